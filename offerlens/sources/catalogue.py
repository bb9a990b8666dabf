"""Catalogue and price-guide snapshots in JSON, wrapped or bare, with upper- or lower-case keys."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema
from . import json_split

# Keys under which a snapshot wraps its list.
PRODUCT_KEYS = ("productList", "products")
PRICE_KEYS = ("priceGuide", "prices")


def _items(raw: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(pos, item): the entries of a list, of a known key's list, or of the first list in an object."""
    text = F.trim("value")
    known = F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in keys])
    fields = F.map_values(F.from_json(text, "map<string,string>"))
    any_list = F.try_element_at(F.filter(fields, lambda v: F.ltrim(v).startswith("[")), F.lit(1))
    body = F.when(text.startswith("["), text).otherwise(F.coalesce(known, any_list))
    return raw.select(F.posexplode(F.from_json(body, "array<string>")).alias("pos", "item"))


def _any(item: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(item, f"$.{n}") for n in names])


def products(raw: DataFrame) -> DataFrame:
    """Snapshot text (column value, one row a file) -> product rows; ``pos`` is the place in the file, ids without a number go."""
    return product_rows(_items(raw, PRODUCT_KEYS))


def product_rows(items: DataFrame) -> DataFrame:
    """Product rows of a snapshot's entries (pos, item)."""
    i = F.col("item")
    rows = items.select(
        F.col("pos").cast("long"), _any(i, "idProduct").try_cast("long").alias("id_product"), _any(i, "name").alias("name"), _any(i, "number").alias("number"),
        _any(i, "expansionName").alias("expansion_name"), _any(i, "idExpansion").try_cast("long").alias("id_expansion"), _any(i, "rarity").alias("rarity"),
    )
    return rows.where(F.col("id_product").isNotNull())


def prices(raw: DataFrame) -> DataFrame:
    """Price rows; the last row of an id wins."""
    return price_rows(_items(raw, PRICE_KEYS))


def price_rows(items: DataFrame) -> DataFrame:
    i = F.col("item")
    both = lambda name: _any(i, name.upper(), name).try_cast("double").alias(name)
    rows = items.select("pos", _any(i, "idProduct").try_cast("long").alias("id_product"), *[both(n) for n in ("low", "sell", "trend", "avg1", "avg7", "avg30")])
    names = [f.name for f in schema("price") if f.name != "id_product"]
    last = rows.where(F.col("id_product").isNotNull()).groupBy("id_product").agg(F.max_by(F.struct(*names), "pos").alias("_r"))
    return last.select("id_product", *[F.col("_r")[n].alias(n) for n in names])


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, value): a row a file, for snapshots of a few MB; larger ones go through ``Snapshots``."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def newest_valid(files: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The newest snapshot that holds at least one entry: a broken download leaves the one before in use."""
    valid = files.where(F.size(F.from_json(F.when(F.trim("value").startswith("["), F.trim("value")).otherwise(F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in keys], F.lit("[]"))), "array<string>")) > 0)
    return valid.orderBy(F.desc("modified"), "path").limit(1)


def is_fresh(modified_epoch: float | None, hours: float, now: float | None = None) -> bool:
    """Younger than ``hours``."""
    return modified_epoch is not None and (time.time() if now is None else now) - modified_epoch < hours * 3600


def fresh(modified: Column, now: Column, hours: Column | float) -> Column:
    """Whether what was modified then is younger than ``hours``; null times aren't."""
    age = F.unix_micros(now) - F.unix_micros(modified)
    return F.coalesce(age < (F.lit(hours) if not isinstance(hours, Column) else hours) * 3_600_000_000, F.lit(False))


class Snapshots:
    """The newest valid snapshot of a folder, of any size, as a lookup that changes while a stream runs.

    ``items`` is asked by each batch: it looks for newer files at most every ``hours`` (or at once, as asked), takes the
    newest that holds an entry, and keeps the one in use if none does: a broken download changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...], hours: float = 24.0):
        self.spark, self.folder, self.keys, self.hours = spark, folder, keys, hours
        self.path: str | None = None
        self.looked = float("-inf")

    def refresh(self, now: float | None = None, at_once: bool = False) -> bool:
        """Whether another snapshot is in use from now on."""
        now = time.time() if now is None else now
        if not at_once and now - self.looked < self.hours * 3600:
            return False
        self.looked = now
        files = self.spark.read.format("binaryFile").load(self.folder).select("path", "modificationTime")  # names and times; contents aren't read
        for row in files.orderBy(F.desc("modificationTime"), F.desc("path")).toLocalIterator():
            if row["path"] == self.path:
                return False
            if json_split.elements(self.spark, row["path"], self.keys).take(1):
                self.path = row["path"]
                return True
        return False

    def items(self, now: float | None = None) -> DataFrame:
        """(path, pos, item) of the snapshot in use; no rows before the first."""
        self.refresh(now)
        if self.path is None:
            return self.spark.createDataFrame([], "path string, pos long, item string")
        return json_split.elements(self.spark, self.path, self.keys)
