"""Ids that have been seen, over all time: buckets by hash, with a Bloom filter each.

A batch reads the filters of the buckets that its ids fall into, and the ids of those
buckets alone whose filter may hold one; what it adds is appended to its buckets. Neither reads nor
writes grow with what other buckets hold, old ids are never shuffled, and the number of folders
is the number of buckets. A bucket's files are put together after COMPACT additions, its filter
is built anew, larger, when it is full.

Ids carry the number of the batch that added them, and a batch only heeds those of earlier ones:
a batch that is repeated after a failure decides as it did at first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

#: Additions to a bucket after which its files become one.
COMPACT = 32
#: Bytes of an empty bucket's filter, bits an id, and probes.
FILTER_BYTES, BITS, PROBES = 1 << 11, 12, 6


def _probes(hashes: np.ndarray, size: int) -> np.ndarray:
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size * 8)).astype(np.int64)


def bloom_add(bits: bytes, hashes: np.ndarray) -> bytes:
    held = np.frombuffer(bits, np.uint8).copy()
    at = _probes(hashes, len(held)).ravel()
    np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return held.tobytes()


def bloom_may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    held = np.frombuffer(bits, np.uint8)
    at = _probes(hashes, len(held))
    return (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)


def _size_for(n: int) -> int:
    size = FILTER_BYTES
    while size * 8 < 2 * BITS * n:
        size *= 2
    return size


_FILTERS = "bucket int, bits binary, n long, files int"


class SeenIndex:
    """Ids of one type below a folder that all executors share. One writer at a time, as a streaming query is."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", buckets: int = 256):
        self.spark, self.path, self.kind, self.buckets = spark, path.rstrip("/"), kind, buckets
        self._ids = f"id {kind}, batch long, bucket int"
        try:
            self.buckets = self.spark.read.schema("buckets int").parquet(f"{self.path}/made").first()["buckets"]  # as it was made
            self.empty = False
        except AnalysisException:
            self.empty = True
            whole = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            nothing = whole.select(F.lit(None).cast(kind).alias("id"), F.lit(-1).cast("long").alias("batch"), "bucket")
            nothing.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ids")
            empty = whole.select("bucket", F.lit(bytes(FILTER_BYTES)).alias("bits"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("files"))
            empty.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/filters")
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/made")  # last, and never again

    def _read(self, what: str, schema: str, buckets: list[int]) -> DataFrame:
        """The given buckets; only their folders are listed."""
        if not buckets:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{what}/bucket={b}" for b in buckets]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*folders)

    def _keyed(self, rows: DataFrame, key: str) -> DataFrame:
        """id, bucket, hash: each id once."""
        h = F.xxhash64("id")
        return rows.select(F.col(key).cast(self.kind).alias("id")).where(F.col("id").isNotNull()).distinct().select("id", F.pmod(h, F.lit(self.buckets)).cast("int").alias("bucket"), F.xxhash64(h, F.lit(1)).alias("hash"))

    @staticmethod
    def _of(keyed: DataFrame) -> list[int]:
        return [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # as many as there are buckets, at most

    def known(self, rows: DataFrame, key: str, batch: int) -> DataFrame:
        """id: those of ``rows`` that batches before ``batch`` have added."""
        if self.empty:
            return self.spark.createDataFrame([], f"id {self.kind}")
        keyed = checkpointed(self._keyed(rows, key))
        filters = self._read("filters", _FILTERS, self._of(keyed))

        def ask(ids: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(ids) or not len(held):
                return ids[["id", "bucket"]].iloc[:0]
            return ids[bloom_may_hold(held["bits"].iloc[0], ids["hash"].to_numpy())][["id", "bucket"]]

        maybe = keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(ask, f"id {self.kind}, bucket int")
        maybe = checkpointed(maybe)
        old = self._read("ids", self._ids, self._of(maybe)).where(F.col("batch") < batch)
        return maybe.select("id").join(old.select("id"), "id", "left_semi")

    def fresh(self, rows: DataFrame, key: str, batch: int) -> DataFrame:
        """``rows`` that no earlier batch has added; a null id is never known."""
        return rows.join(self.known(rows, key, batch).withColumnRenamed("id", "_known"), F.col(key).cast(self.kind) == F.col("_known"), "left_anti")

    def add(self, rows: DataFrame, key: str, batch: int) -> None:
        keyed = checkpointed(self._keyed(rows, key))
        touched = self._of(keyed)
        if not touched:
            return
        self.empty = False
        keyed.select("id", F.lit(batch).cast("long").alias("batch"), "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/ids")
        filters = self._read("filters", _FILTERS, touched)

        def merge(ids: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            row = held.iloc[0]
            n = int(row["n"]) + len(ids)
            full = len(row["bits"]) * 8 < BITS * n
            return pd.DataFrame({"bucket": [int(row["bucket"])], "bits": [None if full else bloom_add(row["bits"], ids["hash"].to_numpy())], "n": [n], "files": [int(row["files"]) + 1]})

        now = checkpointed(keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(merge, _FILTERS))
        worn = [(r["bucket"], r["full"], r["files"]) for r in now.where(F.col("bits").isNull() | (F.col("files") > COMPACT)).select("bucket", F.col("bits").isNull().alias("full"), "files").collect()]
        many = [b for b, _, files in worn if files > COMPACT]
        if many:
            whole = checkpointed(self._read("ids", self._ids, many).groupBy("id", "bucket").agg(F.min("batch").alias("batch")))
            self._replace("ids", whole.select("id", "batch", "bucket").repartition("bucket"))
            now = now.withColumn("files", F.when(F.col("bucket").isin(many), 1).otherwise(F.col("files")))
        full = [b for b, is_full, _ in worn if is_full]
        if full:
            hashed = self._read("ids", self._ids, full).where(F.col("id").isNotNull()).select("id", "bucket").distinct().select("bucket", F.xxhash64(F.xxhash64("id"), F.lit(1)).alias("hash"))

            def build(ids: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"bucket": [int(ids["bucket"].iloc[0])], "bits": [bloom_add(bytes(_size_for(len(ids))), ids["hash"].to_numpy())], "n": [len(ids)]})

            made = hashed.groupBy("bucket").applyInPandas(build, "bucket int, bits binary, n long")
            files = now.select("bucket", "files")
            now = now.where(F.col("bits").isNotNull()).unionByName(made.join(files, "bucket").select("bucket", "bits", "n", "files"))
            now = checkpointed(now)
        self._replace("filters", now.repartition("bucket"))

    def rebuild_filters(self) -> None:
        """All filters from the ids, as after a driver that died while it wrote one."""
        hashed = self.spark.read.schema(self._ids).parquet(f"{self.path}/ids").select("id", "bucket").distinct().select("bucket", F.xxhash64(F.xxhash64("id"), F.lit(1)).alias("hash"), F.col("id").isNull().alias("none"))

        def build(ids: pd.DataFrame) -> pd.DataFrame:
            own = ids.loc[~ids["none"], "hash"].to_numpy()
            return pd.DataFrame({"bucket": [int(ids["bucket"].iloc[0])], "bits": [bloom_add(bytes(_size_for(len(own))), own)], "n": [len(own)], "files": [1]})

        self._replace("filters", checkpointed(hashed.groupBy("bucket").applyInPandas(build, _FILTERS)).repartition("bucket"))

    def _replace(self, what: str, rows: DataFrame) -> None:
        """Only the buckets of ``rows`` are written anew."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{what}")
