"""Sinks: versioned state tables, results by channel, and bad records."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..session import checkpointed


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Result rows, a folder for each channel."""
    results.write.mode(mode).partitionBy("channel").parquet(path)


def write_bad_records(rows: DataFrame, is_bad: Column, path: str) -> DataFrame:
    """Writes what can't be parsed and returns the rest."""
    rows.where(is_bad).write.mode("append").parquet(path)
    return rows.where(~is_bad)


class ConcurrentWrite(RuntimeError):
    """Another writer has claimed the same version of a table."""


class _Versioned:
    """A folder whose present version is kept in one of two places by turns, so that one of them is always whole.

    Writers claim the next version before they change anything and look whether anyone else has; who
    sees another claim stops, so of two writers at a time one at most goes on. A change
    that broke off leaves a claim behind; ``release`` it once its writer is known to be gone.
    """

    _HEAD = "version long, buckets int"

    def __init__(self, spark: SparkSession, path: str, columns: str):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), columns
        self.names = spark.createDataFrame([], columns).columns

    def _head(self) -> tuple[int, int] | None:
        """(version, buckets), or null for a folder that isn't made yet."""
        found = []
        for turn in (0, 1):
            try:
                found += [tuple(r) for r in self.spark.read.schema(self._HEAD).parquet(f"{self.path}/head{turn}").collect()]
            except AnalysisException:
                continue
        return max(found, default=None)

    def _set(self, version: int, buckets: int = 0) -> None:
        self.spark.createDataFrame([(version, buckets)], self._HEAD).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/head{version % 2}")

    def version(self) -> int | None:
        head = self._head()
        return head[0] if head else None

    def _next(self) -> int:
        known = self.version()
        return 0 if known is None else known + 1

    def _claim(self) -> int:
        mine, version = uuid.uuid4().hex, self._next()
        at = f"{self.path}/claims/{version}"
        self.spark.createDataFrame([(mine,)], "writer string").coalesce(1).write.mode("append").parquet(at)
        writers = {r["writer"] for r in self.spark.read.schema("writer string").parquet(at).collect()}
        if writers - {mine, ""}:
            raise ConcurrentWrite(f"version {version} of {self.path} has {len(writers)} writers")
        return version

    def release(self) -> None:
        """Give up the claims on the next version, whose writer is gone."""
        self.spark.createDataFrame([("",)], "writer string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/claims/{self._next()}")


class StateTable(_Versioned):
    """A table that is replaced as a whole: versions ``v=<n>`` below a folder; a version counts once it is complete."""

    def read(self) -> DataFrame:
        known = self.version()
        return self.spark.createDataFrame([], self.columns) if known is None else self.spark.read.schema(self.columns).parquet(f"{self.path}/v={known}")

    def write(self, rows: DataFrame) -> None:
        """The next version; readers of the one before are not disturbed."""
        version = self._claim()
        rows.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        self._set(version)


class BucketedState(_Versioned):
    """A table of keyed rows in buckets by hash of the key: a change reads and writes only the buckets that its keys fall into."""

    def __init__(self, spark: SparkSession, path: str, columns: str, keys: list[str], buckets: int = 64):
        super().__init__(spark, path, columns)
        self.keys, self.buckets = keys, buckets
        head = self._head()
        if head:
            self.buckets = head[1]  # as it was made
        else:
            self._empty(range(buckets))
            self._set(0, buckets)

    def _empty(self, buckets) -> None:
        """A file without rows would leave no folder, so each bucket begins with a row of nulls, which reading drops."""
        kinds = self.spark.createDataFrame([], self.columns).schema
        rows = self.spark.createDataFrame([(b,) for b in buckets], "_bucket int")
        rows.select(*[F.lit(None).cast(kinds[n].dataType).alias(n) for n in self.names], F.lit(True).alias("_none"), "_bucket").repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")

    def _of(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; only their folders are listed."""
        at = f"{self.path}/rows"
        folders = [at] if buckets is None else [f"{at}/_bucket={b}" for b in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(f"{self.columns}, _none boolean, _bucket int").option("basePath", at).parquet(*folders).where(F.col("_none").isNull()).select(*self.names)

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["_bucket"] for r in self._of(rows).select("_bucket").distinct().collect())  # as many as there are buckets, at most

    def change(self, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """What ``merged`` makes of the touched buckets' rows and ``rows``, which share their keys; the buckets that were written."""
        rows = checkpointed(rows)
        buckets = self.touched(rows)
        if not buckets:
            return []
        version = self._claim()
        now = checkpointed(self._of(merged(self.read(buckets), rows)))
        left = {r["_bucket"] for r in now.select("_bucket").distinct().collect()}
        now.select(*self.names, F.lit(None).cast("boolean").alias("_none"), "_bucket").repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")
        if set(buckets) - left:
            self._empty(sorted(set(buckets) - left))
        self._set(version, self.buckets)
        return buckets

    def upsert(self, rows: DataFrame, order: list[str]) -> list[int]:
        """Rows take the place of those with their key, the last by ``order`` of several; the buckets that were written."""
        return self.change(rows, lambda old, new: state.upsert(old, new, self.keys, order))

    def delete(self, rows: DataFrame) -> list[int]:
        """Without the keys of ``rows``."""
        return self.change(rows.select(*self.keys).distinct(), lambda old, gone: old.join(gone, self.keys, "left_anti"))
