"""Aggregates that are kept, not counted anew: a batch adds its partial sums and latest values to those of its keys.

Counts and sums add up, a latest value is the largest of its order, so batches may be cut anywhere. Each key's row
says which batch it took last: a batch that is repeated after a failure adds nothing twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import BucketedState


@dataclass
class Rolling:
    """keys, name -> column to be summed (``F.lit(1)`` counts), name -> (column, what orders it)."""

    keys: list[str]
    sums: dict[str, Column]
    latest: dict[str, tuple[Column, list[Column]]] = field(default_factory=dict)

    def partial(self, rows: DataFrame, batch: int) -> DataFrame:
        """What one batch adds; null keys are a key."""
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in self.sums.items()]
        last = [F.max(F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("value")))).alias(n) for n, (value, order) in self.latest.items()]
        return rows.groupBy(*self.keys).agg(*sums, *last).withColumn("batch", F.lit(batch).cast("long"))

    def merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Rows of ``old`` with what ``new`` adds to those that haven't taken its batch yet."""
        both = old.withColumn("_added", F.lit(False)).unionByName(new.withColumn("_added", F.lit(True)))
        took = F.max(F.when(~F.col("_added"), F.col("batch"))).alias("_took")
        counted = both.groupBy(*self.keys).agg(took, F.collect_list(F.struct("_added", "batch", *self.sums, *self.latest)).alias("_rows"))  # two a key
        rows = F.filter("_rows", lambda r: ~r["_added"] | F.col("_took").isNull() | (r["batch"] > F.col("_took")))
        counted = counted.withColumn("_rows", rows)
        total = lambda n: F.aggregate("_rows", F.lit(0).cast(new.schema[n].dataType), lambda s, r: (s + r[n]).cast(new.schema[n].dataType)).alias(n)
        best = lambda n: F.array_max(F.transform("_rows", lambda r: r[n])).alias(n)
        return counted.select(*self.keys, *[total(n) for n in self.sums], *[best(n) for n in self.latest], F.array_max(F.transform("_rows", lambda r: r["batch"])).alias("batch"))

    def state(self, sample: DataFrame, path: str, buckets: int = 64) -> BucketedState:
        """The table that keeps them, for rows such as ``sample``'s."""
        schema = self.partial(sample.limit(0), 0).schema
        return BucketedState(sample.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), self.keys, buckets)

    def add(self, held: BucketedState, rows: DataFrame, batch: int) -> None:
        held.change(self.partial(rows, batch), self.merged)

    def values(self, held: BucketedState) -> DataFrame:
        """keys, sums and latest values as they are now."""
        return held.read().select(*self.keys, *self.sums, *[F.col(n)["value"].alias(n) for n in self.latest])


def success_ratio(good: str = "good", bad: str = "bad") -> Column:
    """Null where nothing was tried."""
    return F.when(F.col(good) + F.col(bad) > 0, F.col(good) / (F.col(good) + F.col(bad)))
