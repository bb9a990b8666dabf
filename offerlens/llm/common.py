"""Helpers that several operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, shared_root  # noqa: F401  (operators of this folder take them from here)
from ..session import shared_folder as shared_path  # noqa: F401

#: Bytes of text that a Python function takes at a time; an Arrow batch itself holds 64 MB at most by Spark's default.
SLICE_BYTES = 8 << 20
_BLANK = re.compile(rb"[ \t\n\v\f\r]")


def of_unknown_size(df: DataFrame) -> DataFrame:
    """The same rows without size estimates.

    A checkpoint keeps its plan's estimate, and joins multiply them: in a loop the
    digits of that number double with each round and fill the driver's memory.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def sliced(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of record batches that hold at most ``most`` bytes of a text column each, or one row."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists from pieces of about ``size`` bytes: a list of all words of a long text takes many times its bytes."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            found = _BLANK.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 16, how: str = "left") -> DataFrame:
    """Join where a key of ``big`` may hold a third of all rows.

    Each row of ``small`` (one a key) is repeated for every salt, and rows of
    ``big`` take the salt that ``spread`` gives, so a hot key is dealt over
    ``salts`` tasks. Null keys match null keys.
    """
    b = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    s = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys], F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_k_salt"))
    s = s.hint("merge")  # Spark's size estimate doesn't know of the repeats, so it might broadcast far more than its threshold
    on = b["_salt"] == s["_k_salt"]
    for k in keys:
        on = on & b[k].eqNullSafe(s[f"_k_{k}"])
    return b.join(s, on, how).drop("_salt", "_k_salt", *[f"_k_{k}" for k in keys])


def heated_lookup(big: DataFrame, small: DataFrame, key: str, most: int = 20_000) -> DataFrame:
    """Left join on one key (null matches null) of which ``big`` may hold a third of all rows.

    The keys of ``big`` are counted first; the rows of one with more than ``most`` are dealt over
    as many parts as they need, and only its row in ``small`` is repeated.
    """
    hot = checkpointed(big.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most))
    s = small.withColumnRenamed(key, "_key").withColumn("_k_part", F.lit(0))
    b = big.withColumn("_part", F.lit(0))
    if hot.take(1):
        parts = F.broadcast(hot.select("_hot", F.ceil(F.col("_n") / most).cast("int").alias("_parts")))  # one in ``most`` rows of big at most
        b = big.join(parts, big[key].eqNullSafe(F.col("_hot")), "left").drop("_hot")
        b = b.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        s = small.withColumnRenamed(key, "_key").join(parts, F.col("_key").eqNullSafe(F.col("_hot")), "left").drop("_hot")
        s = s.withColumn("_k_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return b.join(s, b[key].eqNullSafe(s["_key"]) & (b["_part"] == s["_k_part"]), "left").drop("_key", "_part", "_k_part")
