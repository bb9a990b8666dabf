"""Operator 7: mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) take the weights in turn and
share the whole token budget; no source may exceed ``max_repeats`` times its own
size, and what it can't take is shared anew by weight. That fixed point is
min(cap, level x weight), and the level follows in closed form from running sums
over the sources sorted by cap / weight.

Order: a source's documents are permuted by a hash of doc_id. Its running token
count there is inverted through the integral of the source's weight schedule,
which gives every copy a training position in [0, 1]; ``ordered`` range-sorts by
it. A source that needs 2.4 passes gives two whole ones and the first 0.4 of the
permutation again.

Scale: running sums go through hash buckets (sums for each bucket, then sums
within one), so a source that holds a third of all rows is dealt over all its
buckets; a bucket that an often repeated doc_id makes hot is split further.
Everything is JVM-side; texts are read twice and, but for ``keep``, never shuffled.

Defined results: null or empty texts have size 0 and are taken 0 words; a table
whose sizes are all 0 has targets 0; repeated rows count one by one; null doc_ids
are permuted by text, rows that share a hot doc_id by their place in the input; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A bucket is hot if it holds this many times the rows that it should; the rows of its hot id are dealt over so many parts.
HOT, PARTS = 8, 256
WORD = r"[^\x20\x09-\x0D]+"
#: A schedule: knots (time, weight), linear between them, times from 0 to 1. Sources take them in turn.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 1.5)),
)


def integral(knots) -> list[float]:
    """Cumulative demand at each knot, as a share of the whole."""
    total, out = 0.0, [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        total += (t1 - t0) * (w0 + w1) / 2
        out.append(total)
    return [x / total for x in out]


def invert(share: Column, knots) -> Column:
    """The time by which a source with this schedule has been asked for ``share`` of its tokens."""
    at = integral(knots)
    total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
    out = F.lit(1.0)
    for (t0, w0), (t1, w1), c0, c1 in reversed(list(zip(knots, knots[1:], at, at[1:], strict=False))):
        slope, need = (w1 - w0) / (t1 - t0), (share - F.lit(c0)) * F.lit(total)
        if abs(slope) < 1e-12:
            t = F.lit(t0) + need / F.lit(w0)
        else:
            t = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        out = F.when(share < F.lit(c1), t).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, weights=(1, 2, 3), max_repeats: float = 3.0) -> DataFrame:
    """(source, source_size) -> + rank, weight, target. One row a source; sizes of sources, not documents, pass through one window."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    s = sizes.withColumn("rank", rank)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    s = s.withColumn("caps", F.sum("cap").over(by_ratio)).withColumn("seen", F.sum("weight").over(by_ratio))
    # with the first k sources at their caps, the level of the others is (total - caps) / (all_weight - seen)
    s = s.withColumn("level", (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_weight") - (F.col("seen") - F.col("weight"))))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("final", F.min(F.when(F.col("free"), F.struct("seen", "level"))).over(whole)["level"])
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")))
    return s.select("source", "source_size", "rank", "weight", "target")


def mix(docs: DataFrame, weights=(1, 2, 3), max_repeats: float = 3.0, schedules=SCHEDULES, bucket_rows: int = 20_000, keep: list[str] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken, positions (one a copy, ascending).

    ``keep`` names further columns to carry along (such as the text, for ``ordered``).
    """
    # documents without an id are permuted by their texts
    order = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.md5(F.xxhash64("text").cast("string")))
    buckets = max(256, docs.count() // bucket_rows)  # of each source; a count of Parquet reads footers only
    d = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("_order"), F.monotonically_increasing_id().alias("_place"), *keep)
    d = d.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("long"))
    # a key that is never null: window and join then share one shuffle of the rows
    d = d.withColumn("_s", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))))
    d = d.withColumn("_part", F.lit(0))
    parts = lambda rows: common.checkpointed(rows.groupBy("_s", "source", "_bucket", "_part").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n")))
    per_bucket = parts(d)
    hot = common.checkpointed(per_bucket.where(F.col("_n") > HOT * bucket_rows).select("_s", "_bucket"))  # one in HOT * bucket_rows rows at most
    if hot.take(1):
        d = _split(d, hot)
        per_bucket = parts(d)
    before = Window.partitionBy("_s").orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    of_bucket = per_bucket.select("_s", "_bucket", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    of_source = targets(per_bucket.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_repeats)
    of_source = of_source.withColumn("_s", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))).drop("source")
    facts = of_bucket.join(of_source, "_s").select("_s", "_bucket", "_part", "_ahead", "source_size", "rank", "target")
    inside = Window.partitionBy("_s", "_bucket", "_part").orderBy("_order", "doc_id", F.when(F.col("_part") == 0, F.col("size")), "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_upto", F.sum("size").over(inside)).join(facts, ["_s", "_bucket", "_part"])
    d = d.withColumn("_at", F.col("_ahead") + F.col("_upto") - F.col("size"))
    # whole passes, then those documents of the permutation whose middle lies within what is left
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("target") - passes * F.col("source_size")
    again = (F.col("_at") + F.col("size") / 2 < left).cast("long")
    d = d.withColumn("copies", (passes + F.when(F.col("source_size") > 0, again).otherwise(F.lit(0))).cast("int"))
    d = d.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    share = lambda i: (F.col("_at") + i * F.col("source_size")) / F.col("target")
    when = lambda i: _by_rank(share(i), F.col("rank"), schedules)
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), when)).otherwise(F.array().cast("array<double>"))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", positions.alias("positions"), *keep)


def _split(d: DataFrame, hot: DataFrame) -> DataFrame:
    """Numbers parts of hot buckets: ids are dealt evenly, so such a bucket holds an id that very many rows share, whose rows are dealt over ``PARTS``."""
    marked = d.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), ["_s", "_bucket"], "left")
    ids = marked.where("_hot").groupBy("_s", "_bucket", "_order").agg(F.count(F.lit(1)).alias("_n"))
    most = common.checkpointed(ids.groupBy("_s", "_bucket").agg(F.max_by("_order", "_n").alias("_hot_order")))  # one a hot bucket
    marked = d.join(F.broadcast(most), ["_s", "_bucket"], "left")
    part = F.when(F.col("_order") < F.col("_hot_order"), 0).when(F.col("_order") > F.col("_hot_order"), PARTS + 1).otherwise(1 + F.pmod(F.xxhash64("_place"), F.lit(PARTS)))
    return marked.withColumn("_part", F.coalesce(part, F.lit(0)).cast("int")).drop("_hot_order")


def _by_rank(share: Column, rank: Column, schedules) -> Column:
    out = invert(share, schedules[0])
    for i, knots in enumerate(schedules[1:], 1):
        out = F.when(rank % len(schedules) == i, invert(share, knots)).otherwise(out)
    return out


def ordered(mixed: DataFrame) -> DataFrame:
    """One row a copy, range-sorted by training position; ties by doc_id."""
    rows = mixed.select("*", F.explode("positions").alias("position")).drop("positions")
    return rows.orderBy("position", "doc_id")


def by_first_position(mixed: DataFrame) -> DataFrame:
    """One row a document, range-sorted by its training positions, those that are never taken last; ties by doc_id."""
    return mixed.orderBy(F.size("positions") == 0, "positions", "doc_id")
