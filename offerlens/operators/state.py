"""State tables without MERGE: each function is (current, batch) -> next.

A batch carries ``ts`` and, for ties, a unique ``seq``; current rows come before
any batch. Tables are rewritten as new versions by the sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import with_group_facts


def _order(order: list[str], newest: bool) -> list[Column]:
    return [F.col(c).desc() if newest else F.col(c).asc() for c in order]


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*_order(order, False)))
    return rows.withColumn("_n", rank).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; combined before the shuffle, since it is an aggregate."""
    others = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return picked.select(*key, *[F.col("_r")[c].alias(c) for c in others]).select(*rows.columns)


def insert_or_ignore(current: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    new = first_wins(batch, key, order).join(current.select(*key), key, "left_anti")
    return current.unionByName(new.select(*current.columns))


def upsert(current: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    latest = last_wins(batch, key, order)
    return current.join(latest.select(*key), key, "left_anti").unionByName(latest.select(*current.columns))


def insert_if_absent(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each key; rows with a null or empty part of the key all stay."""
    partial = F.lit(False)
    for k in key:
        partial = partial | F.col(k).isNull() | (F.col(k).cast("string") == "")
    return rows.where(partial).unionByName(first_wins(rows.where(~partial), key, order))


def update_columns(current: DataFrame, changes: DataFrame, key: list[str], columns: list[str], order: list[str] = ()) -> DataFrame:
    """``columns`` of the changed keys take the change's values where it has one; of several changes of a key the last counts (by ``order``)."""
    changes = last_wins(changes.select(*key, *columns, *[c for c in order if c not in columns]), key, order or columns)
    new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = current.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else c for c in current.columns])


def delete_keys(current: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return current.join(keys.select(*key).distinct(), key, "left_anti")


def append(current: DataFrame, batch: DataFrame) -> DataFrame:
    return current.unionByName(batch, allowMissingColumns=True)


def count_upserts(events: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """The latest value of each key and how often it was written (match_count)."""
    return events.groupBy(*key).agg(F.max_by(F.col(value), F.struct(*order)).alias(value), F.count(F.lit(1)).alias("match_count"))


def success_ratio(events: DataFrame, key: list[str], success: Column) -> DataFrame:
    """Successes, failures and confidence s / (s + f) of each key."""
    out = events.groupBy(*key).agg(F.sum(F.when(success, 1).otherwise(0)).alias("uses_successful"), F.sum(F.when(success, 0).otherwise(1)).alias("uses_failed"))
    return out.withColumn("confidence", F.col("uses_successful") / (F.col("uses_successful") + F.col("uses_failed")))


def upsert_prefix_rules(current: DataFrame, batch: DataFrame) -> DataFrame:
    """New (set_code, prefix) rules start with one success and confidence 1; known ones count up and keep their confidence.

    A rule's set name is the latest known one. ``batch``: set_code, prefix, set_name, ts, seq.
    """
    new = batch.groupBy("set_code", "prefix").agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.col("set_name"), F.when(F.col("set_name").isNotNull(), F.struct("ts", "seq"))).alias("_name"))
    both = current.join(new, ["set_code", "prefix"], "full_outer")
    return both.select(
        "set_code", "prefix", F.coalesce("_name", "set_name").alias("set_name"),
        (F.coalesce("uses_successful", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("uses_successful"),
        F.coalesce("uses_failed", F.lit(0)).cast("long").alias("uses_failed"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def expired(reviews: DataFrame, now: Column, days: int, by_date: bool = False) -> DataFrame:
    """Pending reviews older than ``days`` become expired; ``by_date`` only when their date is before the cutoff's."""
    cutoff = now - F.make_interval(days=F.lit(days))
    old = F.to_date("created_at") < F.to_date(cutoff) if by_date else F.col("created_at") < cutoff
    return reviews.withColumn("status", F.when((F.col("status") == "pending") & old, F.lit("expired")).otherwise(F.col("status")))


def resolve(reviews: DataFrame, replies: DataFrame) -> DataFrame:
    """Reviews that a reply (listing_id, resolved_by, resolved_url, resolved_at) settles."""
    done = update_columns(reviews, replies.withColumn("status", F.lit("resolved")), ["listing_id"], ["status", "resolved_by", "resolved_url", "resolved_at"], ["resolved_at"])
    return done


def seeded(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """Defaults (key, value) for the keys that aren't set."""
    return settings.unionByName(defaults.join(settings.select("key"), "key", "left_anti").select(*settings.columns))


def least_counts(rows: DataFrame, group: str, count: str) -> DataFrame:
    """Rows at the smallest count of groups with more than one row; ties all belong to them."""
    marked = with_group_facts(rows, group, F.min(count).alias("_least"), F.count(F.lit(1)).alias("_rows"))
    return marked.where((F.col("_rows") > 1) & (F.col(count) == F.col("_least"))).drop("_least", "_rows")


def purge_least(rows: DataFrame, group: str, count: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays, what was deleted)."""
    gone = least_counts(rows, group, count)
    return delete_keys(rows, gone, key), gone


def filled(rows: DataFrame, column: str) -> DataFrame:
    """Rows that have a value there; an empty string is none."""
    return rows.where(F.col(column).isNotNull() & (F.col(column).cast("string") != ""))


def first_of_key(rows: DataFrame, keys: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each asked key."""
    return first_wins(rows.join(keys.select(*key).distinct(), key, "left_semi"), key, order)
