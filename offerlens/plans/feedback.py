"""Learning from people's replies: corrections become rules, overrides and mappings, in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions import text as tx
from ..operators import state


def associated(replies: DataFrame, items: DataFrame) -> DataFrame:
    """Replies with the item whose message they answer (message_id)."""
    return replies.join(items, "message_id")


def last_with_message(errors: DataFrame) -> DataFrame:
    """The newest error of each message."""
    return state.last_wins(errors, ["message_id"], ["id"])


def replied_url(replies: DataFrame) -> DataFrame:
    """Replies whose text holds a product URL, with it."""
    return replies.withColumn("corrected_url", urls.first_product_url(F.col("text"))).where(F.col("corrected_url").isNotNull())


def code_of_slug(codes: DataFrame) -> DataFrame:
    """(slug, code): the last code of a shared slug."""
    return codes.groupBy("slug").agg(F.max_by("code", "pos").alias("code"))


def corrections(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """generated_url, corrected_url, collector_number, set_code, ... -> + failed_slug, correct_slug, learned_prefix, rule_code.

    A rule belongs to the known set code, else to that of the set's slug in the corrected URL.
    """
    df = rows.withColumn("failed_slug", urls.last_segment(F.col("generated_url"))).withColumn("correct_slug", urls.last_segment(F.col("corrected_url")))
    df = df.withColumn("learned_prefix", urls.learned_prefix(F.col("failed_slug"), F.col("correct_slug"), F.col("collector_number"))).withColumn("_slug", urls.after_singles(F.col("corrected_url"))["set_slug"])
    df = df.join(code_of_slug(codes).withColumnRenamed("code", "_code").withColumnRenamed("slug", "_slug"), "_slug", "left")
    return df.withColumn("rule_code", F.upper(F.coalesce(F.nullif("set_code", F.lit("")), "_code"))).drop("_slug", "_code")


def learned_rules(current: DataFrame, corrected: DataFrame) -> DataFrame:
    batch = corrected.where(F.col("learned_prefix").isNotNull() & F.col("rule_code").isNotNull())
    return state.upsert_prefix_rules(current, batch.select(F.col("rule_code").alias("set_code"), F.col("learned_prefix").alias("prefix"), "set_name", "ts", "seq"))


def learned_overrides(current: DataFrame, corrected: DataFrame) -> DataFrame:
    """The last corrected URL of each fingerprint."""
    batch = corrected.select("fingerprint", F.col("corrected_url").alias("url"), F.col("correct_slug").alias("preferred_slug"), F.col("ts").alias("created_at"), "seq")
    return state.upsert(current, batch, ["fingerprint"], ["created_at", "seq"])


def variant_hints(corrected: DataFrame) -> DataFrame:
    """(name_slug, set_code, digits, slug): the preferred slug of a card with several variants; the last correction wins."""
    rows = corrected.where(F.col("rule_code").isNotNull()).select(urls.hyphened("card_name").alias("name_slug"), F.col("rule_code").alias("set_code"), tx.digits("collector_number").alias("digits"), F.col("correct_slug").alias("slug"), "ts", "seq")
    return state.last_wins(rows, ["name_slug", "set_code", "digits"], ["ts", "seq"]).drop("ts", "seq")


def learned_mappings(current: DataFrame, corrected: DataFrame, site: urls.Site = urls.Site()) -> DataFrame:
    """Mappings of confidence 1 for corrected cards, appended."""
    new = corrected.select("title", "fingerprint", "card_name", "collector_number", "set_code", urls.normalised_url(F.col("corrected_url"), site).alias("url"), F.col("correct_slug").alias("product_name"), F.lit(1.0).alias("confidence"), F.col("ts").alias("date_added"))
    return state.append(current, new)


def id_slugs(replies: DataFrame) -> DataFrame:
    """Replies with a product id: id_product and the slugs of the corrected URL."""
    at = urls.after_singles(F.col("corrected_url"))
    return replies.withColumn("id_product", tx.product_id("text")).where(F.col("id_product").isNotNull()).withColumn("set_slug", at["set_slug"]).withColumn("product_slug", at["product_slug"])


def store_id_slugs(current: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(product slugs by id, expansion slugs by id with match_count) after a batch of id_product, product_slug, id_expansion, set_slug, ts, seq."""
    products = state.upsert(current.where(F.col("id_product").isNotNull()).select("id_product", "product_slug"), batch.where(F.col("id_product").isNotNull()), ["id_product"], ["ts", "seq"])
    new = state.count_upserts(batch.where(F.col("id_expansion").isNotNull()), ["id_expansion"], "set_slug", ["ts", "seq"]).select("id_expansion", F.col("set_slug").alias("_slug"), F.col("match_count").alias("_n"))
    old = current.where(F.col("id_expansion").isNotNull()).select("id_expansion", "set_slug", "match_count")
    both = old.join(new, "id_expansion", "full_outer")
    return products, both.select("id_expansion", F.coalesce("_slug", "set_slug").alias("set_slug"), (F.coalesce("match_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("match_count"))


def expansion_ids(rows: DataFrame, products: DataFrame, id_slugs_table: DataFrame) -> DataFrame:
    """id_expansion of each row: by its product id in the catalogue, else by its set name's slug (the smallest id)."""
    by_product = products.groupBy("id_product").agg(F.min("id_expansion").alias("_a")).select(F.col("id_product").alias("_pid"), "_a")
    by_slug = id_slugs_table.where(F.col("id_expansion").isNotNull()).groupBy("set_slug").agg(F.min("id_expansion").alias("_b")).select(F.col("set_slug").alias("_slug"), "_b")
    df = rows.withColumn("_pid", F.col("product_id").try_cast("long")).withColumn("_slug", tx.set_slug("set_name"))
    return df.join(by_product, "_pid", "left").join(by_slug, "_slug", "left").withColumn("id_expansion", F.coalesce("_a", "_b")).drop("_a", "_b", "_pid", "_slug")


def stub_listings(rows: DataFrame) -> DataFrame:
    """Review or error rows as listings again: without a price 0, without a currency EUR."""
    from ..schemas import migrated

    listed = migrated(rows, "listing")
    return listed.withColumn("price", F.coalesce("price", F.lit(0.0))).withColumn("currency", F.coalesce(F.nullif("currency", F.lit("")), F.lit("EUR")))
