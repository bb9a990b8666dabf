"""The running service as queries: reviews that expire or are answered, settings that change while a stream runs, state in buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import prefilter, rolling
from ..session import shared_folder
from ..sources import sinks
from ..streaming import reviews
from ..streaming.offers import Service
from . import decision_queries as decisions
from .registry import query, table

#: Days that a review waits, and where the streams are stopped and started anew.
WAIT_DAYS = 0.2
CUTS = ("2024-01-11", "2024-01-21")
_URL = "https://www.market.example/en/X/Products/Singles/S/"

_HAPPENED = f"""a AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'click'),
r AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 5 = 0 THEN event_id + json_extract(props, '$.k')::BIGINT ELSE event_id - json_extract(props, '$.k')::BIGINT END AS ref,
             CASE WHEN event_id % 3 <> 0 THEN '{_URL}' || event_id END AS url FROM events WHERE event_type IN ('purchase', 'view')),
w AS (SELECT {int(WAIT_DAYS * 86_400_000)} AS wait, (SELECT max(ms) FROM (SELECT ms FROM a UNION ALL SELECT ms FROM r)) - 3600000 AS seen),
c AS (SELECT a.id, a.ms AS asked, r.* EXCLUDE (ref) FROM a JOIN r ON r.ref = a.id, w WHERE r.ms BETWEEN a.ms - wait AND a.ms + wait),
f AS (SELECT id, min((ms, seq)) FILTER (WHERE url IS NOT NULL) AS won FROM c GROUP BY id)"""


def _stamped(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _requests(events: DataFrame) -> DataFrame:
    rows = events.where("event_type = 'click'")
    return rows.select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), F.col("user_id").cast("string").alias("item"), F.col("ts").alias("asked_at"))


def _replies(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    ref = F.when(F.col("event_id") % 5 == 0, F.col("event_id") + k).otherwise(F.col("event_id") - k)
    text = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(f"see {_URL}"), F.col("event_id").cast("string"), F.lit("."))).otherwise(F.lit("no link"))
    rows = events.where("event_type IN ('purchase', 'view')")
    return rows.select(F.concat(F.lit("m"), ref.cast("string")).alias("message_id"), text.alias("text"), F.col("ts").alias("replied_at"), F.col("event_id").alias("seq"))


def _parts(events: DataFrame) -> list[DataFrame]:
    one, two = (F.lit(c).cast("timestamp") for c in CUTS)
    return [events.where(F.col("ts") < one), events.where((F.col("ts") >= one) & (F.col("ts") < two)), events.where(F.col("ts") >= two)]


@query(f"""WITH {_HAPPENED}
SELECT 'm' || id AS message_id, 'answered' AS outcome, url, greatest(c.ms, asked)::BIGINT AS at_ms FROM c JOIN f USING (id) WHERE (c.ms, c.seq) = f.won
UNION ALL SELECT 'm' || id, 'no_url', NULL, greatest(c.ms, asked) FROM c JOIN f USING (id) WHERE url IS NULL AND (f.won IS NULL OR (c.ms, c.seq) < f.won)
UNION ALL SELECT 'm' || a.id, 'expired', NULL, a.ms + wait FROM a LEFT JOIN f USING (id), w WHERE f.won IS NULL AND a.ms + wait <= seen""")
def q_review_lifecycle(spark, sf_dir):
    """Reviews answered or expired by timers, over a stream that is stopped and started anew twice."""
    folder, events = shared_folder(spark, "reviews"), _stamped(spark, sf_dir)
    for part in _parts(events):
        part.write.mode("append").parquet(f"{folder}/landed")
        landed = spark.readStream.schema(events.schema).parquet(f"{folder}/landed")
        out = reviews.lifecycle(reviews.happenings(_requests(landed), _replies(landed)), WAIT_DAYS)
        reviews.started(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    done = spark.read.schema(reviews.OUTCOMES).parquet(f"{folder}/out")
    return done.select("message_id", "outcome", "url", F.unix_millis("at").alias("at_ms"))


@query(f"""WITH {_HAPPENED}, p AS (SELECT a.id, count(r.seq) AS n, min(r.seq) AS first FROM a LEFT JOIN r ON r.ref = a.id AND r.ms BETWEEN a.ms AND a.ms + {int(WAIT_DAYS * 86_400_000)} GROUP BY a.id)
SELECT 'm' || id AS message_id, n AS replies, first FROM p JOIN a USING (id), w WHERE n > 0 OR a.ms < seen - 86400000""")
def q_request_reply(spark, sf_dir):
    """A join of the streams of requests and replies, stopped and started anew; requests of the last day may still wait."""
    folder, events = shared_folder(spark, "answers"), _stamped(spark, sf_dir).withColumn("ts", F.date_trunc("millisecond", "ts"))
    newest = events.where("event_type IN ('click', 'purchase', 'view')").agg(F.max("ts").alias("newest"))
    for part in _parts(events):
        _requests(part).write.mode("append").parquet(f"{folder}/asked")
        _replies(part).write.mode("append").parquet(f"{folder}/said")
        streams = [spark.readStream.schema(df.schema).parquet(f"{folder}/{name}") for df, name in ((_requests(part), "asked"), (_replies(part), "said"))]
        reviews.started(reviews.answers(*streams, WAIT_DAYS), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{folder}/out").groupBy("message_id", "asked_at").agg(F.count("seq").alias("replies"), F.min("seq").alias("first")).crossJoin(F.broadcast(newest))  # one row
    old = F.unix_millis("asked_at") < F.unix_millis("newest") - 3_600_000 - 86_400_000
    return done.where((F.col("replies") > 0) | old).select("message_id", "replies", "first")


_KEYS = ("min_price", "max_price", "review_days", "slug_confidence_threshold", "fuzzy_threshold", "max_results")


@query(f"""WITH n AS (SELECT list_value({', '.join(f"'{k}'" for k in _KEYS)}, 'unknown')[n_nationkey % 7 + 1] AS key, CASE WHEN n_nationkey % 5 = 4 THEN 'bad' WHEN n_nationkey % 2 = 0 THEN (n_nationkey * 3)::VARCHAR ELSE n_nationkey || '.5' END AS value FROM nation),
l AS (SELECT key, max(value) AS value FROM n GROUP BY key),
d AS (SELECT * FROM (VALUES ('min_price', 0.5), ('max_price', 500), ('review_days', 5), ('slug_confidence_threshold', 0.6), ('fuzzy_threshold', 80), ('max_results', 12)) t(key, base))
SELECT key, coalesce(try_cast(value AS DOUBLE), base)::DOUBLE AS value FROM d LEFT JOIN l USING (key)""")
def q_settings(spark, sf_dir):
    """Defaults, a file's tree, the environment, then rows of the settings table: with a point a float, else whole, bad ones ignored."""
    k = F.col("n_nationkey")
    names = F.array(*[F.lit(x) for x in (*_KEYS, "unknown")])
    value = F.when(k % 5 == 4, "bad").when(k % 2 == 0, (k * 3).cast("string")).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    rows = table(spark, sf_dir, "nation").select(F.element_at(names, (k % 7 + 1).cast("int")).alias("key"), value.alias("value"))
    base = config.load({"max_results": 10, "review_days": 5}, {"OFFERLENS_MAX_RESULTS": "12"})
    row = config.as_row(rows, base)
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"_settings.{n}").alias("value")) for n in _KEYS])).alias("x")).select("x.*")


@query("""WITH lim AS (SELECT max(s_nationkey) FILTER (WHERE s_suppkey % 2 = 0) + 900 AS first, max(s_nationkey) + 1100 AS second FROM supplier)
SELECT p_partkey, CASE WHEN p_retailprice BETWEEN 0.5 AND CASE WHEN p_partkey % 2 = 0 THEN first ELSE second END THEN NULL ELSE 'price_out_of_range' END AS reason FROM part, lim""")
def q_live_settings(spark, sf_dir):
    """A limit that changes between two batches of one stream; it is a column of the batch, no constant of the plan."""
    folder = shared_folder(spark, "settings")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lit("Pikachu 4/102").alias("title"), F.lit("").alias("description"), F.col("p_retailprice").alias("price"))
    suppliers = table(spark, sf_dir, "supplier")

    def batch(rows: DataFrame, n: int) -> None:
        now = config.with_live(rows, spark.read.schema("key string, value string").parquet(f"{folder}/settings"))
        now.select("p_partkey", prefilter.reason(config.Live()).alias("reason")).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    for rest, add in ((0, 900), (1, 1100)):
        limit = suppliers.where(F.lit(rest == 1) | (F.col("s_suppkey") % 2 == 0)).agg(F.max("s_nationkey") + add)
        limit.select(F.lit("max_price").alias("key"), F.col(limit.columns[0]).cast("string").alias("value")).write.mode("overwrite").parquet(f"{folder}/settings")
        parts.where(F.col("p_partkey") % 2 == rest).write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(parts.schema).parquet(f"{folder}/landed")
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("p_partkey bigint, reason string").option("recursiveFileLookup", True).parquet(f"{folder}/out")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS priority, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS price FROM orders WHERE o_orderkey % 5 <> 1""")
def q_bucketed_state(spark, sf_dir):
    """Upserts and deletes that rewrite the buckets of their keys alone."""
    held = sinks.BucketedState(spark, shared_folder(spark, "buckets"), "o_orderkey bigint, priority string, price double, seq bigint", ["o_orderkey"], buckets=16)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.lit(0).cast("long").alias("seq"))
    held.upsert(rows, ["seq"])
    changed = rows.where("o_orderkey % 3 = 0").withColumn("priority", F.lit("new"))
    held.upsert(changed.withColumn("seq", F.lit(1).cast("long")).unionByName(changed.withColumn("seq", F.lit(2).cast("long")).withColumn("price", F.col("price") + 1)), ["seq"])
    held.delete(rows.where("o_orderkey % 5 = 1"))
    return held.read().select("o_orderkey", "priority", "price")


@query(f"""WITH {decisions._DECIDED} SELECT listing_id, channel, verdict, source FROM r""")
def q_service(spark, sf_dir):
    """The whole loop over landed listings, stopped and started anew; what a batch learned is there for the next one."""
    folder, rows = shared_folder(spark, "service"), decisions._listings(spark, sf_dir)
    for part in (rows.where("p_partkey % 3 = 0"), rows):
        part.write.mode("append").parquet(f"{folder}/landed")
        service = Service(spark, f"{folder}/state", decisions.LEXICON, decisions._tables(spark, sf_dir), buckets=16)
        service.run(spark.readStream.schema(rows.schema).parquet(f"{folder}/landed")).awaitTermination()
    return spark.read.option("basePath", f"{folder}/state/results").parquet(f"{folder}/state/results/*").select("listing_id", "channel", "verdict", "source")


@query("""WITH g AS (SELECT event_type AS failure_step, json_extract(props, '$.k')::INT % 7 AS code, count(*)::BIGINT AS n, count(*) FILTER (WHERE value > 50)::BIGINT AS good, count(*) FILTER (WHERE value <= 50)::BIGINT AS bad, arg_max(user_id, event_id) AS last_user FROM events GROUP BY ALL)
SELECT failure_step, code, n, good::DOUBLE / (good + bad) AS ratio, last_user, n::DOUBLE / sum(n) OVER (PARTITION BY failure_step) AS share FROM g""")
def q_rolling_counters(spark, sf_dir):
    """Counts, success ratios, latest values and shares kept up over four batches, the third of them repeated."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("event_type").alias("failure_step"), (F.get_json_object("props", "$.k").cast("int") % 7).alias("code"))
    kept = rolling.Rolling(
        ["failure_step", "code"], {"n": F.lit(1).cast("long"), "good": F.when(F.col("value") > 50, 1).otherwise(0).cast("long"), "bad": F.when(F.col("value") <= 50, 1).otherwise(0).cast("long")},
        {"last_user": (F.col("user_id"), [F.col("event_id")])},
    )
    held = kept.state(events, shared_folder(spark, "rolling"), buckets=8)
    for batch in (0, 1, 2, 2, 3):
        kept.add(held, events.where(F.col("event_id") % 4 == batch), batch)
    now = kept.values(held)
    of_step = now.groupBy("failure_step").agg(F.sum("n").alias("_all"))
    return now.join(of_step, "failure_step").select("failure_step", "code", "n", rolling.success_ratio().alias("ratio"), "last_user", (F.col("n") / F.col("_all")).alias("share"))
