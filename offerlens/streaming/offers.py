"""The polled pipeline as a stream: micro-batches with exact, never-expiring dedup.

A batch names what it writes by its id, so one that is repeated after a failure writes the
same again. What has been seen is kept in ``SeenIndex``, learned mappings in ``BucketedState``: both
touch only the buckets that a batch's rows fall into. ``Service`` is the whole loop: settings and the catalogue
are read anew with each batch, what a batch learns serves the next one, rows that can't be
read go to a folder of their own, and counters come from the write itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..config import Settings
from ..functions.identify import Lexicon
from ..operators import state
from ..plans import offers
from ..schemas import schema
from ..session import checkpointed
from ..sources.sinks import BucketedState
from .seen import SeenIndex

MAPPINGS = "id long, title string, fingerprint string, card_name string, collector_number string, set_code string, tokens array<string>, url string, product_name string, confidence double, date_added timestamp"
REVIEWS = "message_id string, item string, asked_at timestamp"


def _run(writer, interval: str | None) -> StreamingQuery:
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def dedup_stream(source: DataFrame, key: str, order: list[str], out: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """First row of each key over all time, as Parquet below ``out``/rows; runs until the source is drained."""
    seen = SeenIndex(source.sparkSession, f"{out}/seen", source.schema[key].dataType.simpleString(), buckets)

    def batch(rows: DataFrame, n: int) -> None:
        new = seen.fresh(state.first_wins(rows, [key], order), key, n).persist()
        new.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        seen.add(new, key, n)
        new.unpersist()

    return _run(source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), None)


def run_stream(source: DataFrame, decide: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str, interval: str | None = None, buckets: int = 256) -> StreamingQuery:
    """Listings in, result rows out, partitioned by channel. ``decide`` gets a batch and those of its ids that earlier batches have seen; every outcome marks a listing as seen.

    With an interval the query polls; without, it drains the source and ends. Stopping and starting the query pauses and resumes it.
    """
    seen = SeenIndex(source.sparkSession, f"{out}/seen", buckets=buckets)

    def batch(rows: DataFrame, n: int) -> None:
        known = seen.known(rows, "listing_id", n).select(F.col("id").alias("listing_id"))
        written = f"{out}/results/batch={n}"
        decide(rows, known).hint("rebalance", F.col("channel")).write.mode("overwrite").partitionBy("channel").parquet(written)  # else each task of a plan of many branches has a file a channel
        seen.add(source.sparkSession.read.schema("listing_id string").parquet(written), "listing_id", n)

    return _run(source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), interval)


@dataclass
class Service:
    """The running loop over landed listings; everything it keeps is below ``folder``, which all executors share.

    ``settings_rows`` and ``catalogue`` are asked anew for each batch: a table of (key, value), and products and
    prices as of ``offers.Tables``. ``folder``/results, /bad, /reviews and /counters hold a folder a batch.
    """

    spark: SparkSession
    folder: str
    lexicon: Lexicon
    tables: offers.Tables
    settings: Settings = Settings()
    settings_rows: Callable[[], DataFrame] | None = None
    catalogue: Callable[[], tuple[DataFrame, DataFrame]] | None = None
    buckets: int = 64
    seen: SeenIndex = field(init=False)
    learned: BucketedState = field(init=False)

    def __post_init__(self):
        self.seen = SeenIndex(self.spark, f"{self.folder}/seen", buckets=self.buckets)
        self.learned = BucketedState(self.spark, f"{self.folder}/mappings", f"{MAPPINGS}, batch long", ["id"], self.buckets)

    def now(self, batch: int) -> offers.Tables:
        """What a batch is decided by: mappings of earlier batches, the settings and the catalogue as they are."""
        learned = self.learned.read().where(F.col("batch") < batch).drop("batch")
        changes = {"mappings": self.tables.mappings.unionByName(learned, allowMissingColumns=True)}
        if self.settings_rows is not None:
            changes["settings"] = self.settings_rows()
        if self.catalogue is not None:
            changes["products"], changes["prices"] = self.catalogue()
        return replace(self.tables, **changes)

    def batch(self, rows: DataFrame, n: int) -> None:
        rows = rows.persist()  # read once, so that what the source observes counts once
        known = self.seen.known(rows, "listing_id", n).select(F.col("id").alias("listing_id"))
        tables = self.now(n)
        tables = replace(tables, seen=tables.seen.select("listing_id").unionByName(known))
        results, identities = offers.decided_with_identities(rows, tables, self.lexicon, self.settings)
        results = checkpointed(results)
        counted = Observation(f"cycle-{n}")
        one = lambda condition, name: F.count(F.when(condition, 1)).alias(name)
        watched = results.observe(counted, F.count(F.lit(1)).alias("checked"), one(F.col("verdict") == "profitable", "profitable"), one(F.col("channel").isin("review", "unidentified"), "reviewed"), one(F.col("verdict") == "error", "errors"))
        watched.write.mode("overwrite").partitionBy("channel").parquet(f"{self.folder}/results/batch={n}")
        identities.where(F.col("identify_error").isNotNull()).select("listing_id", "title", "identify_error").write.mode("overwrite").parquet(f"{self.folder}/bad/batch={n}")
        additions = offers.state_rows(results, identities)
        asked = additions["review_queue"].where("status = 'pending'").select(F.concat(F.lit("r"), "listing_id").alias("message_id"), F.col("listing_id").alias("item"), F.col("created_at").alias("asked_at"))
        asked.write.mode("overwrite").parquet(f"{self.folder}/reviews/batch={n}")
        mapped = additions["card_mappings"].withColumn("id", F.xxhash64("fingerprint", "url")).withColumn("product_name", F.lit(None).cast("string")).withColumn("batch", F.lit(n).cast("long"))
        first = self.learned.read(self.learned.touched(mapped)).where(F.col("batch") < n)  # a mapping's first batch counts, also when a batch is repeated
        self.learned.upsert(mapped.join(first.select("id"), "id", "left_anti").select(*self.learned.names), ["confidence", "title"])
        self.spark.createDataFrame([(n, *[counted.get[k] for k in ("checked", "profitable", "reviewed", "errors")])], "batch long, checked long, profitable long, reviewed long, errors long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counters/batch={n}")
        self.seen.add(results, "listing_id", n)
        rows.unpersist()

    def run(self, source: DataFrame, interval: str | None = None) -> StreamingQuery:
        """With an interval the query polls; without, it drains the source and ends. Stopping and starting it pauses and resumes."""
        watched = source.observe("landed", F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("listing_id").isNull(), 1)).alias("without_id"))
        return _run(watched.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint"), interval)


class Cycles(StreamingQueryListener):
    """What each batch of a running service has taken in, as its progress says."""

    def __init__(self):
        self.landed: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("landed")
        if seen is not None:
            self.landed.append({"batch": event.progress.batchId, **seen.asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def landed_listings(spark: SparkSession, path: str) -> DataFrame:
    """Landed listing rows as JSON lines, as a stream."""
    return spark.readStream.schema(schema("listing")).json(path)
