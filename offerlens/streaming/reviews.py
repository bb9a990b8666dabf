"""Reviews and their replies as streams: expiry by timers, and requests joined with replies.

A review is asked in a message; a reply names the message that it answers. ``lifecycle`` keeps
what is open in buckets of messages, whose timer both expires reviews and drops their state, so nothing is
kept longer than the time a review may wait. ``answers`` is the plain join of the two streams.
Both go by event time: after a restart the checkpoint goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import urls

#: What happens to reviews: answered (the first reply with a product URL), no_url (a reply without one), expired.
OUTCOMES = "message_id string, item string, outcome string, url string, at timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is open in a bucket, as JSON.
_OPEN = "held string"


def happenings(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests (message_id, item, asked_at) and replies (message_id, text, replied_at, seq) as one stream of happenings."""
    asked = requests.select("message_id", F.lit("ask").alias("kind"), F.col("asked_at").alias("at"), F.lit(0).cast("long").alias("seq"), F.col("item").cast("string").alias("item"), F.lit(None).cast("string").alias("url"))
    said = replies.select("message_id", F.lit("reply").alias("kind"), F.col("replied_at").alias("at"), F.col("seq").cast("long").alias("seq"), F.lit(None).cast("string").alias("item"), urls.first_product_url(F.col("text")).alias("url"))
    return asked.unionByName(said).where(F.col("message_id").isNotNull() & F.col("at").isNotNull()).withColumn("ms", F.unix_millis("at"))


class _Lifecycle(StatefulProcessor):
    """Messages of one bucket: each pending until its first reply with a URL or until it is due; replies that come before their request wait as long for it.

    A call to the state or a timer costs far more than a row does, so a bucket reads and writes what is open
    once a batch, and has one timer, for what is due first.
    """

    def __init__(self, days: float):
        self.wait = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", _OPEN)

    def _load(self) -> None:
        """reviews: message -> (item, due, done); early: message -> [(url, at, seq)]; timer: when it goes off."""
        held = json.loads(self.state.get()[0]) if self.state.exists() else {}
        self.reviews, self.early, self.timer = held.get("reviews", {}), held.get("early", {}), held.get("timer")

    def _keep(self) -> None:
        first = min((due for _, due, _ in self.reviews.values()), default=None)
        gone = min((at + self.wait for waiting in self.early.values() for _, at, _ in waiting), default=None)
        due = min((x for x in (first, gone) if x is not None), default=None)
        if due != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.state.clear()
        else:
            self.state.update((json.dumps({"reviews": self.reviews, "early": self.early, "timer": due}),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        found = pd.concat(list(rows))
        found = found.sort_values(["ms", "kind", "seq"])  # a request stands before a reply of the same time
        out: list[tuple] = []
        for message, kind, ms, seq, item, url in zip(*[found[c].tolist() for c in ("message_id", "kind", "ms", "seq", "item", "url")], strict=True):
            out += self._asked(message, item, ms) if kind == "ask" else self._answered(message, url, ms, seq)
        self._keep()
        if out:
            yield _frame(out)

    def _asked(self, message: str, item: str | None, ms: int) -> list[tuple]:
        if message in self.reviews:
            return []  # the first request of a message counts
        self.reviews[message] = (item, ms + self.wait, False)
        waiting = sorted(self.early.pop(message, []), key=lambda e: (e[1], e[2]))
        out = []
        for url, at, seq in waiting:  # that they came too soon is forgiven, for as long as a review waits
            out += self._answered(message, url, ms, seq) if at >= ms - self.wait else []
        return out

    def _answered(self, message: str, url: str | None, ms: int, seq: int) -> list[tuple]:
        if message not in self.reviews:
            self.early.setdefault(message, []).append((url, ms, seq))
            return []
        item, due, done = self.reviews[message]
        if done or ms > due:
            return []
        if url is None:
            return [(message, item, "no_url", None, ms)]
        self.reviews[message] = (item, due, True)
        return [(message, item, "answered", url, ms)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.timer == now:  # it is gone with this call
            self.timer = None
        now = max(now, timerValues.getCurrentWatermarkInMs())
        over = {message: review for message, review in self.reviews.items() if review[1] <= now}
        self.reviews = {message: review for message, review in self.reviews.items() if review[1] > now}
        early = {message: [e for e in waiting if e[1] + self.wait > now] for message, waiting in self.early.items()}
        self.early = {message: waiting for message, waiting in early.items() if waiting}
        self._keep()
        out = [(message, item, "expired", None, due) for message, (item, due, done) in over.items() if not done]
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["message_id", "item", "outcome", "url", "ms"])


@contextmanager
def rocksdb(spark: SparkSession):
    """Timers need this state store; a query keeps the setting that it starts with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def lifecycle(stream: DataFrame, days: float, late: str = "1 hour", buckets: int = 256) -> DataFrame:
    """OUTCOMES of a stream of ``happenings``: an answer if one comes within ``days``, else an expiry once the watermark (``late`` behind the newest) has passed. A batch's rows of one of the ``buckets`` are held at once; a checkpoint keeps its number. To be started within ``rocksdb``."""
    watched = stream.withWatermark("at", late).withColumn("bucket", F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int"))
    done = watched.groupBy("bucket").transformWithStateInPandas(_Lifecycle(days), "message_id string, item string, outcome string, url string, ms long", "Append", "EventTime")
    return done.select("message_id", "item", "outcome", "url", F.timestamp_millis("ms").alias("at"))


def answers(requests: DataFrame, replies: DataFrame, days: float, late: str = "1 hour") -> DataFrame:
    """Each request with every reply that comes within ``days``, or with none once that time is over; streams or tables. State holds ``days`` of each side."""
    a = requests.withWatermark("asked_at", late) if requests.isStreaming else requests
    b = replies.withColumnRenamed("message_id", "answers_id")
    b = b.withWatermark("replied_at", late) if b.isStreaming else b
    minutes = int(days * 1440)
    within = F.expr(f"message_id = answers_id AND replied_at >= asked_at AND replied_at <= asked_at + INTERVAL {minutes} MINUTES")
    return a.join(b, within, "leftOuter").drop("answers_id")


def started(out: DataFrame, folder: str, checkpoint: str):
    """Run a stream of outcomes until its source is drained; rows below ``folder``, each exactly once."""
    with rocksdb(out.sparkSession):
        return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
