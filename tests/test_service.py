"""Seen ids, reviews and the running service."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.streaming import reviews
from offerlens.streaming import seen as seen_ids
from offerlens.streaming.seen import SeenIndex

START = datetime(2024, 1, 1)
URL = "https://www.market.example/en/X/Products/Singles/Set/Card-1"


def test_bloom_filter():
    rng = np.random.default_rng(0)
    held, other = rng.integers(-(2**63), 2**63, 1000, dtype=np.int64), rng.integers(-(2**63), 2**63, 5000, dtype=np.int64)
    bits = seen_ids.bloom_add(bytes(seen_ids._size_for(1000)), held)
    assert seen_ids.bloom_may_hold(bits, held).all() and seen_ids.bloom_may_hold(bits, other).mean() < 0.02
    assert not seen_ids.bloom_may_hold(bytes(2048), held).any()


def test_seen_over_batches_replays_and_restarts(spark, tmp_path, monkeypatch):
    """Against a plain set; files are put together and filters grow; a repeated batch decides alike."""
    monkeypatch.setattr(seen_ids, "COMPACT", 3)
    monkeypatch.setattr(seen_ids, "FILTER_BYTES", 8)
    rng, known = random.Random(1), set()
    path = tmp_path.as_uri() + "/seen"
    for n in range(5):
        ids = [rng.choice([None, str(rng.randint(0, 150))]) for _ in range(40)]
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "k int, listing_id string")
        index = SeenIndex(spark, path, buckets=4 if n == 0 else 99)  # a table keeps the number it was made with
        want = sorted(i for i, x in enumerate(ids) if x not in known)
        for _ in range(2):  # the second time as after a failure
            assert sorted(r["k"] for r in index.fresh(rows, "listing_id", n).collect()) == want
            index.add(rows, "listing_id", n)
        known |= {x for x in ids if x is not None}
    index.rebuild_filters()
    rows = spark.createDataFrame([(x,) for x in sorted(known)] + [("never",)], "listing_id string")
    assert {r["listing_id"] for r in index.fresh(rows, "listing_id", 9).collect()} == {"never"}
    assert index.buckets == 4 and len(list((tmp_path / "seen" / "ids").glob("bucket=*"))) == 4
    assert max(len(list(b.glob("*.parquet"))) for b in (tmp_path / "seen" / "ids").glob("bucket=*")) <= 4


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    index = SeenIndex(spark, tmp_path.as_uri() + "/seen", kind="bigint", buckets=64)
    index.add(spark.range(20_000), "id", 0)
    few = spark.range(1_000_000, 1_000_003)
    known = index.known(few, "id", 1)
    assert known.count() == 0
    old = index._read("ids", index._ids, index._of(index._keyed(few, "id")))
    assert 0 < old.count() < 20_000 / 64 * 3 * 2  # what its buckets hold is all it could read


def stream_of(spark, folder, parts, schema, run):
    """Each part lands and is drained by a query that starts anew from the checkpoint."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
        run(spark.readStream.schema(schema).parquet(f"{folder}/landed"))


def brute_outcomes(happened, days, late):
    """From all happenings (kind, message, at, seq, url) in order of time."""
    wait, out = timedelta(days=days), []
    end = max(h[2] for h in happened) - late
    asks = {}
    for kind, m, at, _, _ in sorted(happened, key=lambda h: (h[2], h[0])):
        if kind == "ask":
            asks.setdefault(m, at)
    for m, asked in asks.items():
        said = sorted((at, seq, url) for kind, mm, at, seq, url in happened if kind == "reply" and mm == m and asked - wait <= at <= asked + wait)
        for at, _, url in said:
            out.append((m, "answered" if url else "no_url", url, max(at, asked)))
            if url:
                break
        else:
            if asked + wait <= end:
                out.append((m, "expired", None, asked + wait))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_reviews_expire_or_are_answered_across_restarts(spark, tmp_path, seed):
    rng, days = random.Random(seed), 2.0
    rows, at = [], START
    for i in range(150):
        at += timedelta(minutes=rng.randint(1, 120), milliseconds=rng.randint(0, 999))
        if rng.random() < 0.5:
            rows.append(("ask", f"m{i}", at, 0, None))
        else:  # to an earlier, a later, an unknown message; a third without a URL
            rows.append(("reply", f"m{max(0, i + rng.choice([-60, -20, -3, -2, -1, -1, 1, 2, 25]))}", at, i, rng.choice([None, URL, URL])))
    folder, late = tmp_path.as_uri(), timedelta(hours=1)
    schema = "kind string, message_id string, at timestamp, seq long, text string"

    def run(landed):
        asked = landed.where("kind = 'ask'").select("message_id", F.lit("x").alias("item"), F.col("at").alias("asked_at"))
        said = landed.where("kind = 'reply'").select("message_id", "text", F.col("at").alias("replied_at"), "seq")
        reviews.started(reviews.lifecycle(reviews.happenings(asked, said), days), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()

    stream_of(spark, folder, [rows[:40], rows[40:41], rows[41:110], rows[110:]], schema, run)
    got = sorted(((r["message_id"], r["outcome"], r["url"], r["at"]) for r in spark.read.parquet(f"{folder}/out").collect()), key=str)
    want = brute_outcomes(rows, days, late)
    assert {o for _, o, _, _ in want} == {"answered", "no_url", "expired"} and got == want


def test_answers_join_both_streams(spark, tmp_path):
    """Late, early, repeated and missing replies; the stream gives what the tables give, but for requests that still wait."""
    day = timedelta(days=1)
    asked = [(f"m{i}", str(i), START + i * day) for i in range(8)]
    said = [("m0", URL, START + 0.5 * day, 1), ("m0", URL, START + 0.9 * day, 2), ("m1", URL, START + 2.5 * day, 3), ("m2", URL, START + 1.5 * day, 4), ("m3", "no", START + 3.1 * day, 5), ("m9", URL, START + 4 * day, 6), ("m7", URL, START + 7.5 * day, 7)]
    a_schema, r_schema = "message_id string, item string, asked_at timestamp", "message_id string, text string, replied_at timestamp, seq long"
    folder, cut = tmp_path.as_uri(), START + 2 * day
    for part in (lambda t: t < cut, lambda t: t >= cut):
        spark.createDataFrame([x for x in asked if part(x[2])], a_schema).coalesce(1).write.mode("append").parquet(f"{folder}/a")
        spark.createDataFrame([x for x in said if part(x[2])], r_schema).coalesce(1).write.mode("append").parquet(f"{folder}/r")
        out = reviews.answers(spark.readStream.schema(a_schema).parquet(f"{folder}/a"), spark.readStream.schema(r_schema).parquet(f"{folder}/r"), 1)
        reviews.started(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    got = {(r["message_id"], r["seq"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    whole = reviews.answers(spark.createDataFrame(asked, a_schema), spark.createDataFrame(said, r_schema), 1)
    want = {(r["message_id"], r["seq"]) for r in whole.collect()}
    assert want == {("m0", 1), ("m0", 2), ("m1", None), ("m2", None), ("m3", 5), ("m4", None), ("m5", None), ("m6", None), ("m7", 7)}
    assert got == want - {("m6", None)}  # m6 may still be answered


def test_bucketed_state_writes_what_it_touches(spark, tmp_path):
    from offerlens.sources.sinks import BucketedState, ConcurrentWrite

    path, columns = tmp_path.as_uri() + "/t", "k long, name string, money decimal(10, 2), ts long"
    table = BucketedState(spark, path, columns, ["k"], buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, "k long, name string, money string, ts long").withColumn("money", F.col("money").cast("decimal(10, 2)")).select("k", "name", "money", "ts")
    shown = lambda: sorted((r["k"], r["name"]) for r in table.read().collect())
    assert shown() == []
    table.upsert(frame([(i, f"a{i}", "1.5", 1) for i in range(100)]), ["ts"])
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").glob("_bucket=*/*.parquet")}
    before = files()
    written = table.upsert(frame([(3, "b3", "2", 2), (3, "c3", "2", 3), (500, "b500", None, 1)]), ["ts"])
    changed = {p.parent.name for p in set(files()) ^ set(before)}
    assert len(written) <= 2 and changed == {f"_bucket={b}" for b in written}
    want = {i: f"a{i}" for i in range(100)} | {3: "c3", 500: "b500"}
    assert dict(shown()) == want and table.version() == 2
    again = BucketedState(spark, path, columns, ["k"])  # opened anew, with the buckets it was made with
    again.delete(frame([(i, None, None, 0) for i in range(50)]))
    assert dict(shown()) == {k: v for k, v in want.items() if k >= 50} and again.buckets == 16
    table._claim()  # another writer begins, and is still at it
    with pytest.raises(ConcurrentWrite):
        again.upsert(frame([(1, "x", "1", 1)]), ["ts"])
    assert dict(shown()) == {k: v for k, v in want.items() if k >= 50}
    again.release()
    again.upsert(frame([(1, "x", "1", 1)]), ["ts"])
    assert dict(shown()) == {k: v for k, v in want.items() if k >= 50} | {1: "x"}


def test_settings_as_columns_follow_their_table(spark):
    from offerlens import config

    rows = [("max_price", "80"), ("review_days", "9.5"), ("fuzzy_threshold", "70.5"), ("min_price", "bad"), ("unknown", "1"), ("max_results", "12.0"), ("cheap_price_per_card", None), ("catalogue_hours", "1e2")]
    table = spark.createDataFrame(rows, "key string, value string")
    row = config.as_row(table).select("_settings.*").first().asDict()
    plain = config.with_overrides(config.Settings(), table)
    assert row == {k: float(v) for k, v in vars(plain).items()} and row["max_price"] == 80 and row["min_price"] == 0.5
    assert config.as_row(table.limit(0)).select("_settings.*").first().asDict() == {k: float(v) for k, v in vars(config.Settings()).items()}
    values = ["7", "7.9", "-7", "-7.5", " 8 ", "1_0", "1e1", "nan", "inf", "", "x.y", None]

    def parsed(v):
        try:
            return float(v) if "." in v else float(int(float(v)))
        except (TypeError, ValueError, OverflowError):
            return None

    got = spark.createDataFrame([(v,) for v in values], "v string").select(config._parsed(F.col("v")).alias("x")).collect()
    assert [r["x"] for r in got] == [parsed(v) for v in values]


def test_service_over_batches_and_a_restart(spark, tmp_path):
    """Settings change between batches, learned mappings serve the next, counters and bad rows come with the write, reviews feed their stream."""
    from test_offers import LEXICON, LISTINGS, WANT, shop_tables, tables

    from offerlens.streaming.offers import Cycles, Service

    columns, folder = "listing_id string, title string, price double, description string", tmp_path.as_uri()
    limit = ["1000"]
    listener = Cycles()
    spark.streams.addListener(listener)

    def drain(rows):
        spark.createDataFrame([(i, t, p, None) for i, t, p in rows], columns).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
        service = Service(spark, f"{folder}/service", LEXICON, tables(spark, shop_tables(spark)), buckets=4, settings_rows=lambda: spark.createDataFrame([("max_price", limit[0])], "key string, value string"))
        service.run(spark.readStream.schema(columns).parquet(f"{folder}/landed")).awaitTermination()
        return service

    drain(LISTINGS[1:6])
    limit[0] = "0.6"
    dear = [("dear2", "Pikachu 025/193 Base", 40.0)]
    service = drain(LISTINGS[1:6] + dear)
    results = spark.read.parquet(f"{folder}/service/results").collect()
    got = {r["listing_id"]: (r["channel"], r["verdict"], r["reason"]) for r in results}
    first = {i for i, _, _ in LISTINGS[1:6]}
    assert len(results) == len(got) and {k: v for k, v in got.items() if k in first} == {k: v for k, v in WANT.items() if k in first}
    assert got["dear2"] == ("skipped", "skipped", "price_out_of_range")  # under the limit of the second batch, and of that alone
    counters = {r["batch"]: r["checked"] for r in spark.read.parquet(f"{folder}/service/counters").collect()}
    assert counters == {0: len(first), 1: 1}
    spark.streams.removeListener(listener)
    assert sum(x["rows"] for x in listener.landed) == len(first) * 2 + 1
    asked = {r["item"] for r in spark.read.schema("message_id string, item string, asked_at timestamp").option("recursiveFileLookup", True).parquet(f"{folder}/service/reviews").collect()}
    assert asked == {k for k in first if WANT[k][0] in ("review", "unidentified")}
    mapped = {r["listing_id"] for r in results if r["source"] in ("catalog", "constructed") and r["from_price"]}
    assert service.learned.read().count() <= len(mapped) and (not mapped or service.now(1).mappings.count() > 0)


def test_open_reviews_lie_in_buckets(spark, tmp_path):
    """State is a row and a timer a bucket, however many messages are open."""
    folder, schema = tmp_path.as_uri(), "message_id string, item string, asked_at timestamp, text string, replied_at timestamp, seq long"
    rows = [(f"m{i}", "x", START + timedelta(seconds=i), None, None, 0) for i in range(300)] + [(f"m{i}", None, None, URL, START + timedelta(seconds=i + 1), i) for i in range(0, 600, 3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/landed")
    landed = spark.readStream.schema(schema).parquet(f"{folder}/landed")
    happened = reviews.happenings(landed.where("asked_at IS NOT NULL"), landed.where("replied_at IS NOT NULL").select("message_id", "text", "replied_at", "seq"))
    query = reviews.started(reviews.lifecycle(happened, 1.0, buckets=4), f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").where("outcome = 'answered'").count() == 100
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 4 * 3
