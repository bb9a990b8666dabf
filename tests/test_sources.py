"""Searches as a source, snapshots of any size."""

import json

import pytest
from pyspark.sql import functions as F

from offerlens.sources import search


@pytest.fixture
def landed(tmp_path):
    def land(domain, name, items):
        folder = tmp_path / "landed" / f"domain={domain}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in items))

    for day in range(1, 6):
        for domain in ("fr", "de"):
            land(domain, f"2024-01-0{day}.json", [{"id": f"{domain}{day}-{i}", "title": f"Charizard {day}" if i % 2 else f"other {day}"} for i in range(6)] + ["not json", {"title": "no id"}, "[]"])
    return land


def read(spark, tmp_path, **options):
    spark.dataSource.register(search.LandedSearch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    out = spark.read.format("landed_search").option("path", (tmp_path / "landed").as_uri())
    for k, v in options.items():
        out = out.option(k, v)
    return out.load()


def test_search_pushes_text_limit_and_order(spark, tmp_path, landed):
    everything = read(spark, tmp_path)
    assert everything.count() == 60
    newest = sorted(r["listing_id"] for r in read(spark, tmp_path, search_text="charizard", limit=4).collect())
    assert newest == ["de4-1", "de5-1", "de5-3", "de5-5", "fr4-1", "fr5-1", "fr5-3", "fr5-5"]
    assert read(spark, tmp_path, domains="fr, it", limit=30).select("domain").distinct().collect() == [("fr",)]


def test_filters_reach_the_reader(spark, tmp_path, landed):
    some = read(spark, tmp_path).where((F.col("domain") == "de") & (F.col("file") > "2024-01-03.json") & F.col("title").startswith("Char"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "landed_search" in line or "BatchScan" in line)
    assert some.count() == 6 and some.rdd.getNumPartitions() == 2  # two files of ten
    filters = [line for line in plan.splitlines() if " Filter (" in line]
    assert scan and not any("domain" in line or "file" in line for line in filters)  # Spark tests the rest alone
    assert read(spark, tmp_path).where(F.col("domain").isin("fr", "xx")).count() == 30


def test_stream_counts_a_file_once_over_restarts(spark, tmp_path, landed):
    spark.dataSource.register(search.LandedSearch)

    def drain():
        stream = spark.readStream.format("landed_search").option("path", (tmp_path / "landed").as_uri()).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["listing_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = drain()
    assert len(first) == len(set(first)) == 60
    landed("fr", "2024-01-06.json", [{"id": "new"}])
    landed("it", "2024-01-01.json", [{"id": "other"}])
    assert drain() == sorted([*first, "new", "other"]) and drain() == sorted([*first, "new", "other"])


TRICKY = ['{"id":1,"s":"a}b]c,\\"d{"}', '{"id":2,"n":{"x":[1,2,{"y":"},{"}]}}', "3", '"te,xt}"', "null", "[1,[2,\"]\"]]", '{"id":4,"é":"ü\\\\"}', "{}"]


@pytest.mark.parametrize("wrap", ["{}", '{{"productList":{}}}', '{{"version":6,"meta":{{"a":[9,"]"],"b":"x,y"}},"other":[7],"productList" : {} , "z":1}}', '{{"first":{},"second":[8]}}'])
@pytest.mark.parametrize("size", ["97b", "1m"])
def test_lists_split_anywhere_give_their_elements(spark, tmp_path, wrap, size):
    """Every element once and in order, wherever blocks are cut: in strings, escapes, nested lists, elements longer than a block."""
    from offerlens.sources import json_split

    items = [TRICKY[i % len(TRICKY)] if i % 10 else json.dumps({"id": i, "long": "x{,]" * 90}) for i in range(60)]
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.json").write_text(wrap.format("[" + ",\n ".join(items) + "]"))
    (folder / "b.json").write_text(wrap.format("[]"))
    (folder / "c.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = json_split.elements(spark, str(folder), ("productList", "products"))
        rows = sorted((r["path"].rsplit("/", 1)[1], r["pos"], json.loads(r["item"])) for r in got.collect() if r["path"].endswith("a.json"))
        assert [r[1] for r in rows] == list(range(60)) and [r[2] for r in rows] == [json.loads(x) for x in items]
        rest = [r for r in got.collect() if not r["path"].endswith("a.json")]
        assert rest == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_snapshots_are_swapped_between_batches(spark, tmp_path):
    """A stream's batches look products up in the snapshot that is newest then; broken and empty ones change nothing."""
    import os

    from offerlens.sources import catalogue

    folder = tmp_path / "snapshots"
    folder.mkdir()
    times = iter(range(1_700_000_000, 1_700_001_000, 10))

    def land(name, text):
        (folder / name).write_text(text)
        os.utime(folder / name, (t := next(times), t))

    def file(price):
        return json.dumps({"version": 1, "priceGuide": [{"idProduct": i, "low": price + i} for i in range(50)]})

    held = catalogue.Snapshots(spark, str(folder), catalogue.PRICE_KEYS, hours=1.0)
    seen = []

    def batch(rows, n):
        prices = catalogue.price_rows(held.items(now=n * 3600.0))
        seen.append(sorted((r["id"], r["low"]) for r in rows.join(prices, rows["id"] == prices["id_product"]).select("id", "low").collect()))

    (tmp_path / "in").mkdir()
    for n, name, text in ((0, "a.json", file(10)), (1, "b.json", '{"priceGuide":[{"idPro'), (2, "c.json", '{"priceGuide":[{"idProduct":2,"low":1},{"id'), (3, "d.json", file(20)), (4, "e.json", "[")):
        land(name, text) if text != "[" else None
        spark.createDataFrame([(n,)], "id long").write.mode("append").parquet(str(tmp_path / "in"))
        spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [[(0, 10.0)], [(1, 11.0)], [(2, 12.0)], [(3, 23.0)], [(4, 24.0)]]
    assert not held.refresh(now=4 * 3600.0 + 1) and held.path.endswith("d.json")
