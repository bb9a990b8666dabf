from datetime import datetime, timedelta

from pyspark.sql import functions as F

from offerlens import schemas
from offerlens.config import Settings, deep_get, load, with_overrides
from offerlens.operators import reports, state
from offerlens.plans import feedback
from offerlens.sources.sinks import StateTable

T0 = datetime(2024, 1, 1)


def rows(spark):
    return spark.createDataFrame([("a", 1, T0, 1), ("a", 2, T0, 2), ("b", 3, T0 + timedelta(1), 3), ("a", 4, T0 - timedelta(1), 4)], "k string, v int, ts timestamp, seq long")


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_first_and_last_wins(spark):
    assert pairs(state.first_wins(rows(spark), ["k"], ["ts", "seq"]), "k", "v") == [("a", 4), ("b", 3)]
    assert pairs(state.last_wins(rows(spark), ["k"], ["ts", "seq"]), "k", "v") == [("a", 2), ("b", 3)]


def test_upserts_are_idempotent(spark):
    current = spark.createDataFrame([("a", 0), ("z", 9)], "k string, v int")
    batch = rows(spark)
    once = state.upsert(current, batch, ["k"], ["ts", "seq"])
    assert pairs(once, "k", "v") == [("a", 2), ("b", 3), ("z", 9)]
    assert pairs(state.upsert(once, batch, ["k"], ["ts", "seq"]), "k", "v") == pairs(once, "k", "v")
    ignored = state.insert_or_ignore(current, batch, ["k"], ["ts", "seq"])
    assert pairs(ignored, "k", "v") == [("a", 0), ("b", 3), ("z", 9)]
    assert pairs(state.insert_or_ignore(ignored, batch, ["k"], ["ts", "seq"]), "k", "v") == pairs(ignored, "k", "v")


def test_insert_if_absent_passes_partial_keys(spark):
    df = spark.createDataFrame([("l", "s", 1), ("l", "s", 2), (None, "s", 3), (None, "s", 4), ("", "s", 5), ("l", None, 6)], "l string, s string, seq int")
    assert [r[0] for r in sorted(pairs(state.insert_if_absent(df, ["l", "s"], ["seq"]), "seq"))] == [1, 3, 4, 5, 6]


def test_updates_deletes_and_seeds(spark):
    current = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, s string")
    changed = state.update_columns(current, spark.createDataFrame([("b", "new"), ("c", "no")], "k string, s string"), ["k"], ["s"])
    assert pairs(changed, "k", "v", "s") == [("a", 1, "x"), ("b", 2, "new")]
    assert pairs(state.delete_keys(current, spark.createDataFrame([("a",), ("a",)], "k string"), ["k"]), "k") == [("b",)]
    settings = spark.createDataFrame([("min_price", "2")], "key string, value string")
    defaults = spark.createDataFrame([("min_price", "0.5"), ("max_price", "500")], "key string, value string")
    assert pairs(state.seeded(settings, defaults), "key", "value") == [("max_price", "500"), ("min_price", "2")]
    assert pairs(state.append(current, spark.createDataFrame([("z",)], "k string")), "k") == [("a",), ("b",), ("z",)]


def test_rules_and_ratios(spark):
    current = spark.createDataFrame([("TR", "TR", "Team", 4, 1, 0.8)], "set_code string, prefix string, set_name string, uses_successful long, uses_failed long, confidence double")
    batch = spark.createDataFrame([("TR", "TR", None, T0, 1), ("FO", "FO", "Fossil", T0, 2), ("FO", "FO", None, T0, 3)], "set_code string, prefix string, set_name string, ts timestamp, seq long")
    got = pairs(state.upsert_prefix_rules(current, batch), "set_code", "prefix", "set_name", "uses_successful", "uses_failed", "confidence")
    assert got == [("FO", "FO", "Fossil", 2, 0, 1.0), ("TR", "TR", "Team", 5, 1, 0.8)]
    used = spark.createDataFrame([(1, True), (1, False), (1, True), (2, False)], "id int, ok boolean")
    assert pairs(state.success_ratio(used, ["id"], F.col("ok")), "id", "confidence") == [(1, 2 / 3), (2, 0.0)]


def test_expiry_and_resolution(spark):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    df = spark.createDataFrame([("a", "pending", datetime(2024, 1, 7, 11)), ("b", "pending", datetime(2024, 1, 7, 13)), ("c", "resolved", T0), ("d", "pending", datetime(2024, 1, 6, 23))], "listing_id string, status string, created_at timestamp")
    assert pairs(state.expired(df, now, 3), "listing_id", "status") == [("a", "expired"), ("b", "pending"), ("c", "resolved"), ("d", "expired")]
    assert pairs(state.expired(df, now, 3, by_date=True), "listing_id", "status") == [("a", "pending"), ("b", "pending"), ("c", "resolved"), ("d", "expired")]
    full = df.withColumn("resolved_by", F.lit(None).cast("string")).withColumn("resolved_url", F.lit(None).cast("string")).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    reply = spark.createDataFrame([("b", "me", "u", T0)], "listing_id string, resolved_by string, resolved_url string, resolved_at timestamp")
    assert ("b", "resolved", "me", "u") in pairs(state.resolve(full, reply), "listing_id", "status", "resolved_by", "resolved_url")


def test_purge_deletes_all_ties(spark):
    df = spark.createDataFrame([("s", 1, 5), ("s", 2, 1), ("s", 3, 1), ("t", 4, 1), ("u", 5, 2), ("u", 6, 2)], "slug string, id int, n int")
    stays, gone = state.purge_least(df, "slug", "n", ["slug", "id"])
    assert pairs(stays, "id") == [(1,), (4,)] and pairs(gone, "id") == [(2,), (3,), (5,), (6,)]


def test_reports(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("(unknown)",)], "code string")
    assert [tuple(r) for r in reports.counts_by(df, "code").collect()] in ([("a", 2), ("(unknown)", 1), ("(unknown)", 1)],)
    shares = reports.shares(spark.createDataFrame([("s", 3), ("s", 1), ("t", 2)], "g string, n int"), "g", "n").collect()
    assert {r["g"]: sum(x["confidence"] for x in shares if x["g"] == r["g"]) for r in shares} == {"s": 1.0, "t": 1.0}
    assert spark.range(1).select(reports.share_text(F.lit(1), F.lit(8)), reports.share_text(F.lit(0), F.lit(0)), reports.shortened(F.lit("abcdef"), 3)).first()[:] == ("1 / 8 (12.5%)", "0 / 0", "abc…")
    lines = spark.createDataFrame([(i, "x" * 4) for i in range(5)], "i int, line string")
    assert [r["text"].count("x") for r in reports.pages_of_lines(lines, ["i"], "line", 10).collect()] == [8, 8, 4]
    assert spark.range(1).select(reports.labelled(F.lit("catalog"), reports.SOURCES), reports.labelled(F.lit("other"), reports.SOURCES)).first()[:] == ("Catalogue", "other")


def test_failure_report(spark):
    step = lambda s, m: (s, m, None, None, None, None)
    reviews = spark.createDataFrame(
        [("1", "pending", "r1", [step("a", "m"), step(None, None)], T0), ("2", "expired", "r1", None, T0), ("3", "resolved", "r9", None, T0), ("4", "pending", None, [step("b", "m")], T0)],
        "listing_id string, status string, reason string, attempts array<struct<step:string,message:string,error:string,method:string,result:string,detail:string>>, created_at timestamp",
    )
    got = [tuple(r) for r in reports.failure_report(reviews).orderBy("kind", "rank").collect()]
    assert got == [("message", 1, "m", 2), ("reason", 1, "r1", 2), ("reason", 2, "unknown", 1), ("step", 1, "a", 1), ("step", 2, "b", 1)]


def test_settings(spark):
    assert deep_get({"a": {"b": 1}}, "a.b") == 1 and deep_get({"a": 1}, "a.b", 5) == 5
    settings = load({"min_price": 1}, {"OFFERLENS_MAX_PRICE": "9.5"})
    assert (settings.min_price, settings.max_price, settings.review_days) == (1.0, 9.5, 3)
    rows = spark.createDataFrame([("review_days", "30"), ("max_price", "10.5"), ("unknown", "1"), ("min_price", "x")], "key string, value string")
    got = with_overrides(Settings(), rows)
    assert (got.review_days, got.max_price, got.min_price) == (30, 10.5, 0.5)


def test_migration_and_versions(spark, tmp_path):
    old = spark.createDataFrame([("m", "l")], "message_id string, listing_id string")
    new = schemas.migrated(old, "deal_messages", {"channel_type": "deals"})
    assert new.columns == [f.name for f in schemas.schema("deal_messages")] and new.first()["channel_type"] == "deals"
    table = StateTable(spark, str(tmp_path / "t"), "k string")
    assert table.read().count() == 0
    for n in range(3):
        table.write(table.read().unionByName(spark.createDataFrame([(str(n),)], "k string")))
    assert table.version() == 2 and table.read().count() == 3


def test_feedback(spark):
    base = "https://www.market.example/en/X/Products/Singles/Team/"
    corrected = spark.createDataFrame([(base + "Dark-83", base + "Dark-TR83?a=1", "83/82", None, "Team", "fp", "Dark", "t", T0, 1), (base + "Dark-83", base + "Dark-V2-TR83", "83/82", "tr", None, "fp", "Dark", "t", T0, 2)], "generated_url string, corrected_url string, collector_number string, set_code string, set_name string, fingerprint string, card_name string, title string, ts timestamp, seq long")
    codes = spark.createDataFrame([("OLD", "Team", 0), ("TR", "Team", 1)], "code string, slug string, pos int")
    got = feedback.corrections(corrected, codes)
    assert pairs(got, "rule_code") == [("TR",), ("TR",)] and {r["learned_prefix"] for r in got.collect()} == {"TR", None}
    empty = spark.createDataFrame([], "set_code string, prefix string, set_name string, uses_successful long, uses_failed long, confidence double")
    assert pairs(feedback.learned_rules(empty, got), "set_code", "prefix", "uses_successful") == [("TR", "TR", 1)]
    overrides = feedback.learned_overrides(spark.createDataFrame([], "fingerprint string, url string, preferred_slug string, created_at timestamp"), got)
    assert pairs(overrides, "preferred_slug") == [("Dark-V2-TR83",)]
    assert pairs(feedback.variant_hints(got), "name_slug", "set_code", "digits", "slug") == [("Dark", "TR", "83", "Dark-V2-TR83")]
    mapped = feedback.learned_mappings(spark.createDataFrame([], schemas.schema("card_mappings")), got)
    assert mapped.count() == 2 and all("sellerCountry=23" in r["url"] for r in mapped.collect())
    replies = spark.createDataFrame([("see " + base + "Dark-TR83. id 765991", 7, T0, 1)], "text string, id_expansion long, ts timestamp, seq long")
    ids = feedback.id_slugs(feedback.replied_url(replies))
    current = spark.createDataFrame([(1, None, None, 7, "Old", 4)], "id long, id_product long, product_slug string, id_expansion long, set_slug string, match_count long")
    products, expansions = feedback.store_id_slugs(current, ids)
    assert pairs(products, "id_product", "product_slug") == [(765991, "Dark-TR83")] and pairs(expansions, "id_expansion", "set_slug", "match_count") == [(7, "Team", 5)]
    asked = spark.createDataFrame([("10", None), ("slug", "Old")], "product_id string, set_name string")
    known = feedback.expansion_ids(asked, spark.createDataFrame([(10, 3)], "id_product long, id_expansion long"), current)
    assert pairs(known, "id_expansion") == [(3,), (7,)]


def test_rolling_sums_equal_a_recount_however_batches_are_cut(spark, tmp_path):
    import random

    from offerlens.operators.rolling import Rolling, success_ratio

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 3), rng.choice([True, False]), rng.choice([None, "x", "y", "z"]), i, round(rng.random(), 3)) for i in range(120)]
    schema = "step string, code int, ok boolean, name string, at long, amount double"
    df = spark.createDataFrame(rows, schema)
    kept = Rolling(["step", "code"], {"good": F.when(F.col("ok"), 1).otherwise(0).cast("long"), "bad": F.when(F.col("ok"), 0).otherwise(1).cast("long"), "amount": F.col("amount")}, {"name": (F.col("name"), [F.col("at")])})
    want = {}
    for step, code, ok, name, _, amount in rows:
        w = want.setdefault((step, code), [0, 0, 0.0, None])
        w[0 if ok else 1] += 1
        w[2] = round(w[2] + amount, 3)
        w[3] = name if name is not None else w[3]
    for cut in range(1):
        cuts = sorted(rng.sample(range(1, 120), 3))
        held = kept.state(df, f"{tmp_path.as_uri()}/{cut}", buckets=3)
        for batch, (a, b) in enumerate(zip([0, *cuts], [*cuts, 120])):
            for _ in range(1 + (batch == 1)):  # one batch is repeated
                kept.add(held, df.where((F.col("at") >= a) & (F.col("at") < b)), batch)
        got = {(r["step"], r["code"]): [r["good"], r["bad"], round(r["amount"], 3), r["name"]] for r in kept.values(held).collect()}
        assert got == want
    assert spark.createDataFrame([(3, 1), (0, 0)], "good long, bad long").select(success_ratio().alias("r")).collect() == [(0.75,), (None,)]


def test_pages_of_lines_over_ranges(spark):
    """Greedy pages, however the lines are dealt: long, empty, null and equal lines among them."""
    import random

    from offerlens.operators import reports

    rng = random.Random(5)
    for n, size in ((0, 10), (1, 10), (150, 12), (150, 40)):
        rows = [(rng.randint(0, 60), rng.choice([None, "", "x" * rng.randint(1, 9), "y" * rng.randint(0, 50)])) for _ in range(n)]
        want: list[str] = []
        for _, x in sorted((k, x or "") for k, x in rows):
            if want and len(want[-1]) + 1 + len(x) <= size:
                want[-1] += "\n" + x
            else:
                want.append(x)
        got = reports.pages_of_lines(spark.createDataFrame(rows, "k int, x string").repartition(4), ["k"], "x", size).orderBy("page").collect()
        assert [r["page"] for r in got] == list(range(len(want))) and [r["text"] for r in got] == want
