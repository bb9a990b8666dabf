"""Catalogue, resolver, filters, the whole plan, and streams."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from offerlens.config import Settings
from offerlens.functions import fuzzy
from offerlens.functions import text as tx
from offerlens.functions.identify import Lexicon
from offerlens.operators import catalogue, prefilter, resolver
from offerlens.plans import offers
from offerlens.sources import catalogue as snapshots
from offerlens.sources import listings
from offerlens.streaming.offers import run_stream

PRODUCTS = [(0, 1, "Bulbasaur", "001", "Base", 10, None), (1, 2, "Bulbasaur", "001/025", "Celebrations", 11, None), (2, 3, "Charizard-ex", "125/197", "Obsidian Flames", 12, None), (3, 4, "Other", "125", None, None, None), (4, 5, "Pikachu", "025/193", "Base", 10, None), (5, 5, "Pikachu", "25", "Base", 10, None)]
PRICES = [(1, 1.0, 2.0), (2, 60.0, 6.0), (3, 0.0, 1.0), (5, 40.0, None)]
LEXICON = Lexicon(names=("Bulbasaur", "Charizard", "Pikachu", "Mew"), set_names={"CEL": "Celebrations", "OBF": "Obsidian Flames"}, known_sets={"celebrations": "Celebrations", "obsidian flames": "Obsidian Flames", "base": "Base"})


@pytest.fixture(scope="module")
def shop(spark):
    return shop_tables(spark)


def shop_tables(spark):
    products = catalogue.indexed(spark.createDataFrame(PRODUCTS, "pos long, id_product long, name string, number string, expansion_name string, id_expansion long, rarity string"))
    prices = spark.createDataFrame([(i, low, None, t, None, None, None) for i, low, t in PRICES], "id_product long, low double, sell double, trend double, avg1 double, avg7 double, avg30 double")
    codes = spark.createDataFrame([("OBF", "Obsidian-Flames"), ("CEL", "Celebrations")], "code string, slug string")
    return products, prices, codes


def asked(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ask_id int, name string, number string, set_name string, set_code string")


def test_lookup(spark, shop):
    products, prices, codes = shop
    rows = [("Bulbasaur", "001", "Celebrations", None), ("Bulbasaur", "1", None, "CEL"), ("Bulbasaur", "001", "Nowhere", None), ("Bulbasaur", "999/999", None, None), ("Bulbasaur", None, "Base", None), ("Charizard ex", "125/197", None, "OBF"), ("Pikachu", "25", "Base", None)]
    best = {r["ask_id"]: r["id_product"] for r in catalogue.best_product(asked(spark, rows), products, codes).collect()}
    assert best == {0: 2, 1: 2, 2: 1, 5: 3, 6: 5}
    priced = {r["ask_id"]: (r["from_price"], r["price_trend"]) for r in catalogue.lookup(asked(spark, rows), products, codes, prices).collect()}
    assert priced == {0: (60.0, 6.0), 1: (60.0, 6.0), 2: (1.0, 2.0), 6: (40.0, None)}
    assert tuple(catalogue.counts(products).first()) == (5, 3)


def test_snapshots(spark):
    item = {"idProduct": 7, "name": "A", "number": "1", "expansionName": "E", "idExpansion": 2}
    for body in ([item], {"productList": [item]}, {"version": 6, "data": [item]}):
        rows = snapshots.products(spark.createDataFrame([(json.dumps(body),)], "value string")).collect()
        assert [(r["id_product"], r["name"], r["pos"]) for r in rows] == [(7, "A", 0)]
    for body in ({"priceGuide": [{"idProduct": 7, "LOW": 1.0}, {"idProduct": 7, "LOW": 2.25, "TREND": 6.12}]}, [{"idProduct": 7, "low": 2.25, "trend": 6.12}]):
        row = snapshots.prices(spark.createDataFrame([(json.dumps(body),)], "value string")).first()
        assert (row["low"], row["trend"], row["avg30"]) == (2.25, 6.12, None)
    assert snapshots.is_fresh(100.0, 1, now=3699.0) and not snapshots.is_fresh(100.0, 1, now=3700.0) and not snapshots.is_fresh(None, 1)
    files = spark.createDataFrame([("a", datetime(2024, 1, 1), json.dumps([item])), ("b", datetime(2024, 1, 2), "broken"), ("c", datetime(2023, 1, 1), "[]")], "path string, modified timestamp, value string")
    assert snapshots.newest_valid(files, snapshots.PRODUCT_KEYS).first()["path"] == "a"


def test_listing_shapes(spark):
    api = {"id": 5, "title": " ", "price": "3.5", "url": "/items/5", "photos": [{"url": "http://a"}, {"full_size_url": "http://b"}, {"url": "x"}], "user": {"login": "me", "feedback_reputation": 0.9}}
    page = {"title": "T", "price": {"amount": "2.0", "currency_code": "PLN"}, "path": "items/6", "user": {"username": "you"}, "photos": [{"src": "http://c"}]}
    flat = {"id": "7", "title": "T", "price": 1, "photos": ["http://d", "no"], "seller": {"username": "s", "rating": 4.5}, "condition": "good"}
    a = listings.from_api(spark.createDataFrame([(json.dumps(api), "https://h/"), ("{}", "https://h/")], "json string, base_url string")).collect()
    assert len(a) == 1 and (a[0]["title"], a[0]["price"], a[0]["currency"], a[0]["url"], a[0]["images"], a[0]["seller_rating"]) == ("Unknown", 3.5, "EUR", "https://h/items/5", ["http://a", "http://b"], 4.5)
    p = listings.from_page_item(spark.createDataFrame([(json.dumps(page), "6", "https://h/p", "https://h")], "json string, item_id string, page_url string, base_url string")).first()
    assert (p["listing_id"], p["price"], p["currency"], p["url"], p["seller_name"], p["images"]) == ("6", 2.0, "PLN", "https://h/items/6", "you", ["http://c"])
    f = listings.from_third_party(spark.createDataFrame([(json.dumps(flat),)], "json string")).first()
    assert (f["listing_id"], f["seller_rating"], f["condition"], f["images"], f["url"]) == ("7", 4.5, "good", ["http://d"], "")
    html = '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"itemDto":{"id":9}}}}}</script>'
    got = spark.createDataFrame([(html,), ("<p>",)], "html string").select(listings.page_item(F.col("html"))).collect()
    assert [r[0] for r in got] == ['{"id":9}', None]
    domains = spark.createDataFrame([("NL", "https://nl"), ("DE", "https://de")], "country string, base_url string")
    assert [r["base_url"] for r in listings.base_urls(spark, ["de", "xx"], domains, "NL").collect()] == ["https://de"]
    assert [r["base_url"] for r in listings.base_urls(spark, ["xx"], domains, "NL").collect()] == ["https://nl"]


@pytest.mark.parametrize(
    ("title", "description", "want"),
    [
        ("Pokémon Ultra Clear Soft Sleeves", None, "non_card_item"),
        ("Gameboy - Pokémon Yellow", None, "non_card_item"),
        ("Pikachu (M23 006) NM", "sent in a toploader", None),
        ("Lot de 100 cartes Pokémon", None, "lot_listing"),
        ("3x Japanse full art", None, "lot_listing"),
        ("4 carte fiamme spettrali", None, "lot_listing"),
        ("PSA 10 Charizard", None, "graded_listing"),
        ("Gastly Art Rare GRAAD 9.5", None, "graded_listing"),
        ("Venusaur 200/165 151 Jap", None, "japanese_listing"),
        ("ポケモンカード リザードン", None, "japanese_listing"),
        ("Dialga Platinum", None, "non_card_item"),
    ],
)
def test_filters(spark, title, description, want):
    df = spark.createDataFrame([(title, description, 5.0)], "title string, description string, price double")
    assert df.select(prefilter.reason(Settings())).first()[0] == want


def test_bounds_names_and_bulk(spark):
    df = spark.createDataFrame([("a", "x Pikachu!", None, 0.5), ("b", "pikachuu", None, 500.0), ("c", "Mr. Mime 5", None, 0.49), ("d", "a mr. mime", None, 500.01), ("e", "250x bulk 2 kg", None, 1.0), ("f", "25pikachu-ex", None, 1.0)], "listing_id string, title string, description string, price double")
    assert [r[0] for r in df.select(prefilter.reason(Settings(max_price=500.0))).collect()] == [None, None, "price_out_of_range", "price_out_of_range", "lot_listing", None]
    names = spark.createDataFrame([("Pikachu",), ("Mr. Mime",)], "name string")
    assert {r["listing_id"]: r["has_name"] for r in prefilter.with_known_name(df, names).collect()} == {"a": True, "b": False, "c": True, "d": True, "e": False, "f": True}
    done = {r["listing_id"]: r for r in prefilter.analysed(df).collect()}
    assert (done["e"]["is_bulk_lot"], done["e"]["estimated_card_count"], done["e"]["price_per_card"], done["e"]["confidence"]) == (True, 250, 0.004, "High")
    assert done["a"]["confidence"] == "Medium" and done["c"]["confidence"] == "Low"
    assert {r["listing_id"] for r in offers.bulk_alerts(df).collect()} == {"e"}


def brute_score(a, b):
    """As the rule says it, on dictionaries."""
    if a["fingerprint"] and a["fingerprint"] == b["fingerprint"]:
        return 100.0
    parts = []
    if (b["title"] or "").strip():
        parts.append(fuzzy.token_sort_ratio((a["title"] or "").lower().strip(), b["title"].lower().strip()))
    if a["card_name"] and b["card_name"]:
        parts.append(fuzzy.ratio(b["card_name"].lower(), a["card_name"].lower()) * 0.8)
    for key, f in (("collector_number", str.strip), ("set_code", str.upper)):
        x, y = f(a[key] or ""), f(b[key] or "")
        if x and y:
            parts.append(100.0 if x == y else 0.0)
    if a["tokens"] and b["tokens"]:
        parts.append(100 * len(set(a["tokens"]) & set(b["tokens"])) / max(len(a["tokens"]), len(b["tokens"])))
    if len(parts) < 2:
        return parts[0] if parts else 0.0
    return (1.5 * parts[0] + sum(parts[1:])) / (0.5 + len(parts))


CARD = "id long, listing_id string, title string, fingerprint string, card_name string, collector_number string, set_code string, tokens array<string>, url string, product_name string, confidence double, date_added timestamp"


def cards(rng, first, n, stored):
    words = ["charizard", "ex", "base", "pikachu", "holo", "v", "promo", "125"]
    out = []
    for i in range(first, first + n):
        name = rng.choice([None, "", "charizard ex", "pikachu", "charizard", "Pikachu "])
        number, code = rng.choice([None, "", "125/197", "1", "25", " 1"]), rng.choice([None, "", "OBF", "obf", "CEL"])
        title = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        title = rng.choice([title, title, title.title(), f" {title}\xa0x", "  "])
        if stored and rng.random() < 0.2:
            title = rng.choice([None, ""])
        tokens = rng.choice([None, [], [w for w in (name or "").split()] + [x for x in (code, number) if x], title.split() if title else []])
        out.append({"id": i, "listing_id": str(i), "title": title, "fingerprint": rng.choice([None, "", f"f{rng.randint(0, 9)}"]), "card_name": name, "collector_number": number, "set_code": code, "tokens": tokens, "url": f"u{i}", "product_name": "p", "confidence": rng.choice([0.5, 0.9]), "date_added": datetime(2024, 1, rng.randint(1, 3))})
    return out


def cards_frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in CARD.split(", ")) for r in rows], CARD)


@pytest.mark.parametrize("threshold", [65.72, 66.5, 70.5, 73.2, 73.4, 77, 78.2, 80, 85, 92, 100])
def test_blocked_join_equals_brute_force(spark, threshold):
    """All pairs at or above the threshold, at any that is accepted; the native cap drops none of them."""
    rng = random.Random(int(threshold * 10))
    a, b = cards(rng, 0, 70, False), cards(rng, 1000, 90, True)
    x, y = cards_frame(spark, a), cards_frame(spark, b)
    found = resolver.scored(resolver.blocked_pairs(x, y, threshold), x, y, threshold).where(F.col("score") >= threshold - 1e-9)
    got = {(r["listing_id"], r["id"]): r["score"] for r in found.select("listing_id", "id", "score").collect()}
    want = {(p["listing_id"], q["id"]): pytest.approx(brute_score(p, q)) for p in a for q in b if brute_score(p, q) >= threshold - 1e-9}
    assert len(want) > 10 and got == want


def test_best_mapping_and_hot_signatures(spark, monkeypatch):
    rng = random.Random(4)
    a, b = cards(rng, 0, 60, False), cards(rng, 1000, 80, True)
    want = {}
    for x in a:
        ranked = sorted(((-brute_score(x, y), -y["confidence"], -y["date_added"].timestamp(), y["id"]) for y in b if brute_score(x, y) >= 80))
        if ranked:
            want[x["listing_id"]] = (ranked[0][3], pytest.approx(-ranked[0][0]))
    for hot in (5_000, 2):
        monkeypatch.setattr(resolver, "HOT_SIGNATURE", hot)
        got = {r["listing_id"]: (r["mapping_id"], r["score"]) for r in resolver.best_mapping(cards_frame(spark, a), cards_frame(spark, b)).collect()}
        assert len(want) > 5 and got == want


def test_thresholds_that_any_pair_may_reach_are_refused(spark):
    rows = cards_frame(spark, cards(random.Random(1), 0, 2, True))
    for threshold in (0, 50, 65.7):
        with pytest.raises(ValueError, match="threshold must be above"):
            resolver.blocked_pairs(rows, rows, threshold)


def test_scored_pairs_grow_with_the_rows(spark):
    """Ten times the rows, of as many more numbers, sets and names: ten times the pairs."""
    n = {}
    for k in (300, 3000):
        df = spark.range(k).select(F.col("id"), F.col("id").cast("string").alias("listing_id"), F.concat(F.lit("card n"), (F.col("id") % (k // 3)).cast("string"), F.lit(" near mint holo")).alias("title"), F.lit(None).cast("string").alias("fingerprint"),
                                    F.concat(F.lit("n"), (F.col("id") % (k // 3)).cast("string")).alias("card_name"), (F.col("id") % (k // 2)).cast("string").alias("collector_number"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("S"), (F.col("id") % (k // 10)).cast("string"))).alias("set_code"))
        df = df.withColumn("tokens", F.filter(F.array("card_name", F.lit("card"), F.lit("holo"), F.lower("set_code"), "collector_number"), lambda t: t.isNotNull()))
        n[k] = [resolver.blocked_pairs(df, df, t).count() for t in (80.0, 70.0)]
    assert all(b <= 15 * a for a, b in zip(n[300], n[3000]))


def test_construction(spark):
    cards = spark.createDataFrame(
        [("1", "Dark Raichu", "TR", None, "83/82", "French", False, False, 1, "f1"), ("2", "Charizard ex", "OBF", None, "125/197", None, True, False, None, "f2"), ("3", "Mew", None, "Celebrations", "25/25", None, False, False, 7, "f3"), ("4", "Mew", "XX", None, "1/2", None, False, False, None, "f4"), ("5", "Mew", None, None, "1", None, False, False, None, "f5")],
        "listing_id string, card_name string, set_code string, set_name string, collector_number string, language string, is_reverse_holo boolean, is_promo boolean, condition_code int, fingerprint string",
    )
    codes = spark.createDataFrame([("TR", "Team-Rocket"), ("OBF", "Obsidian-Flames"), ("CEL", "Celebrations")], "code string, slug string")
    rules = spark.createDataFrame([(1, "TR", "X", 9, 0.5), (2, "TR", "TR", 1, 0.9), (3, "OBF", "Z", 1, 0.1)], "id long, set_code string, prefix string, uses_successful long, confidence double")
    overrides = spark.createDataFrame([("f5", "https://override", "s")], "fingerprint string, url string, preferred_slug string")
    sets = spark.createDataFrame([("celebrations", "CEL", 0)], "key string, code string, pos int")
    got = {r["listing_id"]: (r["url"].replace("https://www.market.example/en/Pokemon/Products/Singles/", ""), r["confidence"], r["needs_validation"]) for r in resolver.constructed(cards, codes, rules, overrides, sets).collect()}
    assert got == {
        "1": ("Team-Rocket/Dark-Raichu-TR83?sellerCountry=23&language=2&minCondition=1", 0.75, True),
        "2": ("Obsidian-Flames/Charizard-ex-125?sellerCountry=23&language=1&isReverseHolo=Y&minCondition=2", 0.6, True),
        "3": ("Celebrations/Mew-25?sellerCountry=23&language=1", 0.5, True),
        "5": ("https://override", 0.95, False),
    }


def tables(spark, shop, seen=()):
    products, prices, codes = shop
    page = "https://www.market.example/en/Pokemon/Products/Singles/Obsidian-Flames/Mew-77?sellerCountry=23&language=1&minCondition=2"
    return offers.Tables(
        seen=spark.createDataFrame([(s,) for s in seen], "listing_id string"), names=spark.createDataFrame([(n,) for n in LEXICON.names], "name string"), products=products, prices=prices, codes=codes,
        set_names=spark.createDataFrame([("celebrations", "CEL", 0), ("obsidian flames", "OBF", 1)], "key string, code string, pos int"),
        mappings=spark.createDataFrame([], "id long, title string, fingerprint string, card_name string, collector_number string, set_code string, tokens array<string>, url string, product_name string, confidence double, date_added timestamp"),
        rules=spark.createDataFrame([], "id long, set_code string, prefix string, uses_successful long, confidence double"), overrides=spark.createDataFrame([], "fingerprint string, url string"),
        page_prices=spark.createDataFrame([(page, 100.0, 9), (page.replace("Mew-77", "Mew-V2-80"), 50.0, 10), (page.replace("Mew-77", "Mew-V4-80"), 40.0, 11)], "url string, from_price double, id_product long"),
    )


LISTINGS = [
    ("seen", "Pikachu 025/193 Base", 1.0), ("cheap", "Bulbasaur 001/025 Celebrations", 10.0), ("dear", "Pikachu 025/193 base", 39.0), ("low", "Pikachu 1/2", 0.1), ("album", "Pikachu album", 5.0),
    ("lot", "lot of 300 cards Pikachu", 2.0), ("lot2", "lot of 20 cards Pikachu", 2.0), ("psa", "PSA 9 Pikachu", 5.0), ("jap", "Pikachu japanese", 5.0), ("none", "nothing known 1/2", 5.0), ("bare", "Pikachu", 5.0),
    ("built", "Mew 77/197 OBF Obsidian Flames", 5.0), ("nopage", "Mew 78/197 OBF Obsidian Flames", 5.0), ("variant", "Mew 80/197 OBF Obsidian Flames", 5.0), ("unknown", "Mew 79/97", 5.0),
]
WANT = {
    "cheap": ("deals", "profitable", None), "dear": ("match", "not_profitable", None), "low": ("skipped", "skipped", "price_out_of_range"), "album": ("skipped", "skipped", "non_card_item"),
    "lot": ("deals", "cheap_lot", "lot_listing"), "lot2": ("skipped", "skipped", "lot_listing"), "psa": ("skipped", "skipped", "graded_listing"), "jap": ("skipped", "skipped", "japanese_listing"),
    "none": ("none", "dropped", "no_known_name"), "bare": ("review", "review", "unresolvable_no_identifiers"), "built": ("deals", "profitable", None), "nopage": ("review", "error", "from_price_missing"), "variant": ("deals", "profitable", None), "unknown": ("unidentified", "unidentified", "not_in_catalog_or_db"),
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, p, None) for i, t, p in rows], "listing_id string, title string, price double, description string")


def test_the_whole_plan(spark, shop):
    rows = offers.decided(frame(spark, LISTINGS + LISTINGS[:3]), tables(spark, shop, ["seen"]), LEXICON).collect()
    assert {r["listing_id"]: (r["channel"], r["verdict"], r["reason"]) for r in rows} == WANT and len(rows) == len(WANT)
    by = {r["listing_id"]: r for r in rows}
    assert (by["cheap"]["source"], by["cheap"]["from_price"], by["cheap"]["total_max"], by["cheap"]["diff"]) == ("catalog", 60.0, 18.29, 41.71)
    assert (by["built"]["source"], by["built"]["product_id"]) == ("constructed", 9) and by["dear"]["bid_price"] == 31.2
    assert (by["variant"]["product_id"], by["variant"]["from_price"]) == (10, 50.0)
    results = spark.createDataFrame(rows, offers.RESULT)
    assert tuple(offers.counters(results).first()) == (14, 3, 3)
    added = offers.state_rows(results, offers.with_identity(frame(spark, LISTINGS), LEXICON))
    ids = lambda name: sorted(r["listing_id"] for r in added[name].select("listing_id").collect())
    assert ids("seen_listings") == sorted(WANT) and ids("error_log") == ["nopage"] and ids("deal_messages") == ["built", "cheap", "dear", "variant"]
    assert ids("review_queue") == sorted(k for k, v in WANT.items() if v[0] in ("review", "unidentified", "skipped")) and added["card_mappings"].count() == 4


def test_stream_equals_batch_and_resumes(spark, shop, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    columns = "listing_id string, title string, price double, description string"

    def land(name, rows):
        (source / f"{name}.json").write_text("\n".join(json.dumps({"listing_id": i, "title": t, "price": p}) for i, t, p in rows))

    def drain():
        decide = lambda batch, seen: offers.decided(batch, tables_with(seen), LEXICON)
        run_stream(spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).json(str(source)), decide, str(out), str(tmp_path / "checkpoint")).awaitTermination()

    def tables_with(seen):
        t = tables(spark, shop)
        t.seen = seen
        return t

    land("a", LISTINGS[1:6])
    drain()
    land("b", LISTINGS[1:])
    drain()
    rows = spark.read.parquet(str(out / "results")).collect()
    assert {r["listing_id"]: (r["channel"], r["verdict"], r["reason"]) for r in rows} == WANT and len(rows) == len(WANT)


def test_tokens_are_kept_twice(spark):
    none = F.lit(None).cast("string")
    assert spark.range(1).select(tx.tokens(F.lit("A a"), none, none, none, none)).first()[0] == ["a", "a"]


def test_fuzzy_query_against_all_pairs(spark):
    """The whole query on the smallest tables: every title against every mapping, scored one by one."""
    from offerlens.plans import queries

    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in queries._mapping_rows(spark, sf).collect()]
    stored = [{**r, "title": f"{r['collector_number']} {r['set_code']} {r['card_name']} NM", "fingerprint": r["fingerprint"] if r["p_partkey"] % 2 == 0 else None} for r in rows]
    want = {}
    for a in rows:
        best = min((-brute_score(a, b), b["p_partkey"]) for b in stored)
        if -best[0] >= 80:
            want[str(a["p_partkey"])] = (best[1], pytest.approx(-best[0]))
    got = {r["listing_id"]: (r["mapping_id"], r["score"]) for r in queries.q_fuzzy_resolve(spark, sf).collect()}
    assert len(got) > 50 and got == want


def test_asks_and_products_alike_are_looked_up_once(spark, monkeypatch):
    products = [(i, i, f"Card {i % 2}", "7", f"Set {i % 3}", 1, "Rare") for i in range(60)]
    products = catalogue.indexed(spark.createDataFrame(products, "pos long, id_product long, name string, number string, expansion_name string, id_expansion long, rarity string"))
    rows = [("Card 1", "7", "Set 2", None), ("Card 0", "007/9", None, None), ("Card 0", "7", "Nowhere", None)] * 20
    met, plain = [], catalogue.candidates
    monkeypatch.setattr(catalogue, "candidates", lambda *a: met.append(plain(*a)) or met[-1])
    found = {r["ask_id"]: r["id_product"] for r in catalogue.best_product(asked(spark, rows), products, spark.createDataFrame([], "code string, slug string")).collect()}
    assert found == {i: (5, 0, 0)[i % 3] for i in range(60)}
    assert met[0].count() == 2 + 6 + 6  # not 20 asks of each kind by 10 products of each name and set


def test_mappings_and_listings_alike_are_compared_once(spark, monkeypatch):
    """Copies cost no pairs; ties among mappings alike go to the most confident, then the newest, then the least id."""
    card = {"title": "pikachu base 25", "fingerprint": None, "card_name": "pikachu", "collector_number": "25", "set_code": "BS", "tokens": ["pikachu", "25"], "product_name": "p"}
    a = [{**card, "id": i, "listing_id": str(i), "url": "", "confidence": 0.5, "date_added": datetime(2024, 1, 1)} for i in range(30)]
    b = [{**card, "id": 100 + i, "listing_id": "", "url": f"u{i}", "confidence": (0.5, 0.9)[i % 2], "date_added": datetime(2024, 1, 1 + i % 4 // 3)} for i in range(30)]
    met, plain = [], resolver.blocked_pairs
    monkeypatch.setattr(resolver, "blocked_pairs", lambda *x: met.append(plain(*x)) or met[-1])
    got = {r["listing_id"]: (r["mapping_id"], r["url"]) for r in resolver.best_mapping(cards_frame(spark, a), cards_frame(spark, b)).collect()}
    assert got == {str(i): (103, "u3") for i in range(30)} and met[0].count() == 1


def test_listings_alike_are_read_built_and_paged_once(spark, shop, monkeypatch):
    """Copies cost no readings of titles, no URLs and no variants; a listing without an id is dropped, a title with another description is another text."""
    kinds = [("Mew 80/197 OBF Obsidian Flames", None), ("Mew 80/197 OBF Obsidian Flames", "mint"), ("nothing known 1/2", None)]
    rows = [(str(i), kinds[i % 3][0], 5.0, kinds[i % 3][1]) for i in range(60)] + [(None, kinds[0][0], 5.0, None)]
    seen, read, named, paged = {}, offers.with_identity, resolver.set_name_codes, offers.variant_pages
    keep = lambda name, df: seen.setdefault(name, df)
    monkeypatch.setattr(offers, "with_identity", lambda df, lexicon: read(keep("read", df), lexicon))
    monkeypatch.setattr(resolver, "set_name_codes", lambda df, table: named(keep("built", df), table))
    monkeypatch.setattr(offers, "variant_pages", lambda df, pages: keep("paged", paged(df, pages)))
    out = offers.decided(spark.createDataFrame(rows, "listing_id string, title string, price double, description string"), tables(spark, shop), LEXICON).collect()
    want = {str(i): (("deals", "profitable"), ("review", "error"), ("none", "dropped"))[i % 3] for i in range(60)} | {None: ("none", "dropped")}  # no page of mint cards
    assert {r["listing_id"]: (r["channel"], r["verdict"]) for r in out} == want and len(out) == 61
    assert {name: df.count() for name, df in seen.items()} == {"read": 2, "built": 2, "paged": 1}


def test_a_stream_writes_a_file_a_channel_and_reads_back_what_was_seen(spark, tmp_path):
    """However many tasks decide; a batch without results is one too."""
    (tmp_path / "in").mkdir()
    made = []

    def decide(rows, seen):
        made.append(rows.count())
        return rows.join(seen, "listing_id", "left_anti").repartition(20).withColumn("channel", F.when(F.col("price") < 30, "low").otherwise("high"))

    for n, ids in enumerate((range(40), range(40), range(20, 60))):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"listing_id": str(i), "price": i}) for i in ids))
        run_stream(spark.readStream.schema("listing_id string, price double").json(str(tmp_path / "in")), decide, str(tmp_path / "out"), str(tmp_path / "checkpoint"), buckets=4).awaitTermination()
        assert len(list((tmp_path / "out" / "results" / f"batch={n}").rglob("*.parquet"))) == (2, 0, 1)[n]
    assert made == [40, 40, 40] and sorted(int(r["listing_id"]) for r in spark.read.parquet(str(tmp_path / "out" / "results")).collect()) == list(range(60))
