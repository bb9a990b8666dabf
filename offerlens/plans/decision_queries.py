"""The decision plan and the learning loop as queries: listings made of the driver's parts, with the rows that they must give.

Titles come in kinds, one for each way through the plan; the SQL says by hand what each kind must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as tx

from ..functions.identify import Lexicon
from ..operators import catalogue, prefilter, reports, resolver, state
from ..sources import sinks
from ..streaming.offers import run_stream
from . import feedback, offers
from .registry import query, table


def _of_kinds(df: DataFrame, key: str, kinds: list[tuple]) -> DataFrame:
    """``df`` with k (the key modulo the number of kinds), title and description."""
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in kinds]), (F.col("k") + 1).cast("int"))
    df = df.withColumn("k", (F.col(key) % len(kinds)).cast("int"))
    return df.withColumn("title", pick(0)).withColumn("description", pick(1))


FILTER_KINDS = [
    ("Pikachu 4/102", None), ("Pikachu plush 3", None), ("Lotto Pikachu", None), ("Pikachu PSA 9", None), ("Pikachu japonais", None), ("Unknown thing 7", None), ("Binder bundle Pikachu", None), ("Bundle PSA Pikachu", None),
    ("PSA 10 giapponese Pikachu", None), ("Japanese thing", None), ("Pikachu 4 cartes", None), ("ピカチュウ Pikachu", None), ("Mr. Mime 22/64", None), ("The Old Man of the High Mountain 1/2", None), ("card-pikachu!", None),
    ("Eevee 5/60", "sold with toploader, gradée"), ("Tapu & Koko 3/9", ""), ("Pikachu platinum", None),
]
NAMES = ["Pikachu", "Eevee", "Mr. Mime", "Mew", "The Old Man of the High Mountain", "Tapu & Koko"]


def _filter_rows(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("listing_id"), F.col("p_retailprice").alias("price"))
    return _of_kinds(parts, "p_partkey", FILTER_KINDS)


@query("""WITH k(k, reason) AS (VALUES (0, 'ok'), (1, 'non_card_item'), (2, 'lot_listing'), (3, 'graded_listing'), (4, 'japanese_listing'), (5, 'no_known_name'), (6, 'non_card_item'), (7, 'lot_listing'), (8, 'graded_listing'),
  (9, 'japanese_listing'), (10, 'lot_listing'), (11, 'japanese_listing'), (12, 'ok'), (13, 'ok'), (14, 'ok'), (15, 'graded_listing'), (16, 'ok'), (17, 'non_card_item'))
SELECT p_partkey, CASE WHEN p_retailprice BETWEEN 905.0 AND 1500.0 THEN reason ELSE 'price_out_of_range' END AS reason FROM part JOIN k ON p_partkey % 18 = k""")
def q_filter_chain(spark, sf_dir):
    """The first filter that fails, for each filter and orders of two."""
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    rows = prefilter.with_known_name(_filter_rows(spark, sf_dir), names)
    why = prefilter.reason(Settings(min_price=905.0, max_price=1500.0), F.col("has_name"))
    return rows.select("p_partkey", F.coalesce(why, F.lit("ok")).alias("reason"))


@query("""WITH k(k, non_card, lot, graded, japanese) AS (VALUES (0, false, false, false, false), (1, true, false, false, false), (2, false, true, false, false), (3, false, false, true, false), (4, false, false, false, true), (5, false, false, false, false),
  (6, true, true, false, false), (7, false, true, true, false), (8, false, false, true, true), (9, false, false, false, true), (10, false, true, false, false), (11, false, false, false, true), (12, false, false, false, false), (13, false, false, false, false),
  (14, false, false, false, false), (15, false, false, true, false), (16, false, false, false, false), (17, true, false, false, false))
SELECT p_partkey, non_card, non_card AND k <> 17 AS non_card_word, lot, graded, japanese FROM part JOIN k ON p_partkey % 18 = k""")
def q_title_flags(spark, sf_dir):
    """Each filter on each kind of title; "tin" in "platinum" counts as a substring, not as a word."""
    t, d = F.col("title"), F.col("description")
    return _filter_rows(spark, sf_dir).select("p_partkey", prefilter.is_non_card(t).alias("non_card"), prefilter.is_non_card(t, words=True).alias("non_card_word"), prefilter.is_lot(t, d).alias("lot"), prefilter.is_graded(t, d).alias("graded"), prefilter.is_japanese(t, d).alias("japanese"))


@query("""SELECT p_partkey, p_retailprice / 1000 / (p_size * 10) <= 0.01 AS cheap, p_size * 10 AS estimated_card_count, CASE WHEN p_retailprice / 1000 / (p_size * 10) <= 0.01 THEN 'match' END AS channel FROM part""")
def q_cheap_lots(spark, sf_dir):
    """The estimate of every lot, and lots at a cent a card or less, on the search for cards and on that for bulk."""
    n = (F.col("p_size") * 10).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("listing_id"), (F.col("p_retailprice") / 1000).alias("price"), n.alias("n"), F.format_string("lot of %d pokemon cards", n).alias("title"), F.lit("").alias("description"))
    alerts = offers.bulk_alerts(rows).select("listing_id", "channel")
    return prefilter.analysed(rows).withColumn("cheap", prefilter.is_cheap_lot(Settings())).join(alerts, "listing_id", "left").select("p_partkey", "cheap", "estimated_card_count", "channel")


ANALYSED = [("Lot of 250 cards", None), ("joblot of pokemon", "weighs 360 grams"), ("BULK cards", "no number"), ("Charizard holo 4/102", None), ("an old book", None), ("pokemon thing", "x"), ("kaarten lot 1,5 kg", "")]


@query("""WITH k(k, is_bulk_lot, n, confidence, valuation_explanation) AS (VALUES (0, true, 250, 'High', 'The listing states 250 cards.'), (1, true, 200, 'Medium', 'About 200 cards by weight.'), (2, true, NULL, 'Low', 'A lot of unknown size; there is no price a card.'),
  (3, false, NULL, 'Medium', 'The title names a specific card; a market price would confirm it.'), (4, false, NULL, 'Low', 'No sign of trading cards.'), (5, false, NULL, 'Medium', 'Trading cards, not named exactly; a market price would confirm it.'), (6, true, 833, 'Medium', 'About 833 cards by weight.'))
SELECT p_partkey, is_bulk_lot, n::INT AS estimated_card_count, round(p_size / n, 4) AS price_per_card, confidence, valuation_explanation FROM part JOIN k ON p_partkey % 7 = k""")
def q_analysis(spark, sf_dir):
    """Lots by words, count and weight, with confidence and explanation."""
    rows = _of_kinds(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("price")), "p_partkey", ANALYSED)
    return prefilter.analysed(rows).select("p_partkey", "is_bulk_lot", "estimated_card_count", "price_per_card", "confidence", "valuation_explanation")


# --- the plan ---------------------------------------------------------------------

DECIDED = [
    ("Pikachu 4/102 Obsidian Flames", None), ("Pikachu plush", None), ("lot of 2000 cards Pikachu", None), ("Lotto Pikachu", None), ("Pikachu PSA 9", None), ("Pikachu jap", None), ("Unknown 12/100", None), ("Pikachu", None),
    ("Pikachu 4/102 Obsidian Flames", None), ("Mew 7/50 Obsidian Flames", None), ("Eevee 9/50 OBF", None), ("Eevee 10/50 OBF", None), ("Eevee 11/50 OBF", None), ("Mew 99/100", None), ("Pikachu 4/102 Obsidian Flames", None),
]
LEXICON = Lexicon(names=("Pikachu", "Eevee", "Mew"), set_names={"OBF": "Obsidian Flames"}, known_sets={"obsidian flames": "Obsidian Flames"})
_SINGLES = "https://www.market.example/en/Pokemon/Products/Singles/Obsidian-Flames"
_FILTERS = "?sellerCountry=23&language=1&minCondition=2"


def _listings(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("listing_id"), (F.lit(5) + F.col("p_size") * 0.5).alias("dear"))
    rows = _of_kinds(parts, "p_partkey", DECIDED)
    return rows.select("listing_id", "title", "description", F.when(F.col("k") == 0, 0.10).when(F.col("k") == 2, 5.0).otherwise(F.col("dear")).alias("price"), "p_partkey")


def _tables(spark, sf_dir) -> offers.Tables:
    """Kinds: 0 price, 1 no card, 2 cheap lot, 3 lot, 4 graded, 5 Japanese, 6 no name, 7 no identifiers, 8 catalogue, 9 stored mapping, 10 constructed, 11 constructed without a page, 12 a variant's page, 13 unknown, 14 seen."""
    make = spark.createDataFrame
    product = make([(0, 1, "Pikachu", "4", "Obsidian Flames", 11, "Rare"), (1, 2, "Mew", "70", "Obsidian Flames", 11, "Rare")], "pos long, id_product long, name string, number string, expansion_name string, id_expansion long, rarity string")
    mapping = make([(1, "Mew 7/50 Obsidian Flames", "Mew", "7/50", None, "https://www.market.example/stored/mew", "Mew", 0.9)], "id long, title string, card_name string, collector_number string, set_code string, url string, product_name string, confidence double")
    none = F.lit(None).cast("string")
    mapping = mapping.withColumn("fingerprint", tx.fingerprint("card_name", "set_code", "collector_number")).withColumn("tokens", tx.tokens("card_name", none, "set_code", "collector_number", none)).withColumn("date_added", F.lit("2020-01-01").cast("timestamp"))
    pages = [("https://www.market.example/stored/mew", 30.0, 9), (f"{_SINGLES}/Eevee-9{_FILTERS}", 12.0, 10), (f"{_SINGLES}/Eevee-V2-11{_FILTERS}", 40.0, 12)]
    return offers.Tables(
        seen=table(spark, sf_dir, "part").where("p_partkey % 15 = 14").select(F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("listing_id")),
        names=make([("Pikachu",), ("Eevee",), ("Mew",)], "name string"), products=catalogue.indexed(product),
        prices=make([(1, 20.0, 21.0, 22.0, 23.0, 24.0)], "id_product long, low double, trend double, avg30 double, avg7 double, avg1 double"),
        codes=make([("obf", "Obsidian-Flames")], "code string, slug string"), set_names=make([("obsidian flames", "OBF", 0)], "key string, code string, pos int"),
        mappings=mapping, rules=make([], "id long, set_code string, prefix string, confidence double, uses_successful long"), overrides=make([], "fingerprint string, url string"),
        page_prices=make(pages, offers.PAGE_PRICE),
    )


_DECIDED = f"""k(k, channel, verdict, reason, source, confidence, product_id, url, from_price) AS (VALUES
  (0, 'skipped', 'skipped', 'price_out_of_range', NULL, NULL, NULL, NULL, NULL), (1, 'skipped', 'skipped', 'non_card_item', NULL, NULL, NULL, NULL, NULL), (2, 'deals', 'cheap_lot', 'lot_listing', NULL, NULL, NULL, NULL, NULL),
  (3, 'skipped', 'skipped', 'lot_listing', NULL, NULL, NULL, NULL, NULL), (4, 'skipped', 'skipped', 'graded_listing', NULL, NULL, NULL, NULL, NULL), (5, 'skipped', 'skipped', 'japanese_listing', NULL, NULL, NULL, NULL, NULL),
  (6, 'none', 'dropped', 'no_known_name', NULL, NULL, NULL, NULL, NULL), (7, 'review', 'review', 'unresolvable_no_identifiers', NULL, NULL, NULL, NULL, NULL),
  (8, NULL, NULL, NULL, 'catalog', 0.90, 1, '{_SINGLES}/Pikachu-4', 20), (9, NULL, NULL, NULL, 'database', 1.0, 9, 'https://www.market.example/stored/mew', 30),
  (10, NULL, NULL, NULL, 'constructed', 0.60, 10, '{_SINGLES}/Eevee-9{_FILTERS}', 12), (11, 'review', 'error', 'from_price_missing', 'constructed', 0.60, NULL, '{_SINGLES}/Eevee-10{_FILTERS}', NULL),
  (12, NULL, NULL, NULL, 'constructed', 0.60, 12, '{_SINGLES}/Eevee-V2-11{_FILTERS}', 40), (13, 'unidentified', 'unidentified', 'not_in_catalog_or_db', NULL, NULL, NULL, NULL, NULL)),
l AS (SELECT 'L' || p_partkey AS listing_id, CAST(5 + p_size * 0.5 AS DECIMAL(14,2)) AS price, k.* FROM part JOIN k ON p_partkey % 15 = k),
f AS (SELECT *, CAST(round(price * 0.05 + 0.70, 2) AS DECIMAL(14,2)) AS cost, CAST(from_price AS DECIMAL(14,2)) AS reference FROM l),
t AS (SELECT *, CAST(price + cost + 2.89 AS DECIMAL(14,2)) AS least, CAST(price + cost + 7.09 AS DECIMAL(14,2)) AS most FROM f),
r AS (SELECT listing_id, coalesce(channel, CASE WHEN most < reference THEN 'deals' ELSE 'match' END) AS channel, coalesce(verdict, CASE WHEN most < reference THEN 'profitable' ELSE 'not_profitable' END) AS verdict, reason, source, confidence::DOUBLE AS confidence, product_id::BIGINT AS product_id, url,
  reference::DOUBLE AS from_price, CASE WHEN reference IS NOT NULL THEN cost::DOUBLE END AS fee, CASE WHEN reference IS NOT NULL THEN least::DOUBLE END AS total_min, CASE WHEN reference IS NOT NULL THEN most::DOUBLE END AS total_max,
  (reference - most)::DOUBLE AS diff, round((reference - most)::DOUBLE / reference::DOUBLE * 100, 6) AS pct, CASE WHEN reference IS NOT NULL AND NOT most < reference THEN CAST(round(price * 0.80, 2) AS DECIMAL(14,2))::DOUBLE END AS bid_price FROM t)"""


@query(f"WITH {_DECIDED} SELECT * FROM r")
def q_decided(spark, sf_dir):
    """R04 S16 F09 F11 F12 J10 C37 and the steps they join: one row for each unseen listing, by every way through the plan."""
    return offers.decided(_listings(spark, sf_dir), _tables(spark, sf_dir), LEXICON).withColumn("pct", F.round("pct", 6))


@query(f"""WITH {_DECIDED} SELECT listing_id, CASE WHEN source = 'constructed' THEN 'unidentified' ELSE channel END AS channel, CASE WHEN source = 'constructed' THEN 'unidentified' ELSE verdict END AS verdict FROM r""")
def q_check_listing(spark, sf_dir):
    """The same without construction."""
    return offers.decided(_listings(spark, sf_dir), _tables(spark, sf_dir), LEXICON, construct=False).select("listing_id", "channel", "verdict")


@query(f"""WITH {_DECIDED} SELECT count(*)::BIGINT AS checked, count(*) FILTER (WHERE verdict = 'profitable')::BIGINT AS profitable, count(*) FILTER (WHERE channel IN ('review', 'unidentified'))::BIGINT AS reviewed,
  (SELECT count(*) FROM nation)::BIGINT AS mappings FROM r""")
def q_cycle_status(spark, sf_dir):
    """The counters of a cycle beside the number of mappings."""
    done = offers.decided(_listings(spark, sf_dir), _tables(spark, sf_dir), LEXICON)
    return reports.status(offers.counters(done), table(spark, sf_dir, "nation"))


@query(f"""WITH {_DECIDED} SELECT 'seen_listings' AS state, count(*)::BIGINT AS n FROM r UNION ALL SELECT 'review_queue', count(*) FROM r WHERE channel IN ('review', 'unidentified', 'skipped') UNION ALL SELECT 'error_log', count(*) FROM r WHERE verdict = 'error'
UNION ALL SELECT 'card_mappings', count(*) FROM r WHERE source IN ('catalog', 'constructed') AND from_price > 0 UNION ALL SELECT 'deal_messages', count(*) FROM r WHERE verdict IN ('profitable', 'not_profitable')""")
def q_state_rows(spark, sf_dir):
    """What a cycle adds to each state table."""
    rows = _listings(spark, sf_dir)
    added = offers.state_rows(offers.decided(rows, _tables(spark, sf_dir), LEXICON), offers.with_identity(rows, LEXICON))
    empty = spark.createDataFrame([], "state string, n long")
    for name, new in added.items():
        empty = state.append(empty, new.agg(F.lit(name).alias("state"), F.count(F.lit(1)).alias("n")))
    return empty


def _folder(spark, name: str) -> str:
    from ..session import shared_folder

    return shared_folder(spark, name)


@query(f"""WITH {_DECIDED} SELECT channel, verdict, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def q_result_sink(spark, sf_dir):
    """Results by channel, written and read back."""
    folder = _folder(spark, "results")
    sinks.write_results(offers.decided(_listings(spark, sf_dir), _tables(spark, sf_dir), LEXICON), folder)
    return spark.read.parquet(folder).groupBy("channel", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE o_orderkey % 7 = 0""")
def q_state_sink(spark, sf_dir):
    """Versions of a state table, the second after an upsert, bad records set aside."""
    folder = _folder(spark, "state")
    held = sinks.StateTable(spark, f"{folder}/orders", "o_orderkey long, o_totalprice double, ts timestamp")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").alias("ts"))
    good = sinks.write_bad_records(rows, F.col("o_orderkey") % 7 == 0, f"{folder}/bad")
    held.write(good)
    fixed = spark.read.parquet(f"{folder}/bad").withColumn("o_totalprice", F.lit(-1.0))
    held.write(state.upsert(held.read(), fixed, ["o_orderkey"], ["ts"]))
    return held.read().select("o_orderkey", "o_totalprice")


@query(f"""WITH {_DECIDED} SELECT listing_id, channel, verdict, source FROM r""")
def q_stream_decisions(spark, sf_dir):
    """The plan over a stream that is stopped after its first rows and resumed with all; listings of the first run come again and count once."""
    folder, tables = _folder(spark, "decisions"), _tables(spark, sf_dir)
    rows = _listings(spark, sf_dir)

    def decide(batch: DataFrame, seen: DataFrame) -> DataFrame:
        now = offers.Tables(**{**vars(tables), "seen": tables.seen.unionByName(seen)})
        return offers.decided(batch, now, LEXICON)

    for part in (rows.where("p_partkey % 3 = 0"), rows):
        part.write.mode("append").parquet(f"{folder}/landed")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/landed")
        run_stream(source, decide, f"{folder}/out", f"{folder}/checkpoint", buckets=16).awaitTermination()
    return spark.read.option("recursiveFileLookup", False).option("basePath", f"{folder}/out/results").parquet(f"{folder}/out/results/*").select("listing_id", "channel", "verdict", "source")


# --- gates and construction ---------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Mew' ELSE '' END AS n, CASE WHEN c_custkey % 3 = 0 THEN 'Fossil' END AS s, CASE WHEN c_custkey % 5 = 0 THEN 'FO' ELSE '' END AS c, CASE WHEN c_custkey % 7 < 4 THEN '7/62' END AS m FROM customer)
SELECT c_custkey, n <> '' AND (s IS NOT NULL OR c <> '' OR m IS NOT NULL) AS identifiable, n <> '' AND (s IS NOT NULL OR c <> '') AND m IS NOT NULL AS constructible FROM c""")
def q_gates(spark, sf_dir):
    """What may be resolved, and what may be constructed; empty strings are nothing."""
    k = F.col("c_custkey")
    cols = (F.when(k % 2 == 0, "Mew").otherwise(""), F.when(k % 3 == 0, "Fossil"), F.when(k % 5 == 0, "FO").otherwise(""), F.when(k % 7 < 4, "7/62"))
    return table(spark, sf_dir, "customer").select("c_custkey", prefilter.is_identifiable(*cols).alias("identifiable"), prefilter.may_construct(*cols).alias("constructible"))


@query(f"""WITH k(k, slug, confidence, needs_validation) AS (VALUES (0, '{_SINGLES}/Pikachu-OBF46?sellerCountry=23&language=1&minCondition=2', 0.60, true), (1, 'https://www.market.example/override', 0.95, false),
  (2, 'https://www.market.example/en/Pokemon/Products/Singles/Team-Rocket/Dark-Slowbro-TR29?sellerCountry=23&language=3&minCondition=1', 0.75, true), (3, '{_SINGLES}/Mew-7?sellerCountry=23&language=1&isReverseHolo=Y', 0.50, true), (4, NULL, NULL, NULL))
SELECT s_suppkey::VARCHAR AS listing_id, slug AS url, confidence::DOUBLE AS confidence, needs_validation FROM supplier JOIN k ON s_suppkey % 5 = k WHERE slug IS NOT NULL""")
def q_constructed(spark, sf_dir):
    """An override, a learned prefix, a code, the code of a set's name, and a set that nobody knows."""
    kinds = [("Pikachu", "OBF", None, "46", None, 2, False, False), ("Eevee", "OBF", None, "1/9", None, 2, False, False), ("Dark Slowbro", "TR", None, "29/82", "German", 1, False, False), ("Mew", None, "Obsidian Flames", "7/50", None, 7, True, False), ("Mew", "ZZ", "Nowhere", "7/50", None, None, False, False)]
    schema = "k int, card_name string, set_code string, set_name string, collector_number string, language string, condition_code int, is_reverse_holo boolean, is_promo boolean"
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], schema)
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("listing_id"), (F.col("s_suppkey") % 5).cast("int").alias("k")).join(F.broadcast(rows), "k")  # five rows
    asked = asked.withColumn("fingerprint", tx.fingerprint("card_name", "set_code", "collector_number"))
    codes = spark.createDataFrame([("OBF", "Obsidian-Flames"), ("tr", "Team-Rocket")], "code string, slug string")
    rules = spark.createDataFrame([(1, "TR", "TR", 0.9, 3), (2, "tr", "XX", 0.9, 2), (3, "OBF", "NO", 0.4, 9)], "id long, set_code string, prefix string, confidence double, uses_successful long")
    overrides = spark.createDataFrame([("Eevee", "OBF", "1/9")], "n string, c string, m string").select(tx.fingerprint("n", "c", "m").alias("fingerprint"), F.lit("https://www.market.example/override").alias("url"))
    sets = spark.createDataFrame([("obsidian flames", "OBF", 0), ("team rocket", "TR", 1)], "key string, code string, pos int")
    return resolver.constructed(asked, codes, rules, overrides, sets).select("listing_id", "url", "confidence", "needs_validation")


# --- the learning loop ----------------------------------------------------------------


@query("""WITH e AS (SELECT 'm' || event_id % 500 AS message_id, event_id, event_type FROM events)
SELECT message_id, arg_max(event_type, event_id) AS failure_step, max(event_id) AS id, 'see ' || message_id AS text FROM e GROUP BY 1""")
def q_associated(spark, sf_dir):
    """Replies with the newest item of the message that they answer."""
    items = feedback.last_with_message(table(spark, sf_dir, "events").select(F.concat(F.lit("m"), (F.col("event_id") % 500).cast("string")).alias("message_id"), F.col("event_id").alias("id"), F.col("event_type").alias("failure_step")))
    replies = spark.range(600).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id")).withColumn("text", F.concat(F.lit("see "), F.col("message_id")))
    return feedback.associated(replies, items).select("message_id", "failure_step", "id", "text")


_LEARNT = """s AS (SELECT s_suppkey AS seq, s_nationkey AS n, 'Card' || s_nationkey AS name, 'https://www.market.example/en/X/Products/Singles/Team/Card' || s_nationkey || '-TR' || (s_nationkey + 10) || CASE s_suppkey % 2 WHEN 0 THEN '' ELSE '?language=5' END AS url FROM supplier),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY n ORDER BY seq DESC) = 1)"""


def _corrected(spark, sf_dir) -> DataFrame:
    n = F.col("s_nationkey").cast("string")
    number = (F.col("s_nationkey") + 10).cast("string")
    base = F.concat(F.lit("https://www.market.example/en/X/Products/Singles/Team/Card"), n, F.lit("-"))
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Card "), n).alias("title"), F.concat(F.lit("Card"), n).alias("card_name"), F.concat(number, F.lit("/99")).alias("collector_number"), F.lit("").alias("set_code"), F.lit("Team").alias("set_name"),
        F.concat(base, number).alias("generated_url"), F.concat(F.lit("it is "), base, F.lit("TR"), number, F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("?language=5"), F.lit(" !")).alias("text"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("s_suppkey").alias("seq"),
    )
    codes = spark.createDataFrame([("old", "Team", 0), ("team", "Team", 1)], "code string, slug string, pos int")
    return feedback.corrections(feedback.replied_url(rows), codes).withColumn("fingerprint", tx.fingerprint("card_name", "rule_code", "collector_number"))


@query(f"""WITH {_LEARNT} SELECT name, url, 'Card' || n || '-TR' || (n + 10) AS preferred_slug, 'TEAM' AS set_code, (n + 10)::VARCHAR AS digits FROM l""")
def q_learned_overrides(spark, sf_dir):
    """The last correction of a card is its override and its variant's hint."""
    rows = _corrected(spark, sf_dir)
    current = spark.createDataFrame([], "fingerprint string, url string, preferred_slug string, created_at timestamp")
    kept = feedback.learned_overrides(current, rows).join(rows.select("fingerprint", "card_name", F.regexp_extract("collector_number", "^\\d+", 0).alias("digits")).distinct(), "fingerprint")
    hints = feedback.variant_hints(rows)
    same = (kept["card_name"] == hints["name_slug"]) & (kept["digits"] == hints["digits"]) & (kept["preferred_slug"] == hints["slug"])
    return kept.join(hints, same).select(F.col("card_name").alias("name"), "url", "preferred_slug", "set_code", hints["digits"])


@query(f"""WITH {_LEARNT} SELECT seq, name AS card_name, CASE WHEN seq % 2 = 0 THEN url || '?sellerCountry=23&language=1' ELSE url || '&sellerCountry=23' END AS url, 'Card' || n || '-TR' || (n + 10) AS product_name, 1.0::DOUBLE AS confidence FROM s""")
def q_learned_mappings(spark, sf_dir):
    """Mappings of confidence 1 with normalised URLs, appended to what there is."""
    rows = _corrected(spark, sf_dir).withColumn("title", F.col("seq").cast("string"))
    current = spark.createDataFrame([], "title string, fingerprint string, card_name string, collector_number string, set_code string, url string, product_name string, confidence double, date_added timestamp")
    return feedback.learned_mappings(current, rows).select(F.col("title").cast("long").alias("seq"), "card_name", "url", "product_name", "confidence")


@query("""SELECT 'TEAM' AS set_code, 'TR' AS prefix, 'Team' AS set_name, count(*)::BIGINT AS uses_successful, 0::BIGINT AS uses_failed, 1.0::DOUBLE AS confidence FROM supplier""")
def q_learned_rules(spark, sf_dir):
    """Every correction counts its prefix up."""
    current = spark.createDataFrame([], "set_code string, prefix string, set_name string, uses_successful long, uses_failed long, confidence double")
    return feedback.learned_rules(current, _corrected(spark, sf_dir))


@query("""WITH r AS (SELECT c_custkey AS seq, 1000 + c_nationkey AS pid, 'Set-' || c_nationkey % 4 AS set_slug, 'Card-' || c_custkey AS product_slug, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey % 5 END AS x FROM customer WHERE c_custkey % 6 > 0)
SELECT 'product' AS kind, pid AS id, arg_max(product_slug, seq) AS slug, NULL::BIGINT AS match_count FROM r GROUP BY pid UNION ALL
SELECT 'expansion', x, arg_max(set_slug, seq), count(*)::BIGINT + CASE x WHEN 0 THEN 5 ELSE 0 END FROM r WHERE x IS NOT NULL GROUP BY x""")
def q_id_slugs(spark, sf_dir):
    """Product ids out of replies, their slugs replaced, those of expansions replaced and counted on."""
    key = F.col("c_custkey")
    text = F.when(key % 6 == 0, F.lit("no id 12 here")).otherwise(F.concat(F.lit("it is "), (F.lit(1000) + F.col("c_nationkey")).cast("string"), F.lit(", really")))
    url = F.concat(F.lit("https://www.market.example/en/Products/Singles/Set-"), (F.col("c_nationkey") % 4).cast("string"), F.lit("/Card-"), key.cast("string"), F.lit("?language=1"))
    rows = table(spark, sf_dir, "customer").select(text.alias("text"), url.alias("corrected_url"), F.when(key % 3 > 0, F.col("c_nationkey") % 5).cast("long").alias("id_expansion"), F.lit("2024-01-01").cast("timestamp").alias("ts"), key.alias("seq"))
    current = spark.createDataFrame([(None, None, 0, "Old", 5)], "id_product long, product_slug string, id_expansion long, set_slug string, match_count long")
    products, expansions = feedback.store_id_slugs(current, feedback.id_slugs(rows))
    a = products.select(F.lit("product").alias("kind"), F.col("id_product").alias("id"), F.col("product_slug").alias("slug"), F.lit(None).cast("long").alias("match_count"))
    return a.unionByName(expansions.select(F.lit("expansion").alias("kind"), F.col("id_expansion").alias("id"), F.col("set_slug").alias("slug"), "match_count"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN p_size END, 1000 + c_nationkey)::BIGINT AS id_expansion FROM customer LEFT JOIN part ON c_custkey % 3 = 0 AND p_partkey = c_custkey WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN p_size END::BIGINT FROM customer LEFT JOIN part ON p_partkey = c_custkey WHERE c_custkey % 5 = 0""")
def q_expansion_ids(spark, sf_dir):
    """The expansion by product id, else by the set name's slug; slugs in place of an id are none."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key, F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, "Some-Slug").alias("product_id"), F.when(key % 5 == 0, "Nowhere").otherwise(F.concat(F.lit("Sét & "), F.col("c_nationkey").cast("string"))).alias("set_name"))
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id_product"), F.col("p_size").cast("long").alias("id_expansion"))
    slugs = table(spark, sf_dir, "nation").select(F.concat(F.lit("Set-"), F.col("n_nationkey").cast("string")).alias("set_slug"), (F.col("n_nationkey") + 1000).cast("long").alias("id_expansion"))
    return feedback.expansion_ids(rows, products, slugs).select("c_custkey", "id_expansion")


@query("""SELECT event_id::VARCHAR AS listing_id, CASE event_id % 3 WHEN 0 THEN 0.0 ELSE value END AS price, CASE event_id % 4 WHEN 0 THEN 'EUR' ELSE 'USD' END AS currency, event_type AS title FROM events""")
def q_stub_listing(spark, sf_dir):
    """Listings made of review rows, a missing price as 0 and a missing currency as EUR."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k.cast("string").alias("listing_id"), F.when(k % 3 > 0, F.col("value")).alias("price"), F.when(k % 4 > 0, "USD").alias("currency"), F.col("event_type").alias("title"))
    return feedback.stub_listings(rows).select("listing_id", "price", "currency", "title")


@query("""WITH i AS (SELECT s_suppkey::BIGINT AS id, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey + 100 END AS id_product, CASE s_suppkey % 2 WHEN 0 THEN s_nationkey END AS id_expansion, 'Set-' || s_nationkey AS set_slug FROM supplier)
SELECT id, 'product' AS kind FROM i WHERE id_product IS NOT NULL UNION ALL SELECT id, 'expansion' FROM i WHERE id_expansion IS NOT NULL UNION ALL SELECT id, 'slug' FROM (SELECT min(id) AS id FROM i WHERE set_slug IN ('Set-3', 'Set-7') AND id_expansion IS NOT NULL GROUP BY set_slug)""")
def q_row_selects(spark, sf_dir):
    """Rows with an id of a kind, and the first row of each key."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.cast("long").alias("id"), F.when(k % 3 == 0, k + 100).alias("id_product"), F.when(k % 2 == 0, F.col("s_nationkey")).alias("id_expansion"), F.concat(F.lit("Set-"), F.col("s_nationkey").cast("string")).alias("set_slug"))
    keys = spark.createDataFrame([("Set-3",), ("Set-7",), ("Set-none",)], "set_slug string")
    parts = [(state.filled(rows, "id_product"), "product"), (state.filled(rows, "id_expansion"), "expansion"), (state.first_of_key(state.filled(rows, "id_expansion"), keys, ["set_slug"], ["id"]), "slug")]
    out = spark.createDataFrame([], "id long, kind string")
    for part, kind in parts:
        out = out.unionByName(part.select("id", F.lit(kind).alias("kind")))
    return out
