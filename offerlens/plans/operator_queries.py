"""Sources, catalogue, pages, identities and text similarity as queries, with rows that the SQL says by hand or computes by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy, urls
from ..functions import text as tx
from ..functions.identify import SCHEMA as IDENTITY
from ..functions.identify import Lexicon, identified
from ..operators import catalogue, reports, resolver
from ..sources import catalogue as snapshots
from ..sources import listings, product_pages
from .decision_queries import _of_kinds
from .registry import query, table

# --- landed listings ------------------------------------------------------------


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


@query("""SELECT 'p' || page_id AS listing_id, CASE page_id % 3 WHEN 0 THEN 'Unknown' ELSE 'Page ' || page_id END AS title, CASE page_id % 2 WHEN 0 THEN page_id / 4.0 ELSE page_id / 2.0 END::DOUBLE AS price, CASE page_id % 2 WHEN 0 THEN 'PLN' ELSE 'EUR' END AS currency,
  'https://m.example/items/' || page_id AS url, 'seller' || page_id % 5 AS seller_name, 2.5::DOUBLE AS seller_rating, CASE page_id % 4 WHEN 0 THEN 1 ELSE 0 END::INT AS n_images FROM pages WHERE page_id % 5 <> 0""")
def q_page_listing(spark, sf_dir):
    """The item in a page's data script, at any of its places; prices plain or nested, names with fallbacks."""
    k, key = F.col("page_id"), F.col("page_id").cast("string")
    price = F.when(k % 2 == 0, F.concat(F.lit('"price":{"amount":"'), (k / 4).cast("string"), F.lit('","currency_code":"PLN"}'))).otherwise(F.concat(F.lit('"item_price":'), (k / 2).cast("string")))
    title = F.when(k % 3 == 0, '"title":"  "').otherwise(F.concat(F.lit('"title":" Page '), key, F.lit('"')))
    seller = F.concat(F.when(k % 3 == 1, '"user":{"login":"').otherwise('"user":{"login":"","username":"'), F.lit("seller"), (k % 5).cast("string"), F.lit('","feedback_reputation":0.5}'))
    photos = F.when(k % 4 == 0, '"photos":[{"full_size_url":"http://i/1"},{"src":"x"}]').otherwise('"photos":[]')
    item = F.concat(F.lit('{"id":"p'), key, F.lit('",'), title, F.lit(","), price, F.lit(","), seller, F.lit(","), photos, F.lit(',"path":"/items/'), key, F.lit('"}'))
    holder = F.when(k % 5 == 1, F.concat(F.lit('"item":'), item)).when(k % 5 == 2, F.concat(F.lit('"itemDto":'), item)).when(k % 5 == 3, F.concat(F.lit('"initialItem":'), item)).when(k % 5 == 4, F.concat(F.lit('"data":{"item":'), item, F.lit("}"))).otherwise('"none":1')
    html = F.concat("html", F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{'), holder, F.lit("}}}</script>"))
    rows = table(spark, sf_dir, "pages").select("page_id", listings.page_item(html).alias("json"), F.lit(None).cast("string").alias("item_id"), F.lit("https://m.example/p").alias("page_url"), F.lit("https://m.example/").alias("base_url"))
    found = listings.from_page_item(rows.where(F.col("json").isNotNull()))
    return found.select("listing_id", "title", "price", "currency", "url", "seller_name", "seller_rating", F.size("images").alias("n_images"))


@query("""SELECT 's' || s_suppkey AS listing_id, s_name AS title, s_acctbal AS price, 'EUR' AS currency, 'http://t/' || s_suppkey AS url, s_nationkey::DOUBLE AS seller_rating, 'used' AS condition, 2::INT AS n_images FROM supplier
UNION ALL SELECT 'c' || c_custkey, c_name, c_acctbal, 'EUR', 'https://m.example/items/c' || c_custkey, 5.0, NULL, 0 FROM customer""")
def q_third_party(spark, sf_dir):
    """The third JSON shape (ratings as they are, a condition, photos as links) beside the first."""
    s, c = F.col("s_suppkey").cast("string"), F.col("c_custkey").cast("string")
    one = _json(id=F.concat(F.lit("s"), s), title=F.col("s_name"), price=F.col("s_acctbal"), url=F.concat(F.lit("http://t/"), s), seller=F.struct(F.lit("x").alias("username"), F.col("s_nationkey").alias("rating")), condition=F.lit("used"), photos=F.array(F.lit("http://a"), F.lit("ftp://b"), F.lit("https://c")))
    two = _json(id=F.concat(F.lit("c"), c), title=F.col("c_name"), price=F.col("c_acctbal"), user=F.struct(F.lit(1).alias("feedback_reputation")))
    a = listings.from_third_party(table(spark, sf_dir, "supplier").select(one.alias("json")))
    b = listings.from_api(table(spark, sf_dir, "customer").select(two.alias("json"), F.lit("https://m.example").alias("base_url")))
    return listings.union_of(a, b).select("listing_id", "title", "price", "currency", "url", "seller_rating", "condition", F.size("images").alias("n_images"))


@query("""SELECT c_custkey::VARCHAR AS listing_id, CASE WHEN c_custkey % 2 = 0 THEN 'api' WHEN c_custkey % 3 = 0 THEN 'page' ELSE 'third' END AS source FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0""")
def q_listing_cascade(spark, sf_dir):
    """Listings asked for by URL, each from the first source that has it."""
    asked = table(spark, sf_dir, "customer").select(listings.item_id(F.concat(F.lit("https://m.example/items/"), F.col("c_custkey").cast("string"), F.lit("-a-card?x=1"))).alias("listing_id"))
    having = lambda n, name: asked.where(F.col("listing_id").cast("long") % n == 0).select("listing_id", F.lit(name).alias("source"))
    return listings.cascade(asked, having(2, "api"), having(3, "page"), having(5, "third"))


@query("""SELECT o_orderkey::VARCHAR AS listing_id, o_orderdate AS landed, 'https://' || c AS base_url FROM orders CROSS JOIN (VALUES ('m.fr'), ('m.de')) t(c) QUALIFY row_number() OVER (PARTITION BY c ORDER BY o_orderdate DESC, o_orderkey::VARCHAR) <= 30
UNION ALL SELECT 'default', NULL, 'https://m.nl'""")
def q_newest_by_domain(spark, sf_dir):
    """The newest listings of each known domain; without a known one, the default."""
    domains = spark.createDataFrame([("FR", "https://m.fr"), ("DE", "https://m.de"), ("NL", "https://m.nl")], "country string, base_url string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("listing_id"), F.col("o_orderdate").alias("landed"))
    out = None
    for site in listings.base_urls(spark, ["fr", "xx", "De"], domains, "NL").collect():  # the domains asked for
        newest = listings.newest(rows, "landed", 30).withColumn("base_url", F.lit(site["base_url"]))
        out = newest if out is None else listings.union_of(out, newest)
    fallback = listings.base_urls(spark, ["xx"], domains, "NL").select(F.lit("default").alias("listing_id"), F.lit(None).cast("timestamp").alias("landed"), "base_url")
    return listings.union_of(out, fallback)


# --- the catalogue -----------------------------------------------------------------


@query("""WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part)
SELECT pos::BIGINT AS pos, p_partkey AS id_product, 'n' || p_partkey AS name, p_partkey % 90 || '/90' AS number, p_brand AS expansion_name, p_partkey % 7 AS id_expansion FROM p WHERE p_partkey % 11 <> 0""")
def q_catalogue_load(spark, sf_dir):
    """Product snapshots, wrapped under a known key, under any key or bare; rows without a numeric id go, places stay."""
    k = F.col("p_partkey")
    entry = F.struct(k.alias("_k"), _json(idProduct=F.when(k % 11 == 0, F.lit("none")).otherwise(k.cast("string")), name=F.concat(F.lit("n"), k.cast("string")), number=F.concat((k % 90).cast("string"), F.lit("/90")), expansionName=F.col("p_brand"), idExpansion=k % 7).alias("j"))
    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["j"]), ","), F.lit("]")).alias("l"))  # a snapshot a brand
    shape = F.crc32("p_brand") % 3
    raw = lists.select(F.when(shape == 0, F.concat(F.lit('{"version":6,"productList":'), F.col("l"), F.lit("}"))).when(shape == 1, F.concat(F.lit('{"version":"6","data":'), F.col("l"), F.lit("}"))).otherwise(F.col("l")).alias("value"))
    return snapshots.products(raw).select("pos", "id_product", "name", "number", "expansion_name", "id_expansion")


@query("""SELECT p_size::BIGINT AS id_product, arg_max(p_retailprice, p_partkey) AS low, arg_max(p_retailprice + 1, p_partkey) AS trend, CASE WHEN arg_max(p_retailprice, p_partkey) > 1000 THEN arg_max(p_retailprice, p_partkey) END AS from_price FROM part GROUP BY p_size""")
def q_price_guide(spark, sf_dir):
    """Keys in upper or lower case, the last row of an id, and only positive prices count."""
    k = F.col("p_partkey")
    upper = _json(idProduct=F.col("p_size"), LOW=F.col("p_retailprice"), TREND=F.col("p_retailprice") + 1)
    lower = _json(idProduct=F.col("p_size"), low=F.col("p_retailprice"), trend=F.col("p_retailprice") + 1)
    rows = table(spark, sf_dir, "part").select(F.struct(k.alias("_k"), F.when(k % 2 == 0, upper).otherwise(lower).alias("j")).alias("e"))
    raw = rows.agg(F.concat(F.lit('{"priceGuide":['), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["j"]), ","), F.lit("]}")).alias("value"))  # one snapshot
    return snapshots.prices(raw).select("id_product", "low", "trend", tx.positive(F.when(F.col("low") > 1000, F.col("low").cast("string")).otherwise("-3")).alias("from_price"))


@query("""SELECT p_size::BIGINT AS id_product, max(p_partkey) AS pos, arg_max(lower(replace(p_brand, '#', '')), p_partkey) AS expansion_key, p_size::VARCHAR AS number_key, (SELECT count(DISTINCT p_size) FROM part)::BIGINT AS products, (SELECT count(DISTINCT p_brand) FROM part)::BIGINT AS expansions FROM part GROUP BY p_size""")
def q_catalogue_index(spark, sf_dir):
    """The last product of an id with its search keys, and the catalogue's size."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("long").alias("id_product"), F.col("p_name").alias("name"), F.concat(F.lit("0"), F.col("p_size").cast("string"), F.lit("/50")).alias("number"), F.col("p_brand").alias("expansion_name"), F.xxhash64("p_brand").alias("id_expansion"))
    sizes = catalogue.counts(rows)
    return catalogue.indexed(rows).crossJoin(F.broadcast(sizes)).select("id_product", "pos", "expansion_key", "number_key", "products", "expansions")  # one row


@query("""WITH f AS (SELECT 'n' || n_nationkey AS path, TIMESTAMP '2024-01-01' + (n_nationkey * 7 % 25) * INTERVAL 1 HOUR AS modified, n_nationkey % 4 = 1 AS good FROM nation), n AS (SELECT max(modified) AS now FROM f)
SELECT path, coalesce(path = (SELECT arg_max(path, modified) FROM f WHERE good), false) AS in_use, now - modified < INTERVAL 12 HOUR AS fresh FROM f, n""")
def q_snapshots(spark, sf_dir):
    """Of all landed snapshots the newest that holds an entry, though newer ones are broken, empty or not JSON; and which are within the limit of age."""
    k = F.col("n_nationkey")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (k * 7 % 25) * 3600)
    body = F.when(k % 4 == 0, '{"productList":[]}').when(k % 4 == 1, F.concat(F.lit('{"productList":[{"idProduct":'), k.cast("string"), F.lit("}]}"))).when(k % 4 == 2, '{"productList":[{"id').otherwise("<html>down</html>")
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("path"), at.alias("modified"), body.alias("value"))
    now = files.agg(F.max("modified").alias("now"))
    used = snapshots.newest_valid(files, snapshots.PRODUCT_KEYS).select("path", F.lit(True).alias("in_use"))
    out = files.join(used, "path", "left").crossJoin(F.broadcast(now))  # one row
    return out.select("path", F.coalesce("in_use", F.lit(False)).alias("in_use"), snapshots.fresh(F.col("modified"), F.col("now"), 12.0).alias("fresh"))


@query("""SELECT c_custkey AS ask_id, p_partkey AS id_product, p_name AS name, p_retailprice AS from_price FROM customer JOIN part ON p_partkey = c_custkey * 2 WHERE p_partkey % 3 > 0""")
def q_product_by_id(spark, sf_dir):
    """Products and prices by id; a price of 0 is none."""
    parts = table(spark, sf_dir, "part")
    products = parts.select(F.col("p_partkey").alias("id_product"), F.col("p_name").alias("name"))
    prices = parts.select(F.col("p_partkey").alias("id_product"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")).otherwise(0.0).alias("low"), *[F.lit(None).cast("double").alias(c) for c in ("trend", "avg30", "avg7", "avg1")])
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ask_id"), (F.col("c_custkey") * 2).alias("id_product"))
    return catalogue.priced(catalogue.by_id(asked, products), prices).select("ask_id", "id_product", "name", "from_price")


@query("""WITH a AS (SELECT s_suppkey AS ask_id, s_suppkey % 50 + 1 AS k, s_nationkey % 5 + 1 AS n FROM supplier), p AS (SELECT *, lower(replace(p_brand, '#', ' ')) AS e FROM part),
c AS (SELECT a.ask_id, p.*, contains(p.e, 'brand ' || n) OR contains('brand ' || n, p.e) AS fits FROM a JOIN p ON p.p_size = a.k), f AS (SELECT *, bool_or(fits) OVER (PARTITION BY ask_id) AS any_fits FROM c),
b AS (SELECT * FROM f WHERE fits OR NOT any_fits QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY p_partkey) = 1)
SELECT ask_id, p_partkey AS id_product, p_retailprice AS from_price, 'https://www.market.example/en/Pokemon/Products/Singles/' || replace(p_brand, '#', '-') || '/Card-e-0' || p_size AS url FROM b WHERE p_partkey % 4 > 0""")
def q_lookup_by_code(spark, sf_dir):
    """The expansion by a code's slug; the best product is chosen before its price, and its page keeps leading zeros."""
    parts = table(spark, sf_dir, "part")
    rows = parts.select(F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("id_product"), F.lit("Card-e").alias("name"), F.concat(F.lit("0"), F.col("p_size").cast("string")).alias("number"), F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("expansion_name"), F.lit(None).cast("long").alias("id_expansion"))
    prices = parts.select(F.col("p_partkey").alias("id_product"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice")).alias("low"), *[F.lit(None).cast("double").alias(c) for c in ("trend", "avg30", "avg7", "avg1")])
    number = F.concat((F.col("s_suppkey") % 50 + 1).cast("string"), F.lit("/50"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ask_id"), F.lit("card-e").alias("name"), number.alias("number"), F.lit(None).cast("string").alias("set_name"), F.concat(F.lit("x"), F.col("s_nationkey").cast("string")).alias("set_code"))
    codes = table(spark, sf_dir, "nation").select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("code"), F.concat(F.lit("Brand-"), (F.col("n_nationkey") % 5 + 1).cast("string")).alias("slug"))
    found = catalogue.lookup(asked, catalogue.indexed(rows), codes, prices)
    return found.select("ask_id", "id_product", "from_price", urls.catalogue_url(F.col("expansion_name"), F.col("name"), F.col("number")).alias("url"))


# --- product pages ------------------------------------------------------------------


def _euro(cents):
    return F.concat(F.translate(F.format_number(cents / 100, 2), ",.", ".,"), F.lit(" €"))


def _labels(pairs) -> list:
    out = [F.lit('<dl class="labeled">')]
    for label, value in pairs:
        out += [F.lit(f"<dt>{label}</dt><dd><span>x</span><span>"), value, F.lit("</span></dd>")]
    return [*out, F.lit("</dl>")]


@query("""WITH p AS (SELECT page_id, page_id % 5 AS k, (page_id % 500000 + 100)::DOUBLE AS c FROM pages)
SELECT page_id, CASE WHEN k < 2 THEN c / 100 WHEN k = 3 THEN c / 4 END AS lowest_price, CASE WHEN k < 3 THEN (c + 1) / 100 WHEN k = 3 THEN (c + 1) / 4 END AS price_trend, CASE WHEN k < 2 THEN (c + 2) / 100 WHEN k = 3 THEN (c + 2) / 4 END AS avg_30_days,
  CASE WHEN k < 2 THEN (c + 3) / 100 END AS avg_7_days, CASE WHEN k < 2 THEN (c + 4) / 100 END AS avg_1_day, CASE WHEN k < 4 THEN 'Card ' || page_id END AS card_name, CASE WHEN k IN (0, 3) THEN 'Set ' || page_id % 9 END AS set_name,
  CASE WHEN k < 4 THEN page_id % 900 + 1 || '/950' END AS card_number, CASE WHEN k < 4 THEN page_id + 1000 END::BIGINT AS id_product, CASE k WHEN 3 THEN 'script' WHEN 4 THEN 'none' ELSE 'list' END AS kind FROM p""")
def q_product_page(spark, sf_dir):
    """Price lists in two languages, a first label that is 0, JSON in scripts, pages without prices; name, set, number and id."""
    k, c = F.col("page_id") % 5, (F.col("page_id") % 500_000 + 100).cast("double")
    one = _labels([("From", _euro(c)), ("Price Trend", _euro(c + 1)), ("30-days average price", _euro(c + 2)), ("7-days average price", _euro(c + 3)), ("1-day average price", _euro(c + 4))])
    two = _labels([("Vanaf", _euro(c)), ("Tendance", _euro(c + 1)), ("gemiddelde 30 dagen", _euro(c + 2)), ("7 dagen", _euro(c + 3)), ("1 dag", _euro(c + 4))])
    zero = _labels([("From", F.lit("N/A")), ("Lowest price", _euro(c)), ("Trend", _euro(c + 1))])
    script = [F.lit("<script>var a = {'lowPrice': 1}; var b = "), _json(lowPrice=c / 4, trendPrice=((c + 1) / 4).cast("string"), avg30=(c + 2) / 4, other=F.lit("some text")), F.lit("</script>")]
    crumbs = F.when(k % 3 == 0, F.concat(F.lit('<ol class="breadcrumb"><li><a>Products</a></li><li><a>Set '), (F.col("page_id") % 9).cast("string"), F.lit("</a></li><li><a>x</a></li></ol>"))).otherwise('<ol class="breadcrumb"><li><a>Singles</a></li><li><a>x</a></li></ol>')
    prices = F.when(k == 0, F.concat(*one)).when(k == 1, F.concat(*two)).when(k == 2, F.concat(*zero)).when(k == 3, F.concat(*script)).otherwise("")
    key = F.col("page_id").cast("string")
    body = F.concat(F.lit("<h1> Card "), key, F.lit(" </h1>"), crumbs, F.lit("<p>"), (F.col("page_id") % 900 + 1).cast("string"), F.lit('/950</p><a href="/x?a=1&amp;idProduct='), (F.col("page_id") + 1000).cast("string"), F.lit('">i</a>'), prices)
    kind = F.when(k == 3, "script").when(k == 4, "none").otherwise("list")
    return table(spark, sf_dir, "pages").select("page_id", product_pages.product_page_of(body).alias("p"), kind.alias("kind")).select("page_id", "p.*", "kind")


@query("""WITH p AS (SELECT page_id, page_id % 6 AS k, (page_id % 90000 + 100)::DOUBLE AS c FROM pages)
SELECT page_id, CASE WHEN k < 4 THEN c / 100 END AS first_offer, CASE k WHEN 0 THEN (c + 1) / 100 WHEN 1 THEN (c + 1) / 100 WHEN 2 THEN (c + 2) / 100 END AS graded_offer, CASE k WHEN 4 THEN 10 WHEN 5 THEN 10 ELSE 10 END::INT AS grade,
  CASE WHEN page_id % 2 = 0 THEN coalesce(CASE WHEN k < 4 THEN c / 100 END, 7.0) ELSE 3.0 END AS from_price, CASE WHEN page_id % 2 = 0 THEN k < 4 ELSE true END AS domestic FROM p""")
def q_offer_rows(spark, sf_dir):
    """The first offer's price, the first mint offer of a grade, and the price that a page goes by."""
    k, c = F.col("page_id") % 6, (F.col("page_id") % 90_000 + 100).cast("double")
    row = lambda mark, grade, price, cls="article-row", box="price-container": F.concat(F.lit(f'<div class="{cls}"><div>{mark} {grade}</div><div class="{box}"><span>'), price, F.lit("</span></div></div>"))
    mint, plain = '<span title="Mint">M</span>', "<span>NM</span>"
    body = (
        F.when(k == 0, F.concat(row(plain, "PSA 10", _euro(c)), row("<span>MT</span>", "PSA 10", _euro(c + 1))))
        .when(k == 1, F.concat(row(mint, "PSA 9", _euro(c)), row('<i class="badge condition-mt"></i>', "PSA10", _euro(c + 1)), row(mint, "PSA 10", _euro(c + 2))))
        .when(k == 2, F.concat(row(mint, "PSA 9", _euro(c), "x-article-row-y"), row(mint, "PSA 10", F.lit("0,00 €"), "x-article-row-y"), row(mint, "psa 10", _euro(c + 2), "x-article-row-y", "none")))
        .when(k == 3, row(mint, "BGS 10", _euro(c), box="col-price"))
        .when(k == 4, F.concat(row(mint, "", F.lit("0,00 €")), row(mint, "PSA 8", _euro(c))))
        .otherwise("<p>nothing</p>")
    )
    reverse = F.col("page_id") % 2 == 0
    df = table(spark, sf_dir, "pages").select("page_id", product_pages.offers_of(body).alias("o"), tx.grade_of(F.lit("a card, PSA10 slab")).alias("grade"), tx.has_word(F.lit("slab by psa"), "psa").alias("said"))
    df = df.withColumn("first_offer", product_pages.first_offer_price(F.col("o"))).withColumn("choice", product_pages.chosen_price(reverse, F.col("first_offer"), F.when(~reverse, 3.0), F.lit(7.0), F.lit(8.0)))
    return df.where("said").select("page_id", "first_offer", product_pages.graded_offer_price(F.col("o"), F.lit(10)).alias("graded_offer"), "grade", F.col("choice.from_price").alias("from_price"), F.col("choice.domestic").alias("domestic"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/en/X/Products/Singles/Set-' || page_id || '/Card-1?a=b' WHEN 1 THEN 'https://m.example/en/X/Products/Singles/S/Card-' || page_id END AS link,
  page_id % 3 = 0 AS reverse, CASE page_id % 4 WHEN 1 THEN 'S' WHEN 0 THEN 'Set-' || page_id END AS set_slug FROM pages""")
def q_product_link(spark, sf_dir):
    """The first link to a product on a result page, past links to sets; its set, and whether a URL asks for reverse holos."""
    k, key = F.col("page_id") % 4, F.col("page_id").cast("string")
    links = F.when(k == 0, F.concat(F.lit('<a href="/en/X/Products/Singles/Set">s</a><a href="/en/X/Products/Singles/Set-'), key, F.lit('/Card-1?a=b">c</a><a href="/en/X/Products/Singles/S/Other">o</a>')))
    links = links.when(k == 1, F.concat(F.lit('<a href="https://m.example/en/X/Products/Singles/S/Card-'), key, F.lit('">c</a>'))).when(k == 2, '<a href="/en/X/Products/Boosters/Set/Card">b</a>').otherwise("")
    link = product_pages.first_product_link(F.concat("html", links))
    url = F.concat(F.lit("https://m.example/p?x=1&isReverseHolo="), F.when(F.col("page_id") % 3 == 0, "y").otherwise("N"))
    return table(spark, sf_dir, "pages").select("page_id", link.alias("link"), urls.is_reverse(url).alias("reverse"), urls.after_singles(link)["set_slug"].alias("set_slug"))


# --- identities ----------------------------------------------------------------------

SETS = ("VSTAR Universe", "Obsidian Flames", "Neo Discovery", "Journey Together", "Paradox Rift", "POP Series 3", "Silver Tempest", "Fossil", "Base Set 2", "Ruby & Sapphire", "Crown Zenith")
READ = Lexicon(
    names=("Almond", "Antique", "Bisque", "Chansey", "Ho-Oh", "Hypno"), trainers=("Some Trainer's Help",),
    set_names={"S12a": "VSTAR Universe", "OBF": "Obsidian Flames", "NDI": "Neo Discovery", "MEP": "Promo Stars", "JTG": "Journey Together", "SR": "Some Set"}, known_sets={n.lower(): n for n in SETS},
)
TITLES = [
    ("Carte Pokemon Almond V SAR 118/172 - S12a VSTAR Universe", None), ("Pokemon Bisque ex 016/197 Obsidian Flames", None), ("Pokemon Antique ex 25/197 OBF Obsidian Flames IT", None), ("Hypno TG15/TG30 Silver Tempest", None),
    ("Almond GG05/GG70", None), ("Nobody ex 001/100 OBF Obsidian Flames", None), ("Pokémon Almond (OBF 65/197) deutsch", None), ("Obsidian flames 40/217 bisque ball&normal", None),
    ("Carta Pokemon - Almond - NDI 9", None), ("Pokemon Card Game- Paradox Rift- Bisque 190 English", None), ("Antique Gx d’alola 71/64", None), ("Pokemon Promo MEP 80 Bisque", None),
    ("Pokémon Card – Almond 168 (JTG", None), ("Ho-Oh Ex Pop Serie 3 originale 7/17 Good ITA", None), ("Leveinard 113/165 PSA 9.5", None), ("Hypno Holo 1st Edition - Fossil (8/62)", "played"),
    ("Antique #46 Pokemon Base Set 2", "near mint"), ("Some Trainer's Help 189/198", None), ("Hypno 3/109 Ruby & Sapphire stamped", None), ("Almond reverse holo 12", "état NM"),
    ("Dark Bisque LP français", None), ("nothing to see", None), ("", None), ("magic the gathering BGS 10 Hypno Secret Rare mint", None),
]


@query("""WITH k(k, card_name, collector_number, set_code, set_name, language, rarity, condition, condition_code, grade_authority, grade_value, marks) AS (VALUES
  (0, 'Almond V', '118/172', 'S12a', 'VSTAR Universe', NULL, 'SAR', NULL, NULL, NULL, NULL, ''), (1, 'Bisque ex', '016/197', NULL, 'Obsidian Flames', NULL, NULL, NULL, NULL, NULL, NULL, ''),
  (2, 'Antique ex', '25/197', 'OBF', 'Obsidian Flames IT', 'Italian', NULL, NULL, NULL, NULL, NULL, ''), (3, 'Hypno', 'TG15/TG30', NULL, 'Silver Tempest', NULL, NULL, NULL, NULL, NULL, NULL, ''),
  (4, 'Almond', 'GG05/GG70', 'CRZ', 'Crown Zenith', NULL, NULL, NULL, NULL, NULL, NULL, ''), (5, NULL, '001/100', 'OBF', 'Obsidian Flames', NULL, NULL, NULL, NULL, NULL, NULL, ''),
  (6, 'Almond', '65/197', 'OBF', 'Obsidian Flames', 'German', NULL, NULL, NULL, NULL, NULL, ''), (7, 'Bisque', '40/217', NULL, 'Obsidian Flames', NULL, NULL, NULL, NULL, NULL, NULL, ''),
  (8, 'Almond', '9', 'NDI', 'Neo Discovery', NULL, NULL, NULL, NULL, NULL, NULL, ''), (9, 'Bisque', '190', NULL, 'Paradox Rift', 'English', NULL, NULL, NULL, NULL, NULL, ''),
  (10, 'Alolan Antique GX', '71/64', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, ''), (11, 'Bisque', '80', 'MEP', 'Promo Stars', NULL, NULL, NULL, NULL, NULL, NULL, 'promo'),
  (12, 'Almond', '168', 'JTG', 'Journey Together', NULL, NULL, NULL, NULL, NULL, NULL, ''), (13, 'Ho-Oh Ex', '7/17', NULL, 'POP Series 3', 'Italian', NULL, 'Good', 4, NULL, NULL, ''),
  (14, 'Chansey', '113/165', NULL, NULL, NULL, NULL, NULL, NULL, 'PSA', '9.5', ''), (15, 'Hypno', '8/62', NULL, 'Fossil', NULL, 'Holo', 'Played', 6, NULL, NULL, 'holo first'),
  (16, 'Antique', '46', NULL, 'Base Set 2', NULL, NULL, 'Near Mint', 2, NULL, NULL, ''), (17, 'Some Trainer''s Help', '189/198', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, ''),
  (18, 'Hypno', '3/109', NULL, 'Ruby & Sapphire', NULL, 'Reverse Holo', NULL, NULL, NULL, NULL, 'holo reverse'), (19, 'Almond', '12', NULL, NULL, NULL, 'Reverse Holo', 'Near Mint', 2, NULL, NULL, 'holo reverse'),
  (20, 'Dark Bisque', NULL, NULL, NULL, 'French', NULL, 'Light Played', 5, NULL, NULL, ''), (21, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, ''), (22, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, ''),
  (23, NULL, NULL, NULL, NULL, NULL, 'Rare', 'Mint', 1, 'BGS', '10', 'magic'))
SELECT p_partkey, card_name, card_name IS NOT NULL AS card_name_matched, collector_number, set_code, set_name, language, rarity, condition, condition_code::INT AS condition_code, grade_authority, grade_value, contains(marks, 'promo') AS is_promo, contains(marks, 'holo') AS is_holo,
  contains(marks, 'reverse') AS is_reverse_holo, contains(marks, 'first') AS is_first_edition, CASE WHEN marks = 'magic' THEN 'Magic: The Gathering' ELSE 'Pokemon' END AS game, NULL::VARCHAR AS identify_error FROM part JOIN k ON p_partkey % 24 = k""")
def q_identify(spark, sf_dir):
    """A title for each branch of the reader, with all attributes; behind a grade nothing is taken for a name."""
    rows = _of_kinds(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", TITLES)
    return rows.select("p_partkey", identified(F.col("title"), F.col("description"), READ).alias("fp")).select("p_partkey", *[f"fp.{x.split()[0]}" for x in IDENTITY.split(", ")])


@query("""SELECT p_partkey, '{"card_name":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"' || p_name || '"' END || ',"collector_number":"' || p_size || '","is_promo":' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS json FROM part""")
def q_identity_json(spark, sf_dir):
    """Identities as JSON, nulls included."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("card_name"), F.col("p_size").cast("string").alias("collector_number"), (F.col("p_partkey") % 2 == 0).alias("is_promo"))
    return rows.select("p_partkey", tx.identity_json("card_name", "collector_number", "is_promo").alias("json"))


@query("""WITH l AS (SELECT n_nationkey AS k, n_name || ': ' || n_regionkey AS line FROM nation), r AS (SELECT list(line ORDER BY k) AS x FROM l),
g AS (SELECT list_reduce(list_prepend([''], list_transform(x, lambda e: [e])), lambda a, e: CASE WHEN length(a[-1]) = 0 THEN list_concat(a[1:-2], e) WHEN length(a[-1]) + 1 + length(e[1]) <= 60 THEN list_concat(a[1:-2], [a[-1] || chr(10) || e[1]]) ELSE list_concat(a, e) END) AS pages FROM r)
SELECT (unnest(generate_series(1, len(pages))) - 1)::INT AS page, unnest(pages) AS text FROM g""")
def q_line_pages(spark, sf_dir):
    """P10: lines packed into pages of at most 60 characters, in order."""
    lines = table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(": ", "n_name", F.col("n_regionkey").cast("string")).alias("line"))
    return reports.pages_of_lines(lines, ["n_nationkey"], "line", 60)


# --- similarity ----------------------------------------------------------------------

def _lcs_sql(a: str, b: str) -> str:
    """The length of the longest common subsequence of two strings, row by row of the usual table."""
    first = f"list_transform(range(length({b}) + 1), lambda z: 0)"
    step = f"list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, j: list_append(acc, CASE WHEN substr({a}, i[1], 1) = substr({b}, j[1], 1) THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], acc[-1]) END))"
    return f"list_reduce(list_prepend({first}, list_transform(range(1, length({a}) + 1), lambda y: [y])), lambda prev, i: {step})[-1]"


def _ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {_lcs_sql(a, b)} / (length({a}) + length({b})) END"


_SORTED = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda w: w <> '')), ' ')"


@query(f"""WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b, {_SORTED.format("lower(p_name)")} AS sa, {_SORTED.format("lower(p_type)")} AS sb FROM part)
SELECT p_partkey, round({_ratio_sql("a", "b")}, 9) AS ratio, round({_ratio_sql("sa", "sb")}, 9) AS sorted_ratio FROM p""")
def q_similarity(spark, sf_dir):
    """Ratios of names and types against the table of longest common subsequences."""
    a, b = F.lower("p_name"), F.lower("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(fuzzy.ratio_of(a, b), 9).alias("ratio"), F.round(fuzzy.token_sort_ratio_of(a, b), 9).alias("sorted_ratio"))


def _named(df: DataFrame, key: str, name, title) -> DataFrame:
    none = F.lit(None).cast("string")
    number, code = (F.col(key) % 7).cast("string"), F.when(F.col(key) % 3 > 0, F.concat(F.lit("C"), (F.col(key) % 3).cast("string")))
    df = df.select(F.col(key).alias("k"), title.alias("title"), name.alias("card_name"), F.when(F.col(key) % 7 > 0, number).alias("collector_number"), code.alias("set_code"))
    return df.withColumn("fingerprint", F.when(F.col("k") % 2 == 0, tx.fingerprint("card_name", "set_code", "collector_number"))).withColumn("tokens", tx.tokens("card_name", none, "set_code", "collector_number", none))


_SCORED = f"""
n AS (SELECT n_nationkey::BIGINT AS id, n_nationkey AS k, n_name AS card_name, 'card ' || n_name || ' near mint' AS title FROM nation),
s AS (SELECT s_suppkey AS k, n_name AS card_name, n_name || ' card ' || s_suppkey % 4 AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT *, CASE WHEN k % 7 > 0 THEN (k % 7)::VARCHAR END AS num, CASE WHEN k % 3 > 0 THEN 'C' || k % 3 END AS code, {_SORTED.format("lower(title)")} AS st, list_filter(string_split(lower(card_name), ' '), lambda w: w <> '') AS words FROM s),
y AS (SELECT *, CASE WHEN k % 7 > 0 THEN (k % 7)::VARCHAR END AS num, CASE WHEN k % 3 > 0 THEN 'C' || k % 3 END AS code, {_SORTED.format("lower(title)")} AS st, list_filter(string_split(lower(card_name), ' '), lambda w: w <> '') AS words FROM n),
tx AS (SELECT *, list_concat(words, CASE WHEN code IS NULL THEN [] ELSE [lower(code)] END, CASE WHEN num IS NULL THEN [] ELSE [num] END) AS tok FROM x), ty AS (SELECT *, list_concat(words, CASE WHEN code IS NULL THEN [] ELSE [lower(code)] END, CASE WHEN num IS NULL THEN [] ELSE [num] END) AS tok FROM y),
parts AS (SELECT tx.k, ty.id, tx.k % 2 = 0 AND ty.k % 2 = 0 AND lower(tx.card_name) = lower(ty.card_name) AND coalesce(tx.code, '') = coalesce(ty.code, '') AND coalesce(tx.num, '') = coalesce(ty.num, '') AS same,
  list_filter([{_ratio_sql("tx.st", "ty.st")}, {_ratio_sql("lower(ty.card_name)", "lower(tx.card_name)")} * 0.8, CASE WHEN tx.num IS NOT NULL AND ty.num IS NOT NULL THEN CASE WHEN tx.num = ty.num THEN 100.0 ELSE 0.0 END END,
    CASE WHEN tx.code IS NOT NULL AND ty.code IS NOT NULL THEN CASE WHEN tx.code = ty.code THEN 100.0 ELSE 0.0 END END, len(list_intersect(tx.tok, ty.tok)) / greatest(len(tx.tok), len(ty.tok))::DOUBLE * 100], lambda v: v IS NOT NULL) AS v FROM tx CROSS JOIN ty),
scored AS (SELECT k, id, CASE WHEN same THEN 100.0 ELSE (list_sum(v) + v[1] * 0.5) / (len(v) + 0.5) END AS score FROM parts)"""


@query(f"""WITH {_SCORED} SELECT k, id AS mapping_id, round(score, 9) AS score FROM scored WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, id % 4 DESC, id) = 1""")
def q_best_mapping(spark, sf_dir):
    """The best of all stored mappings for each title; the SQL scores every pair, the operator those that blocking leaves."""
    nation = table(spark, sf_dir, "nation")
    stored = _named(nation, "n_nationkey", F.col("n_name"), F.concat(F.lit("card "), F.col("n_name"), F.lit(" near mint")))
    stored = stored.withColumn("id", F.col("k").cast("long")).withColumn("url", F.lit("u")).withColumn("product_name", F.col("card_name")).withColumn("confidence", (F.col("k") % 4).cast("double")).withColumn("date_added", F.lit("2020-01-01").cast("timestamp"))
    asked = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    asked = _named(asked, "s_suppkey", F.col("n_name"), F.concat(F.col("n_name"), F.lit(" card "), (F.col("s_suppkey") % 4).cast("string"))).withColumn("listing_id", F.col("k").cast("string"))
    return resolver.best_mapping(asked, stored).select(F.col("listing_id").cast("long").alias("k"), "mapping_id", F.round("score", 9).alias("score"))
