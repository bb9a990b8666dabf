"""From listings to verdicts: each step is DataFrame -> DataFrame, in the order that decides.

Rows keep ``channel``, ``verdict`` and ``reason``; a later step only sees what the
earlier ones left open. Steps that need Python run on the rows that native
filters let through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Live, Settings, with_live, with_overrides
from ..functions import money, urls
from ..functions import text as tx
from ..functions.identify import Lexicon, identified
from ..operators import catalogue, prefilter, resolver, state
from ..session import checkpointed

RESULT = "listing_id string, channel string, verdict string, reason string, source string, confidence double, product_id long, url string, from_price double, fee double, total_min double, total_max double, diff double, pct double, bid_price double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
#: Price a page must offer: a listing's page prices, keyed by URL.
PAGE_PRICE = "url string, from_price double, id_product long"


@dataclass
class Tables:
    """What a batch is decided by; all are DataFrames."""

    seen: DataFrame  # listing_id
    names: DataFrame  # name
    products: DataFrame  # as of catalogue.indexed
    prices: DataFrame
    codes: DataFrame  # code, slug
    set_names: DataFrame  # key, code, pos
    mappings: DataFrame
    rules: DataFrame
    overrides: DataFrame
    page_prices: DataFrame  # PAGE_PRICE: what landed pages say
    settings: DataFrame | None = None  # key, value: read anew with each batch, over the settings given
    site: urls.Site = field(default_factory=urls.Site)


def _result(df: DataFrame, **columns) -> DataFrame:
    kinds = dict(x.split() for x in RESULT.split(", "))
    return df.select(*[columns.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in _NAMES])


def prefiltered(listings: DataFrame, tables: Tables, settings: Settings) -> DataFrame:
    """Unseen listings with ``reason`` (null: go on to the names) and ``cheap_lot``; the first failing filter is the reason. Of rows that share an id the first counts (by ``seq`` where there is one)."""
    first = state.first_wins(listings, ["listing_id"], ["seq"] if "seq" in listings.columns else [c for c in ("title", "price", "url") if c in listings.columns])
    fresh = prefilter.unseen(first, tables.seen)
    if tables.settings is not None:
        fresh, settings = with_live(fresh, tables.settings, settings), Live()
    return fresh.withColumn("reason", prefilter.reason(settings)).withColumn("cheap_lot", F.coalesce((F.col("reason") == "lot_listing") & prefilter.is_cheap_lot(settings), F.lit(False))).drop("_settings")


def named_texts(listings: DataFrame, names: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(_title, _description) and their identity: the texts whose title holds a known name, each read once however many listings say the same."""
    texts = listings.where(F.col("listing_id").isNotNull()).select("title", F.col("description").cast("string").alias("description")).distinct()  # a column of nulls may have no type
    named = prefilter.with_known_name(texts, names).where("has_name").drop("has_name")
    named = named.repartition(2 * listings.sparkSession.sparkContext.defaultParallelism)  # reading takes long beside the size of the texts, by which Spark would deal them
    return with_identity(named, lexicon).withColumnsRenamed({"title": "_title", "description": "_description"})


def with_identity(listings: DataFrame, lexicon: Lexicon) -> DataFrame:
    df = listings.withColumn("fp", identified(F.col("title"), F.col("description"), lexicon)).select("*", "fp.*").drop("fp", "has_name")
    hashed = tx.fingerprint("card_name", "set_code", "collector_number")
    return df.withColumn("fingerprint", hashed).withColumn("tokens", tx.tokens("card_name", "set_name", "set_code", "collector_number", "rarity"))


def variant_pages(asked: DataFrame, page_prices: DataFrame) -> DataFrame:
    """(asked_url, url, from_price, product_id): the first variant of each asked URL whose page has a price; a URL that many rows ask for is tried once."""
    slug = urls.last_segment(F.col("url"))
    tried = asked.select("url").distinct().select(F.col("url").alias("asked_url"), slug.alias("_slug"), F.explode(urls.variants(slug)).alias("_v"))
    tried = tried.select("asked_url", F.replace("asked_url", F.concat(F.lit("/"), "_slug"), F.concat(F.lit("/"), F.col("_v.slug"))).alias("url"), F.col("_v.position").alias("_position"))
    found = tried.join(page_prices.where("from_price > 0"), "url")
    best = found.groupBy("asked_url").agg(F.min_by(F.struct("url", "from_price", F.col("id_product").alias("product_id")), "_position").alias("_b"))
    return best.select("asked_url", "_b.*")


def decided(listings: DataFrame, tables: Tables, lexicon: Lexicon, settings: Settings = Settings(), construct: bool = True) -> DataFrame:
    """One row (RESULT) for each unseen listing; without ``construct`` only the catalogue and stored mappings are asked."""
    return decided_with_identities(listings, tables, lexicon, settings, construct)[0]


def decided_with_identities(listings: DataFrame, tables: Tables, lexicon: Lexicon, settings: Settings = Settings(), construct: bool = True) -> tuple[DataFrame, DataFrame]:
    """The results, and the listings that passed the filters with their identity."""
    threshold = (with_overrides(settings, tables.settings) if tables.settings is not None else settings).fuzzy_threshold
    # each step's rows are checkpointed: several branches below read them, and plans stay short
    start = checkpointed(prefiltered(listings, tables, settings))
    dropped = start.where(F.col("reason").isNotNull())
    lots = _result(dropped.where("cheap_lot"), listing_id=F.col("listing_id"), channel=F.lit("deals"), verdict=F.lit("cheap_lot"), reason=F.col("reason"))
    skipped = _result(dropped.where("not cheap_lot"), listing_id=F.col("listing_id"), channel=F.lit("skipped"), verdict=F.lit("skipped"), reason=F.col("reason"))
    passed = start.where(F.col("reason").isNull())
    texts = checkpointed(named_texts(passed, tables.names, lexicon))
    same = (F.col("title") == F.col("_title")) & F.col("description").cast("string").eqNullSafe(F.col("_description")) & F.col("listing_id").isNotNull()
    known = checkpointed(passed.join(texts, same).drop("_title", "_description"))
    nameless = passed.join(texts, same, "left_anti")
    silent = _result(nameless, listing_id=F.col("listing_id"), channel=F.lit("none"), verdict=F.lit("dropped"), reason=F.lit("no_known_name"))
    bare = F.col("collector_number").isNull() & F.col("set_name").isNull() & F.col("set_code").isNull()
    review = _result(known.where(bare), listing_id=F.col("listing_id"), channel=F.lit("review"), verdict=F.lit("review"), reason=F.lit("unresolvable_no_identifiers"))
    open_ = known.where(~bare)
    # 1. the catalogue
    asked = open_.select(F.col("listing_id").alias("ask_id"), F.col("card_name").alias("name"), F.col("collector_number").alias("number"), "set_name", "set_code").where(F.coalesce("name", F.lit("")) != "")
    hit = catalogue.lookup(asked, tables.products, tables.codes, tables.prices)
    hit = checkpointed(hit.select(F.col("ask_id").alias("listing_id"), F.col("id_product").alias("product_id"), urls.catalogue_url(F.col("expansion_name"), F.col("name"), F.col("number"), tables.site).alias("url"), "from_price", F.lit("catalog").alias("source"), F.lit(0.90).alias("confidence")))
    # 2. stored mappings, 3. construction, on what is left
    rest = open_.join(hit.select("listing_id"), "listing_id", "left_anti")
    stored = checkpointed(resolver.best_mapping(rest, tables.mappings, threshold).select("listing_id", "url", F.lit("database").alias("source"), (F.col("score") / 100).alias("confidence")))
    left = rest.join(stored.select("listing_id"), "listing_id", "left_anti")
    full = F.lit(construct) & prefilter.may_construct(F.col("card_name"), F.col("set_name"), F.col("set_code"), F.col("collector_number"))
    built = checkpointed(resolver.constructed(left.where(full), tables.codes, tables.rules, tables.overrides, tables.set_names, tables.site).select("listing_id", "url", F.lit("constructed").alias("source"), "confidence"))
    found = stored.unionByName(built)
    missing = rest.join(found.select("listing_id"), "listing_id", "left_anti")
    unidentified = _result(missing, listing_id=F.col("listing_id"), channel=F.lit("unidentified"), verdict=F.lit("unidentified"), reason=F.lit("not_in_catalog_or_db"))
    paged = found.join(tables.page_prices.select("url", "from_price", F.col("id_product").alias("product_id")), "url", "left")
    no_page = paged.where(~(F.coalesce("from_price", F.lit(0.0)) > 0))
    unpaged = no_page.where("source = 'constructed'")
    other = checkpointed(unpaged.select("listing_id", "source", "confidence", F.col("url").alias("asked_url")).join(variant_pages(unpaged, tables.page_prices), "asked_url").drop("asked_url"))
    no_price = no_page.join(other.select("listing_id"), "listing_id", "left_anti")
    failed = _result(no_price, listing_id=F.col("listing_id"), channel=F.when(F.col("source") == "constructed", "review").otherwise("log"), verdict=F.lit("error"), reason=F.lit("from_price_missing"), source=F.col("source"), confidence=F.col("confidence"), url=F.col("url"))
    names = ["listing_id", "product_id", "url", "from_price", "source", "confidence"]
    priced = hit.select(names).unionByName(paged.where("from_price > 0").select(names)).unionByName(other.select(names)).join(known.select("listing_id", "price"), "listing_id")
    cmp, bid = money.compared(F.col("price"), F.col("from_price")), money.bid(F.col("price"), F.col("from_price"))
    priced = priced.withColumn("cmp", cmp).withColumn("bid", bid)
    good = F.col("cmp.is_profitable")
    compared = _result(
        priced, listing_id=F.col("listing_id"), channel=F.when(good, "deals").otherwise("match"), verdict=F.when(good, "profitable").otherwise("not_profitable"), source=F.col("source"), confidence=F.col("confidence"), product_id=F.col("product_id"),
        url=F.col("url"), from_price=F.col("from_price"), fee=F.col("cmp.fee"), total_min=F.col("cmp.total_min"), total_max=F.col("cmp.total_max"), diff=F.col("cmp.difference"), pct=F.col("cmp.percent"), bid_price=F.when(~good, F.col("bid.bid")),
    )
    out = lots
    for part in (skipped, silent, review, unidentified, failed, compared):
        out = out.unionByName(part)
    return out, known


def bulk_alerts(listings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Listings of bulk searches whose price a card is at most the threshold."""
    done = prefilter.analysed(listings)
    cheap = (F.col("estimated_card_count") > 0) & (F.col("price") / F.col("estimated_card_count") <= settings.cheap_price_per_card)
    return done.where(cheap).select("listing_id", "title", "price", "estimated_card_count", "price_per_card", F.lit("match").alias("channel"))


def counters(results: DataFrame) -> DataFrame:
    """One row: checked, profitable, reviewed."""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias
    return results.agg(F.count(F.lit(1)).alias("checked"), one(F.col("verdict") == "profitable")("profitable"), one(F.col("channel").isin("review", "unidentified"))("reviewed"))


def state_rows(results: DataFrame, identities: DataFrame) -> dict[str, DataFrame]:
    """What a batch adds to the state: seen_listings, review_queue, error_log, card_mappings, deal_messages.

    ``identities``: the listings with their identity, as of ``with_identity``.
    """
    now = F.current_timestamp()
    listed = identities.select("listing_id", "title", "price", "card_name", "collector_number", "set_code", "fingerprint", "tokens")
    full = results.join(listed, "listing_id", "left")
    queued = F.col("channel").isin("review", "unidentified", "skipped")
    return {
        "seen_listings": full.select("listing_id", "title", "price", "url", now.alias("first_seen")),
        "review_queue": full.where(queued).select("listing_id", "title", "price", F.lit("EUR").alias("currency"), "url", "reason", F.when(F.col("channel") == "skipped", "skipped").otherwise("pending").alias("status"), now.alias("created_at")),
        "error_log": full.where("verdict = 'error'").select("listing_id", F.col("reason").alias("failure_step"), F.col("reason").alias("error_message"), "price", F.lit("EUR").alias("currency"), now.alias("created_at")),
        "card_mappings": full.where("source in ('catalog', 'constructed') and from_price > 0").select("title", "fingerprint", "card_name", "collector_number", "set_code", "tokens", "url", F.col("confidence"), now.alias("date_added")),
        "deal_messages": full.where("verdict in ('profitable', 'not_profitable')").select("listing_id", F.col("channel").alias("channel_type"), "url", "price", now.alias("created_at")),
    }
