"""Landed listings in three JSON shapes, and the item JSON inside a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _title(c: Column) -> Column:
    return F.coalesce(_text(F.trim(c)), F.lit("Unknown"))


def absolute(url: Column, base: Column, fallback: Column) -> Column:
    rooted = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(url, "^/+", ""))
    return F.when(url.startswith("http"), url).when(F.coalesce(url, F.lit("")) != "", rooted).otherwise(fallback)


def _get(raw: Column, *paths: str) -> Column:
    return F.coalesce(*[_text(F.get_json_object(raw, p)) for p in paths])


def _images(raw: Column, *names: str) -> Column:
    photos = F.from_json(F.get_json_object(raw, "$.photos"), "array<string>")  # items as JSON text
    source = (lambda p: F.coalesce(*[_text(F.get_json_object(p, f"$.{n}")) for n in names])) if names else (lambda p: p)
    return F.coalesce(F.filter(F.transform(photos, source), lambda u: u.startswith("http")), F.array().cast("array<string>"))


def _listing(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema("listing")]).where(F.coalesce("listing_id", F.lit("")) != "")


def from_api(rows: DataFrame, raw: str = "json", base: str = "base_url") -> DataFrame:
    """Search results: one JSON item a row. Ratings from 0 to 1 become 0 to 5; rows without an id are dropped."""
    j, at = F.col(raw), F.col(base)
    item_id = _get(j, "$.id")
    default = F.concat(F.regexp_replace(at, "/+$", ""), F.lit("/items/"), item_id)
    return _listing(
        rows, listing_id=item_id, title=_title(F.get_json_object(j, "$.title")), price=F.coalesce(F.get_json_object(j, "$.price").try_cast("double"), F.lit(0.0)),
        currency=F.coalesce(_get(j, "$.currency"), F.lit("EUR")), url=absolute(F.get_json_object(j, "$.url"), at, default), images=_images(j, "url", "full_size_url"),
        seller_name=F.get_json_object(j, "$.user.login"), seller_rating=F.get_json_object(j, "$.user.feedback_reputation").try_cast("double") * 5, description=F.get_json_object(j, "$.description"),
    )


def from_page_item(rows: DataFrame, raw: str = "json", item_id: str = "item_id", page_url: str = "page_url", base: str = "base_url") -> DataFrame:
    """The item of a page: a price may be a number or {amount, currency_code}, names and links have fallbacks."""
    j = F.col(raw)
    nested = lambda p: p.startswith("{")
    read = lambda p: F.struct(F.when(nested(p), F.get_json_object(p, "$.amount")).otherwise(p).try_cast("double").alias("amount"), F.when(nested(p), _text(F.get_json_object(p, "$.currency_code"))).alias("currency"))
    price = F.transform(F.array(_get(j, "$.price", "$.item_price")), read)[0]  # bound by an array of one, as in page_item
    currency = F.coalesce(price["currency"], _get(j, "$.currency"), F.lit("EUR"))
    return _listing(
        rows, listing_id=F.coalesce(_get(j, "$.id"), F.col(item_id)), title=_title(F.get_json_object(j, "$.title")), price=F.coalesce(price["amount"], F.lit(0.0)), currency=currency,
        url=absolute(_get(j, "$.url", "$.path"), F.col(base), F.col(page_url)), images=_images(j, "url", "full_size_url", "src"), seller_name=_get(j, "$.user.login", "$.user.username"),
        seller_rating=F.get_json_object(j, "$.user.feedback_reputation").try_cast("double") * 5, description=F.get_json_object(j, "$.description"),
    )


def from_third_party(rows: DataFrame, raw: str = "json") -> DataFrame:
    """Flat items: photos are links, ratings are taken as they are, and there is a condition."""
    j = F.col(raw)
    return _listing(
        rows, listing_id=_get(j, "$.id"), title=_title(F.get_json_object(j, "$.title")), price=F.coalesce(F.get_json_object(j, "$.price").try_cast("double"), F.lit(0.0)), currency=F.coalesce(_get(j, "$.currency"), F.lit("EUR")),
        url=F.coalesce(F.get_json_object(j, "$.url"), F.lit("")), images=_images(j), seller_name=F.get_json_object(j, "$.seller.username"), seller_rating=F.get_json_object(j, "$.seller.rating").try_cast("double"),
        description=F.get_json_object(j, "$.description"), condition=F.get_json_object(j, "$.condition"),
    )


#: Where a page's data holds its item, first match first.
ITEM_PATHS = [f"$.props.{level}.{key}" for level in ("pageProps", "pageProps.data") for key in ("item", "itemDto", "initialItem")]


def page_item(html: Column) -> Column:
    """The item's JSON out of a page's data script, or null."""
    data = F.regexp_extract(F.coalesce(html, F.lit("")), r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    first = lambda d: F.coalesce(*[_text(F.get_json_object(d, p)) for p in ITEM_PATHS])
    return F.transform(F.array(data), first)[0]  # bound by an array of one: the page is searched once, not for every path


def item_id(url: Column) -> Column:
    return _text(F.regexp_extract(F.coalesce(url, F.lit("")), r"/items/(\d+)", 1))


def cascade(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """For each wanted listing_id the row of the first source that has one."""
    out, left = None, wanted.select("listing_id").distinct()
    for source in sources:
        hit = source.join(left, "listing_id", "left_semi")
        out = hit if out is None else out.unionByName(hit, allowMissingColumns=True)
        left = left.join(source.select("listing_id"), "listing_id", "left_anti")
    return out


def base_urls(spark: SparkSession, wanted: list[str], domains: DataFrame, default: str) -> DataFrame:
    """(country, base_url) of known country codes; the default's where none is known."""
    asked = spark.createDataFrame([(i, c.upper()) for i, c in enumerate(wanted)], "pos int, country string")
    known = asked.join(domains, "country").orderBy("pos").select("country", "base_url")
    return known if known.take(1) else domains.where(F.col("country") == default).select("country", "base_url")


def union_of(*frames: DataFrame) -> DataFrame:
    """All rows of all domains; nothing is removed, missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def newest(rows: DataFrame, order: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(order), "listing_id").limit(limit)
