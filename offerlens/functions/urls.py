"""Product URLs of a marketplace: parts, filters, construction, variants and learned prefixes.

``Site`` names the marketplace; queries on URLs of other hosts leave them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bare_number, digits, hyphened, set_slug

# Language codes of URL filters, the filters that every URL gets, the part of the path before set and product.
LANGUAGE_CODES = {"English": "1", "Dutch": "11", "French": "2", "German": "3", "Spanish": "4", "Italian": "5", "Japanese": "7", "Korean": "8", "Russian": "9", "Portuguese": "10"}
DEFAULT_FILTERS = (("sellerCountry", "23"), ("language", "1"))
PRODUCT_PATH = "/en/Pokemon/Products/Singles"
#: Sets whose product slugs carry the set code before the number, and promo sets that write it twice.
CODE_IN_NUMBER = (
    "RS", "SS", "DR", "MA", "HL", "RG", "FR", "TRR", "DX", "EM", "UF", "DS", "LM", "HP", "CG", "DF", "PK", "EX", "AQ", "SK", "N1", "N2", "N3", "N4",
    "BS", "JU", "FO", "B2", "TR", "G1", "G2", "LC", "DP", "MT", "SW", "GE", "MD", "LA", "SF", "PL", "PLA", "PLAT", "RR", "SV", "AR", "HS", "UL",
    "UD", "TM", "CL", "BLW", "EPO", "NVI", "NXD", "DEX", "DRX", "DRV", "BCR", "PLS", "PLF", "PLB", "LTR",
)
DOUBLED = {"BW": "BWBW"}


@dataclass(frozen=True)
class Site:
    host: str = "market.example"

    @property
    def base(self) -> str:
        return f"https://www.{self.host}"


def segments(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.filter(F.split(path, "/"), lambda x: x != "")


def last_segment(url: Column) -> Column:
    return F.try_element_at(segments(url), F.lit(-1))


def after_singles(url: Column) -> Column:
    """struct(set_slug, product_slug): what follows "Singles" in the path."""
    parts = segments(url)
    at = F.array_position(parts, "Singles").cast("int")
    get = lambda k: F.when(at > 0, F.get(parts, at + (k - 1)))
    return F.struct(get(1).alias("set_slug"), get(2).alias("product_slug"))


def query_value(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def is_reverse(url: Column) -> Column:
    return F.coalesce(F.upper(query_value(url, "isReverseHolo")) == "Y", F.lit(False))


def first_product_url(text: Column) -> Column:
    """The first URL of a text, without punctuation behind it, if it is a product's."""
    found = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"(https?://[^\s<>\"]+)", 1), r"[.,;)]+$", "")
    return F.when(found.contains("/Products/Singles/"), found)


def without_parameter(url: Column, name: str) -> Column:
    out = F.regexp_replace(url, rf"(?<=[?&]){name}=[^&#]*&?", "")
    return F.regexp_replace(out, r"[?&]+(?=#|$)", "")


def normalise_url(url: str | None, site: Site = Site(), language: str | None = None, reverse: bool = False, condition: int | None = None) -> str | None:
    """Filters in their order of appearance, first value each; the default filters are added where they are missing."""
    if url is None:
        return None
    parts = urlsplit(url)
    host = parts.netloc.lower()
    if host != site.host and not host.endswith("." + site.host):
        return url
    held = {k: v[0] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    for key, value in DEFAULT_FILTERS:
        held.setdefault(key, value)
    if language:
        held["language"] = language
    if reverse:
        held["isReverseHolo"] = "Y"
    if condition is not None and 1 <= condition <= 6:
        held["minCondition"] = str(int(condition))
    return urlunsplit(parts._replace(query=urlencode(held)))


def normalised_url(url: Column, site: Site = Site(), language: Column | None = None, reverse: Column | None = None, condition: Column | None = None) -> Column:
    @F.pandas_udf("string")
    def run(u: pd.Series, lang: pd.Series, rev: pd.Series, cond: pd.Series) -> pd.Series:
        return pd.Series([normalise_url(a, site, b, bool(c) and c == c, None if d is None or d != d else int(d)) for a, b, c, d in zip(u, lang, rev, cond, strict=True)], dtype=object)

    none = F.lit(None)
    return run(url, (none if language is None else language).cast("string"), F.coalesce((none if reverse is None else reverse).cast("boolean"), F.lit(False)), (none if condition is None else condition).cast("int"))


def number_suffix(code: Column, number: Column, prefix: Column | None = None, promo: Column | None = None) -> Column:
    """The end of a product slug: subset numbers take code and letters, a learned prefix comes before the rest of the rules."""
    prefix = F.lit(None).cast("string") if prefix is None else prefix
    promo = F.lit(False) if promo is None else F.coalesce(promo, F.lit(False))
    upper, part, bare = F.upper(code), bare_number(number), digits(number)
    doubled = upper
    for k, v in DOUBLED.items():
        doubled = F.when(upper == k, F.lit(v)).otherwise(doubled)
    coded = promo | ~F.coalesce(number, F.lit("")).contains("/") | upper.isin(*CODE_IN_NUMBER)
    return F.when(part.rlike(r"^[A-Za-z]+[0-9]+$"), F.concat(upper, F.upper(part))).when(prefix.isNotNull(), F.concat(prefix, bare)).when(coded, F.concat(doubled, bare)).otherwise(bare)


def product_path(name: Column, slug_of_set: Column, suffix: Column, hint: Column | None = None) -> Column:
    """Null without a set; a preferred slug (hint) replaces the built one."""
    built = F.concat_ws("-", F.nullif(hyphened(name), F.lit("")), F.nullif(suffix, F.lit("")))
    return F.when(slug_of_set.isNotNull(), F.concat_ws("/", F.lit(PRODUCT_PATH), slug_of_set, built if hint is None else F.coalesce(hint, built)))


def catalogue_url(expansion: Column, name: Column, number: Column, site: Site = Site()) -> Column:
    """A product's page by catalogue fields; leading zeros of the number stay."""
    product = F.concat_ws("-", hyphened(name), F.nullif(bare_number(number), F.lit("")))
    known = F.coalesce(expansion, F.lit("")) != ""
    return F.when(known & (F.coalesce(name, F.lit("")) != ""), F.concat(F.lit(site.base + PRODUCT_PATH + "/"), set_slug(expansion), F.lit("/"), product))


def variants(slug: Column, count: int = 5) -> Column:
    """array<struct(position, slug)>: the base slug and its V1..V5 forms but the given one, in order.

    The mark stands before the rightmost part that ends in a number (name-V2-OBF125);
    without such a part there are no variants.
    """
    plain = F.regexp_replace(slug, r"(?i)-V\d+(?=-)", "")
    shape = r"^(.+)-([A-Z]{0,6}\d{2,4})(?:-[^-]*)*$"
    head, tail = F.regexp_extract(plain, shape, 1), F.regexp_extract(plain, shape, 2)
    marked = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.concat(head, F.lit("-V"), i.cast("string"), F.lit("-"), tail))
    every = F.when(tail != "", F.concat(F.array(F.concat_ws("-", head, tail)), marked)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(every, lambda s, i: F.struct(i.alias("position"), s.alias("slug"))), lambda x: F.lower(x["slug"]) != F.lower(slug))


def learned_prefix(failed: Column, correct: Column, number: Column) -> Column:
    """Letters that a correction put between the name and the number of a slug, or null."""
    bare = digits(number)
    tail = F.concat(F.lit("-"), bare)
    head = F.left(failed, F.greatest(F.length(failed) - F.length(tail), F.lit(0)))
    rest = F.substring(correct, F.length(head) + 2, F.length(correct))
    prefix = F.left(rest, F.greatest(F.length(rest) - F.length(bare), F.lit(0)))
    fits = (failed != correct) & (bare != "") & failed.endswith(tail) & correct.startswith(F.concat(head, F.lit("-"))) & rest.endswith(bare)
    return F.when(fits & prefix.rlike(r"^\p{L}+$"), prefix)
