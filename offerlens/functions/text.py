"""Normalisation, prices, numbers and slugs as native column expressions (null in, null or the stated default out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hyphened(name: Column | str) -> Column:
    """Runs of anything but ASCII letters and digits become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(name), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def set_slug(name: Column | str) -> Column:
    """``hyphened`` with é as e."""
    return hyphened(F.translate(_col(name), "éÉ", "eE"))


def bare_number(number: Column | str) -> Column:
    return F.trim(F.substring_index(F.coalesce(_col(number), F.lit("")), "/", 1))


def digits(number: Column | str) -> Column:
    return F.regexp_replace(bare_number(number), "[^0-9]", "")


def number_key(number: Column | str) -> Column:
    """The digits before a slash without leading zeros; without digits, that part in lower case."""
    d = digits(number)
    stripped = F.regexp_replace(d, "^0+", "")
    return F.when(d != "", F.when(stripped == "", F.lit("0")).otherwise(stripped)).otherwise(F.lower(bare_number(number)))


def name_key(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(name), F.lit(""))), "[^a-z0-9 ]", ""))


def expansion_key(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(_col(name), F.lit(""))), "-é", " e"), "[^a-z0-9 ]", ""))


def positive(value: Column | str) -> Column:
    """A positive double, or null."""
    number = F.try_cast(_col(value), "double") if hasattr(F, "try_cast") else _col(value).try_cast("double")
    return F.when((number > 0) & ~F.isnan(number), number)


def same_number(a: Column | str, b: Column | str) -> Column:
    """Equal without leading zeros; nothing counts as 0."""
    plain = lambda c: F.coalesce(F.nullif(F.ltrim(F.coalesce(_col(c), F.lit("")), F.lit("0")), F.lit("")), F.lit("0"))
    return plain(a) == plain(b)


def repaired_price(text: Column | str) -> Column:
    """Currency signs that were decoded wrongly are put right."""
    fixed = F.replace(F.replace(F.coalesce(_col(text), F.lit("")), F.lit("â\x82¬"), F.lit("€")), F.lit("Â£"), F.lit("£"))
    return F.regexp_replace(fixed, r"^\s+|\s+$", "")


def parsed_price(text: Column | str) -> Column:
    """A European price string as a double: comma decimals, dots before a comma are thousands; 0 if there is none."""
    kept = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"[^\d,.]", "")
    point = F.when(kept.contains(","), F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(kept)
    return F.coalesce(point.try_cast("double"), F.lit(0.0))


def has_word(text: Column | str, word: str) -> Column:
    return F.coalesce(_col(text), F.lit("")).rlike(rf"(?iU)\b{word}\b")


def grade_of(text: Column | str, authority: str = "PSA") -> Column:
    found = F.regexp_extract(F.coalesce(_col(text), F.lit("")), rf"(?iU)\b{authority}\s*(\d{{1,2}})\b", 1)
    return F.nullif(found, F.lit("")).cast("int")


def effective_condition(code: Column | str) -> Column:
    """Condition filter: 2 if unknown, none for the poorest (7)."""
    return F.when(_col(code).isNull(), F.lit(2)).when(_col(code).between(1, 6), _col(code).cast("int"))


def product_id(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_col(text), F.lit("")), r"\b(\d{4,9})\b", 1), F.lit("")).cast("long")


# --- identities ---------------------------------------------------------------


def fingerprint(name: Column | str, code: Column | str, number: Column | str) -> Column:
    """The first 16 hex digits of SHA-256 over name, set code and number."""
    blank = lambda c: F.coalesce(_col(c), F.lit(""))
    key = F.concat_ws("|", F.trim(F.lower(blank(name))), F.trim(F.upper(blank(code))), F.trim(blank(number)))
    return F.substring(F.sha2(key, 256), 1, 16)


def display_key(name, set_name, set_code, number, rarity, title) -> Column:
    full = lambda c: F.nullif(_col(c), F.lit(""))
    joined = F.concat_ws(" | ", full(name), F.coalesce(full(set_name), full(set_code)), full(number), full(rarity))
    return F.coalesce(F.nullif(joined, F.lit("")), F.substring(_col(title), 1, 80))


def tokens(name, set_name, set_code, number, rarity) -> Column:
    """Lower-case tokens, repeats kept."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"\s+"), lambda x: x != "")
    one = lambda c: F.filter(F.array(F.lower(F.coalesce(_col(c), F.lit("")))), lambda x: x != "")
    return F.concat(words(name), words(set_name), one(set_code), one(number), one(rarity))


def discount_percent(price: Column, value: Column) -> Column:
    """How far a price lies below the market value, in percent; null without a positive value."""
    return F.when(value > 0, (1 - price / value) * 100)


def thumbnail(images: Column | str) -> Column:
    """The first image, or null."""
    return F.try_element_at(_col(images), F.lit(1))


def identity_json(*fields: Column | str) -> Column:
    """An identity's fields as a JSON object, nulls included."""
    return F.to_json(F.struct(*[_col(f) for f in fields]), {"ignoreNullFields": "false"})


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the longer list's length."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest > 0, F.size(F.array_intersect(a, b)) / longest).otherwise(F.lit(0.0))


def translated(title: Column | str, names: dict[str, str], sets: dict[str, str]) -> Column:
    """Replace foreign names (as whole words), then set names (anywhere), longest first, in any case."""
    out = _col(title)
    for table, edge in ((names, r"\b"), (sets, "")):
        for source in sorted(table, key=len, reverse=True):
            quoted = "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in source)
            out = F.regexp_replace(out, f"(?iU){edge}{quoted}{edge}", table[source].replace("\\", "\\\\").replace("$", "\\$"))
    return out


# --- counts and weights ---------------------------------------------------------

# Patterns of card counts, and grams of a card.
COUNT_PATTERNS = (
    r"(?iU)\b(\d{2,5})\s*(?:x\b)?\s*(?:pokemon\s+)?cards?\b",
    r"(?iU)lot\s+of\s+(?:approx\.?\s+)?(\d{2,5})",
    r"(?iU)(?:^|\s)x(\d{2,5})\b",
    r"(?iU)\b(\d{2,5})x\b",
    r"(?iU)approx\.?\s+(\d{2,5})\s*cards?\b",
    r"(?iU)[+\-]{1,2}/?[+\-]{0,1}\s*(\d{2,5})\s*cards?\b",
)
GRAMS_PER_CARD = 1.8


def explicit_count(text: Column | str) -> Column:
    """The largest stated count, or null."""
    found = F.concat(*[F.regexp_extract_all(_col(text), F.lit(p), F.lit(1)) for p in COUNT_PATTERNS])
    return F.array_max(F.transform(found, lambda x: x.try_cast("int")))


def weight_grams(text: Column | str) -> Column:
    """A weight in grams; kilograms only without a gram figure."""
    number = lambda unit: F.replace(F.nullif(F.regexp_extract(_col(text), rf"(?iU)\b(\d+(?:[.,]\d+)?)\s*{unit}\b", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(number("(?:gram|grams|gr|g)"), number("kg") * 1000)


def estimated_count(text: Column | str) -> Column:
    """struct(count, source): stated, or from weight."""
    stated, grams = explicit_count(text), weight_grams(text)
    return F.struct(
        F.coalesce(stated, F.floor(grams / GRAMS_PER_CARD).cast("int")).alias("count"),
        F.when(stated.isNotNull(), "explicit").when(grams.isNotNull(), "weight").otherwise("unknown").alias("source"),
    )
