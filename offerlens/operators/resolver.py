"""Resolving identities by stored mappings, overrides, learned rules and construction.

The fuzzy join is blocked without loss at any threshold it accepts. The score is a mean of
parts, so for each way in which numbers and set codes can agree the threshold says how many
tokens, or which likeness of titles, a pair needs at least. Each row gets signatures: its number and code
where they must be equal, with the rarest tokens of which one must be shared (a prefix filter). Pairs that share
a signature are bounded natively (letters in common cap the Indel ratio), and only those
that can still reach the threshold are scored.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, urls
from ..functions import text as tx
from ..session import checkpointed
from .catalogue import containing_pairs

#: A signature that more mappings have is dealt over several tasks.
HOT_SIGNATURE = 5_000
_EPS = 1e-9
#: How numbers (or codes) of a pair stand: equal, both there but different, missing in the listing, missing in the mapping only.
_EQUAL, _DIFFERENT, _NOT_IN_A, _NOT_IN_B = "E", "D", "A", "B"
#: Frequent characters last: what a likeness of titles rests on is looked for among the others.
_COMMON = " eaionrtslcudpmhgbfvkyw"


def _parts(number: str, code: str) -> list[float]:
    """What number and code add to the score."""
    return [100.0 if x == _EQUAL else 0.0 for x in (number, code) if x in (_EQUAL, _DIFFERENT)]


def _needed(threshold: float, others: list[float], most: float = 100.0, first: bool = False) -> float:
    """The fraction of its best value (``most``) that a part needs beside the others; the pair's first part weighs 1.5."""
    n = len(others) + 1
    if n == 1:
        return threshold / most
    if first:
        return (threshold * (n + 0.5) - sum(others)) / (1.5 * most)
    return (threshold * (n + 0.5) - sum(others) - 0.5 * others[0]) / most


def needed_overlap(threshold: float, number: str, code: str) -> float:
    """The overlap of tokens that a pair with tokens on both sides needs, whether or not titles and names are there."""
    return min(_needed(threshold, [*title, *name, *_parts(number, code)]) for title in ([], [100.0]) for name in ([], [80.0])) - _EPS


def needed_title(threshold: float, number: str, code: str) -> float:
    """The ratio of sorted titles that a pair without tokens needs."""
    return min(_needed(threshold, [*name, *_parts(number, code)], first=True) for name in ([], [80.0])) - _EPS


def needed_name(threshold: float, number: str, code: str) -> float:
    """The ratio of names that a pair without tokens and titles needs."""
    return _needed(threshold, _parts(number, code), 80.0, True) - _EPS


#: At or below, titles and names alone could reach the threshold, so that any two rows might match.
LOWEST_THRESHOLD = 230 / 3.5


#: What Python's split() and strip() take for white space.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _title(c: str = "title") -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), _EDGES, "")


def _name(c: str = "card_name") -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _number(c: str = "collector_number") -> Column:
    """Null if there is none."""
    return F.nullif(F.regexp_replace(F.col(c), _EDGES, ""), F.lit(""))


def _code(c: str = "set_code") -> Column:
    return F.nullif(F.upper(F.col(c)), F.lit(""))


def _prepared(df: DataFrame, key: str) -> DataFrame:
    """key, number and code (null if missing), title and name as they are compared, fingerprint and tokens."""
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    return df.select(F.col(key).alias("row"), _number().alias("number"), _code().alias("code"), _title().alias("title"), _name().alias("name"), F.nullif(F.col("fingerprint"), F.lit("")).alias("fp"), F.size(tokens).alias("size"), F.array_distinct(tokens).alias("tokens"))


def _with_rarest(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``tokens`` ordered from the rarest among the mappings on."""
    each = rows.select("row", F.explode("tokens").alias("_t")).join(counts, "_t", "left")
    ordered = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_count", F.lit(0)).alias("c"), "_t"))).alias("_all"))  # the tokens of a title
    return rows.drop("tokens").join(ordered.select("row", F.col("_all._t").alias("tokens")), "row", "left")


def _letters(text: str) -> Column:
    """A text's letters, numbered where they repeat, the rarest first."""
    return F.expr(f"""transform(array_sort(transform(split({text}, ''), (x, i) -> struct(position(x, '{_COMMON}') AS c, x, size(filter(slice(split({text}, ''), 1, i + 1), y -> y = x)) AS n))), s -> concat(s.x, s.n))""")


def _variants(threshold: float, side: str, bare_a: bool, bare_b: bool) -> list[tuple]:
    """The ways in which a row of this side can match: kind, whether number and code are part of the key, whether each must be there (null: either), which text gives further keys, what that needs, and whether tokens and a title must be there."""
    there = {"a": {_EQUAL: True, _DIFFERENT: True, _NOT_IN_A: False, _NOT_IN_B: True}, "b": {_EQUAL: True, _DIFFERENT: True, _NOT_IN_A: None, _NOT_IN_B: False}}[side]
    out = [("fp", False, False, None, None, "fp", 0.0, None, None)]
    for number, code in product((_EQUAL, _DIFFERENT, _NOT_IN_A, _NOT_IN_B), repeat=2):
        kind, overlap = number + code, needed_overlap(threshold, number, code)
        begin = (number == _EQUAL, code == _EQUAL, there[number], there[code])
        equal = begin[0] + begin[1]
        if equal == 2 or equal and overlap <= 0:
            out.append((kind, *begin, "none", 0.0, None, None))
            continue
        if overlap <= 1:
            out.append((f"{kind}t", *begin, "tokens", overlap, True, None))
        for lacking in "a" * bare_a + "b" * bare_b:  # without tokens in the listing, or in the mapping only
            tokens = False if side == lacking else None if lacking == "a" else True
            if equal:
                out.append((f"{kind}n{lacking}", *begin, "none", 0.0, tokens, None))
                continue
            for text, needed in (("title", needed_title(threshold, number, code)), ("name", needed_name(threshold, number, code))):
                if needed <= 1:
                    out.append((f"{kind}{lacking}{text}", *begin, text, needed, tokens, None if side == "a" else text == "title"))
    return out


_VARIANT = "kind string, by_number boolean, by_code boolean, with_number boolean, with_code boolean, further string, needed double, with_tokens boolean, with_title boolean"


def _signatures(rows: DataFrame, side: str, threshold: float, bare_a: bool, bare_b: bool) -> DataFrame:
    """row, signature: listings (side a) and mappings (b) that may reach the threshold together share one. ``bare_a``, ``bare_b``: listings or mappings without tokens exist."""
    variants = rows.sparkSession.createDataFrame(_variants(threshold, side, bare_a, bare_b), _VARIANT)
    if bare_a or bare_b:
        rows = rows.withColumn("sorted_title", F.array_join(F.array_sort(F.filter(F.split("title", _SPACE), lambda w: w != "")), " "))
        rows = rows.withColumn("of_title", _letters("sorted_title")).withColumn("of_name", _letters("name")).drop("sorted_title")
    else:
        rows = rows.withColumn("of_title", F.array().cast("array<string>")).withColumn("of_name", F.array().cast("array<string>"))
    # So many of the rarest that a row (or a text) of the likeness needed has one of them too.
    of_tokens = "slice(tokens, 1, greatest(size(tokens) - int(ceil(size * needed - 1e-9)) + 1, 0))"
    of_text = "slice({0}, 1, greatest(size({0}) - int(ceil(size({0}) * needed / (2 - needed) - 1e-9)) + 1, 0))"
    keys = F.expr(f"""CASE further WHEN 'tokens' THEN {of_tokens} WHEN 'title' THEN IF(title = '', array(), {of_text.format("of_title")}) WHEN 'name' THEN IF(name = '', array(), {of_text.format("of_name")})
                      WHEN 'fp' THEN IF(fp IS NULL, array(), array(fp)) ELSE array('') END""")
    fits = F.expr("""(with_number IS NULL OR with_number = (number IS NOT NULL)) AND (with_code IS NULL OR with_code = (code IS NOT NULL))
                     AND (with_tokens IS NULL OR with_tokens = (coalesce(size(tokens), 0) > 0)) AND (with_title IS NULL OR with_title = (title <> ''))""")
    each = rows.crossJoin(F.broadcast(variants)).where(fits)  # some thirty rows, by how they are made
    each = each.select("row", "kind", F.expr("IF(by_number, number, NULL)").alias("n"), F.expr("IF(by_code, code, NULL)").alias("c"), F.explode(keys).alias("key"))
    return each.select("row", F.xxhash64("kind", "n", "c", "key").alias("signature")).distinct()


def blocked_pairs(listings: DataFrame, mappings: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(listing_id, id) that may reach the threshold; each pair once. Thresholds of LOWEST_THRESHOLD or less are refused: they'd leave nothing to join by."""
    if threshold <= LOWEST_THRESHOLD:
        raise ValueError(f"a threshold must be above {LOWEST_THRESHOLD:.2f}, not {threshold}: any two rows might reach it")
    a, b = _prepared(listings, "listing_id"), _prepared(mappings, "id")
    counts = b.select(F.explode("tokens").alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_count"))
    bare = lambda df, side: df.where(F.size("tokens") == 0).select(F.lit(side).alias("side")).limit(1)
    sides = {r["side"] for r in bare(a, "a").unionByName(bare(b, "b")).collect()}
    bare_a, bare_b = "a" in sides, "b" in sides
    x = _signatures(_with_rarest(a, counts), "a", threshold, bare_a, bare_b).withColumnRenamed("row", "listing_id")
    y = checkpointed(_signatures(_with_rarest(b, counts), "b", threshold, bare_a, bare_b).withColumnRenamed("row", "id"))
    hot = checkpointed(y.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_SIGNATURE))
    if hot.take(1):  # deal its mappings out, repeat its listings
        parts = hot.select("signature", F.ceil(F.col("n") / HOT_SIGNATURE).cast("int").alias("parts"))
        x = x.join(parts, "signature", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        y = y.join(parts, "signature", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        return x.join(y, ["signature", "part"]).select("listing_id", "id").distinct()
    return x.join(y, "signature").select("listing_id", "id").distinct()


_CLASSES = ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st", "uv", "wx", "yz", "01234", "56789")


def _letter_counts(text: str) -> Column:
    """How many of each class of characters a text (a column's name) has, the last for all others."""
    each = ", ".join(f"char_length({text}) - char_length(translate({text}, '{c}', ''))" for c in _CLASSES)
    return F.expr(f"array({each}, char_length(translate({text}, '{''.join(_CLASSES)}', '')))")


def _shared(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"least({a}[{i}], {b}[{i}])" for i in range(len(_CLASSES) + 1)))


def _cap(same: Column, parts: list[tuple[Column, Column]]) -> Column:
    """``fuzzy.weighted_score`` of parts (whether it is there, value) in plain arithmetic, so that each value is computed once a pair."""
    n, before, total = F.lit(0), F.lit(False), F.lit(0.0)
    for there, value in parts:
        n = n + F.when(there, 1).otherwise(0)
        total = total + F.when(there, value * F.when(before, 1.0).otherwise(1.5)).otherwise(0.0)
        before = before | there
    return F.when(same, F.lit(100.0)).otherwise(total / F.when(n <= 1, 1.5).otherwise(n + 0.5))


def _ratio_cap(shared: Column, size: Column, blanks: Column | int = 0) -> Column:
    """No Indel ratio is higher: a common subsequence has no more letters than both texts, and no more blanks."""
    return F.when(size + 2 * blanks > 0, 200.0 * (shared + blanks) / (size + 2 * blanks)).otherwise(F.lit(100.0))


def scored(pairs: DataFrame, listings: DataFrame, mappings: DataFrame, least: float | None = None) -> DataFrame:
    """pairs with ``score`` and the mapping's columns; with ``least``, pairs that can't reach it may be left out unscored."""
    dense = lambda c: F.regexp_replace(c, _SPACE, "")
    keys = [_title().alias("title"), _name().alias("name"), _number().alias("number"), _code().alias("code"), F.nullif(F.col("fingerprint"), F.lit("")).alias("fp"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")]
    caps = [_letter_counts("dense").alias("title_letters"), _letter_counts("name").alias("name_letters"), F.size(F.split("title", _SPACE)).alias("words"), F.char_length("dense").alias("title_size"), F.char_length("name").alias("name_size")]

    def side(df: DataFrame, prefix: str, key: str, *more: str) -> DataFrame:
        own = df.select(key, *more, *keys).withColumn("dense", dense("title"))
        own = own.select(*own.columns, *caps).drop("dense")
        return own.select(key, *more, *[F.col(c).alias(f"{prefix}_{c}") for c in own.columns if c not in (key, *more)])

    df = pairs.join(side(listings, "a", "listing_id"), "listing_id").join(side(mappings, "b", "id", "url", "product_name", "confidence", "date_added"), "id")
    equal = lambda c: F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), 100.0).when(F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull(), 0.0)
    same = F.coalesce(F.col("a_fp") == F.col("b_fp"), F.lit(False))

    def total(title: Column, name: Column) -> Column:
        return fuzzy.weighted_score(same, [
            F.when(F.col("b_title") != "", title),
            F.when((F.col("a_name") != "") & (F.col("b_name") != ""), name * 0.8),
            equal("number"),
            equal("code"),
            F.when((F.size("a_tokens") > 0) & (F.size("b_tokens") > 0), tx.overlap(F.col("a_tokens"), F.col("b_tokens")) * 100),
        ])

    if least is not None:
        title = _ratio_cap(_shared("a_title_letters", "b_title_letters"), F.col("a_title_size") + F.col("b_title_size"), F.least("a_words", "b_words"))
        name = _ratio_cap(_shared("a_name_letters", "b_name_letters"), F.col("a_name_size") + F.col("b_name_size"))
        both = lambda c: F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull()
        cap = _cap(same, [
            (F.col("b_title") != "", title),
            ((F.col("a_name") != "") & (F.col("b_name") != ""), name * 0.8),
            (both("number"), equal("number")),
            (both("code"), equal("code")),
            ((F.size("a_tokens") > 0) & (F.size("b_tokens") > 0), tx.overlap(F.col("a_tokens"), F.col("b_tokens")) * 100),
        ])
        df = df.where(cap >= least - 1e-6)
    df = df.withColumn("_title", fuzzy.token_sort_ratio_of(F.col("a_title"), F.col("b_title"))).withColumn("_name", fuzzy.ratio_of(F.col("b_name"), F.col("a_name")))
    return df.withColumn("score", total(F.col("_title"), F.col("_name"))).drop(*[f"{p}_{c}" for p in "ab" for c in ("title_letters", "name_letters", "words", "title_size", "name_size")])


def best_mapping(listings: DataFrame, mappings: DataFrame, threshold: float = 80.0) -> DataFrame:
    """The best stored mapping of each listing at or above the threshold; ties by confidence, then recency, then id.

    Rows that a score can't tell apart are compared once: of mappings alike only the one that wins ties can be the
    best, and listings alike have the same best, so copies of either cost no pairs.
    """
    rank = F.struct("confidence", "date_added", F.bitwise_not("id"))
    held = mappings.groupBy(*_COMPARED).agg(F.max_by(F.struct("id", "url", "product_name", "confidence", "date_added"), rank).alias("_r")).select("_r.*", *_COMPARED)
    kinds = checkpointed(listings.select(*_COMPARED).distinct().withColumn("_kind", F.monotonically_increasing_id()))
    asked = kinds.withColumnRenamed("_kind", "listing_id")
    found = scored(blocked_pairs(asked, held, threshold), asked, held, threshold).where(F.col("score") >= threshold)
    best = _first_by_score(found.select(F.col("listing_id").alias("_kind"), "id", "score", "url", "product_name", "confidence", "date_added"), "_kind")
    same = F.struct(*_COMPARED).alias("_same")
    members = listings.select("listing_id", same).join(kinds.select("_kind", same), "_same").select("listing_id", "_kind")
    best = _first_by_score(members.join(best, "_kind"), "listing_id")
    return best.select("listing_id", F.col("id").alias("mapping_id"), "score", "url", "product_name")


#: All that a score is made of.
_COMPARED = ["title", "card_name", "collector_number", "set_code", "fingerprint", "tokens"]


def _first_by_score(found: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("confidence"), F.desc("date_added"), "id")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_rule(rules: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """(set_code, prefix): the most confident, then most used rule of each code, if it is confident enough."""
    order = Window.partitionBy(F.upper("set_code")).orderBy(F.desc("confidence"), F.desc("uses_successful"), "id")
    best = rules.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select(F.upper("set_code").alias("set_code"), F.when(F.col("confidence") >= min_confidence, F.col("prefix")).alias("prefix"))


def set_name_codes(names: DataFrame, table: DataFrame) -> DataFrame:
    """(set_name, derived_code): the exact set, else the first set (by pos) whose name contains the text or is contained."""
    asked = names.where(F.coalesce("set_name", F.lit("")) != "").select("set_name", F.lower("set_name").alias("_low")).distinct()
    joined = containing_pairs(asked, "_low", table.select("key", "code", "pos"), "key")
    return joined.groupBy("set_name").agg(F.min_by("code", F.struct((F.col("_low") != F.col("key")).alias("other"), "pos")).alias("derived_code"))


def constructed(listings: DataFrame, codes: DataFrame, rules: DataFrame, overrides: DataFrame, set_names: DataFrame, site: urls.Site = urls.Site(), hints: DataFrame | None = None) -> DataFrame:
    """listing_id, url, confidence, needs_validation for listings with a name: override, else by code, else by the set name's code.

    Listings of the same identity get the same URL, so each identity is built once.
    """
    named = listings.where(F.coalesce("card_name", F.lit("")) != "").select("listing_id", F.struct(*_BUILT_OF).alias("_same"))
    df = named.select("_same").distinct().select("_same", "_same.*")
    df = df.join(overrides.select("fingerprint", F.col("url").alias("_override")), "fingerprint", "left").join(set_name_codes(df, set_names), "set_name", "left")
    slugs, best = codes.select(F.upper("code").alias("_c"), "slug"), best_rule(rules)
    language = F.lit(None).cast("string")
    for name, code in urls.LANGUAGE_CODES.items():
        if code not in ("1", "11"):
            language = F.when(F.col("language") == name, F.lit(code)).otherwise(language)
    for k, source in (("1", "set_code"), ("2", "derived_code")):
        df = df.withColumn("_c", F.upper(source)).join(slugs.withColumnRenamed("slug", f"_slug{k}"), "_c", "left")
        df = df.join(best.select(F.col("set_code").alias("_c"), F.col("prefix").alias(f"_prefix{k}")), "_c", "left")
        hint = None
        if hints is not None:
            df = df.withColumn("_hint_name", urls.hyphened("card_name")).withColumn("_hint_number", tx.digits("collector_number"))
            df = df.join(hints.select(F.col("name_slug").alias("_hint_name"), F.upper("set_code").alias("_c"), F.col("digits").alias("_hint_number"), F.col("slug").alias(f"_hint{k}")), ["_hint_name", "_c", "_hint_number"], "left")
            hint = F.col(f"_hint{k}")
        suffix = urls.number_suffix(F.col("_c"), F.col("collector_number"), F.col(f"_prefix{k}"), F.col("is_promo"))
        df = df.withColumn(f"_path{k}", urls.product_path(F.col("card_name"), F.col(f"_slug{k}"), suffix, hint)).drop("_c")
    raw = F.concat(F.lit(site.base), F.coalesce("_path1", "_path2"))
    built = urls.normalised_url(raw, site, language, F.col("is_reverse_holo"), tx.effective_condition("condition_code"))
    sure = lambda k, a, b: F.when(F.col(f"_prefix{k}").isNotNull(), F.lit(a)).otherwise(F.lit(b))
    df = df.withColumn("_built", built)
    found = df.select(
        "_same", F.coalesce("_override", "_built").alias("url"),
        F.when(F.col("_override").isNotNull(), F.lit(0.95)).when(F.col("_path1").isNotNull(), sure("1", 0.75, 0.60)).otherwise(sure("2", 0.65, 0.50)).alias("confidence"),
        F.col("_override").isNull().alias("needs_validation"),
    ).where(F.col("url").isNotNull())
    return named.join(found, "_same").drop("_same")


#: All that a URL is built of.
_BUILT_OF = ["fingerprint", "card_name", "collector_number", "set_code", "set_name", "language", "condition_code", "is_reverse_holo", "is_promo"]


def is_valid_page(status: Column) -> Column:
    """A page's HTTP status: 404 no, 403 and 405 yes, other errors and none no."""
    return F.when(status.isin(403, 405), True).when(status.isNull() | (status >= 400), False).otherwise(True)
