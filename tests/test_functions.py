import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions import fuzzy, money, urls
from offerlens.functions import text as tx


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_keys_and_slugs(spark):
    assert apply(spark, tx.number_key, ["025/193", "25", "TG09/TG30", "000", "promo", "", None, "9" * 30]) == ["25", "25", "9", "0", "promo", "", "", "9" * 30]
    assert apply(spark, tx.set_slug, ["Obsidian Flames", "Pokémon GO", "151", " -- "]) == ["Obsidian-Flames", "Pokemon-GO", "151", ""]
    assert apply(spark, urls.hyphened, ["Pokémon GO"]) == ["Pok-mon-GO"]
    assert apply(spark, tx.name_key, ["Charizard-ex", " Mr. Mime "]) == ["charizardex", "mr mime"]
    assert apply(spark, tx.expansion_key, ["Obsidian-Flames", "Pokémon"]) == ["obsidian flames", "pokemon"]
    assert apply(spark, tx.positive, ["1.5", "0", "-1", "x", None, "nan"]) == [1.5, None, None, None, None, None]


def test_prices(spark):
    got = apply(spark, lambda c: tx.parsed_price(tx.repaired_price(c)), ["13,98 €", "1.234,56 €", "13.98", "N/A", "", None, "3,50 â\x82¬", "1.2.3"])
    assert got == [13.98, 1234.56, 13.98, 0.0, 0.0, 0.0, 3.5, 0.0]
    assert apply(spark, tx.repaired_price, ["3,50 â\x82¬", "Â£2"]) == ["3,50 €", "£2"]


def test_counts_and_weights(spark):
    assert apply(spark, tx.explicit_count, ["100 cards", "lot of approx. 300", " x250", "250x", "+-300 cards and 20 cards", "5 cards", ""]) == [100, 300, 250, 250, 300, None, None]
    assert apply(spark, tx.weight_grams, ["1800g", "1,8 kg", "2kg 500 gram", "none"]) == [1800.0, 1800.0, 500.0, None]
    assert [tuple(x) for x in apply(spark, tx.estimated_count, ["1,8 kg", "99 cards 1kg", ""])] == [(1000, "weight"), (99, "explicit"), (None, "unknown")]


def test_grades_conditions_ids(spark):
    assert apply(spark, tx.grade_of, ["PSA 9", "psa10", "xPSA 9", None]) == [9, 10, None, None]
    assert apply(spark, tx.effective_condition, [None, 1, 6, 7], "int") == [2, 1, 6, None]
    assert apply(spark, tx.product_id, ["id 765991.", "12", None]) == [765991, None, None]


@pytest.mark.parametrize(("price", "fee", "low", "high"), [("0.50", "0.73", "4.12", "8.32"), ("1.00", "0.75", "4.64", "8.84"), ("10.00", "1.20", "14.09", "18.29"), ("12.50", "1.33", "16.72", "20.92"), ("100.00", "5.70", "108.59", "112.79")])
def test_money(spark, price, fee, low, high):
    p = F.lit(price).cast("decimal(14,2)")
    row = spark.range(1).select(money.fee(p), money.total(p, money.SHIPPING_MIN), money.total(p, money.SHIPPING_MAX)).first()
    assert [str(x) for x in row] == [fee, low, high]


def test_binary_rounding_is_pythons(spark):
    df = spark.createDataFrame([(0.5,), (12.5,), (10.0,), (None,)], "p double").select(money.binary_fee("p"), money.binary_total("p", F.lit(7.09)))
    assert [tuple(r) for r in df.collect()] == [(0.72, 8.31), (1.32, 20.91), (1.2, 18.29), (None, None)]


def test_comparison_is_strict(spark):
    df = spark.createDataFrame([("10.00", "18.29"), ("10.00", "18.30"), ("10.00", "0"), ("10.00", None)], "p string, r string").select(money.compared(F.col("p").cast("decimal(14,2)"), F.col("r").cast("decimal(14,2)")).alias("c"))
    assert [(r["c"]["is_profitable"], float(r["c"]["difference"])) for r in df.collect()] == [(False, 0.0), (True, 0.01), (False, 0.0), (False, 0.0)]


def test_url_filters():
    site = urls.Site()
    norm = lambda u, **k: urls.normalise_url(u, site, **k)
    base = "https://www.market.example/en/X/Y"
    assert norm(base) == base + "?sellerCountry=23&language=1"
    assert norm(base + "?language=3&language=4&q=") == base + "?language=3&q=&sellerCountry=23"
    assert norm(base, language="7", reverse=True, condition=2) == base + "?sellerCountry=23&language=7&isReverseHolo=Y&minCondition=2"
    assert norm(base, condition=7) == norm(base) and norm(norm(base)) == norm(base)
    assert norm("https://evilmarket.example.org/x") == "https://evilmarket.example.org/x" and norm(None) is None


def test_url_columns(spark):
    u = "https://www.market.example/en/X/Products/Singles/Base-Set/Card-V2-OBF125?isReverseHolo=y&a=b#f"
    df = spark.createDataFrame([(u,), (None,), ("https://h/",)], "u string")
    c = F.col("u")
    got = df.select(urls.last_segment(c), urls.after_singles(c), urls.is_reverse(c), urls.without_parameter(c, "isReverseHolo"), urls.variants(urls.last_segment(c))).collect()
    assert (got[0][0], tuple(got[0][1]), got[0][2], got[0][3]) == ("Card-V2-OBF125", ("Base-Set", "Card-V2-OBF125"), True, u.replace("isReverseHolo=y&", ""))
    assert [v["slug"] for v in got[0][4]] == ["Card-OBF125", "Card-V1-OBF125", "Card-V3-OBF125", "Card-V4-OBF125", "Card-V5-OBF125"]
    assert got[1][0] is None and got[2][0] is None and apply(spark, urls.variants, ["no-number-part"])[0] == []
    texts = [f"see {u.split('?')[0]}).", "https://h/other", None]
    assert apply(spark, urls.first_product_url, texts) == [u.split("?")[0], None, None]


def test_suffix_rules(spark):
    rows = [("crz", "GG36/GG70", None, False), ("OBF", "125/197", None, False), ("TR", "83/82", "TR", False), ("SVP", "214", None, False), ("BW", "73", None, True), ("CG", "94/100", None, False), ("OBF", None, None, False)]
    df = spark.createDataFrame(rows, "c string, n string, p string, promo boolean").select(urls.number_suffix(*(F.col(x) for x in ("c", "n", "p", "promo"))))
    assert [r[0] for r in df.collect()] == ["CRZGG36", "125", "TR83", "SVP214", "BWBW73", "CG94", "OBF"]


def test_learned_prefix(spark):
    rows = [("Dark-Raichu-83", "Dark-Raichu-TR83", "83/82"), ("Krabby-51", "Krabby-FO51", "51"), ("A-1", "A-1", "1"), ("A-1", "A-B21", "1"), ("A-1", "C-X1", "1"), ("A-1", "A-X1", ""), ("A-2", "A-X1", "1")]
    df = spark.createDataFrame(rows, "f string, c string, n string").select(urls.learned_prefix(F.col("f"), F.col("c"), F.col("n")))
    assert [r[0] for r in df.collect()] == ["TR", "FO", None, None, None, None, None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_indel_ratio():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 25))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == lcs(a, b)
    assert fuzzy.ratio("abcd", "abxd") == 75.0 and fuzzy.ratio("", "") == 100.0 and fuzzy.token_sort_ratio("b a", "a b") == 100.0
    assert fuzzy.token_set_ratio("a b c", "a b") == 100.0 and fuzzy.token_set_ratio("", "a") == 0.0


def test_fingerprint_and_tokens(spark):
    import hashlib

    df = spark.createDataFrame([(" Pikachu ", "svp", "214"), (None, None, None)], "n string, c string, k string")
    got = [r[0] for r in df.select(tx.fingerprint("n", "c", "k")).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest()[:16] for x in ("pikachu|SVP|214", "||")]
    none = F.lit(None).cast("string")
    assert df.select(tx.tokens("n", "n", "c", "k", none)).first()[0] == ["pikachu", "pikachu", "svp", "214"]
    assert [r[0] for r in df.select(tx.display_key("n", none, "c", "k", none, F.lit("t" * 90))).collect()] == [" Pikachu  | svp | 214", "t" * 80]


def test_folded_words_are_found_as_any_of_them(spark):
    import random

    from offerlens.operators import prefilter

    rng = random.Random(1)
    words = ("tin", "t-shirt", "tshirt", "top loader", "toploader", "etb", "display", "display box", "a.b", "é+", "lot de", "lot")
    texts = ["".join(rng.choice([*words, "t", "di", " ", "ab", "e", "lo", "-", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    texts = [x[: rng.randint(0, len(x))] for x in texts]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(prefilter.contains_any(F.col("x"), words).alias("hit")).collect()
    assert [r["hit"] for r in got] == [any(w in x for w in words) for x in texts]
