import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from offerlens.llm import simhash
from offerlens.llm.queries import op6_simhash_near_dedup


def fingerprint(text, k=3):
    words = [w for w in (text or "").encode().lower().replace(b"\x1f", b"\x1f").split()]
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    value = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            value |= 1 << bit
    return value


def components(ids, linked):
    label = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if linked(a, b) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words")]
    for g in range(12):
        base = [word() for _ in range(rng.randint(60, 400))]
        for c in range(4):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 + 10 * g + c, " ".join(copy)))
    return rows + [(500 + i, "the same text of a large group of copies " * 5) for i in range(40)] + [(900, "long " * 30_000)]


def test_contract_against_brute_force(docs_of):
    rows = corpus()
    found = simhash.near_duplicates(docs_of(rows), shingle=3, radius=3, lanes=1, parts=3, size_ratio=None).collect()
    got = {r["doc_id"]: (r["f0"] & (2**64 - 1), r["component_id"]) for r in found}
    prints = {d: fingerprint(t) for d, t in rows}
    assert {d: f for d, (f, _) in got.items()} == prints
    label = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {d: c for d, (_, c) in got.items()} == label


def test_query(spark, sf):
    rows = op6_simhash_near_dedup(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: fingerprint(t) for d, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{f:016x}" for d, f in prints.items()}
    label = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {r["doc_id"]: r["component_id"] for r in rows} == label


def test_stage_keeps_one_of_each_group(docs_of):
    rows = corpus()
    df = docs_of(rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {100 + 10 * g for g in range(12)} <= ids and not {101 + 10 * g for g in range(12)} & ids
    assert len(ids & set(range(500, 540))) == 1 and {1, 4, 900} <= ids and not {2, 3, 5} & ids


def test_links_lose_nothing_over_many_tiles(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 60, dtype=np.int64)
    prints = sorted({int(b) ^ int(sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 4), replace=False))) for b in base for _ in range(8)})
    nodes = spark.createDataFrame([(i, 1, f) for i, f in enumerate(prints)], "node long, size long, f0 long")
    for parts, tile in ((3, 3), (0, 50), (2, 2048)):
        found = simhash.components(simhash.links(nodes, 3, 1, parts, None, tile))
        got = {i: i for i in range(len(prints))} | {r["node"]: r["component"] for r in found.collect()}
        assert got == components(list(range(len(prints))), lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3)


def test_long_chain_is_one_component(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r["component"] for r in simhash.components(edges).collect()} == {0}


def test_empty_null_ids_and_repeated_rows(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    text = "a text of some words that is held by rows of several kinds " * 3
    rows = simhash.near_duplicates(docs_of([(None, text), (5, text), (5, text), (9, text)])).collect()
    assert [r["component_id"] for r in rows] == [5] * 4


def test_stage_against_brute_force_jaccard(spark, docs_of):
    """Pairs on both sides of 0.8, where an estimate errs, over one tile and over many."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    rows = [(1, None), (2, " "), (3, "one"), (4, "a b c d e f g h"), (5, "a b c d e f g h i"), (6, "z " * 400 + "a b c d e f g h")]
    for g in range(40):
        n = rng.randint(60, 300)
        base = [word() for _ in range(n)]
        rows.append((1000 + 10 * g, " ".join(base)))
        for c in range(1, 6):
            copy, share = list(base), rng.uniform(0.66, 0.86)
            keep = round(2 * share / (1 + share) * n)  # of n words the last n - keep are new
            copy[keep:] = [word() for _ in range(n - keep)]
            rows.append((1000 + 10 * g + c, " ".join(copy)))
    sets = {}
    for d, text in rows:
        words = (text or "").lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    label = components(sorted(sets), near)
    assert 20 < sum(label[d] != d for d in label) < 200
    docs = docs_of(rows)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == label
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {d for d in label if label[d] == d}
    nodes = simhash.fingerprints(docs, 5, 4, distinct=True).withColumnRenamed("doc_id", "node")
    together = nodes.where("node > 1").select("node", F.lit(1).cast("long").alias("component"))
    found = simhash.components(simhash.checked_links(docs, nodes, together, 5, 80, 4, 0.8, tile=20))
    assert {d: d for d in label} | {r["node"]: r["component"] for r in found.collect()} == label


def test_rows_without_an_id_connect_others(docs_of):
    """A fingerprint that only a row without an id holds lies between two that are too far apart."""
    rng = random.Random(8)
    words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(400)]
    prints, chain = {}, None
    for i in range(3000):
        t = list(words)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(400)] = f"n{rng.random()}"
        prints[" ".join(t)] = fingerprint(" ".join(t))
        if i % 50 == 49:
            items = list(prints.items())
            near = lambda a, b: (a[1] ^ b[1]).bit_count() <= 3
            chain = next(((a, m, b) for m in items for a in items for b in items if a is not b and near(a, m) and near(m, b) and not near(a, b)), None)
            if chain:
                break
    a, m, b = (x[0] for x in chain)
    for middle in (None, 77):
        rows = simhash.near_duplicates(docs_of([(5, a), (middle, m), (9, b)]), shingle=3, radius=3, lanes=1, parts=3, size_ratio=None).collect()
        assert [r["component_id"] for r in rows] == [5] * 3
    alone = simhash.near_duplicates(docs_of([(None, a), (None, a), (3, "else " * 50)]), shingle=3, radius=3, lanes=1, parts=3, size_ratio=None).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in alone) == [(0, 0), (0, 0), (3, 3)]


def test_stage_keeps_one_row_of_repeated_ids(docs_of):
    text = "a text of quite some words that five rows of several kinds hold alike"
    kept = simhash.keep_one(docs_of([(2, text), (1, text), (None, text), (1, text), (None, text), (None, "another text entirely that nobody shares at all"), (None, "another text entirely that nobody shares at all")])).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:2]) for r in kept) == [(0, "an"), (1, "a ")]


def test_sets_are_shipped_about_once(spark, docs_of, monkeypatch):
    """One component of thousands: twice the documents ship about twice the rows to the exact check."""
    shipped, real = [], simhash._forests
    monkeypatch.setattr(simhash, "_forests", lambda pairs, names, radius, ratio: shipped.append(pairs.selectExpr("sum(size(rows_a) + coalesce(size(rows_b), 0)) AS n").first()["n"] or 0) or real(pairs, names, radius, ratio))
    base = [f"w{i}" for i in range(60)]
    for n in (1500, 3000):
        rows = [(i, " ".join([*base[: i % 60], f"x{i}", *base[i % 60 + 1 :]])) for i in range(n)]
        assert simhash.near_duplicates(docs_of(rows)).select("component_id").distinct().count() >= 1
    small, large = shipped[1::2]
    assert small and large <= 2.3 * small


def test_no_pair_within_the_radius_is_skipped():
    """Four lanes: what the first three let through are all pairs within the radius."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**63, (300, 4), dtype=np.int64).astype(np.uint64)
    b = a[rng.integers(0, 300, 400)] ^ (np.uint64(1) << rng.integers(0, 63, (400, 4)).astype(np.uint64))
    for _ in range(30):  # up to 124 further bits, some all in one lane
        b[:, rng.integers(0, 4)] ^= np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)
    want = {(i, j) for i in range(300) for j in range(400) if int(np.bitwise_count(a[i] ^ b[j]).sum()) <= 80}
    got = {(int(x), int(y)) for i, j in simhash._near(a, b, np.ones(300), np.ones(400), 80, None) for x, y in zip(i, j)}
    assert want and got == want
