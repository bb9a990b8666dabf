import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from offerlens.llm import lexical
from offerlens.llm.queries import op12_ranked_search

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def brute(rows, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            m = 100 - 90 + 90 * n * n_docs // total
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0))
        found.sort()
        out += [(item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def run(docs, items, k=10):
    return sorted(map(tuple, lexical.rank(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n=300, topics=6):
    rng = random.Random(seed)
    common_words = [f"w{i}" for i in range(30)]
    own = [[f"t{k}x{i}" for i in range(80)] for k in range(topics)]
    rows = []
    for i in range(n):
        k = rng.randrange(topics)
        words = [rng.choice(common_words if rng.random() < 0.4 else own[k]) for _ in range(rng.randint(1, 80))]
        rows.append((i, rng.choice([" ", ", ", "\n", "/"]).join(rng.choice([x, x.upper()]) for x in words)))
    rows += [(n + i, rows[i][1]) for i in range(40)]  # copies tie
    items = [(j, " ".join(rng.choice(own[rng.randrange(topics)] if rng.random() < 0.7 else common_words) for _ in range(rng.randint(1, 12)))) for j in range(25)]
    return rows, items


HARD = [(None, None), (900, ""), (901, " .,;"), (None, "Größe größe GRÖSSE w1"), (902, "x" * 200_000 + " w1 " * 20_000), (902, "w1"), (902, "w1"), (-3, "\x00w1\x00\x85w2\xa0")]
HARD_ITEMS = [(100, None), (101, ""), (102, "nosuchterm"), (103, "größe w1 W1 w1"), (103, "w2"), (None, "w3 w4")]


@pytest.fixture
def items_of(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs_of, items_of, seed):
    rows, items = corpus(seed)
    rows, items = rows + HARD, items + HARD_ITEMS
    assert run(docs_of(rows), items_of(items)) == brute(rows, items)
    assert run(docs_of(rows), items_of(items), 3) == brute(rows, items, 3)


def test_many_clusters_and_turns(docs_of, items_of, monkeypatch):
    """Small clusters, a fitted tree, leaves dealt over parts, terms too many to broadcast: the same rows, over several turns."""
    rows, items = corpus(3, 600)
    rows, items = rows + HARD, items + HARD_ITEMS
    want = brute(rows, items)
    for name, value in {"GROUP_DOCS": 64, "CLUSTER_DOCS": 8, "FIRST": 1, "MORE": 2, "BROADCAST_TERMS": 3}.items():
        monkeypatch.setattr(lexical, name, value)
    index = lexical.Index.of(docs_of(rows))
    found, turns = index.visit(items_of(items))
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert len(turns) > 2 and turns[-1] == 0


def test_stops_early_where_documents_cluster(docs_of, items_of, monkeypatch):
    monkeypatch.setattr(lexical, "CLUSTER_DOCS", 25)
    rng = random.Random(9)
    rows = [(i, " ".join(f"t{i % 20}x{rng.randint(0, 30)}" for _ in range(40)) + " the of and") for i in range(1000)]
    items = [(j, f"t{j}x1 t{j}x2 t{j}x3") for j in range(20)]
    found, turns = lexical.Index.of(docs_of(rows)).visit(items_of(items))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, items)
    assert sum(turns) <= 20 * 40 / 4  # of 40 clusters each


def test_empty_tables(docs_of, items_of):
    assert run(docs_of([]), items_of([(1, "a")])) == [] and run(docs_of([(1, "a")]), items_of([])) == []
    assert run(docs_of([(1, None), (2, "")]), items_of([(1, "a")])) == []


def test_bisection_puts_like_documents_together():
    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat(np.arange(8), 64))
    doc = np.repeat(np.arange(512), 30)
    term = topic[doc] * 100 + rng.integers(0, 60, len(doc))
    order = lexical.bisected(doc, term, 512, 64)
    assert sorted(order.tolist()) == list(range(512))
    mixed = np.mean([max(np.bincount(topic[order[i : i + 64]])) for i in range(0, 512, 64)])
    assert mixed > 45  # of 64; by chance about 13
    assert lexical.bisected(np.zeros(0, np.int64), np.zeros(0, np.int64), 5, 2).tolist() == [0, 1, 2, 3, 4]


def test_tree_sends_like_documents_to_one_leaf():
    rng = random.Random(2)
    text = lambda k: " ".join(f"t{k}x{rng.randint(0, 40)}" for _ in range(30)).encode()
    tree = lexical.Tree.fit([text(i % 4) for i in range(200)], 2)
    leaf = {}
    for k in range(4):
        known = [np.array([tree.terms[t] for t in set(lexical.terms_of(text(k))) if t in tree.terms]) for _ in range(50)]
        got = tree.leaves(np.repeat(np.arange(50), [len(x) for x in known]), np.concatenate(known), 50)
        leaf[k] = np.bincount(got, minlength=4).argmax()
        assert np.bincount(got).max() >= 40
    assert len(set(leaf.values())) == 4


def test_long_text(docs_of, items_of):
    rows = [(1, "word " * 1_000_000), (2, "z" * 5_000_000 + " word"), (3, " " * 5_000_000), (4, "word other")]
    items = [(1, "word other")]
    assert run(docs_of(rows), items_of(items)) == brute(rows, items)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, op12_ranked_search(spark, sf).collect()), key=str) == brute(rows, items)
