import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from offerlens.llm import spelling
from offerlens.llm.queries import op11_spelling_variants

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def neighbours(words):
    """Near words through deletions of one letter, another way than the operator's."""
    by, out = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i] + "*" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                out[w].add(w[:i] + w[i + 1 :])
                out[w[:i] + w[i + 1 :]].add(w)
    for group in by.values():
        for w in group:
            out[w] |= group - {w}
    return out


def brute(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = neighbours(n.keys())
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def run(df):
    return sorted(map(tuple, spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    weights = [1 / (i + 1) ** 2 for i in range(len(base))]

    def word():
        w = rng.choices(base, weights)[0]
        if rng.random() < 0.2:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdé") + w[i:], w[:i] + rng.choice("abcdé") + w[i + 1 :]])
        return rng.choice([w, w, w.title(), w.upper()])

    return [(i, rng.choice([" ", ", ", "-", "1"]).join(word() for _ in range(rng.randint(0, 90)))) for i in range(n)]


CHAIN = [(5000 + i, ("letters " * 3 + "lettres " * 40 + "lettrés " * 500 + "lettréss " * 6000)) for i in range(1)]
HARD = [(None, None), (900, ""), (901, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999), (None, "abcdefg abcdefg ABCDEFG"), (902, "Äöüßéèê äöüßéèê Äöüßéèê"), (903, "short words only"), (903, "abcdefg" * 1 + " abcdefx" * 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs_of, seed):
    rows = corpus(seed) + HARD + CHAIN
    assert run(docs_of(rows)) == brute(rows)


def test_small_shards_and_hot_borders(docs_of, monkeypatch):
    rows = corpus(3) + HARD + [(7000 + i, "prefix" + "".join(random.Random(i // 2).choices("abc", k=4)) + " ") for i in range(200)]
    want = brute(rows)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 16)
    monkeypatch.setattr(spelling, "PAIRS", 4)
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    monkeypatch.setattr(spelling, "PIECE_CHARS", 10)
    assert run(docs_of(rows)) == want


def test_repeated_rows_and_empty_table(docs_of):
    rows = [(1, "Letters of letterz")] * 3
    assert run(docs_of(rows)) == brute(rows)
    assert run(docs_of([])) == [] and run(docs_of([(1, None), (2, "")])) == []


def test_near_is_one_edit():
    rng = random.Random(5)

    def distance_one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for n, m in ((4, 4), (4, 5), (5, 4)):
        a = ["".join(rng.choices("ab", k=n)) for _ in range(300)]
        b = ["".join(rng.choices("ab", k=m)) for _ in range(300)]
        every = np.arange(300)
        got = spelling._near(spelling._matrix(a, every, n), spelling._matrix(b, every, m))
        assert got.tolist() == [distance_one(x, y) for x, y in zip(a, b)]


def test_chain_of_forms_longer_than_one_round(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(6)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(links, 2 * 10**6).collect()} == {(f"w{i}", "w6") for i in range(6)}


def test_long_text(docs_of):
    rows = [(1, "wonderful wonderfull " * 250_000), (2, "q" * 5_000_000), (3, " " * 5_000_000)]
    got = {r[0]: r[3:5] for r in run(docs_of(rows))}
    assert got == {r[0]: r[3:5] for r in brute(rows)}


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op11_spelling_variants(spark, sf).collect()), key=str) == brute(rows)


def test_parts_of_a_border_in_one_shard(docs_of, monkeypatch):
    """Many words with one beginning: its parts share the few shards there are, and no pair counts twice."""
    rng = random.Random(11)
    words = {"pre" + "".join(rng.choices("abc", k=k)) for k in (4, 5, 6) for _ in range(60)}
    rows = [(i, " ".join(sorted(words))) for i in range(4)]
    monkeypatch.setattr(spelling, "SHARD_WORDS", 200)
    assert run(docs_of(rows)) == brute(rows)
