import hashlib
import random

import numpy as np
import pytest

from offerlens.llm import suffixdedup
from offerlens.llm.queries import op13_suffix_array_dedup


def brute(rows, length=100):
    """The definition itself: doc_id, n_bytes, n_removed, n_spans, sha256."""
    seen, out = set(), [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        data = (rows[i][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)
        out[i] = (rows[i][0], len(data), int(gone.sum()), int(runs), hashlib.sha256(kept).hexdigest())
    return sorted(out, key=str)


def digest(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()), key=str)


def prose(rng, words):
    return " ".join(rng.choice("the of and alpha beta gamma delta müller straße zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(words))


def corpus(seed, n=120):
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (8, 12, 20, 60, 200)]
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            cut = rng.randint(0, len(part) // 2)
            text += rng.choice(["", "\n", " x "]) + part[cut : len(part) - rng.randint(0, 20)] + prose(rng, rng.randint(0, 10))
        rows.append((i, text))
    rows += [(n + i, rows[i][1]) for i in range(0, 30)]
    return rows


HARD = [
    (None, None), (900, ""), (901, "a" * 99), (902, "a" * 100), (903, "b" * 101), (904, "ab" * 400), (905, "x" * 3000), (906, "\x00" * 250 + "end"), (907, "\x00" * 120), (908, "é" * 300),
    (909, "0123456789" * 9 + "abcdefghij"), (910, "0123456789" * 9 + "abcdefghij"), (911, "z" + "0123456789" * 9 + "abcdefghij"), (None, "0123456789" * 9 + "abcdefghij" + "tail"), (7, "0123456789" * 30),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs_of, seed):
    rows = corpus(seed) + HARD
    assert digest(suffixdedup.remove(docs_of(rows))) == brute(rows)


def test_repeated_rows_and_empty_table(docs_of):
    text = prose(random.Random(3), 40)
    rows = [(5, text)] * 4 + [(None, text)] * 3 + [(1, text[30:])]
    assert digest(suffixdedup.remove(docs_of(rows).coalesce(1))) == brute(rows)
    assert suffixdedup.remove(docs_of([])).collect() == []


def test_small_blocks_shards_and_hot_keys(docs_of, monkeypatch):
    """Many blocks, levels and shards, and every key hot: the same result."""
    rows = corpus(4) + HARD
    want = brute(rows)
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffixdedup, "SHARD_KEYS", 64)
    monkeypatch.setattr(suffixdedup, "SHARD_CONTEXTS", 20)
    assert digest(suffixdedup.remove(docs_of(rows))) == want
    for hot in (0, 5):
        monkeypatch.setattr(suffixdedup, "HOT", hot)
        assert digest(suffixdedup.remove(docs_of(rows))) == want


def test_batches_give_what_one_gives(spark, docs_of, monkeypatch):
    """Three batches, not in the order of ids, with an index that outgrows its shards."""
    rows = corpus(5) + HARD
    monkeypatch.setattr(suffixdedup, "SHARD_KEYS", 200)
    order = rows[60:120] + rows[:60] + rows[120:]
    family = suffixdedup.Family.empty(spark)
    for part in (order[:60], order[60:100], order[100:]):
        family = family.insert(docs_of(part).coalesce(1))
    assert family.bits > 0 and digest(family.kept()) == brute(order)


def test_levels_are_geometric():
    rng = np.random.default_rng(0)
    family = suffixdedup.Levels([])
    for block in range(100):
        keys = np.unique(rng.integers(0, 2**63, 100, dtype=np.int64).astype(np.uint64))
        family.insert(keys, block, np.ones(len(keys), np.uint32))
        sizes = [len(x[0]) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and all((np.diff(x[0].astype(np.float64)) >= 0).all() for x in family.levels)
    assert sum(sizes) >= 9900 and len(sizes) <= 8


def test_equal_windows_have_equal_anchors():
    rng = random.Random(6)
    passage = prose(rng, 400).encode()
    a, b = prose(rng, 50).encode() + passage, prose(rng, 9).encode() + passage + b"!"
    where = {}
    for text in (a, b):
        key, place, begin, end = suffixdedup.anchors(np.frombuffer(text, np.uint8), np.array([len(text)]))
        assert begin[0] == 0 and end[-1] == len(text) - 100 and (begin[1:] == end[:-1] + 1).all()
        for k, p, x, y in zip(key.tolist(), place.tolist(), begin.tolist(), end.tolist()):
            for w in range(x, y + 1):
                assert w <= p <= w + 68
                assert where.setdefault(text[w : w + 100], (k, p - w)) == (k, p - w)


def test_long_texts(docs_of):
    """5 MB of one letter, of a period, and of blanks; a text that repeats itself."""
    rng = random.Random(7)
    half = prose(rng, 60_000)
    rows = [(1, "a" * 5_000_000), (2, "ab" * 2_500_000), (3, "\n" * 5_000_000), (4, half + half)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], len(r["kept"])) for r in suffixdedup.remove(docs_of(rows)).collect()}
    assert got[1] == (5_000_000, 4_999_999, 1, 1) and got[2] == (5_000_000, 4_999_998, 1, 2) and got[3] == (5_000_000, 4_999_999, 1, 1)
    n = len(half.encode())
    assert got[4][0] == 2 * n and got[4][1] >= n - 99


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op13_suffix_array_dedup(spark, sf).collect()), key=str) == brute(rows)
