import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from offerlens.llm import packing
from offerlens.llm.queries import op1_best_fit_packing, tokenizer_path

CAPACITY = 1024


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def check(rows, docs, tokenizer, capacity=CAPACITY):
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {d for d, _ in docs}
    for d, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(got[d], key=lambda r: r["piece"])
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in parts] == [(i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_edge_cases(spark, docs_of, tokenizer):
    texts = [None, "", " ", "a", "two words", "<|endoftext|> is text", "a  b\n\n c\t\td ", "é" * 3000, "word " * 5000, "\n x", "don't", "x  y", "　a b", "tail ", "a \n b"]
    docs = list(enumerate(texts))
    rows = packing.pack(docs_of(docs), tokenizer_path()).collect()
    check(rows, docs, tokenizer)


def test_empty_table_and_repeated_rows(spark, docs_of):
    assert packing.pack(docs_of([]), tokenizer_path()).collect() == []
    rows = packing.pack(docs_of([(1, "same text")] * 5 + [(None, "x")]), tokenizer_path(), with_ids=True).collect()
    assert len(rows) == 6 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 6
    assert all(len(r["ids"]) == r["length"] for r in rows)


def test_whole_table(spark, sf, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = op1_best_fit_packing(spark, sf).collect()
    used = check(rows, docs, tokenizer)
    assert used <= math.ceil(sum(r["length"] for r in rows) / CAPACITY) * 1.03 + 1


def test_words_encode_as_texts(tokenizer):
    encode = packing.TextEncoder(tokenizer_path())
    rng = random.Random(0)
    alphabet = ["a", "B", "é", "7", " ", "  ", "\n", "\t", "'s", ".", "%%", "日", " ", "ll", "'", "\r\n", "<|endoftext|>"]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
def test_plan_places_every_piece_once(counts):
    rows, sequences = packing.plan_rows(counts, 64, groups=8)
    fill, places = {}, {}
    for length, rank, count, each, first, offset, step in rows:
        for k in range(count):
            places.setdefault(length, []).append(rank + k)
            fill.setdefault(first + k // each, []).append((offset + k % each * step, length))
    assert {n: sorted(r) for n, r in places.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert len(fill) == sequences >= -(-sum(n * c for n, c in counts.items()) // 64)
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64


def test_configurations_reach_the_bound():
    found = packing.configurations([50, 30, 20], [100, 100, 100], 100)
    assert sum(t for _, t in found) == pytest.approx(100, abs=1e-6)


def test_one_id_for_all_rows(spark, docs_of, tokenizer):
    """Nothing tells the rows apart; buckets stay even."""
    for doc_id in (None, 7):
        rows = packing.pack(docs_of([(doc_id, "same text")] * 6000 + [(doc_id, "")] * 6000), tokenizer_path(), bucket_rows=100).collect()
        assert len(rows) == 12_000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 12_000
        fill = {}
        for r in rows:
            fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
        assert max(fill.values()) <= CAPACITY and len(fill) == math.ceil(sum(fill.values()) / CAPACITY)


def test_configurations_come_near_the_bound():
    rng = random.Random(2)
    for _ in range(20):
        sizes = sorted(rng.sample(range(200, 1000), rng.randint(1, 40)), reverse=True)
        demand = [rng.randint(1, 5000) for _ in sizes]
        found = packing.configurations(sizes, demand, CAPACITY)
        for i, n in enumerate(demand):
            assert sum(c[i] * x for c, x in found) >= n - 1e-3
        assert all(sum(a * b for a, b in zip(c, sizes, strict=True)) <= CAPACITY for c, _ in found)
        halves = sum(n for s, n in zip(sizes, demand, strict=True) if s > CAPACITY / 2)
        bound = max(halves, sum(a * b for a, b in zip(sizes, demand, strict=True)) / CAPACITY)
        assert sum(x for _, x in found) <= 1.35 * bound
