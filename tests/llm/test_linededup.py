import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import linededup
from offerlens.llm.queries import op9_line_dedup

LONG = "This Passage is long enough to count as a shared line of text"


def brute(rows, chars=40, docs=5):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\v\f\r").translate(upper)
    held = defaultdict(set)
    for i, (d, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add((float("-inf") if d is None else d, i))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= docs and max(held[key(x)])[0] != (float("-inf") if d is None else d))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    rows = linededup.dedup(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()
    return sorted(map(tuple, rows), key=str)


ROWS = (
    [(i, f"own line {i}\n  {LONG.upper() if i % 2 else LONG}\t\nend") for i in range(20)]
    + [(100 + i, f"{'é' * 40}\n\n{'É' * 40}") for i in range(6)]
    + [(200 + i, "a line of forty characters, held by four") for i in range(4)]
    + [(300, None), (301, ""), (302, "\n\n"), (None, LONG), (304, "x" * 100_000 + "\n" + LONG), (305, (LONG + "\n") * 3000)]
)


def test_against_brute_force(docs_of):
    assert run(docs_of(ROWS)) == brute(ROWS)


def test_repeated_rows_and_empty_table(docs_of):
    rows = [(7, LONG)] * 3 + [(1, LONG), (2, LONG)]
    assert run(docs_of(rows)) == brute(rows)
    assert linededup.dedup(docs_of([])).collect() == []


def test_other_columns_stay(docs_of):
    df = docs_of(ROWS)
    out = linededup.dedup(df)
    assert set(df.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))


def test_insert_and_delete_are_reversible(spark, docs_of):
    state = linededup.postings(docs_of(ROWS))
    before = sorted(map(tuple, state.collect()), key=str)
    more = docs_of([(9000 + i, LONG + "\n" + "another shared line that is long enough for it") for i in range(8)])
    grown = linededup.insert(state, more)
    assert grown.count() == len(before) + 16
    back = linededup.delete(grown, more)
    assert sorted(map(tuple, back.select("doc_id", "k1", "k2").collect()), key=str) == before
    counts = {(r["k1"], r["k2"]): (r["n_docs"], r["keeper"]) for r in linededup.reference_counts(grown).collect()}
    a, b = linededup.key_hashes(LONG.encode())
    assert counts[(a, b)] == (31, 9007)


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 20_000, dtype=np.int64)
    made = linededup.CuckooFilter.of(keys)
    assert made.contains(keys).all()
    others = np.random.default_rng(1).integers(-(2**63), 2**63, 50_000, dtype=np.int64)
    assert made.contains(others).mean() < 0.001
    for k in keys[:10_000].tolist():
        assert made.delete(k)
    assert made.contains(keys[10_000:]).all() and made.contains(keys[:10_000]).mean() < 0.001
    assert (linededup.CuckooFilter.load(made.dump()).table == made.table).all()


def test_filters_follow_changes(spark):
    start = spark.createDataFrame([(i,) for i in range(1000)], "k1 long")
    made = linededup.filters(start, 4)
    added, removed = spark.createDataFrame([(5000,)], "k1 long"), spark.createDataFrame([(7,)], "k1 long")
    now = {r["shard"]: linededup.CuckooFilter.load(bytes(r["filter"])) for r in linededup.update_filters(made, added, removed, 4).collect()}
    has = lambda k: now[k % 4].contains(np.array([k]))[0]
    assert has(5000) and not has(7) and all(has(k) for k in range(1000) if k != 7)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op9_line_dedup(spark, sf).collect()), key=str) == brute(rows)


def test_index_follows_changes_like_a_rebuild(spark, docs_of, monkeypatch):
    """Insert, delete and insert again: the same drops, tables and filter answers as from scratch, over shards that fill up."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", 40)
    line = lambda k: f"shared line number {k:04} that is long enough to count"
    first = [(i, "\n".join(line(k) for k in range(30))) for i in range(6)]
    more = [(100 + i, "\n".join(line(k) for k in range(20, 260))) for i in range(5)] + [(None, line(1)), (100, line(2))]
    one = linededup.Index.of(docs_of(first))
    two = one.insert(docs_of(more))
    three = two.delete(docs_of(more[:3] + more[-1:]))
    four = three.insert(docs_of(more[:3] + more[-1:]))
    for index, rows in ((one, first), (two, first + more), (three, first + more[3:-1]), (four, first + more)):
        fresh = linededup.Index.of(docs_of(rows))
        plain = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert plain(index.postings.select("doc_id", "k1", "k2")) == plain(fresh.postings.select("doc_id", "k1", "k2"))
        assert plain(index.dropped.select("k1", "k2", "n_docs", "keeper")) == plain(fresh.dropped.select("k1", "k2", "n_docs", "keeper"))
        held = {r["shard"]: linededup.CuckooFilter.load(bytes(r["filter"])) for r in index.filters.collect()}
        keys = [r["k1"] for r in index.dropped.select("k1").collect()]
        assert all(held[k % index.shards].contains(np.array([k]))[0] for k in keys)
        assert sum(np.count_nonzero(f.table) for f in held.values()) == len(keys)  # nothing stays behind
        assert plain(index.drops()) == plain(fresh.drops())
        done = linededup.apply(docs_of(rows), index.drops()).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
        assert sorted(map(tuple, done.collect()), key=str) == brute(rows)


def test_full_shard_is_built_anew(spark):
    made = linededup.filters(spark.range(10).select(F.col("id").alias("k1")), 1)
    added = spark.range(10, 5000).select(F.col("id").alias("k1"))
    with pytest.raises(Exception, match="is full"):
        linededup.update_filters(made, added, added.limit(0), 1).collect()
    row = linededup.update_filters(made, added, added.limit(0), 1, spark.range(5000).select(F.col("id").alias("k1"))).collect()
    assert len(row) == 1 and linededup.CuckooFilter.load(bytes(row[0]["filter"])).contains(np.arange(5000)).all()


def test_hot_and_null_ids(spark, docs_of, monkeypatch):
    rows = [(None, LONG + f"\nown {i}") for i in range(300)] + [(5, LONG + f"\nmine {i}") for i in range(300)] + [(i, LONG) for i in range(3)]
    small, real = [], linededup.common.heated_lookup
    monkeypatch.setattr(linededup.common, "heated_lookup", lambda a, b, k: small.append(real(a, b, k, most=50)) or small[-1])
    assert run(docs_of(rows)) == brute(rows)
