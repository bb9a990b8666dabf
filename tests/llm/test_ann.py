import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import ann
from offerlens.llm.queries import op2_multiprobe_lsh


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(vectors, queries, k=10):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype="f8")
    out = {}
    for q in queries:
        d = np.sqrt(((x - np.array(vectors[q], dtype="f8")) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(r + 1, int(ids[i]), float(d[i])) for r, i in enumerate(order)]
    return out


def lists(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_and_exact_scores_on_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.float32(r["embedding"]) for r in rows}
    want = brute(vectors, [i for i in vectors if i % 100 == 0])
    got = lists(op2_multiprobe_lsh(spark, sf).collect())
    assert set(got) == set(want)
    hits = [len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    for q in got:
        assert [r for r, _, _ in got[q]] == list(range(1, len(got[q]) + 1))
        for _, v, score in got[q]:
            d = np.sqrt(((vectors[v].astype("f8") - vectors[q].astype("f8")) ** 2).sum())
            assert score == pytest.approx(d, rel=1e-14, abs=0)


def test_clusters_are_found_without_the_exact_way(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(v) for v in np.float32(centres[i % 30] + rng.normal(size=16) * 0.05)], 0) for i in range(3000)]
    got = lists(ann.nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect())
    want = brute({r[0]: r[1] for r in rows}, list(got))
    assert len(got) == 30 and np.mean([len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) / 10 for q in got]) >= 0.9


def test_bad_vectors_ties_copies_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0), (6, [], 0), (7, [1.0, 2.0, 3.0], 0), (None, [1.0, 0.0], 0), (9, [1.0, -0.0], 0), (10, [1.0, 1.0], 0), (11, [1.0, -1.0], 0), (11, [1.0, -1.0], 0), (100, [2.0, 0.0], 0), (200, [nan, nan], 0)]
    got = lists(ann.nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert set(got) == {0, 100}
    assert got[0] == [(1, 9, 0.0), (2, 10, 1.0), (3, 11, 1.0), (4, 100, 1.0)]
    assert [v for _, v, _ in got[100]] == [0, 9, 10, 11]
    assert ann.nearest(table(spark, []), F.lit(True)).collect() == []


def test_hot_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(1500)] + [(1500 + i, [1.0, 2.0, float(i)], 0) for i in range(300)]
    got = lists(ann.nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert len(got) == 18
    for q in range(0, 1500, 100):
        assert [v for _, v, _ in got[q]] == [i for i in range(12) if i != q][:10] and {s for _, _, s in got[q]} == {0.0}


def test_probes_come_in_order_of_estimated_success():
    h = ann.Hash(8, 0, 5, 1.0)
    x = np.random.default_rng(1).normal(size=(1, 8))
    slots, above = h.slots(x)
    assert (above >= 0).all() and (above < 1).all()
    few, many = h.probe_keys(x, 5)[0], h.probe_keys(x, 50)[0]
    assert len(few) == 5 and len(many) == 50 and set(few) <= set(many) and h.keys(slots)[0] in few


def test_rows_that_share_an_id(spark):
    rng = np.random.default_rng(3)
    rows = [(100, [float(x) for x in np.float32(rng.normal(size=8))], 0) for _ in range(8)] + [(i, [float(x) for x in np.float32(rng.normal(size=8))], 0) for i in range(1, 41)] + [(7, [float(x) for x in np.float32(rng.normal(size=8))], 0)]
    got = lists(ann.nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect())
    mine = [np.array(v) for i, v, _ in rows if i == 100]
    near = {i: min(np.sqrt(((np.array(v) - m) ** 2).sum()) for j, v, _ in rows if j == i for m in mine) for i in range(1, 41)}
    want = sorted((d, i) for i, d in near.items())[:10]
    assert [(r, v) for r, v, _ in got[100]] == [(k + 1, i) for k, (_, i) in enumerate(want)]
    assert [s for _, _, s in got[100]] == pytest.approx([d for d, _ in want], rel=1e-14)


def test_recall_and_share_of_candidates_on_a_larger_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r["vec_id"]: np.float32(r["embedding"]) for r in rows.collect()}
    got = lists(ann.nearest(rows, F.col("vec_id") % 50 == 0).collect())
    want = brute(vectors, list(got))
    assert np.mean([len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) / 10 for q in got]) >= 0.9


def test_doubles_keep_their_precision(spark):
    rows = [(0, [1.0, 1e-12], 0), (1, [1.0, 0.0], 0), (2, [1.0, 3e-12], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert lists(ann.nearest(df, F.col("vec_id") == 0).collect())[0] == [(1, 1, 1e-12), (2, 2, 3e-12 - 1e-12)]


def test_near_copies_do_not_narrow_the_slots(spark):
    """A tenth of the rows in tight groups: with slots fitted to the groups' distances all other queries would need the exact way."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    x[:600] = x[:3].repeat(200, axis=0) + rng.normal(size=(600, 32)) * 0.01
    rows = [(i, [float(v) for v in np.float32(v)], 0) for i, v in enumerate(x[rng.permutation(6000)])]
    is_query = F.col("vec_id") % 30 == 0
    found = ann.entries(ann.clean(table(spark, rows)), 10, is_query).cache()
    width = ann.slot_width(*ann.sample_neighbours(found, "<f4", 10), ann.PROBES, ann.TABLES, ann.HASHES, ann.RECALL)
    want = brute({r[0]: r[1] for r in rows}, range(0, 6000, 30))
    data, hit = np.array([r[1] for r in rows]), {(q, v): False for q in want for _, v, _ in want[q]}
    for t in range(ann.TABLES):
        h = ann.Hash(32, t, ann.HASHES, width)
        keys = h.keys(h.slots(data)[0])
        buckets = dict(zip(want, h.probe_keys(data[list(want)], ann.PROBES), strict=True))
        for q, v in hit:
            hit[q, v] |= bool(keys[v] in buckets[q])
    assert len(hit) == 2000 and np.mean(list(hit.values())) >= 0.9  # by the probes alone
    got = lists(ann.nearest(table(spark, rows), is_query).collect())
    assert np.mean([len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_slot_width_follows_the_scale_of_the_vectors():
    rng = np.random.default_rng(6)
    x, of = rng.normal(size=(40, 12)), np.repeat(np.arange(40), 5)
    y = x[of] + rng.normal(size=(200, 12)) * 0.2
    width = ann.slot_width(x, y, of, 30, 2, 6, 0.9)
    assert ann.slot_width(x * 1e6, y * 1e6, of, 30, 2, 6, 0.9) == pytest.approx(width * 1e6, rel=0.05)
    assert ann.slot_width(x, x[of], of, 30, 2, 6, 0.9) == 1.0  # no distances, as of no neighbours
    assert ann.slot_width(x, y[:0], of[:0], 30, 2, 6, 0.9) == 1.0


def test_more_hot_buckets_than_are_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=4) * (0.01 if i % 2 else 1)).tolist(), 0) for i in range(300)]
    monkeypatch.setattr(ann, "TILE", 16)
    got = []
    for most in (100_000, 0):
        monkeypatch.setattr(ann, "MOST_HOT", most)
        got.append(sorted(map(tuple, ann.nearest(table(spark, rows), F.col("vec_id") % 10 == 0, 5).collect())))
    assert got[0] == got[1] and len(got[0]) == 30 * 5
