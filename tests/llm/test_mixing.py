import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from offerlens.llm import mixing
from offerlens.llm.queries import op7_curriculum_mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        left = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def brute(rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for doc_id, text, _, source in rows:
        by[source].append((doc_id, words(text)))
    sizes = {s: sum(n for _, n in v) for s, v in by.items()}
    target, out = brute_targets(sizes), {}
    for s, docs in by.items():
        docs.sort(key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest())
        passes = int(target[s] / sizes[s] + 1e-9) if sizes[s] else 0
        at = 0
        for d, n in docs:
            again = sizes[s] and at + n / 2 < target[s] - passes * sizes[s]
            out[d] = (n, sizes[s], target[s], n * (passes + bool(again)))
            at += n
    return out


ROWS = [(i, "w " * (i % 7) if i % 11 else None, "en", f"s{i % 5}" if i % 13 else None) for i in range(200)] + [(1000 + i, "x " * 90, "en", "hot") for i in range(150)]


def test_against_brute_force(docs_of):
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(docs_of(ROWS)).collect()}
    want = brute(ROWS)
    assert set(got) == set(want)
    for d, w in want.items():
        assert got[d][:2] == w[:2] and got[d][3] == w[3]
        assert got[d][2] == pytest.approx(w[2], rel=1e-9)


def test_taken_comes_near_targets_and_repeats_agree(docs_of):
    first, second = (mixing.mix(docs_of(ROWS)).collect() for _ in range(2))
    assert sorted(map(str, first)) == sorted(map(str, second))
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in first:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["copies"]
    for s in target:
        assert abs(taken[s] - target[s]) <= longest[s]


def test_positions_invert_the_schedule(spark):
    for knots in mixing.SCHEDULES:
        shares = [i / 20 for i in range(21)]
        got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.invert(F.col("s"), knots)).collect()]
        whole = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))

        def demand(t, knots=knots, whole=whole):
            done = 0.0
            for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
                x = min(max(t, t0), t1) - t0
                done += a * x + (b - a) / (t1 - t0) * x * x / 2
            return done / whole

        assert [demand(t) for t in got] == pytest.approx(shares, abs=1e-9)


def test_order_and_edges(docs_of):
    rows = mixing.ordered(mixing.mix(docs_of(ROWS))).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and all(0 <= r["position"] <= 1 for r in rows)
    assert mixing.mix(docs_of([])).collect() == []
    blank = mixing.mix(docs_of([(1, None), (2, ""), (None, " ")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in blank] == [(0, 0, 0.0)] * 3


def test_query_sorts_by_position(spark, sf):
    """The query's rows stand in training order, so it computes the schedules."""
    mixed = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    want = sorted(mixed, key=lambda r: (not r["positions"], r["positions"], r["doc_id"]))
    assert [r["doc_id"] for r in op7_curriculum_mixing(spark, sf).collect()] == [r["doc_id"] for r in want]


def test_first_position_of_the_query_against_an_integral(spark, sf):
    """Positions by bisection over the numerically integrated schedule, from the running counts of the brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    names = sorted({r["source"] for r in docs if r["source"] is not None}) + [None]
    by = defaultdict(list)
    for r in docs:
        by[r["source"]].append(r["doc_id"])
    got = {r["doc_id"]: r for r in op7_curriculum_mixing(spark, sf).collect()}
    steps = 20_000
    for source, ids in by.items():
        knots = mixing.SCHEDULES[names.index(source) % 3]
        weight = lambda t, k=knots: next(a + (b - a) * (t - t0) / (t1 - t0) for (t0, a), (t1, b) in zip(k, k[1:], strict=False) if t <= t1)
        done = [0.0]
        for i in range(steps):
            done.append(done[-1] + weight((i + 0.5) / steps) / steps)
        at = 0
        for d in sorted(ids, key=lambda d: hashlib.md5(str(d).encode()).hexdigest()):
            row = got[d]
            if row["taken"] or row["position"] is not None:
                share = at / row["target"] * done[-1]
                low = next((i for i in range(steps + 1) if done[i] >= share - 1e-12), steps) / steps
                assert abs(row["position"] - low) < 2e-3
            at += words[d]


def test_rows_stand_in_order_of_position(spark, sf):
    positions = [r["position"] for r in op7_curriculum_mixing(spark, sf).collect()]
    known = [p for p in positions if p is not None]
    assert known == sorted(known) and None not in positions[: len(known)]


def test_hot_and_null_ids(docs_of):
    rows = [(7, "w " * (1 + i % 3), "en", "a") for i in range(4000)] + [(None, f"x{i} y", "en", "a") for i in range(2000)] + [(i, "z " * 5, "en", "b") for i in range(500)]
    docs = docs_of(rows)
    plain, split = (mixing.mix(docs, bucket_rows=n).collect() for n in (20_000, 10))
    for found in (plain, split):
        taken = defaultdict(int)
        for r in found:
            taken[r["source"]] += r["taken"]
        target = {r["source"]: r["target"] for r in found}
        assert len(found) == len(rows) and all(abs(taken[s] - target[s]) <= 5 for s in target)
        starts = sorted(p for r in found if r["source"] == "a" for p in r["positions"])
        assert len(set(starts)) == len(starts)  # running counts leave no two copies at one place
