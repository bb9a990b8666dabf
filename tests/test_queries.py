"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k.startswith("q_")}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(columns).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k.startswith("q_") and k not in ORACLE))
def test_without_sql(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_lot_has_its_estimate(spark):
    from offerlens.plans.decision_queries import q_cheap_lots

    sizes = {r["p_partkey"]: r["p_size"] * 10 for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    rows = q_cheap_lots(spark, "/root/testdata/sf0.001").collect()
    assert {r["p_partkey"]: r["estimated_card_count"] for r in rows} == sizes and any(not r["cheap"] for r in rows)


def test_names_alike_meet_known_names_once(spark, tmp_path):
    from offerlens.plans import queries

    rows = [(i, f"red {('ring', 'bolt')[i % 2]}", f"Brand#{i % 3}") for i in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    for query in (queries.q_token_jaccard, queries.q_token_overlap):
        found = query(spark, str(tmp_path))
        lines = [x.strip(" :+-") for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
        at = next(i for i, x in enumerate(lines) if x.startswith("Generate") and "p_name" in x)
        assert lines[at + 1].startswith("Aggregate [p_name")  # words are taken of names, not of 600 parts
        assert {(r["p_partkey"], r["known"], r["score"]) for r in found.collect()} == {(i, n, 1.0) for i, n, _ in rows}
