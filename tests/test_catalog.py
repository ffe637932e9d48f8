"""Every query of the catalogue against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_reruns_alike(spark, sf_dir, name):
    first, again = (sorted(map(str, catalog.QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first and first == again


def test_lineup_replay_gets_every_line_item(spark, sf_dir, monkeypatch):
    seen = []
    replay = catalog.filters.replay_lineups
    monkeypatch.setattr(catalog.filters, "replay_lineups", lambda starters, moments, *a, **k: seen.append(moments) or replay(starters, moments, *a, **k))
    assert catalog.lineup_replay(spark, sf_dir).count() > 0
    lines = catalog.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), "l_orderkey", F.col("l_suppkey").alias("player")).distinct()
    marks = seen[0].select("year", "l_orderkey", F.explode(F.concat("outs", "ins")).alias("player"))
    assert marks.count() == lines.count() and not lines.exceptAll(marks).count()


def test_block_ridge_has_a_coefficient_a_supplier(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r["entity"] for r in catalog.block_ridge(spark, sf_dir).where("block = 'supplier'").collect()}
    want = {str(r[0]) for r in catalog.table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().collect()}
    assert len(want) > 50 and got == want
