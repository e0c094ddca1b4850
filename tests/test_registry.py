"""The registry, its contract, and a sample of queries against their oracle SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tidemark.plans import load_all
from tools.check import TABLES, compare

DATA = "/root/testdata/sf0.001"
SAMPLE = ["view_bars", "rsi", "asof_latest_filed", "q4_synthesis", "cs_rank_minmax", "insider_cluster", "purged_kfold", "max_pain", "score_signal", "quality_scorecard", "top_per_publisher_cap"]


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 300
    for name, query in load_all().items():
        cols = [c for c, _ in query.cols]
        assert len(cols) == len(set(cols)), name


def test_no_row_caps_or_hints_in_the_library():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tidemark")
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert "broadcast(" not in text and ".localCheckpoint" not in text and ".toPandas(" not in text, f


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [c[0] for c in cur.description]) is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ticker", "horizon", "composite", "rank"] and df.count() > 0
