"""Building blocks against brute force: averages, ranks, the normal distribution, rounding."""

import datetime as dt
import random
from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.ewm import with_ewms
from tidemark.functions.frames import rnd, with_lead_split
from tidemark.functions.normal import norm_cdf, norm_ppf
from tidemark.functions.ranks import _place, split_points, with_rank_stats


def test_ewm_over_several_blocks_equals_pandas(spark):
    rng = random.Random(1)
    pdf = pd.DataFrame({"ticker": [1] * 2600 + [2] * 40, "rn": list(range(1, 2601)) + list(range(1, 41))})
    pdf["d"] = pdf["rn"]
    pdf["x"] = [100 + rng.gauss(0, 5) for _ in range(len(pdf))]
    got = with_ewms(spark.createDataFrame(pdf), {"fast": ("x", 1 / 3), "slow": ("x", 2 / 201)}).toPandas().sort_values(["ticker", "d"])
    for t, g in got.groupby("ticker"):
        for name, a in (("fast", 1 / 3), ("slow", 2 / 201)):
            want = g["x"].ewm(alpha=a, adjust=False).mean()
            assert (g[name] - want).abs().max() < 1e-9, (t, name)


def test_rank_stats_with_a_third_of_all_rows_on_one_value(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else "cold", 7.0 if rng.random() < 0.34 else rng.uniform(-1e6, 1e3)) for _ in range(3000)] + [("hot", None)]
    got = with_rank_stats(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").toPandas()
    for g, x in got.groupby("g"):
        v = x["v"].dropna()
        for _, r in x.dropna(subset=["v"]).sample(60, random_state=1).iterrows():
            assert r["n"] == len(v) and r["n_less"] == (v < r["v"]).sum() and r["n_equal"] == (v == r["v"]).sum()
    assert got[got["v"].isna()]["n"].isna().all()


def test_rank_parts_are_even_for_a_skewed_distribution(spark):
    """Values over six decades: no part holds 2 % of them, and ranks are exact, with and without keys."""
    rng = random.Random(3)
    rows = [("a", 10 ** rng.gauss(0, 1.5)) for _ in range(5000)] + [("b", float(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v double")
    hist = df.groupBy("g", F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parts = hist.join(split_points(hist, ["g"], "_v"), "g").select("g", _place(F.col("_v"), F.col("_splits")).alias("part"))
    sizes = [r["count"] for r in parts.where("g = 'a'").groupBy("part").count().collect()]
    assert max(sizes) < 0.02 * 5000 and len(sizes) > 200
    for keys in (["g"], []):
        got = with_rank_stats(df, keys, "v").toPandas()
        for _, x in got.groupby("g") if keys else [(0, got)]:
            assert (x["n_less"] == x["v"].rank(method="min") - 1).all() and (x["n"] == len(x)).all()


def test_leads_of_a_key_with_half_of_all_rows(spark):
    """Blocks with halos give the rows of a plain window, also where blocks hold fewer rows than the lead."""
    rng = random.Random(5)
    rows = [(1 if i % 2 else 2 + i % 40, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(2_000_000) if i % 7 else 777), i, float(i % 11)) for i in range(6000)]
    df = spark.createDataFrame(rows, "ticker long, ts timestamp, id long, x double")
    want = df.withColumn("y", F.lead("x", 5).over(Window.partitionBy("ticker").orderBy("ts", "id")))
    got = with_lead_split(df, "ticker", ["ts", "id"], "x", 5, "y", rows=100).select(*want.columns)
    key = lambda r: (r[0], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    for limit in (3, 100_000):
        got = with_lead_split(df.where("id < 900"), "ticker", ["ts", "id"], "x", 5, "y", rows=limit)
        assert got.count() == 900 and got.where("y is null").count() == df.where("id < 900").groupBy("ticker").count().agg(F.sum(F.least(F.lit(5), "count"))).first()[0]


def test_normal_distribution(spark):
    xs = [-6.0, -2.5, -0.3, 0.0, 0.7, 3.1, 6.5]
    ps = [1e-6, 0.01, 0.3, 0.5, 0.84, 0.999]
    n = NormalDist()
    a = spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p")).collect()
    b = spark.createDataFrame([(p,) for p in ps], "p double").select("p", norm_ppf(F.col("p")).alias("x")).collect()
    assert all(abs(r["p"] - n.cdf(r["x"])) < 1e-12 for r in a)
    assert all(abs(r["x"] - n.inv_cdf(r["p"])) < 1e-7 for r in b)


@pytest.mark.parametrize("x,places,want", [(0.125, 2, 0.13), (-0.125, 2, -0.12), (2.5, 0, 3.0)])
def test_half_up(spark, x, places, want):
    assert spark.range(1).select(rnd(F.lit(x), places).alias("y")).first()["y"] == want
