"""Steps whose work or memory must not grow faster than their input."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.frames import full, last_n, with_pair_rolled, with_returns, with_rolled, with_rolled_max
from tidemark.operators import joins, news, technical, volatility
from tidemark.sources import views

DAY0 = date(2000, 1, 1)


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def closes(spark, n=300):
    rng = random.Random(3)
    rows = [(t, DAY0 + timedelta(days=i), None if t == 2 and i % 97 == 50 else 0.25 if t == 3 else rng.gauss(0, 0.02)) for t in (1, 2, 3, None) for i in range(n)]
    return spark.createDataFrame(rows, "ticker long, d date, r double")


def test_rolled_equals_full_frames(spark, capsys):
    b, sizes = closes(spark), (5, 10, 21, 63, 126, 252)
    want = b.select("ticker", "d", *[full(f, "r", n).alias(f"w{k}_{n}") for n in sizes for k, f in (("s", F.sum), ("d", F.stddev_samp))])
    got = with_rolled(b, "r", sizes, "x").withColumnRenamed("ticker", "t").withColumnRenamed("d", "e")
    both = want.join(got, F.col("ticker").eqNullSafe(F.col("t")) & (F.col("d") == F.col("e"))).collect()
    assert len(both) == 1200
    for r in both:
        for n in sizes:
            for k in "sd":
                assert r[f"x{k}_{n}"] == (None if r[f"w{k}_{n}"] is None else pytest.approx(r[f"w{k}_{n}"], abs=1e-12))
            if r["ticker"] == 3 and r[f"xd_{n}"] is not None:
                assert r[f"xd_{n}"] == 0.0
    assert "-251" not in plan(technical.tsmom(b), capsys)  # no frame that is gone through for each row


def test_pair_moments_equal_frames(spark, capsys):
    from pyspark.sql import Window

    b = closes(spark).where("ticker = 1").withColumn("y", F.col("r") * 0.5 + F.sin(F.dayofyear("d")) / 50)
    w = Window.partitionBy("ticker").orderBy("d").rowsBetween(-125, 0)
    x = with_pair_rolled(b, "r", "y", 126).withColumn("cov", F.covar_samp("r", "y").over(w)).withColumn("var", F.var_pop("y").over(w))
    rows = x.orderBy("d").collect()
    assert [r["_x"] is None for r in rows] == [i < 125 for i in range(300)]
    for r in rows[125:]:
        assert r["_x"]["qxy"] / 125 == pytest.approx(r["cov"], abs=1e-12) and r["_x"]["qyy"] / 126 == pytest.approx(r["var"], abs=1e-12)
    market = b.select("d", F.col("y").alias("mr"))
    assert "-125" not in plan(technical.residual_momentum(b, market), capsys)


def test_rolled_max_equals_frame_and_panel_has_no_year_long_frame(spark, capsys, monkeypatch):
    from tidemark.plans import q_96_models

    b = closes(spark).where("ticker is not null")
    x = with_rolled_max(b, "r", 252, "top").withColumn("want", F.max("r").over(last_n(252))).collect()
    assert len(x) == 900 and all(r["top"] == r["want"] for r in x)
    bars = with_returns(b.select("ticker", "d", (100 + F.col("r")).alias("c"), F.lit(1.0).alias("v")))
    monkeypatch.setattr(q_96_models, "rets", lambda s, d: bars)
    assert "-251" not in plan(q_96_models.panel(spark, ""), capsys) + plan(q_96_models.feature_matrix(spark, ""), capsys)


def test_fracdiff_orders_share_the_partitions_of_the_bars(spark, capsys):
    rng = random.Random(5)
    rows = [(t, DAY0 + timedelta(days=i), 100 + rng.random() * 10) for t in (1, 2) for i in range(120)]
    b = with_returns(spark.createDataFrame(rows, "ticker long, d date, c double"))
    assert plan(volatility.fracdiff_min_d(b), capsys).count("Exchange") == 1


def test_large_tables_are_dealt_to_bounded_tasks(spark, tmp_path, monkeypatch):
    rows = [(1, i % 5, DAY0 + timedelta(days=i % 11), 100.0 + i, float(1 + i % 7)) for i in range(200)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    small = sorted(map(tuple, views.bars(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(views, "task_parts", lambda rows: 13)
    b = views.bars(spark, str(tmp_path))
    assert b.rdd.getNumPartitions() == 13 and sorted(map(tuple, b.collect())) == small


def test_points_are_not_sent_to_every_day(spark, capsys):
    b = spark.createDataFrame([(1, DAY0 + timedelta(days=i), float(i)) for i in range(0, 60, 7)] + [(None, DAY0, 5.0)], "ticker long, d date, c double")
    p = spark.createDataFrame([(t, DAY0 + timedelta(days=i)) for t in (1, None) for i in range(-15, 75)] + [(1, None)], "ticker long, x date")
    for f, side in ((joins.close_on_or_after, 1), (joins.close_on_or_before, -1)):
        got = {(r["ticker"], r["x"]): r["c"] for r in f(b, p).collect()}
        assert len(got) == 181 and got[1, None] is None
        for i in range(-15, 75):
            near = [abs(k - i) for k in range(0, 60, 7) if 0 <= (k - i) * side <= 10]
            assert got[1, DAY0 + timedelta(days=i)] == (float(i + side * min(near)) if near else None) and got[None, DAY0 + timedelta(days=i)] is None
        assert "sequence(" not in plan(f(b, p), capsys)


def test_copies_of_a_title_make_no_pairs(spark):
    a = spark.createDataFrame([(1, i, 1.0, "quarter results beat every estimate") for i in range(40)] + [(1, 99, 0.5, "merger talks ended without agreement"), (None, 7, 1.0, "same title here twice"), (None, 8, 1.0, "same title here twice")], "day int, doc_id long, score double, title string")
    _, copies, pairs, _ = news.clashing_titles(a, ["day"], "score", lambda df, name: df.localCheckpoint())
    assert pairs.count() == 0 and copies.count() == 39
    assert {r["doc_id"] for r in news.dedupe_stories(a, ["day"], "score").collect()} == {0, 99, 7, 8}


def test_titles_of_a_crowded_day_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(news, "BLOCK_WORDS", 1200)
    r = random.Random(11)
    rows = [(d, i, r.choice([1.0, 2.0, 3.0]), " ".join(r.sample([f"word{k}" for k in range(40)], r.randint(1, 9)))) for d, n in ((1, 220), (2, 30)) for i in range(n)]
    rows += [(1, 7, rows[7][2], "other words stand under that number")]  # a number that comes twice: its titles do not drop one another
    a = spark.createDataFrame(rows, "day int, doc_id long, score double, title string")
    written = {}
    put = lambda df, name: written.setdefault(name, df.localCheckpoint())
    _, _, pairs, sets = news.clashing_titles(a, ["day"], "score", put)
    assert {x["day"]: x["blocks"] for x in written["story-blocks"].collect()} == {1: 4, 2: 1}
    assert max(x.count() for name, x in written.items() if name != "story-pairs") <= len(rows)  # no row per word
    ids = {x["sid"]: (x["day"], x["id"]["o"], x["id"]["doc_id"], frozenset(x["w"])) for x in written["story-sets"].collect()}
    ranked = sorted(ids)
    assert [ids[s][1:3] for s in ranked] == sorted(x[1:3] for x in ids.values()) and {x["sid"] for x in sets.collect()} == set(ids)
    clash = lambda x, y: x[0] == y[0] and x[1:3] != y[1:3] and len(x[3] & y[3]) / min(len(x[3]), len(y[3])) > 0.45
    want = sorted((s, t) for k, s in enumerate(ranked) for t in ranked[k + 1:] if clash(ids[s], ids[t]))
    assert sorted((x["one"], x["other"]) for x in pairs.collect()) == want and len(want) > 1000


def test_runs_of_pairs_are_bounded(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tidemark.functions import overlaps

    monkeypatch.setattr(overlaps, "CHUNK", 8)
    r = random.Random(4)
    sets = [r.sample([f"w{k}" for k in range(30)], r.randint(1, 20)) for _ in range(60)]
    n = np.arange(60)
    for cross in (False, True):
        runs = [[*zip(i.tolist(), j.tolist())] for i, j in overlaps.overlapping(pa.array(sets, pa.list_(pa.string())), n, n % 2, n, 0.45, cross)]
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if ((i + j) % 2 == 1) == cross and len({*sets[i]} & {*sets[j]}) / min(len(sets[i]), len(sets[j])) > 0.45}
        got = [tuple(sorted(p)) for run in runs for p in run]
        assert {*got} == want and len(got) == len(want) and max(map(len, runs)) <= 8


def test_bodies_are_read_once_and_not_shuffled(spark, capsys, monkeypatch, tmp_path):
    from tidemark.functions import text
    from tidemark.plans import load_all

    docs = [(i, "Title of words\nBody about Earnings" if i else None, "src1") for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    seen = []
    monkeypatch.setattr(news, "dedupe_stories", lambda a, key, score: seen.append(a) or a)
    load_all()["greedy_dedupe_story"].build(spark, str(tmp_path))
    whole = views.articles(spark, str(tmp_path))
    assert sorted(x["doc_id"] for x in seen[0].collect()) == sorted(x["doc_id"] for x in whole.collect()) == [0, 1, 1, 2, 3]  # an article with two labels stays two rows
    node = seen[0]._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert "sc#" in node.left().output().mkString(" ") and "text#" not in node.left().output().mkString(" ")
    scored = whole.select(text.materiality(F.col("title"), F.col("body"), F.col("publisher")).alias("score"))
    assert plan(scored, capsys).count("lower(") <= 3
