"""Operators on small fixtures: look-ahead, as-of rules, labels, portfolio rules, text rules."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.frames import with_returns
from tidemark.operators import filters, joins, labels, news, portfolio, technical, windows
from tidemark.sources import stores

D0 = dt.date(2020, 1, 1)


def bars(spark, n=320, tickers=(1, 2), bump=None):
    rows = []
    for t in tickers:
        for i in range(n):
            c = 50.0 + t + 10 * ((i * 7919 + t * 31) % 97) / 97 + (bump or (lambda i: 0))(i)
            rows.append((t, D0 + dt.timedelta(days=i), c - 0.5, c + 1, c - 1, c, 100.0 + i % 13, 1 + i % 4))
    return spark.createDataFrame(rows, "ticker long, d date, o double, h double, l double, c double, v double, n long")


def test_features_do_not_move_when_the_future_changes(spark):
    cut = D0 + dt.timedelta(days=280)
    a, b = bars(spark), bars(spark, bump=lambda i: 25.0 if i > 280 else 0.0)
    for fn in (technical.momentum_price, technical.rsi, technical.macd, technical.bollinger, technical.drawdown_structure):
        x = fn(with_returns(a)).where(F.col("d") <= F.lit(cut)).toPandas().sort_values(["ticker", "d"]).reset_index(drop=True)
        y = fn(with_returns(b)).where(F.col("d") <= F.lit(cut)).toPandas().sort_values(["ticker", "d"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(x, y)


def test_short_history_gives_null_not_a_guess(spark):
    x = technical.momentum_price(with_returns(bars(spark, n=5))).toPandas()
    assert x.drop(columns=["ticker", "d"]).isna().all().all()
    y = technical.bollinger(with_returns(bars(spark, n=5))).toPandas()
    assert y["bb_pct_b_20"].isna().all() and (y["bb_squeeze_20"] == 0).all()


def test_asof_join_plain_and_bucketed_agree_with_brute_force(spark):
    left = [("a" if i % 3 else "b", i) for i in range(60)]
    right = [("a", i, float(i)) for i in range(0, 60, 7)] + [("b", 10, 1.0), ("b", 10, 2.0)]
    ldf, rdf = spark.createDataFrame(left, "k string, t int"), spark.createDataFrame(right, "k string, u int, v double")
    want = {(k, t): max([(u, v) for kk, u, v in right if kk == k and u <= t], default=(None, None))[1] for k, t in left}
    for bucket in (None, F.floor(F.col("_t") / 13)):
        got = joins.asof_join(ldf, rdf, "k", "t", "u", ["v"], bucket=bucket).collect()
        assert len(got) == len(left) and all(want[(r["k"], r["t"])] == r["v"] for r in got)


def test_forward_exit_needs_a_matured_window(spark):
    b = spark.createDataFrame([(1, D0 + dt.timedelta(days=i), 10.0 + i) for i in (0, 2, 30, 95)], "ticker long, d date, c double")
    p = spark.createDataFrame([(1, D0), (1, D0 + dt.timedelta(days=20))], "ticker long, x date")
    got = joins.forward_exit(b, p, 28, slip=5).collect()
    # from day 0: in at day 2, out at day 30; from day 20 the first close after day 48 is past the slip
    assert [(r["entry"], r["exit"]) for r in got] == [(12.0, 40.0)]


def test_slip_and_weekend(spark):
    b = spark.createDataFrame([(1, dt.date(2024, 1, 5), 10.0), (1, dt.date(2024, 1, 8), 11.0)], "ticker long, d date, c double")
    p = spark.createDataFrame([(1, dt.date(2024, 1, 6)), (1, dt.date(2024, 3, 1))], "ticker long, x date")
    assert [r["c"] for r in joins.close_on_or_after(b, p).orderBy("x").collect()] == [11.0, None]
    assert [r["c"] for r in joins.close_on_or_before(b, p).orderBy("x").collect()] == [10.0, None]


def test_fact_filed_on_the_as_of_day_is_visible(spark):
    f = spark.createDataFrame([(1, dt.date(2024, 1, 6)), (1, dt.date(2024, 1, 7))], "cik long, filed date")
    assert filters.pit_as_of(f, "2024-01-06").count() == 1
    assert filters.pit_as_of(f, "2024-01-06", lag_days=1).count() == 0


def test_upsert_keeps_open_high_low_and_takes_close_volume(spark):
    s = "ticker long, d date, o double, h double, l double, c double, v double"
    old = spark.createDataFrame([(1, D0, 1.0, 2.0, 0.5, 1.5, 10.0)], s)
    new = spark.createDataFrame([(1, D0, 9.0, 9.0, 9.0, 1.6, 11.0), (2, D0, 3.0, 3.0, 3.0, 3.0, 3.0)], s)
    got = {r["ticker"]: r for r in stores.upsert_bars(old, new).collect()}
    assert (got[1]["o"], got[1]["h"], got[1]["l"], got[1]["c"], got[1]["v"]) == (1.0, 2.0, 0.5, 1.6, 11.0) and got[2]["c"] == 3.0


def test_q4_is_synthesised_only_from_exactly_three_quarters(spark):
    q = "cik long, end date, val double, filed date"
    ends = [dt.date(2023, 3, 31), dt.date(2023, 6, 30), dt.date(2023, 9, 30)]
    quarters = spark.createDataFrame([(1, e, 10.0, e) for e in ends] + [(2, e, 10.0, e) for e in ends[:2]], q)
    annual = spark.createDataFrame([(k, dt.date(2023, 12, 31), 50.0, dt.date(2024, 2, 1)) for k in (1, 2)], q)
    add = windows.q4_synthesis(quarters, annual).where("end = date'2023-12-31'").collect()
    assert [(r["cik"], r["val"], r["filed"]) for r in add] == [(1, 20.0, dt.date(2024, 2, 1))]


def test_triple_barrier_directions(spark):
    up = labels.triple_barrier(with_returns(bars(spark, n=120, tickers=(1,), bump=lambda i: 4.0 * max(0, i - 100))), h=10)
    late = up.where(F.col("t0") == F.lit(D0 + dt.timedelta(days=105))).first()
    assert late["label"] == 1 and late["barrier"] == "profit" and late["t1"] > late["t0"]


def test_uniqueness_matches_brute_force(spark):
    b = bars(spark, n=60, tickers=(1,))
    ev = b.where("v % 3 = 0").select("ticker", F.col("d").alias("t0"), F.date_add("d", 5).alias("t1"))
    got = labels.uniqueness(ev, b).toPandas()
    e = ev.toPandas()
    days = b.toPandas()["d"].tolist()
    conc = {x: int(((e["t0"] <= x) & (e["t1"] >= x)).sum()) for x in days}
    for _, r in got.iterrows():
        span = [conc[x] for x in days if r["t0"] <= x <= r["t1"]]
        assert abs(r["tb_weight"] - 1 / max(sum(span) / len(span), 1)) < 1e-12
        assert abs(r["ma_weight"] - sum(1 / v for v in span) / len(span)) < 1e-12


def test_drawdown_tiers_follow_the_deepest_loss(spark):
    x = spark.createDataFrame([(v,) for v in (-0.01, -0.06, -0.12, -0.16, -0.3)], "dd double")
    got = [(r["s"], r["t"]) for r in x.select(*[c.alias(n) for c, n in zip(portfolio.drawdown_tier(F.col("dd")), "st")]).collect()]
    assert got == [(1.0, "NORMAL"), (0.9, "CAUTION"), (0.7, "WARNING"), (0.5, "CRITICAL"), (0.25, "HALT")]


def test_position_caps_sum_to_one_and_hold_the_cap(spark):
    w = spark.createDataFrame([("b", f"t{i:02d}", x) for i, x in enumerate([0.3, 0.2] + [0.05] * 10)], "book string, ticker string, weight double")
    got = portfolio.position_caps(w, "book", cap=0.12).toPandas()
    assert abs(got["weight"].sum() - 1) < 1e-9 and got["weight"].max() < 0.1205


def test_news_rules_with_the_fixed_lists(spark):
    x = spark.createDataFrame([("Acme beats on earnings and raises guidance", "Revenue rose 12% and margin hit a record.", "Reuters"), ("10 stocks to buy and retire a millionaire", "Acme is mentioned as one of many.", "GlobeNewswire")], "t string, r string, p string")
    got = x.select(T.materiality(F.col("t"), F.col("r"), F.col("p")).alias("m"), T.source_weight(F.col("p")).alias("w")).collect()
    # 9 + 9 + 7 + 7 for the first four material words; the second is a passing mention, a list and a wire
    assert [(r["m"], r["w"]) for r in got] == [(72, 95), (0, 70)]


def test_event_class_and_relationships(spark):
    kinds = [("DEAL", ("acquires", "merger")), ("EARNINGS", ("earnings",))]
    x = spark.createDataFrame([("Acme acquires Bolt for $2 billion", ""), ("Will Acme beat the market?", "")], "t string, r string")
    k = T.classify(F.col("t"), F.col("r"), ("acquired",), ("could",), ("upgrade",), kinds)
    assert [(r["c"], r["e"]) for r in x.select(k["class"].alias("c"), k["event_kind"].alias("e")).collect()] == [("EVENT", "DEAL"), ("COMMENTARY", None)]
    doc = spark.createDataFrame([(1, "<p>Our customers include Ford Motor, Volvo Cars and Europe. We grow.</p>")], "id long, text string")
    got = news.relationships(doc, "id", "text", [("customer", "customers include")]).collect()
    assert {(r["kind"], r["name"]) for r in got} == {("customer", "Ford Motor"), ("customer", "Volvo Cars")}


def test_stories_and_facts(spark):
    a = spark.createDataFrame([(1, 10, "Acme shares surge after strong quarterly earnings", 9), (1, 11, "Acme shares surge after earnings", 5), (1, 12, "Regulator opens probe into Bolt", 4)], "ticker long, doc_id long, title string, sc int")
    assert {r["doc_id"] for r in news.dedupe_stories(a, ["ticker"], "sc").collect()} == {10, 12}
    f = spark.createDataFrame([(1, 1, "Gross margin declined 4% for the second quarter. It could rise to 9% in the coming year.")], "k long, o long, body string")
    got = news.stated_facts(f, "k", "body", "o", {"FINANCIAL": ("margin",)}).collect()
    assert [r["fact"] for r in got] == ["Gross margin declined 4% for the second quarter"]


def test_entity_resolution(spark):
    names = spark.createDataFrame([("SIER", "Sierra Bancorp"), ("TXN", "Texas Instruments Inc"), ("AAPL", "Apple Inc")], "ticker string, name string")
    m = spark.createDataFrame([(1, "Texas Instruments Incorporated"), (2, "Apple Corp"), (3, "Sierra Wireless")], "id long, name string")
    found = lambda n: {r["id"]: r["ticker"] for r in joins.resolve_entities(m, n).collect()}
    assert found(names) == {1: "TXN", 2: "AAPL", 3: "SIER"}  # one name only begins with the word
    assert found(names.unionByName(spark.createDataFrame([("SMT", "Sierra Metals")], names.schema))) == {1: "TXN", 2: "AAPL", 3: None}


def test_year_ago_reaches_over_many_rows(spark):
    """Thirty rows a year: the match a year back is further away than any fixed number of rows; ties go to the earlier date."""
    from datetime import date, timedelta

    from tidemark.operators.joins import year_ago

    days = [date(2020, 1, 1) + timedelta(days=12 * i) for i in range(70)]
    rows = [(1, d, float(i)) for i, d in enumerate(days)] + [(2, date(2020, 1, 1), 1.0), (2, date(2020, 1, 11), 2.0), (2, date(2021, 1, 5), 3.0)]
    frame = spark.createDataFrame(rows, "cik int, end date, val double")
    for last in (False, True):
        for r in year_ago(frame, "cik", "end", "val", 45, last).collect():
            back = [(abs((r["end"] - timedelta(days=365) - d).days), d, v) for k, d, v in rows if k == r["cik"] and d < r["end"]]
            back = [x for x in back if x[0] <= 45]
            want = None if not back else max(back, key=lambda x: x[1]) if last else min(back)
            assert (r["prior_end"], r["prior"]) == ((want[1], want[2]) if want else (None, None))


def test_daily_ic_slides_its_chunks_over_the_last_ninety_days(spark):
    import datetime as dt

    import numpy as np
    import pandas as pd

    from tidemark.operators.aggregates import daily_ic

    rng, end = np.random.default_rng(4), dt.datetime(2024, 6, 1)
    rows = [(i, end - dt.timedelta(days=2 * i), "ab"[i % 2], float(rng.integers(-9, 9)), float(rng.normal()) if i % 7 else None) for i in range(80)]
    got = daily_ic(spark.createDataFrame(rows, "id long, generated_at timestamp, model string, signal double, ret double"), F.lit(end), ["a", "b"]).collect()
    kept = pd.DataFrame([r for r in rows if r[4] is not None and r[0] <= 45], columns=["id", "at", "model", "s", "r"])
    rho = lambda a, b: np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]
    s, r, n = kept["s"].to_numpy(), kept["r"].to_numpy(), len(kept)
    ics = [rho(s[i : i + 21], r[i : i + 21]) for i in range(min(n - 5, 42))]
    want = [rho(s, r), np.mean((s > 0) == (r > 0)), n, np.mean(ics) / np.std(ics), *(rho(np.where(kept["model"] == m, s, 0.0), r) for m in "ab")]
    assert len(got) == 1 and np.allclose(list(got[0]), want)
    few = daily_ic(spark.createDataFrame(rows[:4], "id long, generated_at timestamp, model string, signal double, ret double"), F.lit(end), ["a"]).collect()
    assert [tuple(x) for x in few] == [(None, None, 0, None, None)]
