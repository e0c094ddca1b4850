"""Composite price scores and rankings over the technical features, one row per ticker."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import by, clip, full, last_n, latest, running, with_tail
from tidemark.functions.ranks import with_rank_stats
from tidemark.functions.scores import linear_score
from tidemark.operators.filters import cap_tier

ANN = math.sqrt(252)
# Horizon weights of the screen, signal quality weights, regime multipliers.
HORIZON_WEIGHTS = {
    "short_term": {"momentum": 0.40, "accumulation": 0.30, "trend": 0.20, "quality": 0.10},
    "medium_term": {"quality": 0.35, "momentum": 0.25, "trend": 0.20, "accumulation": 0.20},
    "long_term": {"quality": 0.55, "trend": 0.20, "momentum": 0.15, "accumulation": 0.10},
}
HURST_LAGS = tuple(range(2, 50))
REGIME_MULTIPLIER = {"calm": 1.10, "normal": 1.00, "elevated": 0.80, "panic": 0.50}


def _lagged_slope(a: Column) -> Column:
    """Slope of ln(deviation of lagged differences) on ln(lag), lags 2..49 of a year of closes at most. The lags are
    fixed, so the regression is a weighted sum of the 48 logarithms."""
    xs = [math.log(g) for g in HURST_LAGS]
    mx = sum(xs) / len(xs)
    sxx = sum((v - mx) ** 2 for v in xs)

    def log_dev(g):
        diff = F.zip_with(F.slice(a, g + 1, F.size(a)), F.slice(a, F.lit(1), F.size(a) - g), lambda p, q: p - q)
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
        m = F.aggregate(diff, zero, lambda t, x: F.struct((t["s"] + x).alias("s"), (t["q"] + x * x).alias("q")))
        n = F.size(a) - g
        return F.log(F.sqrt(m["q"] / n - (m["s"] / n) * (m["s"] / n)))

    logs = F.transform(F.array(*[F.lit(g) for g in HURST_LAGS]), log_dev)
    w = F.array(*[F.lit((v - mx) / sxx) for v in xs])
    return F.aggregate(F.zip_with(logs, w, lambda y, k: y * k), F.lit(0.0), lambda t, v: t + v)


def factor_inputs(b: DataFrame) -> DataFrame:
    """Raw momentum, accumulation and trend inputs of the newest bar of every ticker: one shuffle, one aggregation."""
    sign = F.coalesce(F.signum("r"), F.lit(0.0))
    flow = F.when(F.col("h") == F.col("l"), 0.0).otherwise(F.try_divide(2 * F.col("c") - F.col("l") - F.col("h"), F.col("h") - F.col("l"))) * F.col("v")
    t = with_tail(b).withColumn("obv", F.sum(F.col("v") * sign).over(running())).withColumn("ad", F.sum(flow).over(running()))
    t = t.select("*", (-F.col("k")).cast("double").alias("i"), F.max(F.when(F.col("k") < 504, F.col("c"))).over(running()).alias("hi504"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("c")))
    tail = lambda n, x: F.when(F.col("k") < n, x)
    slope = lambda y: F.regr_slope(tail(63, F.col(y)), tail(63, F.col("i")))
    g = t.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.count("r").alias("nr"), at(0).alias("p0"), at(20).alias("p21"), at(62).alias("p63"), at(125).alias("p126"), at(251).alias("p252"),
        (F.stddev_samp(tail(63, F.col("r"))) * ANN).alias("vol_3m"), slope("obv").alias("so"), slope("c").alias("sc"), slope("ad").alias("sa"),
        F.avg(tail(63, F.col("obv"))).alias("mo"), F.avg(tail(63, F.col("c"))).alias("mc"), F.avg(tail(63, F.col("ad"))).alias("ma"),
        F.avg(tail(20, F.col("v"))).alias("v20"), F.avg(tail(90, F.col("v"))).alias("v90"), (F.avg(tail(60, F.abs(F.coalesce(F.col("r"), F.lit(0.0))) / (F.col("c") * F.col("v") + 1))) * 1e9).alias("amihud"),
        F.avg(tail(50, F.col("c"))).alias("ma50"), F.avg(tail(200, F.col("c"))).alias("ma200"), (F.stddev_samp(tail(252, F.col("r"))) * ANN).alias("vol_12m"), F.max(tail(252, F.col("c"))).alias("hi52"),
        (F.avg(tail(504, F.col("r"))) * 252).alias("mu2"), (F.stddev_samp(tail(504, F.col("r"))) * ANN).alias("sd2"), F.abs(F.min(tail(504, F.col("c") / F.col("hi504") - 1))).alias("max_dd_2y"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("k") < 252, F.struct("d", "c")))), lambda e: e["c"]).alias("last252"))
    hurst = _lagged_slope(F.col("last252"))
    m3 = F.col("p0") / F.col("p63") - 1
    obv_slope, price_slope = F.col("so") / (F.abs("mo") + 1e-9), F.col("sc") / (F.col("mc") + 1e-9)
    ok = F.col("n") >= 252
    v12 = F.when(F.col("nr") >= 252, F.col("vol_12m"))
    return g.select(
        "ticker", "n", F.when(ok, F.col("p21") / F.col("p252") - 1).alias("mom_12_1"), F.when(ok, F.col("p0") / F.col("p126") - 1).alias("mom_6m"), F.when(ok, m3).alias("mom_3m"),
        F.when(ok, F.col("p0") / F.col("p21") - 1).alias("mom_1m"), F.when(ok, F.when(F.col("vol_3m") > 0, m3 / F.col("vol_3m")).otherwise(0.0)).alias("sharpe_3m"),
        obv_slope.alias("obv_slope"), (obv_slope - price_slope).alias("price_vol_divergence"), (F.col("v20") / F.col("v90")).alias("volume_surge"), "amihud",
        (F.col("sa") / (F.abs("ma") + 1e-9)).alias("ad_slope"), (F.col("p0") / F.col("ma50") - 1).alias("pct_above_ma50"), (F.col("p0") / F.col("ma200") - 1).alias("pct_above_ma200"),
        F.when((F.col("p0") > F.col("ma50")) & (F.col("ma50") > F.col("ma200")), 1).when((F.col("p0") < F.col("ma50")) & (F.col("ma50") < F.col("ma200")), -1).otherwise(0).alias("ma_alignment"),
        F.when(v12 > 0, (F.col("p0") / F.col("p252") - 1) / v12).otherwise(0.0).alias("vol_adj_return"), (1 - F.col("p0") / F.col("hi52")).alias("dist_from_high"), "max_dd_2y",
        F.when(F.col("n") >= 100, clip(F.coalesce(hurst, F.lit(0.5)), 0, 1)).otherwise(0.5).alias("hurst"), F.when(F.col("sd2") > 0, F.col("mu2") / F.col("sd2")).otherwise(0.0).alias("sharpe_2y"))


def factor_scores(raw: DataFrame) -> DataFrame:
    """0..100 scores with the scanner weights and the back-test weights. raw: factor_inputs."""
    # one row per instrument, read many times by the score expressions: keep it instead of repeating the inputs inside them
    raw = raw.persist()
    ls = linear_score
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mom = (0.40 * ls(zero("mom_12_1"), -0.20, 0.50) + 0.25 * ls(zero("mom_6m"), -0.15, 0.30) + 0.20 * ls(zero("mom_3m"), -0.10, 0.20) + 0.15 * ls(zero("sharpe_3m"), -1.0, 2.0))
    acc = (0.30 * ls(F.col("obv_slope"), -0.02, 0.02) + 0.25 * ls(F.col("price_vol_divergence"), -0.01, 0.01) + 0.20 * ls(F.col("volume_surge"), 0.7, 1.8)
           + 0.15 * ls(F.col("ad_slope"), -0.02, 0.02) + 0.10 * (100 - ls(F.col("amihud"), 0.1, 10.0)))
    align = F.when(F.col("ma_alignment") > 0, 100.0).when(F.col("ma_alignment") < 0, 0.0).otherwise(50.0)
    a50, a200, va = ls(F.col("pct_above_ma50"), -0.10, 0.15), ls(F.col("pct_above_ma200"), -0.20, 0.30), ls(F.col("vol_adj_return"), -0.5, 2.0)
    trend = 0.25 * a50 + 0.25 * a200 + 0.20 * align + 0.15 * ls(F.col("hurst"), 0.40, 0.65) + 0.15 * va
    acc_bt = 0.40 * ls(F.col("obv_slope"), -0.02, 0.02) + 0.35 * ls(F.col("volume_surge"), 0.7, 1.8) + 0.25 * (100 - ls(F.col("amihud"), 0.1, 10.0))
    trend_bt = 0.30 * a50 + 0.30 * a200 + 0.25 * align + 0.15 * va
    ok = F.col("n") >= 252
    qual = F.when(F.col("n") >= 500, 0.6 * ls(F.col("sharpe_2y"), -0.5, 1.5) + 0.4 * ls(F.col("max_dd_2y"), 0.50, 0.10)).otherwise(50.0)
    return raw.select("*", F.when(ok, mom).otherwise(50.0).alias("momentum"), F.when(F.col("n") >= 90, acc).otherwise(50.0).alias("accumulation"),
                      F.when(F.col("n") >= 200, trend).otherwise(50.0).alias("trend"), F.when(F.col("n") >= 90, acc_bt).otherwise(50.0).alias("accumulation_bt"),
                      F.when(F.col("n") >= 200, trend_bt).otherwise(50.0).alias("trend_bt"), qual.alias("quality"))


def rank_by_horizon(scores: DataFrame) -> DataFrame:
    """Composite per horizon and its position (best first, ticker breaks ties). A horizon holds the whole universe, so the
    position is counted from value bins instead of sorting a horizon in one task."""
    hz = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), sum((w * F.col(f) for f, w in ws.items()), F.lit(0.0)).alias("x")) for h, ws in HORIZON_WEIGHTS.items()]))
    x = scores.select("ticker", hz.alias("e")).select("ticker", F.col("e.horizon").alias("horizon"), (F.floor(F.col("e.x") * 100 + 0.5) / 100).alias("composite"))
    return with_position(x, ["horizon"], "composite")


def with_position(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1-based position by value descending; rows with one value are ordered by ticker among themselves."""
    x = with_rank_stats(x.withColumn("_neg", -F.col(value)), keys, "_neg", prefix="_p_")
    w = Window.partitionBy(*keys, value).orderBy("ticker")
    return x.withColumn("rank", F.col("_p_n_less") + F.row_number().over(w)).drop("_neg", "_p_n", "_p_n_less", "_p_n_equal")


def regime(stress: Column, breadth: Column) -> Column:
    """Volatility ladder, raised by weak breadth."""
    base = F.when(stress < 12, "calm").when(stress < 20, "normal").when(stress < 32, "elevated").otherwise("panic")
    return F.when(breadth < 0.30, "panic").when((breadth < 0.50) & base.isin("calm", "normal"), "elevated").otherwise(base)


def regime_rerank(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """state: one row (regime). Composite x multiplier, rounded, ranked again."""
    mult = F.create_map(*[y for k, v in REGIME_MULTIPLIER.items() for y in (F.lit(k), F.lit(v))])
    x = ranked.crossJoin(state).select("ticker", "horizon", F.col("composite").alias("raw"), "regime",
                                       (F.floor(F.col("composite") * F.try_element_at(mult, F.col("regime")) * 100 + 0.5) / 100).alias("composite"))
    return with_position(x, ["horizon"], "composite")


def ascent_score(m: DataFrame) -> DataFrame:
    """Strength .35, volume .30, tier headroom .20, nearness to the high .15, with the first five flags.
    m: ticker, market_cap, and momentum inputs in percent."""
    g = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    r2s = lambda c, k: clip(50 + g(c) / k * 50, 0, 100)
    allpos = (g("mom_12_1") > 0) & (g("mom_6m") > 0) & (g("mom_3m") > 0) & (g("mom_1m") > 0)
    base = (0.35 * r2s("mom_12_1", 100.0) + 0.25 * r2s("mom_6m", 60.0) + 0.20 * r2s("mom_3m", 40.0) + 0.10 * r2s("mom_1m", 20.0) + 0.10 * clip(50 + g("sharpe_3m") * 20, 0, 100))
    strength = clip(base * F.when(allpos, 1.15).otherwise(1.0), 0, 100)
    obv = F.col("obv_slope")
    vol = clip(0.50 * clip(50 + (F.col("volume_surge") - 1) * 100, 0, 100) + 0.30 * clip(50 + F.signum(obv) * F.least(F.abs(obv) * 200, F.lit(45.0)), 0, 100)
               + 0.20 * clip(50 + F.col("pct_above_ma200") * 50, 0, 100), 0, 100)
    m = m.select("*", strength.alias("strength"), vol.alias("volume"), cap_tier(F.col("market_cap")).alias("tier"))
    pos = F.when(F.col("tier") == "nano", 0).when(F.col("tier") == "micro", 1).when(F.col("tier") == "small", 2).when(F.col("tier") == "large", 4).when(F.col("tier") == "mega", 5).otherwise(3)
    tier_s, high_s = clip(0.5 * (5 - pos) / 5 * 100 + 0.5 * F.col("strength"), 0, 100), F.coalesce(clip(100 - F.col("dist_from_high") * 200, 0, 100), F.lit(50.0))
    flags = F.slice(F.array_compact(F.array(
        F.when(allpos, "all_horizons"), F.when(g("mom_3m") > 30, "strong_3m"), F.when(g("sharpe_3m") > 1.5, "risk_adjusted"), F.when(F.col("volume_surge") > 1.4, "volume"),
        F.when(obv > 0.05, "accumulation"), F.when(F.col("tier").isin("small", "mid") & (F.col("strength") > 60), "headroom"), F.when(F.col("dist_from_high") < 0.05, "near_high"))), 1, 5)
    return m.select("ticker", "tier", "strength", "volume", tier_s.alias("tier_score"), high_s.alias("high_score"), F.array_join(flags, ",").alias("flags")).withColumn(
        "ascent_score", clip(0.35 * F.col("strength") + 0.30 * F.col("volume") + 0.20 * F.col("tier_score") + 0.15 * F.col("high_score"), 0, 100))


def price_position(b: DataFrame, bench_3m: DataFrame) -> DataFrame:
    """Distance from the 252-row high and low, range position, three-month return over the benchmark's.
    bench_3m: one row (b3)."""
    t = with_tail(b).where("k < 252").groupBy("ticker").agg(F.max("c").alias("hi"), F.min("c").alias("lo"), F.max(F.when(F.col("k") == 0, F.col("c"))).alias("p0"), F.max(F.when(F.col("k") == 63, F.col("c"))).alias("p63"))
    return t.crossJoin(bench_3m).select("ticker", ((F.col("p0") / F.col("hi") - 1) * 100).alias("pct_from_high"), ((F.col("p0") / F.col("lo") - 1) * 100).alias("pct_from_low"),
                                        F.when(F.col("hi") > F.col("lo"), (F.col("p0") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100).alias("range_percentile"),
                                        ((F.col("p0") / F.col("p63") - 1 - F.col("b3")) * 100).alias("relative_strength"))


def gap_range(b: DataFrame) -> DataFrame:
    """Mean absolute overnight gap of 20 rows and intraday range of 5 rows against the 15 before."""
    gap, rng = F.abs(F.col("o") / F.lag("c").over(by()) - 1), (F.col("h") - F.col("l")) / F.col("c")
    x = b.select("ticker", "d", "rn", gap.alias("g"), rng.alias("x"))
    base = F.avg("x").over(by().rowsBetween(-19, -5))
    return x.select("ticker", "d", full(F.avg, "g", 20).alias("gap_frequency"), F.when((F.col("rn") >= 30) & (base > 0), F.avg("x").over(last_n(5)) / base - 1).alias("range_expansion"))


def short_interest(records: DataFrame, key="ticker", order="date") -> DataFrame:
    """Latest two records per instrument: level, trend, days to cover and squeeze class."""
    x = latest(records, key, order, 2).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())))
    g = x.groupBy(key).agg(*[F.max(F.when(F.col("_k") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("short_interest", "days_to_cover")])
    tr = F.when((F.col("short_interest1") != 0) & (F.col("short_interest2") > 0), F.col("short_interest1") / F.col("short_interest2") - 1)
    dtc = F.col("days_to_cover1")
    return g.select(key, F.col("short_interest1").alias("short_interest"), dtc.alias("days_to_cover"), tr.alias("trend"),
                    F.when((dtc > 5) & (F.coalesce(tr, F.lit(0.0)) > 0.1), "elevated").when(dtc > 3, "moderate").otherwise("low").alias("squeeze_risk"))


def relative_strength(b: DataFrame, sector: DataFrame) -> DataFrame:
    """Newest returns over the sector's, beta, correlation and up/down capture of the last 126 shared rows.
    sector: ticker, d, sc (sector level on the ticker's own days)."""
    x = b.join(sector, ["ticker", "d"])
    w = by()
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    x = x.select("ticker", "d", "c", "sc", (n - F.row_number().over(w)).alias("k"), (F.col("c") / F.lag("c").over(w) - 1).alias("y"), (F.col("sc") / F.lag("sc").over(w) - 1).alias("x"))
    at = lambda col, k: F.max(F.when(F.col("k") == k, F.col(col)))
    rs = lambda k: (at("c", 0) / at("c", k - 1) - 1) - (at("sc", 0) / at("sc", k - 1) - 1)
    inn = F.col("k") < 125
    y, m = F.when(inn, F.col("y")), F.when(inn, F.col("x"))
    up, dn = inn & (F.col("x") > 0), inn & (F.col("x") < 0)
    return x.groupBy("ticker").agg(
        rs(21).alias("rs_1m"), rs(63).alias("rs_3m"), rs(126).alias("rs_6m"), rs(252).alias("rs_1y"), (F.covar_pop(y, m) / F.var_pop(m)).alias("beta"), F.corr(y, m).alias("correlation"),
        (F.avg(F.when(up, F.col("y"))) / F.avg(F.when(up, F.col("x")))).alias("up_capture"), (F.avg(F.when(dn, F.col("y"))) / F.avg(F.when(dn, F.col("x")))).alias("down_capture"))


def support_resistance(levels: DataFrame, last: DataFrame, pct: float = 0.01) -> DataFrame:
    """Closest two clustered levels below and above the newest close, with percentage defaults.
    levels: ticker, kind, level; last: ticker, p0."""
    from tidemark.operators.windows import cluster_levels

    x = cluster_levels(levels, pct).join(last, "ticker")
    sup = F.sort_array(F.collect_list(F.when((F.col("kind") == "support") & (F.col("level") < F.col("p0") * 0.999), F.col("level"))), asc=False)
    res = F.sort_array(F.collect_list(F.when((F.col("kind") == "resistance") & (F.col("level") > F.col("p0") * 1.001), F.col("level"))))
    g = last.join(x.groupBy("ticker").agg(sup.alias("s"), res.alias("r")), "ticker", "left")
    pick = lambda a, i, k: F.coalesce(F.try_element_at(a, F.lit(i)), F.col("p0") * k)
    return g.select("ticker", pick(F.col("s"), 1, 0.95).alias("support_1"), pick(F.col("s"), 2, 0.90).alias("support_2"), pick(F.col("r"), 1, 1.05).alias("resistance_1"), pick(F.col("r"), 2, 1.10).alias("resistance_2"))


def expected_return(b: DataFrame, rf: float = 0.052, premium: float = 0.055, beta: float = 1.0) -> DataFrame:
    """Five annual return estimates and their fixed-weight mean."""
    t = with_tail(b)
    g = t.groupBy("ticker").agg((F.avg("r") * 252).alias("mu_historical"), (F.avg(F.when(F.col("k") < 63, F.col("r"))) * 252).alias("rec"), F.count("r").alias("n"),
                                (F.max(F.when(F.col("k") == 0, F.col("c"))) / F.avg(F.when(F.col("k") < 200, F.col("c"))) - 1).alias("dist"))
    h, capm = F.col("mu_historical"), rf + beta * premium
    mom = 0.4 * h + 0.6 * F.when(F.col("n") >= 63, F.col("rec")).otherwise(h)
    rev = h - 0.3 * F.col("dist")
    sh = F.greatest(F.lit(0.0), 1 - 5 / (F.col("n") / 252))
    shr = sh * h + (1 - sh) * capm
    return g.select("ticker", h.alias("mu_historical"), F.lit(capm).alias("mu_capm"), mom.alias("mu_momentum"), rev.alias("mu_reversion"), shr.alias("mu_shrunk"),
                    (0.15 * h + 0.25 * capm + 0.25 * mom + 0.15 * rev + 0.20 * shr).alias("mu_ensemble"))
