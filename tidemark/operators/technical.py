"""Price, volume and technical features: one row per (ticker, d), every value known at the close of d.

Input `b` is the output of frames.with_returns (ticker, d, o, h, l, c, v, n, rn, r, lr). All features of one family
share the (ticker, d) partitioning and ordering, so a plan has one shuffle however many columns it computes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ewm import span, with_ewm, with_ewms
from tidemark.functions.frames import between, by, full, last_n, running, with_pair_rolled, with_rolled

EPS = 1e-10
ANN = math.sqrt(252)


def lagged(col, n: int) -> Column:
    return F.lag(col, n).over(by())


def tsmom(b: DataFrame, lookbacks=(5, 10, 21, 63, 126, 252)) -> DataFrame:
    """Sum of returns over each lookback, its sign and its ratio to the scaled deviation."""
    b = with_rolled(b.select("ticker", "d", "r"), "r", lookbacks, "_")
    out = []
    for k in lookbacks:
        s, sd = F.col(f"_s_{k}"), F.col(f"_d_{k}")
        out += [s.alias(f"tsmom_{k}d"), F.signum(s).alias(f"tsmom_sign_{k}d"),
                F.when(sd > 0, s / (sd * math.sqrt(252 / k))).alias(f"tsmom_sharpe_{k}d")]
    return b.select("ticker", "d", *out)


def momentum_12_1(b: DataFrame) -> DataFrame:
    ok = F.col("rn") >= 253
    m1 = F.sum(F.col("r")).over(last_n(21))
    return b.select("ticker", "d", F.when(ok, F.sum(F.col("r")).over(between(-251, -21))).alias("cs_momentum_12_1"),
                    F.when(ok, m1).alias("cs_momentum_1m"), F.when(ok, -m1).alias("momentum_reversal"))


def momentum_price(b: DataFrame) -> DataFrame:
    """Price ratios on the 252nd, 126th, 63rd and 21st newest close (lag = position - 1)."""
    ok = F.col("rn") >= 252
    p = {n: lagged("c", n - 1) for n in (252, 126, 63, 21)}
    m3, vol = F.col("c") / p[63] - 1, F.stddev_samp(F.col("r")).over(last_n(63)) * ANN
    cols = {"mom_12_1": p[21] / p[252] - 1, "mom_6m": F.col("c") / p[126] - 1, "mom_3m": m3, "mom_1m": F.col("c") / p[21] - 1,
            "vol_3m": vol, "sharpe_3m": F.when(vol > 0, m3 / vol).otherwise(0.0)}
    return b.select("ticker", "d", *[F.when(ok, v).alias(k) for k, v in cols.items()])


def momentum_log(b: DataFrame) -> DataFrame:
    """Log momentum with the documented sign (positive after a rise): see README, behaviours decided."""
    ok = F.col("rn") >= 252
    p = lambda n: lagged("c", n - 1)
    return b.select("ticker", "d", F.when(ok, F.log(p(21) / p(252))).alias("mom_12_1"), F.when(ok, F.log(p(21) / p(126))).alias("mom_6_1"),
                    F.when(ok, F.log(F.col("c") / p(21))).alias("mom_1m"))


def momentum_pit(b: DataFrame) -> DataFrame:
    """Returns over 5..252 bars and the 12-month return without the last month."""
    ret = {k: F.col("c") / lagged("c", n) - 1 for k, n in {"r_1w": 5, "r_1m": 21, "r_3m": 63, "r_6m": 126, "r_12m": 252}.items()}
    return b.select("ticker", "d", *[v.alias(k) for k, v in ret.items()]).withColumn(
        "r_12m_ex_1m", F.when(F.col("r_1m") > -1, (1 + F.col("r_12m")) / (1 + F.col("r_1m")) - 1))


def residual_momentum(b: DataFrame, market: DataFrame, n: int = 126) -> DataFrame:
    """Return left after the market part. beta mixes a sample covariance with a population variance on purpose.
    market: d, mr. The residual moments are expanded from window sums, so no residual series is built."""
    j = b.select("ticker", "d", "r").join(market, "d").where("r is not null and mr is not null")
    j = with_pair_rolled(j, "r", "mr", n)
    cov, vp = F.col("_x.qxy") / (n - 1), F.col("_x.qyy") / n
    j = j.select("ticker", "d", F.col("_x").isNotNull().alias("ok"), F.when(vp > 0, cov / vp).otherwise(1.0).alias("beta"), cov.alias("cov"),
                 (F.col("_x.qxx") / (n - 1)).alias("vr"), (F.col("_x.qyy") / (n - 1)).alias("vm"),
                 F.col("_x.sx").alias("sr"), F.col("_x.sy").alias("sm"))
    tot = F.col("sr") - F.col("beta") * F.col("sm")
    sd = F.sqrt(F.greatest(F.col("vr") - 2 * F.col("beta") * F.col("cov") + F.col("beta") ** 2 * F.col("vm"), F.lit(0.0)))
    return j.where("ok").select("ticker", "d", "beta", tot.alias("residual_momentum_6m"), (sd * ANN).alias("residual_momentum_vol"),
                                (tot / (sd + 1e-8)).alias("beta_adjusted_momentum"))


def momentum_acceleration(b: DataFrame) -> DataFrame:
    ok = F.col("rn") >= 64
    recent, medium = F.sum(F.col("r")).over(last_n(21)), F.sum(F.col("r")).over(between(-62, -21))
    return b.select("ticker", "d", F.when(ok, recent - medium / 2).alias("momentum_acceleration"),
                    F.when(ok, recent - 2 * medium).alias("momentum_concavity"))


def rsi(b: DataFrame, periods=(7, 14, 21)) -> DataFrame:
    """Wilder RSI, its 5-row slope, and the simple-mean form."""
    delta = F.col("c") - lagged("c", 1)
    df = b.withColumn("_g", F.coalesce(F.greatest(delta, F.lit(0.0)), F.lit(0.0))).withColumn(
        "_l", F.coalesce(F.greatest(-delta, F.lit(0.0)), F.lit(0.0)))
    df = with_ewms(df, {**{f"_ag{n}": ("_g", 1.0 / n) for n in periods}, **{f"_al{n}": ("_l", 1.0 / n) for n in periods}})
    for n in periods:
        df = df.withColumn(f"rsi_{n}", 100 - 100 / (1 + F.col(f"_ag{n}") / (F.col(f"_al{n}") + EPS)))
        df = df.withColumn(f"rsi_{n}_slope", F.col(f"rsi_{n}") - lagged(f"rsi_{n}", 5))
    for n in (5, 14, 21):
        g, lo = F.sum("_g").over(last_n(n)), F.sum("_l").over(last_n(n))
        df = df.withColumn(f"rsi_sma_{n}", F.when((F.col("rn") > n) & (lo > 0), 100 - 100 / (1 + g / lo)))
    return df


def macd(b: DataFrame) -> DataFrame:
    df = with_ewms(b, {"_e12": ("c", span(12)), "_e26": ("c", span(26))})
    df = df.withColumn("macd", F.col("_e12") - F.col("_e26"))
    df = with_ewm(df, "macd_signal", "macd", span(9)).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return df.select("ticker", "d", "macd", "macd_signal", "macd_hist",
                     (F.col("macd_hist") - lagged("macd_hist", 3)).alias("macd_hist_slope"),
                     F.when(F.col("macd") > F.col("macd_signal"), 1).otherwise(-1).alias("macd_crossover"))


def bollinger(b: DataFrame, periods=(20, 50)) -> DataFrame:
    df = b
    for n in periods:
        sma, sd = full(F.avg, F.col("c"), n), full(F.stddev_samp, F.col("c"), n)
        df = df.withColumn(f"bb_pct_b_{n}", (F.col("c") - (sma - 2 * sd)) / (4 * sd + EPS)).withColumn(f"bb_bandwidth_{n}", 4 * sd / sma)
        bw = f"bb_bandwidth_{n}"
        df = df.withColumn(f"bb_squeeze_{n}", F.when(F.col(bw) < full(F.avg, bw, 20), 1).otherwise(0))
    return df


def true_range() -> Column:
    prev = lagged("c", 1)
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - prev), F.abs(F.col("l") - prev))


def atr(b: DataFrame) -> DataFrame:
    df = with_ewms(b.withColumn("tr", true_range()), {f"atr_{n}": ("tr", span(n)) for n in (14, 21)})
    for n in (14, 21):
        df = df.withColumn(f"atr_{n}_normalized", F.col(f"atr_{n}") / F.col("c"))
    return df.withColumn("atr_sma_14", full(F.avg, "tr", 14)).withColumn("atr_pct", F.col("atr_sma_14") / F.col("c") * 100)


def adx(b: DataFrame) -> DataFrame:
    """Directional index; the minus side and the index itself start at the second row."""
    up, dn = F.greatest(F.col("h") - lagged("h", 1), F.lit(0.0)), F.greatest(lagged("l", 1) - F.col("l"), F.lit(0.0))
    df = b.withColumn("tr", true_range()).withColumn("_up", F.when(F.col("rn") > 1, up)).withColumn("_dn", F.when(F.col("rn") > 1, dn))
    df = df.withColumn("_p", F.when(F.col("_up") > F.col("_dn"), F.col("_up")).otherwise(0.0))
    df = df.withColumn("_m", F.when(F.col("_up") > F.col("_dn"), 0.0).otherwise(F.col("_dn")))
    a = span(14)
    df = with_ewm(with_ewms(df, {"_atr": ("tr", a), "_ps": ("_p", a)}), "_ms", "_m", a, first=2)
    df = df.withColumn("di_plus", 100 * F.col("_ps") / (F.col("_atr") + EPS)).withColumn("di_minus", 100 * F.col("_ms") / (F.col("_atr") + EPS))
    df = df.withColumn("_dx", 100 * F.abs(F.col("di_plus") - F.col("di_minus")) / (F.col("di_plus") + F.col("di_minus") + EPS))
    return with_ewm(df, "adx", "_dx", a, first=2).withColumn("trend_strength", F.col("adx") / 100)


def stochastic(b: DataFrame) -> DataFrame:
    df = b
    for n in (14, 21):
        lo, hi = full(F.min, F.col("l"), n), full(F.max, F.col("h"), n)
        df = df.withColumn(f"stoch_k_{n}", 100 * (F.col("c") - lo) / (hi - lo + EPS))
        df = df.withColumn(f"stoch_d_{n}", full(F.avg, f"stoch_k_{n}", 3))
    return df


def cci(b: DataFrame, n: int = 20) -> DataFrame:
    """Commodity channel index; the absolute deviation is about the mean of the same frame."""
    w = last_n(n)
    df = b.withColumn("_tp", (F.col("h") + F.col("l") + F.col("c")) / 3)
    df = df.withColumn("_m", F.avg("_tp").over(w)).withColumn("_x", F.collect_list("_tp").over(w))
    mad = F.aggregate(F.transform("_x", lambda x: F.abs(x - F.col("_m"))), F.lit(0.0), lambda a, x: a + x) / n
    df = df.withColumn("cci", F.when(F.size("_x") == n, (F.col("_tp") - F.col("_m")) / (0.015 * mad + EPS)))
    return df.select("ticker", "d", "cci", F.when(F.col("cci") > 100, 1).when(F.col("cci") < -100, -1).otherwise(0).alias("cci_overbought"))


def williams_r(b: DataFrame, n: int = 14) -> DataFrame:
    hi, lo = full(F.max, F.col("h"), n), full(F.min, F.col("l"), n)
    return b.select("ticker", "d", (-100 * (hi - F.col("c")) / (hi - lo + EPS)).alias("williams_r"))


def chaikin_money_flow(b: DataFrame) -> DataFrame:
    """20-row money flow with its 5-row change, and the 21-row form in which a bar without range counts as zero."""
    clv = ((F.col("c") - F.col("l")) - (F.col("h") - F.col("c"))) / (F.col("h") - F.col("l") + EPS)
    flow = F.when(F.col("h") == F.col("l"), 0.0).otherwise(F.try_divide((F.col("c") - F.col("l")) - (F.col("h") - F.col("c")), F.col("h") - F.col("l"))) * F.col("v")
    cmf = full(F.sum, clv * F.col("v"), 20) / (full(F.sum, F.col("v"), 20) + EPS)
    df = b.withColumn("cmf", cmf).withColumn("cmf_trend", F.col("cmf") - lagged("cmf", 5))
    df = df.withColumn("chaikin_21", full(F.sum, flow, 21) / full(F.sum, F.col("v"), 21))
    return df.withColumn("ad_line", F.sum(flow).over(running()))


def obv_vpt(b: DataFrame) -> DataFrame:
    w = running()
    df = b.withColumn("obv", F.sum(F.signum(F.col("c") - lagged("c", 1)) * F.col("v")).over(w)).withColumn("vpt", F.sum(F.col("r") * F.col("v")).over(w))
    df = df.withColumn("obv_trend", (F.col("obv") - lagged("obv", 20)) / (F.avg(F.col("v")).over(w) + EPS))
    df = df.withColumn("obv_momentum", F.try_divide(F.col("obv"), lagged("obv", 20)) - 1)
    df = df.withColumn("obv_vs_mean", F.try_divide(F.col("obv"), full(F.avg, "obv", 20)) - 1)
    return df.withColumn("vpt_trend", F.col("vpt") - lagged("vpt", 10))


def ma_ema_cross(b: DataFrame, periods=(5, 10, 20, 50, 100, 200)) -> DataFrame:
    df = with_ewms(b.select("*", *[full(F.avg, F.col("c"), n).alias(f"sma_{n}") for n in periods]), {f"ema_{n}": ("c", span(n)) for n in periods})
    df = df.select("*", *[(F.col("c") / (F.col(f"{m}_{n}") + EPS) - 1).alias(f"price_vs_{m}_{n}") for n in periods for m in ("sma", "ema")])
    s50, s200 = F.col("sma_50"), F.col("sma_200")
    return df.withColumn("golden_cross", F.when(s50 > s200, 1).otherwise(-1)).withColumn("golden_cross_distance", (s50 - s200) / (s200 + EPS))


def volume_ratios(b: DataFrame) -> DataFrame:
    a20 = full(F.avg, F.col("v"), 20)
    return b.select("ticker", "d", (F.col("v") / (a20 + EPS)).alias("volume_ratio"), (full(F.avg, F.col("v"), 5) / (a20 + EPS)).alias("volume_trend"),
                    (F.col("c") * F.col("v")).alias("dollar_volume"), full(F.avg, F.col("c") * F.col("v"), 20).alias("dollar_volume_ma20"), (F.col("v") / full(F.avg, F.col("v"), 21)).alias("rvol"))


def candle_shape(b: DataFrame) -> DataFrame:
    return b.select("ticker", "d", ((F.col("h") - F.col("l")) / F.col("c")).alias("daily_range"), ((F.col("h") - F.greatest(F.col("c"), F.col("o"))) / F.col("c")).alias("upper_shadow"),
                    ((F.least(F.col("c"), F.col("o")) - F.col("l")) / F.col("c")).alias("lower_shadow"), (F.abs(F.col("c") - F.col("o")) / F.col("c")).alias("body_size"))


def ichimoku(b: DataFrame) -> DataFrame:
    mid = lambda n: (full(F.max, F.col("h"), n) + full(F.min, F.col("l"), n)) / 2
    df = b.withColumn("tenkan", mid(9)).withColumn("kijun", mid(26)).withColumn("_b", mid(52))
    df = df.withColumn("senkou_a", F.lag((F.col("tenkan") + F.col("kijun")) / 2, 26).over(by())).withColumn("senkou_b", lagged("_b", 26))
    cloud = F.greatest("senkou_a", "senkou_b")
    return df.where("rn >= 52").select("ticker", "d", "tenkan", "kijun", F.when(F.col("c") > cloud, 1).otherwise(-1).alias("above_cloud"),
                                       F.when(F.col("tenkan") > F.col("kijun"), 1).otherwise(-1).alias("tenkan_kijun_cross"))


def pivot_points(b: DataFrame) -> DataFrame:
    ph, pl, pc = lagged("h", 1), lagged("l", 1), lagged("c", 1)
    p = (ph + pl + pc) / 3
    r1, s1 = 2 * p - pl, 2 * p - ph
    return b.select("ticker", "d", ((F.col("c") - p) / p).alias("vs_pivot"), ((F.col("c") - r1) / r1).alias("vs_r1"), ((F.col("c") - s1) / (F.abs(s1) + EPS)).alias("vs_s1"))


FIB = {"236": 0.236, "382": 0.382, "500": 0.5, "618": 0.618, "786": 0.786}


def fibonacci_levels(b: DataFrame) -> DataFrame:
    w = last_n(252)
    df = b.withColumn("_hi", F.max(F.col("h")).over(w)).withColumn("_lo", F.min(F.col("l")).over(w)).where("rn >= 52")
    lvl = lambda x: F.col("_lo") + x * (F.col("_hi") - F.col("_lo"))
    return df.select("ticker", "d", *[((F.col("c") - lvl(x)) / (lvl(x) + EPS)).alias(f"vs_fib_{k}") for k, x in FIB.items()])


def vwap_distance(b: DataFrame) -> DataFrame:
    tp = full(F.sum, (F.col("h") + F.col("l") + F.col("c")) / 3 * F.col("v"), 21) / full(F.sum, F.col("v"), 21)
    cl = full(F.sum, F.col("c") * F.col("v"), 20) / full(F.sum, F.col("v"), 20)
    return b.select("ticker", "d", ((F.col("c") / tp - 1) * 100).alias("vwap_dist_21"), ((F.col("c") - cl) / cl).alias("vwap_distance_20"))


def money_flow_index(b: DataFrame) -> DataFrame:
    """Typical-price share of positive flow (0..1), and the close-based 0..100 proxy."""
    df = b.withColumn("_tp", (F.col("h") + F.col("l") + F.col("c")) / 3)
    prev, flow, w = lagged("_tp", 1), F.col("_tp") * F.col("v"), last_n(14)
    df = df.withColumn("_pf", F.when(F.col("_tp") > prev, flow).otherwise(0.0)).withColumn("_nf", F.when(F.col("_tp") < prev, flow).otherwise(0.0))
    df = df.withColumn("_pc", F.when(F.col("c") > lagged("c", 1), F.col("c") * F.col("v")).otherwise(0.0)).withColumn("_nc", F.when(F.col("c") > lagged("c", 1), 0.0).otherwise(F.col("c") * F.col("v")))
    pf, nf, pc, nc = (F.sum(x).over(w) for x in ("_pf", "_nf", "_pc", "_nc"))
    return df.select("ticker", "d", F.when((F.col("rn") >= 15) & (pf + nf > 0), pf / (pf + nf)).alias("money_flow_index"),
                     F.when((F.col("rn") >= 40) & (nc > 0), 100 - 100 / (1 + pc / nc)).alias("mfi_proxy"))


def trade_size_flow(b: DataFrame) -> DataFrame:
    df = b.withColumn("_s", F.when((F.col("v") > 0) & (F.col("n") > 0), F.col("v") / F.col("n"))).where("_s is not null")
    df = df.withColumn("_k", F.row_number().over(by())).withColumn("_base", F.avg("_s").over(between(-39, -5)))
    df = df.withColumn("_l10", F.collect_list("_s").over(last_n(10))).withColumn("_l5", F.avg("_s").over(last_n(5)))
    blocks = F.size(F.filter("_l10", lambda x: x > 1.5 * F.col("_base"))) / 10
    return df.where("_k >= 40 and _base > 0").select("ticker", "d", (F.col("_l5") / F.col("_base") - 1).alias("avg_trade_size_trend"),
                                                     blocks.alias("block_trade_frequency"))


def volume_surge_accumulation(b: DataFrame) -> DataFrame:
    dv, up = F.col("c") * F.col("v"), F.col("c") > lagged("c", 1)
    df = b.withColumn("_dv", dv).withColumn("_uv", F.when(up, F.col("v")).otherwise(0.0)).withColumn(
        "_ac", F.when(up & (F.col("v") > lagged("v", 1)), 1).otherwise(0))
    rec, base = F.avg("_dv").over(last_n(21)), F.avg("_dv").over(between(-83, -21))
    v20, ok = F.sum(F.col("v")).over(last_n(20)), F.col("rn") >= 65
    return df.select("ticker", "d", F.when(ok & (base > 0), rec / base).alias("dollar_vol_trend"),
                     F.when(ok & (v20 > 0), F.sum("_uv").over(last_n(20)) / v20).alias("up_day_share"),
                     F.when(ok & (rec > 0), F.log10(rec)).alias("log_adv"),
                     F.when(F.col("rn") >= 40, F.sum("_ac").over(last_n(20))).alias("accumulation_days"),
                     F.when(F.col("rn") >= 40, F.avg(F.col("v")).over(last_n(5)) / F.avg(F.col("v")).over(between(-39, -5)) - 1).alias("vol_change_pct"))


def drawdown_structure(b: DataFrame) -> DataFrame:
    """Position against the three-year high and the one-year low, by calendar days; ties keep the first date."""
    day = F.unix_date("d")
    w3 = Window.partitionBy("ticker").orderBy(day).rangeBetween(-1095, 0)
    w1 = Window.partitionBy("ticker").orderBy(day).rangeBetween(-365, 0)
    hi, lo = F.max(F.struct(F.col("c").alias("c"), (-day).alias("k"))).over(w3), F.min(F.struct(F.col("c").alias("c"), day.alias("k"))).over(w1)
    df = b.select("ticker", "d", "c", hi.alias("_hi"), lo.alias("_lo"), F.count(F.lit(1)).over(w3).alias("_n3"), F.count(F.lit(1)).over(w1).alias("_n1"))
    ok3, ok1 = F.col("_n3") >= 30, F.col("_n1") >= 30
    return df.select("ticker", "d", F.when(ok3, 1 - F.col("c") / F.col("_hi.c")).alias("dd_3y"), F.when(ok3, day + F.col("_hi.k")).alias("days_underwater"),
                     F.when(ok1, F.col("c") / F.col("_lo.c") - 1).alias("off_1y_low"), F.when(ok1, day - F.col("_lo.k")).alias("days_since_1y_low"))
