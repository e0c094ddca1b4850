"""Portfolio construction, back-tests, regimes and governance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import clip
from tidemark.functions.normal import norm_ppf

ANN = math.sqrt(252)
# Regime likelihoods per slope class, regime multipliers, drawdown tiers.
REGIMES = ("BULL_LOW_VOL", "BULL_HIGH_VOL", "MEAN_REVERT", "BEAR_LOW_VOL", "BEAR_HIGH_VOL")
SLOPE_LIKELIHOOD = {
    "inverted": (0.05, 0.10, 0.20, 0.35, 0.30),
    "flat": (0.15, 0.20, 0.30, 0.25, 0.10),
    "normal": (0.30, 0.25, 0.25, 0.15, 0.05),
    "steep": (0.50, 0.25, 0.15, 0.08, 0.02),
}
RISK_MULTIPLIER = {"BULL_LOW_VOL": 1.00, "BULL_HIGH_VOL": 0.85, "MEAN_REVERT": 0.90, "BEAR_LOW_VOL": 0.70, "BEAR_HIGH_VOL": 0.45}
DRAWDOWN_TIERS = ((-0.20, 0.25, "HALT"), (-0.15, 0.50, "CRITICAL"), (-0.10, 0.70, "WARNING"), (-0.05, 0.90, "CAUTION"))


def book_returns(selected: DataFrame, leg: str) -> DataFrame:
    """Per period: mean outcome of a leg and the share of names that are new. selected: m, prev_m, ticker, leg, y.
    A name is new when its own previous membership is not the period before, so no set of names is collected."""
    x = selected.where(F.col("leg") == leg)
    w = Window.partitionBy("ticker").orderBy("m")
    x = x.withColumn("new", (~F.lag("m").over(w).eqNullSafe(F.col("prev_m"))).cast("double"))
    return x.groupBy("m").agg(F.avg("y").alias("ret"), F.avg("new").alias("turnover"), F.count(F.lit(1)).alias("n"))


def period_stats(x: DataFrame, value: str, periods: float = 4.0) -> DataFrame:
    """Annual mean and deviation, ratio, hit rate, deepest compound drawdown, t. x: one row per period (m)."""
    w = Window.orderBy("m")  # one row per period
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    y = x.withColumn("_cum", F.exp(F.sum(F.log1p(value)).over(run))).withColumn("_dd", F.col("_cum") / F.greatest(F.max("_cum").over(run), F.lit(1.0)) - 1)
    m, s, n = F.avg(value), F.stddev_samp(value), F.count(value)
    return y.agg(n.alias("n_periods"), (m * periods).alias("ann_mean"), (s * math.sqrt(periods)).alias("ann_vol"), (m * periods / (s * math.sqrt(periods))).alias("sharpe"), F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"),
                 F.least(F.min("_dd"), F.lit(0.0)).alias("max_drawdown"), (m / (s / F.sqrt(n))).alias("t_stat"), F.avg("turnover").alias("avg_turnover")).where("n_periods >= 6")


def inverse_vol(v: DataFrame, keys: list[str], vol: str = "vol") -> DataFrame:
    """Weights 1/vol over their sum; names without a positive volatility are dropped."""
    x = v.where(F.col(vol) > 0).withColumn("_i", 1 / F.col(vol))
    tot = x.groupBy(*keys).agg(F.sum("_i").alias("_t"))
    return x.join(tot, keys).withColumn("weight", F.col("_i") / F.col("_t")).drop("_i", "_t")


def flat_corr_leverage(w: DataFrame, keys: list[str], target: float, corr: float = 0.3, cap: float = 1.0) -> DataFrame:
    """Leverage for a target volatility under one flat correlation: the pair sum is corr*(sum wv)^2 + (1-corr)*sum (wv)^2."""
    x = F.col("weight") * F.col("vol")
    g = w.groupBy(*keys).agg(F.sqrt(corr * F.sum(x) * F.sum(x) + (1 - corr) * F.sum(x * x)).alias("port_vol"))
    return g.withColumn("leverage", F.when(F.col("port_vol") > 0, clip(target / F.col("port_vol"), 0, cap)).otherwise(0.0))


def drawdown_scale(dd: Column, start: float = -0.08, floor: float = -0.20, low: float = 0.3) -> Column:
    return F.when(dd >= start, 1.0).when(dd <= floor, low).otherwise(1 - (dd - start) / (floor - start) * (1 - low))


def drawdown_tier(dd: Column) -> tuple[Column, Column]:
    """Scale and status of the documented tiers: the deepest threshold that is reached wins."""
    s, t = F.when(F.lit(False), 1.0), F.when(F.lit(False), "NORMAL")
    for limit, scale, name in DRAWDOWN_TIERS:
        s, t = s.when(dd <= limit, scale), t.when(dd <= limit, name)
    return s.otherwise(1.0), t.otherwise("NORMAL")


def position_caps(w: DataFrame, key: str, cap: float = 0.10, dust: float = 0.01, rounds: int = 10) -> DataFrame:
    """Up to ten rounds of capping and sharing the excess among the uncapped, then normalised.

    Only the few names over dust enter (at most 1/dust of a normalised book), so a book is a short array and the rounds
    are a fold over it."""
    g = w.where(F.col("weight") >= dust).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ticker", F.col("weight").alias("w")))).alias("a"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    state = F.struct(F.transform("a", lambda x: x["w"]).alias("w"), F.lit(False).alias("done"))

    def one(s, _):
        c = F.transform(s["w"], lambda x: F.least(x, F.lit(cap)))
        t = total(c)
        un = total(F.transform(c, lambda x: F.when(x < cap - 1e-6, x).otherwise(0.0)))
        stop = (1 - t <= 0.001) | (un == 0)
        nxt = F.transform(c, lambda x: F.when(stop, x / t).when(x < cap - 1e-6, x + (1 - t) * x / un).otherwise(x))
        return F.struct(F.when(s["done"], s["w"]).otherwise(nxt).alias("w"), (s["done"] | stop).alias("done"))

    g = g.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, one)).withColumn("t", total(F.col("f.w")))
    z = F.explode(F.arrays_zip(F.transform("a", lambda x: x["ticker"]).alias("ticker"), F.col("f.w").alias("w"))).alias("z")
    return g.select(key, "t", z).select(key, F.col("z.ticker").alias("ticker"), (F.col("z.w") / F.col("t")).alias("weight"))


def kelly(mu: Column, sigma: Column, prob: Column, rf: float = 0.05, fraction: float = 0.25, cap: float = 0.10) -> Column:
    f = (mu - rf) / (sigma * sigma) * (2 * prob - 1) * fraction
    return F.when(sigma <= 0, 0.0).otherwise(clip(f, -cap, cap))


def var_cvar(p: DataFrame, key: str, value: str, levels=(0.95, 0.99)) -> DataFrame:
    """Historical (order statistic), Cornish-Fisher and Gaussian value at risk per book. p: one row per (book, day)."""
    w = Window.partitionBy(key)
    x = p.withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    m, s, sk, ku = F.avg(value), F.stddev_pop(value), F.skewness(value), F.kurtosis(value)
    out = []
    for a in levels:
        cut = F.floor(F.col("n") * (1 - a))
        tag = int(a * 100)
        z = norm_ppf(F.lit(1 - a))
        cf = z + (z * z - 1) * sk / 6 + (z * z * z - 3 * z) * ku / 24 - (2 * z * z * z - 5 * z) * sk * sk / 36
        out += [(-F.max(F.when(F.col("i") == cut, F.col(value)))).alias(f"var_{tag}"), (-F.avg(F.when(F.col("i") < cut, F.col(value)))).alias(f"cvar_{tag}"), (-(m + s * cf)).alias(f"var_cf_{tag}"), (-(m + s * z)).alias(f"var_gauss_{tag}")]
    return x.groupBy(key).agg(*out, (s * ANN).alias("vol_annual"), sk.alias("skewness"), ku.alias("kurtosis"))


def tail_stats(p: DataFrame, key: str, value: str, q: float = 0.05) -> DataFrame:
    """Rows strictly below the q percentile of the book: mean, sample skew, count, Sharpe (population deviation)."""
    c = p.groupBy(key).agg(F.percentile(value, F.lit(q)).alias("q"))
    x = p.join(c, key).where(F.col(value) < F.col("q"))
    n = F.count(F.lit(1))
    return x.groupBy(key).agg((-F.first("q")).alias("tail_var"), (-F.avg(value)).alias("tail_cvar"), F.when(n > 3, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0).alias("tail_skewness"), n.alias("n_tail"),
                              (F.avg(value) / F.stddev_pop(value) * ANN).alias("tail_sharpe"))


def regime_bayes(prior: DataFrame, slope: Column, smoothing: float = 0.30) -> DataFrame:
    """Prior x likelihood of the slope class, normalised, then smoothed with the prior. prior: id, regime, p and inputs."""
    cat = F.when(slope < -0.5, "inverted").when(slope < 0, "flat").when(slope < 1.0, "normal").otherwise("steep")
    lk = F.create_map(*[y for c, ps in SLOPE_LIKELIHOOD.items() for r, v in zip(REGIMES, ps) for y in (F.lit(f"{c}|{r}"), F.lit(v))])
    x = prior.withColumn("like", F.try_element_at(lk, F.concat_ws("|", cat, F.col("regime"))) * F.col("p"))
    w = Window.partitionBy("id")
    x = x.withColumn("post", F.col("like") / F.sum("like").over(w))
    x = x.withColumn("_s", (1 - smoothing) * F.col("post") + smoothing * F.col("p"))
    return x.select("id", "regime", "post", (F.col("_s") / F.sum("_s").over(w)).alias("smoothed"))


def ic_health(ics: DataFrame, key: str, order: str, fast: int = 21, slow: int = 63, expected: float = 0.05, quarantine: float = -0.02, q_days: int = 10, watch: float = 0.0, minimum: float = 0.02) -> DataFrame:
    """Mean, recent mean, decay t and the action ladder per series, with the trailing run below the quarantine level."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    x = ics.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    x = x.withColumn("bad", F.sum(F.when(F.col("ic") < quarantine, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rec, old = F.when(F.col("k") <= fast, F.col("ic")), F.when(F.col("k") > fast, F.col("ic"))
    n, n1, n2 = F.count("ic"), F.count(rec), F.count(old)
    sp = ((n1 - 1) * F.var_samp(rec) + (n2 - 1) * F.var_samp(old)) / (n1 + n2 - 2)
    g = x.groupBy(key).agg(n.alias("n"), F.avg("ic").alias("mean_ic"), F.avg(rec).alias("recent_ic"), (F.avg("ic") / (F.stddev_pop("ic") + 1e-10)).alias("icir"), F.when(n >= slow, (F.avg(rec) - F.avg(old)) / F.sqrt(sp * (1 / n1 + 1 / n2))).otherwise(0.0).alias("t_decay"),
                           F.avg(old).alias("old"), F.sum((F.col("bad") == 0).cast("int")).alias("days_below"))
    decay = (F.abs("t_decay") > 1.645) & (F.col("recent_ic") < F.col("old"))
    act = (F.when(F.col("days_below") >= q_days, "QUARANTINE").when(F.col("recent_ic") < watch, "WATCH").when(decay & (F.col("recent_ic") < expected * 0.5), "REVIEW").when(F.col("mean_ic") < minimum, "MONITOR").otherwise("MAINTAIN"))
    return g.where("n >= 5").withColumn("action", act).select(key, "n", "mean_ic", "recent_ic", "icir", "t_decay", "days_below", "action",
                                                              F.when(act.isin("QUARANTINE", "WATCH"), F.greatest(F.lit(0.0), F.col("recent_ic") / (expected + 1e-10))).otherwise(1.0).alias("weight"))


def live_divergence(x: DataFrame) -> DataFrame:
    """Live against back-test ratios. x: key columns, sharpe_bt, sharpe_live, ic_bt, ic_live, vol_bt, vol_live, live_days."""
    r = lambda a: F.col(a + "_live") / (F.col(a + "_bt") + 1e-10)
    crit, warn = (r("sharpe") < 0.20) | (r("ic") < 0.20), (r("sharpe") < 0.50)
    viol = F.array_compact(F.array(F.when(r("sharpe") < 0.2, "sharpe_critical").when(r("sharpe") < 0.5, "sharpe_warning"), F.when(r("ic") < 0.2, "ic_critical").when(r("ic") < 0.5, "ic_warning"), F.when(r("vol") > 2.5, "vol_warning")))
    act = F.when(F.col("live_days") < 60, "INSUFFICIENT").when(crit, "QUARANTINE").when(warn, "REDUCE_WEIGHT").when(F.size(viol) > 0, "MONITOR").otherwise("MAINTAIN")
    return x.withColumn("violations", F.array_join(viol, ",")).withColumn("action", act)


def capital_allocation(w: DataFrame, key: str, target: float = 0.10, max_lev: float = 1.5, max_gross: float = 1.0) -> DataFrame:
    """Weights times the most cautious of volatility scale, regime and drawdown multipliers, then a gross cap.
    w: key, ticker, weight, realized_vol, drawdown, regime."""
    reg = F.create_map(*[y for k, v in RISK_MULTIPLIER.items() for y in (F.lit(k), F.lit(v))])
    vs = F.when(F.col("realized_vol") <= 0, 1.0).otherwise(clip(target / F.col("realized_vol"), 0.25, max_lev))
    mult = F.least(vs, F.coalesce(F.try_element_at(reg, F.col("regime")), F.lit(1.0)), drawdown_tier(F.col("drawdown"))[0])
    x = w.withColumn("multiplier", mult).withColumn("_w", F.col("weight") * F.col("multiplier"))
    g = x.groupBy(key).agg(F.sum(F.abs("_w")).alias("gross"))
    return x.join(g, key).select(key, "ticker", "multiplier", (F.col("_w") * F.when(F.col("gross") > max_gross, max_gross / F.col("gross")).otherwise(1.0)).alias("final_weight"))


def reduce_capital(x: DataFrame, target: float = 0.10) -> DataFrame:
    t = F.array_compact(F.array(F.when(F.col("realized_vol") > 2 * target, "vol"), F.when(F.col("drawdown") < -0.10, "drawdown"), F.when(F.col("regime").isin("BEAR_LOW_VOL", "BEAR_HIGH_VOL"), "regime"), F.when(F.col("psi") > 0.25, "psi")))
    return x.withColumn("triggers", F.array_join(t, ",")).withColumn("urgency", F.when(F.size(t) >= 2, "IMMEDIATE").when(F.size(t) == 1, "ELEVATED").otherwise("NONE"))
