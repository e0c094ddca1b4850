"""Panel, model, back-test and remaining queries with their oracles (fits are rows-only checks)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import full, last_n, with_rolled_max, with_tail
from tidemark.operators import models as M
from tidemark.operators import ridge as R
from tidemark.operators import technical as T
from tidemark.operators import volatility as VO
from tidemark.operators.aggregates import ic_summary, rank_ic
from tidemark.operators.windows import cs_rank_minmax
from tidemark.plans.oracle import W
from tidemark.plans.oracle import full as sfull
from tidemark.plans.q_10_technical import ANN, BB, GL, MC, market, rets
from tidemark.plans.q_20_volatility import HURST, HURST_LOG
from tidemark.plans.q_30_sources_filters import reg
from tidemark.sources import views as V

c = F.col
FEATS = ["r_1m", "r_3m", "r_6m", "vol_21", "dd"]


def panel(s, d, every=1):
    """Month-end features of liquid names with the ranked 63-bar forward return, in one pass over the bars."""
    w = Window.partitionBy("ticker").orderBy("d")
    x = with_rolled_max(rets(s, d), "c", 252, "top").select("ticker", "d", "rn", (c("c") / F.lag("c", 21).over(w) - 1).alias("r_1m"), (c("c") / F.lag("c", 63).over(w) - 1).alias("r_3m"), (c("c") / F.lag("c", 126).over(w) - 1).alias("r_6m"),
                          (full(F.stddev_samp, "r", 21) * 252 ** 0.5).alias("vol_21"), (c("c") / c("top") - 1).alias("dd"), F.avg(c("c") * c("v")).over(last_n(21)).alias("adv"),
                          (F.lead("c", 64).over(w) / F.lead("c", 1).over(w) - 1).alias("fwd"), F.last_day("d").alias("m"))
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("ticker", "m").orderBy(c("d").desc()))).where("_k = 1 and rn >= 260 and adv >= 100")
    return x.withColumn("label", cs_rank_minmax("fwd", "m")).drop("_k", "rn", "adv")


PAN = f"""pb AS (SELECT *, CASE WHEN fwd IS NOT NULL AND count(fwd) OVER (PARTITION BY m) >= 2 THEN (row_number() OVER (PARTITION BY m, fwd IS NULL ORDER BY fwd, ticker) - 1) / (count(fwd) OVER (PARTITION BY m) - 1) END AS label FROM (SELECT ticker, d, rn, last_day(d) AS m, c / lag(c, 21) OVER w - 1 AS r_1m, c / lag(c, 63) OVER w - 1 AS r_3m, c / lag(c, 126) OVER w - 1 AS r_6m,
    {sfull('stddev_samp(r)', 21)} * {ANN} AS vol_21, c / max(c) OVER (w ROWS 251 PRECEDING) - 1 AS dd, avg(c * v) OVER (w ROWS 20 PRECEDING) AS adv, lead(c, 64) OVER w / lead(c, 1) OVER w - 1 AS fwd, row_number() OVER (PARTITION BY ticker, last_day(d) ORDER BY d DESC) AS k FROM rets {W}) WHERE k = 1 AND rn >= 260 AND adv >= 100)"""
reg("panel_build", "ticker d " + " ".join(FEATS) + " fwd label", "rets", "SELECT * FROM pb", panel, PAN)
reg("feature_matrix", "ticker d " + " ".join(FEATS), "rets", f"SELECT ticker, d, coalesce(r_1m, 0) AS r_1m, coalesce(r_3m, 0) AS r_3m, coalesce(r_6m, 0) AS r_6m, coalesce(vol_21, 0) AS vol_21, coalesce(dd, 0) AS dd FROM (SELECT ticker, d, rn, c / lag(c, 21) OVER w - 1 AS r_1m, c / lag(c, 63) OVER w - 1 AS r_3m, c / lag(c, 126) OVER w - 1 AS r_6m, {sfull('stddev_samp(r)', 21)} * {ANN} AS vol_21, c / max(c) OVER (w ROWS 251 PRECEDING) - 1 AS dd FROM rets {W}) WHERE rn % 21 = 0",
    lambda s, d: feature_matrix(s, d))


def feature_matrix(s, d, step=21):
    """Feature vector on every step-th row of each instrument, missing values as zero."""
    w = Window.partitionBy("ticker").orderBy("d")
    x = with_rolled_max(rets(s, d), "c", 252, "top").select("ticker", "d", "rn", (c("c") / F.lag("c", 21).over(w) - 1).alias("r_1m"), (c("c") / F.lag("c", 63).over(w) - 1).alias("r_3m"), (c("c") / F.lag("c", 126).over(w) - 1).alias("r_6m"), (full(F.stddev_samp, "r", 21) * 252 ** 0.5).alias("vol_21"), (c("c") / c("top") - 1).alias("dd"))
    return x.where(c("rn") % step == 0).select("ticker", "d", *[F.coalesce(c(f), F.lit(0.0)).alias(f) for f in FEATS])


def indexed(s, d):
    p = panel(s, d).where("label is not null")
    cal = p.select("m").distinct().withColumn("i", F.row_number().over(Window.orderBy("m")) - 1)  # one row per month
    return M.assemble(p.join(cal, "m"), FEATS).persist()


def model(s, d, build):
    p = indexed(s, d)
    return M.fit_predict(p.where("i < 24"), p.where("i >= 24"), build).select("ticker", "d", "label", "prediction")


def monthly(s, d):
    """Every month from the thirteenth on, predicted by a ridge on all months before."""
    p = R.dated(panel(s, d), "m")
    return R.walk_forward(p, FEATS, R.monthly_folds(p))


def blocks(s, d):
    """Three expanding folds with a gap before each test block."""
    p = R.dated(panel(s, d).where("label is not null"), "m")
    return R.walk_forward(p, FEATS, R.expanding_folds(p, embargo=3, min_train=12), least=1)


RIDGE = PAN + ", " + R.oracle(FEATS, "SELECT *, dense_rank() OVER (ORDER BY m) - 1 AS i FROM pb", "SELECT DISTINCT i AS fold, i AS train_end, i AS lo, i + 1 AS hi FROM pm WHERE i >= 12")
BLOCKS = PAN + ", " + R.oracle(FEATS, "SELECT *, dense_rank() OVER (ORDER BY m) - 1 AS i FROM pb WHERE label IS NOT NULL", "SELECT fold, 12 + fold * size AS train_end, 15 + fold * size AS lo, least(15 + (fold + 1) * size, n) AS hi FROM (SELECT n, greatest(5, (n - 15) // 3) AS size FROM (SELECT max(i) + 1 AS n FROM pm)), (SELECT unnest([0, 1, 2]) AS fold) WHERE least(15 + (fold + 1) * size, n) - (15 + fold * size) >= 2", least=1)
OIC = ", oi AS (SELECT m, corr(a, b) AS ic FROM (SELECT m, row_number() OVER (PARTITION BY m ORDER BY prediction, ticker) AS a, row_number() OVER (PARTITION BY m ORDER BY fwd, ticker) AS b FROM rp WHERE fwd IS NOT NULL) GROUP BY m HAVING count(*) >= 5)"
reg("cross_sectional_model", "ticker d fold:i label prediction", "rets", "SELECT ticker, d, fold, label, prediction FROM rp", monthly, RIDGE)
reg("boosted_regression", "ticker d label prediction", "", None, lambda s, d: model(s, d, lambda: M.boosted(3, 10)))
oof = lambda s, d: M.out_of_fold(indexed(s, d), lambda: M.ridge(1000), min_train=12, embargo=3)
reg("model_factory", "ticker d fold:i prediction", "rets", "SELECT ticker, d, fold, prediction FROM rp", blocks, BLOCKS)
reg("walk_forward_eval", "n:i mean_ic t_stat positive_share", "rets", "SELECT count(*) AS n, avg(ic) AS mean_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_stat, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS positive_share FROM oi",
    lambda s, d: ic_summary(rank_ic(monthly(s, d), ["m"], "prediction", "fwd", ordinal=True)), RIDGE + OIC)
reg("oof_ensemble", "ticker d ridge tree ensemble", "", None, lambda s, d: M.oof_ensemble(indexed(s, d), {"ridge": lambda: M.ridge(1000), "tree": lambda: M.boosted(2, 5)}, {"ridge": 0.6, "tree": 0.4}, ["ticker", "d"], embargo=3, min_train=12))
reg("feature_importance", "feature:s mdi mda sfi consensus", "", None, lambda s, d: M.importances(panel(s, d).persist(), FEATS))
reg("meta_model", "ticker d p_correct", "", None, lambda s, d: M.meta_model(oof(s, d).drop("features").withColumn("correct", ((c("prediction") > 0.5) == (c("label") > 0.5)).cast("double")), FEATS))


def market_state(s, d):
    w = Window.orderBy("d").rowsBetween(-20, 0)  # one row per session
    return market(s, d).where("mr is not null").withColumn("ret", F.avg("mr").over(w) * 252).withColumn("vol", F.stddev_samp("mr").over(w) * 252 ** 0.5).where("vol is not null")


reg("regime_clusters", "d ret vol regime:i", "", None, lambda s, d: M.regime_clusters(market_state(s, d), ["ret", "vol"]))
reg("panel_scoring", "ticker d r_1m r_3m", "rets", """SELECT ticker, d, CASE WHEN r_1m IS NULL THEN 0.5 ELSE least(len(list_filter(q1, lambda v: v < r_1m)) / 100, 1.0) END AS r_1m, CASE WHEN r_3m IS NULL THEN 0.5 ELSE least(len(list_filter(q3, lambda v: v < r_3m)) / 100, 1.0) END AS r_3m FROM pb, (SELECT quantile_cont(r_1m, list_transform(range(101), lambda i: i / 100.0)) AS q1, quantile_cont(r_3m, list_transform(range(101), lambda i: i / 100.0)) AS q3 FROM pb WHERE d < DATE '1999-01-01') WHERE d >= DATE '1999-01-01'""",
    lambda s, d: (lambda p: M.percentile_position(p.where("d >= date'1999-01-01'").select("ticker", "d", "r_1m", "r_3m"), p.where("d < date'1999-01-01'"), ["r_1m", "r_3m"]))(panel(s, d)), PAN)
reg("cs_signal_rank", "ticker d rank_pct", "rets", "SELECT ticker, d, (rank() OVER (PARTITION BY m ORDER BY r_3m) + (count(*) OVER (PARTITION BY m, r_3m) - 1) / 2.0) / count(*) OVER (PARTITION BY m) AS rank_pct FROM pb",
    lambda s, d: (lambda p, w: p.select("ticker", "d", ((F.rank().over(w.orderBy("r_3m")) + (F.count(F.lit(1)).over(Window.partitionBy("m", "r_3m")) - 1) / 2.0) / F.count(F.lit(1)).over(w)).alias("rank_pct")))(panel(s, d), Window.partitionBy("m")), PAN)


def variants(s, d):
    """z-score rules over the market series as competing strategies; thresholds and look-backs are given, not drawn."""
    x = market(s, d).where("mr is not null")
    w = Window.orderBy("d")  # one row per session
    out = []
    for k, (t, n) in enumerate(((0.3, 10), (0.5, 15), (0.7, 20), (0.9, 30))):
        f = w.rowsBetween(-(n - 1), 0)
        z = (c("mr") - F.avg("mr").over(f)) / (F.stddev_samp("mr").over(f) + 1e-10)
        out.append(F.struct(F.lit(k).alias("strategy"), F.when((F.count("mr").over(f) >= 5) & (z > t), c("mr")).when((F.count("mr").over(f) >= 5) & (z < -t), -c("mr")).otherwise(0.0).alias("r")))
    return x.select((F.row_number().over(w) - 1).alias("i"), F.array(*out).alias("a")).select("i", F.explode("a").alias("e")).select("i", "e.strategy", "e.r")


VARQ = " UNION ALL ".join(f"SELECT {k} AS strategy, i, CASE WHEN n{k} >= 5 AND z{k} > {t} THEN mr WHEN n{k} >= 5 AND z{k} < -{t} THEN -mr ELSE 0 END AS r FROM vz" for k, (t, n) in enumerate(((0.3, 10), (0.5, 15), (0.7, 20), (0.9, 30))))
VZ = "vz AS (SELECT mr, row_number() OVER (ORDER BY d) - 1 AS i, " + ", ".join(f"count(mr) OVER (ORDER BY d ROWS {n - 1} PRECEDING) AS n{k}, (mr - avg(mr) OVER (ORDER BY d ROWS {n - 1} PRECEDING)) / (stddev_samp(mr) OVER (ORDER BY d ROWS {n - 1} PRECEDING) + 1e-10) AS z{k}" for k, (t, n) in enumerate(((0.3, 10), (0.5, 15), (0.7, 20), (0.9, 30)))) + " FROM mkt WHERE mr IS NOT NULL)"
reg("threshold_variant_returns", "strategy:i i:i r:8", "mkt", VARQ, variants, VZ)
reg("ml_feature_sets", "ticker d rsi_14:5 macd:5 bb:5 vol_ratio", "rets", f"SELECT rs.ticker, rs.d, rsi_14, macd, bb_pct_b_20 AS bb, vol_ratio FROM rs JOIN m1 USING (ticker, d) JOIN bb USING (ticker, d) JOIN (SELECT ticker, d, v / ({sfull('avg(v)', 20)} + 1e-10) AS vol_ratio FROM rets {W}) USING (ticker, d)", lambda s, d: small_set(s, d), ", ".join((GL, MC, BB)))


def small_set(s, d):
    """Short feature list for tree models: RSI, MACD, band position, volume ratio; joined on the shared partitioning."""
    b = rets(s, d)
    return (T.rsi(b, (14,)).select("ticker", "d", "rsi_14").join(T.macd(b).select("ticker", "d", "macd"), ["ticker", "d"]).join(T.bollinger(b, (20,)).select("ticker", "d", c("bb_pct_b_20").alias("bb")), ["ticker", "d"])
            .join(T.volume_ratios(b).select("ticker", "d", c("volume_ratio").alias("vol_ratio")), ["ticker", "d"]))


def registered(s, d):
    r = M.FeatureRegistry()
    r.register("ret_21", "momentum", lambda b: b.select("ticker", "d", full(F.sum, "r", 21).alias("value")))
    r.register("vol_21", "risk", lambda b: b.select("ticker", "d", full(F.stddev_samp, "r", 21).alias("value")))
    t = r.compute(rets(s, d))
    return r.get(t, "ret_21", "1999-12-31").withColumn("feature", F.lit("ret_21")).unionByName(r.get(t, "vol_21", "1999-12-31").withColumn("feature", F.lit("vol_21")))


reg("feature_registry", "ticker feature:s as_of value", "rets", f"SELECT ticker, f AS feature, max(d) AS as_of, arg_max(v, d) AS value FROM (SELECT ticker, d, 'ret_21' AS f, {sfull('sum(r)', 21)} AS v FROM rets {W} UNION ALL SELECT ticker, d, 'vol_21', {sfull('stddev_samp(r)', 21)} FROM rets {W}) WHERE v IS NOT NULL AND d <= DATE '1999-12-31' GROUP BY 1, 2", registered)
# signal log, universes and distributions
reg("signal_log_sink", "id:i ticker at:s payload:s", "signals", """SELECT id, ticker, generated_at AS at, '{"model":"' || model || '","up":' || CASE WHEN signal > 0 THEN 'true' ELSE 'false' END || '}' AS payload FROM signals""",
    lambda s, d: V.signals(s, d).select("id", "ticker", c("generated_at").alias("at"), F.to_json(F.struct("model", (c("signal") > 0).alias("up"))).alias("payload")))
reg("exchange_universe", "ticker name:s market_cap:2", "universe", "SELECT ticker, name, market_cap FROM universe WHERE active AND bucket IN ('AMERICA', 'EUROPE', 'ASIA') ORDER BY market_cap DESC, ticker LIMIT 3000",
    lambda s, d: V.universe(s, d).where("active and bucket in ('AMERICA', 'EUROPE', 'ASIA')").orderBy(c("market_cap").desc(), "ticker").limit(3000))
reg("trailing_returns_matrix", "ticker d r:8", "tails", "SELECT ticker, d, r FROM tails WHERE k < 252 AND r IS NOT NULL", lambda s, d: with_tail(rets(s, d)).where("k < 252 and r is not null"))
reg("tsmom_vol_scaled", "ticker d signal strength", "rets", f"SELECT ticker, d, sign(x) / (v * {ANN}) AS signal, abs(x) / (v * {ANN}) AS strength FROM (SELECT ticker, d, ln(c / lag(c, 252) OVER w) AS x, stddev_samp(lr) OVER (w ROWS 62 PRECEDING) AS v FROM rets {W}) WHERE x IS NOT NULL",
    lambda s, d: (lambda w: rets(s, d).select("ticker", "d", F.log(c("c") / F.lag("c", 252).over(w)).alias("x"), (F.stddev_samp("lr").over(last_n(63)) * 252 ** 0.5).alias("v")).where("x is not null").select("ticker", "d", (F.signum("x") / c("v")).alias("signal"), (F.abs("x") / c("v")).alias("strength")))(Window.partitionBy("ticker").orderBy("d")))


def distribution(s, d, h=21):
    """Moments and percentiles scaled to a horizon, tail means, and the Hill index of the worst tenth (at least five)."""
    x = rets(s, d).where("r is not null").withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("r"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    x = x.withColumn("kk", F.greatest(F.lit(5), F.floor(c("n") * 0.1)))
    at = F.max(F.when(c("k") == c("kk"), F.abs("r")))
    q = F.percentile("r", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    g = x.groupBy("ticker").agg((F.avg("r") * h).alias("mean_h"), (F.stddev_samp("r") * h ** 0.5).alias("std_h"), q.alias("q"), at.alias("a"), F.sum(F.when((c("k") <= c("kk")) & (c("r") < 0), F.log(F.abs("r")))).alias("sl"), F.sum(((c("k") <= c("kk")) & (c("r") < 0)).cast("int")).alias("m"))
    rt = h ** 0.5
    return g.select("ticker", "mean_h", "std_h", (c("q")[0] * rt).alias("q05"), (c("q")[1] * rt).alias("q50"), (c("q")[2] * rt).alias("q95"), (1 / (c("sl") / c("m") - F.log("a"))).alias("hill"))


reg("return_distribution", "ticker mean_h std_h q05 q50 q95 hill:4", "rets", """SELECT ticker, avg(r) * 21 AS mean_h, stddev_samp(r) * sqrt(21) AS std_h, quantile_cont(r, 0.05) * sqrt(21) AS q05, quantile_cont(r, 0.5) * sqrt(21) AS q50, quantile_cont(r, 0.95) * sqrt(21) AS q95, 1 / (avg(ln(abs(r))) FILTER (k <= kk AND r < 0) - ln(max(abs(r)) FILTER (k = kk))) AS hill FROM
    (SELECT *, greatest(5, floor(nn * 0.1)) AS kk FROM (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY r) AS k, count(*) OVER (PARTITION BY ticker) AS nn FROM rets WHERE r IS NOT NULL)) GROUP BY ticker""", distribution)


def directional(s, d):
    """Fixed-weight mean of nine clipped signals of the newest bar, with its class."""
    b = rets(s, d)
    w = Window.partitionBy("ticker").orderBy("d")
    m = b.select("ticker", "d", ((c("c") / F.lag("c", 63).over(w) - 1) * 100).alias("m63"), ((c("c") / F.lag("c", 252).over(w) - 1) * 100).alias("m252"), ((c("c") / F.lag("c", 5).over(w) - 1) * 100).alias("m5"), (c("v") / full(F.avg, "v", 20)).alias("rv"), full(F.avg, "c", 50).alias("a50"), full(F.avg, "c", 200).alias("a200"))
    x = m.join(T.rsi(b, (14,)).select("ticker", "d", "rsi_sma_14"), ["ticker", "d"]).join(T.macd(b).select("ticker", "d", "macd_hist"), ["ticker", "d"])
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(c("d").desc()))).where("_k = 1").join(VO.vol_percentile(b).select("ticker", "vol_percentile"), "ticker").join(VO.hurst_rs(b).select("ticker", "hurst_log"), "ticker")
    cn = lambda v, lo, hi: F.least(F.greatest((v - lo) / (hi - lo + 1e-10) * 2 - 1, F.lit(-1.0)), F.lit(1.0))
    pm = lambda k: F.when(k, 1.0).otherwise(-1.0)
    rs = F.when(c("rsi_sma_14") < 30, 1.0).when(c("rsi_sma_14") > 70, -1.0).otherwise(cn(50 - c("rsi_sma_14"), -20, 20))
    # a trending series repeats the momentum signal, a reverting one the RSI signal
    hs = F.when(c("hurst_log") > 0.55, cn(c("m63"), -20, 20)).when(c("hurst_log") < 0.45, rs).otherwise(0.0)
    sg = [(0.030, hs), (0.040, cn(c("m63"), -20, 20)), (0.035, pm(c("m252") > 0)), (-0.025, cn(-c("m5"), -5, 5)), (0.030, rs), (0.025, pm(c("macd_hist") > 0)), (0.020, cn(c("rv") * pm(c("m5") > 0), -3, 3)), (0.020, cn(50 - c("vol_percentile"), -50, 50)), (0.025, pm(c("a50") > c("a200")))]
    comp = sum((k * v for k, v in sg), F.lit(0.0)) / 0.25
    x = x.select("ticker", "d", comp.alias("composite"))
    return x.withColumn("signal", F.when(c("composite") > 0.3, "STRONG_BUY").when(c("composite") > 0.1, "BUY").when(c("composite") > -0.1, "NEUTRAL").when(c("composite") > -0.3, "SELL").otherwise("STRONG_SELL"))


CNQ = lambda v, lo, hi: f"least(greatest(({v} - ({lo})) / ({hi} - ({lo}) + 1e-10) * 2 - 1, -1.0), 1.0)"
RSQ = f"CASE WHEN rsi_sma_14 < 30 THEN 1.0 WHEN rsi_sma_14 > 70 THEN -1.0 ELSE {CNQ('50 - rsi_sma_14', -20, 20)} END"
PMQ = lambda k: f"CASE WHEN {k} THEN 1.0 ELSE -1.0 END"
DIRQ = f"""SELECT *, CASE WHEN composite > 0.3 THEN 'STRONG_BUY' WHEN composite > 0.1 THEN 'BUY' WHEN composite > -0.1 THEN 'NEUTRAL' WHEN composite > -0.3 THEN 'SELL' ELSE 'STRONG_SELL' END AS signal FROM (SELECT ticker, d, (0.040 * {CNQ('m63', -20, 20)} + 0.035 * {PMQ('m252 > 0')} - 0.025 * {CNQ('-m5', -5, 5)} + 0.030 * {RSQ} + 0.025 * {PMQ('macd_hist > 0')} + 0.020 * {CNQ(f"(rv * {PMQ('m5 > 0')})", -3, 3)}
    + 0.030 * CASE WHEN hurst_log > 0.55 THEN {CNQ('m63', -20, 20)} WHEN hurst_log < 0.45 THEN {RSQ} ELSE 0 END + 0.020 * {CNQ('50 - vp', -50, 50)} + 0.025 * {PMQ('a50 > a200')}) / 0.25 AS composite FROM
    (SELECT ticker, d, k, (c / lag(c, 63) OVER w - 1) * 100 AS m63, (c / lag(c, 252) OVER w - 1) * 100 AS m252, (c / lag(c, 5) OVER w - 1) * 100 AS m5, v / {sfull('avg(v)', 20)} AS rv, {sfull('avg(c)', 50)} AS a50, {sfull('avg(c)', 200)} AS a200 FROM tails {W}) JOIN (SELECT ticker, d, rsi_sma_14 FROM rs) USING (ticker, d) JOIN (SELECT ticker, d, macd_hist FROM m3) USING (ticker, d) JOIN h3 USING (ticker)
    JOIN (SELECT ticker, (2 * count(*) FILTER (rv < cur) + count(*) FILTER (rv = cur) + 1) * 50.0 / count(*) AS vp FROM (SELECT *, max(CASE WHEN k = 0 THEN rv END) OVER (PARTITION BY ticker) AS cur FROM (SELECT *, {sfull('stddev_samp(r)', 21)} * {ANN} AS rv FROM tails {W}) WHERE rv IS NOT NULL) GROUP BY ticker) USING (ticker) WHERE k = 0)"""
reg("directional_composite", "ticker d composite signal:s", "tails", DIRQ, directional, ", ".join((GL, MC, HURST[:HURST.index(",\nch AS")], HURST_LOG)))


def altdata(s, d):
    """Flow features: volume surge and trend, transaction surge, Amihud, price-volume divergence."""
    w = Window.partitionBy("ticker").orderBy("d")
    f = lambda k, a, z: F.avg(k).over(w.rowsBetween(a, z))
    x = rets(s, d).withColumn("il", F.abs("r") / (c("c") * c("v")) * 1e9)
    return x.select("ticker", "d", "rn", (f("v", -4, 0) / f("v", -39, -5) - 1).alias("unusual_volume"), (f("v", -9, 0) / f("v", -39, -10) - 1).alias("volume_trend"), (f("n", -4, 0) / f("n", -39, -5) - 1).alias("txn_surge"), f("il", -19, 0).alias("amihud"),
                    F.when((c("c") / F.lag("c", 9).over(w) - 1 > 0) & (f("v", -4, 0) / f("v", -9, -5) - 1 < -0.1), 1).otherwise(0).alias("divergence")).where("rn >= 40")


A = lambda k, a, z: f"avg({k}) OVER (w ROWS BETWEEN {a} PRECEDING AND {z} PRECEDING)" if z else f"avg({k}) OVER (w ROWS {a} PRECEDING)"
reg("altdata_flow_features", "ticker d unusual_volume volume_trend txn_surge amihud:2 divergence:i", "rets", f"""SELECT * FROM (SELECT ticker, d, rn, {A('v', 4, 0)} / {A('v', 39, 5)} - 1 AS unusual_volume, {A('v', 9, 0)} / {A('v', 39, 10)} - 1 AS volume_trend, {A('n', 4, 0)} / {A('n', 39, 5)} - 1 AS txn_surge, {A('il', 19, 0)} AS amihud,
    CASE WHEN c / lag(c, 9) OVER w - 1 > 0 AND {A('v', 4, 0)} / {A('v', 9, 5)} - 1 < -0.1 THEN 1 ELSE 0 END AS divergence FROM (SELECT *, abs(r) / (c * v) * 1e9 AS il FROM rets) {W}) WHERE rn >= 40""", altdata)


def backtest(s, d, top=10, cost=0.0016):
    """Monthly rotation: names ranked at the last bar before the month by 63-bar return, bought at the first open of the
    month, valued at their last close. Holdings of a month meet those of the month before in one aggregation, and only
    the chain over months (one row each) is sequential."""
    w = Window.partitionBy("ticker").orderBy("d")
    x = rets(s, d).select("ticker", "d", "o", "c", F.last_day("d").alias("m"), (c("c") / F.lag("c", 63).over(w) - 1).alias("score"))
    g = x.groupBy("ticker", "m").agg(F.min_by("o", "d").alias("o"), F.max_by("c", "d").alias("c"), F.max_by("score", "d").alias("score"))
    wm = Window.partitionBy("ticker").orderBy("m")
    g = g.withColumn("sig", F.when(F.lag("m").over(wm) == F.last_day(F.add_months("m", -1)), F.lag("score").over(wm))).where("sig is not null")
    p = Window.partitionBy("m")
    g = g.withColumn("k", F.row_number().over(p.orderBy(c("sig").desc(), "ticker"))).where(c("k") <= top).withColumn("w0", 1 / F.count(F.lit(1)).over(p)).withColumn("gr", c("c") / c("o"))
    g = g.withColumn("we", c("w0") * c("gr") / F.sum(c("w0") * c("gr")).over(p))
    e = g.select("ticker", F.explode(F.array(F.struct(c("m").alias("m"), c("w0").alias("w"), c("w0").alias("wn"), c("gr").alias("gr"), F.lit(1).alias("own")), F.struct(F.last_day(F.add_months("m", 1)).alias("m"), (-c("we")).alias("w"), F.lit(0.0).alias("wn"), F.lit(0.0).alias("gr"), F.lit(0).alias("own")))).alias("e")).select("ticker", "e.*")
    n = e.groupBy("m", "ticker").agg(F.sum("w").alias("dw"), F.sum(c("wn") * c("gr")).alias("g"), F.sum("own").alias("own"))
    r = n.groupBy("m").agg(F.sum(F.abs("dw")).alias("turnover"), F.sum("g").alias("growth"), F.sum("own").alias("n")).where("n > 0")
    run = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    return r.withColumn("nav", F.exp(F.sum(F.log(c("growth") * (1 - cost * c("turnover")))).over(run)) * 100000)


BT = """bx AS (SELECT ticker, last_day(d) AS m, arg_min(o, d) AS o, arg_max(c, d) AS c, arg_max(score, d) AS score FROM (SELECT *, c / lag(c, 63) OVER (PARTITION BY ticker ORDER BY d) - 1 AS score FROM rets) GROUP BY 1, 2),
by_ AS (SELECT *, CASE WHEN lag(m) OVER w = last_day(m - INTERVAL 1 MONTH) THEN lag(score) OVER w END AS sig FROM bx WINDOW w AS (PARTITION BY ticker ORDER BY m)), bk AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY sig DESC, ticker) AS k FROM by_ WHERE sig IS NOT NULL),
bw AS (SELECT ticker, m, c / o AS gr, 1.0 / count(*) OVER (PARTITION BY m) AS w0 FROM bk WHERE k <= 10), be AS (SELECT *, w0 * gr / sum(w0 * gr) OVER (PARTITION BY m) AS we FROM bw),
bt AS (SELECT coalesce(a.m, last_day(b.m + INTERVAL 1 MONTH)) AS m, sum(abs(coalesce(a.w0, 0) - coalesce(b.we, 0))) AS turnover, sum(a.w0 * a.gr) AS growth, count(a.ticker) AS n FROM be a FULL JOIN be b ON a.ticker = b.ticker AND a.m = last_day(b.m + INTERVAL 1 MONTH) GROUP BY 1)"""
reg("backtest_nav", "m:s n:i turnover growth nav:2", "rets", "SELECT *, exp(sum(ln(growth * (1 - 0.0016 * turnover))) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING)) * 100000 AS nav FROM bt WHERE n > 0", backtest, BT)
