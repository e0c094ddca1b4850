"""Composite scores, rankings and selections with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import composites as X
from tidemark.plans.q_10_technical import ANN, market, rets
from tidemark.plans.q_20_volatility import HURST
from tidemark.plans.q_30_sources_filters import CAP, reg
from tidemark.plans.q_50_windows import LEV, swing_levels
from tidemark.sources import views as V


def scores(s, d):
    return X.factor_scores(X.factor_inputs(rets(s, d)))


LS = lambda x, lo, hi: f"(CASE WHEN {x} IS NULL THEN 50 ELSE least(greatest(({x} - {lo}) / ({hi} - {lo}) * 100, 0.0), 100.0) END)"
SCORES = HURST + f""",
ft AS (SELECT *, CAST(-k AS DOUBLE) AS i, sum(v * coalesce(sign(r), 0)) OVER w AS obv, sum(CASE WHEN h = l THEN 0 ELSE (2 * c - l - h) / (h - l) * v END) OVER w AS ad FROM tails WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING)),
fi0 AS (SELECT ticker, count(*) AS n, count(r) AS nr, max(c) FILTER (k = 0) AS p0, max(c) FILTER (k = 20) AS p21, max(c) FILTER (k = 62) AS p63, max(c) FILTER (k = 125) AS p126, max(c) FILTER (k = 251) AS p252,
    stddev_samp(r) FILTER (k < 63) * {ANN} AS vol3, regr_slope(obv, i) FILTER (k < 63) / (abs(avg(obv) FILTER (k < 63)) + 1e-9) AS obv_slope, regr_slope(c, i) FILTER (k < 63) / (avg(c) FILTER (k < 63) + 1e-9) AS ps,
    regr_slope(ad, i) FILTER (k < 63) / (abs(avg(ad) FILTER (k < 63)) + 1e-9) AS ad_slope, avg(v) FILTER (k < 20) / avg(v) FILTER (k < 90) AS volume_surge, avg(abs(coalesce(r, 0)) / (c * v + 1)) FILTER (k < 60) * 1e9 AS amihud,
    avg(c) FILTER (k < 50) AS ma50, avg(c) FILTER (k < 200) AS ma200, stddev_samp(r) FILTER (k < 252) * {ANN} AS vol12, max(c) FILTER (k < 252) AS hi52, avg(r) FILTER (k < 504) * 252 / (stddev_samp(r) FILTER (k < 504) * {ANN}) AS sharpe_2y FROM ft GROUP BY 1),
dd2 AS (SELECT ticker, abs(min(c / m - 1)) AS max_dd_2y FROM (SELECT ticker, c, max(c) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) AS m FROM tails WHERE k < 504) GROUP BY 1),
fi AS (SELECT ticker, n, p21 / p252 - 1 AS mom_12_1, p0 / p126 - 1 AS mom_6m, p0 / p63 - 1 AS mom_3m, p0 / p21 - 1 AS mom_1m, (p0 / p63 - 1) / vol3 AS sharpe_3m, obv_slope, obv_slope - ps AS pvd, volume_surge, amihud, ad_slope,
    p0 / ma50 - 1 AS a50, p0 / ma200 - 1 AS a200, CASE WHEN p0 > ma50 AND ma50 > ma200 THEN 1 WHEN p0 < ma50 AND ma50 < ma200 THEN -1 ELSE 0 END AS al, (p0 / p252 - 1) / vol12 AS va, 1 - p0 / hi52 AS dist_from_high, sharpe_2y, max_dd_2y, hurst_diff AS hurst
    FROM fi0 JOIN dd2 USING (ticker) JOIN h2 USING (ticker)),
sc AS (SELECT *, 0.40 * {LS('mom_12_1', -0.2, 0.5)} + 0.25 * {LS('mom_6m', -0.15, 0.30)} + 0.20 * {LS('mom_3m', -0.1, 0.2)} + 0.15 * {LS('sharpe_3m', -1.0, 2.0)} AS momentum,
    0.30 * {LS('obv_slope', -0.02, 0.02)} + 0.25 * {LS('pvd', -0.01, 0.01)} + 0.20 * {LS('volume_surge', 0.7, 1.8)} + 0.15 * {LS('ad_slope', -0.02, 0.02)} + 0.10 * (100 - {LS('amihud', 0.1, 10.0)}) AS accumulation,
    0.25 * {LS('a50', -0.1, 0.15)} + 0.25 * {LS('a200', -0.2, 0.3)} + 0.20 * (50 + 50 * al) + 0.15 * {LS('hurst', 0.40, 0.65)} + 0.15 * {LS('va', -0.5, 2.0)} AS trend,
    0.40 * {LS('obv_slope', -0.02, 0.02)} + 0.35 * {LS('volume_surge', 0.7, 1.8)} + 0.25 * (100 - {LS('amihud', 0.1, 10.0)}) AS accumulation_bt,
    0.30 * {LS('a50', -0.1, 0.15)} + 0.30 * {LS('a200', -0.2, 0.3)} + 0.25 * (50 + 50 * al) + 0.15 * {LS('va', -0.5, 2.0)} AS trend_bt,
    CASE WHEN n >= 500 THEN 0.6 * {LS('sharpe_2y', -0.5, 1.5)} + 0.4 * {LS('max_dd_2y', 0.5, 0.1)} ELSE 50 END AS quality FROM fi),
hz AS (SELECT ticker, horizon, round(x, 2) AS composite FROM (SELECT ticker, 'short_term' AS horizon, 0.40 * momentum + 0.30 * accumulation + 0.20 * trend + 0.10 * quality AS x FROM sc UNION ALL
    SELECT ticker, 'medium_term', 0.35 * quality + 0.25 * momentum + 0.20 * trend + 0.20 * accumulation FROM sc UNION ALL SELECT ticker, 'long_term', 0.55 * quality + 0.20 * trend + 0.15 * momentum + 0.10 * accumulation FROM sc)),
rh AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY composite DESC, ticker) AS rank FROM hz),
brd AS (SELECT avg(CASE WHEN a200 > 0 THEN 1.0 ELSE 0 END) AS breadth FROM fi),
reg AS (SELECT CASE WHEN breadth < 0.30 THEN 'panic' WHEN breadth < 0.50 AND st < 20 THEN 'elevated' WHEN st < 12 THEN 'calm' WHEN st < 20 THEN 'normal' WHEN st < 32 THEN 'elevated' ELSE 'panic' END AS regime, st, breadth
    FROM brd, (SELECT stddev_samp(mr) * {ANN} * 100 AS st FROM (SELECT mr FROM mkt ORDER BY d DESC LIMIT 20)))"""
reg("composite_factor_scores", "ticker momentum:4 accumulation:4 trend:4 accumulation_bt:4 trend_bt:4 quality:4", "tails", "SELECT * FROM sc", scores, SCORES[:SCORES.index(",\nhz AS")])
reg("rank_by_horizon", "ticker horizon:s composite:2 rank:i", "tails", "SELECT * FROM rh", lambda s, d: X.rank_by_horizon(scores(s, d)), SCORES[:SCORES.index(",\nbrd AS")])
reg("trend_raw", "ticker pct_above_ma50 pct_above_ma200 ma_alignment:i vol_adj_return", "tails", "SELECT ticker, a50 AS pct_above_ma50, a200 AS pct_above_ma200, al AS ma_alignment, va AS vol_adj_return FROM fi", lambda s, d: X.factor_inputs(rets(s, d)), SCORES[:SCORES.index(",\nsc AS")])


def breadth(s, d):
    return X.factor_inputs(rets(s, d)).agg(F.avg((F.col("pct_above_ma200") > 0).cast("double")).alias("breadth"))


def regime_row(s, d):
    vol = market(s, d).orderBy(F.col("d").desc()).limit(20).agg((F.stddev_samp("mr") * (252 ** 0.5) * 100).alias("stress"))
    return vol.crossJoin(breadth(s, d)).select(X.regime(F.col("stress"), F.col("breadth")).alias("regime"), "stress", "breadth")


reg("breadth_above_ma", "breadth:3", "tails mkt", "SELECT breadth FROM brd", breadth, SCORES)
reg("regime_rules", "regime:s stress breadth", "tails mkt", "SELECT regime, st AS stress, breadth FROM reg", regime_row, SCORES)
reg("regime_rerank", "ticker horizon:s raw:2 composite:2 rank:i regime:s", "tails mkt", """SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY composite DESC, ticker) AS rank FROM (SELECT ticker, horizon, composite AS raw, regime,
    round(composite * CASE regime WHEN 'calm' THEN 1.10 WHEN 'normal' THEN 1.0 WHEN 'elevated' THEN 0.80 ELSE 0.50 END, 2) AS composite FROM hz, reg)""",
    lambda s, d: X.regime_rerank(X.rank_by_horizon(scores(s, d)), regime_row(s, d).select("regime")), SCORES)


def ascent(s, d):
    f = X.factor_inputs(rets(s, d))
    pc = [(F.col(c) * 100).alias(c) for c in ("mom_12_1", "mom_6m", "mom_3m", "mom_1m")]
    m = f.select("ticker", *pc, "sharpe_3m", "obv_slope", "volume_surge", "pct_above_ma200", "dist_from_high")
    return X.ascent_score(m.join(V.universe(s, d).select("ticker", (F.col("market_cap") * 2e5).alias("market_cap")), "ticker"))


CL = lambda x: f"least(greatest({x}, 0.0), 100.0)"
ASC = SCORES[:SCORES.index(",\nsc AS")] + f""",
as1 AS (SELECT fi.*, market_cap * 2e5 AS m, {CL('''(0.35 * least(greatest(50 + mom_12_1 * 100 / 100 * 50, 0.0), 100.0) + 0.25 * least(greatest(50 + mom_6m * 100 / 60 * 50, 0.0), 100.0) + 0.20 * least(greatest(50 + mom_3m * 100 / 40 * 50, 0.0), 100.0)
    + 0.10 * least(greatest(50 + mom_1m * 100 / 20 * 50, 0.0), 100.0) + 0.10 * least(greatest(50 + sharpe_3m * 20, 0.0), 100.0)) * CASE WHEN mom_12_1 > 0 AND mom_6m > 0 AND mom_3m > 0 AND mom_1m > 0 THEN 1.15 ELSE 1.0 END''')} AS strength,
    {CL('0.50 * least(greatest(50 + (volume_surge - 1) * 100, 0.0), 100.0) + 0.30 * least(greatest(50 + sign(obv_slope) * least(abs(obv_slope) * 200, 45.0), 0.0), 100.0) + 0.20 * least(greatest(50 + a200 * 50, 0.0), 100.0)')} AS volume FROM fi JOIN universe USING (ticker)),
as2 AS (SELECT *, {CAP} AS tier FROM as1),
as3 AS (SELECT *, {CL("0.5 * (5 - CASE tier WHEN 'nano' THEN 0 WHEN 'micro' THEN 1 WHEN 'small' THEN 2 WHEN 'large' THEN 4 WHEN 'mega' THEN 5 ELSE 3 END) / 5.0 * 100 + 0.5 * strength")} AS tier_score, {CL('100 - dist_from_high * 200')} AS high_score FROM as2)"""
reg("ascent_score", "ticker tier:s strength:4 volume:4 tier_score:4 high_score:4 ascent_score:4 flags:s", "tails universe", f"""SELECT *, {CL('0.35 * strength + 0.30 * volume + 0.20 * tier_score + 0.15 * high_score')} AS ascent_score, array_to_string(list_filter([
    CASE WHEN mom_12_1 > 0 AND mom_6m > 0 AND mom_3m > 0 AND mom_1m > 0 THEN 'all_horizons' END, CASE WHEN mom_3m * 100 > 30 THEN 'strong_3m' END, CASE WHEN sharpe_3m > 1.5 THEN 'risk_adjusted' END, CASE WHEN volume_surge > 1.4 THEN 'volume' END,
    CASE WHEN obv_slope > 0.05 THEN 'accumulation' END, CASE WHEN tier IN ('small', 'mid') AND strength > 60 THEN 'headroom' END, CASE WHEN dist_from_high < 0.05 THEN 'near_high' END], lambda x: x IS NOT NULL)[1:5], ',') AS flags FROM as3""", ascent, ASC)
reg("price_position_52w", "ticker pct_from_high:4 pct_from_low:4 range_percentile:4 relative_strength:4", "tails bench", """SELECT ticker, (p0 / hi - 1) * 100 AS pct_from_high, (p0 / lo - 1) * 100 AS pct_from_low, (p0 - lo) / (hi - lo) * 100 AS range_percentile, (p0 / p63 - 1 - b3) * 100 AS relative_strength FROM
    (SELECT ticker, max(c) AS hi, min(c) AS lo, max(c) FILTER (k = 0) AS p0, max(c) FILTER (k = 63) AS p63 FROM tails WHERE k < 252 GROUP BY 1), (SELECT max(c) FILTER (i = 1) / max(c) FILTER (i = 64) - 1 AS b3 FROM (SELECT c, row_number() OVER (ORDER BY d DESC) AS i FROM bench))""",
    lambda s, d: X.price_position(rets(s, d), V.bench(V.bars(s, d)).orderBy(F.col("d").desc()).limit(64).agg((F.max_by("c", "d") / F.min_by("c", "d") - 1).alias("b3"))))
reg("gap_range_expansion", "ticker d gap_frequency range_expansion", "rets", """SELECT ticker, d, CASE WHEN count(g) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(g) OVER (w ROWS 19 PRECEDING) END AS gap_frequency, CASE WHEN rn >= 30 AND avg(x) OVER (w ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) > 0 THEN avg(x) OVER (w ROWS 4 PRECEDING)
    / avg(x) OVER (w ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) - 1 END AS range_expansion FROM (SELECT ticker, d, rn, abs(o / lag(c) OVER w - 1) AS g, (h - l) / c AS x FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY d)) WINDOW w AS (PARTITION BY ticker ORDER BY d)""", lambda s, d: X.gap_range(rets(s, d)))


def short_records(s, d):
    return V.bars(s, d).groupBy("ticker", F.last_day("d").alias("date")).agg(F.sum(F.when(F.col("n") % 2 == 1, F.col("v")).otherwise(0.0)).alias("short_interest"), F.avg("v").alias("av")).withColumn("days_to_cover", F.col("short_interest") / F.col("av") / 2)


reg("short_interest", "ticker short_interest:2 days_to_cover trend squeeze_risk:s", "bars", """SELECT ticker, si1 AS short_interest, d1 AS days_to_cover, t AS trend, CASE WHEN d1 > 5 AND coalesce(t, 0) > 0.1 THEN 'elevated' WHEN d1 > 3 THEN 'moderate' ELSE 'low' END AS squeeze_risk FROM (SELECT *, CASE WHEN si1 <> 0 AND si2 > 0 THEN si1 / si2 - 1 END AS t FROM
    (SELECT ticker, max(si) FILTER (k = 1) AS si1, max(si) FILTER (k = 2) AS si2, max(si / av / 2) FILTER (k = 1) AS d1 FROM (SELECT ticker, last_day(d) AS dt, sum(CASE WHEN n % 2 = 1 THEN v ELSE 0 END) AS si, avg(v) AS av, row_number() OVER (PARTITION BY ticker ORDER BY last_day(d) DESC) AS k FROM bars GROUP BY 1, 2) GROUP BY 1))""",
    lambda s, d: X.short_interest(short_records(s, d)))


def sector_levels(s, d, b):
    """Sector level on every day of every instrument: mean log price path of its region, compounded per region."""
    f = V.factor_returns(s, d, b)
    lv = f.withColumn("sc", F.exp(F.sum(F.log1p("fr")).over(Window.partitionBy("f").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))).select("f", "d", "sc")
    m = V.table(s, d, "supplier").join(V.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ticker"), F.col("n_regionkey").alias("f"))
    return b.select("ticker", "d").join(m, "ticker").join(lv, ["f", "d"]).select("ticker", "d", "sc")


RSQ = ", ".join(f"(max(c) FILTER (k = 0) / max(c) FILTER (k = {k - 1}) - 1) - (max(sc) FILTER (k = 0) / max(sc) FILTER (k = {k - 1}) - 1) AS rs_{n}" for n, k in (("1m", 21), ("3m", 63), ("6m", 126), ("1y", 252)))
reg("relative_strength_capture", "ticker rs_1m rs_3m rs_6m rs_1y beta correlation up_capture:5 down_capture:5", "fret", f"""SELECT ticker, {RSQ}, covar_pop(y, x) FILTER (k < 125) / var_pop(x) FILTER (k < 125) AS beta, corr(y, x) FILTER (k < 125) AS correlation, avg(y) FILTER (k < 125 AND x > 0) / avg(x) FILTER (k < 125 AND x > 0) AS up_capture,
    avg(y) FILTER (k < 125 AND x < 0) / avg(x) FILTER (k < 125 AND x < 0) AS down_capture FROM (SELECT ticker, c, sc, count(*) OVER (PARTITION BY ticker) - row_number() OVER w AS k, c / lag(c) OVER w - 1 AS y, sc / lag(sc) OVER w - 1 AS x FROM rets JOIN supplier ON ticker = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN (SELECT d, f, exp(sum(ln(1 + fr)) OVER (PARTITION BY f ORDER BY d ROWS UNBOUNDED PRECEDING)) AS sc FROM fret) lv ON lv.f = n_regionkey AND lv.d = rets.d WINDOW w AS (PARTITION BY ticker ORDER BY rets.d)) GROUP BY ticker""",
    lambda s, d: (lambda b: X.relative_strength(b, sector_levels(s, d, b)))(rets(s, d)))


def all_levels(s, d):
    from tidemark.functions.frames import with_tail

    sw = swing_levels(s, d)
    t = with_tail(rets(s, d)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("k") == 0, F.col("c"))).alias("p0"), *[F.avg(F.when(F.col("k") < n, F.col("c"))).alias(f"m{n}") for n in (20, 50, 200)],
                                                    F.max(F.when(F.col("k") < 252, F.col("c"))).alias("hi"), F.min(F.when(F.col("k") < 252, F.col("c"))).alias("lo"))
    lv = [F.when(F.col("n") >= n, F.col(f"m{n}")) for n in (20, 50, 200)] + [F.when(F.col("n") >= 252, F.col("lo") + x * (F.col("hi") - F.col("lo"))) for x in (0.236, 0.382, 0.5, 0.618, 0.786)]
    extra = t.select("ticker", "p0", F.explode(F.array(*lv)).alias("level")).where("level is not null").select("ticker", F.when(F.col("level") < F.col("p0"), "support").otherwise("resistance").alias("kind"), "level")
    return sw.unionByName(extra), t.select("ticker", "p0")


SR = LEV[:LEV.index("\ncl AS")] + """
tt AS (SELECT ticker, count(*) AS n, max(c) FILTER (k = 0) AS p0, avg(c) FILTER (k < 20) AS m20, avg(c) FILTER (k < 50) AS m50, avg(c) FILTER (k < 200) AS m200, max(c) FILTER (k < 252) AS hi, min(c) FILTER (k < 252) AS lo FROM tails GROUP BY 1),
la AS (SELECT * FROM lv UNION ALL SELECT ticker, CASE WHEN level < p0 THEN 'support' ELSE 'resistance' END, level FROM (SELECT ticker, p0, unnest([CASE WHEN n >= 20 THEN m20 END, CASE WHEN n >= 50 THEN m50 END, CASE WHEN n >= 200 THEN m200 END, CASE WHEN n >= 252 THEN lo + 0.236 * (hi - lo) END,
    CASE WHEN n >= 252 THEN lo + 0.382 * (hi - lo) END, CASE WHEN n >= 252 THEN lo + 0.5 * (hi - lo) END, CASE WHEN n >= 252 THEN lo + 0.618 * (hi - lo) END, CASE WHEN n >= 252 THEN lo + 0.786 * (hi - lo) END]) AS level FROM tt) WHERE level IS NOT NULL),
cl AS (SELECT *, sum(nw) OVER (PARTITION BY ticker, kind ORDER BY level, nw DESC ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN level / lag(level) OVER (PARTITION BY ticker, kind ORDER BY level) - 1 < 0.01 THEN 0 ELSE 1 END AS nw FROM la)),
lc AS (SELECT ticker, kind, cluster, avg(level) AS level FROM cl GROUP BY 1, 2, 3), sr AS (SELECT tt.ticker, p0, list(level ORDER BY level DESC) FILTER (kind = 'support' AND level < p0 * 0.999) AS s, list(level ORDER BY level) FILTER (kind = 'resistance' AND level > p0 * 1.001) AS r
    FROM tt LEFT JOIN lc USING (ticker) GROUP BY 1, 2)"""
reg("support_resistance", "ticker support_1:5 support_2:5 resistance_1:5 resistance_2:5", "tails", "SELECT ticker, coalesce(s[1], p0 * 0.95) AS support_1, coalesce(s[2], p0 * 0.90) AS support_2, coalesce(r[1], p0 * 1.05) AS resistance_1, coalesce(r[2], p0 * 1.10) AS resistance_2 FROM sr",
    lambda s, d: X.support_resistance(*all_levels(s, d)), SR)
reg("expected_return_ensemble", "ticker mu_historical mu_capm mu_momentum mu_reversion mu_shrunk mu_ensemble", "tails", """SELECT *, 0.15 * mu_historical + 0.25 * mu_capm + 0.25 * mu_momentum + 0.15 * mu_reversion + 0.20 * mu_shrunk AS mu_ensemble FROM (SELECT ticker, h AS mu_historical, 0.107 AS mu_capm, 0.4 * h + 0.6 * CASE WHEN n >= 63 THEN rec ELSE h END AS mu_momentum,
    h - 0.3 * dist AS mu_reversion, greatest(0, 1 - 5 / (n / 252)) * h + (1 - greatest(0, 1 - 5 / (n / 252))) * 0.107 AS mu_shrunk FROM (SELECT ticker, avg(r) * 252 AS h, avg(r) FILTER (k < 63) * 252 AS rec, count(r) AS n, max(c) FILTER (k = 0) / avg(c) FILTER (k < 200) - 1 AS dist FROM tails GROUP BY 1))""",
    lambda s, d: X.expected_return(rets(s, d)))


def monthly_selection(s, d, frac=0.1):
    """Top and bottom fraction of each month by signal; a month holds one row per instrument."""
    m = V.bars(s, d).groupBy("ticker", F.last_day("d").alias("m")).agg((F.max_by("c", "d") / F.min_by("c", "d") - 1).alias("score"))
    p = Window.partitionBy("m")
    x = m.withColumn("r", F.row_number().over(p.orderBy(F.col("score").desc(), "ticker"))).withColumn("n", F.count(F.lit(1)).over(p)).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * frac)))
    return x.where((F.col("r") <= F.col("k")) | (F.col("r") > F.col("n") - F.col("k"))).withColumn("leg", F.when(F.col("r") <= F.col("k"), "long").otherwise("short"))


SEL = """ms AS (SELECT ticker, last_day(d) AS m, arg_max(c, d) / arg_min(c, d) - 1 AS score FROM bars GROUP BY 1, 2), mr AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, ticker) AS r, count(*) OVER (PARTITION BY m) AS n FROM ms),
sel AS (SELECT *, CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'long' ELSE 'short' END AS leg FROM mr WHERE r <= greatest(1, floor(n * 0.1)) OR r > n - greatest(1, floor(n * 0.1)))"""
reg("decile_selection", "ticker m:s score leg:s", "bars", "SELECT * FROM sel", monthly_selection, SEL)


def two_stage(s, d):
    """Largest 12 per tier, then the best 5 of those by score. Both cuts are top-k per group, trimmed before the shuffle."""
    sc = X.factor_inputs(rets(s, d)).select("ticker", "mom_12_1")
    u = V.universe(s, d).withColumn("tier", F.substring("sic_code", 4, 1)).join(sc, "ticker")
    a = u.withColumn("a", F.row_number().over(Window.partitionBy("tier").orderBy(F.col("market_cap").desc(), "ticker"))).where("a <= 12")
    return a.withColumn("b", F.row_number().over(Window.partitionBy("tier").orderBy(F.col("mom_12_1").desc(), "ticker"))).where("b <= 5")


reg("topn_per_tier_two_stage", "ticker tier:s market_cap:2 mom_12_1 b:i", "universe tails", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY mom_12_1 DESC, ticker) AS b FROM (SELECT u.*, substr(sic_code, 4, 1) AS tier, mom_12_1, row_number() OVER (PARTITION BY substr(sic_code, 4, 1) ORDER BY market_cap DESC, ticker) AS a
    FROM universe u JOIN fi USING (ticker)) WHERE a <= 12) WHERE b <= 5""", two_stage, SCORES[:SCORES.index(",\nsc AS")])
