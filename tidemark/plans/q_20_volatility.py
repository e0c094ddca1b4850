"""Volatility and microstructure with their oracles."""

from tidemark.operators import volatility as X
from tidemark.plans.oracle import W, full
from tidemark.plans.q_10_technical import ANN, reg

NV = (5, 10, 21, 42, 63, 126, 252)
reg("realized_vol", "ticker " + " ".join(f"realized_vol_{n}d" for n in NV) + " vol_of_vol vol_regime_mean vol_persistence vol_ratio_short_long historical_vol realized_vol_1m",
    "SELECT ticker, " + ", ".join(f"CASE WHEN count(r) >= {n} THEN stddev_samp(CASE WHEN k < {n} THEN r END) * {ANN} END AS realized_vol_{n}d" for n in NV) + f""",
    CASE WHEN count(r) >= 252 THEN stddev_samp(rv) END AS vol_of_vol, CASE WHEN count(r) >= 252 THEN avg(rv) END AS vol_regime_mean,
    CASE WHEN count(r) >= 252 THEN corr(rv, rv1) END AS vol_persistence,
    CASE WHEN count(r) >= 63 THEN stddev_samp(CASE WHEN k < 21 THEN r END) * {ANN} / (stddev_samp(CASE WHEN k < 63 THEN r END) * {ANN} + 1e-10) END AS vol_ratio_short_long,
    stddev_pop(r) * {ANN} AS historical_vol, stddev_pop(CASE WHEN k < 21 THEN r END) * {ANN} AS realized_vol_1m
    FROM (SELECT *, lag(rv) OVER w AS rv1 FROM (SELECT *, {full('stddev_samp(r)', 21)} * {ANN} AS rv FROM tails {W}) {W}) GROUP BY ticker""", X.realized_vol, "tails")
reg("downside_deviation", "ticker downside_dev downside_vol up_vol", f"""SELECT ticker, CASE WHEN count(CASE WHEN k < 63 AND r < 0 THEN r END) < 2 THEN 0
    ELSE sqrt(avg(CASE WHEN k < 63 AND r < 0 THEN r * r END)) * {ANN} END AS downside_dev,
    CASE WHEN count(*) FILTER (r < 0) > 2 THEN stddev_pop(r) FILTER (r < 0) * {ANN} END AS downside_vol,
    CASE WHEN count(*) FILTER (r > 0) > 2 THEN stddev_pop(r) FILTER (r > 0) * {ANN} END AS up_vol FROM tails GROUP BY ticker""", X.downside_deviation, "tails")
reg("parkinson", "ticker d parkinson_vol", f"SELECT ticker, d, sqrt({full('sum(x)', 21)} / (4 * 21 * ln(2))) * {ANN} AS parkinson_vol FROM (SELECT *, pow(ln(h / l), 2) AS x FROM rets) {W}", X.parkinson)
reg("garman_klass", "ticker d garman_klass_vol", f"""SELECT ticker, d, CASE WHEN m >= 0 THEN sqrt(m) * {ANN} END AS garman_klass_vol FROM (SELECT ticker, d, {full('avg(x)', 21)} AS m
    FROM (SELECT *, 0.5 * pow(ln(h / l), 2) - (2 * ln(2) - 1) * pow(ln(c / o), 2) AS x FROM rets) {W})""", X.garman_klass)
reg("yang_zhang", "ticker d yang_zhang_vol", f"""SELECT ticker, d, sqrt(greatest(yz, 0.0)) * {ANN} AS yang_zhang_vol FROM (SELECT ticker, d, {full('var_samp(oc)', 21)} + kk * {full('var_samp(co)', 21)}
    + (1 - kk) * {full('avg(rs)', 21)} AS yz FROM (SELECT *, ho * (ho - co) + lo * (lo - co) AS rs, 0.34 / (1.34 + 22.0 / 20.0) AS kk FROM (SELECT *, ln(o / lag(c) OVER w) AS oc, ln(c / o) AS co,
    ln(h / o) AS ho, ln(l / o) AS lo FROM rets {W})) {W}) WHERE yz IS NOT NULL""", X.yang_zhang)
reg("ewma_vol_ensemble", "ticker d vol_estimate vol_regime:s scale_factor", f"""SELECT ticker, d, vol_estimate, vol_regime, greatest(least(0.10 / vol_estimate, CASE vol_regime WHEN 'CRISIS' THEN 0.5
    WHEN 'ELEVATED' THEN 0.75 ELSE 1.0 END), 0.1) AS scale_factor FROM (SELECT *, CASE WHEN x > 2.5 THEN 'CRISIS' WHEN x > 1.5 THEN 'ELEVATED' WHEN x < 0.7 THEN 'CALM' ELSE 'NORMAL' END AS vol_regime
    FROM (SELECT *, vol_estimate / (hist + 1e-10) AS x FROM (SELECT *, greatest(0.5 * e + 0.3 * v21 + 0.2 * v63, 0.05) AS vol_estimate FROM (
    SELECT *, CASE WHEN rn >= 64 THEN s63 ELSE v21 END AS v63 FROM (SELECT *, CASE WHEN rn >= 22 THEN s21 ELSE e END AS v21 FROM (
    SELECT ticker, d, rn, sqrt(252 * (0.06 * sum(CASE WHEN rn > 1 THEN r * r * pow(0.94, -rn) END) OVER (w ROWS UNBOUNDED PRECEDING) * pow(0.94, rn))) AS e,
    stddev_samp(r) OVER (w ROWS 20 PRECEDING) * {ANN} AS s21, stddev_samp(r) OVER (w ROWS 62 PRECEDING) * {ANN} AS s63,
    CASE WHEN rn >= 253 THEN stddev_samp(r) OVER (w ROWS UNBOUNDED PRECEDING) * {ANN} ELSE 0.15 END AS hist FROM rets {W}))) WHERE rn >= 6)))""", X.ewma_vol_ensemble)
reg("vol_percentile", "ticker vol_percentile vol_below current_vol", f"""SELECT ticker, (2 * count(*) FILTER (rv < cur) + count(*) FILTER (rv = cur) + 1) * 50.0 / count(*) AS vol_percentile,
    100.0 * count(*) FILTER (rv < cur) / count(*) AS vol_below, max(cur) AS current_vol FROM (SELECT *, max(CASE WHEN k = 0 THEN rv END) OVER (PARTITION BY ticker) AS cur FROM
    (SELECT *, {full('stddev_samp(r)', 21)} * {ANN} AS rv FROM tails {W}) WHERE rv IS NOT NULL) GROUP BY ticker""", X.vol_percentile, "tails")
reg("vol_term_structure", "ticker horizon:i vol", """SELECT ticker, horizon, sqrt(greatest(lrv + pow(p, horizon) * (v0 - lrv), 0.0) * 252) AS vol FROM
    (SELECT ticker, arg_max(r * r, d) AS v0, 0.98 AS p, 0.000002 / (1 - 0.98 + 1e-10) AS lrv FROM rets WHERE r IS NOT NULL GROUP BY ticker), (SELECT unnest([1, 5, 10, 21, 42, 63, 126, 252]) AS horizon)""",
    lambda b: X.vol_term_structure(b, 0.000002, 0.05, 0.04, 0.91))
HURST = """lags AS (SELECT unnest(range(2, 100)) AS lag), nn AS (SELECT ticker, count(r) AS nn FROM rets GROUP BY 1),
ch AS (SELECT r.ticker, lag, (rn - 2) // lag AS ch, rn, r, avg(r) OVER p AS m, stddev_pop(r) OVER p AS sd FROM rets r JOIN nn USING (ticker), lags
    WHERE rn >= 2 AND ((rn - 2) // lag) * lag < nn - lag WINDOW p AS (PARTITION BY r.ticker, lag, (rn - 2) // lag)),
cu AS (SELECT ticker, lag, ch, sd, sum(r - m) OVER (PARTITION BY ticker, lag, ch ORDER BY rn ROWS UNBOUNDED PRECEDING) AS dev FROM ch),
rs AS (SELECT ticker, lag, avg(x) AS x FROM (SELECT ticker, lag, ch, (max(dev) - min(dev)) / (max(sd) + 1e-10) AS x FROM cu GROUP BY 1, 2, 3) GROUP BY 1, 2),
h1 AS (SELECT ticker, greatest(least(regr_slope(ln(x), ln(lag)), 1.0), 0.0) AS hurst FROM rs GROUP BY 1),
v AS (SELECT ticker, rn, c FROM tails WHERE k < 252),
df AS (SELECT a.ticker, lag, stddev_pop(a.c - b.c) AS tau FROM lags JOIN v a ON lag < 50 JOIN v b ON a.ticker = b.ticker AND b.rn = a.rn - lag GROUP BY 1, 2),
h2 AS (SELECT ticker, greatest(least(regr_slope(ln(tau), ln(lag)), 1.0), 0.0) AS hurst_diff FROM df GROUP BY 1)"""
HURST_LOG = """gch AS (SELECT r.ticker, lag, (rn - 2) // lag AS ch, rn, lr, avg(lr) OVER p AS m, stddev_samp(lr) OVER p AS sd FROM rets r JOIN nn USING (ticker), lags WHERE rn >= 2 AND lag BETWEEN 10 AND 49 AND ((rn - 2) // lag) * lag < nn - lag WINDOW p AS (PARTITION BY r.ticker, lag, (rn - 2) // lag)),
gcu AS (SELECT ticker, lag, ch, sd, sum(lr - m) OVER (PARTITION BY ticker, lag, ch ORDER BY rn ROWS UNBOUNDED PRECEDING) AS dev FROM gch),
grs AS (SELECT ticker, lag, avg(x) AS x FROM (SELECT ticker, lag, ch, (max(dev) - min(dev)) / max(sd) AS x FROM gcu WHERE sd > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2), h3 AS (SELECT ticker, greatest(least(regr_slope(ln(x), ln(lag)), 0.95), 0.1) AS hurst_log FROM grs GROUP BY 1)"""
reg("hurst_rs", "ticker hurst hurst_log hurst_diff", "SELECT * FROM h1 JOIN h2 USING (ticker) JOIN h3 USING (ticker)", X.hurst_rs, "tails", HURST + ", " + HURST_LOG)
WT = X.fracdiff_weights(0.4)
reg("fracdiff", "ticker d fracdiff", f"""SELECT ticker, d, CASE WHEN len(x) = {len(WT)} THEN list_sum(list_transform(list_zip(x, ww), lambda z: z[1] * z[2])) END AS fracdiff
    FROM (SELECT ticker, d, list(c) OVER (w ROWS {len(WT) - 1} PRECEDING) AS x FROM rets {W}),
    (SELECT list_reverse(list(w ORDER BY k)) AS ww FROM (WITH RECURSIVE z(k, w) AS (SELECT 0, CAST(1.0 AS DOUBLE) UNION ALL SELECT k + 1, -w * (0.4 - k) / (k + 1) FROM z WHERE k < {len(WT) - 1}) SELECT * FROM z))""",
    X.fracdiff)
reg("fracdiff_min_d", "ticker d_variance:2 d_dickey_fuller:2", """SELECT ticker, coalesce(min(g) FILTER (m >= 20 AND vr < 1.5), 1.0) AS d_variance, coalesce(min(g) FILTER (t < -2.86), 1.0) AS d_dickey_fuller FROM (
    SELECT ticker, g, max(m) AS m, var_pop(y) FILTER (i > m // 2) / (var_pop(y) + 1e-10) AS vr, corr(y - y1, y1) * sqrt((count(y1) - 2) / (1 - corr(y - y1, y1) * corr(y - y1, y1))) AS t FROM (
    SELECT ticker, g, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY ticker, g) AS m, lag(y) OVER w AS y1 FROM (
    SELECT ticker, d, g, list_sum(list_transform(list_zip(x, ww), lambda z: z[1] * z[2])) AS y FROM (SELECT ticker, d, rn, list(ln(c)) OVER (w ROWS 49 PRECEDING) AS x FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY d)),
    (SELECT g, list_reverse(list(w ORDER BY k)) AS ww FROM (WITH RECURSIVE z(g, k, w) AS (SELECT q / 10.0, 0, CAST(1.0 AS DOUBLE) FROM range(1, 11) t(q) UNION ALL SELECT g, k + 1, -w * (g - k) / (k + 1) FROM z WHERE k < 49)
    SELECT * FROM z) GROUP BY g) WHERE rn >= 50) WINDOW w AS (PARTITION BY ticker, g ORDER BY d)) GROUP BY ticker, g) GROUP BY ticker""", X.fracdiff_min_d)
reg("df_statistic", "ticker adf_statistic:5", f"""SELECT ticker, corr(lr, lp1) * sqrt((count(*) - 2) / (1 - corr(lr, lp1) * corr(lr, lp1))) AS adf_statistic FROM
    (SELECT ticker, lr, ln(lag(c) OVER w) AS lp1 FROM rets {W}) WHERE lr IS NOT NULL GROUP BY ticker""", X.df_statistic)
reg("ar1_half_life", "ticker ar1_beta half_life_days:4 kappa theta half_life_ou:4 mean_rev_signal", f"""SELECT ticker, ar1_beta, CASE WHEN ar1_beta > -1 AND ar1_beta < 0 THEN least(-ln(2) / ln(1 + ar1_beta), 999) ELSE 999 END AS half_life_days,
    CASE WHEN b < 0 THEN -b END AS kappa, CASE WHEN b < 0 THEN -a / b END AS theta, CASE WHEN b < 0 THEN ln(2) / -b END AS half_life_ou, CASE WHEN b < 0 THEN (lp + a / b) * b ELSE 0 END AS mean_rev_signal
    FROM (SELECT ticker, regr_slope(r, r1) AS ar1_beta, regr_slope(lr, lp1) AS b, regr_intercept(lr, lp1) AS a, arg_max(ln(c), d) AS lp FROM
    (SELECT *, lag(r) OVER w AS r1, ln(lag(c) OVER w) AS lp1 FROM rets {W}) GROUP BY ticker)""", X.ar1_half_life)
reg("autocorr_vol_clustering", "ticker acf_lag1 acf_lag5 vol_clustering skewness excess_kurtosis", f"""SELECT ticker, corr(r, r1) AS acf_lag1, corr(r, r5) AS acf_lag5, corr(r * r, r1 * r1) AS vol_clustering,
    avg(pow(z, 3)) AS skewness, avg(pow(z, 4)) - 3 AS excess_kurtosis FROM (SELECT *, (r - avg(r) OVER (PARTITION BY ticker)) / stddev_pop(r) OVER (PARTITION BY ticker) AS z FROM
    (SELECT *, lag(r) OVER w AS r1, lag(r, 5) OVER w AS r5 FROM rets {W})) GROUP BY ticker""", X.autocorr_vol_clustering)
KAL = f"""kq AS (SELECT ticker, var_pop(dc) AS q, var_pop(lr) * avg(c) * avg(c) AS rr, max(rn) AS n FROM (SELECT *, c - lag(c) OVER w AS dc FROM rets {W}) GROUP BY 1),
kf AS (WITH RECURSIVE z(ticker, rn, x, p, k) AS (SELECT ticker, rn, c, rr, CAST(0 AS DOUBLE) FROM rets JOIN kq USING (ticker) WHERE rn = 1 UNION ALL
    SELECT z.ticker, b.rn, z.x + (z.p + q) / (z.p + q + rr + 1e-10) * (b.c - z.x), (1 - (z.p + q) / (z.p + q + rr + 1e-10)) * (z.p + q), (z.p + q) / (z.p + q + rr + 1e-10)
    FROM z JOIN kq ON z.ticker = kq.ticker JOIN rets b ON b.ticker = z.ticker AND b.rn = z.rn + 1) SELECT * FROM z)"""
reg("kalman_local_level", "ticker snr filtered_price:5 kalman_gain trend_slope trend_acceleration:5 signal:s", """SELECT a.ticker, q / (rr + 1e-10) AS snr, a.x AS filtered_price, a.k AS kalman_gain,
    (a.x - b.x) / (b.x + 1e-10) AS trend_slope, a.x - 2 * b.x + c.x AS trend_acceleration, CASE WHEN q / (rr + 1e-10) > 0.1 THEN 'STRONG_TREND' WHEN q / (rr + 1e-10) > 0.01 THEN 'WEAK_TREND' ELSE 'MEAN_REVERTING' END AS signal
    FROM kq JOIN kf a ON a.ticker = kq.ticker AND a.rn = n JOIN kf b ON b.ticker = a.ticker AND b.rn = n - 4 JOIN kf c ON c.ticker = a.ticker AND c.rn = n - 9""", X.kalman_local_level, "rets", KAL)
reg("amihud", "ticker d amihud_volume_return:4 amihud_dollar_21:4 amihud_dollar_60:2", f"""SELECT ticker, d, {full('avg(abs(r) / (m + 1e-10))', 21)} * 1e6 AS amihud_volume_return,
    {full('avg(abs(r) / (c * v))', 21)} * 1e6 AS amihud_dollar_21, {full('avg(coalesce(abs(r), 0) / (c * v + 1))', 60)} * 1e9 AS amihud_dollar_60
    FROM (SELECT *, {full('avg(v * abs(r))', 21)} AS m FROM rets {W}) {W}""", X.amihud)
reg("kyle_lambda", "ticker d kyle_lambda:8", f"""SELECT ticker, d, CASE WHEN rn > 21 THEN covar_samp(r, v) OVER (w ROWS 20 PRECEDING) / (var_pop(v) OVER (w ROWS 20 PRECEDING) + 1e-10) END AS kyle_lambda FROM rets {W}""", X.kyle_lambda)
reg("roll_spread", "ticker d roll_spread", f"""SELECT ticker, d, CASE WHEN rn > 21 THEN CASE WHEN cv >= 0 THEN 0.001 ELSE 2 * sqrt(-cv) END END AS roll_spread FROM
    (SELECT *, corr(r, r1) OVER (w ROWS 19 PRECEDING) * var_samp(r) OVER (w ROWS 20 PRECEDING) AS cv FROM (SELECT *, lag(r) OVER w AS r1 FROM rets {W}) {W})""", X.roll_spread)
reg("vpin", "ticker d vpin", f"""SELECT ticker, d, CASE WHEN m IS NULL THEN NULL ELSE least(greatest(m, 0.0), 1.0) END AS vpin FROM (SELECT ticker, d, {full('avg(x)', 50)} AS m FROM
    (SELECT *, abs((CASE WHEN r > 0 THEN v ELSE v * 0.5 END) - (CASE WHEN r < 0 THEN v ELSE v * 0.5 END)) / ((CASE WHEN r > 0 THEN v ELSE v * 0.5 END) + (CASE WHEN r < 0 THEN v ELSE v * 0.5 END) + 1e-10) AS x FROM rets) {W})""", X.vpin)
reg("order_flow_imbalance", "ticker ofi", f"""SELECT ticker, least(greatest((sum(CASE WHEN s > 0 THEN v ELSE 0 END) - sum(CASE WHEN s < 0 THEN v ELSE 0 END)) / (sum(v) + 1e-10), -1.0), 1.0) AS ofi
    FROM (SELECT *, {full('sum(r)', 5)} AS s FROM rets {W}) GROUP BY ticker""", X.order_flow_imbalance)


def positions(b):
    from pyspark.sql import functions as F

    from tidemark.functions.frames import with_tail

    return with_tail(b).groupBy("ticker").agg((F.sum(F.when(F.col("k") < 5, F.col("c") * F.col("v"))) * 3).alias("value"),
                                              F.avg(F.when(F.col("k") < 21, F.col("c") * F.col("v"))).alias("adv"))


reg("impact_cost", "ticker participation_rate permanent_bps:9 temporary_bps:9 total_bps:9 optimal_days days_to_liquidate shortfall_bps:9", """
    SELECT ticker, pr AS participation_rate, 2.5e-8 * sqrt(pr) * 10000 AS permanent_bps, 2.5e-7 * pr * (0.3 / sqrt(252.0)) * 10000 AS temporary_bps,
    2.5e-8 * sqrt(pr) * 10000 + 2.5e-7 * pr * (0.3 / sqrt(252.0)) * 10000 AS total_bps, least(sqrt(2.5e-7 / (2.5e-8 + 1e-15)) * sqrt(pr), 30) AS optimal_days, value / (adv * 0.2) AS days_to_liquidate,
    (2.5e-8 * sqrt(pr) * 10000 + 2.5e-7 * pr * (0.3 / sqrt(252.0)) * 10000) * 0.5 AS shortfall_bps FROM (SELECT *, value / (adv + 1e-10) AS pr FROM
    (SELECT ticker, sum(c * v) FILTER (k < 5) * 3 AS value, avg(c * v) FILTER (k < 21) AS adv FROM tails GROUP BY 1))""", lambda b: X.impact_cost(positions(b)), "tails")
reg("swing_extrema", "ticker d resistance:4 support:4", """SELECT * FROM (SELECT ticker, d, CASE WHEN count(*) OVER x = 21 AND h = max(h) OVER x THEN h END AS resistance,
    CASE WHEN count(*) OVER x = 21 AND l = min(l) OVER x THEN l END AS support FROM rets WINDOW x AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
    WHERE resistance IS NOT NULL OR support IS NOT NULL""", X.support_extrema)
