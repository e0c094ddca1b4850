"""Technical features with their oracles."""


from tidemark.functions.frames import with_returns
from tidemark.operators import technical as T
from tidemark.plans.oracle import W, ewm, full, with_views
from tidemark.plans.registry import query
from tidemark.sources import views as V

ANN = "sqrt(252.0)"


def rets(s, d):
    return with_returns(V.bars(s, d))


def market(s, d):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    bn = V.bench(V.bars(s, d))
    return bn.select("d", (F.col("c") / F.lag("c").over(Window.orderBy("d")) - 1).alias("mr"))


def reg(name, cols, sql, fn, views="rets", ctes=""):
    query(name, cols, with_views(views, sql, ctes))(lambda s, d: fn(rets(s, d)))


LB = (5, 10, 21, 63, 126, 252)
reg("tsmom", "ticker d " + " ".join(f"tsmom_{k}d tsmom_sign_{k}d:i tsmom_sharpe_{k}d" for k in LB),
    "SELECT ticker, d, " + ", ".join(
        f"{full('sum(r)', k)} AS tsmom_{k}d, sign({full('sum(r)', k)}) AS tsmom_sign_{k}d, {full('sum(r)', k)} / nullif({full('stddev_samp(r)', k)} * sqrt(252.0/{k}), 0) AS tsmom_sharpe_{k}d"
        for k in LB) + f" FROM rets {W}", T.tsmom)
reg("momentum_12_1", "ticker d cs_momentum_12_1 cs_momentum_1m momentum_reversal", f"""SELECT ticker, d,
    CASE WHEN rn >= 253 THEN sum(r) OVER (w ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING) END AS cs_momentum_12_1,
    CASE WHEN rn >= 253 THEN sum(r) OVER (w ROWS 20 PRECEDING) END AS cs_momentum_1m,
    CASE WHEN rn >= 253 THEN -sum(r) OVER (w ROWS 20 PRECEDING) END AS momentum_reversal FROM rets {W}""", T.momentum_12_1)
MOM = f"""SELECT ticker, d, p21 / p252 - 1 AS mom_12_1, c / p126 - 1 AS mom_6m, c / p63 - 1 AS mom_3m, c / p21 - 1 AS mom_1m, vol AS vol_3m,
    CASE WHEN vol > 0 THEN (c / p63 - 1) / vol ELSE 0 END AS sharpe_3m FROM
    (SELECT ticker, d, c, rn, lag(c, 20) OVER w AS p21, lag(c, 62) OVER w AS p63, lag(c, 125) OVER w AS p126, lag(c, 251) OVER w AS p252,
    stddev_samp(r) OVER (w ROWS 62 PRECEDING) * {ANN} AS vol FROM rets {W})"""
reg("momentum_12_1_price", "ticker d mom_12_1 mom_6m mom_3m mom_1m vol_3m sharpe_3m",
    f"SELECT ticker, d, mom_12_1, mom_6m, mom_3m, mom_1m, vol_3m, sharpe_3m FROM ({MOM} WHERE rn >= 252)",
    lambda b: T.momentum_price(b).where("mom_12_1 is not null"))
reg("momentum_log_inverted", "ticker d mom_12_1 mom_6_1 mom_1m", f"""SELECT ticker, d, ln(p21 / p252) AS mom_12_1, ln(p21 / p126) AS mom_6_1,
    ln(c / p21) AS mom_1m FROM (SELECT ticker, d, c, lag(c, 20) OVER w AS p21, lag(c, 125) OVER w AS p126, lag(c, 251) OVER w AS p252 FROM rets {W})
    WHERE p252 IS NOT NULL""", lambda b: T.momentum_log(b).where("mom_12_1 is not null"))
reg("momentum_pit_bars", "ticker d r_1w r_1m r_3m r_6m r_12m r_12m_ex_1m", f"""SELECT ticker, d, c / p5 - 1 AS r_1w, c / p21 - 1 AS r_1m, c / p63 - 1 AS r_3m,
    c / p126 - 1 AS r_6m, c / p252 - 1 AS r_12m, CASE WHEN c / p21 - 1 > -1 THEN (c / p252) / (c / p21) - 1 END AS r_12m_ex_1m FROM
    (SELECT ticker, d, c, lag(c, 5) OVER w AS p5, lag(c, 21) OVER w AS p21, lag(c, 63) OVER w AS p63, lag(c, 126) OVER w AS p126,
    lag(c, 252) OVER w AS p252 FROM rets {W})""", T.momentum_pit)

query("residual_momentum", "ticker d beta residual_momentum_6m residual_momentum_vol beta_adjusted_momentum", with_views("rets mkt", f"""
SELECT ticker, d, beta, sr - beta * sm AS residual_momentum_6m, sqrt(greatest(vr - 2 * beta * cv + beta * beta * vm, 0.0)) * {ANN} AS residual_momentum_vol,
    (sr - beta * sm) / (sqrt(greatest(vr - 2 * beta * cv + beta * beta * vm, 0.0)) + 1e-8) AS beta_adjusted_momentum
FROM (SELECT ticker, d, count(*) OVER x AS k, covar_samp(r, mr) OVER x AS cv, covar_samp(r, mr) OVER x / var_pop(mr) OVER x AS beta,
    var_samp(r) OVER x AS vr, var_samp(mr) OVER x AS vm, sum(r) OVER x AS sr, sum(mr) OVER x AS sm
    FROM rets JOIN mkt USING (d) WHERE r IS NOT NULL AND mr IS NOT NULL
    WINDOW x AS (PARTITION BY ticker ORDER BY d ROWS 125 PRECEDING)) WHERE k = 126"""))(
    lambda s, d: T.residual_momentum(rets(s, d), market(s, d)))
reg("momentum_acceleration", "ticker d momentum_acceleration momentum_concavity", f"""SELECT ticker, d, a - m / 2 AS momentum_acceleration,
    a - 2 * m AS momentum_concavity FROM (SELECT ticker, d, rn, CASE WHEN rn >= 64 THEN sum(r) OVER (w ROWS 20 PRECEDING) END AS a,
    sum(r) OVER (w ROWS BETWEEN 62 PRECEDING AND 21 PRECEDING) AS m FROM rets {W})""", T.momentum_acceleration)

GL = f"""gl AS (SELECT *, coalesce(greatest(c - lag(c) OVER w, 0.0), 0.0) AS g, coalesce(greatest(lag(c) OVER w - c, 0.0), 0.0) AS lo FROM rets {W}),
rs AS (SELECT ticker, d, rn, {', '.join(f"100 - 100 / (1 + {ewm('g', f'(1.0/{n})')} / ({ewm('lo', f'(1.0/{n})')} + 1e-10)) AS rsi_{n}" for n in (7, 14, 21))},
    {', '.join(f"CASE WHEN rn > {n} AND sum(lo) OVER (w ROWS {n - 1} PRECEDING) > 0 THEN 100 - 100 / (1 + sum(g) OVER (w ROWS {n - 1} PRECEDING) / sum(lo) OVER (w ROWS {n - 1} PRECEDING)) END AS rsi_sma_{n}" for n in (5, 14, 21))} FROM gl {W})"""
reg("rsi", "ticker d " + " ".join(f"rsi_{n}:5 rsi_{n}_slope:5" for n in (7, 14, 21)) + " rsi_sma_5:5 rsi_sma_14:5 rsi_sma_21:5",
    "SELECT *, " + ", ".join(f"rsi_{n} - lag(rsi_{n}, 5) OVER w AS rsi_{n}_slope" for n in (7, 14, 21)) + f" FROM rs {W}", T.rsi, ctes=GL)
MC = f"""m1 AS (SELECT ticker, d, rn, {ewm('c', '(2.0/13)')} - {ewm('c', '(2.0/27)')} AS macd FROM rets {W}),
m2 AS (SELECT *, {ewm('macd', '(2.0/10)')} AS macd_signal FROM m1 {W}), m3 AS (SELECT *, macd - macd_signal AS macd_hist FROM m2)"""
reg("macd", "ticker d macd:5 macd_signal:5 macd_hist:5 macd_hist_slope:5 macd_crossover:i", f"""SELECT *, macd_hist - lag(macd_hist, 3) OVER w AS macd_hist_slope,
    CASE WHEN macd > macd_signal THEN 1 ELSE -1 END AS macd_crossover FROM m3 {W}""", T.macd, ctes=MC)
BB = "bb AS (SELECT ticker, d, c, " + ", ".join(
    f"(c - ({full('avg(c)', n)} - 2 * {full('stddev_samp(c)', n)})) / (4 * {full('stddev_samp(c)', n)} + 1e-10) AS bb_pct_b_{n}, 4 * {full('stddev_samp(c)', n)} / {full('avg(c)', n)} AS bb_bandwidth_{n}"
    for n in (20, 50)) + f" FROM rets {W})"
reg("bollinger", "ticker d bb_pct_b_20:5 bb_bandwidth_20 bb_squeeze_20:i bb_pct_b_50:5 bb_bandwidth_50 bb_squeeze_50:i",
    "SELECT *, " + ", ".join(f"CASE WHEN bb_bandwidth_{n} < {full(f'avg(bb_bandwidth_{n})', 20)} THEN 1 ELSE 0 END AS bb_squeeze_{n}" for n in (20, 50))
    + f" FROM bb {W}", T.bollinger, ctes=BB)
TR = f"tr AS (SELECT *, greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) AS tr FROM rets {W})"
reg("atr", "ticker d atr_14:5 atr_14_normalized atr_21:5 atr_21_normalized atr_sma_14:5 atr_pct:5", f"""SELECT *, atr_14 / c AS atr_14_normalized,
    atr_21 / c AS atr_21_normalized, atr_sma_14 / c * 100 AS atr_pct FROM (SELECT ticker, d, c, {ewm('tr', '(2.0/15)')} AS atr_14,
    {ewm('tr', '(2.0/22)')} AS atr_21, {full('avg(tr)', 14)} AS atr_sma_14 FROM tr {W})""", T.atr, ctes=TR)
DM = TR + f""", dm AS (SELECT *, CASE WHEN rn > 1 THEN greatest(h - lag(h) OVER w, 0.0) END AS up, CASE WHEN rn > 1 THEN greatest(lag(l) OVER w - l, 0.0) END AS dn FROM tr {W}),
dm2 AS (SELECT *, CASE WHEN up > dn THEN up ELSE 0.0 END AS p, CASE WHEN up > dn THEN 0.0 ELSE dn END AS m FROM dm),
di AS (SELECT ticker, d, rn, 100 * {ewm('p', '(2.0/15)')} / ({ewm('tr', '(2.0/15)')} + 1e-10) AS di_plus,
    100 * {ewm('m', '(2.0/15)', 2)} / ({ewm('tr', '(2.0/15)')} + 1e-10) AS di_minus FROM dm2 {W}),
dx AS (SELECT *, 100 * abs(di_plus - di_minus) / (di_plus + di_minus + 1e-10) AS dx FROM di)"""
reg("adx", "ticker d di_plus:5 di_minus:5 adx:5 trend_strength", f"SELECT *, adx / 100 AS trend_strength FROM (SELECT *, {ewm('dx', '(2.0/15)', 2)} AS adx FROM dx {W})",
    T.adx, ctes=DM)
ST = "st AS (SELECT ticker, d, " + ", ".join(
    f"100 * (c - {full('min(l)', n)}) / ({full('max(h)', n)} - {full('min(l)', n)} + 1e-10) AS stoch_k_{n}" for n in (14, 21)) + f" FROM rets {W})"
reg("stochastic", "ticker d stoch_k_14:5 stoch_d_14:5 stoch_k_21:5 stoch_d_21:5",
    "SELECT *, " + ", ".join(f"{full(f'avg(stoch_k_{n})', 3)} AS stoch_d_{n}" for n in (14, 21)) + f" FROM st {W}", T.stochastic, ctes=ST)
CC = f"""cc AS (SELECT ticker, d, tp, avg(tp) OVER (w ROWS 19 PRECEDING) AS m, list(tp) OVER (w ROWS 19 PRECEDING) AS x
    FROM (SELECT *, (h + l + c) / 3 AS tp FROM rets) {W}),
cc2 AS (SELECT ticker, d, CASE WHEN len(x) = 20 THEN (tp - m) / (0.015 * list_sum(list_transform(x, lambda y: abs(y - m))) / 20 + 1e-10) END AS cci FROM cc)"""
reg("cci", "ticker d cci:5 cci_overbought:i", "SELECT *, CASE WHEN cci > 100 THEN 1 WHEN cci < -100 THEN -1 ELSE 0 END AS cci_overbought FROM cc2", T.cci, ctes=CC)
reg("williams_r", "ticker d williams_r:5", f"SELECT ticker, d, -100 * ({full('max(h)', 14)} - c) / ({full('max(h)', 14)} - {full('min(l)', 14)} + 1e-10) AS williams_r FROM rets {W}",
    T.williams_r)
CM = f"""cm AS (SELECT ticker, d, v, ((c - l) - (h - c)) / (h - l + 1e-10) * v AS f, CASE WHEN h = l THEN 0.0 ELSE ((c - l) - (h - c)) / (h - l) * v END AS mf FROM rets),
cm2 AS (SELECT *, {full('sum(f)', 20)} / ({full('sum(v)', 20)} + 1e-10) AS cmf, {full('sum(mf)', 21)} / {full('sum(v)', 21)} AS chaikin_21,
    sum(mf) OVER (w ROWS UNBOUNDED PRECEDING) AS ad_line FROM cm {W})"""
reg("chaikin_money_flow", "ticker d cmf cmf_trend chaikin_21 ad_line:4", f"SELECT *, cmf - lag(cmf, 5) OVER w AS cmf_trend FROM cm2 {W}", T.chaikin_money_flow, ctes=CM)
OB = f"""ob AS (SELECT *, sum(sign(c - pc) * v) OVER (w ROWS UNBOUNDED PRECEDING) AS obv, sum(r * v) OVER (w ROWS UNBOUNDED PRECEDING) AS vpt,
    avg(v) OVER (w ROWS UNBOUNDED PRECEDING) AS mv FROM (SELECT *, lag(c) OVER (PARTITION BY ticker ORDER BY d) AS pc FROM rets) {W})"""
reg("obv_vpt", "ticker d obv:2 vpt:5 obv_trend obv_momentum obv_vs_mean vpt_trend:5", f"""SELECT ticker, d, obv, vpt, (obv - lag(obv, 20) OVER w) / (mv + 1e-10) AS obv_trend,
    obv / nullif(lag(obv, 20) OVER w, 0) - 1 AS obv_momentum, obv / nullif({full('avg(obv)', 20)}, 0) - 1 AS obv_vs_mean, vpt - lag(vpt, 10) OVER w AS vpt_trend
    FROM ob {W}""", T.obv_vpt, ctes=OB)
P = (5, 10, 20, 50, 100, 200)
reg("ma_ema_cross", "ticker d " + " ".join(f"sma_{n}:7 ema_{n}:5 price_vs_sma_{n} price_vs_ema_{n}" for n in P) + " golden_cross:i golden_cross_distance",
    "SELECT *, " + ", ".join(f"c / (sma_{n} + 1e-10) - 1 AS price_vs_sma_{n}, c / (ema_{n} + 1e-10) - 1 AS price_vs_ema_{n}" for n in P)
    + ", CASE WHEN sma_50 > sma_200 THEN 1 ELSE -1 END AS golden_cross, (sma_50 - sma_200) / (sma_200 + 1e-10) AS golden_cross_distance FROM (SELECT ticker, d, c, "
    + ", ".join(f"{full('avg(c)', n)} AS sma_{n}, {ewm('c', f'(2.0/{n + 1})')} AS ema_{n}" for n in P) + f" FROM rets {W})", T.ma_ema_cross)
reg("volume_ratios", "ticker d volume_ratio volume_trend dollar_volume:2 dollar_volume_ma20:2 rvol", f"""SELECT ticker, d, v / ({full('avg(v)', 20)} + 1e-10) AS volume_ratio,
    {full('avg(v)', 5)} / ({full('avg(v)', 20)} + 1e-10) AS volume_trend, c * v AS dollar_volume, {full('avg(c * v)', 20)} AS dollar_volume_ma20,
    v / {full('avg(v)', 21)} AS rvol FROM rets {W}""", T.volume_ratios)
reg("candle_shape", "ticker d daily_range upper_shadow lower_shadow body_size", """SELECT ticker, d, (h - l) / c AS daily_range, (h - greatest(c, o)) / c AS upper_shadow,
    (least(c, o) - l) / c AS lower_shadow, abs(c - o) / c AS body_size FROM rets""", T.candle_shape)
mid = lambda n: f"({full('max(h)', n)} + {full('min(l)', n)}) / 2"
reg("ichimoku", "ticker d tenkan:4 kijun:4 above_cloud:i tenkan_kijun_cross:i", f"""SELECT ticker, d, tenkan, kijun, CASE WHEN c > greatest(sa, sb) THEN 1 ELSE -1 END AS above_cloud,
    CASE WHEN tenkan > kijun THEN 1 ELSE -1 END AS tenkan_kijun_cross FROM (SELECT *, lag((tenkan + kijun) / 2, 26) OVER w AS sa, lag(b52, 26) OVER w AS sb FROM
    (SELECT ticker, d, c, rn, {mid(9)} AS tenkan, {mid(26)} AS kijun, {mid(52)} AS b52 FROM rets {W}) {W}) WHERE rn >= 52""", T.ichimoku)
reg("pivot_points", "ticker d vs_pivot vs_r1 vs_s1", f"""SELECT ticker, d, (c - p) / p AS vs_pivot, (c - (2 * p - pl)) / (2 * p - pl) AS vs_r1,
    (c - (2 * p - ph)) / (abs(2 * p - ph) + 1e-10) AS vs_s1 FROM (SELECT *, (ph + pl + pc) / 3 AS p FROM
    (SELECT ticker, d, c, lag(h) OVER w AS ph, lag(l) OVER w AS pl, lag(c) OVER w AS pc FROM rets {W}))""", T.pivot_points)
reg("fibonacci_levels", "ticker d " + " ".join(f"vs_fib_{k}" for k in T.FIB), "SELECT ticker, d, " + ", ".join(
    f"(c - (lo + {x} * (hi - lo))) / (lo + {x} * (hi - lo) + 1e-10) AS vs_fib_{k}" for k, x in T.FIB.items()) + f""" FROM (SELECT ticker, d, c, rn,
    max(h) OVER (w ROWS 251 PRECEDING) AS hi, min(l) OVER (w ROWS 251 PRECEDING) AS lo FROM rets {W}) WHERE rn >= 52""", T.fibonacci_levels)
reg("vwap_distance", "ticker d vwap_dist_21:5 vwap_distance_20", f"""SELECT ticker, d, (c / ({full('sum((h + l + c) / 3 * v)', 21)} / {full('sum(v)', 21)}) - 1) * 100 AS vwap_dist_21,
    (c - {full('sum(c * v)', 20)} / {full('sum(v)', 20)}) / ({full('sum(c * v)', 20)} / {full('sum(v)', 20)}) AS vwap_distance_20 FROM rets {W}""", T.vwap_distance)
reg("money_flow_index", "ticker d money_flow_index mfi_proxy:5", f"""SELECT ticker, d, CASE WHEN rn >= 15 AND pf + nf > 0 THEN pf / (pf + nf) END AS money_flow_index,
    CASE WHEN rn >= 40 AND nc > 0 THEN 100 - 100 / (1 + pc / nc) END AS mfi_proxy FROM (SELECT ticker, d, rn,
    sum(CASE WHEN tp > ptp THEN tp * v ELSE 0.0 END) OVER (w ROWS 13 PRECEDING) AS pf, sum(CASE WHEN tp < ptp THEN tp * v ELSE 0.0 END) OVER (w ROWS 13 PRECEDING) AS nf,
    sum(CASE WHEN c > pcl THEN c * v ELSE 0.0 END) OVER (w ROWS 13 PRECEDING) AS pc, sum(CASE WHEN c > pcl THEN 0.0 ELSE c * v END) OVER (w ROWS 13 PRECEDING) AS nc
    FROM (SELECT *, (h + l + c) / 3 AS tp, lag((h + l + c) / 3) OVER w AS ptp, lag(c) OVER w AS pcl FROM rets {W}) {W})""", T.money_flow_index)
reg("trade_size_flow", "ticker d avg_trade_size_trend block_trade_frequency", f"""SELECT ticker, d, l5 / base - 1 AS avg_trade_size_trend,
    len(list_filter(l10, lambda x: x > 1.5 * base)) / 10 AS block_trade_frequency FROM (SELECT ticker, d, rn, avg(v / n) OVER (w ROWS BETWEEN 39 PRECEDING AND 5 PRECEDING) AS base,
    avg(v / n) OVER (w ROWS 4 PRECEDING) AS l5, list(v / n) OVER (w ROWS 9 PRECEDING) AS l10 FROM rets {W}) WHERE rn >= 40""", T.trade_size_flow)
reg("volume_surge_accumulation", "ticker d dollar_vol_trend up_day_share log_adv accumulation_days:i vol_change_pct", f"""SELECT ticker, d,
    CASE WHEN rn >= 65 THEN avg(dv) OVER (w ROWS 20 PRECEDING) / avg(dv) OVER (w ROWS BETWEEN 83 PRECEDING AND 21 PRECEDING) END AS dollar_vol_trend,
    CASE WHEN rn >= 65 THEN sum(uv) OVER (w ROWS 19 PRECEDING) / sum(v) OVER (w ROWS 19 PRECEDING) END AS up_day_share,
    CASE WHEN rn >= 65 THEN log10(avg(dv) OVER (w ROWS 20 PRECEDING)) END AS log_adv, CASE WHEN rn >= 40 THEN sum(ac) OVER (w ROWS 19 PRECEDING) END AS accumulation_days,
    CASE WHEN rn >= 40 THEN avg(v) OVER (w ROWS 4 PRECEDING) / avg(v) OVER (w ROWS BETWEEN 39 PRECEDING AND 5 PRECEDING) - 1 END AS vol_change_pct
    FROM (SELECT *, c * v AS dv, CASE WHEN c > lag(c) OVER w THEN v ELSE 0.0 END AS uv, CASE WHEN c > lag(c) OVER w AND v > lag(v) OVER w THEN 1 ELSE 0 END AS ac FROM rets {W}) {W}""",
    T.volume_surge_accumulation)
reg("drawdown_structure", "ticker d dd_3y days_underwater:i off_1y_low days_since_1y_low:i", """SELECT ticker, d, CASE WHEN n3 >= 30 THEN 1 - c / hi.c END AS dd_3y,
    CASE WHEN n3 >= 30 THEN k + hi.k END AS days_underwater, CASE WHEN n1 >= 30 THEN c / lo.c - 1 END AS off_1y_low, CASE WHEN n1 >= 30 THEN k - lo.k END AS days_since_1y_low
    FROM (SELECT ticker, d, c, k, max({'c': c, 'k': -k}) OVER w3 AS hi, min({'c': c, 'k': k}) OVER w1 AS lo, count(*) OVER w3 AS n3, count(*) OVER w1 AS n1
    FROM (SELECT *, d - DATE '1970-01-01' AS k FROM rets) WINDOW w3 AS (PARTITION BY ticker ORDER BY k RANGE 1095 PRECEDING), w1 AS (PARTITION BY ticker ORDER BY k RANGE 365 PRECEDING))""",
    T.drawdown_structure)
