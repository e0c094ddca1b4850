"""Dependence, portfolio, regime and options queries with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import with_tail
from tidemark.operators import dependence as D
from tidemark.operators import options as O
from tidemark.operators import portfolio as P
from tidemark.plans.oracle import W, sql_norm_ppf
from tidemark.plans.q_10_technical import ANN, market, rets
from tidemark.plans.q_30_sources_filters import reg
from tidemark.plans.q_55_composites import SEL, monthly_selection
from tidemark.plans.q_60_aggregates import RKX, outcomes
from tidemark.plans.q_60_aggregates import OUT as OUTC
from tidemark.operators.aggregates import rank_ic
from tidemark.sources import views as V

N = [0, 1, 2, 3, 4]
PAIRS = [(a, b) for a in N for b in N if a < b]
FW = "fw AS (SELECT d, " + ", ".join(f"max(fr) FILTER (f = {k}) AS f{k}" for k in N) + " FROM fret GROUP BY d HAVING count(*) = 5)"
fw = lambda s, d: D.wide(V.factor_returns(s, d, rets(s, d)), N)
UN = lambda f, ps: " UNION ALL ".join(f.format(a=a, b=b) for a, b in ps)
COV = UN("SELECT {a} AS a, {b} AS b, covar_samp(f{a}, f{b}) AS cov, corr(f{a}, f{b}) AS corr, covar_samp(f{a}, f{b}) * pow(0.94, max(t)) + 0.06 * sum(pow(0.94, t - i) * f{a} * f{b}) AS ewma FROM fi", [(a, b) for a in N for b in N if a <= b])
FI = FW + ", fi AS (SELECT *, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS t, row_number() OVER (ORDER BY d DESC) AS k FROM fw)"
reg("covariance_matrix_long", "a:i b:i cov:9 corr ewma:9", "fret", COV, lambda s, d: D.covariance_long(fw(s, d), N), FI)
reg("correlation_stress", "a:i b:i stressed crisis", "fret", f"SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE least(corr * 1.5, 0.95) END AS stressed, CASE WHEN a = b THEN 1.0 ELSE 0.9 END AS crisis FROM ({COV})", lambda s, d: D.correlation_stress(D.covariance_long(fw(s, d), N)), FI)
reg("correlation_instability", "frobenius score avg_recent avg_prior action:s", "fret", f"""SELECT *, frobenius / sqrt(5) AS score, CASE WHEN frobenius / sqrt(5) > 1 THEN 'REDUCE' WHEN frobenius / sqrt(5) > 0.5 THEN 'MONITOR' ELSE 'NORMAL' END AS action FROM (SELECT sqrt(sum(2 * pow(r - p, 2))) AS frobenius, avg(r) AS avg_recent, avg(p) AS avg_prior FROM
    ({UN('SELECT corr(f{a}, f{b}) FILTER (k <= 21) AS r, corr(f{a}, f{b}) FILTER (k > 21) AS p FROM fi WHERE k <= 42', PAIRS)}))""", lambda s, d: D.correlation_instability(fw(s, d), N), FI)
TAIL = UN("""SELECT {a} AS a, {b} AS b, count(*) FILTER (f{a} <= q{a} AND f{b} <= q{b}) / count(*) FILTER (f{a} <= q{a}) AS ltd, count(*) FILTER (f{a} < q{a} AND f{b} < q{b}) / count(*) / 0.05 AS strict, CASE WHEN count(*) FILTER (f{a} < q{a} AND f{b} < q{b}) > 5 THEN corr(f{a}, f{b}) FILTER (f{a} < q{a} AND f{b} < q{b}) ELSE 0 END AS tail_corr,
    count(*) FILTER (f{a} < q{a} AND f{b} < q{b}) AS n FROM fw, (SELECT quantile_cont(f{a}, 0.05) AS q{a}, quantile_cont(f{b}, 0.05) AS q{b} FROM fw)""", PAIRS)
reg("lower_tail_dependence", "a:i b:i ltd strict", "fret", TAIL, lambda s, d: D.tail_pairs(fw(s, d), N), FW)
reg("tail_correlation", "a:i b:i tail_corr n:i", "fret", TAIL, lambda s, d: D.tail_pairs(fw(s, d), N), FW)
rm = lambda s, d: rets(s, d).join(market(s, d), "d").where("r is not null and mr is not null")
reg("covar", "ticker var_i covar delta_covar", "rets mkt", """SELECT ticker, var_i, CASE WHEN nb >= 5 AND nm >= 5 THEN cb ELSE 0 END AS covar, CASE WHEN nb >= 5 AND nm >= 5 THEN cb - cm ELSE 0 END AS delta_covar FROM (SELECT ticker, max(q1) AS var_i, count(*) FILTER (r <= q1) AS nb, count(*) FILTER (r BETWEEN q2 AND q3) AS nm, quantile_cont(mr, 0.05) FILTER (r <= q1) AS cb, quantile_cont(mr, 0.05) FILTER (r BETWEEN q2 AND q3) AS cm
    FROM rm JOIN (SELECT ticker, quantile_cont(r, 0.05) AS q1, quantile_cont(r, 0.45) AS q2, quantile_cont(r, 0.55) AS q3 FROM rm GROUP BY 1) USING (ticker) GROUP BY ticker)""", lambda s, d: D.covar(rm(s, d)), "rm AS (SELECT ticker, d, r, mr FROM rets JOIN mkt USING (d) WHERE r IS NOT NULL AND mr IS NOT NULL)")
reg("beta_corr_to_proxies", "ticker " + " ".join(f"beta_{k} corr_{k}" for k in N) + " beta_stability", "fret", "SELECT ticker, " + ", ".join(f"covar_pop(r, f{k}) / var_pop(f{k}) AS beta_{k}, corr(r, f{k}) AS corr_{k}" for k in N) + """,
    1 - least(1.0, abs(covar_pop(r, f0) FILTER (k <= 125) / var_pop(f0) FILTER (k <= 125) - covar_pop(r, f0) FILTER (k > 125) / var_pop(f0) FILTER (k > 125))) AS beta_stability FROM (SELECT ticker, r, fw.*, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM rets JOIN fw USING (d) WHERE r IS NOT NULL) WHERE k < 252 GROUP BY ticker""",
    lambda s, d: D.proxy_betas(rets(s, d), fw(s, d), N), FW)
S2 = lambda x: f"sum(({x}) * pow(q, -kk)) OVER (w ROWS UNBOUNDED PRECEDING)"
reg("capm_beta", "ticker beta beta_raw:5 beta_shrunk:5 bab_signal:5", "rets mkt", f"""SELECT ticker, beta, beta_raw, 0.6 * beta_raw + 0.4 AS beta_shrunk, 0.6 - 0.6 * beta_raw AS bab_signal FROM (SELECT ticker, regr_slope(r, mr) AS beta FROM rets JOIN mkt USING (d) WHERE r IS NOT NULL AND mr IS NOT NULL GROUP BY 1) JOIN
    (SELECT ticker, arg_max((xm / sw - x * m / sw / sw) / (mm / sw - pow(m / sw, 2) + 1e-10 / cf), d) AS beta_raw FROM (SELECT *, sw * sw / (sw * sw - sw2) AS cf FROM (SELECT ticker, d, {S2('1.0')} * pow(q, kk) AS sw, sum(pow(q, -2 * kk)) OVER (w ROWS UNBOUNDED PRECEDING) * pow(q, 2 * kk) AS sw2, {S2('r')} * pow(q, kk) AS x, {S2('mr')} * pow(q, kk) AS m, {S2('mr * mr')} * pow(q, kk) AS mm, {S2('r * mr')} * pow(q, kk) AS xm
    FROM (SELECT ticker, d, r, mr, rn - 2 AS kk, 1.0 - 2.0 / 64 AS q FROM rets JOIN mkt USING (d) WHERE r IS NOT NULL) {W})) GROUP BY 1) USING (ticker)""", lambda s, d: D.capm_beta(rets(s, d).join(market(s, d), "d")))
reg("factor_exposures", "ticker alpha b_mr b_f0 r_squared idio_risk", "rets mkt fret", """SELECT ticker, (my - b1 * m1 - b2 * m2) * 252 AS alpha, b1 AS b_mr, b2 AS b_f0, (b1 * c1 + b2 * c2) * n / (vy * n + 1e-10) AS r_squared, sqrt(greatest(vy - b1 * c1 - b2 * c2, 0.0) * 252) AS idio_risk FROM (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM
    (SELECT ticker, count(*) AS n, avg(r) AS my, avg(mr) AS m1, avg(fr) AS m2, var_pop(r) AS vy, var_pop(mr) AS v1, var_pop(fr) AS v2, covar_pop(mr, fr) AS v12, covar_pop(r, mr) AS c1, covar_pop(r, fr) AS c2 FROM (SELECT ticker, r, mr, fr, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM rets JOIN mkt USING (d) JOIN fret USING (d)
    WHERE f = 0 AND r IS NOT NULL AND mr IS NOT NULL) WHERE k <= 252 GROUP BY ticker))""", lambda s, d: D.factor_exposures(rm(s, d).join(V.factor_returns(s, d, rets(s, d)).where("f = 0").select("d", F.col("fr").alias("f0")), "d").select("ticker", "d", "r", "mr", "f0"), ["mr", "f0"]))
reg("crowding_score", "f:i recent_sharpe persistence crowding unwind_prob", "fret", f"""SELECT *, 1 / (1 + exp(-(crowding - 0.65) * 10)) AS unwind_prob FROM (SELECT f, sh AS recent_sharpe, pers AS persistence, (0.40 * least(greatest(sh / 3, 0.0), 1.0) + 0.30 * least(pers, 1.0)) / 2 AS crowding FROM (SELECT f, avg(fr) / (stddev_samp(fr) + 1e-10) * {ANN} AS sh FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY d DESC) AS k FROM fret) WHERE k <= 63 GROUP BY 1) JOIN
    (SELECT f, avg(CASE WHEN s > 0.5 THEN 1.0 ELSE 0 END) AS pers FROM (SELECT f, last_day(d) AS m, avg(fr) / (stddev_samp(fr) + 1e-10) * {ANN} AS s, row_number() OVER (PARTITION BY f ORDER BY last_day(d) DESC) AS j FROM fret GROUP BY 1, 2) WHERE j <= 12 GROUP BY 1) USING (f))""", lambda s, d: D.crowding_score(V.factor_returns(s, d, rets(s, d))))
CORR = "c0 AS (SELECT " + ", ".join(f"corr(f{a}, f{b}) AS a{a}_{b}" if a != b else f"1.0 AS a{a}_{b}" for a in N for b in N if a <= b) + " FROM fi WHERE k <= 63), "
reg("crowding_pca", "entropy effective_n top_share level:s", "fret", """SELECT *, CASE WHEN effective_n < 2 OR top_share > 0.6 THEN 'HIGH' WHEN effective_n < 3 OR top_share > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT -sum(e * ln(e + 1e-10)) AS entropy, exp(-sum(e * ln(e + 1e-10))) AS effective_n, max(e) AS top_share FROM (SELECT ev / (SELECT sum(ev) FROM eigen) AS e FROM eigen))""",
    lambda s, d: D.crowding_pca(fw(s, d), N), f"{FI}, {CORR}{D.jacobi_sql(len(N), 'c0')}")
reg("factor_dispersion", "f:i dispersion n:i crowded:i", "fret", "SELECT *, dispersion < 0.3 AS crowded FROM (SELECT f, stddev_samp(b) / abs(avg(b)) AS dispersion, count(*) AS n FROM (SELECT ticker, f, regr_slope(r, fr) AS b FROM rets JOIN fret USING (d) WHERE r IS NOT NULL GROUP BY 1, 2) GROUP BY f)",
    lambda s, d: D.factor_dispersion(rets(s, d).where("r is not null").join(V.factor_returns(s, d, rets(s, d)), "d").groupBy("ticker", "f").agg(F.regr_slope("r", "fr").alias("b"))))


def selected(s, d):
    """Decile members of each month with the next month's return and the month before."""
    m = V.bars(s, d).groupBy("ticker", F.last_day("d").alias("m")).agg((F.max_by("c", "d") / F.min_by("c", "d") - 1).alias("score"))
    y = m.withColumn("y", F.lead("score").over(Window.partitionBy("ticker").orderBy("m"))).select("ticker", "m", "y")
    return monthly_selection(s, d).join(y, ["ticker", "m"]).withColumn("prev_m", F.last_day(F.add_months("m", -1)))


SELY = SEL + """, ny AS (SELECT ticker, m, lead(score) OVER (PARTITION BY ticker ORDER BY m) AS y FROM ms), sy AS (SELECT sel.*, y, CASE WHEN lag(m) OVER (PARTITION BY ticker, leg ORDER BY m) = last_day(m - INTERVAL 1 MONTH) THEN 0.0 ELSE 1.0 END AS nw FROM sel JOIN ny USING (ticker, m)),
bk AS (SELECT m, leg, avg(y) AS ret, avg(nw) AS tn FROM sy GROUP BY 1, 2), mk AS (SELECT m, avg(y) AS mret FROM ny GROUP BY 1)"""
PS = """SELECT count(*) AS n_periods, avg(x) * 4 AS ann_mean, stddev_samp(x) * 2 AS ann_vol, avg(x) * 4 / (stddev_samp(x) * 2) AS sharpe, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END) AS hit_rate, least(min(dd), 0) AS max_drawdown, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t_stat, avg(tn) AS avg_turnover FROM
    (SELECT *, cum / greatest(max(cum) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + x)) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING)) AS cum FROM ({})))"""
PSC = "n_periods:i ann_mean ann_vol sharpe hit_rate max_drawdown t_stat avg_turnover"


def long_book(s, d):
    x = selected(s, d).persist()
    mk = V.bars(s, d).groupBy("ticker", F.last_day("d").alias("m")).agg((F.max_by("c", "d") / F.min_by("c", "d") - 1).alias("s"))
    mk = mk.withColumn("y", F.lead("s").over(Window.partitionBy("ticker").orderBy("m"))).groupBy("m").agg(F.avg("y").alias("mret"))
    b = P.book_returns(x, "long").join(mk, "m").where("ret is not null and mret is not null")
    return P.period_stats(b.withColumn("x", F.col("ret") - F.col("mret") - 0.0016 * F.col("turnover")), "x")


def long_short(s, d):
    x = selected(s, d).persist()
    lo, sh = P.book_returns(x, "long"), P.book_returns(x, "short").select("m", F.col("ret").alias("sret"), F.col("turnover").alias("st"))
    b = lo.join(sh, "m").where("ret is not null and sret is not null").withColumn("turnover", F.col("turnover") + F.col("st"))
    return P.period_stats(b.withColumn("x", F.col("ret") - F.col("sret") - 0.0016 * F.col("turnover")), "x")


reg("long_book_backtest", PSC, "bars", PS.format("SELECT m, ret - mret - 0.0016 * tn AS x, tn FROM bk JOIN mk USING (m) WHERE leg = 'long' AND ret IS NOT NULL AND mret IS NOT NULL"), long_book, SELY)
reg("long_short_backtest", PSC, "bars", PS.format("SELECT l.m, l.ret - s.ret - 0.0016 * (l.tn + s.tn) AS x, l.tn + s.tn AS tn FROM bk l JOIN bk s ON l.m = s.m AND l.leg = 'long' AND s.leg = 'short' WHERE l.ret IS NOT NULL AND s.ret IS NOT NULL"), long_short, SELY)
reg("cost_model", "m:s leg:s turnover cost_bps", "bars", "SELECT m, leg, tn AS turnover, 16 * tn AS cost_bps FROM bk", lambda s, d: (lambda x: P.book_returns(x, "long").withColumn("leg", F.lit("long")).unionByName(P.book_returns(x, "short").withColumn("leg", F.lit("short"))).withColumn("cost_bps", 2 * (1 + 5 + 2) * F.col("turnover")))(selected(s, d).persist()), SELY)


def vols(s, d):
    """Trailing volatility of every instrument at the end of each month; the book is every instrument."""
    from tidemark.functions.frames import full

    v = rets(s, d).select("ticker", "d", F.last_day("d").alias("m"), (full(F.stddev_samp, "r", 21) * 252 ** 0.5).alias("vol"))
    return v.groupBy("ticker", "m").agg(F.max_by("vol", "d").alias("vol")).where("vol > 0")


VO = f"""vo AS (SELECT ticker, m, vol FROM (SELECT ticker, last_day(d) AS m, arg_max(coalesce(v, -1), d) AS vol FROM (SELECT ticker, d, CASE WHEN count(r) OVER (w ROWS 20 PRECEDING) = 21 THEN stddev_samp(r) OVER (w ROWS 20 PRECEDING) * {ANN} END AS v FROM rets {W}) GROUP BY 1, 2) WHERE vol > 0),
iw AS (SELECT *, (1 / vol) / sum(1 / vol) OVER (PARTITION BY m) AS weight FROM vo), lev AS (SELECT m, sqrt(0.3 * pow(sum(weight * vol), 2) + 0.7 * sum(pow(weight * vol, 2))) AS port_vol FROM iw GROUP BY 1)"""
reg("inverse_vol_weights", "ticker m:s weight", "rets", "SELECT * FROM iw", lambda s, d: P.inverse_vol(vols(s, d), ["m"]), VO)
reg("vol_target", "m:s port_vol leverage", "rets", "SELECT *, least(greatest(0.10 / port_vol, 0.0), 1.0) AS leverage FROM lev", lambda s, d: P.flat_corr_leverage(P.inverse_vol(vols(s, d), ["m"]), ["m"], 0.10), VO)
DSC = "CASE WHEN dd >= -0.08 THEN 1 WHEN dd <= -0.20 THEN 0.3 ELSE 1 - (dd + 0.08) / (-0.12) * 0.7 END"


def dds(s, d):
    from tidemark.operators.windows import drawdown

    return drawdown(V.bars(s, d))


reg("drawdown_scale", "ticker d scale", "bars", f"SELECT ticker, d, {DSC} AS scale FROM (SELECT ticker, d, c / max(c) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars)", lambda s, d: dds(s, d).select("ticker", "d", P.drawdown_scale(F.col("dd")).alias("scale")))


def size_book(s, d):
    w = P.inverse_vol(vols(s, d), ["m"]).persist()
    lev = P.flat_corr_leverage(w, ["m"], 0.10)
    dd = dds(s, d).groupBy("ticker", F.last_day("d").alias("m")).agg(F.max_by("dd", "d").alias("dd"))
    return w.join(lev, "m").join(dd, ["ticker", "m"]).select("ticker", "m", (F.col("weight") * F.col("leverage") * P.drawdown_scale(F.col("dd"))).alias("final_weight"))


reg("size_book", "ticker m:s final_weight", "rets", f"""SELECT ticker, m, weight * least(greatest(0.10 / port_vol, 0.0), 1.0) * {DSC} AS final_weight FROM iw JOIN lev USING (m) JOIN (SELECT ticker, last_day(d) AS m, arg_max(dd, d) AS dd FROM (SELECT ticker, d, c / max(c) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars) GROUP BY 1, 2) USING (ticker, m)""", size_book, VO)


def cap_weights(s, d):
    e = V.edges(s, d).where("tier = 2")
    return e.select(F.col("src").alias("book"), F.col("dst").alias("ticker"), (F.col("weight") ** 2).alias("w2")).withColumn("weight", F.col("w2") / F.sum("w2").over(Window.partitionBy("book")))


CAPS = """cw AS (SELECT src AS book, dst AS ticker, weight * weight / sum(weight * weight) OVER (PARTITION BY src) AS w FROM edges WHERE tier = 2),
c0 AS (SELECT book, list(ticker ORDER BY ticker) AS t, list(w ORDER BY ticker) AS w FROM cw WHERE w >= 0.01 GROUP BY 1),
cr AS (WITH RECURSIVE z(i, book, t, w, done) AS (SELECT 0, book, t, w, false FROM c0 UNION ALL SELECT i + 1, book, t, CASE WHEN done THEN w WHEN 1 - tt <= 0.001 OR un = 0 THEN list_transform(cp, lambda x: x / tt) ELSE list_transform(cp, lambda x: CASE WHEN x < 0.06 - 1e-6 THEN x + (1 - tt) * x / un ELSE x END) END, done OR 1 - tt <= 0.001 OR un = 0
    FROM (SELECT *, list_sum(cp) AS tt, list_sum(list_transform(cp, lambda x: CASE WHEN x < 0.06 - 1e-6 THEN x ELSE 0 END)) AS un FROM (SELECT *, list_transform(w, lambda x: least(x, 0.06)) AS cp FROM z WHERE i < 10))) SELECT * FROM z WHERE i = 10)"""
reg("position_caps", "book:i ticker:s weight", "edges", "SELECT book, unnest(t) AS ticker, unnest(list_transform(w, lambda x: x / list_sum(w))) AS weight FROM cr", lambda s, d: P.position_caps(cap_weights(s, d), "book", cap=0.06), CAPS)
reg("kelly_single", "ticker kelly", "rets", f"SELECT ticker, least(greatest((avg(r) * 252 - 0.05) / pow(stddev_samp(r) * {ANN}, 2) * (2 * avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) - 1) * 0.25, -0.10), 0.10) AS kelly FROM rets WHERE r IS NOT NULL GROUP BY ticker",
    lambda s, d: rets(s, d).where("r is not null").groupBy("ticker").agg((F.avg("r") * 252).alias("mu"), (F.stddev_samp("r") * 252 ** 0.5).alias("sg"), F.avg((F.col("r") > 0).cast("double")).alias("p")).select("ticker", P.kelly(F.col("mu"), F.col("sg"), F.col("p")).alias("kelly")))


def book_daily(s, d):
    """Daily return of a value-weighted book per region."""
    u = V.universe(s, d).select("ticker", "bucket", "market_cap")
    x = rets(s, d).where("r is not null").join(u, "ticker")
    return x.groupBy("bucket", "d").agg((F.sum(F.col("r") * F.col("market_cap")) / F.sum("market_cap")).alias("p"))


BD = "bd AS (SELECT bucket, d, sum(r * market_cap) / sum(market_cap) AS p FROM rets JOIN universe USING (ticker) WHERE r IS NOT NULL GROUP BY 1, 2), bz AS (SELECT *, (p - avg(p) OVER q) / stddev_pop(p) OVER q AS z, row_number() OVER (PARTITION BY bucket ORDER BY p) - 1 AS i, count(*) OVER q AS n FROM bd WINDOW q AS (PARTITION BY bucket))"
ZS = {a: sql_norm_ppf(f"(1 - {a})") for a in (0.95, 0.99)}
VC = ", ".join(f"-max(p) FILTER (i = floor(n * (1 - {a}))) AS var_{int(a * 100)}, -avg(p) FILTER (i < floor(n * (1 - {a}))) AS cvar_{int(a * 100)}, -(avg(p) + stddev_pop(p) * (z{int(a * 100)} + (z{int(a * 100)} * z{int(a * 100)} - 1) * avg(pow(z, 3)) / 6 + (pow(z{int(a * 100)}, 3) - 3 * z{int(a * 100)}) * (avg(pow(z, 4)) - 3) / 24 - (2 * pow(z{int(a * 100)}, 3) - 5 * z{int(a * 100)}) * pow(avg(pow(z, 3)), 2) / 36)) AS var_cf_{int(a * 100)}, -(avg(p) + stddev_pop(p) * z{int(a * 100)}) AS var_gauss_{int(a * 100)}" for a in ZS)
reg("portfolio_var_cvar", "bucket:s " + " ".join(f"var_{t} cvar_{t} var_cf_{t} var_gauss_{t}" for t in (95, 99)) + " vol_annual skewness kurtosis", "rets universe", f"SELECT bucket, {VC}, stddev_pop(p) * {ANN} AS vol_annual, avg(pow(z, 3)) AS skewness, avg(pow(z, 4)) - 3 AS kurtosis FROM bz, (SELECT {ZS[0.95]} AS z95, {ZS[0.99]} AS z99) GROUP BY bucket, z95, z99",
    lambda s, d: P.var_cvar(book_daily(s, d), "bucket", "p"), BD)
reg("portfolio_tail_stats", "bucket:s tail_var tail_cvar tail_skewness n_tail:i tail_sharpe", "rets universe", f"SELECT bucket, -max(q) AS tail_var, -avg(p) AS tail_cvar, skewness(p) AS tail_skewness, count(*) AS n_tail, avg(p) / stddev_pop(p) * {ANN} AS tail_sharpe FROM bd JOIN (SELECT bucket, quantile_cont(p, 0.05) AS q FROM bd GROUP BY 1) USING (bucket) WHERE p < q GROUP BY bucket",
    lambda s, d: P.tail_stats(book_daily(s, d), "bucket", "p"), BD)


def cvar_parts(s, d):
    """Change of each book's tail mean when one member is raised by a small step, per unit of weight, with weights renormalised.
    Every member only meets its own book's days: the bumped book return is (p + h*w*r)/(1 + h*w)."""
    h = 0.01
    u = V.universe(s, d).select("ticker", "bucket", "market_cap")
    u = u.withColumn("w", F.col("market_cap") / F.sum("market_cap").over(Window.partitionBy("bucket")))
    x = rets(s, d).where("r is not null").join(u, "ticker")
    p = x.groupBy("bucket", "d").agg((F.sum(F.col("r") * F.col("market_cap")) / F.sum("market_cap")).alias("p"))
    j = x.join(p, ["bucket", "d"]).withColumn("b", (F.col("p") + h * F.col("w") * F.col("r")) / (1 + h * F.col("w")))
    q = j.groupBy("ticker").agg(F.percentile("b", F.lit(0.05)).alias("qb"), F.percentile("p", F.lit(0.05)).alias("qp"))
    j = j.join(q, "ticker")
    return j.groupBy("ticker").agg(F.first("w").alias("w"), F.avg(F.when(F.col("b") <= F.col("qb"), F.col("b"))).alias("cb"), F.avg(F.when(F.col("p") <= F.col("qp"), F.col("p"))).alias("cp")).select(
        "ticker", (-(F.col("cb") - F.col("cp")) / (h * F.col("w"))).alias("marginal"), (-(F.col("cb") - F.col("cp")) / h).alias("contribution"))


reg("cvar_contributions", "ticker marginal contribution", "rets universe", """SELECT ticker, -(cb - cp) / (0.01 * w) AS marginal, -(cb - cp) / 0.01 AS contribution FROM (SELECT ticker, max(w) AS w, avg(b) FILTER (b <= qb) AS cb, avg(p) FILTER (p <= qp) AS cp FROM j JOIN (SELECT ticker, quantile_cont(b, 0.05) AS qb, quantile_cont(p, 0.05) AS qp FROM j GROUP BY 1) USING (ticker) GROUP BY 1)""", cvar_parts,
    BD + ", uw AS (SELECT ticker, bucket, market_cap / sum(market_cap) OVER (PARTITION BY bucket) AS w FROM universe), j AS (SELECT r.ticker, bd.p, w, (bd.p + 0.01 * w * r.r) / (1 + 0.01 * w) AS b FROM rets r JOIN uw USING (ticker) JOIN bd ON bd.bucket = uw.bucket AND bd.d = r.d WHERE r.r IS NOT NULL)")
ICM = f"""icm AS ({RKX("(SELECT *, model AS md, CAST(generated_at AS DATE) AS dd FROM outc WHERE ret IS NOT NULL)", 'md, dd')})"""
reg("ic_health", "model:s n:i mean_ic recent_ic icir t_decay days_below:i action:s weight", "signals", """SELECT model, n, mean_ic, recent_ic, icir, t_decay, days_below, action, CASE WHEN action IN ('QUARANTINE', 'WATCH') THEN greatest(0, recent_ic / (0.05 + 1e-10)) ELSE 1 END AS weight FROM (SELECT *, CASE WHEN days_below >= 10 THEN 'QUARANTINE' WHEN recent_ic < 0 THEN 'WATCH' WHEN abs(t_decay) > 1.645 AND recent_ic < o AND recent_ic < 0.025 THEN 'REVIEW'
    WHEN mean_ic < 0.02 THEN 'MONITOR' ELSE 'MAINTAIN' END AS action FROM (SELECT md AS model, count(*) AS n, avg(ic) AS mean_ic, avg(ic) FILTER (k <= 7) AS recent_ic, avg(ic) / (stddev_pop(ic) + 1e-10) AS icir, avg(ic) FILTER (k > 7) AS o, count(*) FILTER (bad = 0) AS days_below,
    (avg(ic) FILTER (k <= 7) - avg(ic) FILTER (k > 7)) / sqrt(((count(*) FILTER (k <= 7) - 1) * var_samp(ic) FILTER (k <= 7) + (count(*) FILTER (k > 7) - 1) * var_samp(ic) FILTER (k > 7)) / (count(*) - 2) * (1 / count(*) FILTER (k <= 7) + 1 / count(*) FILTER (k > 7))) AS t_decay FROM
    (SELECT *, row_number() OVER (PARTITION BY md ORDER BY dd DESC) AS k, sum(CASE WHEN ic < -0.02 THEN 0 ELSE 1 END) OVER (PARTITION BY md ORDER BY dd DESC ROWS UNBOUNDED PRECEDING) AS bad FROM icm) GROUP BY md))""",
    lambda s, d: P.ic_health(rank_ic(outcomes(s, d).withColumn("dd", F.to_date("generated_at")), ["model", "dd"], "signal", "ret", tie="id"), "model", "dd", fast=7, slow=14), OUTC + ", " + ICM)


def live(s, d):
    t = with_tail(rets(s, d)).where("r is not null")
    lv = F.col("k") < 100
    sh = lambda m: F.avg(F.when(m, F.col("r"))) / F.stddev_samp(F.when(m, F.col("r"))) * 252 ** 0.5
    g = t.withColumn("r1", F.lag("r").over(Window.partitionBy("ticker").orderBy("d"))).groupBy("ticker").agg(
        sh(~lv).alias("sharpe_bt"), sh(lv).alias("sharpe_live"), F.corr(F.when(~lv, F.col("r")), F.when(~lv, F.col("r1"))).alias("ic_bt"), F.corr(F.when(lv, F.col("r")), F.when(lv, F.col("r1"))).alias("ic_live"),
        F.stddev_samp(F.when(~lv, F.col("r"))).alias("vol_bt"), F.stddev_samp(F.when(lv, F.col("r"))).alias("vol_live"), F.sum(lv.cast("int")).alias("live_days"))
    return P.live_divergence(g)


reg("live_divergence", "ticker violations:s action:s", "tails", f"""SELECT ticker, v AS violations, CASE WHEN n < 60 THEN 'INSUFFICIENT' WHEN s < 0.2 OR i < 0.2 THEN 'QUARANTINE' WHEN s < 0.5 THEN 'REDUCE_WEIGHT' WHEN v <> '' THEN 'MONITOR' ELSE 'MAINTAIN' END AS action FROM (SELECT *, array_to_string(list_filter([CASE WHEN s < 0.2 THEN 'sharpe_critical' WHEN s < 0.5 THEN 'sharpe_warning' END,
    CASE WHEN i < 0.2 THEN 'ic_critical' WHEN i < 0.5 THEN 'ic_warning' END, CASE WHEN vv > 2.5 THEN 'vol_warning' END], lambda x: x IS NOT NULL), ',') AS v FROM (SELECT ticker, count(*) FILTER (k < 100) AS n, avg(r) FILTER (k < 100) / stddev_samp(r) FILTER (k < 100) * {ANN} / (avg(r) FILTER (k >= 100) / stddev_samp(r) FILTER (k >= 100) * {ANN} + 1e-10) AS s,
    corr(r, r1) FILTER (k < 100) / (corr(r, r1) FILTER (k >= 100) + 1e-10) AS i, stddev_samp(r) FILTER (k < 100) / (stddev_samp(r) FILTER (k >= 100) + 1e-10) AS vv FROM (SELECT *, lag(r) OVER (PARTITION BY ticker ORDER BY d) AS r1 FROM tails WHERE r IS NOT NULL) GROUP BY ticker))""", live)


def priors(s, d):
    """Prior regime probabilities per order: equal mass tilted by the order key, slope from its price."""
    o = V.table(s, d, "orders")
    r = F.explode(F.array(*[F.struct(F.lit(x).alias("regime"), F.lit(i).alias("i")) for i, x in enumerate(P.REGIMES)])).alias("r")
    x = o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 150000 - 1).alias("slope"), r).select("id", "slope", "r.*")
    x = x.withColumn("u", 1.0 + (F.col("id") + F.col("i")) % 3)
    return x.withColumn("p", F.col("u") / F.sum("u").over(Window.partitionBy("id")))


LK = "CASE " + " ".join(f"WHEN c = '{c}' AND i = {i} THEN {v}" for c, ps in P.SLOPE_LIKELIHOOD.items() for i, v in enumerate(ps)) + " END"
PRI = """pr0 AS (SELECT o_orderkey AS id, o_totalprice / 150000 - 1 AS slope, regime, i, 1.0 + (o_orderkey + i) % 3 AS u FROM orders, (SELECT unnest(['BULL_LOW_VOL', 'BULL_HIGH_VOL', 'MEAN_REVERT', 'BEAR_LOW_VOL', 'BEAR_HIGH_VOL']) AS regime, unnest([0, 1, 2, 3, 4]) AS i)),
pr1 AS (SELECT *, u / sum(u) OVER (PARTITION BY id) AS p, CASE WHEN slope < -0.5 THEN 'inverted' WHEN slope < 0 THEN 'flat' WHEN slope < 1.0 THEN 'normal' ELSE 'steep' END AS c FROM pr0)"""
reg("regime_bayes", "id:i regime:s post smoothed", "", f"SELECT id, regime, post, s / sum(s) OVER (PARTITION BY id) AS smoothed FROM (SELECT *, 0.7 * post + 0.3 * p AS s FROM (SELECT *, l / sum(l) OVER (PARTITION BY id) AS post FROM (SELECT *, p * {LK} AS l FROM pr1)))", lambda s, d: P.regime_bayes(priors(s, d), F.col("slope")), PRI)
MU = "CASE regime WHEN 'BULL_LOW_VOL' THEN 1.0 WHEN 'BULL_HIGH_VOL' THEN 0.85 WHEN 'MEAN_REVERT' THEN 0.90 WHEN 'BEAR_LOW_VOL' THEN 0.70 ELSE 0.45 END"
reg("regime_risk_budget", "id:i vol_target max_gross max_net", "", f"SELECT id, 0.10 * sum(p * {MU}) AS vol_target, 1.5 * sum(p * {MU}) AS max_gross, sum(p * {MU}) AS max_net FROM pr1 GROUP BY id",
    lambda s, d: (lambda m: priors(s, d).groupBy("id").agg(F.sum(F.col("p") * F.coalesce(F.try_element_at(m, F.col("regime")), F.lit(0.80))).alias("k")).select("id", (0.10 * F.col("k")).alias("vol_target"), (1.5 * F.col("k")).alias("max_gross"), F.col("k").alias("max_net")))(
        F.create_map(*[y for k, v in P.RISK_MULTIPLIER.items() for y in (F.lit(k), F.lit(v))])), PRI)


def alloc(s, d):
    w = P.inverse_vol(vols(s, d), ["m"])
    dd = dds(s, d).groupBy("ticker", F.last_day("d").alias("m")).agg(F.max_by("dd", "d").alias("drawdown"))
    return w.join(dd, ["ticker", "m"]).select("m", "ticker", (F.col("weight") * 1.6).alias("weight"), F.col("vol").alias("realized_vol"), "drawdown", F.element_at(F.array(*[F.lit(x) for x in P.REGIMES]), (F.col("ticker") % 5 + 1).cast("int")).alias("regime"))


AL = VO + """, al AS (SELECT ticker, m, weight * 1.6 AS weight, vol, dd, ['BULL_LOW_VOL', 'BULL_HIGH_VOL', 'MEAN_REVERT', 'BEAR_LOW_VOL', 'BEAR_HIGH_VOL'][CAST(ticker % 5 + 1 AS INT)] AS regime FROM iw JOIN (SELECT ticker, last_day(d) AS m, arg_max(dd, d) AS dd FROM (SELECT ticker, d, c / max(c) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars) GROUP BY 1, 2) USING (ticker, m))"""
TIER = "CASE WHEN dd <= -0.20 THEN 0.25 WHEN dd <= -0.15 THEN 0.50 WHEN dd <= -0.10 THEN 0.70 WHEN dd <= -0.05 THEN 0.90 ELSE 1.0 END"
reg("capital_allocation", "m:s ticker multiplier final_weight", "rets", f"SELECT m, ticker, multiplier, w * CASE WHEN g > 1 THEN 1 / g ELSE 1 END AS final_weight FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY m) AS g FROM (SELECT *, weight * multiplier AS w FROM (SELECT *, least(least(greatest(0.10 / vol, 0.25), 1.5), {MU}, {TIER}) AS multiplier FROM al)))",
    lambda s, d: P.capital_allocation(alloc(s, d), "m"), AL)
reg("reduce_capital_triggers", "m:s ticker triggers:s urgency:s", "rets", """SELECT m, ticker, array_to_string(t, ',') AS triggers, CASE WHEN len(t) >= 2 THEN 'IMMEDIATE' WHEN len(t) = 1 THEN 'ELEVATED' ELSE 'NONE' END AS urgency FROM (SELECT *, list_filter([CASE WHEN vol > 0.2 THEN 'vol' END, CASE WHEN dd < -0.10 THEN 'drawdown' END, CASE WHEN regime IN ('BEAR_LOW_VOL', 'BEAR_HIGH_VOL') THEN 'regime' END,
    CASE WHEN (ticker % 10) / 20.0 > 0.25 THEN 'psi' END], lambda x: x IS NOT NULL) AS t FROM al)""", lambda s, d: P.reduce_capital(alloc(s, d).withColumn("psi", (F.col("ticker") % 10) / 20.0)), AL)

# options
spot = lambda s, d: V.chain(s, d).groupBy("underlying").agg(F.avg("strike").alias("spot"))
SPOT = "spot AS (SELECT underlying, avg(strike) AS spot FROM chain GROUP BY 1)"
GX = SPOT + """, gx AS (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot * sd) * (oi_call - oi_put) * 100 * spot * spot / 1e9 AS gex FROM (SELECT *, (ln(spot / strike) + (0.05 + iv * iv / 2) * t) / sd AS d1 FROM (SELECT *, days_to_expiry / 365 AS t, iv * sqrt(days_to_expiry / 365) AS sd FROM chain JOIN spot USING (underlying)))),
gs AS (SELECT underlying, strike, arg_max(gex, {'d': days_to_expiry, 'i': iv}) AS gex FROM gx GROUP BY 1, 2), gt AS (SELECT underlying, sum(gex) AS total_gex, max(spot) AS spot FROM gx GROUP BY 1)"""
reg("gamma_exposure", "underlying:s strike:2 gex:9 total_gex:9", "chain", "SELECT underlying, strike, gex, total_gex FROM gs JOIN gt USING (underlying)", lambda s, d: O.gex_by_strike(V.chain(s, d), spot(s, d)), GX)
reg("gamma_flip", "underlying:s gamma_flip:5 total_gex:9", "chain", """SELECT underlying, coalesce(arg_min(lv, strike) FILTER (gex * g2 < 0), max(spot)) AS gamma_flip, max(total_gex) AS total_gex FROM (SELECT *, strike + (k2 - strike) * (-gex) / (g2 - gex + 1e-10) AS lv FROM (SELECT *, lead(strike) OVER w AS k2, lead(gex) OVER w AS g2 FROM gs JOIN gt USING (underlying) WINDOW w AS (PARTITION BY underlying ORDER BY strike))) GROUP BY underlying""",
    lambda s, d: O.gamma_flip(O.gex_by_strike(V.chain(s, d), spot(s, d))), GX)
reg("max_pain", "underlying:s max_pain:2 pain:2", "chain", """SELECT underlying, arg_min(k, {'p': pain, 'k': k}) AS max_pain, min(pain) AS pain FROM (SELECT a.underlying, a.strike AS k, sum(b.oi_call * greatest(b.strike - a.strike, 0) + b.oi_put * greatest(a.strike - b.strike, 0)) AS pain FROM (SELECT DISTINCT underlying, strike FROM chain) a JOIN chain b USING (underlying) GROUP BY 1, 2) GROUP BY 1""",
    lambda s, d: O.max_pain(V.chain(s, d)))
reg("iv_term_skew", "underlying:s days_to_expiry:i atm_iv skew_25d term_slope contango:i", "chain", """SELECT *, term_slope > 0 AS contango FROM (SELECT underlying, days_to_expiry, atm_iv, coalesce(p, atm_iv) - coalesce(c, atm_iv) AS skew_25d, arg_max(atm_iv, days_to_expiry) OVER (PARTITION BY underlying) - arg_min(atm_iv, days_to_expiry) OVER (PARTITION BY underlying) AS term_slope FROM
    (SELECT underlying, days_to_expiry, max(atm_iv) AS atm_iv, avg(iv) FILTER (strike < spot - r AND strike > spot - 2 * r) AS p, avg(iv) FILTER (strike > spot + r AND strike < spot + 2 * r) AS c FROM (SELECT *, spot * atm_iv * sqrt(days_to_expiry / 365) * 0.5 AS r FROM chain JOIN spot USING (underlying) JOIN
    (SELECT underlying, days_to_expiry, arg_min(iv, {'a': abs(strike - spot), 'k': strike}) AS atm_iv FROM chain JOIN spot USING (underlying) GROUP BY 1, 2) USING (underlying, days_to_expiry)) GROUP BY 1, 2))""", lambda s, d: O.iv_term_skew(V.chain(s, d), spot(s, d)), SPOT)
reg("option_flow", "underlying:s call_iv put_iv iv_skew pc_volume pc_oi flow:s", "chain", """SELECT *, put_iv - call_iv AS iv_skew, CASE WHEN pc_volume < 0.7 AND put_iv - call_iv < 0.02 THEN 'BULLISH' WHEN pc_volume > 1.5 AND put_iv - call_iv > 0.05 THEN 'BEARISH' ELSE 'NEUTRAL' END AS flow FROM (SELECT underlying, avg(iv) FILTER (oi_call > 0 AND rc <= 3) AS call_iv, avg(iv) FILTER (oi_put > 0 AND rp <= 3) AS put_iv,
    sum(vol_put) / greatest(sum(vol_call), 1) AS pc_volume, sum(oi_put) / greatest(sum(oi_call), 1) AS pc_oi FROM (SELECT *, row_number() OVER (PARTITION BY underlying, oi_call > 0 ORDER BY abs(strike - spot), strike, days_to_expiry, iv) AS rc, row_number() OVER (PARTITION BY underlying, oi_put > 0 ORDER BY abs(strike - spot), strike, days_to_expiry, iv) AS rp FROM chain JOIN spot USING (underlying)) GROUP BY underlying)""",
    lambda s, d: O.option_flow(V.chain(s, d), spot(s, d)), SPOT)
