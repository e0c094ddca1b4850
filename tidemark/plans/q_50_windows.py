"""Window operators, top-k and set operations with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.ewm import with_ewms
from tidemark.functions.frames import by, full, running
from tidemark.operators import windows as X
from tidemark.operators.joins import year_ago
from tidemark.plans.oracle import W, ewm, sql_norm_ppf
from tidemark.plans.oracle import full as sfull
from tidemark.plans.q_10_technical import market, rets
from tidemark.plans.q_30_sources_filters import QREV, reg
from tidemark.sources import stores as S
from tidemark.sources import views as V

reg("cs_rank_pct", "ticker d rank_pct", "rets", """SELECT ticker, d, CASE WHEN count(r) OVER (PARTITION BY d) < 5 THEN 0.5 WHEN r IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY d, r IS NULL ORDER BY r) + (count(*) OVER (PARTITION BY d, r) - 1) / 2.0) / count(r) OVER (PARTITION BY d) END AS rank_pct FROM rets""",
    lambda s, d: (lambda b: b.select("ticker", "d", X.cs_rank_pct(b, "r").alias("rank_pct")))(rets(s, d)))
reg("cs_rank_minmax", "ticker d rank01", "rets", """SELECT ticker, d, CASE WHEN r IS NOT NULL AND count(r) OVER (PARTITION BY d) >= 2 THEN (row_number() OVER (PARTITION BY d, r IS NULL ORDER BY r, ticker) - 1) / (count(r) OVER (PARTITION BY d) - 1) END AS rank01 FROM rets""",
    lambda s, d: rets(s, d).select("ticker", "d", X.cs_rank_minmax("r").alias("rank01")))
reg("cs_robust_normalise", "ticker d robust", "rets", """SELECT ticker, d, CASE WHEN nn >= 5 AND r IS NOT NULL THEN least(greatest((r - q2) / CASE WHEN q3 - q1 > 0 THEN q3 - q1 ELSE sd + 1e-10 END, -3.0), 3.0) END AS robust FROM rets JOIN
    (SELECT d, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS q2, quantile_cont(r, 0.75) AS q3, count(r) AS nn, stddev_samp(r) AS sd FROM rets GROUP BY d) USING (d)""", lambda s, d: X.cs_robust(rets(s, d), "r"))


def sessions_at_month_end(b):
    return b.groupBy(F.last_day("d").alias("m")).agg(F.max("d").alias("d")).select("d")


reg("cs_past_only_normalise", "ticker as_of z pct normal_score", "rets", f"""SELECT ticker, as_of, z, pct, {sql_norm_ppf('pct')} AS normal_score FROM (SELECT ticker, as_of, z, least(greatest((rank() OVER (PARTITION BY as_of ORDER BY z) + (count(*) OVER (PARTITION BY as_of, z) - 1) / 2.0) / count(*) OVER (PARTITION BY as_of), 0.01), 0.99) AS pct
    FROM (SELECT ticker, d AS as_of, least(greatest((r - q2) / CASE WHEN q3 = q1 THEN 1.0 ELSE q3 - q1 END, -3.0), 3.0) AS z FROM rets JOIN par ON par.as_of = rets.d WHERE r IS NOT NULL))""",
    lambda s, d: (lambda b: X.cs_past_only(b, sessions_at_month_end(b), "r"))(rets(s, d).select("ticker", "d", "r")),
    """cal AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM rets)), ask AS (SELECT d AS as_of, i AS ai FROM cal WHERE d IN (SELECT max(d) FROM rets GROUP BY last_day(d))),
par AS (SELECT as_of, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS q2, quantile_cont(r, 0.75) AS q3 FROM ask JOIN cal ON cal.i BETWEEN ai - 60 AND ai - 1 JOIN rets ON rets.d = cal.d GROUP BY 1)""")
PCT = """SELECT ticker, bucket, CASE WHEN n >= 5 THEN 100.0 * (less + 0.5 * eq) / n END AS pct_mid, CASE WHEN n >= 5 THEN less / n END AS pct_below FROM (SELECT ticker, bucket, count(market_cap) OVER (PARTITION BY bucket) AS n,
    rank() OVER (PARTITION BY bucket ORDER BY market_cap) - 1 AS less, count(*) OVER (PARTITION BY bucket, market_cap) AS eq FROM universe)"""
reg("percentile_rank_midpoint", "ticker bucket:s pct_mid inverted", "universe", f"SELECT *, 100 - pct_mid AS inverted FROM ({PCT})", lambda s, d: X.percentile_ranks(V.universe(s, d), ["bucket"], "market_cap").withColumn("inverted", 100 - F.col("pct_mid")))
reg("percentile_below_only", "ticker bucket:s pct_below", "universe", PCT, lambda s, d: X.percentile_ranks(V.universe(s, d), ["bucket"], "market_cap"))
reg("rolling_mean_std_min_max", "ticker d m:7 sd:5 lo:4 hi:4", "rets", f"SELECT ticker, d, {sfull('avg(c)', 20)} AS m, {sfull('stddev_samp(c)', 20)} AS sd, {sfull('min(c)', 20)} AS lo, {sfull('max(c)', 20)} AS hi FROM rets {W}",
    lambda s, d: V.bars(s, d).select("ticker", "d", full(F.avg, "c", 20).alias("m"), full(F.stddev_samp, "c", 20).alias("sd"), full(F.min, "c", 20).alias("lo"), full(F.max, "c", 20).alias("hi")))
reg("pct_change_lag", "ticker d r:8 lr:8", "rets", "SELECT ticker, d, r, lr FROM rets", rets)
reg("cumulative_sum_product", "ticker d cum_volume:2 nav", "rets", f"SELECT ticker, d, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_volume, exp(sum(ln(1 + coalesce(r, 0))) OVER (w ROWS UNBOUNDED PRECEDING)) AS nav FROM rets {W}",
    lambda s, d: rets(s, d).select("ticker", "d", F.sum("v").over(running()).alias("cum_volume"), F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(running())).alias("nav")))
reg("running_max_drawdown", "ticker d peak:4 dd", "bars", f"SELECT ticker, d, max(c) OVER (w ROWS UNBOUNDED PRECEDING) AS peak, c / max(c) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars {W}", lambda s, d: X.drawdown(V.bars(s, d)))
DDS = f"""ddx AS (SELECT ticker, d, c, max(c) OVER (w ROWS UNBOUNDED PRECEDING) AS peak FROM bars {W}), tr AS (SELECT ticker, min(c / peak - 1) AS dd, arg_min(d, {{'x': c / peak - 1, 'd': d}}) AS td, arg_min(peak, {{'x': c / peak - 1, 'd': d}}) AS tp FROM ddx GROUP BY 1),
pk AS (SELECT tr.ticker, min(ddx.d) AS pd FROM tr JOIN ddx ON ddx.ticker = tr.ticker AND ddx.d <= td AND ddx.c = tp GROUP BY 1), rc AS (SELECT tr.ticker, min(ddx.d) AS rd FROM tr JOIN ddx ON ddx.ticker = tr.ticker AND ddx.d > td AND ddx.c >= tp GROUP BY 1)"""
reg("drawdown_duration", "ticker max_drawdown duration_days:i underwater_share recovered:i", "bars", """SELECT ticker, dd AS max_drawdown, coalesce(rd, last_d) - pd AS duration_days, uw AS underwater_share, rd IS NOT NULL AS recovered FROM tr JOIN pk USING (ticker) LEFT JOIN rc USING (ticker)
    JOIN (SELECT ticker, max(d) AS last_d, avg(CASE WHEN c / peak - 1 < -0.001 THEN 1.0 ELSE 0 END) AS uw FROM ddx GROUP BY 1) USING (ticker)""", lambda s, d: X.drawdown_duration(V.bars(s, d)), DDS)
reg("ewm_recursive", "ticker d ewm_c:5 ewm_v:5", "rets", f"SELECT ticker, d, {ewm('c', '0.1')} AS ewm_c, {ewm('v', '(2.0/11)')} AS ewm_v FROM rets {W}",
    lambda s, d: with_ewms(rets(s, d), {"ewm_c": ("c", 0.1), "ewm_v": ("v", 2.0 / 11)}))
wsum = lambda x: f"sum(({x}) * pow(q, -kk)) OVER (w ROWS UNBOUNDED PRECEDING) * pow(q, kk)"
reg("ewm_adjusted_var_cov", "ticker d ewm_std ewm_beta:5", "rets mkt", f"""SELECT ticker, d, sqrt(greatest((sxx / sw - pow(sx / sw, 2)) * cf, 0.0)) AS ewm_std, (sxm / sw - sx * sm / sw / sw) / (smm / sw - pow(sm / sw, 2) + 1e-10 / cf) AS ewm_beta FROM (SELECT *, sw * sw / (sw * sw - sw2) AS cf FROM
    (SELECT ticker, d, kk, {wsum('1.0')} AS sw, sum(pow(q, -2 * kk)) OVER (w ROWS UNBOUNDED PRECEDING) * pow(q, 2 * kk) AS sw2, {wsum('r')} AS sx, {wsum('r * r')} AS sxx, {wsum('mr')} AS sm, {wsum('mr * mr')} AS smm, {wsum('r * mr')} AS sxm
    FROM (SELECT ticker, d, r, mr, rn - 2 AS kk, 1.0 - 2.0 / 64 AS q FROM rets JOIN mkt USING (d) WHERE r IS NOT NULL) {W})) WHERE kk >= 9""",
    lambda s, d: X.ewm_adjusted(rets(s, d).join(market(s, d), "d"), 2.0 / 64))
reg("slope_over_last_n", "ticker obv_slope price_slope ad_line_slope price_vol_divergence", "tails", """SELECT ticker, regr_slope(obv, i) / (abs(avg(obv)) + 1e-9) AS obv_slope, regr_slope(c, i) / (avg(c) + 1e-9) AS price_slope, regr_slope(ad, i) / (abs(avg(ad)) + 1e-9) AS ad_line_slope,
    regr_slope(obv, i) / (abs(avg(obv)) + 1e-9) - regr_slope(c, i) / (avg(c) + 1e-9) AS price_vol_divergence FROM (SELECT ticker, c, k, CAST(-k AS DOUBLE) AS i, sum(v * coalesce(sign(r), 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS obv,
    sum(CASE WHEN h = l THEN 0 ELSE (2 * c - l - h) / (h - l) * v END) OVER (w ROWS UNBOUNDED PRECEDING) AS ad FROM tails WINDOW w AS (PARTITION BY ticker ORDER BY d)) WHERE k < 63 GROUP BY ticker""", lambda s, d: X.last_n_slopes(rets(s, d)))
ERC = f"er AS ({QREV})"
TTM = """tt AS (SELECT cik, "end", ttm, knowable FROM (SELECT cik, "end", sum(val) OVER (w ROWS 3 PRECEDING) AS ttm, max(filed) OVER (w ROWS 3 PRECEDING) AS knowable, "end" - lag("end", 3) OVER w AS span FROM er WINDOW w AS (PARTITION BY cik ORDER BY "end")) WHERE span BETWEEN 230 AND 320)"""
qrev = lambda s, d: S.quarterly_series(V.facts(s, d), "revenue")
reg("ttm_rolling4", "cik:i end:s ttm:2 knowable:s", "facts", "SELECT * FROM tt", lambda s, d: X.ttm(qrev(s, d)), ERC + ", " + TTM)
reg("ttm_last_complete", "ticker period_end:s ttm:2", "quarters", """SELECT ticker, max(period_end) AS period_end, arg_max(s, period_end) AS ttm FROM (SELECT ticker, period_end, sum(x) OVER w AS s, count(x) OVER w AS k FROM (SELECT *, CASE WHEN n % 11 <> 0 THEN revenue END AS x FROM quarters)
    WINDOW w AS (PARTITION BY ticker ORDER BY period_end ROWS 3 PRECEDING)) WHERE k = 4 GROUP BY ticker""",
    lambda s, d: (lambda w: V.quarters(s, d).withColumn("x", F.when(F.col("n") % 11 != 0, F.col("revenue"))).withColumn("s", F.when(F.count("x").over(w) == 4, F.sum("x").over(w))).where("s is not null")
                  .groupBy("ticker").agg(F.max("period_end").alias("period_end"), F.max_by("s", "period_end").alias("ttm")))(by("ticker", "period_end").rowsBetween(-3, 0)))
AREV = QREV.replace("80 AND 100", "350 AND 380")
reg("q4_synthesis", "cik:i end:s val:2 filed:s", "facts", """SELECT cik, "end", val, filed FROM er UNION ALL SELECT cik, ae, av - s, greatest(af, qf) FROM (SELECT a.cik, a."end" AS ae, a.val AS av, a.filed AS af, count(*) AS n, sum(q.val) AS s, max(q.filed) AS qf FROM ar a JOIN er q ON q.cik = a.cik
    AND a."end" - q."end" BETWEEN 1 AND 320 WHERE NOT EXISTS (SELECT 1 FROM er e WHERE e.cik = a.cik AND e."end" = a."end") GROUP BY 1, 2, 3, 4) WHERE n = 3 AND av - s > 0""",
    lambda s, d: X.q4_synthesis(qrev(s, d), S.quarterly_series(V.facts(s, d), "revenue", 350, 380)), f"{ERC}, ar AS ({AREV})")


def ytd(s, d):
    w = Window.partitionBy("ticker", F.year("period_end")).orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    x = V.quarters(s, d).select(F.col("ticker").alias("cik"), F.trunc("period_end", "year").alias("start"), F.col("period_end").alias("end"), F.sum("revenue").over(w).alias("val"), "filed", (F.col("n") % 2 == 0).alias("framed"))
    return x.unionByName(x.where("framed = false").withColumn("val", F.col("val") + 5).withColumn("filed", F.date_sub("filed", 1)))


reg("cumulative_to_discrete", "cik:i end:s val:2", "quarters", """SELECT ticker AS cik, period_end AS "end", revenue AS val FROM quarters""", lambda s, d: X.cumulative_to_discrete(ytd(s, d)))
GS = """ok AS (SELECT a.cik, a."end", max(CASE WHEN a.val / m.b.v - 1 > 0 AND m.b.v >= 500000 THEN 1 ELSE 0 END) AS ok FROM er a LEFT JOIN (SELECT a.cik, a."end", min({'g': abs(a."end" - 365 - b."end"), 'e': b."end", 'v': b.val}) AS b FROM er a JOIN er b ON a.cik = b.cik AND b."end" < a."end"
    AND abs(a."end" - 365 - b."end") <= 45 GROUP BY 1, 2) m ON m.cik = a.cik AND m."end" = a."end" GROUP BY 1, 2)"""
reg("growth_streak", "cik:i streak:i", "facts", """SELECT cik, count(*) FILTER (bad = 0) AS streak FROM (SELECT cik, sum(1 - ok) OVER (PARTITION BY cik ORDER BY "end" DESC ROWS UNBOUNDED PRECEDING) AS bad FROM ok) GROUP BY 1""",
    lambda s, d: X.streak(year_ago(qrev(s, d), "cik", "end", "val"), "cik", "end", (F.col("val") / F.col("prior") - 1 > 0) & (F.col("prior") >= 500000)), f"{ERC}, {GS}")
reg("accumulation_streak", "ticker accum_streak_weeks:i", "tails", """SELECT ticker, count(*) FILTER (bad = 0) AS accum_streak_weeks FROM (SELECT ticker, sum(CASE WHEN share > 0.45 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY wk ROWS UNBOUNDED PRECEDING) AS bad FROM (SELECT ticker, k // 5 AS wk, sum(up) / sum(v) AS share FROM
    (SELECT *, CASE WHEN c > lag(c) OVER (PARTITION BY ticker ORDER BY d) THEN v ELSE 0.0 END AS up FROM tails) WHERE rn > 1 GROUP BY 1, 2 HAVING count(*) = 5)) GROUP BY 1""", lambda s, d: X.accumulation_streak(rets(s, d), 0.45))
RISE = """mo AS (SELECT ticker, last_day(d) AS m, arg_max(c, d) AS c, sum(v) AS v FROM bars GROUP BY 1, 2),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY ticker ORDER BY m) AS g FROM (SELECT ticker, m, lag(m) OVER w AS p, c > lag(c) OVER w AS up, row_number() OVER w AS i FROM mo WINDOW w AS (PARTITION BY ticker ORDER BY m)) WHERE up)"""
reg("first_durable_rise", "ticker rise_start:s", "bars", "SELECT ticker, min(s) AS rise_start FROM (SELECT ticker, g, min(p) AS s FROM isl GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1",
    lambda s, d: X.first_durable_rise(V.bars(s, d).groupBy("ticker", F.last_day("d").alias("m")).agg(F.max_by("c", "d").alias("c")), "ticker", "m", "c"), RISE)
STATE = "CASE WHEN r > 0.01 THEN 'up' WHEN r < -0.01 THEN 'down' ELSE 'flat' END"
reg("run_length_regimes", "state:s mean_run p_stay persistence", "rets", f"""SELECT state, avg(n) FILTER (NOT open) AS mean_run, sum(stay) / sum(pairs) AS p_stay, 1 / (1 - sum(stay) / sum(pairs)) AS persistence FROM (SELECT ticker, run, state, count(*) AS n, count(*) FILTER (nxt = state) AS stay, count(nxt) AS pairs, bool_or(nxt IS NULL) AS open FROM
    (SELECT *, sum(nw) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT ticker, d, state, lead(state) OVER w AS nxt, CASE WHEN state = lag(state) OVER w THEN 0 ELSE 1 END AS nw FROM (SELECT *, {STATE} AS state FROM rets WHERE r IS NOT NULL) {W})) GROUP BY 1, 2, 3) GROUP BY 1""",
    lambda s, d: X.run_lengths(rets(s, d).where("r is not null").withColumn("state", F.expr(STATE)), "ticker", "d", "state"))


def swing_levels(s, d):
    from tidemark.operators.volatility import support_extrema

    e = support_extrema(rets(s, d))
    return e.select("ticker", F.explode(F.array(F.struct(F.lit("resistance").alias("kind"), F.col("resistance").alias("level")), F.struct(F.lit("support").alias("kind"), F.col("support").alias("level")))).alias("x")).select("ticker", "x.*").where("level is not null")


LEV = """ext AS (SELECT ticker, d, CASE WHEN count(*) OVER x = 21 AND h = max(h) OVER x THEN h END AS resistance, CASE WHEN count(*) OVER x = 21 AND l = min(l) OVER x THEN l END AS support FROM rets WINDOW x AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
lv AS (SELECT ticker, 'resistance' AS kind, resistance AS level FROM ext WHERE resistance IS NOT NULL UNION ALL SELECT ticker, 'support', support FROM ext WHERE support IS NOT NULL),
cl AS (SELECT *, sum(nw) OVER (PARTITION BY ticker, kind ORDER BY level, nw DESC ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN level / lag(level) OVER (PARTITION BY ticker, kind ORDER BY level) - 1 < 0.01 THEN 0 ELSE 1 END AS nw FROM lv)),
lc AS (SELECT ticker, kind, cluster, avg(level) AS level, count(*) AS n FROM cl GROUP BY 1, 2, 3)"""
reg("level_clustering", "ticker kind:s cluster:i level:5 n:i", "rets", "SELECT * FROM lc", lambda s, d: X.cluster_levels(swing_levels(s, d)), LEV)
WIN = (1, 3, 7, 14, 30, 60, 90)
reg("price_ladder", "ticker " + " ".join(f"ret_{k}d" for k in WIN), "bars", "SELECT ticker, " + ", ".join(f"arg_max(c, d) / arg_max(c, d) FILTER (d <= t - {k}) - 1 AS ret_{k}d" for k in WIN) + " FROM (SELECT *, max(d) OVER (PARTITION BY ticker) AS t FROM bars) GROUP BY ticker",
    lambda s, d: X.price_ladder(V.bars(s, d)))


def bands(s, d):
    """Rebased weekly closes of every sector, with index-picked quartiles. Forward fill runs per instrument; the picks come
    from ordinal positions inside (sector, week), whose groups are one row per instrument."""
    sec = V.universe(s, d).select("ticker", "bucket")
    wk = V.bars(s, d).groupBy("ticker", F.to_date(F.date_trunc("week", "d")).alias("w")).agg(F.max_by("c", "d").alias("c"))
    cal = wk.select("w").distinct()
    ext = wk.groupBy("ticker").agg(F.min("w").alias("w0"))
    grid = ext.join(cal, F.col("w") >= F.col("w0")).select("ticker", "w")
    g = grid.join(wk, ["ticker", "w"], "left").withColumn("c", F.last("c", ignorenulls=True).over(running("ticker", "w")))
    g = g.withColumn("x", (F.col("c") / F.first("c").over(by("ticker", "w").rowsBetween(Window.unboundedPreceding, 0)) - 1) * 100).join(sec, "ticker")
    p = Window.partitionBy("bucket", "w")
    g = g.withColumn("i", F.row_number().over(p.orderBy("x", "ticker")) - 1).withColumn("n", F.count(F.lit(1)).over(p))
    pick = lambda q: F.max(F.when(F.col("i") == q, F.col("x")))
    a = g.groupBy("bucket", "w").agg(F.max("n").alias("n"), pick(F.floor(F.col("n") / 2)).alias("med"), pick(F.floor(F.col("n") * 0.25)).alias("p25"), pick(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.75))).alias("p75"))
    return a.where("n >= 4")


reg("rebase_percentile_bands", "bucket:s w:s n:i med:4 p25:4 p75:4", "universe", """SELECT bucket, w, max(n) AS n, max(x) FILTER (i = n // 2) AS med, max(x) FILTER (i = CAST(floor(n * 0.25) AS BIGINT)) AS p25, max(x) FILTER (i = least(n - 1, CAST(floor(n * 0.75) AS BIGINT))) AS p75 FROM
    (SELECT bucket, w, x, row_number() OVER (PARTITION BY bucket, w ORDER BY x, ticker) - 1 AS i, count(*) OVER (PARTITION BY bucket, w) AS n FROM (SELECT ticker, w, (c / first_value(c) OVER (PARTITION BY ticker ORDER BY w) - 1) * 100 AS x FROM
    (SELECT ticker, w, last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY w ROWS UNBOUNDED PRECEDING) AS c FROM grid LEFT JOIN wk USING (ticker, w))) JOIN universe USING (ticker)) GROUP BY 1, 2 HAVING max(n) >= 4""", bands,
    "wk AS (SELECT ticker, CAST(date_trunc('week', d) AS DATE) AS w, arg_max(c, d) AS c FROM bars GROUP BY 1, 2), grid AS (SELECT e.ticker, c.w FROM (SELECT ticker, min(w) AS w0 FROM wk GROUP BY 1) e JOIN (SELECT DISTINCT w FROM wk) c ON c.w >= e.w0)")

# set operations
reg("union_quarter_annual", "cik:i end:s val:2 filed:s", "facts", 'SELECT cik, "end", val, filed FROM er UNION ALL SELECT cik, "end", val, filed FROM ar WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.cik = ar.cik AND er."end" = ar."end")',
    lambda s, d: (lambda q, a: q.select("cik", "end", "val", "filed").unionByName(a.select("cik", "end", "val", "filed").join(q.select("cik", "end"), ["cik", "end"], "left_anti")))(qrev(s, d), S.quarterly_series(V.facts(s, d), "revenue", 350, 380)), f"{ERC}, ar AS ({AREV})")


def entries_exits(s, d):
    """Names that enter or leave the top decile between months: membership runs found with lag and lead per name."""
    top = V.bars(s, d).groupBy("ticker", F.last_day("d").alias("m")).agg(F.sum(F.col("c") * F.col("v")).alias("dv"))
    p = Window.partitionBy("m")
    top = top.withColumn("_r", F.row_number().over(p.orderBy(F.col("dv").desc(), "ticker"))).withColumn("_n", F.count(F.lit(1)).over(p)).where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1)))
    w = Window.partitionBy("ticker").orderBy("m")
    nxt, prv = F.last_day(F.add_months("m", 1)), F.last_day(F.add_months("m", -1))
    x = top.select("ticker", "m", F.lag("m").over(w).eqNullSafe(prv).alias("had"), F.lead("m").over(w).eqNullSafe(nxt).alias("has"), nxt.alias("nm"))
    return x.where(~F.col("had")).select("ticker", "m", F.lit("entry").alias("kind")).unionByName(x.where(~F.col("has")).select("ticker", F.col("nm").alias("m"), F.lit("exit").alias("kind")))


reg("entries_exits", "ticker m:s kind:s", "bars", """SELECT a.ticker, a.m, 'entry' AS kind FROM dec a WHERE NOT EXISTS (SELECT 1 FROM dec b WHERE b.ticker = a.ticker AND b.m = last_day(a.m - INTERVAL 1 MONTH)) UNION ALL SELECT a.ticker, last_day(a.m + INTERVAL 1 MONTH), 'exit' FROM dec a
    WHERE NOT EXISTS (SELECT 1 FROM dec b WHERE b.ticker = a.ticker AND b.m = last_day(a.m + INTERVAL 1 MONTH))""", entries_exits, """dec AS (SELECT ticker, m FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY dv DESC, ticker) AS r, count(*) OVER (PARTITION BY m) AS n FROM
    (SELECT ticker, last_day(d) AS m, sum(c * v) AS dv FROM bars GROUP BY 1, 2)) WHERE r <= greatest(1, floor(n * 0.1)))""")
reg("intersect_dates", "ticker n_shared:i", "bars", "SELECT ticker, count(*) AS n_shared FROM bars WHERE ticker <> 1 AND d IN (SELECT d FROM bars WHERE ticker = 1) GROUP BY ticker",
    lambda s, d: (lambda b: b.where("ticker <> 1").join(b.where("ticker = 1").select("d"), "d", "left_semi").groupBy("ticker").agg(F.count(F.lit(1)).alias("n_shared")))(V.bars(s, d)))
reg("union_tags", "cik:i fy:i val:2 tag:s", "facts", """SELECT cik, year("end") AS fy, arg_min(val, p) AS val, arg_min(metric, p) AS tag FROM (SELECT *, CASE metric WHEN 'op_cash_flow' THEN 1 WHEN 'net_income' THEN 2 ELSE 3 END + CASE WHEN val <= 0 THEN 10 ELSE 0 END AS p FROM facts WHERE fp = 'FY' AND metric IN ('op_cash_flow', 'net_income', 'gross_profit')) GROUP BY 1, 2""",
    lambda s, d: (lambda f, p: f.groupBy("cik", F.year("end").alias("fy")).agg(F.min_by("val", p).alias("val"), F.min_by("metric", p).alias("tag")))(
        V.facts(s, d).where("fp = 'FY' and metric in ('op_cash_flow', 'net_income', 'gross_profit')"), F.expr("case metric when 'op_cash_flow' then 1 when 'net_income' then 2 else 3 end + case when val <= 0 then 10 else 0 end")))


def population(s, d):
    """Passers and controls of each quarter, tagged and stacked."""
    q = V.quarters(s, d).select("ticker", F.col("period_end").alias("as_of"), (F.col("net_income") > 0).alias("passed"), F.col("revenue").alias("x"))
    return q.where("passed").unionByName(q.where("not passed and x > 600000"))


reg("event_population_union", "ticker as_of passed:i x:2", "quarters", "SELECT ticker, period_end AS as_of, net_income > 0 AS passed, revenue AS x FROM quarters WHERE net_income > 0 OR revenue > 600000", population)
