"""Fundamentals with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import clip, sdiv
from tidemark.operators import filters as FL
from tidemark.operators import fundamentals as X
from tidemark.operators import joins as J
from tidemark.operators import windows as WN
from tidemark.plans.q_30_sources_filters import QREV, reg
from tidemark.plans.q_50_windows import ERC, GS, TTM, qrev
from tidemark.sources import stores as S
from tidemark.sources import views as V

c = F.col
FB = ("fb0 AS (SELECT *, " + ", ".join(f"CASE WHEN q >= 4 THEN sum({f}) OVER (w ROWS 3 PRECEDING) END AS ttm_{f}" for f in X.FLOWS) + ", " + ", ".join(f"lag({s}, 4) OVER w AS y_{s}" for s in (*X.STOCKS, "revenue", "gross_profit", "net_income"))
      + " FROM quarters WINDOW w AS (PARTITION BY ticker ORDER BY period_end)), fb AS (SELECT *, " + ", ".join(f"lag(ttm_{f}, 4) OVER (PARTITION BY ticker ORDER BY period_end) AS ttmp_{f}" for f in ("revenue", "gross_profit", "net_income", "operating_income", "op_cash_flow")) + " FROM fb0)")
base = lambda s, d: X.fund_base(V.quarters(s, d))


def fb(name, cols, sql, fn, ctes="", views="quarters"):
    reg(name, "ticker period_end:s " + cols, views, sql, lambda s, d: fn(base(s, d)), FB + (", " + ctes if ctes else ""))


IC = "CASE WHEN equity + debt - cash > 0 THEN equity + debt - cash END"
fb("quarter_ratios", "nopat:2 invested_capital:2 fcf:2 gross_margin operating_margin net_margin current_ratio debt_to_equity roic roe roa", f"""SELECT ticker, period_end, operating_income * 0.79 AS nopat, {IC} AS invested_capital, op_cash_flow - abs(capex) AS fcf, gross_profit / revenue AS gross_margin, operating_income / revenue AS operating_margin, net_income / revenue AS net_margin,
    current_assets / current_liabilities AS current_ratio, CASE WHEN equity > 0 THEN debt / equity END AS debt_to_equity, operating_income * 0.79 / {IC} AS roic, CASE WHEN equity > 0 THEN net_income / equity END AS roe, net_income / assets AS roa FROM fb""", X.quarter_ratios)
CI = lambda x: f"CASE WHEN {x} THEN 1 ELSE 0 END"
PF = f"""pf AS (SELECT ticker, period_end, {CI('ttm_net_income > 0')} + {CI('ttm_op_cash_flow > 0')} + {CI('ttm_net_income / assets > ttmp_net_income / y_assets')} + {CI('ttm_op_cash_flow > ttm_net_income')} + {CI('debt < y_debt')} + {CI('current_assets / current_liabilities > y_current_assets / y_current_liabilities')}
    + {CI('ttm_gross_profit / ttm_revenue > ttmp_gross_profit / ttmp_revenue')} + {CI('ttm_revenue / assets > ttmp_revenue / y_assets')} AS f8, {CI('ttm_net_income > 0')} + {CI('ttm_op_cash_flow > 0')} + {CI('ttm_net_income / assets > ttmp_net_income / y_assets')} + {CI('ttm_op_cash_flow > ttm_net_income')}
    + {CI('current_assets / current_liabilities > y_current_assets / y_current_liabilities')} + {CI('ttm_gross_profit / ttm_revenue > ttmp_gross_profit / ttmp_revenue')} AS f6, {CI('ttm_net_income / av > 0')} + {CI('ttm_op_cash_flow > 0')} + {CI('ttm_net_income / av > y_net_income / y_assets')} + {CI('ttm_op_cash_flow > ttm_net_income')}
    + {CI('debt / assets < y_debt / y_assets')} + {CI('current_assets / current_liabilities > y_current_assets / y_current_liabilities')} + {CI('shares <= y_shares * 1.01')} + {CI('gross_profit / revenue > y_gross_profit / y_revenue')} + {CI('revenue / av > y_revenue / y_assets')} AS f9 FROM (SELECT *, (assets + y_assets) / 2 AS av FROM fb) WHERE q >= 8)"""
fb("piotroski_ttm", "f8:i f6:i f9:i", "SELECT * FROM pf", X.piotroski_ttm, PF)
AO = """ao AS (SELECT ticker, period_end, 1.2 * wc / assets + 1.4 * retained_earnings / assets + rest AS altman_z, 1.2 * wc / assets + 1.4 * ttm_net_income / assets + rest AS altman_z_income, -1.32 - 0.407 * ln(greatest(assets, 1.0) / 1e6) + 6.03 * liabilities / assets - 1.43 * wc / assets - 2.37 * ttm_net_income / assets - 1.83 * ttm_op_cash_flow / liabilities AS ohlson_o
    FROM (SELECT *, current_assets - current_liabilities AS wc, 3.3 * ttm_operating_income / assets + 0.6 * equity / liabilities + ttm_revenue / assets AS rest FROM fb WHERE q >= 4 AND liabilities > 0))"""
fb("altman_ohlson", "altman_z altman_z_income ohlson_o bankruptcy_prob zone:s", "SELECT *, 1 / (1 + exp(-ohlson_o)) AS bankruptcy_prob, CASE WHEN altman_z > 2.99 THEN 'safe' WHEN altman_z < 1.81 THEN 'distress' ELSE 'grey' END AS zone FROM ao", X.altman_ohlson, AO)
fb("beneish", "dsri gmi:4 aqi:4 sgi tata m_score:4 flagged:i", """SELECT *, m_score > -1.78 AS flagged FROM (SELECT *, -4.84 + 0.92 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi + 4.679 * tata AS m_score FROM (SELECT ticker, period_end, (receivables / revenue) / (y_receivables / y_revenue) AS dsri, (y_gross_profit / y_revenue) / nullif(gross_profit / revenue, 0) AS gmi,
    (1 - (current_assets + ppe) / assets) / nullif(1 - (y_current_assets + y_ppe) / y_assets, 0) AS aqi, revenue / y_revenue AS sgi, (net_income - op_cash_flow) / assets AS tata FROM fb WHERE q >= 5))""", X.beneish)
fb("dupont_owner_roic", "net_margin asset_turnover equity_multiplier roe_dupont owner_earnings:2 roic_normalised", f"""SELECT ticker, period_end, ttm_net_income / ttm_revenue AS net_margin, ttm_revenue / assets AS asset_turnover, assets / nullif(equity, 0) AS equity_multiplier, ttm_net_income / ttm_revenue * (ttm_revenue / assets) * (assets / nullif(equity, 0)) AS roe_dupont,
    ttm_net_income + ttm_depreciation - abs(ttm_capex) * 0.7 AS owner_earnings, ttm_operating_income * 0.79 / {IC} AS roic_normalised FROM fb WHERE q >= 4""", X.dupont_owner_roic)
QI = f"""qi0 AS (SELECT *, operating_income * 0.79 / {IC} AS ro, gross_profit / revenue AS gm, CASE WHEN net_income > 0 THEN (op_cash_flow - abs(capex)) / net_income END AS cv, CASE WHEN y_revenue > 0 THEN revenue / y_revenue - 1 END AS yy, CASE WHEN equity > 0 THEN debt / equity END AS de, CAST(q AS DOUBLE) AS qd FROM fb),
qi AS (SELECT *, CASE WHEN count(ro) OVER w20 >= 4 THEN avg(ro) OVER w20 END AS roic_mean, CASE WHEN count(ro) OVER wa >= 8 THEN regr_slope(ro, qd) OVER wa END AS roic_slope, CASE WHEN count(gm) OVER w20 >= 8 THEN avg(gm) OVER w20 END AS gm_mean, CASE WHEN count(gm) OVER w20 >= 8 THEN stddev_samp(gm) OVER w20 / avg(gm) OVER w20 END AS gm_cov,
    CASE WHEN count(cv) OVER w20 >= 4 THEN avg(cv) OVER w20 END AS fcf_conv, CASE WHEN count(yy) OVER wa >= 4 THEN avg(yy) OVER wa END AS growth_mean, CASE WHEN count(yy) OVER wa >= 4 THEN stddev_samp(yy) OVER wa END AS growth_std, last_value(de IGNORE NULLS) OVER wa AS de_latest, CASE WHEN count(de) OVER wa >= 8 THEN regr_slope(de, qd) OVER wa END AS de_slope
    FROM qi0 WINDOW w20 AS (PARTITION BY ticker ORDER BY period_end ROWS 19 PRECEDING), wa AS (PARTITION BY ticker ORDER BY period_end ROWS UNBOUNDED PRECEDING))"""
fb("quality_trends", "roic_mean roic_slope gm_mean gm_cov fcf_conv growth_mean growth_std de_latest de_slope", "SELECT * FROM qi", X.quality_inputs, QI)
GGS = lambda x, g, t: f"(CASE WHEN {x} IS NULL THEN 50 WHEN {x} >= {t} THEN 100 WHEN {x} <= {g} - ({t} - {g}) THEN 0 ELSE 50 + 50 * ({x} - {g}) / ({t} - {g}) END)" if t > g else f"(CASE WHEN {x} IS NULL THEN 50 WHEN {x} <= {t} THEN 100 WHEN {x} >= {g} + ({g} - {t}) THEN 0 ELSE 50 + 50 * ({g} - {x}) / ({g} - {t}) END)"
fb("quality_scorecard", "spread past_score:4", f"""SELECT ticker, period_end, sp AS spread, CASE WHEN sp <= 0 THEN least(least(greatest(t, 0.0), 100.0), 45.0) ELSE least(greatest(t, 0.0), 100.0) END AS past_score FROM (SELECT ticker, period_end, sp, 0.25 * CASE WHEN sp IS NULL THEN 50 WHEN sp <= 0 THEN least(greatest(25 + sp * 200, 0.0), 40.0) WHEN sp <= 0.05 THEN 40 + sp / 0.05 * 25 WHEN sp <= 0.15 THEN 65 + (sp - 0.05) / 0.10 * 25 ELSE least(greatest(90 + (sp - 0.15) * 66, 90.0), 100.0) END
    + 0.10 * {GGS('roic_mean', 0.08, 0.20)} + 0.10 * {GGS('gm_cov', 0.15, 0.05)} + 0.15 * {GGS('fcf_conv', 0.8, 1.2)} + 0.08 * {GGS('growth_mean', 0.05, 0.15)} + 0.07 * {GGS('de_latest', 1.0, 0.3)} + 0.10 * coalesce(f8 / 9 * 100, 50) + 0.05 * {GGS('altman_z_income', 1.8, 3.0)} + 0.10 * {GGS('acc', 0.05, -0.05)} AS t
    FROM (SELECT qi.*, f8, altman_z_income, roic_mean - 0.107 AS sp, CASE WHEN q >= 4 THEN (ttm_net_income - ttm_op_cash_flow) / assets END AS acc FROM qi LEFT JOIN pf USING (ticker, period_end) LEFT JOIN ao USING (ticker, period_end)))""", X.quality_scorecard, ", ".join((PF, AO, QI)))


def annual(s, d):
    q = V.quarters(s, d)
    y = F.year("period_end").alias("fy")
    return q.groupBy(c("ticker").alias("cik"), y).agg(*[F.sum(k).alias(k) for k in ("revenue", "gross_profit", "net_income", "op_cash_flow")], *[F.max_by(k, "period_end").alias(k) for k in ("assets", "liabilities", "current_assets", "current_liabilities", "shares")])


PA = "an AS (SELECT ticker AS cik, year(period_end) AS fy, " + ", ".join(f"sum({k}) AS {k}" for k in ("revenue", "gross_profit", "net_income", "op_cash_flow")) + ", " + ", ".join(f"arg_max({k}, period_end) AS {k}" for k in ("assets", "liabilities", "current_assets", "current_liabilities", "shares")) + """ FROM quarters GROUP BY 1, 2),
ap AS (SELECT a.*, """ + ", ".join(f"p.{k} AS p_{k}" for k in ("net_income", "assets", "liabilities", "revenue", "gross_profit", "current_assets", "current_liabilities", "shares")) + f""" FROM an a LEFT JOIN an p ON p.cik = a.cik AND p.fy = a.fy - 1),
pa AS (SELECT *, {CI('net_income > 0')} + {CI('op_cash_flow > 0')} + {CI('net_income / assets > p_net_income / p_assets')} + {CI('op_cash_flow > net_income')} + {CI('liabilities / assets < p_liabilities / p_assets')} + {CI('current_assets / current_liabilities > p_current_assets / p_current_liabilities')} + {CI('shares / p_shares > 1.5 OR shares / p_shares <= 1.02')}
    + {CI('gross_profit / revenue > p_gross_profit / p_revenue')} + {CI('revenue / assets > p_revenue / p_assets')} AS f_score, gross_profit / assets AS gross_profitability, revenue / p_revenue - 1 AS rev_growth, (net_income - op_cash_flow) / assets AS accruals, liabilities / assets - p_liabilities / p_assets AS leverage_delta, gross_profit / revenue - p_gross_profit / p_revenue AS margin_delta FROM ap)"""
pa = lambda s, d: X.piotroski_annual(annual(s, d))
reg("piotroski_annual", "cik:i fy:i f_score:i gross_profitability rev_growth", "quarters", "SELECT * FROM pa", pa, PA)
reg("accruals_debt_margin", "cik:i fy:i accruals leverage_delta margin_delta", "quarters", "SELECT * FROM pa", pa, PA)
reg("growth_composite", "cik:i fy:i composite", "quarters", "SELECT cik, fy, f_score / 9 * 40 + least(gross_profitability, 1) * 30 + CASE WHEN rev_growth > pg THEN 30 WHEN rev_growth > 0.15 THEN 15 ELSE 0 END AS composite FROM (SELECT *, lag(rev_growth) OVER (PARTITION BY cik ORDER BY fy) AS pg FROM pa)",
    lambda s, d: pa(s, d).withColumn("pg", F.lag("rev_growth").over(Window.partitionBy("cik").orderBy("fy"))).select("cik", "fy", (c("f_score") / 9 * 40 + F.least(c("gross_profitability"), F.lit(1.0)) * 30 + F.when(c("rev_growth") > c("pg"), 30).when(c("rev_growth") > 0.15, 15).otherwise(0)).alias("composite")), PA)
MB = "CASE WHEN rev_growth IS NOT NULL AND p_revenue >= 2500000 THEN greatest(least(greatest(rev_growth, 0), 2) * 50 + f_score / 9 * 15 + CASE WHEN margin_delta > 0 THEN 8 ELSE 0 END + CASE WHEN accruals < 0 THEN 6 ELSE 0 END - CASE WHEN leverage_delta > 0.05 THEN 8 ELSE 0 END, 0) END"


def multibagger(s, d):
    """Score of each company year and its place inside the fiscal year's tier; years hold one row per company."""
    z = lambda k, v: F.when(k, v).otherwise(0)
    sc = F.when(c("rev_growth").isNotNull() & (c("p_revenue") >= 2500000), F.greatest(F.least(F.greatest(c("rev_growth"), F.lit(0.0)), F.lit(2.0)) * 50 + c("f_score") / 9 * 15 + z(c("margin_delta") > 0, 8) + z(c("accruals") < 0, 6) - z(c("leverage_delta") > 0.05, 8), F.lit(0.0)))
    x = pa(s, d).withColumn("score", sc).where("score is not null")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("fy").orderBy(c("score").desc(), "cik"))).where("rank <= 100")


reg("multibagger_rank", "cik:i fy:i score rank:i", "quarters", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fy ORDER BY score DESC, cik) AS rank FROM (SELECT *, {MB} AS score FROM pa) WHERE score IS NOT NULL) WHERE rank <= 100", multibagger, PA)
CASEV = lambda m, tg: f"""(SELECT ((list_sum(pv) + f7 * (1 + t) / (0.09 - t) / pow(1.09, 7)) - nd) / sh FROM (SELECT t, [{', '.join('fcf' + ''.join(f' * (1 + t + (g - t) * pow(0.7, {k}))' for k in range(y)) + f' / pow(1.09, {y})' for y in range(1, 8))}] AS pv, fcf{''.join(f' * (1 + t + (g - t) * pow(0.7, {k}))' for k in range(7))} AS f7 FROM (SELECT least({tg}, 0.09 - 0.03) AS t, least(gr * {m}, 0.20) AS g)))"""
fb("dcf_table", "base:3 bull:3 bear:3 weighted:3 epv:3 graham:3 residual_income:3", f"""SELECT *, 0.25 * bull + 0.5 * base + 0.25 * bear AS weighted FROM (SELECT ticker, period_end, {CASEV(1.0, 0.025)} AS base, {CASEV(1.3, 0.03)} AS bull, {CASEV(0.5, 0.02)} AS bear, (ttm_operating_income * 0.79 / 0.09 - nd) / sh AS epv, CASE WHEN eps > 0 AND bv > 0 THEN sqrt(22.5 * eps * bv) END AS graham,
    CASE WHEN bv > 0 THEN bv + list_sum(list_transform(range(1, 11), lambda y: (eps / bv - 0.09) * bv * pow(1 + eps / bv * 0.6, y - 1) / pow(1.09, y))) END AS residual_income FROM (SELECT *, ttm_op_cash_flow - abs(ttm_capex) AS fcf, debt - cash AS nd, shares AS sh, ttm_net_income / shares AS eps, equity / shares AS bv, coalesce(ttm_revenue / ttmp_revenue - 1, 0.05) AS gr FROM fb WHERE q >= 8 AND shares > 0) WHERE fcf > 0)""", X.dcf_table)


def quarter_price(s, d):
    pts = V.quarters(s, d).select("ticker", c("period_end").alias("x"))
    return J.asof_join(pts, V.bars(s, d).select("ticker", "d", "c"), "ticker", "x", "d", ["c"]).select("ticker", c("x").alias("period_end"), c("c").alias("price"))


QP = "qp AS (SELECT q.ticker, q.period_end, b.c AS price FROM quarters q ASOF LEFT JOIN bars b ON b.ticker = q.ticker AND q.period_end >= b.d)"
GRID = """vx AS (SELECT fb.*, price, ttm_op_cash_flow - abs(ttm_capex) AS fcf, debt - cash AS nd, shares AS sh, coalesce(ttm_revenue / ttmp_revenue - 1, 0.05) AS gr FROM fb JOIN qp USING (ticker, period_end) WHERE q >= 8 AND shares > 0 AND price IS NOT NULL),
sc AS (SELECT ticker, period_end, fcf, nd, sh, price, ww, least(tt, ww - 0.03) AS t, least(gr, 0.20) AS g FROM vx, (SELECT 0.09 + unnest([-0.02, -0.01, 0.0, 0.01, 0.02]) AS ww), (SELECT 0.025 + unnest([-0.01, -0.005, 0.0, 0.005, 0.01]) AS tt)),
yr AS (SELECT *, list_transform(range(1, 8), lambda y: list_aggregate(list_transform(range(0, y), lambda k: 1 + t + (g - t) * pow(0.7, k)), 'product')) AS f FROM sc),
hit AS (SELECT ticker, period_end, count(*) FILTER ((list_sum(list_transform(range(1, 8), lambda y: fcf * f[y] / pow(1 + ww, y))) + fcf * f[7] * (1 + t) / (ww - t) / pow(1 + ww, 7) - nd) / sh >= price) / 25 AS share_above FROM yr WHERE fcf > 0 GROUP BY 1, 2)"""
reg("valuation_extras", "ticker period_end:s share_above ddm:3 nav:3 liquidation:3 ev_sales:4", "quarters bars", """SELECT vx.ticker, vx.period_end, share_above, CASE WHEN ttm_dividends / sh > 0 THEN ttm_dividends / sh * (1 + least(gr, 0.07)) / (0.09 - least(gr, 0.07)) END AS ddm, (assets - liabilities) / sh AS nav, (assets * 0.6 - liabilities) / sh AS liquidation,
    (price * sh + nd) / ttm_revenue AS ev_sales FROM vx LEFT JOIN hit USING (ticker, period_end)""", lambda s, d: X.dcf_grid(base(s, d), quarter_price(s, d).where("price is not null")), FB + ", " + QP + ", " + GRID)


def pit(s, d, as_of="1999-09-30"):
    """Newest filed value per period as of a date, trailing sums of the last four periods, growth by the fifth."""
    f = FL.pit_as_of(V.facts(s, d), as_of).where("fp <> 'FY'")
    last = f.groupBy("cik", "metric", "end").agg(F.max_by("val", "filed").alias("val"))
    w = Window.partitionBy("cik", "metric").orderBy(c("end").desc())
    x = last.withColumn("k", F.row_number().over(w)).where("k <= 5")
    g = x.groupBy("cik", "metric").agg(F.sum(F.when(c("k") <= 4, c("val"))).alias("s"), F.count(F.lit(1)).alias("n"), F.max(F.when(c("k") == 1, c("val"))).alias("v1"), F.max(F.when(c("k") == 5, c("val"))).alias("v5"))
    m = lambda k, e: F.max(F.when(c("metric") == k, e))
    t = F.when(c("n") >= 4, c("s")).otherwise(c("v1"))
    p = g.groupBy("cik").agg(m("revenue", t).alias("rev"), m("net_income", t).alias("ni"), m("gross_profit", t).alias("gp"), m("op_cash_flow", t).alias("ocf"), m("assets", c("v1")).alias("a"), m("liabilities", c("v1")).alias("l"), m("revenue", c("v1") / c("v5") - 1).alias("growth"), m("shares", c("v1")).alias("sh"))
    e = c("a") - c("l")
    return p.select("cik", sdiv("ni", "rev").alias("net_margin"), sdiv("gp", "rev").alias("gross_margin"), sdiv("ocf", "rev").alias("ocf_margin"), sdiv("ni", "a").alias("roa"), F.when(e > 0, c("ni") / e).alias("roe"), F.when(e > 0, c("l") / e).alias("debt_to_equity"), sdiv("rev", "a").alias("asset_turnover"), "growth")


PIT = """lf AS (SELECT cik, metric, "end", arg_max(val, filed) AS val FROM facts WHERE fp <> 'FY' AND filed <= DATE '1999-09-30' GROUP BY 1, 2, 3), lk AS (SELECT *, row_number() OVER (PARTITION BY cik, metric ORDER BY "end" DESC) AS k FROM lf),
lg AS (SELECT cik, metric, CASE WHEN count(*) FILTER (k <= 5) >= 4 THEN sum(val) FILTER (k <= 4) ELSE max(val) FILTER (k = 1) END AS t, max(val) FILTER (k = 1) AS v1, max(val) FILTER (k = 5) AS v5 FROM lk GROUP BY 1, 2),
lp AS (SELECT cik, max(t) FILTER (metric = 'revenue') AS rev, max(t) FILTER (metric = 'net_income') AS ni, max(t) FILTER (metric = 'gross_profit') AS gp, max(t) FILTER (metric = 'op_cash_flow') AS ocf, max(v1) FILTER (metric = 'assets') AS a, max(v1) FILTER (metric = 'liabilities') AS l, max(v1 / v5 - 1) FILTER (metric = 'revenue') AS growth FROM lg GROUP BY 1)"""
PITQ = "SELECT cik, ni / rev AS net_margin, gp / rev AS gross_margin, ocf / rev AS ocf_margin, ni / a AS roa, CASE WHEN a - l > 0 THEN ni / (a - l) END AS roe, CASE WHEN a - l > 0 THEN l / (a - l) END AS debt_to_equity, rev / a AS asset_turnover, growth FROM lp"
reg("pit_fundamentals", "cik:i net_margin gross_margin ocf_margin roa roe debt_to_equity asset_turnover growth", "facts", PITQ, pit, PIT)
reg("fundamentals_hook", "ticker d roe growth", "facts bars", f"SELECT b.ticker, b.d, f.roe, f.growth FROM bars b JOIN ({PITQ}) f ON f.cik = b.ticker WHERE b.d BETWEEN DATE '1999-09-30' AND DATE '1999-12-31'",
    lambda s, d: V.bars(s, d).where("d between date'1999-09-30' and date'1999-12-31'").select("ticker", "d").join(pit(s, d).withColumnRenamed("cik", "ticker"), "ticker"), PIT)


def peer_fund(s, d):
    u = V.universe(s, d).select("ticker", "bucket", "market_cap")
    w = Window.partitionBy("cik").orderBy(c("fy").desc())
    a = pa(s, d).withColumn("k", F.row_number().over(w)).where("k = 1").withColumnRenamed("cik", "ticker").join(u, "ticker")
    e = c("assets") - c("liabilities")
    return a.select("ticker", "bucket", "market_cap", "revenue", sdiv("gross_profit", "revenue").alias("gross_margin"), sdiv("net_income", "revenue").alias("net_margin"), sdiv("op_cash_flow", "revenue").alias("ocf_margin"), sdiv("net_income", "assets").alias("roa"), F.when(e != 0, c("net_income") / e).alias("roe"), sdiv("net_income", "assets").alias("roic"),
                    c("rev_growth").alias("growth"), F.when(c("net_income") > 0, c("market_cap") / c("net_income")).alias("pe"), sdiv("market_cap", "revenue").alias("ps"), F.when(e > 0, c("market_cap") / e).alias("pb"), sdiv("revenue", "assets").alias("asset_turnover"), sdiv("current_assets", "current_liabilities").alias("current_ratio"))


PFU = PA + """, pe AS (SELECT ticker, bucket, market_cap, revenue, gross_profit / revenue AS gross_margin, net_income / revenue AS net_margin, op_cash_flow / revenue AS ocf_margin, net_income / assets AS roa, net_income / nullif(assets - liabilities, 0) AS roe, net_income / assets AS roic, rev_growth AS growth, CASE WHEN net_income > 0 THEN market_cap / net_income END AS pe, market_cap / revenue AS ps,
    CASE WHEN assets - liabilities > 0 THEN market_cap / (assets - liabilities) END AS pb, revenue / assets AS asset_turnover, current_assets / current_liabilities AS current_ratio FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY fy DESC) AS k FROM pa) x JOIN universe u ON u.ticker = x.cik WHERE k = 1)"""
reg("peer_fundamentals", "ticker bucket:s gross_margin net_margin ocf_margin roa roe growth pe:4 ps pb asset_turnover current_ratio", "quarters universe", "SELECT * FROM pe", peer_fund, PFU)
SL = lambda x, n: f"CASE WHEN count({x}) OVER (w ROWS {n - 1} PRECEDING) >= 3 THEN regr_slope({x}, CAST(q AS DOUBLE)) OVER (w ROWS {n - 1} PRECEDING) END"
STB = lambda x, n: f"CASE WHEN count({x}) OVER (w ROWS {n - 1} PRECEDING) >= 3 AND avg({x}) OVER (w ROWS {n - 1} PRECEDING) <> 0 THEN greatest(0.0, 1 - stddev_pop({x}) OVER (w ROWS {n - 1} PRECEDING) / abs(avg({x}) OVER (w ROWS {n - 1} PRECEDING))) END"
WQ = "WINDOW w AS (PARTITION BY ticker ORDER BY period_end)"


def financial(b):
    """Margins, stability, growth, returns, cash quality and working-capital days. Free cash flow is differenced per quarter and then summed."""
    w = Window.partitionBy("ticker").orderBy("period_end")
    b = b.withColumn("_f", c("op_cash_flow") - F.abs("capex")).withColumn("_gm", c("gross_profit") / c("revenue")).withColumn("_om", c("operating_income") / c("revenue"))
    b = b.withColumn("fcf", F.when(c("q") >= 4, F.sum("_f").over(w.rowsBetween(-3, 0))))
    prev = F.lag("ttm_revenue").over(w)
    dso, dio = c("receivables") / c("ttm_revenue") * 365, c("inventory") / c("ttm_cost_of_revenue") * 365
    return b.select("ticker", "period_end", sdiv("ttm_gross_profit", "ttm_revenue").alias("gross_margin"), sdiv("ttm_operating_income", "ttm_revenue").alias("operating_margin"), sdiv("ttm_net_income", "ttm_revenue").alias("net_margin"), sdiv(c("ttm_operating_income") + c("ttm_depreciation"), "ttm_revenue").alias("ebitda_margin"),
                    sdiv("fcf", "ttm_revenue").alias("fcf_margin"), X.stability(c("_gm"), 8).alias("gm_stability"), X.slope(c("_om"), 8).alias("om_trend"), ((c("ttm_revenue") - prev) / F.abs(prev)).alias("revenue_growth"), (F.pow(c("ttm_revenue") / F.lag("ttm_revenue", 3).over(w), 1 / 3) - 1).alias("cagr_3"),
                    sdiv("fcf", "ttm_net_income").alias("fcf_conversion"), sdiv("ttm_op_cash_flow", "ttm_net_income").alias("earnings_quality"), dso.alias("dso"), dio.alias("dio"), (dso + dio).alias("cash_cycle"), sdiv("cash", "current_liabilities").alias("cash_ratio"), sdiv("debt", c("ttm_operating_income") + c("ttm_depreciation")).alias("debt_to_ebitda"),
                    ((c("ttm_net_income") - c("ttm_op_cash_flow")) / c("assets")).alias("accruals"))


fb("financial_features", "gross_margin operating_margin net_margin ebitda_margin fcf_margin gm_stability om_trend revenue_growth cagr_3 fcf_conversion:4 earnings_quality:4 dso:4 dio:4 cash_cycle:4 cash_ratio debt_to_ebitda:4 accruals", f"""SELECT *, dso + dio AS cash_cycle FROM (SELECT ticker, period_end, ttm_gross_profit / ttm_revenue AS gross_margin, ttm_operating_income / ttm_revenue AS operating_margin, ttm_net_income / ttm_revenue AS net_margin, (ttm_operating_income + ttm_depreciation) / ttm_revenue AS ebitda_margin, fcf / ttm_revenue AS fcf_margin,
    {STB('gm', 8)} AS gm_stability, {SL('om', 8)} AS om_trend, (ttm_revenue - lag(ttm_revenue) OVER w) / abs(lag(ttm_revenue) OVER w) AS revenue_growth, pow(ttm_revenue / lag(ttm_revenue, 3) OVER w, 1 / 3) - 1 AS cagr_3, fcf / nullif(ttm_net_income, 0) AS fcf_conversion, ttm_op_cash_flow / nullif(ttm_net_income, 0) AS earnings_quality,
    receivables / ttm_revenue * 365 AS dso, inventory / ttm_cost_of_revenue * 365 AS dio, cash / current_liabilities AS cash_ratio, debt / nullif(ttm_operating_income + ttm_depreciation, 0) AS debt_to_ebitda, (ttm_net_income - ttm_op_cash_flow) / assets AS accruals FROM
    (SELECT *, gross_profit / revenue AS gm, operating_income / revenue AS om, CASE WHEN q >= 4 THEN sum(op_cash_flow - abs(capex)) OVER (w ROWS 3 PRECEDING) END AS fcf FROM fb {WQ}) {WQ})""", financial)
fb("base_quality_features", "gross_margin operating_margin net_margin accruals", """SELECT ticker, period_end, ttm_gross_profit / ttm_revenue AS gross_margin, ttm_operating_income / ttm_revenue AS operating_margin, ttm_net_income / ttm_revenue AS net_margin, (ttm_net_income - ttm_op_cash_flow) / assets AS accruals FROM fb""", financial)


def business(b):
    """Returns on capital against their cost over sixteen trailing sums, margin resilience, predictability, incremental margins."""
    w = Window.partitionBy("ticker").orderBy("period_end")
    ic = c("equity") + c("debt")
    b = b.withColumn("_r", F.when(ic > 0, c("ttm_operating_income") * 0.79 / ic)).withColumn("_g", c("ttm_gross_profit") / c("ttm_revenue"))
    w16 = X.back(16)
    ob = F.lag("ttm_operating_income", 4).over(w)
    return b.where("q >= 4").select("ticker", "period_end", F.avg("_r").over(w16).alias("roic_avg"), X.slope(c("_r"), 16).alias("roic_trend"), (F.sum((c("_r") > 0.09).cast("int")).over(w16) / 4).alias("spread_years"), X.stability(c("_r"), 16).alias("return_consistency"), ((c("_r") - 0.09) * ic).alias("economic_profit"),
                                    (F.min("_g").over(w16) / F.avg("_g").over(w16)).alias("margin_resilience"), F.when(F.count("ttm_revenue").over(w16) >= 8, F.regr_r2("ttm_revenue", c("q").cast("double")).over(w16)).alias("predictability"),
                                    sdiv(c("ttm_operating_income") - ob, c("ttm_revenue") - F.lag("ttm_revenue", 4).over(w)).alias("incremental_margin"), sdiv("ttm_revenue", "assets").alias("capital_turnover"))


fb("business_features", "roic_avg roic_trend spread_years return_consistency economic_profit:2 margin_resilience:4 predictability incremental_margin:4 capital_turnover", f"""SELECT ticker, period_end, avg(r) OVER w16 AS roic_avg, {SL('r', 16)} AS roic_trend, count(*) FILTER (r > 0.09) OVER w16 / 4 AS spread_years, {STB('r', 16)} AS return_consistency, (r - 0.09) * (equity + debt) AS economic_profit, min(g) OVER w16 / avg(g) OVER w16 AS margin_resilience,
    CASE WHEN count(ttm_revenue) OVER w16 >= 8 THEN regr_r2(ttm_revenue, CAST(q AS DOUBLE)) OVER w16 END AS predictability, (ttm_operating_income - lag(ttm_operating_income, 4) OVER w) / nullif(ttm_revenue - lag(ttm_revenue, 4) OVER w, 0) AS incremental_margin, ttm_revenue / assets AS capital_turnover FROM
    (SELECT *, CASE WHEN equity + debt > 0 THEN ttm_operating_income * 0.79 / (equity + debt) END AS r, ttm_gross_profit / ttm_revenue AS g FROM fb WHERE q >= 4) WINDOW w AS (PARTITION BY ticker ORDER BY period_end), w16 AS (PARTITION BY ticker ORDER BY period_end ROWS 15 PRECEDING)""", business)


def forecast(b):
    """Growth acceleration, two-year stacked growth, operating leverage inside sane bounds, rule of forty, return on new capital."""
    w = Window.partitionBy("ticker").orderBy("period_end")
    lag = lambda k, n: F.lag(k, n).over(w)
    g = c("revenue") / lag("revenue", 1) - 1
    b = b.withColumn("_g", g).withColumn("_yoy", c("revenue") / c("y_revenue") - 1).withColumn("_om", c("operating_income") / c("revenue"))
    dr, do = c("revenue") - lag("revenue", 3), c("operating_income") - lag("operating_income", 3)
    im = F.when(F.abs(dr) > 0.02 * F.abs("revenue"), do / dr)
    icn, ico = c("equity") + c("debt"), lag("equity", 3) + lag("debt", 3)
    ro = F.when(F.abs(icn - ico) > 0.03 * F.abs(icn), do * 0.79 / (icn - ico))
    rec = (c("_g") + lag("_g", 1)) / 2
    return b.where("q is not null").select("ticker", "period_end", rec.alias("growth_recent"), (rec - (lag("_g", 10) + lag("_g", 9)) / 2).alias("revenue_accel"), c("_yoy").alias("yoy"), (c("_yoy") - lag("_yoy", 1)).alias("yoy_accel"), (c("_yoy") + lag("_yoy", 4)).alias("two_year_stack"),
                                           F.when(im.between(-1.5, 3.0), im).alias("incremental_op_margin"), X.slope(c("_om"), 8).alias("op_margin_trajectory"), ((c("ttm_revenue") / lag("ttm_revenue", 1) - 1) + c("_om")).alias("rule_of_40"), F.when(ro.between(-0.5, 0.6), ro).alias("roiic"))


fb("forecast_features", "growth_recent revenue_accel yoy yoy_accel two_year_stack incremental_op_margin op_margin_trajectory rule_of_40 roiic", f"""SELECT ticker, period_end, (g + lag(g) OVER w) / 2 AS growth_recent, (g + lag(g) OVER w) / 2 - (lag(g, 10) OVER w + lag(g, 9) OVER w) / 2 AS revenue_accel, yo AS yoy, yo - lag(yo) OVER w AS yoy_accel, yo + lag(yo, 4) OVER w AS two_year_stack,
    CASE WHEN abs(dr) > 0.02 * abs(revenue) AND do_ / dr BETWEEN -1.5 AND 3.0 THEN do_ / dr END AS incremental_op_margin, {SL('om', 8)} AS op_margin_trajectory, ttm_revenue / lag(ttm_revenue) OVER w - 1 + om AS rule_of_40, CASE WHEN abs(ci) > 0.03 * abs(equity + debt) AND do_ * 0.79 / ci BETWEEN -0.5 AND 0.6 THEN do_ * 0.79 / ci END AS roiic FROM
    (SELECT *, revenue / lag(revenue) OVER w - 1 AS g, revenue / y_revenue - 1 AS yo, operating_income / revenue AS om, revenue - lag(revenue, 3) OVER w AS dr, operating_income - lag(operating_income, 3) OVER w AS do_, equity + debt - (lag(equity, 3) OVER w + lag(debt, 3) OVER w) AS ci FROM fb {WQ}) {WQ}""", forecast)


def management(b):
    """Payouts (a missing payout is zero when capital spending is reported), reinvestment, dividend record and margin drift."""
    w8 = X.back(8)
    fcf = c("ttm_op_cash_flow") - c("ttm_capex")
    pay = F.coalesce(c("ttm_dividends"), F.lit(0.0)) + F.coalesce(c("ttm_buybacks"), F.lit(0.0))
    w = Window.partitionBy("ticker").orderBy("period_end")
    b = b.withColumn("_om", c("operating_income") / c("revenue"))
    m3 = lambda a, z: F.avg("_om").over(w.rowsBetween(a, z))
    return b.where("q >= 4").select("ticker", "period_end", sdiv(fcf, "ttm_revenue").alias("fcf_generation"), sdiv("ttm_capex", "ttm_op_cash_flow").alias("reinvestment_rate"), F.when(fcf > 0, pay / fcf).alias("payout_ratio"), F.avg((c("dividends") > 0).cast("double")).over(w8).alias("dividend_consistency"),
                                    F.when(F.count("_om").over(w8) >= 8, m3(-2, 0) - m3(-7, -5)).alias("margin_trend"))


fb("management_features", "fcf_generation reinvestment_rate:4 payout_ratio:4 dividend_consistency margin_trend", """SELECT ticker, period_end, (ttm_op_cash_flow - ttm_capex) / ttm_revenue AS fcf_generation, ttm_capex / nullif(ttm_op_cash_flow, 0) AS reinvestment_rate, CASE WHEN ttm_op_cash_flow - ttm_capex > 0 THEN (coalesce(ttm_dividends, 0) + coalesce(ttm_buybacks, 0)) / (ttm_op_cash_flow - ttm_capex) END AS payout_ratio,
    avg(CASE WHEN dividends > 0 THEN 1.0 ELSE 0 END) OVER (w ROWS 7 PRECEDING) AS dividend_consistency, CASE WHEN count(om) OVER (w ROWS 7 PRECEDING) >= 8 THEN avg(om) OVER (w ROWS 2 PRECEDING) - avg(om) OVER (w ROWS BETWEEN 7 PRECEDING AND 5 PRECEDING) END AS margin_trend FROM (SELECT *, operating_income / revenue AS om FROM fb WHERE q >= 4) WINDOW w AS (PARTITION BY ticker ORDER BY period_end)""", management)


def ownership(b):
    """Share-count drift (medians of three, moves of 40 % and more are splits), its steadiness, buyback intensity."""
    w = Window.partitionBy("ticker").orderBy("period_end")
    med = lambda a: F.array_sort(F.array(*[F.lag("shares", k).over(w) if k else c("shares") for k in a]))[1]
    chg = F.when(c("q") >= 8, med((0, 1, 2)) / med((5, 6, 7)) - 1)
    b = b.withColumn("_ch", c("shares") / F.lag("shares").over(w) - 1)
    return b.select("ticker", "period_end", F.when(F.abs(chg) < 0.4, chg).alias("share_count_trend"), F.when(c("q") >= 8, 1 - F.least(F.lit(1.0), F.stddev_pop("_ch").over(w.rowsBetween(-6, 0)) * 20)).alias("share_count_stability"), sdiv("buybacks", c("equity")).alias("buyback_intensity"))


fb("ownership_features", "share_count_trend share_count_stability buyback_intensity", """SELECT ticker, period_end, CASE WHEN q >= 8 AND abs(mdn / mdo - 1) < 0.4 THEN mdn / mdo - 1 END AS share_count_trend, CASE WHEN q >= 8 THEN 1 - least(1.0, stddev_pop(ch) OVER (w ROWS 6 PRECEDING) * 20) END AS share_count_stability, buybacks / nullif(equity, 0) AS buyback_intensity FROM
    (SELECT *, list_sort([shares, lag(shares) OVER w, lag(shares, 2) OVER w])[2] AS mdn, list_sort([lag(shares, 5) OVER w, lag(shares, 6) OVER w, lag(shares, 7) OVER w])[2] AS mdo, shares / lag(shares) OVER w - 1 AS ch FROM fb WINDOW w AS (PARTITION BY ticker ORDER BY period_end)) WINDOW w AS (PARTITION BY ticker ORDER BY period_end)""", ownership)


def risk(b):
    """Leverage, liquidity, cash runway and earnings volatility."""
    ebitda = c("ttm_operating_income") + c("ttm_depreciation")
    burn = F.when(c("ttm_op_cash_flow") < 0, -c("ttm_op_cash_flow") / 4)
    opex = c("ttm_revenue") - c("ttm_operating_income")
    w8 = X.back(8)
    return b.where("q >= 4").select("ticker", "period_end", sdiv("debt", "assets").alias("debt_to_assets"), sdiv(c("debt") - c("cash"), ebitda).alias("net_debt_to_ebitda"), (c("debt") / c("assets") - c("y_debt") / c("y_assets")).alias("leverage_trend"), sdiv(c("current_assets") - c("inventory"), "current_liabilities").alias("quick_ratio"),
                                    (c("cash") / burn).alias("cash_runway_qtrs"), F.when(opex > 0, c("current_assets") / (opex / 365)).alias("defensive_days"), F.abs(F.stddev_pop("net_income").over(w8) / F.avg("net_income").over(w8)).alias("earnings_volatility"))


fb("risk_features", "debt_to_assets net_debt_to_ebitda:4 leverage_trend quick_ratio cash_runway_qtrs:4 defensive_days:4 earnings_volatility:3", """SELECT ticker, period_end, debt / assets AS debt_to_assets, (debt - cash) / nullif(ttm_operating_income + ttm_depreciation, 0) AS net_debt_to_ebitda, debt / assets - y_debt / y_assets AS leverage_trend, (current_assets - inventory) / current_liabilities AS quick_ratio, CASE WHEN ttm_op_cash_flow < 0 THEN cash / (-ttm_op_cash_flow / 4) END AS cash_runway_qtrs,
    CASE WHEN ttm_revenue - ttm_operating_income > 0 THEN current_assets / ((ttm_revenue - ttm_operating_income) / 365) END AS defensive_days, abs(stddev_pop(net_income) OVER w8 / avg(net_income) OVER w8) AS earnings_volatility FROM fb WHERE q >= 4 WINDOW w8 AS (PARTITION BY ticker ORDER BY period_end ROWS 7 PRECEDING)""", risk)
fb("qmj_value_factors", "profitability growth safety payout qmj", """SELECT *, tanh((profitability + growth + safety + payout) / 4) AS qmj FROM (SELECT ticker, period_end, (net_income / equity + net_income / assets + gross_profit / revenue) / 3 AS profitability, (net_income / nullif(y_net_income, 0) - 1 + revenue / y_revenue - 1) / 2 AS growth, -0.5 * liabilities / equity - 0.5 AS safety, (ttm_dividends / assets + (ttm_op_cash_flow - ttm_capex) / assets) / 2 AS payout FROM fb WHERE q >= 5 AND equity > 0)""",
    lambda b: b.where("q >= 5 and equity > 0").select("ticker", "period_end", ((c("net_income") / c("equity") + c("net_income") / c("assets") + c("gross_profit") / c("revenue")) / 3).alias("profitability"), ((sdiv("net_income", "y_net_income") - 1 + c("revenue") / c("y_revenue") - 1) / 2).alias("growth"), (-0.5 * c("liabilities") / c("equity") - 0.5).alias("safety"),
                                                        ((c("ttm_dividends") / c("assets") + (c("ttm_op_cash_flow") - c("ttm_capex")) / c("assets")) / 2).alias("payout")).withColumn("qmj", F.tanh((c("profitability") + c("growth") + c("safety") + c("payout")) / 4)))


def own_history(s, d):
    """Price to trailing sales of each filing at its first close after it was known, its percentile in the company's own past."""
    t = WN.ttm(qrev(s, d)).withColumnRenamed("cik", "ticker").withColumnRenamed("knowable", "x")
    px = J.close_on_or_after(V.bars(s, d), t.select("ticker", "x").distinct())
    sh = S.instant_series(V.facts(s, d), "shares").select(c("cik").alias("ticker"), "filed", "end", "val")
    j = J.asof_join(t.join(px, ["ticker", "x"]), sh.select("ticker", "filed", F.struct("end", "val").alias("sv")), "ticker", "x", "filed", ["sv"])
    j = j.withColumn("ps", c("c") * c("sv.val") / c("ttm")).where("ps is not null")
    w = Window.partitionBy("ticker").orderBy("end").rowsBetween(-20, -1)
    j = j.withColumn("h", F.collect_list("ps").over(w))
    n = F.size("h")
    srt = F.array_sort("h")
    med = (F.try_element_at(srt, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(srt, F.floor(n / 2 + 1).cast("int"))) / 2
    return j.where(n >= 5).select("ticker", "end", "ps", med.alias("ps_median"), (c("ps") / med).alias("ps_vs_median"), (100.0 * F.size(F.filter("h", lambda v: v <= c("ps"))) / n).alias("percentile"))


OH = f"""{ERC}, {TTM}, si AS (SELECT cik, "end", arg_min(val, {{'z': CASE WHEN val = 0 THEN 1 ELSE 0 END, 'f': filed, 'v': val}}) AS val, arg_min(filed, {{'z': CASE WHEN val = 0 THEN 1 ELSE 0 END, 'f': filed, 'v': val}}) AS filed FROM facts WHERE metric = 'shares' AND fp <> 'FY' GROUP BY 1, 2),
sf AS (SELECT cik, filed, max({{'e': "end", 'v': val}}) AS sv FROM si GROUP BY 1, 2), pxx AS (SELECT tt.cik, tt.knowable, arg_min(b.c, b.d) AS px FROM (SELECT DISTINCT cik, knowable FROM tt) tt JOIN bars b ON b.ticker = tt.cik AND b.d BETWEEN tt.knowable AND tt.knowable + 10 GROUP BY 1, 2),
hp AS (SELECT * FROM (SELECT t.cik AS ticker, t."end", px * sf.sv.v / t.ttm AS ps FROM tt t JOIN pxx ON pxx.cik = t.cik AND pxx.knowable = t.knowable ASOF LEFT JOIN sf ON sf.cik = t.cik AND t.knowable >= sf.filed) WHERE ps IS NOT NULL)"""
reg("valuation_own_history", "ticker end:s ps:5 ps_median:5 ps_vs_median:5 percentile:4", "facts bars", """SELECT ticker, "end", ps, list_aggregate(h, 'median') AS ps_median, ps / list_aggregate(h, 'median') AS ps_vs_median, 100.0 * len(list_filter(h, lambda v: v <= ps)) / len(h) AS percentile FROM (SELECT *, list(ps) OVER (PARTITION BY ticker ORDER BY "end" ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h FROM hp) WHERE len(h) >= 5""", own_history, OH)
reg("recovery_progress", "ticker d progress reached:i upside", "bars", """SELECT ticker, d, CASE WHEN hi > en THEN least(greatest((c - en) / (hi - en), 0.0), 1.0) * 100 END AS progress, c >= hi AS reached, hi / c - 1 AS upside FROM (SELECT ticker, d, c, lag(c, 63) OVER w AS en, max(c) OVER (w ROWS BETWEEN 315 PRECEDING AND 64 PRECEDING) AS hi FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)) WHERE en IS NOT NULL AND hi IS NOT NULL""",
    lambda s, d: (lambda w: V.bars(s, d).select("ticker", "d", "c", F.lag("c", 63).over(w).alias("en"), F.max("c").over(w.rowsBetween(-315, -64)).alias("hi")).where("en is not null and hi is not null").select("ticker", "d", F.when(c("hi") > c("en"), clip((c("c") - c("en")) / (c("hi") - c("en")), 0, 1) * 100).alias("progress"), (c("c") >= c("hi")).alias("reached"), (c("hi") / c("c") - 1).alias("upside")))(Window.partitionBy("ticker").orderBy("d")))
reg("quarterly_growth_accel", "cik:i growth accelerating:i", "facts", """SELECT cik, max(g) FILTER (k = 1) AS growth, max(g) FILTER (k = 1) > max(g) FILTER (k = 2) AS accelerating FROM (SELECT a.cik, a.val / m.b.v - 1 AS g, row_number() OVER (PARTITION BY a.cik ORDER BY a."end" DESC) AS k FROM er a JOIN (SELECT a.cik, a."end", min({'g': abs(a."end" - 365 - b."end"), 'e': b."end", 'v': b.val}) AS b FROM er a JOIN er b ON a.cik = b.cik AND b."end" < a."end"
    AND abs(a."end" - 365 - b."end") <= 45 GROUP BY 1, 2) m ON m.cik = a.cik AND m."end" = a."end") WHERE k <= 2 GROUP BY 1""",
    lambda s, d: J.year_ago(qrev(s, d), "cik", "end", "val").where("prior is not null").withColumn("g", c("val") / c("prior") - 1).withColumn("k", F.row_number().over(Window.partitionBy("cik").orderBy(c("end").desc()))).where("k <= 2").groupBy("cik").agg(F.max(F.when(c("k") == 1, c("g"))).alias("growth"), F.max(F.when(c("k") == 2, c("g"))).alias("g2")).withColumn("accelerating", c("growth") > c("g2")), ERC)
reg("quarterly_gross_profit", "cik:i end:s val:2 filed:s", "facts", f"""SELECT cik, "end", val, filed FROM gpf UNION ALL SELECT r.cik, r."end", r.val - k.val, greatest(r.filed, k.filed) FROM er r JOIN cst k ON k.cik = r.cik AND k."end" = r."end" WHERE r.cik NOT IN (SELECT cik FROM gpf)""",
    lambda s, d: gross_profit(s, d), f"{ERC}, cst AS ({QREV.replace(chr(39) + 'revenue' + chr(39), chr(39) + 'cost_of_revenue' + chr(39))}), gpf AS ({QREV.replace(chr(39) + 'revenue' + chr(39), chr(39) + 'gross_profit' + chr(39) + ' AND cik % 3 <> 0')})")


def gross_profit(s, d):
    """Filed gross profit; companies that file none get revenue less cost, known when both are."""
    f = V.facts(s, d).where("metric <> 'gross_profit' or cik % 3 <> 0")
    gp, rv, co = (S.quarterly_series(f, k) for k in ("gross_profit", "revenue", "cost_of_revenue"))
    syn = rv.join(co.select("cik", "end", c("val").alias("cv"), c("filed").alias("cf")), ["cik", "end"]).join(gp.select("cik").distinct(), "cik", "left_anti")
    return gp.select("cik", "end", "val", "filed").unionByName(syn.select("cik", "end", (c("val") - c("cv")).alias("val"), F.greatest("filed", "cf").alias("filed")))


reg("stock_concept_series", "cik:i end:s val:2", "facts", """SELECT cik, "end", arg_max(val, {'f': filed, 'v': val}) AS val FROM facts WHERE metric = 'assets' AND "end" >= DATE '1996-01-01' GROUP BY 1, 2""",
    lambda s, d: V.facts(s, d).where("metric = 'assets' and end >= date'1996-01-01'").groupBy("cik", "end").agg(F.max_by("val", F.struct("filed", "val")).alias("val")))
HEAL = f"""{ERC}, {GS}, sk AS (SELECT cik, count(*) FILTER (bad = 0) AS streak FROM (SELECT cik, sum(1 - ok) OVER (PARTITION BY cik ORDER BY "end" DESC ROWS UNBOUNDED PRECEDING) AS bad FROM ok) GROUP BY 1), {PA}, lf9 AS (SELECT cik, arg_max(f_score, fy) AS f_score FROM pa GROUP BY 1)"""


def healthy(s, d):
    st = WN.streak(J.year_ago(qrev(s, d), "cik", "end", "val"), "cik", "end", (c("val") / c("prior") - 1 > 0) & (c("prior") >= 500000))
    return st.join(pa(s, d).groupBy("cik").agg(F.max_by("f_score", "fy").alias("f_score")), "cik", "full_outer").withColumn("healthy", (c("streak") >= 2) & (c("f_score") >= 5))


reg("healthy_flag", "cik:i streak:i f_score:i healthy:i", "facts", "SELECT cik, streak, f_score, streak >= 2 AND f_score >= 5 AS healthy FROM sk FULL JOIN lf9 USING (cik)", healthy, HEAL)


def buyback(s, d):
    """Trailing repurchases of every quarter, share of assets, and whether they run through the last year."""
    w = Window.partitionBy("ticker").orderBy("period_end")
    return base(s, d).where("q >= 4").select("ticker", "period_end", c("ttm_buybacks").alias("buyback_ttm"), (c("ttm_buybacks") / c("assets")).alias("to_assets"), ((c("ttm_buybacks") > 0) & (F.max(c("buybacks")).over(w.rowsBetween(-1, 0)) > 0)).alias("active"))


reg("buyback_confirm", "ticker period_end:s buyback_ttm:2 to_assets active:i", "quarters", "SELECT ticker, period_end, ttm_buybacks AS buyback_ttm, ttm_buybacks / assets AS to_assets, ttm_buybacks > 0 AND max(buybacks) OVER (PARTITION BY ticker ORDER BY period_end ROWS 1 PRECEDING) > 0 AS active FROM fb WHERE q >= 4", buyback, FB)


def merged(s, d):
    """Primary quarters overlaid with the nearest filing facts inside 45 days; the primary value stays when none is near."""
    q = shifted_primary(s, d)
    for m in ("revenue", "net_income"):
        f = S.quarterly_series(V.facts(s, d), m).select(c("cik").alias("ticker"), "end", c("val").alias(m + "_f"))
        q = J.nearest_within(q, f, "ticker", "pe", "end", m + "_f").drop("gap_days", "matched").withColumn(m, F.coalesce(c("nearest_" + m + "_f"), c(m))).drop("nearest_" + m + "_f")
    return q.withColumn("fcf", c("op_cash_flow") - F.abs("capex"))


def shifted_primary(s, d):
    return V.quarters(s, d).select("ticker", F.date_add("period_end", (c("ticker") % 60).cast("int")).alias("pe"), (c("revenue") + 1).alias("revenue"), (c("net_income") + 1).alias("net_income"), "op_cash_flow", "capex")


NEAR = lambda m: f"(SELECT p.ticker, p.pe, min({{'g': abs(p.pe - e.\"end\"), 'e': e.\"end\", 'v': e.val}}) AS b FROM p JOIN ({QREV.replace(chr(39) + 'revenue' + chr(39), chr(39) + m + chr(39))}) e ON e.cik = p.ticker AND abs(p.pe - e.\"end\") <= 45 GROUP BY 1, 2)"
reg("quarter_merge", "ticker pe:s revenue:2 net_income:2 fcf:2", "facts", f"SELECT p.ticker, p.pe, coalesce(a.b.v, p.revenue) AS revenue, coalesce(n.b.v, p.net_income) AS net_income, op_cash_flow - abs(capex) AS fcf FROM p LEFT JOIN {NEAR('revenue')} a ON a.ticker = p.ticker AND a.pe = p.pe LEFT JOIN {NEAR('net_income')} n ON n.ticker = p.ticker AND n.pe = p.pe", merged,
    "p AS (SELECT ticker, period_end + CAST(ticker % 60 AS INTEGER) AS pe, revenue + 1 AS revenue, net_income + 1 AS net_income, op_cash_flow, capex FROM quarters)")
