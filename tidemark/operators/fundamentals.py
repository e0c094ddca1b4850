"""Company fundamentals: one row per (ticker, quarter), every value from filings of that quarter and before.

`fund_base` computes all trailing sums and year-ago values in one pass over (ticker, period_end); the scores below are
column expressions over it. A history holds one row per quarter, so windows stay small for any company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import clip, sdiv
from tidemark.functions.scores import good_great_score

FLOWS = ("revenue", "cost_of_revenue", "gross_profit", "operating_income", "net_income", "op_cash_flow", "capex", "depreciation", "rd", "dividends", "buybacks", "interest")
STOCKS = ("assets", "liabilities", "equity", "current_assets", "current_liabilities", "cash", "debt", "shares", "receivables", "ppe")
c = F.col


def fund_base(q: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("period_end")
    w4 = w.rowsBetween(-3, 0)
    x = q.select("*", *[F.when(c("q") >= 4, F.sum(f).over(w4)).alias("ttm_" + f) for f in FLOWS], *[F.lag(s, 4).over(w).alias("y_" + s) for s in STOCKS],
                 *[F.lag(f, 4).over(w).alias("y_" + f) for f in ("revenue", "gross_profit", "net_income")])
    return x.select("*", *[F.lag("ttm_" + f, 4).over(w).alias("ttmp_" + f) for f in ("revenue", "gross_profit", "net_income", "operating_income", "op_cash_flow")])


def back(n: int):
    return Window.partitionBy("ticker").orderBy("period_end").rowsBetween(-(n - 1), 0)


def stability(value: Column, n: int) -> Column:
    """1 - population deviation / |mean| over the last n quarters, not under 0; needs three."""
    w = back(n)
    m = F.avg(value).over(w)
    return F.when((F.count(value).over(w) >= 3) & (m != 0), F.greatest(F.lit(0.0), 1 - F.stddev_pop(value).over(w) / F.abs(m)))


def slope(value: Column, n: int) -> Column:
    w = back(n)
    return F.when(F.count(value).over(w) >= 3, F.regr_slope(value, c("q").cast("double")).over(w))


def invested(x: DataFrame | None = None) -> Column:
    ic = c("equity") + c("debt") - c("cash")
    return F.when(ic > 0, ic)


def quarter_ratios(b: DataFrame) -> DataFrame:
    nopat, pos = c("operating_income") * (1 - 0.21), lambda n: F.when(c(n) > 0, c(n))
    return b.select("ticker", "period_end", nopat.alias("nopat"), invested().alias("invested_capital"), (c("op_cash_flow") - F.abs("capex")).alias("fcf"), sdiv("gross_profit", "revenue").alias("gross_margin"),
                    sdiv("operating_income", "revenue").alias("operating_margin"), sdiv("net_income", "revenue").alias("net_margin"), sdiv("current_assets", "current_liabilities").alias("current_ratio"),
                    (c("debt") / pos("equity")).alias("debt_to_equity"), (nopat / invested()).alias("roic"), (c("net_income") / pos("equity")).alias("roe"), (c("net_income") / pos("assets")).alias("roa"))


def piotroski_ttm(b: DataFrame) -> DataFrame:
    """Eight trailing-year checks, six checks, and nine checks on average assets."""
    n = lambda k: F.coalesce(k, F.lit(False)).cast("int")
    roa, roap = c("ttm_net_income") / c("assets"), c("ttmp_net_income") / c("y_assets")
    gm, gmp = c("ttm_gross_profit") / c("ttm_revenue"), c("ttmp_gross_profit") / c("ttmp_revenue")
    at, atp = c("ttm_revenue") / c("assets"), c("ttmp_revenue") / c("y_assets")
    cr, crp = c("current_assets") / c("current_liabilities"), c("y_current_assets") / c("y_current_liabilities")
    pos, ocf, qual = n(c("ttm_net_income") > 0), n(c("ttm_op_cash_flow") > 0), n(c("ttm_op_cash_flow") > c("ttm_net_income"))
    f8 = pos + ocf + n(roa > roap) + qual + n(c("debt") < c("y_debt")) + n(cr > crp) + n(gm > gmp) + n(at > atp)
    f6 = pos + ocf + n(roa > roap) + qual + n(cr > crp) + n(gm > gmp)
    avg = (c("assets") + c("y_assets")) / 2
    f9 = (n(c("ttm_net_income") / avg > 0) + ocf + n(c("ttm_net_income") / avg > c("y_net_income") / c("y_assets")) + qual + n(c("debt") / c("assets") < c("y_debt") / c("y_assets")) + n(cr > crp) + n(c("shares") <= c("y_shares") * 1.01)
          + n(c("gross_profit") / c("revenue") > c("y_gross_profit") / c("y_revenue")) + n(c("revenue") / avg > c("y_revenue") / c("y_assets")))
    return b.where("q >= 8").select("ticker", "period_end", f8.alias("f8"), f6.alias("f6"), f9.alias("f9"))


def altman_ohlson(b: DataFrame) -> DataFrame:
    """Z with retained earnings or with trailing income as the second term, its zone, O-score and its probability."""
    a = c("assets")
    wc = c("current_assets") - c("current_liabilities")
    rest = 3.3 * c("ttm_operating_income") / a + 0.6 * c("equity") / c("liabilities") + c("ttm_revenue") / a
    z, zn = 1.2 * wc / a + 1.4 * c("retained_earnings") / a + rest, 1.2 * wc / a + 1.4 * c("ttm_net_income") / a + rest
    o = -1.32 - 0.407 * F.log(F.greatest(a, F.lit(1.0)) / 1e6) + 6.03 * c("liabilities") / a - 1.43 * wc / a - 2.37 * c("ttm_net_income") / a - 1.83 * c("ttm_op_cash_flow") / c("liabilities")
    x = b.where("q >= 4 and liabilities > 0").select("ticker", "period_end", z.alias("altman_z"), zn.alias("altman_z_income"), o.alias("ohlson_o"), (1 / (1 + F.exp(-o))).alias("bankruptcy_prob"))
    return x.withColumn("zone", F.when(c("altman_z") > 2.99, "safe").when(c("altman_z") < 1.81, "distress").otherwise("grey"))


def beneish(b: DataFrame) -> DataFrame:
    """M-score of five terms against the quarter a year earlier."""
    d = sdiv
    dsri = d(d("receivables", "revenue"), d("y_receivables", "y_revenue"))
    gmi = d(d("y_gross_profit", "y_revenue"), d("gross_profit", "revenue"))
    aqi = d(1 - (c("current_assets") + c("ppe")) / c("assets"), 1 - (c("y_current_assets") + c("y_ppe")) / c("y_assets"))
    sgi, tata = d("revenue", "y_revenue"), (c("net_income") - c("op_cash_flow")) / c("assets")
    x = b.where("q >= 5").select("ticker", "period_end", dsri.alias("dsri"), gmi.alias("gmi"), aqi.alias("aqi"), sgi.alias("sgi"), tata.alias("tata"))
    x = x.withColumn("m_score", -4.84 + 0.92 * c("dsri") + 0.528 * c("gmi") + 0.404 * c("aqi") + 0.892 * c("sgi") + 4.679 * c("tata"))
    return x.withColumn("flagged", c("m_score") > -1.78)


def dupont_owner_roic(b: DataFrame) -> DataFrame:
    nopat = c("ttm_operating_income") * (1 - 0.21)
    return b.where("q >= 4").select("ticker", "period_end", sdiv("ttm_net_income", "ttm_revenue").alias("net_margin"), sdiv("ttm_revenue", "assets").alias("asset_turnover"), sdiv("assets", "equity").alias("equity_multiplier"),
                                    (sdiv("ttm_net_income", "ttm_revenue") * sdiv("ttm_revenue", "assets") * sdiv("assets", "equity")).alias("roe_dupont"), (c("ttm_net_income") + c("ttm_depreciation") - F.abs("ttm_capex") * 0.7).alias("owner_earnings"),
                                    (nopat / invested()).alias("roic_normalised"))


def quality_inputs(b: DataFrame, n: int = 20) -> DataFrame:
    """Trends over the last 20 quarters: return on capital, margin variation, cash conversion, growth, leverage."""
    roic, gm = c("operating_income") * 0.79 / invested(), c("gross_profit") / c("revenue")
    conv = F.when(c("net_income") > 0, (c("op_cash_flow") - F.abs("capex")) / c("net_income"))
    yoy = F.when(c("y_revenue") > 0, c("revenue") / c("y_revenue") - 1)
    de = F.when(c("equity") > 0, c("debt") / c("equity"))
    w, allw = back(n), back(100000)
    x = b.select("*", roic.alias("_roic"), gm.alias("_gm"), conv.alias("_conv"), yoy.alias("_yoy"), de.alias("_de"))
    g = lambda k, e, win, m: F.when(F.count(k).over(win) >= m, e)
    return x.select("*", g("_roic", F.avg("_roic").over(w), w, 4).alias("roic_mean"), g("_roic", slope(c("_roic"), 100000), allw, 8).alias("roic_slope"), g("_gm", F.avg("_gm").over(w), w, 8).alias("gm_mean"),
                    g("_gm", F.stddev_samp("_gm").over(w) / F.avg("_gm").over(w), w, 8).alias("gm_cov"), g("_conv", F.avg("_conv").over(w), w, 4).alias("fcf_conv"), g("_yoy", F.avg("_yoy").over(allw), allw, 4).alias("growth_mean"),
                    g("_yoy", F.stddev_samp("_yoy").over(allw), allw, 4).alias("growth_std"), F.last("_de", ignorenulls=True).over(allw).alias("de_latest"), g("_de", slope(c("_de"), 100000), allw, 8).alias("de_slope"))


def spread_score(s: Column) -> Column:
    return (F.when(s.isNull(), 50.0).when(s <= 0, clip(25 + s * 200, 0, 40)).when(s <= 0.05, 40 + s / 0.05 * 25).when(s <= 0.15, 65 + (s - 0.05) / 0.10 * 25).otherwise(clip(90 + (s - 0.15) * 66, 90, 100)))


def quality_scorecard(b: DataFrame, wacc_high: float = 0.107) -> DataFrame:
    """Weighted 0..100 quality score, capped at 45 when capital earns less than the high end of its cost."""
    x = quality_inputs(b).join(piotroski_ttm(b).select("ticker", "period_end", "f8"), ["ticker", "period_end"], "left").join(altman_ohlson(b).select("ticker", "period_end", "altman_z_income"), ["ticker", "period_end"], "left")
    sp = c("roic_mean") - wacc_high
    acc = F.when(c("q") >= 4, (c("ttm_net_income") - c("ttm_op_cash_flow")) / c("assets"))
    gg = good_great_score
    total = (0.25 * spread_score(sp) + 0.10 * gg(c("roic_mean"), 0.08, 0.20) + 0.10 * gg(c("gm_cov"), 0.15, 0.05, False) + 0.15 * gg(c("fcf_conv"), 0.8, 1.2) + 0.08 * gg(c("growth_mean"), 0.05, 0.15) + 0.07 * gg(c("de_latest"), 1.0, 0.3, False)
             + 0.10 * F.coalesce(c("f8") / 9 * 100, F.lit(50.0)) + 0.05 * gg(c("altman_z_income"), 1.8, 3.0) + 0.10 * gg(acc, 0.05, -0.05, False))
    return x.select("ticker", "period_end", sp.alias("spread"), F.when(sp <= 0, F.least(clip(total, 0, 100), F.lit(45.0))).otherwise(clip(total, 0, 100)).alias("past_score"))


def dcf_per_share(fcf: Column, growth: Column, wacc: Column, tg: Column, shares: Column, net_debt: Column, years: int = 7) -> Column:
    """Two stages: growth capped at 20 %, fading to the terminal rate by .7 a year, terminal rate at least 3 points under
    the discount rate. The years are a fold over a literal sequence."""
    g, t = F.least(growth, F.lit(0.20)), F.least(tg, wacc - 0.03)
    start = F.struct(fcf.cast("double").alias("f"), F.lit(0.0).alias("pv"))

    def year(a, y):
        f = a["f"] * (1 + t + (g - t) * F.pow(F.lit(0.7), y - 1))
        return F.struct(f.alias("f"), (a["pv"] + f / F.pow(1 + wacc, y)).alias("pv"))

    z = F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, year)
    ev = z["pv"] + z["f"] * (1 + t) / (wacc - t) / F.pow(1 + wacc, F.lit(years))
    return F.when((shares > 0) & (wacc > tg), (ev - net_debt) / shares)


def dcf_table(b: DataFrame, wacc: float = 0.09) -> DataFrame:
    """Bull, base and bear values per share with their weighted mean, earnings power, Graham number, residual income, agreement."""
    fcf, nd, sh = c("ttm_op_cash_flow") - F.abs("ttm_capex"), c("debt") - c("cash"), c("shares")
    x = b.where("q >= 8 and shares > 0").withColumn("_fcf", fcf).where("_fcf > 0")
    g = F.coalesce(c("ttm_revenue") / c("ttmp_revenue") - 1, F.lit(0.05))
    w = F.lit(wacc)
    case = lambda m, tg: dcf_per_share(c("_fcf"), g * m, w, F.lit(tg), sh, nd)
    eps, bv = c("ttm_net_income") / sh, c("equity") / sh
    roe = eps / bv
    ri = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.struct(bv.alias("b"), F.lit(0.0).alias("s")), lambda a, y: F.struct((a["b"] * (1 + roe * 0.6)).alias("b"), (a["s"] + (roe - wacc) * a["b"] / F.pow(F.lit(1 + wacc), y)).alias("s")))
    x = x.select("ticker", "period_end", case(1.0, 0.025).alias("base"), case(1.3, 0.03).alias("bull"), case(0.5, 0.02).alias("bear"), ((c("ttm_operating_income") * 0.79 / wacc - nd) / sh).alias("epv"),
                 F.when((eps > 0) & (bv > 0), F.sqrt(22.5 * eps * bv)).alias("graham"), F.when(bv > 0, bv + ri["s"]).alias("residual_income"))
    return x.withColumn("weighted", 0.25 * c("bull") + 0.50 * c("base") + 0.25 * c("bear"))


def dcf_grid(b: DataFrame, price: DataFrame, wacc: float = 0.09, tg: float = 0.025) -> DataFrame:
    """Share of the 25 discount/terminal rate scenarios above the price, dividend model and asset values of every company."""
    fcf = c("ttm_op_cash_flow") - F.abs("ttm_capex")
    x = b.join(price, ["ticker", "period_end"]).where("q >= 8 and shares > 0").withColumn("_fcf", fcf)
    g = F.coalesce(c("ttm_revenue") / c("ttmp_revenue") - 1, F.lit(0.05))
    vals = [dcf_per_share(c("_fcf"), g, F.lit(wacc + dw), F.lit(tg + dt), c("shares"), c("debt") - c("cash")) for dw in (-0.02, -0.01, 0.0, 0.01, 0.02) for dt in (-0.01, -0.005, 0.0, 0.005, 0.01)]
    dps = c("ttm_dividends") / c("shares")
    gd = F.least(g, F.lit(wacc - 0.02))
    return x.select("ticker", "period_end", F.when(c("_fcf") > 0, F.aggregate(F.array(*[(v >= c("price")).cast("int") for v in vals]), F.lit(0), lambda a, e: a + e) / 25).alias("share_above"),
                    F.when(dps > 0, dps * (1 + gd) / (wacc - gd)).alias("ddm"), ((c("assets") - c("liabilities")) / c("shares")).alias("nav"), ((c("assets") * 0.6 - c("liabilities")) / c("shares")).alias("liquidation"),
                    ((c("price") * c("shares") + c("debt") - c("cash")) / c("ttm_revenue")).alias("ev_sales"))


def piotroski_annual(a: DataFrame) -> DataFrame:
    """Nine yearly checks per company and fiscal year; a share jump over 1.5x is a split and passes, 2 % is noise.
    a: cik, fy and one column per metric."""
    w = Window.partitionBy("cik").orderBy("fy")
    cols = ("net_income", "assets", "liabilities", "revenue", "gross_profit", "current_assets", "current_liabilities", "shares")
    prev = F.lag("fy").over(w) == c("fy") - 1
    x = a.select("*", *[F.when(prev, F.lag(k).over(w)).alias("p_" + k) for k in cols])
    n = lambda k: F.coalesce(k, F.lit(False)).cast("int")
    r, d = c("shares") / c("p_shares"), sdiv
    checks = [c("net_income") > 0, c("op_cash_flow") > 0, d("net_income", "assets") > d("p_net_income", "p_assets"), c("op_cash_flow") > c("net_income"), d("liabilities", "assets") < d("p_liabilities", "p_assets"),
              d("current_assets", "current_liabilities") > d("p_current_assets", "p_current_liabilities"), (r > 1.5) | (r <= 1.02), d("gross_profit", "revenue") > d("p_gross_profit", "p_revenue"), d("revenue", "assets") > d("p_revenue", "p_assets")]
    tot = n(checks[0])
    for k in checks[1:]:
        tot = tot + n(k)
    return x.select("*", tot.alias("f_score"), d("gross_profit", "assets").alias("gross_profitability"), (d("revenue", "p_revenue") - 1).alias("rev_growth"), ((c("net_income") - c("op_cash_flow")) / c("assets")).alias("accruals"),
                    (d("liabilities", "assets") - d("p_liabilities", "p_assets")).alias("leverage_delta"), (d("gross_profit", "revenue") - d("p_gross_profit", "p_revenue")).alias("margin_delta"))


def stage(off_low: Column, days_since_low: Column, streak: Column, up_share: Column) -> Column:
    based, accum = days_since_low >= 60, (streak >= 3) | (up_share >= 0.55)
    return F.when(off_low >= 0.25, "RECOVERING").when(based & accum, "TURNING").when(based, "BASING").otherwise("FALLING")


def points(x: Column, lo: float, hi: float, budget: float) -> Column:
    return F.coalesce(budget * clip((x - lo) / (hi - lo), 0, 1), F.lit(0.0))
