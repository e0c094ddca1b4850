"""Peer, module and signal scoring, and the screen for rebounds, with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import composites as CP
from tidemark.operators import fundamentals as FU
from tidemark.operators import scoring as X
from tidemark.operators import windows as WN
from tidemark.operators.aggregates import rank_ic
from tidemark.operators.technical import drawdown_structure
from tidemark.plans.q_10_technical import rets
from tidemark.plans.q_30_sources_filters import reg
from tidemark.plans.q_55_composites import SCORES
from tidemark.plans.q_60_aggregates import OUT, RKX, outcomes
from tidemark.plans.q_90_fundamentals import FB, PFU, base, peer_fund
from tidemark.sources import views as V

c = F.col
FIELDS = ["gross_margin", "net_margin", "ocf_margin", "roa", "roe", "growth", "pe", "ps", "asset_turnover", "current_ratio"]
N = None
SPEC = [
    ("financial", "margins", "gm", "gross_margin", 4.0, 6.0, 60.0, True, 0.2, 0.5, -0.1, 25.0, 0.7, 88.0, False, "live"), ("financial", "margins", "nm", "net_margin", 3.0, 6.0, 60.0, True, 0.0, 0.2, N, N, N, N, True, "live"),
    ("financial", "margins", "om", "ocf_margin", 2.0, 6.0, 60.0, True, 0.0, 0.2, N, N, N, N, True, "live"), ("financial", "returns", "roa", "roa", 3.0, 4.0, 60.0, True, 0.02, 0.1, -0.02, 30.0, N, N, True, "live"),
    ("financial", "returns", "roe", "roe", 2.0, 4.0, 60.0, True, 0.05, 0.2, N, N, N, N, False, "live"), ("valuation", "multiples", "pe", "pe", 3.0, 7.0, 40.0, False, 25.0, 12.0, 60.0, 30.0, 8.0, 85.0, False, "live"),
    ("valuation", "multiples", "ps", "ps", 2.0, 7.0, 40.0, False, 0.2, 0.05, N, N, N, N, True, "live"), ("valuation", "multiples", "ev", "ps", 2.0, 7.0, 40.0, False, 0.2, 0.05, N, N, N, N, False, "reference"),
    ("valuation", "growth", "growth", "growth", 4.0, 3.0, 40.0, True, 0.05, 0.2, -0.3, 20.0, 0.4, 90.0, True, "live"), ("valuation", "growth", "flow", "asset_turnover", 1.0, 3.0, 40.0, True, 0.5, 1.0, N, N, N, N, False, "needs_source"),
]
lit = lambda v: "NULL" if v is None else ("true" if v is True else "false" if v is False else f"'{v}'" if isinstance(v, str) else f"{v!r}")
SP = "sp(module, category, id, field, weight, category_weight, module_weight, higher, good, great, flo, floor_score, cap, cap_score, ranked, status) AS (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in SPEC) + ")"
LONG = "lo AS (SELECT ticker, bucket, field, value FROM (SELECT ticker, bucket, " + ", ".join(FIELDS) + " FROM pe) UNPIVOT INCLUDE NULLS (value FOR field IN (" + ", ".join(FIELDS) + ")))"
BAND = "CASE WHEN x <= g THEN greatest(0.0, 40 + (x - (g - (gg - g))) / (gg - g) * 25) WHEN x <= gg THEN 65 + (x - g) / (gg - g) * 25 ELSE least(100.0, 90 + (x - gg) / (gg - g) * 10) END"
SCO = PFU + ", " + LONG + ", " + SP + f""", s1 AS (SELECT *, CASE WHEN higher THEN value ELSE -value END AS x, CASE WHEN higher THEN good ELSE -good END AS g, CASE WHEN higher THEN great ELSE -great END AS gg, CASE WHEN higher THEN flo ELSE -flo END AS fl, CASE WHEN higher THEN cap ELSE -cap END AS cp FROM
    (SELECT *, CASE WHEN value IS NULL THEN NULL ELSE count(value) OVER (PARTITION BY bucket, field) END AS n, rank() OVER (PARTITION BY bucket, field, value IS NULL ORDER BY value) - 1 AS less, count(*) OVER (PARTITION BY bucket, field, value) AS eq FROM lo) JOIN sp USING (field)),
s2 AS (SELECT *, CASE WHEN ranked AND n >= 5 THEN CASE WHEN higher THEN 100.0 * (less + 0.5 * eq) / n ELSE 100 - 100.0 * (less + 0.5 * eq) / n END END AS pct, {BAND} AS bnd FROM s1), s3 AS (SELECT *, coalesce(pct, bnd) AS raw, CASE WHEN status IN ('reference', 'needs_source') THEN status WHEN value IS NULL THEN 'missing' WHEN pct IS NOT NULL THEN 'percentile' ELSE 'absolute' END AS method FROM s2),
s4 AS (SELECT *, CASE WHEN fl IS NOT NULL AND x < fl THEN least(raw, floor_score) ELSE raw END AS r1 FROM s3), ss AS (SELECT *, CASE WHEN method IN ('percentile', 'absolute') THEN round(CASE WHEN cp IS NOT NULL AND x > cp THEN greatest(r1, cap_score) ELSE r1 END, 1) END AS score FROM s4),
ca AS (SELECT ticker, module, category, category_weight, module_weight, round(sum(score * weight) / sum(weight) FILTER (score IS NOT NULL), 1) AS score, coalesce(round(sum(weight) FILTER (score IS NOT NULL) / sum(weight), 3), 0) AS confidence FROM ss GROUP BY ALL),
mo AS (SELECT ticker, module, module_weight, round(sum(score * category_weight) / sum(category_weight) FILTER (score IS NOT NULL), 1) AS score, coalesce(round(sum(category_weight) FILTER (score IS NOT NULL) / sum(category_weight), 3), 0) AS confidence FROM ca GROUP BY ALL)"""


def long(s, d):
    p = peer_fund(s, d)
    return p.select("ticker", "bucket", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c(f).alias("value")) for f in FIELDS])).alias("e")).select("ticker", "bucket", "e.field", "e.value")


scored = lambda s, d: X.score_signals(long(s, d), X.catalog(s, SPEC))
reg("score_signal", "ticker id:s value score:1 method:s", "quarters universe", "SELECT * FROM ss", scored, SCO)
reg("signal_catalog", "module:s category:s id:s field:s weight:2 higher:i good:4 great:4 status:s n_values:i", "quarters universe", "SELECT module, category, id, field, weight, higher, good, great, status, count(value) AS n_values FROM sp JOIN lo USING (field) GROUP BY ALL",
    lambda s, d: X.catalog(s, SPEC).join(long(s, d), "field").groupBy("module", "category", "id", "field", "weight", "higher", "good", "great", "status").agg(F.count("value").alias("n_values")), SCO)
reg("weighted_rollup", "ticker module:s category:s score:1 confidence:3", "quarters universe", "SELECT * FROM ca", lambda s, d: X.weighted_rollup(scored(s, d), ["ticker", "module", "category"]), SCO)
reg("module_rollup", "ticker module:s score:1 confidence:3", "quarters universe", "SELECT * FROM mo", lambda s, d: X.module_scores(scored(s, d)), SCO)
VER = "CASE WHEN conviction IS NULL THEN 'NO_DATA' WHEN conviction >= 80 THEN 'STRONG_BUY' WHEN conviction >= 65 THEN 'BUY' WHEN conviction >= 45 THEN 'NEUTRAL' WHEN conviction >= 30 THEN 'SELL' ELSE 'STRONG_SELL' END"
CON = f"SELECT *, {VER} AS verdict FROM (SELECT ticker, round(sum(score * module_weight) / sum(module_weight) FILTER (score IS NOT NULL), 1) AS conviction, sum(module_weight) FILTER (score IS NOT NULL) / 100 AS coverage, count(score) AS live_modules FROM mo GROUP BY ticker)"
reg("conviction_aggregate", "ticker conviction:1 coverage live_modules:i verdict:s", "quarters universe", CON, lambda s, d: X.conviction(X.module_scores(scored(s, d)), 100.0), SCO)


def registry_conviction(s, d):
    """Scorers are functions from the session to (ticker, module, module_weight, score) frames; their union is rolled up."""
    allm = X.module_scores(scored(s, d)).persist()
    scorers = {m: (lambda m=m: allm.where(c("module") == m)) for m in ("financial", "valuation")}
    frames = [fn() for fn in scorers.values()]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return X.conviction(u, 100.0)


reg("scorer_registry", "ticker conviction:1 verdict:s", "quarters universe", CON, registry_conviction, SCO)
PCT = "pc AS (SELECT *, CASE WHEN value IS NOT NULL AND count(value) OVER (PARTITION BY bucket, field) >= 5 THEN (rank() OVER (PARTITION BY bucket, field, value IS NULL ORDER BY value) - 1) / count(value) OVER (PARTITION BY bucket, field) END AS pct FROM lo)"
PCL = PFU + ", " + LONG + ", " + PCT
reg("peer_percentiles", "ticker bucket:s field:s pct", "quarters universe", "SELECT * FROM pc", lambda s, d: X.field_percentiles(long(s, d), "bucket"), PCL)
CMPQ = "SELECT ticker, bucket, avg(pct) AS composite, avg(CASE WHEN pct IS NOT NULL THEN CASE WHEN pct >= 0.75 THEN 1.0 ELSE 0 END END) AS top_quartile, avg(CASE WHEN pct IS NOT NULL THEN CASE WHEN pct <= 0.25 THEN 1.0 ELSE 0 END END) AS bottom_quartile, count(pct) AS n_fields FROM pc GROUP BY 1, 2"
reg("peers_features", "ticker bucket:s composite top_quartile bottom_quartile n_fields:i", "quarters universe", CMPQ, lambda s, d: X.rank_composite(X.field_percentiles(long(s, d), "bucket"), "bucket"), PCL)
ADV = ["net_margin", "gross_margin", "roe", "roic", "growth", "asset_turnover"]
reg("competitive_features", "ticker bucket:s " + " ".join(f + "_advantage" for f in ADV) + " market_share share_loss_risk:1", "quarters universe", "SELECT ticker, bucket, " + ", ".join(f"{f} - m_{f} AS {f}_advantage" for f in ADV) + ", revenue / rev AS market_share, CASE WHEN growth - m_growth < -0.05 THEN 1.0 ELSE 0.0 END AS share_loss_risk FROM pe JOIN (SELECT bucket, "
    + ", ".join(f"quantile_cont({f}, 0.5) AS m_{f}" for f in ADV) + ", sum(revenue) AS rev, count(*) AS k FROM pe GROUP BY 1) USING (bucket) WHERE k >= 5", lambda s, d: X.peer_advantages(peer_fund(s, d), "bucket", ADV), PFU)
FIU = SCORES[:SCORES.index(",\nsc AS")]
MF = ["mom_12_1", "mom_6m", "mom_3m", "volume_surge", "obv_slope"]


def momentum_long(s, d):
    f = CP.factor_inputs(rets(s, d)).join(V.universe(s, d).select("ticker", "bucket"), "ticker")
    return f.select("ticker", "bucket", "mom_3m", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c(k).alias("value")) for k in MF])).alias("e")).select("ticker", "bucket", "mom_3m", "e.field", "e.value")


ML = FIU + ", ml AS (SELECT ticker, bucket, mom_3m AS m3, field, value FROM (SELECT ticker, mom_3m, " + ", ".join(f"{k} AS x_{k}" for k in MF) + ", bucket FROM fi JOIN universe USING (ticker)) UNPIVOT INCLUDE NULLS (value FOR field IN (" + ", ".join(f"x_{k}" for k in MF) + "))), mp AS (SELECT *, CASE WHEN value IS NOT NULL AND count(value) OVER (PARTITION BY bucket, field) >= 5 THEN (rank() OVER (PARTITION BY bucket, field, value IS NULL ORDER BY value) - 1) / count(value) OVER (PARTITION BY bucket, field) END AS pct FROM ml)"


def industry(s, d):
    """Mean factor percentile inside the sector, with the sector's momentum level and dispersion."""
    p = X.field_percentiles(momentum_long(s, d), "bucket")
    g = p.groupBy("ticker", "bucket").agg(F.avg("pct").alias("composite"), F.first("mom_3m").alias("m3"))
    sec = g.groupBy("bucket").agg(F.avg("m3").alias("sector_avg"), F.stddev_pop("m3").alias("dispersion"), F.count("m3").alias("n")).where("n >= 10")
    return g.join(sec, "bucket").select("ticker", "bucket", "composite", "sector_avg", "dispersion", (c("m3") - c("sector_avg")).alias("vs_sector"))


reg("industry_features", "ticker bucket:s composite sector_avg dispersion vs_sector", "tails universe", "SELECT ticker, bucket, composite, a AS sector_avg, s AS dispersion, m3 - a AS vs_sector FROM (SELECT ticker, bucket, avg(pct) AS composite, max(m3) AS m3 FROM mp GROUP BY 1, 2) JOIN (SELECT bucket, avg(m3) AS a, stddev_pop(m3) AS s FROM ml WHERE field = 'x_mom_3m' GROUP BY 1 HAVING count(m3) >= 10) USING (bucket)", industry, ML)
reg("market_scoring", "ticker bucket:s composite top_quartile bottom_quartile", "tails universe", "SELECT ticker, bucket, avg(pct) AS composite, avg(CASE WHEN pct >= 0.75 THEN 1.0 ELSE 0 END) AS top_quartile, avg(CASE WHEN pct <= 0.25 THEN 1.0 ELSE 0 END) AS bottom_quartile FROM mp GROUP BY 1, 2", lambda s, d: X.rank_composite(X.field_percentiles(momentum_long(s, d), "bucket"), "bucket"), ML)


def styles(s, d):
    f = CP.factor_inputs(rets(s, d)).select("ticker", "mom_6m", "mom_3m")
    return X.style_ensemble(peer_fund(s, d).withColumn("earnings_yield", F.when(c("pe") > 0, 1 / c("pe"))).join(f, "ticker"))


ZB = lambda x, m, w: f"CASE WHEN {x} IS NOT NULL THEN 1 / (1 + exp(-({x} - {m}) / {w})) END"
MEAN = lambda *xs: f"list_avg(list_filter([{', '.join(xs)}], lambda v: v IS NOT NULL))"
STY = FIU + ", " + PFU + f""", st AS (SELECT ticker, {MEAN(f"1 - {ZB('pe', 25.0, 12.0)}", ZB('1 / nullif(pe, 0)', 0.04, 0.03))} AS value, {MEAN(ZB('mom_6m', 0.0, 0.15), ZB('mom_3m', 0.0, 0.1))} AS momentum, {MEAN(ZB('roic', 0.12, 0.08), ZB('roe', 0.15, 0.1), ZB('net_margin', 0.1, 0.08))} AS quality, {MEAN(ZB('growth', 0.05, 0.1))} AS growth FROM pe JOIN fi USING (ticker)),
en AS (SELECT *, (coalesce(value * 0.20, 0) + coalesce(momentum * 0.22, 0) + coalesce(quality * 0.24, 0) + coalesce(growth * 0.22, 0)) / (CASE WHEN value IS NULL THEN 0 ELSE 0.20 END + CASE WHEN momentum IS NULL THEN 0 ELSE 0.22 END + CASE WHEN quality IS NULL THEN 0 ELSE 0.24 END + CASE WHEN growth IS NULL THEN 0 ELSE 0.22 END) AS ensemble, list_filter([value, momentum, quality, growth], lambda v: v IS NOT NULL) AS a FROM st)"""
reg("style_ensemble", "ticker value momentum quality growth ensemble agreement up_probability conviction", "tails quarters universe", "SELECT *, greatest(len(list_filter(a, lambda v: v > 0.55)), len(list_filter(a, lambda v: v < 0.45))) / len(a) AS agreement, 1 / (1 + exp(-(ensemble - 0.5) * 6)) AS up_probability, abs(ensemble - 0.5) * 2 AS conviction FROM en", styles, STY)
reg("logistic_band", "ticker d band", "rets", "SELECT ticker, d, 1 / (1 + exp(-(r - 0.0) / 0.02)) AS band FROM rets WHERE r IS NOT NULL", lambda s, d: rets(s, d).where("r is not null").select("ticker", "d", (1 / (1 + F.exp(-c("r") / 0.02))).alias("band")))
ICW = OUT + f", icm AS ({RKX('(SELECT *, model AS md, CAST(generated_at AS DATE) AS dd FROM outc WHERE ret IS NOT NULL)', 'md, dd')}), ik AS (SELECT md, ic, row_number() OVER (PARTITION BY md ORDER BY dd DESC) AS k FROM icm), iw AS (SELECT md, sum(ic * exp(-(k - 1) / (n - 1))) / sum(exp(-(k - 1) / (n - 1))) AS recent_ic FROM (SELECT *, count(*) OVER (PARTITION BY md) AS n FROM ik WHERE k <= 12) GROUP BY 1), iwt AS (SELECT md, recent_ic, CASE WHEN t < 0.001 THEN 1 / m ELSE greatest(recent_ic, 0) / t END AS weight FROM iw, (SELECT sum(greatest(recent_ic, 0)) AS t, count(*) AS m FROM iw))"
icw = lambda s, d: X.ic_weights(rank_ic(outcomes(s, d).withColumn("dd", F.to_date("generated_at")), ["model", "dd"], "signal", "ret", tie="id"), "model", "dd")


def ensemble(s, d):
    """Latest signal of every model per instrument, blended with the coefficient weights."""
    last = V.signals(s, d).groupBy("ticker", "model").agg(F.max_by("signal", F.struct("generated_at", "id")).alias("signal"))
    return last.join(icw(s, d), "model").groupBy("ticker").agg(F.sum(c("signal") * c("weight")).alias("combined"), F.count(F.lit(1)).alias("n_models"))


LASTS = ", ls AS (SELECT ticker, model, arg_max(signal, {'g': generated_at, 'i': id}) AS signal FROM signals GROUP BY 1, 2)"
reg("ic_weighted_ensemble", "ticker combined n_models:i", "signals", "SELECT ticker, sum(signal * weight) AS combined, count(*) AS n_models FROM ls JOIN iwt ON md = model GROUP BY ticker", ensemble, ICW + LASTS)
RW = [("calm", "click", 0.5), ("calm", "view", 0.3), ("calm", "purchase", 0.2), ("normal", "click", 0.4), ("normal", "signup", 0.6), ("panic", "error", 0.7), ("panic", "view", 0.3)]


def blend(s, d):
    """Latest signals weighted by the row of the current regime; models without a weight stay out."""
    wt = s.createDataFrame(RW, "regime string, model string, w double")
    last = outcomes(s, d).groupBy("ticker", "model").agg(F.max_by(F.struct("signal", "regime"), F.struct("generated_at", "id")).alias("x")).select("ticker", "model", "x.*")
    return last.join(wt, ["regime", "model"]).groupBy("ticker").agg((F.sum(c("signal") * c("w")) / F.sum("w")).alias("blend"), F.count(F.lit(1)).alias("n"))


reg("regime_conditional_blend", "ticker blend n:i", "signals", "SELECT ticker, sum(signal * w) / sum(w) AS blend, count(*) AS n FROM (SELECT ticker, model, z.s AS signal, z.r AS regime FROM (SELECT ticker, model, arg_max({'s': signal, 'r': regime}, {'g': generated_at, 'i': id}) AS z FROM outc GROUP BY 1, 2)) JOIN (VALUES " + ", ".join(f"('{a}', '{b}', {w})" for a, b, w in RW) + ") t(rg, md, w) ON rg = regime AND md = model GROUP BY ticker", blend, OUT)

# the rebound screen: price structure, filings and volume of every quarter
STG = "CASE WHEN off_1y_low >= 0.25 THEN 'RECOVERING' WHEN days_since_1y_low >= 60 AND (up_day_share >= 0.55) THEN 'TURNING' WHEN days_since_1y_low >= 60 THEN 'BASING' ELSE 'FALLING' END"
DDX = f"""ddx AS (SELECT ticker, d, CASE WHEN n3 >= 30 THEN 1 - c / hi.c END AS dd_3y, CASE WHEN n1 >= 30 THEN c / lo.c - 1 END AS off_1y_low, CASE WHEN n1 >= 30 THEN k - lo.k END AS days_since_1y_low FROM (SELECT ticker, d, c, k, max({{'c': c, 'k': -k}}) OVER w3 AS hi, min({{'c': c, 'k': k}}) OVER w1 AS lo, count(*) OVER w3 AS n3, count(*) OVER w1 AS n1 FROM (SELECT *, d - DATE '1970-01-01' AS k FROM rets)
    WINDOW w3 AS (PARTITION BY ticker ORDER BY k RANGE 1095 PRECEDING), w1 AS (PARTITION BY ticker ORDER BY k RANGE 365 PRECEDING))),
ups AS (SELECT ticker, d, CASE WHEN rn >= 65 THEN sum(uv) OVER (w ROWS 19 PRECEDING) / sum(v) OVER (w ROWS 19 PRECEDING) END AS up_day_share FROM (SELECT *, CASE WHEN c > lag(c) OVER w THEN v ELSE 0.0 END AS uv FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY d)) WINDOW w AS (PARTITION BY ticker ORDER BY d)),
stg AS (SELECT *, {STG} AS stage FROM ddx JOIN ups USING (ticker, d) WHERE days_since_1y_low IS NOT NULL)"""


def staged(s, d):
    from tidemark.operators.technical import volume_surge_accumulation

    b = rets(s, d)
    x = drawdown_structure(b).join(volume_surge_accumulation(b).select("ticker", "d", "up_day_share"), ["ticker", "d"]).where("days_since_1y_low is not null")
    return x.withColumn("stage", FU.stage(c("off_1y_low"), c("days_since_1y_low"), F.lit(0), F.coalesce(c("up_day_share"), F.lit(0.0))))


reg("stage_classifier", "ticker d stage:s", "rets", "SELECT ticker, d, stage FROM stg", staged, DDX)
RB = FB + f""", {DDX}, rbx AS (SELECT f.ticker, f.period_end, f.filed, f.q, ttm_revenue / ttmp_revenue - 1 AS ttm_growth, liabilities / assets - y_liabilities / y_assets AS lev, shares / y_shares AS sr, CASE WHEN op_cash_flow < 0 THEN cash / (-op_cash_flow / 3) END AS runway, ttm_net_income / assets > ttmp_net_income / y_assets AS roic_up, ttm_net_income < ttm_op_cash_flow AS clean, ttm_rd / assets AS rd,
    ttm_buybacks > 0 AS bb, s.dd_3y, s.stage, s.up_day_share FROM fb f ASOF JOIN stg s ON s.ticker = f.ticker AND f.filed >= s.d WHERE f.q >= 8),
rbg AS (SELECT *, array_to_string(list_filter([CASE WHEN ttm_growth < 0 THEN 'revenue_shrinking' END, CASE WHEN lev > 0.10 THEN 'leverage_spiking' END, CASE WHEN sr BETWEEN 0.6 AND 1.5 AND sr - 1 > 0.10 THEN 'dilution' END, CASE WHEN runway < 18 THEN 'cash_runway' END], lambda v: v IS NOT NULL), ',') AS flags FROM rbx)"""


def rebound_inputs(s, d):
    """Filing quarters joined to the price structure known on the filing day, with the knife filters."""
    from tidemark.operators.joins import asof_join

    b = base(s, d).where("q >= 8")
    st = staged(s, d).select("ticker", "d", "dd_3y", "stage", "up_day_share")
    q = b.select("ticker", "period_end", "filed", (c("ttm_revenue") / c("ttmp_revenue") - 1).alias("ttm_growth"), (c("liabilities") / c("assets") - c("y_liabilities") / c("y_assets")).alias("lev"), (c("shares") / c("y_shares")).alias("sr"),
                 F.when(c("op_cash_flow") < 0, c("cash") / (-c("op_cash_flow") / 3)).alias("runway"), (c("ttm_net_income") / c("assets") > c("ttmp_net_income") / c("y_assets")).alias("roic_up"), (c("ttm_net_income") < c("ttm_op_cash_flow")).alias("clean"), (c("ttm_rd") / c("assets")).alias("rd"), (c("ttm_buybacks") > 0).alias("bb"))
    j = asof_join(q, st, "ticker", "filed", "d", ["dd_3y", "stage", "up_day_share"]).where("stage is not null")
    flags = F.array_compact(F.array(F.when(c("ttm_growth") < 0, "revenue_shrinking"), F.when(c("lev") > 0.10, "leverage_spiking"), F.when(c("sr").between(0.6, 1.5) & (c("sr") - 1 > 0.10), "dilution"), F.when(c("runway") < 18, "cash_runway")))
    return j.withColumn("flags", F.array_join(flags, ","))


reg("rebound_gates", "ticker period_end:s dd_3y flags:s stage:s", "quarters rets", "SELECT * FROM rbg", rebound_inputs, RB)
PTS = lambda x, lo, hi, b: f"coalesce({b} * least(greatest(({x} - {lo}) / ({hi} - {lo}), 0.0), 1.0), 0)"
RSQ = f"CASE WHEN flags = '' AND dd_3y >= 0.2 THEN {PTS('dd_3y', 0.2, 0.75, 15)} + {PTS('ttm_growth', 0.0, 0.2, 15)} + CASE WHEN roic_up THEN 2 ELSE 0 END + CASE WHEN clean THEN 3 ELSE 0 END + {PTS('up_day_share', 0.5, 0.7, 5)} + CASE WHEN bb THEN 4 ELSE 0 END + CASE WHEN rd >= 0.02 THEN 3 ELSE 0 END + 4 END"


def rebound(s, d):
    p = FU.points
    sc = (p(c("dd_3y"), 0.2, 0.75, 15) + p(c("ttm_growth"), 0.0, 0.2, 15) + F.when(c("roic_up"), 2).otherwise(0) + F.when(c("clean"), 3).otherwise(0) + p(c("up_day_share"), 0.5, 0.7, 5) + F.when(c("bb"), 4).otherwise(0) + F.when(c("rd") >= 0.02, 3).otherwise(0) + 4)
    return rebound_inputs(s, d).withColumn("score", F.when((c("flags") == "") & (c("dd_3y") >= 0.2), sc))


reg("rebound_score", "ticker period_end:s stage:s score:4", "quarters rets", f"SELECT ticker, period_end, stage, {RSQ} AS score FROM rbg", rebound, RB)
reg("rebound_scan", "period_end:s ticker stage:s score:4 rank:i n_stage:i", "quarters rets", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_end ORDER BY score DESC, ticker) AS rank, count(*) OVER (PARTITION BY period_end, stage) AS n_stage FROM (SELECT ticker, period_end, stage, {RSQ} AS score FROM rbg) WHERE score IS NOT NULL) WHERE rank <= 10",
    lambda s, d: rebound(s, d).where("score is not null").withColumn("rank", F.row_number().over(Window.partitionBy("period_end").orderBy(c("score").desc(), "ticker"))).withColumn("n_stage", F.count(F.lit(1)).over(Window.partitionBy("period_end", "stage"))).where("rank <= 10"), RB)
reg("artifact_enrich", "ticker ret_90d quiet:i vol_change_pct", "rets", """SELECT l.ticker, ret_90d, abs(ret_90d) < 0.2 AS quiet, vol_change_pct FROM (SELECT ticker, arg_max(c, d) / arg_max(c, d) FILTER (d <= t - 90) - 1 AS ret_90d FROM (SELECT *, max(d) OVER (PARTITION BY ticker) AS t FROM rets) GROUP BY 1) l LEFT JOIN
    (SELECT ticker, arg_max(x, d) AS vol_change_pct FROM (SELECT ticker, d, CASE WHEN rn >= 40 THEN avg(v) OVER (w ROWS 4 PRECEDING) / avg(v) OVER (w ROWS BETWEEN 39 PRECEDING AND 5 PRECEDING) - 1 END AS x FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY d)) GROUP BY 1) v ON v.ticker = l.ticker""",
    lambda s, d: enriched(s, d))


def enriched(s, d):
    """Screen rows with the price ladder and the newest volume change; quiet = moved under a fifth in three months."""
    from tidemark.operators.technical import volume_surge_accumulation

    vol = volume_surge_accumulation(rets(s, d)).groupBy("ticker").agg(F.max_by("vol_change_pct", "d").alias("vol_change_pct"))
    return WN.price_ladder(V.bars(s, d)).join(vol, "ticker", "left").withColumn("quiet", F.abs("ret_90d") < 0.2)
