"""Aggregations with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import with_lead_split, with_tail
from tidemark.operators import aggregates as X
from tidemark.plans.oracle import W, sql_norm_cdf, sql_norm_ppf
from tidemark.plans.q_10_technical import ANN, market, rets
from tidemark.plans.q_30_sources_filters import reg
from tidemark.sources import views as V


def panel(s, d):
    """Month, instrument, score of the month and outcome of the next."""
    m = V.bars(s, d).groupBy("ticker", F.last_day("d").alias("m")).agg((F.max_by("c", "d") / F.min_by("c", "d") - 1).alias("pred"))
    return m.withColumn("y", F.lead("pred").over(Window.partitionBy("ticker").orderBy("m")))


PAN = """pan AS (SELECT *, lead(pred) OVER (PARTITION BY ticker ORDER BY m) AS y FROM (SELECT ticker, last_day(d) AS m, arg_max(c, d) / arg_min(c, d) - 1 AS pred FROM bars GROUP BY 1, 2)),
rka AS (SELECT m, rank() OVER (PARTITION BY m ORDER BY pred) + (count(*) OVER (PARTITION BY m, pred) - 1) / 2.0 AS a, rank() OVER (PARTITION BY m ORDER BY y) + (count(*) OVER (PARTITION BY m, y) - 1) / 2.0 AS b,
    row_number() OVER (PARTITION BY m ORDER BY pred, ticker) AS oa, row_number() OVER (PARTITION BY m ORDER BY y, ticker) AS ob FROM pan WHERE y IS NOT NULL),
ica AS (SELECT m, corr(a, b) AS ic, count(*) AS n FROM rka GROUP BY 1 HAVING count(*) >= 5)"""
reg("spearman_avg_rank", "m:s ic n:i", "bars", "SELECT * FROM ica", lambda s, d: X.rank_ic(panel(s, d), ["m"], "pred", "y"), PAN)
reg("spearman_ordinal", "m:s ic n:i", "bars", "SELECT m, corr(oa, ob) AS ic, count(*) AS n FROM rka GROUP BY 1 HAVING count(*) >= 5", lambda s, d: X.rank_ic(panel(s, d), ["m"], "pred", "y", ordinal=True), PAN)
GREEDY = """, gr AS (WITH RECURSIVE z(m) AS (SELECT min(m) FROM ica UNION ALL SELECT (SELECT min(i.m) FROM ica i WHERE i.m - z.m >= 63) FROM z WHERE EXISTS (SELECT 1 FROM ica i WHERE i.m - z.m >= 63)) SELECT * FROM z)"""
reg("rank_ic_by_date", "m:s ic n:i", "bars", "SELECT ica.* FROM ica JOIN gr USING (m)", lambda s, d: (lambda ic: ic.join(X.spaced_dates(ic, "m", 63), "m"))(X.rank_ic(panel(s, d), ["m"], "pred", "y")), PAN + GREEDY)
reg("ic_summary", "n:i mean_ic std_pop t_stat icir positive_share", "bars", "SELECT count(*) AS n, avg(ic) AS mean_ic, stddev_pop(ic) AS std_pop, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_stat, avg(ic) / stddev_samp(ic) AS icir, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS positive_share FROM ica",
    lambda s, d: X.ic_summary(X.rank_ic(panel(s, d), ["m"], "pred", "y")), PAN)


def outcomes(s, d):
    """Signals with the outcome five events later of the same instrument."""
    x = with_lead_split(V.signals(s, d), "ticker", ["generated_at", "id"], "signal", 5, "later")
    return x.withColumn("ret", F.col("later") / 100 - F.col("signal") / 400).drop("later").withColumn("regime", F.expr("case when day(generated_at) % 3 = 0 then 'calm' when day(generated_at) % 3 = 1 then 'normal' else 'panic' end"))


OUT = """outc AS (SELECT *, lead(signal, 5) OVER (PARTITION BY ticker ORDER BY generated_at, id) / 100 - signal / 400 AS ret, CASE WHEN day(generated_at) % 3 = 0 THEN 'calm' WHEN day(generated_at) % 3 = 1 THEN 'normal' ELSE 'panic' END AS regime FROM signals),
new500 AS (SELECT *, row_number() OVER (ORDER BY generated_at DESC, id) AS i FROM (SELECT * FROM outc WHERE ret IS NOT NULL AND generated_at >= (SELECT max(generated_at) FROM signals) - INTERVAL 90 DAY ORDER BY generated_at DESC, id LIMIT 500))"""


MODELS = ["click", "error", "purchase", "signup", "view"]


def daily_ic(s, d):
    """The job of the last day that has a signal."""
    last = V.signals(s, d).agg(F.max("generated_at").alias("as_of"))
    return X.daily_ic(outcomes(s, d).crossJoin(last), F.col("as_of"), MODELS)


RKX = lambda t, k: f"SELECT {k}, corr(a, b) AS ic, count(*) AS n FROM (SELECT {k}, rank() OVER (PARTITION BY {k} ORDER BY signal) + (count(*) OVER (PARTITION BY {k}, signal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY {k} ORDER BY ret) + (count(*) OVER (PARTITION BY {k}, ret) - 1) / 2.0 AS b FROM {t}) GROUP BY {k} HAVING count(*) >= 5"
# the rule: 90 days, newest 500, chunks [i, i + 21) for every i < min(n - 5, 42), population deviation, a model's missing value is 0
CHUNKS = "(SELECT ch, signal, ret FROM (SELECT unnest(range(42)) AS ch), new500 WHERE i - 1 BETWEEN ch AND ch + 20 AND ch < (SELECT count(*) FROM new500) - 5)"
BY_MODEL = f"(SELECT m, CASE WHEN model = m THEN signal ELSE 0.0 END AS signal, ret FROM new500, (SELECT unnest({MODELS}) AS m))"
reg("daily_ic_job", "ic hit_rate n_signals:i icir " + " ".join(f"ic_{m}" for m in MODELS), "signals", f"""SELECT * FROM
    (SELECT ic FROM ({RKX('(SELECT *, 1 AS g FROM new500)', 'g')})),
    (SELECT avg(CASE WHEN (signal > 0) = (ret > 0) THEN 1.0 ELSE 0 END) AS hit_rate, count(*) AS n_signals FROM new500),
    (SELECT CASE WHEN count(ic) >= 3 THEN avg(ic) / stddev_pop(ic) END AS icir FROM ({RKX(CHUNKS, 'ch')})),
    (SELECT {', '.join(f"max(ic) FILTER (m = '{m}') AS ic_{m}" for m in MODELS)} FROM ({RKX(BY_MODEL, 'm')}))""", daily_ic, OUT)
reg("track_record", "n:i first_at:s hit_rate ic_sharpe", "signals", f"""SELECT * FROM (SELECT count(*) AS n, min(generated_at) AS first_at, avg(CASE WHEN ret IS NOT NULL THEN CASE WHEN sign(signal) = sign(ret) THEN 1.0 ELSE 0 END END) AS hit_rate FROM outc),
    (SELECT avg(ic) / stddev_samp(ic) * sqrt(252) AS ic_sharpe FROM ({RKX("(SELECT *, CAST(generated_at AS DATE) AS dd FROM outc WHERE ret IS NOT NULL)", 'dd')}))""",
    lambda s, d: (lambda o: o.agg(F.count(F.lit(1)).alias("n"), F.min("generated_at").alias("first_at"), F.avg(F.when(F.col("ret").isNotNull(), (F.signum("signal") == F.signum("ret")).cast("double"))).alias("hit_rate"))
                  .crossJoin(X.rank_ic(o.withColumn("dd", F.to_date("generated_at")), ["dd"], "signal", "ret", tie="id").orderBy(F.col("dd").desc()).limit(252).agg((F.avg("ic") / F.stddev_samp("ic") * 252 ** 0.5).alias("ic_sharpe"))))(outcomes(s, d)), OUT)


def regime_matrix(s, d):
    w = Window.partitionBy("regime").orderBy(F.col("generated_at").desc(), "id")
    x = outcomes(s, d).where("ret is not null").withColumn("k", F.row_number().over(w)).where("k <= 500")
    return X.rank_ic(x, ["regime", "model"], "signal", "ret", tie="id").groupBy("regime").pivot("model", ["click", "error", "purchase", "signup", "view"]).agg(F.max("ic"))


reg("regime_ic_matrix", "regime:s click error purchase signup view", "signals", "SELECT regime, " + ", ".join(f"max(ic) FILTER (model = '{m}') AS {m}" for m in ("click", "error", "purchase", "signup", "view")) + f" FROM ({RKX('(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY generated_at DESC, id) AS k FROM outc WHERE ret IS NOT NULL) WHERE k <= 500)', 'regime, model')}) GROUP BY regime", regime_matrix, OUT)


def latest_positions(s, d):
    h = V.holdings(s, d).where("putcall = ''")
    last = h.agg(F.max("quarter").alias("quarter"))
    return h.join(last, "quarter", "left_semi").withColumn("family", F.col("manager") % 50)


LP = "lp AS (SELECT *, manager % 50 AS family FROM holdings WHERE putcall = '' AND quarter = (SELECT max(quarter) FROM holdings WHERE putcall = ''))"


ISSUED = "upper(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' INC' WHEN 1 THEN ' ' || p_type || ' COM' WHEN 2 THEN 'S CORP' ELSE ' HOLDINGS CLASS A' END"
COMPANY = "p_name || CASE p_partkey % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' ' || p_type || ' Corporation' ELSE ' & Co' END"


def ownership(s, d):
    """Companies find their security by issuer name among the latest positions; its largest holder families."""
    part = V.table(s, d, "part")
    companies = part.where("p_partkey % 5 = 0").selectExpr("p_partkey AS ticker", f"{COMPANY} AS name", "CASE WHEN p_partkey % 35 = 0 THEN NULL ELSE 20.0 + p_partkey % 160 END AS outstanding")
    positions = latest_positions(s, d).join(part.selectExpr("p_partkey AS cusip", f"{ISSUED} AS issuer"), "cusip")
    return X.ownership_by_issuer(companies, positions)


STEM = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(upper({x}), '[^A-Z ]', ' ', 'g'), '{X.ISSUER_SUFFIXES}', ' ', 'g'), ' +', ' ', 'g'))"
ISSUERS = f""", hp AS (SELECT lp.*, {ISSUED} AS issuer FROM lp JOIN part ON p_partkey = cusip), hc AS (SELECT cusip, max(issuer) AS issuer, sum(shares) AS total_shares FROM hp GROUP BY cusip),
co AS (SELECT p_partkey AS ticker, lower(split_part({STEM(COMPANY)}, ' ', 1)) AS word, CASE WHEN p_partkey % 35 = 0 THEN NULL ELSE 20.0 + p_partkey % 160 END AS outstanding FROM part WHERE p_partkey % 5 = 0 AND length({STEM(COMPANY)}) >= 3),
cd AS (SELECT * FROM (SELECT ticker, outstanding, hc.*, row_number() OVER (PARTITION BY ticker ORDER BY total_shares DESC, cusip) AS r FROM co JOIN hc ON lower(issuer) LIKE word || '%') WHERE r <= 5),
pk AS (SELECT ticker, arg_min(outstanding, r) AS outstanding, min(r) AS r, arg_min(cusip, r) AS cusip, arg_min(total_shares, r) AS total_shares FROM (SELECT * FROM cd WHERE outstanding IS NULL OR total_shares <= outstanding * 1.05) GROUP BY ticker),
fm AS (SELECT *, row_number() OVER (PARTITION BY cusip ORDER BY s DESC, family) AS rank FROM (SELECT cusip, family, sum(shares) AS s, sum(value_usd) AS v, count(DISTINCT manager) AS entities FROM lp GROUP BY 1, 2))"""
reg("ownership_by_issuer", "ticker cusip:i total_shares:2 family:i s:2 v:2 entities:i rank:i pct:5", "holdings", """SELECT pk.ticker, fm.cusip, pk.total_shares, family, s, v, entities, rank, (SELECT min(s / o.outstanding * 100) FROM co o WHERE o.ticker = pk.ticker) AS pct FROM pk JOIN fm USING (cusip) WHERE rank <= 15""", ownership, LP + ISSUERS)


def notable(s, d):
    p = latest_positions(s, d)
    book = p.groupBy("manager").agg(F.sum("value_usd").alias("book"))
    h = p.where("manager % 10 = 0").groupBy("cusip", "manager").agg(F.sum("shares").alias("s"), F.sum("value_usd").alias("v")).join(book, "manager")
    w = Window.partitionBy("cusip").orderBy(F.col("v").desc(), "manager")
    return h.select("cusip", "manager", "s", "v", (F.col("s") / (300.0 + F.col("cusip") % 100) * 100).alias("pct_of_company"), (F.col("v") / F.col("book") * 100).alias("pct_of_book"), F.row_number().over(w).alias("rank")).where("rank <= 12")


reg("notable_holders", "cusip:i manager:i s:2 v:2 pct_of_company:5 pct_of_book:5 rank:i", "holdings", """SELECT * FROM (SELECT cusip, manager, s, v, s / (300.0 + cusip % 100) * 100 AS pct_of_company, v / book * 100 AS pct_of_book, row_number() OVER (PARTITION BY cusip ORDER BY v DESC, manager) AS rank FROM
    (SELECT cusip, manager, sum(shares) AS s, sum(value_usd) AS v FROM lp WHERE manager % 10 = 0 GROUP BY 1, 2) JOIN (SELECT manager, sum(value_usd) AS book FROM lp GROUP BY 1) USING (manager)) WHERE rank <= 12""", notable, LP)
reg("ownership_concentration", "quarter:s families:i top1_pct top3_pct top10_pct avg_pct n_over_5:i hhi:8", "holdings", """SELECT quarter, count(*) AS families, sum(s) FILTER (r <= 1) / max(o) * 100 AS top1_pct, sum(s) FILTER (r <= 3) / max(o) * 100 AS top3_pct, sum(s) FILTER (r <= 10) / max(o) * 100 AS top10_pct, avg(s) / max(o) * 100 AS avg_pct, count(*) FILTER (s / o > 0.05) AS n_over_5,
    sum(s * s) / (sum(s) * sum(s)) AS hhi FROM (SELECT *, sum(s) OVER (PARTITION BY quarter) * 2 AS o, row_number() OVER (PARTITION BY quarter ORDER BY s DESC, family) AS r FROM (SELECT quarter, manager % 50 AS family, sum(shares) AS s FROM holdings WHERE putcall = '' GROUP BY 1, 2)) GROUP BY quarter""",
    lambda s, d: (lambda h: X.ownership_concentration(h, "quarter", "family", h.groupBy("quarter").agg((F.sum("shares") * 2).alias("out"))))(V.holdings(s, d).where("putcall = ''").withColumn("family", F.col("manager") % 50)))


def holders_13g(s, d):
    last = V.insider(s, d).where("shares > 0").groupBy("issuer", "owner").agg(F.max(F.struct("filed", "shares")).alias("x")).select("issuer", "owner", F.col("x.shares").alias("s"))
    last = last.withColumn("r", F.row_number().over(Window.partitionBy("issuer").orderBy(F.col("s").desc(), "owner")))
    return last.groupBy("issuer").agg(F.count(F.lit(1)).alias("holders"), F.sum("s").alias("total"), F.max("s").alias("largest"), F.avg("s").alias("mean"), F.sum(F.when(F.col("r") <= 3, F.col("s"))).alias("top3"))


reg("13g_latest_per_holder", "issuer:i holders:i total:2 largest:2 mean top3:2", "insider", """SELECT issuer, count(*) AS holders, sum(s) AS total, max(s) AS largest, avg(s) AS mean, sum(s) FILTER (r <= 3) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY s DESC, owner) AS r FROM (SELECT issuer, owner, max({'f': filed, 's': shares}).s AS s FROM insider WHERE shares > 0 GROUP BY 1, 2)) GROUP BY 1""", holders_13g)
reg("insider_activity", "issuer:i buys:i sells:i buy_value:2 sell_value:2 buy_ratio buyers:i sellers:i officer_net:i director_net:i cluster:i", "insider", """SELECT issuer, count(*) FILTER (code = 'P') AS buys, count(*) FILTER (code = 'S') AS sells, sum(value) FILTER (code = 'P') AS buy_value, sum(value) FILTER (code = 'S') AS sell_value, sum(value) FILTER (code = 'P') / sum(value) AS buy_ratio,
    count(DISTINCT owner) FILTER (code = 'P') AS buyers, count(DISTINCT owner) FILTER (code = 'S') AS sellers, count(*) FILTER (code = 'P' AND is_officer) - count(*) FILTER (code = 'S' AND is_officer) AS officer_net, count(*) FILTER (code = 'P' AND is_director) - count(*) FILTER (code = 'S' AND is_director) AS director_net,
    count(DISTINCT owner) FILTER (code = 'P') >= 3 AS cluster FROM insider GROUP BY issuer""", lambda s, d: X.insider_activity(V.insider(s, d)))
reg("insider_cluster", "issuer:i n_buyers:i n_purchases:i total_value:2 n_officers:i n_directors:i cluster:i", "insider", """SELECT issuer, count(*) AS n_buyers, sum(k) AS n_purchases, sum(v) AS total_value, count(*) FILTER (o) AS n_officers, count(*) FILTER (dr) AS n_directors, count(*) >= 2 AS cluster FROM
    (SELECT issuer, owner, count(*) AS k, sum(value) AS v, bool_or(is_officer) AS o, bool_or(is_director) AS dr FROM insider WHERE code = 'P' AND filed BETWEEN DATE '2000-06-30' - 90 AND DATE '2000-06-30' GROUP BY 1, 2) GROUP BY 1""", lambda s, d: X.insider_cluster(V.insider(s, d), "2000-06-30"))
reg("insider_buys_as_of", "issuer:i filed:s owner:i accession:i shares:2 price:4", "insider", "SELECT DISTINCT issuer, filed, owner, accession, shares, price FROM insider WHERE code = 'P' AND filed BETWEEN DATE '1999-01-01' AND DATE '2000-06-30'",
    lambda s, d: V.insider(s, d).where("code = 'P' and filed between date'1999-01-01' and date'2000-06-30'").select("issuer", "filed", "owner", "accession", "shares", "price").dropDuplicates())


def picks(s, d):
    p = Window.partitionBy("m")
    x = panel(s, d).where("y is not null").withColumn("r", F.row_number().over(p.orderBy(F.col("pred").desc(), "ticker"))).withColumn("n", F.count(F.lit(1)).over(p))
    return x.withColumn("selected", F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).withColumn("win", F.col("y") > 0)


PK = PAN + ", pk AS (SELECT *, r <= greatest(1, floor(n * 0.1)) AS selected, y > 0 AS win FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY pred DESC, ticker) AS r, count(*) OVER (PARTITION BY m) AS n FROM pan WHERE y IS NOT NULL))"
PT = "SELECT base, sel AS selected_rate, sel / base AS lift, (sel - base) / sqrt(base * (1 - base) / n) / sqrt(5) AS t_stat FROM (SELECT avg(CAST(win AS INT)) AS base, avg(CAST(win AS INT)) FILTER (selected) AS sel, count(*) FILTER (selected) AS n FROM pk)"
reg("base_rate_lift", "base selected_rate lift", "bars", PT, lambda s, d: X.proportion_test(picks(s, d), "selected", "win", 5), PK)
reg("proportion_t_stat", "t_stat", "bars", PT, lambda s, d: X.proportion_test(picks(s, d), "selected", "win", 5), PK)


def calibration(s, d):
    """Worst gap of mean forecast and outcome over index deciles; positions come from value bins, not one global sort."""
    x = panel(s, d).where("y is not null").select("ticker", "m", (1 / (1 + F.exp(-20 * F.col("pred")))).alias("p"), (F.col("y") > 0).cast("double").alias("y"))
    from tidemark.functions.ranks import with_rank_stats

    x = with_rank_stats(x, [], "p", prefix="_")
    i = F.col("_n_less") + F.row_number().over(Window.partitionBy("p").orderBy("ticker", "m")) - 1
    g = x.withColumn("dec", X.decile_of(i, F.col("_n"))).groupBy("dec").agg(F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return g.agg(F.coalesce(F.max("gap"), F.lit(1.0)).alias("max_dev"), F.count(F.lit(1)).alias("n_deciles"))


reg("calibration_max_dev", "max_dev n_deciles:i", "bars", """SELECT max(gap) AS max_dev, count(*) AS n_deciles FROM (SELECT dec, abs(avg(p) - avg(y)) AS gap FROM (SELECT p, y, (SELECT max(g) FROM range(10) t(g) WHERE g * n // 10 <= i) AS dec FROM (SELECT p, y, row_number() OVER (ORDER BY p, ticker, m) - 1 AS i, count(*) OVER () AS n FROM
    (SELECT ticker, m, 1 / (1 + exp(-20 * pred)) AS p, CASE WHEN y > 0 THEN 1.0 ELSE 0 END AS y FROM pan WHERE y IS NOT NULL))) GROUP BY dec)""", calibration, PAN)


def study(s, d):
    """Profitable companies against the rest, return from the filing on over 182 days, against the mean of all names."""
    from tidemark.operators.joins import forward_exit

    q = V.quarters(s, d)
    pts = q.select("ticker", F.col("filed").alias("x"))
    r = forward_exit(V.bars(s, d), pts, 182).select("ticker", F.col("x").alias("filed"), "ret")
    e = q.join(r, ["ticker", "filed"]).select("ticker", F.col("period_end").alias("as_of"), "filed", (F.col("net_income") > 0).alias("passed"), "ret", F.when(F.col("n") % 3 == 0, "TURNING").when(F.col("n") % 3 == 1, "BASING").otherwise("RECOVERING").alias("stage"))
    return e.join(e.groupBy("as_of").agg(F.avg("ret").alias("bench")), "as_of")


EV = """ev0 AS (SELECT q.ticker, q.period_end AS as_of, q.net_income > 0 AS passed, CASE q.n % 3 WHEN 0 THEN 'TURNING' WHEN 1 THEN 'BASING' ELSE 'RECOVERING' END AS stage, e.x / e.n0 - 1 AS ret FROM quarters q JOIN
    (SELECT p.ticker, p.filed, arg_min(b.c, b.d) AS n0, arg_min(b.c, b.d) FILTER (b.d >= filed + 182) AS x FROM quarters p JOIN bars b ON b.ticker = p.ticker AND b.d > filed AND b.d <= filed + 192 GROUP BY 1, 2) e ON e.ticker = q.ticker AND e.filed = q.filed WHERE e.x IS NOT NULL),
ev AS (SELECT *, avg(ret) OVER (PARTITION BY as_of) AS bench FROM ev0)"""
ES = """SELECT count(*) AS n_dates, sum(np) AS n_pass, sum(nc) AS n_ctrl, avg(spread) AS mean_spread, avg(spread) / (stddev_samp(spread) / sqrt(count(spread))) AS t_stat, sum(wp) / sum(np) AS passer_win, sum(wc) / sum(nc) AS control_win, (sum(wp) / sum(np)) / (sum(wc) / sum(nc)) AS lift, sum(sp) / sum(np) AS mean_passer, sum(sc) / sum(nc) AS mean_control
    FROM (SELECT as_of, avg(x) FILTER (passed) - avg(x) FILTER (NOT passed) AS spread, count(*) FILTER (passed) AS np, count(*) FILTER (NOT passed) AS nc, count(*) FILTER (passed AND x > 0) AS wp, count(*) FILTER (NOT passed AND x > 0) AS wc, sum(x) FILTER (passed) AS sp, sum(x) FILTER (NOT passed) AS sc
    FROM (SELECT *, ret - bench - 0.0016 AS x FROM ev WHERE {}) GROUP BY as_of)"""
ESC = "n_dates:i n_pass:i n_ctrl:i mean_spread t_stat passer_win control_win lift mean_passer mean_control"
reg("event_study_summary", ESC, "bars quarters", ES.format("true"), lambda s, d: X.event_study(study(s, d), 0.0016), EV)
reg("stage_restricted_summary", ESC, "bars quarters", ES.format("NOT passed OR stage IN ('TURNING', 'RECOVERING')"), lambda s, d: X.event_study(study(s, d).where("not passed or stage in ('TURNING', 'RECOVERING')"), 0.0016), EV)


def recoveries(s, d):
    """Entry at the filing, target 5 % above the first close after it, followed for a year."""
    q = V.quarters(s, d).select("ticker", "filed", (F.col("net_income") > 0).alias("healthy"))
    q = q.withColumn("y", F.explode(F.array(F.year("filed"), F.year("filed") + 1)))  # the only two years a follow-up can touch
    j = q.join(V.bars(s, d).select("ticker", "d", "c", F.year("d").alias("y")), ["ticker", "y"]).where((F.col("d") > F.col("filed")) & (F.col("d") <= F.date_add("filed", 365)))
    g = j.groupBy("ticker", "filed", "healthy").agg(F.min_by("c", "d").alias("entry"), F.sort_array(F.collect_list(F.struct("d", "c"))).alias("p"))
    hit = F.try_element_at(F.filter("p", lambda x: x["c"] >= F.col("entry") * 1.05), F.lit(1))
    g = g.withColumn("hit", hit)
    return g.select("ticker", "filed", "healthy", "entry", F.col("hit").isNotNull().alias("recovered"), F.datediff("hit.d", "filed").alias("days"), (F.array_max(F.transform("p", lambda x: x["c"])) / (F.col("entry") * 1.05)).alias("max_fraction"))


REC = """rc0 AS (SELECT q.ticker, q.filed, q.net_income > 0 AS healthy, b.d, b.c, first_value(b.c) OVER (PARTITION BY q.ticker, q.filed ORDER BY b.d) AS entry FROM quarters q JOIN bars b ON b.ticker = q.ticker AND b.d > q.filed AND b.d <= q.filed + 365),
rec AS (SELECT ticker, filed, healthy, max(entry) AS entry, bool_or(c >= entry * 1.05) AS recovered, min(d) FILTER (c >= entry * 1.05) - filed AS days, max(c) / (max(entry) * 1.05) AS max_fraction FROM rc0 GROUP BY 1, 2, 3)"""
reg("recovery_outcome", "ticker filed:s entry:4 recovered:i days:i max_fraction", "bars quarters", "SELECT * FROM rec", recoveries, REC)
reg("two_proportion_gate", "n_h:i n_c:i rate_h rate_c days_h days_c edge z", "bars quarters", """SELECT n_h, n_c, k_h / n_h AS rate_h, k_c / n_c AS rate_c, days_h, days_c, k_h / n_h - k_c / n_c AS edge, (k_h / n_h - k_c / n_c) / sqrt((k_h + k_c) / (n_h + n_c) * (1 - (k_h + k_c) / (n_h + n_c)) * (1 / n_h + 1 / n_c)) AS z FROM
    (SELECT count(*) FILTER (healthy) AS n_h, count(*) FILTER (NOT healthy) AS n_c, count(*) FILTER (healthy AND recovered) AS k_h, count(*) FILTER (NOT healthy AND recovered) AS k_c, quantile_cont(days, 0.5) FILTER (healthy AND recovered) AS days_h, quantile_cont(days, 0.5) FILTER (NOT healthy AND recovered) AS days_c FROM rec)""",
    lambda s, d: X.two_proportion(recoveries(s, d)), REC)
SK = "(SELECT *, (r - avg(r) OVER p) / stddev_pop(r) OVER p AS z FROM rets WHERE r IS NOT NULL WINDOW p AS (PARTITION BY ticker))"
reg("risk_summary_stats", "ticker annual_return annual_volatility sharpe sortino calmar omega max_drawdown var_95 var_99 cvar_95 cvar_99 tail_ratio skewness excess_kurtosis ulcer_index sterling", "rets", f"""SELECT ticker, ar AS annual_return, av AS annual_volatility, (ar - 0.05) / (av + 1e-10) AS sharpe, (ar - 0.05) / (dn + 1e-10) AS sortino, ar / (abs(mdd) + 1e-10) AS calmar, g / (l + 1e-10) AS omega, mdd AS max_drawdown,
    q5 AS var_95, q1 AS var_99, c5 AS cvar_95, c1 AS cvar_99, abs(q95) / (abs(q5) + 1e-10) AS tail_ratio, sk AS skewness, ku AS excess_kurtosis, ui AS ulcer_index, ar / (abs(coalesce(ad, -0.01)) + 1e-10) AS sterling FROM (SELECT ticker, exp(sum(ln(1 + r)) * 252 / count(*)) - 1 AS ar, stddev_samp(r) * {ANN} AS av, stddev_samp(r) FILTER (r < 0) * {ANN} AS dn, min(dd) AS mdd,
    sum(r) FILTER (r > 0.05 / 252) AS g, abs(sum(r) FILTER (r < 0.05 / 252)) AS l, max(q1) AS q1, max(q5) AS q5, max(q95) AS q95, avg(r) FILTER (r <= q5) AS c5, avg(r) FILTER (r <= q1) AS c1, avg(pow(z, 3)) AS sk, avg(pow(z, 4)) - 3 AS ku, sqrt(avg(dd * dd)) AS ui, avg(dd) FILTER (dd < 0) AS ad FROM
    (SELECT *, nav / max(nav) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + r)) OVER (w ROWS UNBOUNDED PRECEDING)) AS nav FROM {SK} WINDOW w AS (PARTITION BY ticker ORDER BY d)) WINDOW w AS (PARTITION BY ticker ORDER BY d)) JOIN
    (SELECT ticker, quantile_cont(r, 0.01) AS q1, quantile_cont(r, 0.05) AS q5, quantile_cont(r, 0.95) AS q95 FROM rets GROUP BY 1) USING (ticker) GROUP BY ticker)""", lambda s, d: X.risk_summary(rets(s, d)))
reg("performance_report", "ticker annual_return annual_vol sharpe sortino alpha beta r_squared information_ratio tracking_error win_rate avg_win avg_loss profit_factor", "rets mkt", f"""SELECT *, (annual_return - 0.05) / annual_vol AS sharpe, (annual_return - 0.05) / dd AS sortino FROM (SELECT ticker, exp(sum(ln(1 + r)) * 252 / count(*)) - 1 AS annual_return, stddev_samp(r) * {ANN} AS annual_vol,
    stddev_samp(r - 0.05 / 252) FILTER (r < 0.05 / 252) * {ANN} AS dd, regr_slope(r, mr) AS beta, regr_intercept(r - 0.05 / 252, mr - 0.05 / 252) * 252 AS alpha, regr_r2(r, mr) AS r_squared, avg(r - mr) / stddev_samp(r - mr) * {ANN} AS information_ratio, stddev_samp(r - mr) * {ANN} AS tracking_error,
    avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(r) FILTER (r > 0) AS avg_win, avg(r) FILTER (r < 0) AS avg_loss, sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r < 0)) AS profit_factor FROM rets JOIN mkt USING (d) WHERE r IS NOT NULL AND mr IS NOT NULL GROUP BY ticker)""",
    lambda s, d: X.performance_report(rets(s, d).join(market(s, d), "d").where("r is not null and mr is not null")))
reg("trading_risk_sorted", "ticker var_5pct cvar_5pct gap_risk_freq tail_ratio", "rets", """SELECT ticker, max(r) FILTER (i = kk) AS var_5pct, avg(r) FILTER (i <= kk) AS cvar_5pct, avg(CASE WHEN abs(r) > 0.02 THEN 1.0 ELSE 0 END) AS gap_risk_freq, abs(max(r) FILTER (i = floor(0.95 * nn) + 1) / max(r) FILTER (i = floor(0.05 * nn) + 1)) AS tail_ratio FROM
    (SELECT *, greatest(1, floor(0.05 * nn)) AS kk FROM (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY r) AS i, count(*) OVER (PARTITION BY ticker) AS nn FROM rets WHERE r IS NOT NULL)) GROUP BY ticker""", lambda s, d: X.trading_risk(rets(s, d)))
reg("drawdown_risk_stats", "ticker ulcer_index pain_index recovery_factor", "bars", """SELECT ticker, sqrt(avg(dd * dd)) AS ulcer_index, abs(avg(dd)) AS pain_index, (arg_max(c, d) / arg_min(c, d) - 1) / abs(min(dd)) AS recovery_factor FROM (SELECT ticker, d, c, c / max(c) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars) GROUP BY ticker""",
    lambda s, d: X.drawdown_risk(V.bars(s, d)))
reg("deflated_sharpe", "ticker sr dsr", "rets", f"""SELECT ticker, sr, {sql_norm_cdf('zz')} AS dsr FROM (SELECT *, (sr - ((1 - 0.5772156649) * {sql_norm_ppf('(1 - 1 / 20.0)')} + 0.5772156649 * {sql_norm_ppf('(1 - 1 / (20.0 * exp(1)))')}) / sqrt(nn - 1)) / sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / (nn - 1)) AS zz FROM
    (SELECT ticker, count(*) AS nn, (avg(r) - 0.05 / 252) / stddev_samp(r) AS sr, avg(pow(z, 3)) AS sk, avg(pow(z, 4)) AS ku FROM {SK} GROUP BY ticker))""", lambda s, d: X.deflated_sharpe(rets(s, d), 20))


def strategies(s, d):
    """Monthly returns of every region as competing strategies, periods numbered."""
    f = V.factor_returns(s, d, rets(s, d)).groupBy(F.col("f").alias("strategy"), F.last_day("d").alias("m")).agg(F.sum("fr").alias("r"))
    return f.select("strategy", "r", (F.row_number().over(Window.partitionBy("strategy").orderBy("m")) - 1).alias("i"))


reg("pbo_cscv", "pbo logit_mean logit_std n_splits:i", "fret", f"""SELECT avg(CASE WHEN lg < 0 THEN 1.0 ELSE 0 END) AS pbo, avg(lg) AS logit_mean, stddev_pop(lg) AS logit_std, count(*) AS n_splits FROM (SELECT ln(p / (1 - p)) AS lg FROM (SELECT least(greatest(count(*) FILTER (wt > test) / (count(*) - 1), 1e-6), 1 - 1e-6) AS p FROM
    (SELECT y.split, y.test, first_value(test) OVER (PARTITION BY split ORDER BY train DESC, strategy) AS wt FROM (SELECT split, strategy, sum(sh) FILTER (list_contains(tr, s)) / 4 AS train, sum(sh) FILTER (NOT list_contains(tr, s)) / 4 AS test FROM sh, splits GROUP BY 1, 2) y) GROUP BY split))""",
    lambda s, d: X.pbo_cscv(strategies(s, d)), f"""st AS (SELECT f AS strategy, last_day(d) AS m, sum(fr) AS r FROM fret GROUP BY 1, 2), sti AS (SELECT strategy, r, row_number() OVER (PARTITION BY strategy ORDER BY m) - 1 AS i, (SELECT count(DISTINCT m) FROM st) // 8 AS sz FROM st),
sh AS (SELECT strategy, i // sz AS s, avg(r) / (stddev_pop(r) + 1e-10) * {ANN} AS sh FROM sti WHERE i < sz * 8 GROUP BY 1, 2),
splits AS (SELECT m AS split, list_filter(range(8), lambda b: (m >> b) & 1 = 1) AS tr FROM range(256) t(m) WHERE bit_count(CAST(m AS INTEGER)) = 4)""")
reg("psi", "ticker psi", "tails", """SELECT ticker, sum((a - e) * ln(a / e)) AS psi FROM (SELECT ticker, greatest(coalesce(ce, 0) / ne, 1e-6) AS e, greatest(coalesce(ca, 0) / na, 1e-6) AS a FROM (SELECT ticker, bin, ne, na FROM lim, range(10) t(bin)) LEFT JOIN
    (SELECT ticker, CASE WHEN r = hi THEN 9 ELSE CAST(floor((r - lo) / (hi - lo) * 10) AS BIGINT) END AS bin, count(*) FILTER (k >= 100) AS ce, count(*) FILTER (k < 100) AS ca FROM tails JOIN lim USING (ticker) WHERE r BETWEEN lo AND hi GROUP BY 1, 2) USING (ticker, bin)) GROUP BY ticker""",
    lambda s, d: (lambda t: X.psi(t.where("k >= 100"), t.where("k < 100"), "ticker", "r"))(with_tail(rets(s, d)).where("r is not null")),
    "lim AS (SELECT ticker, min(r) FILTER (k >= 100) AS lo, max(r) FILTER (k >= 100) AS hi, count(r) FILTER (k >= 100) AS ne, count(r) FILTER (k < 100) AS na FROM tails GROUP BY 1)")
reg("ks_two_sample", "ticker ks p_value severity:s", "tails", """SELECT ticker, ks, p AS p_value, CASE WHEN p < 0.01 THEN 'HIGH' WHEN p < 0.05 THEN 'MEDIUM' ELSE 'NONE' END AS severity FROM (SELECT ticker, ks, least(greatest(list_sum(list_transform(range(1, 51), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * lam * lam))), 0.0), 1.0) AS p FROM
    (SELECT ticker, max(gap) AS ks, max(gap) * sqrt(max(n1) * max(n2) / (max(n1) + max(n2))) AS lam FROM (SELECT ticker, abs(count(*) FILTER (k < 100) OVER w / count(*) FILTER (k < 100) OVER p - count(*) FILTER (k >= 100) OVER w / count(*) FILTER (k >= 100) OVER p) AS gap, CAST(count(*) FILTER (k < 100) OVER p AS DOUBLE) AS n1, CAST(count(*) FILTER (k >= 100) OVER p AS DOUBLE) AS n2
    FROM tails WHERE r IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY r RANGE UNBOUNDED PRECEDING), p AS (PARTITION BY ticker)) GROUP BY 1))""",
    lambda s, d: X.ks_two_sample(with_tail(rets(s, d)).where("r is not null").withColumn("live", F.col("k") < 100), "ticker", "r", "live"))
reg("shannon_entropy", "ticker entropy", "rets", """SELECT ticker, -sum(p * ln(p)) AS entropy FROM (SELECT ticker, least(floor((r - lo) / (hi - lo) * 20), 19) AS bin, count(*) / max(nn) AS p FROM rets JOIN (SELECT ticker, min(r) AS lo, max(r) AS hi, count(r) AS nn FROM rets GROUP BY 1) USING (ticker) WHERE r IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    lambda s, d: X.return_entropy(rets(s, d)))
reg("validation_price_distribution", "ticker hist_mean hist_std hist_skew hist_kurt tail_neg tail_pos", "tails", f"""SELECT ticker, avg(x) AS hist_mean, stddev_pop(x) AS hist_std, skewness(x) AS hist_skew, kurtosis(x) AS hist_kurt, avg(CASE WHEN x < -0.10 THEN 1.0 ELSE 0 END) AS tail_neg, avg(CASE WHEN x > 0.10 THEN 1.0 ELSE 0 END) AS tail_pos FROM
    (SELECT ticker, k, sum(lr) OVER (w ROWS 20 PRECEDING) AS x, count(lr) OVER (w ROWS 20 PRECEDING) AS n21 FROM tails {W}) WHERE n21 = 21 AND k < 232 GROUP BY ticker HAVING count(*) >= 20""",
    lambda s, d: price_distribution(s, d))


def price_distribution(s, d, h=21, back=252):
    """Moments of overlapping h-day log returns that lie inside the last `back` rows, sample skew and kurtosis."""
    from tidemark.functions.frames import full, with_tail

    x = with_tail(rets(s, d)).withColumn("x", full(F.sum, "lr", h)).where(F.col("k") < back - h + 1).where("x is not null")
    n, sk, ku = F.count(F.lit(1)), F.skewness("x"), F.kurtosis("x")
    g1 = sk * F.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ku + 6)
    g = x.groupBy("ticker").agg(n.alias("n"), F.avg("x").alias("hist_mean"), F.stddev_pop("x").alias("hist_std"), g1.alias("hist_skew"), g2.alias("hist_kurt"), F.avg((F.col("x") < -0.10).cast("double")).alias("tail_neg"), F.avg((F.col("x") > 0.10).cast("double")).alias("tail_pos"))
    return g.where("n >= 20")


def ratings(s, d):
    """Monthly rating counts per instrument, from the line statuses of the month's shipments."""
    li = V.table(s, d, "lineitem")
    k = F.col("l_quantity") % 5
    return li.groupBy(F.col("l_suppkey").alias("ticker"), F.last_day(F.to_date("l_shipdate")).alias("m")).agg(*[F.sum((k == i).cast("int")).alias(f"r{i + 1}") for i in range(5)], F.sum("l_discount").alias("surprise"))


def consensus(s, d):
    n = sum((F.col(f"r{i}") for i in range(1, 6)), F.lit(0))
    sc = sum((F.col(f"r{i}") * i for i in range(1, 6)), F.lit(0)) / n
    x = ratings(s, d).withColumn("n", n).withColumn("score", sc).withColumn("bull", (F.col("r4") + F.col("r5")) / n).withColumn("conviction", sum(((F.col(f"r{i}") / n) ** 2 for i in range(1, 6)), F.lit(0.0)))
    w = Window.partitionBy("ticker").orderBy("m")
    x = x.withColumn("revision", F.col("bull") - F.lag("bull", 3).over(w)).withColumn("delta", F.col("score") - F.lag("score").over(w))
    return x.select("ticker", "m", "n", "score", "bull", "conviction", "revision", F.when(F.col("delta") >= 0.1, 1).when(F.col("delta") <= -0.1, -1).otherwise(0).alias("change"),
                    F.element_at(F.array(*[F.lit(v) for v in ("STRONG SELL", "SELL", "HOLD", "BUY", "STRONG BUY")]), F.greatest(F.lit(1), F.least(F.lit(5), F.bround("score").cast("int")))).alias("label"))


reg("analyst_consensus", "ticker m:s n:i score bull conviction revision change:i label:s", "", """SELECT ticker, m, n, score, bull, conviction, bull - lag(bull, 3) OVER w AS revision, CASE WHEN score - lag(score) OVER w >= 0.1 THEN 1 WHEN score - lag(score) OVER w <= -0.1 THEN -1 ELSE 0 END AS change,
    ['STRONG SELL', 'SELL', 'HOLD', 'BUY', 'STRONG BUY'][greatest(1, least(5, CAST(round_even(score, 0) AS INT)))] AS label FROM (SELECT *, (r1 + 2 * r2 + 3 * r3 + 4 * r4 + 5 * r5) / n AS score, (r4 + r5) / n AS bull, pow(r1 / n, 2) + pow(r2 / n, 2) + pow(r3 / n, 2) + pow(r4 / n, 2) + pow(r5 / n, 2) AS conviction FROM
    (SELECT l_suppkey AS ticker, last_day(CAST(l_shipdate AS DATE)) AS m, count(*) AS n, """ + ", ".join(f"count(*) FILTER (l_quantity % 5 = {i}) AS r{i + 1}" for i in range(5)) + """ FROM lineitem GROUP BY 1, 2)) WINDOW w AS (PARTITION BY ticker ORDER BY m)""", consensus)


def eps(s, d):
    w = Window.partitionBy("ticker").orderBy("period_end")
    return V.quarters(s, d).select("ticker", "period_end", (F.col("net_income") / F.col("shares")).alias("e")).select("ticker", "period_end", F.col("e").alias("eps"), F.lag("e", 4).over(w).alias("eps_prev"), ((F.col("e") - F.lag("e", 4).over(w)) / F.abs(F.lag("e", 4).over(w))).alias("eps_growth"))


reg("eps_history", "ticker period_end:s eps:5 eps_prev:5 eps_growth:5", "quarters", "SELECT ticker, period_end, e AS eps, lag(e, 4) OVER w AS eps_prev, (e - lag(e, 4) OVER w) / abs(lag(e, 4) OVER w) AS eps_growth FROM (SELECT ticker, period_end, net_income / shares AS e FROM quarters) WINDOW w AS (PARTITION BY ticker ORDER BY period_end)", eps)
