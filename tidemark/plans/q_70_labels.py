"""Labels and validation folds with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import full
from tidemark.operators import labels as X
from tidemark.plans.oracle import W, sql_norm_cdf
from tidemark.plans.oracle import full as sfull
from tidemark.plans.q_10_technical import rets
from tidemark.plans.q_30_sources_filters import reg
from tidemark.plans.q_40_joins import spans
from tidemark.plans.q_60_aggregates import PAN, panel
from tidemark.sources import views as V

TB = f"""tb0 AS (SELECT * FROM (SELECT ticker, d, c, {sfull('stddev_samp(r)', 21)} AS vol, list(c) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS pc, list(d) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS pd FROM rets {W}) WHERE vol IS NOT NULL AND len(pc) > 0),
tb1 AS (SELECT *, nullif(list_position(list_transform(pc, lambda x: x >= c * (1 + 1.5 * vol * sqrt(10))), true), 0) AS iu, nullif(list_position(list_transform(pc, lambda x: x <= c * (1 - 1.5 * vol * sqrt(10))), true), 0) AS il FROM tb0),
tb AS (SELECT ticker, d AS t0, pd[coalesce(least(iu, il), len(pc))] AS t1, pc[coalesce(least(iu, il), len(pc))] / c - 1 AS ret, vol, CASE WHEN iu IS NULL AND il IS NULL THEN 'time' WHEN il IS NULL OR iu < il THEN 'profit' ELSE 'stop' END AS barrier FROM tb1),
tbl AS (SELECT *, CASE WHEN abs(ret) < 0.005 THEN 0 WHEN barrier = 'profit' THEN 1 WHEN barrier = 'stop' THEN -1 ELSE 0 END AS label FROM tb)"""
tbar = lambda s, d: X.triple_barrier(rets(s, d), min_ret=0.005)
reg("triple_barrier", "ticker t0:s t1:s ret label:i barrier:s vol", "rets", "SELECT * FROM tbl", tbar, TB)
reg("triple_barrier_log", "ticker d label_5 label_21 label_63 label_252", "rets", f"""SELECT ticker, d, ln(c63 / c) AS label_63, ln(c252 / c) AS label_252, """ + ", ".join(
    f"CASE WHEN u{h} IS NULL AND l{h} IS NULL THEN ln(c{h} / c) WHEN l{h} IS NULL OR u{h} < l{h} THEN 2 * s ELSE -2 * s END AS label_{h}" for h in (5, 21)) + " FROM (SELECT *, " + ", ".join(
    f"nullif(list_position(list_transform(p[1:{h}], lambda x: x >= c * exp(2 * s)), true), 0) AS u{h}, nullif(list_position(list_transform(p[1:{h}], lambda x: x <= c * exp(-2 * s)), true), 0) AS l{h}" for h in (5, 21))
    + f""" FROM (SELECT ticker, d, c, CASE WHEN count(lr) OVER (w ROWS 19 PRECEDING) >= 5 THEN stddev_samp(lr) OVER (w ROWS 19 PRECEDING) END AS s, list(c) OVER (w ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS p,
    lead(c, 5) OVER w AS c5, lead(c, 21) OVER w AS c21, lead(c, 63) OVER w AS c63, lead(c, 252) OVER w AS c252 FROM rets {W}) WHERE s > 0 AND c252 IS NOT NULL)""", lambda s, d: X.log_labels(rets(s, d)))
reg("triple_barrier_touch", "ticker d ret label:i timeout:i", "rets", f"""SELECT ticker, d, p[i] / c - 1 AS ret, CASE WHEN abs(p[i] / c - 1) < 0.1 * t THEN 0 ELSE sign(p[i] / c - 1) END AS label, (iu IS NULL AND il IS NULL) OR i = len(p) AS timeout FROM (SELECT *, coalesce(least(iu, il), len(p)) AS i FROM
    (SELECT *, nullif(list_position(list_transform(p, lambda x: x / c - 1 >= t), true), 0) AS iu, nullif(list_position(list_transform(p, lambda x: x / c - 1 <= -t), true), 0) AS il FROM (SELECT ticker, d, c, {sfull('stddev_samp(r)', 21)} * sqrt(21) AS t,
    list(c) OVER (PARTITION BY ticker ORDER BY k RANGE BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS p FROM (SELECT *, d - DATE '1970-01-01' AS k FROM rets) {W}) WHERE t IS NOT NULL AND len(p) > 0))""", lambda s, d: X.touch_labels(rets(s, d)))
CUS = f"""cu AS (SELECT ticker, rn, d, lr, coalesce({sfull('stddev_samp(r)', 21)}, 0.01) AS h FROM rets {W}),
cz AS (WITH RECURSIVE z(ticker, rn, d, p, n, side) AS (SELECT ticker, rn, d, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0 FROM cu WHERE rn = 1 UNION ALL SELECT q.ticker, q.rn, q.d, CASE WHEN q.pp > q.h THEN 0 ELSE q.pp END, CASE WHEN q.pp <= q.h AND q.nn < -q.h THEN 0 ELSE q.nn END,
    CASE WHEN q.pp > q.h THEN 1 WHEN q.nn < -q.h THEN -1 ELSE 0 END FROM (SELECT cu.ticker, cu.rn, cu.d, cu.h, greatest(0.0, z.p + cu.lr) AS pp, least(0.0, z.n + cu.lr) AS nn FROM z JOIN cu ON cu.ticker = z.ticker AND cu.rn = z.rn + 1) q) SELECT * FROM z)"""
reg("cusum_events", "ticker d side:i", "rets", "SELECT ticker, d, side FROM cz WHERE side <> 0", lambda s, d: X.cusum_events(rets(s, d)), CUS)
reg("forward_labels", "ticker d " + " ".join(f"fwd_{h}" for h in (5, 21, 63, 126, 252)), "bars", "SELECT ticker, d, " + ", ".join(f"ln(lead(c, {h}) OVER w / lead(c, 1) OVER w) - 0.001 AS fwd_{h}" for h in (5, 21, 63, 126, 252)) + f" FROM bars {W}", lambda s, d: X.forward_labels(V.bars(s, d)))
reg("delist_return", "ticker reason:s ret:4", "membership", """SELECT ticker, reason, CASE reason WHEN 'bankruptcy' THEN -0.70 WHEN 'performance' THEN -0.40 WHEN 'acquisition' THEN 0.15 WHEN 'merger' THEN 0.10 WHEN 'voluntary' THEN -0.15 WHEN 'exchange_transfer' THEN 0.0 ELSE -0.30 END AS ret FROM membership""",
    lambda s, d: V.membership(s, d).select("ticker", "reason", X.delist_return(F.col("reason")).alias("ret")))
OC = """oc AS (SELECT o_orderkey, o_orderkey % 7 <> 0 AS reached, ['merged_continues', 'bankrupt', 'acquired_below', 'acquired_premium', 'none', 'none'][CAST(o_custkey % 6 + 1 AS INT)] AS ex, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 60000 END AS xs, o_totalprice / 80000 AS rm, o_orderkey % 3 <> 0 AS ru,
    o_custkey % 13 = 0 AS bk, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_custkey % 20) / 10.0 END AS dl FROM orders)"""
OCS = """select o_orderkey, o_orderkey % 7 <> 0 as reached, element_at(array('merged_continues', 'bankrupt', 'acquired_below', 'acquired_premium', 'none', 'none'), cast(o_custkey % 6 + 1 as int)) as ex, case when o_orderkey % 11 = 0 then null else o_totalprice / 60000 end as xs,
    o_totalprice / 80000 as rm, o_orderkey % 3 <> 0 as ru, o_custkey % 13 = 0 as bk, case when o_orderkey % 5 = 0 then null else (o_custkey % 20) / 10D end as dl from {o}"""
reg("outcome_labeler", "o_orderkey:i label:s", "", """SELECT o_orderkey, CASE WHEN NOT reached THEN 'CENSORED' WHEN ex = 'merged_continues' THEN 'FOLLOW_SUCCESSOR' WHEN ex IN ('bankrupt', 'acquired_below') THEN 'NON_WINNER' WHEN ex = 'acquired_premium' THEN CASE WHEN coalesce(xs >= 3, false) THEN 'WINNER' ELSE 'NON_WINNER' END
    WHEN coalesce(xs >= 3, false) AND rm >= 2 AND ru AND NOT bk AND coalesce(dl <= 1.0, true) THEN 'WINNER' ELSE 'NON_WINNER' END AS label FROM oc""",
    lambda s, d: s.sql(OCS, o=V.table(s, d, "orders")).select("o_orderkey", X.outcome_label(*[F.col(c) for c in ("reached", "ex", "xs", "rm", "ru", "bk", "dl")]).alias("label")), OC)


def primary(s, d):
    """Direction of the last five returns at every event, 0 inside half a percent."""
    sig = rets(s, d).select("ticker", F.col("d").alias("t0"), full(F.sum, "r", 5).alias("m5"))
    return tbar(s, d).join(sig, ["ticker", "t0"]).withColumn("side", F.when(F.col("m5") > 0.005, 1).when(F.col("m5") < -0.005, -1).otherwise(0))


MT = TB + f", mt AS (SELECT tbl.*, CASE WHEN m5 > 0.005 THEN 1 WHEN m5 < -0.005 THEN -1 ELSE 0 END AS side FROM tbl JOIN (SELECT ticker, d AS t0, {sfull('sum(r)', 5)} AS m5 FROM rets {W}) USING (ticker, t0))"
reg("meta_labels", "ticker t0:s side:i meta:i meta_strict:i", "rets", "SELECT ticker, t0, side, CASE WHEN side = sign(label) THEN 1 ELSE 0 END AS meta, CASE WHEN side = sign(ret) AND abs(ret) > 0.005 THEN 1 ELSE 0 END AS meta_strict FROM mt WHERE side <> 0",
    lambda s, d: primary(s, d).where("side <> 0").select("ticker", "t0", "side", (F.col("side") == F.signum("label")).alias("meta"), ((F.col("side") == F.signum("ret")) & (F.abs("ret") > 0.005)).alias("meta_strict")), MT)
reg("bet_size", "event_id:i size", "", f"SELECT event_id, least(greatest(2 * {sql_norm_cdf('z')} - 1, 0.0), 1.0) AS size FROM (SELECT event_id, (q - 0.5) / sqrt(q * (1 - q)) AS z FROM (SELECT event_id, least(greatest(value / 100, 0.001), 0.999) AS q FROM events))",
    lambda s, d: V.table(s, d, "events").select("event_id", X.bet_size(F.col("value") / 100).alias("size")))
UQ = """sp AS (SELECT ticker, d AS t0, d + CAST(n * 7 + 3 AS INTEGER) AS t1 FROM bars), oc AS (SELECT b.ticker, b.d, count(*) AS o FROM bars b JOIN sp ON sp.ticker = b.ticker AND b.d BETWEEN t0 AND t1 GROUP BY 1, 2),
uq AS (SELECT sp.ticker, t0, t1, 1 / greatest(avg(o), 1.0) AS tb_weight, avg(1.0 / o) AS ma_weight FROM sp JOIN oc ON oc.ticker = sp.ticker AND oc.d BETWEEN t0 AND t1 GROUP BY 1, 2, 3)"""
uniq = lambda s, d: (lambda b: X.uniqueness(spans(b), b))(V.bars(s, d))
reg("uniqueness_weights", "ticker t0:s t1:s tb_weight ma_weight", "bars", "SELECT * FROM uq", uniq, UQ)
reg("time_decay_weights", "ticker t0:s decayed", "bars", """SELECT ticker, t0, x / avg(x) OVER (PARTITION BY ticker) AS decayed FROM (SELECT ticker, t0, greatest(0.0, 1 - 0.5 / tot * tot + 0.5 / tot * cw) AS x FROM (SELECT ticker, t0, sum(tb_weight) OVER (PARTITION BY ticker ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS cw, sum(tb_weight) OVER (PARTITION BY ticker) AS tot FROM uq))""",
    lambda s, d: X.time_decay(uniq(s, d), "tb_weight", "t0", 0.5), UQ)
reg("drop_rare_labels", "ticker t0:s label:i", "rets", "SELECT ticker, t0, label FROM tbl WHERE label IN (SELECT label FROM tbl GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM tbl) >= 0.31)", lambda s, d: X.drop_rare(tbar(s, d), 0.31), TB)
CAL = "cal AS (SELECT i, n, least(i + 21, n - 1) AS t1 FROM (SELECT row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)))"
cal = lambda s, d: X.numbered(V.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("d")))
reg("purged_kfold", "fold:i i:i role:s form:s", "", """SELECT fold, i, CASE WHEN i >= lo AND i < hi THEN 'test' ELSE 'train' END AS role, form FROM (SELECT 'as_coded' AS form, i, n, t1, fold, CAST(floor((n - 1) * fold / 5) AS BIGINT) AS lo, CAST(floor((n - 1) * (fold + 1) / 5) AS BIGINT) AS hi, CAST(floor(n * 0.01) AS BIGINT) AS e FROM cal, range(5) t(fold)
    UNION ALL SELECT 'overlap', i, n, t1, fold, n // 5 * fold, CASE WHEN fold = 4 THEN n ELSE n // 5 * (fold + 1) END, CAST(floor(n * 0.01) AS BIGINT) FROM cal, range(5) t(fold))
    WHERE (i >= lo AND i < hi) OR (form = 'as_coded' AND NOT (t1 >= lo OR (i > hi AND i < hi + e))) OR (form = 'overlap' AND NOT ((t1 >= lo AND i <= hi - 1) OR (i >= hi AND i < hi + e)))""",
    lambda s, d: X.purged_kfold(cal(s, d)).withColumn("form", F.lit("as_coded")).unionByName(X.purged_kfold(cal(s, d), as_coded=False).withColumn("form", F.lit("overlap"))), CAL)
reg("combinatorial_purged", "combo:i i:i role:s", "", """SELECT combo, i, role FROM (SELECT *, count(*) FILTER (role = 'train') OVER (PARTITION BY combo) AS k FROM (SELECT combo, i, CASE WHEN i // sz IN (a, b) AND i < sz * 6 THEN 'test' WHEN NOT (t1 >= a * sz OR (i > (b + 1) * sz - 1 AND i <= (b + 1) * sz - 1 + CAST(floor(n * 0.01) AS BIGINT))) THEN 'train' END AS role FROM
    (SELECT *, n // 6 AS sz FROM cal), (SELECT row_number() OVER (ORDER BY a, b) - 1 AS combo, a, b FROM range(6) x(a), range(6) y(b) WHERE a < b)) WHERE role IS NOT NULL) WHERE k >= 50""", lambda s, d: X.combinatorial_purged(cal(s, d)), CAL)
reg("walk_forward_split", "fold:i i:i role:s", "", """SELECT fold, i, CASE WHEN i >= lo AND i < hi THEN 'test' ELSE 'train' END AS role FROM (SELECT i, fold, 40 + fold * ((n - 40) // 5) AS lo, CASE WHEN fold = 4 THEN n ELSE 40 + (fold + 1) * ((n - 40) // 5) END AS hi FROM cal, range(5) t(fold)) WHERE (i >= lo AND i < hi) OR i < lo - 5""",
    lambda s, d: X.walk_forward(cal(s, d)), CAL)
reg("winsor_impute", "ticker m:s pred y pred_z y_z", "bars", """SELECT ticker, m, coalesce(pred, mp) AS pred, coalesce(y, my) AS y, least(greatest((coalesce(pred, mp) - ap) / sp, -5.0), 5.0) AS pred_z, least(greatest((coalesce(y, my) - ay) / sy, -5.0), 5.0) AS y_z FROM pan, (SELECT avg(pred) AS ap, stddev_samp(pred) AS sp, avg(y) AS ay, stddev_samp(y) AS sy FROM pan),
    (SELECT max(pred) FILTER (i = n // 2) AS mp FROM (SELECT pred, row_number() OVER (ORDER BY pred) - 1 AS i, count(*) OVER () AS n FROM pan)), (SELECT max(y) FILTER (i = n // 2) AS my FROM (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i, count(*) OVER () AS n FROM pan WHERE y IS NOT NULL))""",
    lambda s, d: X.median_impute(panel(s, d), ["pred", "y"]), PAN)


def validations(s, d):
    """One validation block per customer segment and order year."""
    o, c = V.table(s, d, "orders"), V.table(s, d, "customer")
    g = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("a"), F.stddev_samp("o_totalprice").alias("sd"), F.count(F.lit(1)).alias("n"))
    return g.select("c_mktsegment", "y", F.when(F.col("y") % 4 == 0, "").otherwise("link").alias("mechanism"), (F.col("n") % 5 != 0).alias("cost_survived"), (F.col("a") / 180000).alias("lift"), (F.col("a") / F.col("sd") * 2).alias("t_stat"), ((F.col("n") % 20) / 100.0).alias("calibration_max_dev"), (F.col("n") % 4).alias("n_regimes_passed"))


VAL = """va AS (SELECT c_mktsegment, y, CASE WHEN y % 4 = 0 THEN '' ELSE 'link' END AS mech, n % 5 <> 0 AS cs, a / 180000 AS lift, a / sd * 2 AS t, (n % 20) / 100.0 AS cal, n % 4 AS nr FROM (SELECT c_mktsegment, year(o_orderdate) AS y, avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS sd, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)),
gate AS (SELECT *, array_to_string(list_filter([CASE WHEN mech = '' THEN 'no_mechanism' END, CASE WHEN NOT cs THEN 'costs' END, CASE WHEN lift < 1.0 THEN 'lift' END, CASE WHEN t < 3 THEN 't_stat' END, CASE WHEN cal > 0.1 THEN 'calibration' END, CASE WHEN nr < 2 THEN 'regimes' END], lambda x: x IS NOT NULL), ',') AS reasons FROM va)"""
gate = lambda s, d: X.promotion_gate(validations(s, d), lift=1.0)
reg("promotion_gate", "c_mktsegment:s y:i reasons:s passed:i", "", "SELECT *, reasons = '' AS passed FROM gate", gate, VAL)
reg("failure_log", "c_mktsegment:s n_failures:i last_year:i", "", "SELECT c_mktsegment, count(*) AS n_failures, max(y) AS last_year FROM gate WHERE reasons <> '' GROUP BY 1", lambda s, d: gate(s, d).where("not passed").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_failures"), F.max("y").alias("last_year")), VAL)


def oos(s, d):
    """Mean next-month return of the top decile over all names, before and after the split date, and what share is kept."""
    p = Window.partitionBy("m")
    x = panel(s, d).where("y is not null").withColumn("r", F.row_number().over(p.orderBy(F.col("pred").desc(), "ticker"))).withColumn("n", F.count(F.lit(1)).over(p)).withColumn("ex", F.col("y") - F.avg("y").over(p))
    t = x.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).groupBy("m").agg(F.avg("ex").alias("ex"))
    tr = F.col("m") < F.lit("1999-06-30").cast("date")
    return t.agg(F.avg(F.when(tr, F.col("ex"))).alias("train"), F.avg(F.when(~tr, F.col("ex"))).alias("test")).withColumn("retention", F.col("test") / F.col("train"))


reg("out_of_sample_compare", "train test retention", "bars", "SELECT *, test / train AS retention FROM (SELECT avg(ex) FILTER (m < DATE '1999-06-30') AS train, avg(ex) FILTER (m >= DATE '1999-06-30') AS test FROM (SELECT m, avg(ex) AS ex FROM (SELECT m, y - avg(y) OVER (PARTITION BY m) AS ex, row_number() OVER (PARTITION BY m ORDER BY pred DESC, ticker) AS r, count(*) OVER (PARTITION BY m) AS n FROM pan WHERE y IS NOT NULL) WHERE r <= greatest(1, floor(n * 0.1)) GROUP BY m))",
    oos, PAN)
