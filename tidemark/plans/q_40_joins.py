"""Joins with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import with_returns
from tidemark.operators import joins as J
from tidemark.plans.oracle import with_views
from tidemark.plans.q_10_technical import market, rets
from tidemark.plans.q_30_sources_filters import QREV, reg
from tidemark.plans.registry import query
from tidemark.sources import stores as S
from tidemark.sources import views as V


def filings(s, d):
    return V.facts(s, d).where("metric = 'revenue' and fp <> 'FY'").select(F.col("cik").alias("ticker"), "filed", "val")


FIL = "fil AS (SELECT cik AS ticker, filed, max(val) AS val FROM facts WHERE metric = 'revenue' AND fp <> 'FY' GROUP BY 1, 2)"
reg("asof_latest_filed", "ticker d c:4 val:2 filed:s", "bars facts", "SELECT b.ticker, b.d, b.c, f.val, f.filed FROM bars b ASOF LEFT JOIN fil f ON b.ticker = f.ticker AND b.d >= f.filed",
    lambda s, d: J.asof_join(V.bars(s, d).select("ticker", "d", "c"), filings(s, d), "ticker", "d", "filed", ["val", "filed"]), FIL)
reg("asof_knowable_annual", "cik:i fy:i revenue:2 net_income:2 assets:2", "facts", """SELECT cik, year("end") AS fy, max(val) FILTER (metric = 'revenue') AS revenue, max(val) FILTER (metric = 'net_income') AS net_income,
    max(val) FILTER (metric = 'assets') AS assets FROM facts WHERE fp = 'FY' AND filed <= DATE '1999-12-31' GROUP BY 1, 2""",
    lambda s, d: V.facts(s, d).where("fp = 'FY' and filed <= date'1999-12-31'").groupBy("cik", F.year("end").alias("fy")).pivot("metric", ["revenue", "net_income", "assets"]).agg(F.max("val")))


def points(s, d):
    return V.quarters(s, d).select("ticker", F.col("filed").alias("x"))


for name, lo, hi, agg, fn in (("asof_on_or_after_slip", "x", "x + 10", "arg_min", J.close_on_or_after), ("asof_on_or_before_slip", "x - 10", "x", "arg_max", J.close_on_or_before)):
    query(name, "ticker x:s c:4", with_views("bars quarters", f"""SELECT p.ticker, p.x, {agg}(b.c, b.d) AS c FROM (SELECT ticker, filed AS x FROM quarters) p LEFT JOIN bars b ON b.ticker = p.ticker
        AND b.d BETWEEN {lo} AND {hi} GROUP BY 1, 2"""))(lambda s, d, fn=fn: fn(V.bars(s, d), points(s, d)))


def weekly_ranks(s, d):
    """Rank of every ticker by close in each weekly snapshot; a snapshot holds one row per instrument."""
    w = Window.partitionBy("scan_time").orderBy(F.col("c").desc(), "ticker")
    snap = V.bars(s, d).groupBy("ticker", F.to_date(F.date_trunc("week", "d")).alias("scan_time")).agg(F.max_by("c", "d").alias("c"))
    return snap.withColumn("rank", F.row_number().over(w))


RANKS = """wk AS (SELECT ticker, CAST(date_trunc('week', d) AS DATE) AS scan_time, arg_max(c, d) AS c FROM bars GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY scan_time ORDER BY c DESC, ticker) AS rank FROM wk), top AS (SELECT max(scan_time) AS t FROM rk)"""


def rank_history(ranks, board_only=False):
    """Newest rank per ticker and its change against the last snapshot at or before 3, 7 and 30 days ago.
    All look-backs come out of one aggregation over the snapshots."""
    x = ranks.crossJoin(ranks.agg(F.max("scan_time").alias("t")))
    now = F.max_by("rank", "scan_time")
    back = {k: F.max_by("rank", F.when(F.col("scan_time") <= F.date_sub("t", k), F.col("scan_time"))) for k in (3, 7, 30)}
    g = x.groupBy("ticker").agg(F.max(F.when(F.col("scan_time") == F.col("t"), F.col("rank"))).alias("rank") if board_only else now.alias("rank"),
                                *[v.alias(f"prev_{k}d") for k, v in back.items()], F.min("scan_time").alias("first_seen"), F.max("t").alias("t"))
    g = g.select("*", *[(F.col(f"prev_{k}d") - F.col("rank")).alias(f"change_{k}d") for k in back])
    return g.where("rank is not null")


HIST = """h AS (SELECT ticker, arg_max(rank, scan_time) AS rank_any, max(rank) FILTER (scan_time = t) AS rank_now, arg_max(rank, scan_time) FILTER (scan_time <= t - 3) AS p3, arg_max(rank, scan_time) FILTER (scan_time <= t - 7) AS p7,
    arg_max(rank, scan_time) FILTER (scan_time <= t - 30) AS p30, min(scan_time) AS first_seen, max(t) AS t FROM rk, top GROUP BY 1)"""
reg("asof_rank_history", "ticker rank:i change_3d:i change_7d:i change_30d:i", "bars", "SELECT ticker, rank_any AS rank, p3 - rank_any AS change_3d, p7 - rank_any AS change_7d, p30 - rank_any AS change_30d FROM h",
    lambda s, d: rank_history(weekly_ranks(s, d)), RANKS + ", " + HIST)
reg("leaderboard_with_deltas", "ticker rank:i change_3d:i change_7d:i change_30d:i is_new:i", "bars", """SELECT ticker, rank_now AS rank, p3 - rank_now AS change_3d, p7 - rank_now AS change_7d, p30 - rank_now AS change_30d, first_seen >= t - 7 AS is_new
    FROM h WHERE rank_now IS NOT NULL ORDER BY rank LIMIT 25""",
    lambda s, d: rank_history(weekly_ranks(s, d), True).withColumn("is_new", F.col("first_seen") >= F.date_sub("t", 7)).orderBy("rank").limit(25), RANKS + ", " + HIST)


def shifted(s, d):
    return V.quarters(s, d).select("ticker", F.date_add("period_end", (F.col("ticker") % 60).cast("int")).alias("pe"))


reg("nearest_within_tolerance", "ticker pe:s nearest_val:2 gap_days:i matched:s", "facts", """SELECT p.ticker, p.pe, m.b.v AS nearest_val, m.b.g AS gap_days, m.b.e AS matched FROM p LEFT JOIN
    (SELECT p.ticker, p.pe, min({'g': abs(p.pe - e."end"), 'e': e."end", 'v': e.val}) AS b FROM p JOIN er e ON e.cik = p.ticker AND abs(p.pe - e."end") <= 45 GROUP BY 1, 2) m ON m.ticker = p.ticker AND m.pe = p.pe""",
    lambda s, d: J.nearest_within(shifted(s, d), S.quarterly_series(V.facts(s, d), "revenue").withColumnRenamed("cik", "ticker"), "ticker", "pe", "end", "val"),
    f"er AS ({QREV}), p AS (SELECT ticker, period_end + CAST(ticker % 60 AS INTEGER) AS pe FROM quarters)")
reg("year_ago_match", "cik:i end:s val:2 prior:2 growth prior_last:2", "facts", """SELECT a.cik, a."end", a.val, m.b.v AS prior, a.val / m.b.v - 1 AS growth, m.l.v AS prior_last FROM er a LEFT JOIN
    (SELECT a.cik, a."end", min({'g': abs(a."end" - 365 - b."end"), 'e': b."end", 'v': b.val}) FILTER (abs(a."end" - 365 - b."end") <= 45) AS b, max({'e': b."end", 'v': b.val}) FILTER (abs(a."end" - 365 - b."end") <= 90) AS l
    FROM er a JOIN er b ON a.cik = b.cik AND b."end" < a."end" GROUP BY 1, 2) m ON m.cik = a.cik AND m."end" = a."end" """,
    lambda s, d: (lambda q: J.year_ago(J.year_ago(q, "cik", "end", "val", 90, True).withColumnRenamed("prior", "prior_last").drop("prior_end"), "cik", "end", "val", 45)
                  .withColumn("growth", F.col("val") / F.col("prior") - 1))(S.quarterly_series(V.facts(s, d), "revenue")), f"er AS ({QREV})")
reg("forward_exit_join", "ticker x:s entry:4 exit:4 ret", "bars quarters", """SELECT *, exit / entry - 1 AS ret FROM (SELECT p.ticker, p.x, arg_min(b.c, b.d) AS entry, arg_min(b.c, b.d) FILTER (b.d >= x + 182) AS exit FROM
    (SELECT ticker, filed AS x FROM quarters) p JOIN bars b ON b.ticker = p.ticker AND b.d > x AND b.d <= x + 192 GROUP BY 1, 2) WHERE exit IS NOT NULL""", lambda s, d: J.forward_exit(V.bars(s, d), points(s, d), 182))
reg("forward_return_bars", "ticker d fwd_21 fwd_63", "bars", """SELECT ticker, d, lead(c, 22) OVER w / lead(c, 1) OVER w - 1 AS fwd_21, lead(c, 64) OVER w / lead(c, 1) OVER w - 1 AS fwd_63 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)""",
    lambda s, d: (lambda w: V.bars(s, d).select("ticker", "d", *[(F.lead("c", n + 1).over(w) / F.lead("c", 1).over(w) - 1).alias(f"fwd_{n}") for n in (21, 63)]))(Window.partitionBy("ticker").orderBy("d")))
reg("semi_join_universe", "ticker d c:4", "bars", "SELECT ticker, d, c FROM bars WHERE ticker IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    lambda s, d: V.bars(s, d).join(V.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker")), "ticker", "left_semi"))
reg("anti_join_unprocessed", "ticker market_cap:2", "universe edges", """SELECT ticker, market_cap FROM universe WHERE ticker NOT IN (SELECT src FROM edges WHERE tier = 2 AND weight > 0.062) ORDER BY market_cap DESC NULLS LAST, ticker LIMIT 400""",
    lambda s, d: V.universe(s, d).join(V.edges(s, d).where("tier = 2 and weight > 0.062").select(F.col("src").alias("ticker")), "ticker", "left_anti")
    .orderBy(F.col("market_cap").desc_nulls_last(), "ticker").limit(400))


def aligned(s, d):
    g = rets(s, d).join(market(s, d), "d").where("r is not null and mr is not null").groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("r", "mr").alias("b"), F.regr_intercept("r", "mr").alias("a"), F.regr_r2("r", "mr").alias("r2"))
    ok = F.col("n") >= 30
    return g.select("ticker", "n", F.when(ok, F.col("b")).otherwise(1.0).alias("beta"), F.when(ok, F.col("a") * 252).otherwise(0.0).alias("alpha"), F.when(ok, F.col("r2")).otherwise(0.0).alias("r_squared"))


reg("inner_aligned_returns", "ticker n:i beta alpha r_squared", "rets mkt", """SELECT ticker, count(*) AS n, CASE WHEN count(*) >= 30 THEN regr_slope(r, mr) ELSE 1 END AS beta, CASE WHEN count(*) >= 30 THEN regr_intercept(r, mr) * 252 ELSE 0 END AS alpha,
    CASE WHEN count(*) >= 30 THEN regr_r2(r, mr) ELSE 0 END AS r_squared FROM rets JOIN mkt USING (d) WHERE r IS NOT NULL AND mr IS NOT NULL GROUP BY ticker""", aligned)


def by_sector(s, d):
    sup, nat, reg_ = (V.table(s, d, t) for t in ("supplier", "nation", "region"))
    dim = sup.join(nat, sup.s_nationkey == nat.n_nationkey).join(reg_, nat.n_regionkey == reg_.r_regionkey).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("bucket"))
    return with_returns(V.bars(s, d)).join(dim, "ticker").groupBy("bucket", "d").agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("n"))


reg("broadcast_dimension", "bucket:s d mean_r n:i", "rets", "SELECT r_name AS bucket, d, avg(r) AS mean_r, count(*) AS n FROM rets JOIN supplier ON ticker = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", by_sector)
PAIR = """px AS (SELECT b.ticker, b.d, b.c, a.c AS bc, m.c AS mc FROM bars b JOIN bars a ON a.ticker = 1 AND a.d = b.d JOIN bench m ON m.d = b.d WHERE b.ticker <> 1),
pr AS (SELECT ticker, ln(c / lag(c) OVER w) AS y, ln(bc / lag(bc) OVER w) AS x, ln(mc / lag(mc) OVER w) AS m FROM px WINDOW w AS (PARTITION BY ticker ORDER BY d)),
ps AS (SELECT ticker, count(*) AS days, corr(x, y) AS correlation, corr(x, m) AS rxm, corr(y, m) AS rym, covar_samp(x, y) / var_pop(x) AS beta_to_base FROM pr WHERE y IS NOT NULL GROUP BY 1),
pp AS (SELECT ticker, days, correlation, (correlation - rxm * rym) / sqrt((1 - rxm * rxm) * (1 - rym * rym)) AS residual_correlation, beta_to_base FROM ps WHERE days >= 59)"""


def pair(s, d):
    b = V.bars(s, d)
    return J.base_pair_stats(b, 1, V.bench(b), 60)


reg("pairwise_self_join", "ticker days:i correlation residual_correlation beta_to_base", "bars bench", "SELECT * FROM pp", pair, PAIR)
reg("pair_correlation", "ticker days:i correlation residual_correlation beta_to_base same_region:i", "bars bench", """SELECT pp.*, n_regionkey = (SELECT n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1) AS same_region
    FROM pp JOIN supplier ON s_suppkey = ticker JOIN nation ON s_nationkey = n_nationkey""", lambda s, d: with_region(s, d, pair(s, d)), PAIR)


def with_region(s, d, df):
    sup, nat = V.table(s, d, "supplier"), V.table(s, d, "nation")
    m = sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(F.col("s_suppkey").alias("ticker"), "n_regionkey")
    base = m.where("ticker = 1").select(F.col("n_regionkey").alias("base_region"))
    return df.join(m, "ticker").crossJoin(base).withColumn("same_region", F.col("n_regionkey") == F.col("base_region"))


def movers(s, d):
    """Three cuts of one ranking: highest 15, lowest 6, highest 10 of other regions. The peer list is one row per instrument."""
    x = with_region(s, d, pair(s, d)).select("ticker", "correlation", "same_region")
    cut = lambda df, o, n, k: df.orderBy(o, "ticker").limit(n).withColumn("cut", F.lit(k))
    hi = F.col("correlation").desc()
    return cut(x, hi, 15, "movers").unionByName(cut(x, F.col("correlation").asc(), 6, "inverse")).unionByName(cut(x.where("not same_region"), hi, 10, "cross"))


reg("movers_inverse_cross", "ticker correlation cut:s", "bars bench", """SELECT * FROM (SELECT ticker, correlation, 'movers' AS cut FROM pr2 ORDER BY correlation DESC, ticker LIMIT 15) UNION ALL SELECT * FROM (SELECT ticker, correlation, 'inverse' FROM pr2 ORDER BY correlation, ticker LIMIT 6)
    UNION ALL SELECT * FROM (SELECT ticker, correlation, 'cross' FROM pr2 WHERE NOT same ORDER BY correlation DESC, ticker LIMIT 10)""", movers,
    PAIR + """, pr2 AS (SELECT pp.*, n_regionkey = (SELECT n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1) AS same FROM pp JOIN supplier ON s_suppkey = ticker JOIN nation ON s_nationkey = n_nationkey)""")


def spans(b):
    return b.select("ticker", F.col("d").alias("t0"), F.date_add("d", (F.col("n") * 7 + 3).cast("int")).alias("t1"))


reg("interval_overlap_join", "ticker d open_spans:i", "bars", """SELECT b.ticker, b.d, count(*) AS open_spans FROM bars b JOIN bars e ON e.ticker = b.ticker AND b.d BETWEEN e.d AND e.d + CAST(e.n * 7 + 3 AS INTEGER) GROUP BY 1, 2""",
    lambda s, d: (lambda b: J.concurrency(spans(b), b))(V.bars(s, d)))


def turnover(h):
    """Sum of absolute weight changes between consecutive quarters, missing = 0. Each weight is sent to its own quarter
    with + and to the next with -, so old and new holdings meet in one aggregation."""
    q = h.where("putcall = ''").groupBy("quarter", "cusip").agg(F.sum("value_usd").alias("v"))
    tot = q.groupBy("quarter").agg(F.sum("v").alias("t"))
    w = q.join(tot, "quarter").withColumn("w", F.col("v") / F.col("t"))
    nxt = F.last_day(F.add_months("quarter", 3))
    x = w.select("cusip", F.explode(F.array(F.struct(F.col("quarter").alias("q"), F.col("w").alias("w")), F.struct(nxt.alias("q"), (-F.col("w")).alias("w")))).alias("e"))
    g = x.groupBy(F.col("e.q").alias("quarter"), "cusip").agg(F.sum("e.w").alias("dw"))
    return g.groupBy("quarter").agg(F.sum(F.abs("dw")).alias("turnover"), F.count(F.lit(1)).alias("n_names"))


reg("full_outer_weights", "quarter:s turnover n_names:i", "holdings", """SELECT coalesce(a.quarter, last_day(b.quarter + INTERVAL 3 MONTH)) AS quarter, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover, count(*) AS n_names FROM hw a FULL JOIN hw b
    ON a.cusip = b.cusip AND a.quarter = last_day(b.quarter + INTERVAL 3 MONTH) GROUP BY 1""", lambda s, d: turnover(V.holdings(s, d)),
    "hw AS (SELECT quarter, cusip, v / sum(v) OVER (PARTITION BY quarter) AS w FROM (SELECT quarter, cusip, sum(value_usd) AS v FROM holdings WHERE putcall = '' GROUP BY 1, 2))")
PEER = """pk AS (SELECT ticker, bucket, sic_code, CASE WHEN bucket = 'Other' THEN NULL WHEN count(*) OVER (PARTITION BY bucket, substr(sic_code, 1, 4)) >= 4 THEN '4:' || sic_code WHEN count(*) OVER (PARTITION BY bucket, substr(sic_code, 1, 3)) >= 8 THEN '3:' || substr(sic_code, 1, 3)
    WHEN count(*) OVER (PARTITION BY bucket, substr(sic_code, 1, 2)) >= 8 THEN '2:' || substr(sic_code, 1, 2) ELSE 'b:' || bucket END AS peer_key FROM universe)"""
reg("peer_group_narrowing", "ticker bucket:s sic_code:s peer_key:s", "universe", "SELECT * FROM pk", lambda s, d: J.peer_group(V.universe(s, d)), PEER)
SH = "(length(dst) % 7 - 3) / 100.0"
reg("network_edge_join", "src:i momentum n_edges:i top_neighbour:s", "edges", f"""SELECT src, sum(c) AS momentum, count(*) AS n_edges, max({{'a': abs(c), 'd': dst}}).d AS top_neighbour FROM (SELECT src, dst, {SH} * weight * CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0 END AS c
    FROM edges WHERE confirmed AND weight >= 0.04) GROUP BY src""", lambda s, d: (lambda e: J.network_momentum(e, e.select("dst").distinct().withColumn("shock", (F.length("dst") % 7 - 3) / 100.0), floor=0.04))(V.edges(s, d)))
KEYED = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '{J.NAME_SUFFIXES}', '', 'g'), '[^a-z0-9 ]', '', 'g'))"
LISTED = "p_name || CASE p_partkey % 3 WHEN 0 THEN ' ' || p_type || ' Corp' WHEN 1 THEN ' Technologies, Inc.' ELSE ' ' || substr(p_brand, 7) || ' Group' END"
SAID = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' Holdings' WHEN 1 THEN p_name || ' ' || p_type || ' of Ohio, Inc.' WHEN 2 THEN split_part(p_name, ' ', 2) || ' Ltd.' WHEN 3 THEN p_name || ' ' || p_type || 'S' ELSE substr(p_name, 1, length(p_name) - 1) END"
NAMES = f"""un AS (SELECT p_partkey AS ticker, {KEYED(LISTED)} AS k FROM part WHERE p_partkey % 7 = 0), wn AS (SELECT k, min(ticker) AS t FROM un WHERE length(k) >= 4 GROUP BY k),
fw AS (SELECT split_part(k, ' ', 1) AS k, min(ticker) AS t FROM un WHERE length(split_part(k, ' ', 1)) >= 5 GROUP BY 1 HAVING count(*) = 1), ix AS (SELECT * FROM wn UNION ALL SELECT * FROM fw WHERE k NOT IN (SELECT k FROM wn)),
mn AS (SELECT p_partkey AS id, {KEYED(SAID)} AS k FROM part), mw AS (SELECT id, k, list_filter(string_split(k, ' '), lambda w: w <> '') AS w FROM mn),
ru AS (SELECT id, arg_max(t, n) AS t FROM (SELECT id, n, array_to_string(w[1:n], ' ') AS head FROM mw, (SELECT unnest(range(1, 12)) AS n) WHERE n <= len(w)) JOIN ix ON ix.k = head WHERE length(head) >= 5 GROUP BY id),
px AS (SELECT id, min(t) AS t FROM mn JOIN ix ON length(ix.k) >= 5 AND (starts_with(ix.k, mn.k) OR starts_with(mn.k, ix.k)) WHERE length(mn.k) >= 6 GROUP BY id HAVING count(DISTINCT t) = 1)"""
reg("entity_resolution_join", "id:i ticker rule:s", "", f"""WITH {NAMES} SELECT mn.id, coalesce(ix.t, ru.t, px.t) AS ticker, CASE WHEN ix.t IS NOT NULL THEN 'exact' WHEN ru.t IS NOT NULL THEN 'words' WHEN px.t IS NOT NULL THEN 'prefix' END AS rule
    FROM mn LEFT JOIN ix ON ix.k = mn.k LEFT JOIN ru ON ru.id = mn.id LEFT JOIN px ON px.id = mn.id""",
    lambda s, d: (lambda p: J.resolve_entities(p.selectExpr("p_partkey AS id", f"{SAID} AS name"), p.where("p_partkey % 7 = 0").selectExpr("p_partkey AS ticker", f"{LISTED} AS name")))(V.table(s, d, "part")))
