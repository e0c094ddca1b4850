"""Sources, sinks, filters and predicates with their oracles."""

from pyspark.sql import functions as F

from tidemark.functions import scores as SC
from tidemark.functions.frames import with_returns
from tidemark.operators import filters as X
from tidemark.plans.oracle import W, with_views
from tidemark.plans.registry import query
from tidemark.sources import stores as S
from tidemark.sources import views as V
from tidemark.streaming.jobs import work_dir


def reg(name, cols, views, sql, fn, ctes=""):
    query(name, cols, with_views(views, sql, ctes) if sql else None)(fn)


reg("bars_scan", "ticker d o:4 h:4 l:4 c:4 v:2", "bars", "SELECT * FROM bars WHERE d BETWEEN DATE '1996-03-01' AND DATE '1999-06-30'",
    lambda s, d: S.bars_scan(V.bars(s, d), "1996-03-01", "1999-06-30"))
reg("bars_on_day", "ticker c:4", "bars", "SELECT ticker, c FROM bars WHERE d = DATE '1998-06-01'", lambda s, d: S.bars_on_day(V.bars(s, d), "1998-06-01"))


def month_ends(s, start="1994-11-01", end="2002-02-28"):
    return s.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("x"))


ME = "me AS (SELECT last_day(CAST(m AS DATE)) AS x FROM generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '2002-02-28', INTERVAL 1 MONTH) t(m))"
reg("nearest_session", "x:s session:s", "bars", """SELECT x, coalesce(max(d), x) AS session FROM me LEFT JOIN (SELECT DISTINCT d FROM bars) ON d BETWEEN x - 6 AND x GROUP BY x""",
    lambda s, d: S.nearest_session(V.bars(s, d), month_ends(s)), ME)


def corrections(b):
    late = b.where("n % 2 = 0").select("ticker", "d", "o", "h", "l", (F.col("c") * 1.01).alias("c"), (F.col("v") + 1).alias("v"))
    return late.unionByName(b.where("n = 3").select("ticker", F.date_add("d", 4000).alias("d"), "o", "h", "l", "c", "v"))


COR = """cor AS (SELECT ticker, d, o, h, l, c * 1.01 AS c, v + 1 AS v FROM bars WHERE n % 2 = 0 UNION ALL SELECT ticker, d + 4000, o, h, l, c, v FROM bars WHERE n = 3)"""
UPS = """SELECT coalesce(b.ticker, cor.ticker) AS ticker, coalesce(b.d, cor.d) AS d, coalesce(b.o, cor.o) AS o, coalesce(b.h, cor.h) AS h, coalesce(b.l, cor.l) AS l,
    coalesce(cor.c, b.c) AS c, coalesce(cor.v, b.v) AS v FROM bars b FULL JOIN cor ON b.ticker = cor.ticker AND b.d = cor.d"""
reg("bars_upsert_sink", "ticker d o:4 h:4 l:4 c:5 v:2", "bars", UPS, lambda s, d: upserted(s, d), COR)


def upserted(s, d):
    """The bar store after a merge of corrections: only the months that they touch are written again."""
    bars = V.bars(s, d).drop("n", "u")
    store = S.MonthStore(s, work_dir(s, "bars-upsert"), bars.schema)
    store.write(bars, 0)
    store.merge(corrections(V.bars(s, d)), 1, S.upsert_bars)
    return store.read()



reg("incremental_day_ingest", "d", "bars", """SELECT x AS d FROM (SELECT CAST(g AS DATE) AS x FROM generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2002-01-31', INTERVAL 1 DAY) t(g))
    WHERE isodow(x) <= 5 AND x NOT IN (SELECT d FROM bars)""", lambda s, d: S.missing_sessions(V.bars(s, d), "1994-12-01", "2002-01-31", s))
reg("store_coverage", "n_rows:i n_tickers:i first_d:s last_d:s n_days:i", "bars", """SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(d) AS first_d, max(d) AS last_d,
    count(DISTINCT d) AS n_days FROM bars""", lambda s, d: S.store_coverage(V.bars(s, d)))


def snapshots(s, d):
    return V.bars(s, d).groupBy("ticker", F.last_day("d").alias("scan_time")).agg(F.max_by("c", "d").alias("score"))


SNAP = "snap AS (SELECT ticker, last_day(d) AS scan_time, arg_max(c, d) AS score FROM bars GROUP BY 1, 2)"
reg("snapshot_sink_keep_last_n", "ticker scan_time:s score:4", "bars", """SELECT * FROM snap WHERE scan_time IN (SELECT DISTINCT scan_time FROM snap ORDER BY 1 DESC LIMIT 3)""",
    lambda s, d: S.keep_last_snapshots(snapshots(s, d)), SNAP)
reg("snapshot_prune_by_age", "ticker scan_time:s score:4", "bars", "SELECT * FROM snap WHERE scan_time >= DATE '2001-06-30' - 120", lambda s, d: S.prune_snapshots(snapshots(s, d), "2001-06-30"), SNAP)
reg("first_seen_sink", "ticker first_seen:s", "bars", "SELECT ticker, min(scan_time) AS first_seen FROM snap GROUP BY 1", lambda s, d: S.first_seen(snapshots(s, d)), SNAP)


def filing_tables(s, d):
    o, li = V.table(s, d, "orders"), V.table(s, d, "lineitem")
    sub = o.select(F.col("o_orderkey").alias("accession"), F.when(F.col("o_orderstatus") == "F", "13F-NT").otherwise("13F-HR").alias("type"),
                   F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("period"))
    cover = o.select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").cast("string").alias("manager"))
    info = li.select(F.col("l_orderkey").alias("accession"), F.col("l_partkey").alias("cusip"), F.when(F.col("l_returnflag") == "R", "PUT").otherwise("").alias("putcall"),
                     F.when(F.col("l_linestatus") == "O", "SH").otherwise("PRN").alias("kind"), F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("value"),
                     F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("line"))
    return sub, cover, info


reg("holdings_13f_load", "quarter:s cusip:i manager:s shares:2 value:2", "", """SELECT quarter, cusip, manager, shares, value FROM (SELECT CAST(o_orderdate AS DATE) AS quarter, l_partkey AS cusip,
    CAST(o_custkey AS VARCHAR) AS manager, l_quantity AS shares, l_extendedprice AS value, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), l_partkey, o_custkey
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND l_returnflag <> 'R' AND l_linestatus = 'O') WHERE r = 1""",
    lambda s, d: S.load_13f(*filing_tables(s, d)))
TAGS = {"revenue": ["revenue"], "cost_of_revenue": ["cost_of_revenue"], "assets": ["assets"], "cash_flow": ["op_cash_flow", "net_income"]}
reg("company_facts_to_annual", "cik:i metric:s fy:i val:2 filed:s", "facts", """SELECT cik, metric, fy, val, filed FROM ann UNION ALL SELECT r.cik, 'gross_profit', r.fy, r.val - c.val, greatest(r.filed, c.filed)
    FROM ann r JOIN ann c ON r.cik = c.cik AND r.fy = c.fy AND r.metric = 'revenue' AND c.metric = 'cost_of_revenue'""",
    lambda s, d: S.annual_series(V.facts(s, d), TAGS), """ann AS (SELECT cik, metric, fy, val, filed FROM (SELECT *, row_number() OVER (PARTITION BY cik, metric, fy ORDER BY CASE WHEN val = 0 THEN 1 ELSE 0 END, i, filed) AS r
    FROM (SELECT cik, CASE WHEN metric IN ('op_cash_flow', 'net_income') THEN 'cash_flow' ELSE metric END AS metric, CASE WHEN metric = 'net_income' THEN 1 ELSE 0 END AS i, year("end") AS fy, val, filed
    FROM facts WHERE fp = 'FY' AND form = '10-K' AND metric IN ('revenue', 'cost_of_revenue', 'assets', 'op_cash_flow', 'net_income'))) WHERE r = 1)""")
ER = 'SELECT cik, metric, "end", arg_min(val, {{\'z\': CASE WHEN val = 0 THEN 1 ELSE 0 END, \'f\': filed, \'v\': val}}) AS val, arg_min(filed, {{\'z\': CASE WHEN val = 0 THEN 1 ELSE 0 END, \'f\': filed, \'v\': val}}) AS filed FROM facts WHERE {} GROUP BY 1, 2, 3'
QREV = ER.format("metric = 'revenue' AND \"end\" - start BETWEEN 80 AND 100")
reg("company_facts_to_quarterly", "cik:i end:s val:2 filed:s", "facts", QREV, lambda s, d: S.quarterly_series(V.facts(s, d), "revenue"))
reg("filing_series_dedupe", "cik:i metric:s end:s val:2 filed:s", "facts", ER.format("metric = 'assets' AND fp <> 'FY'"), lambda s, d: S.instant_series(V.facts(s, d), "assets"))


def panel(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("d")
    return V.bars(s, d).select("ticker", "d", (F.lead("c", 21).over(w) / F.lead("c", 1).over(w) - 1).alias("label_1m"), (F.lead("c", 63).over(w) / F.lead("c", 1).over(w) - 1).alias("label_3m"))


reg("panel_sink_with_meta", "n_rows:i n_tickers:i n_dates:i label_1m_mean label_1m_std label_3m_mean label_3m_std", "bars", f"""SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, count(DISTINCT d) AS n_dates,
    avg(l1) AS label_1m_mean, stddev_samp(l1) AS label_1m_std, avg(l3) AS label_3m_mean, stddev_samp(l3) AS label_3m_std FROM
    (SELECT ticker, d, lead(c, 21) OVER w / lead(c, 1) OVER w - 1 AS l1, lead(c, 63) OVER w / lead(c, 1) OVER w - 1 AS l3 FROM bars {W})""", lambda s, d: S.panel_meta(panel(s, d), ["label_1m", "label_3m"]))
def fetched_facts(s, d):
    """The later half of the filings merged into a table that holds the earlier half."""
    f = V.facts(s, d).where("metric = 'revenue' and fp <> 'FY'").select("cik", F.col("filed").alias("fetched"), "val", F.struct("end", "val").alias("ord"))
    cut = F.lit("1998-06-30").cast("date")
    first = S.insert_if_new(f.where("1 = 0"), f.where(F.col("fetched") <= cut), ["cik", "fetched"], "ord")
    return S.insert_if_new(first, f, ["cik", "fetched"], "ord")


reg("macro_ohlcv_sinks", "cik:i fetched:s val:2", "facts", """SELECT cik, filed AS fetched, val FROM (SELECT cik, filed, val, row_number() OVER (PARTITION BY cik, filed ORDER BY "end", val) AS r FROM facts WHERE metric = 'revenue' AND fp <> 'FY') WHERE r = 1""",
    lambda s, d: fetched_facts(s, d))

# filters
reg("pit_as_of_filter", "cik:i metric:s end:s filed:s val:2 fp:s", "facts", "SELECT * FROM facts WHERE filed <= DATE '1998-09-30'", lambda s, d: X.pit_as_of(V.facts(s, d), "1998-09-30"))
reg("pit_filing_lag_filter", "ticker period_end:s filed:s revenue:2", "quarters", "SELECT * FROM quarters WHERE filed IS NOT NULL AND filed <= DATE '1998-09-30' - 45",
    lambda s, d: X.pit_as_of(V.quarters(s, d), "1998-09-30", lag_days=45))
reg("prices_before_as_of", "ticker d c:4", "bars", "SELECT * FROM bars WHERE d < DATE '1999-01-01' AND d >= DATE '1999-01-01' - 378", lambda s, d: X.prices_before(V.bars(s, d), "1999-01-01"))
reg("universe_membership_as_of", "ticker ipo:s delist:s", "membership", "SELECT * FROM membership WHERE ipo <= DATE '2001-10-20' AND (delist IS NULL OR delist > DATE '2001-10-20')",
    lambda s, d: X.universe_as_of(V.membership(s, d), "2001-10-20"))
reg("liquid_universe_topn", "ticker avg_dv:2 k:i", "bars", """SELECT ticker, avg(c * v) AS avg_dv, count(*) AS k FROM bars WHERE d IN (SELECT DISTINCT d FROM bars ORDER BY d DESC LIMIT 40) AND c >= 3 GROUP BY ticker
    HAVING count(*) >= 3 AND avg(c * v) >= 1000 ORDER BY avg_dv DESC, ticker LIMIT 2500""", lambda s, d: X.liquid_universe(V.bars(s, d), 2500, 3.0, 1000.0, sessions=40))
reg("price_prefilter", "ticker n_bars:i drawdown price:4 adv:2", "bars", """SELECT ticker, count(*) AS n_bars, 1 - max(c) FILTER (k = 1) / max(c) FILTER (d >= DATE '2001-06-30' - 1095) AS drawdown, max(c) FILTER (k = 1) AS price, avg(c * v) FILTER (k <= 60) AS adv
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM bars WHERE d <= DATE '2001-06-30' AND d >= DATE '2001-06-30' - 1098) GROUP BY ticker
    HAVING count(*) >= 200 AND 1 - max(c) FILTER (k = 1) / max(c) FILTER (d >= DATE '2001-06-30' - 1095) >= 0.35 AND max(c) FILTER (k = 1) >= 2 AND avg(c * v) FILTER (k <= 60) >= 500""",
    lambda s, d: X.price_prefilter(V.bars(s, d), "2001-06-30", min_adv=500.0))
reg("shell_company_filter", "p_partkey:i shell:i", "", "SELECT p_partkey, contains(upper(p_type || ' blank check ' || p_brand), 'BLANK CHECK') AND p_size > 25 AS shell FROM part",
    lambda s, d: V.table(s, d, "part").select("p_partkey", (X.is_shell(F.concat("p_type", F.lit(" blank check "), "p_brand")) & (F.col("p_size") > 25)).alias("shell")))
reg("basis_discontinuity_cut", "ticker d u:4", "rets", """SELECT ticker, d, u FROM (SELECT *, max(CASE WHEN m > 0.6 THEN d END) OVER (PARTITION BY ticker) AS cut FROM
    (SELECT *, abs(u / lag(u) OVER w - 1) AS m FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY d))) WHERE cut IS NULL OR d >= cut""", lambda s, d: X.cut_after_break(V.bars(s, d), "u"))
NB = """nb AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS nn, list_sort(list_filter([lag(revenue, 1) OVER w, lag(revenue, 2) OVER w, lead(revenue, 1) OVER w, lead(revenue, 2) OVER w], lambda x: x > 0)) AS a
    FROM quarters WINDOW w AS (PARTITION BY ticker ORDER BY period_end))"""
reg("clean_quarters", "ticker period_end:s revenue:2", "quarters", """SELECT * FROM nb WHERE NOT coalesce(nn >= 3 AND revenue > 0 AND revenue < 0.6 * list_median(a), false)""".replace("list_median(a)", "list_aggregate(a, 'median')"),
    lambda s, d: X.clean_quarters(V.quarters(s, d), "ticker", "period_end", "revenue", floor=0.6), NB)
reg("valid_share_count", "ticker period_end:s valid_shares:2", "quarters", """SELECT ticker, period_end, coalesce(last_value(s IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(s IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS valid_shares
    FROM (SELECT *, CASE WHEN qty > 700 THEN qty WHEN n > 32 THEN shares END AS s FROM quarters) WINDOW w AS (PARTITION BY ticker ORDER BY period_end)""",
    lambda s, d: X.valid_shares(V.quarters(s, d).withColumn("diluted", F.col("qty")).withColumn("basic", F.when(F.col("n") > 32, F.col("shares"))), floor=700.0))
reg("price_series_validation", "ticker n_nonpositive:i n_extreme:i n_outliers:i", "rets", f"""SELECT ticker, 0 AS n_nonpositive, count(*) FILTER (abs(lr) > 0.06) AS n_extreme, count(*) FILTER (abs(z) > 2.5) AS n_outliers FROM
    (SELECT *, (lr - avg(lr) OVER p) / (stddev_samp(lr) OVER p + 1e-10) AS z FROM rets WINDOW p AS (PARTITION BY ticker)) GROUP BY ticker""", lambda s, d: X.validate_prices(V.bars(s, d), 0.06, 2.5))
reg("lookahead_check", "ticker as_of max_ts:s severity:s", "bars quarters", """SELECT ticker, as_of, max_ts, 'CRITICAL' AS severity FROM (SELECT ticker, max(period_end) AS as_of FROM quarters GROUP BY 1) JOIN
    (SELECT ticker, max(filed) AS max_ts FROM quarters WHERE ticker % 3 = 0 OR period_end < DATE '2000-01-01' GROUP BY 1) USING (ticker) WHERE max_ts > as_of""",
    lambda s, d: X.lookahead_violations(V.quarters(s, d).groupBy("ticker").agg(F.max("period_end").alias("as_of")),
                                        V.quarters(s, d).where("ticker % 3 = 0 or period_end < date'2000-01-01'").select("ticker", F.col("filed").alias("ts"))))
CAP = "CASE WHEN m IS NULL OR m <= 0 THEN 'unknown' WHEN m < 5e7 THEN 'nano' WHEN m < 3e8 THEN 'micro' WHEN m < 2e9 THEN 'small' WHEN m < 1e10 THEN 'mid' WHEN m < 2e11 THEN 'large' ELSE 'mega' END"
reg("cap_tier", "c_custkey:i tier:s tier3:s", "", f"""SELECT c_custkey, {CAP} AS tier, CASE WHEN m >= 1e10 THEN 'large' WHEN m >= 2e9 THEN 'mid' WHEN m >= 3e8 THEN 'small' END AS tier3 FROM
    (SELECT c_custkey, c_acctbal * pow(10, c_custkey % 8) AS m FROM customer)""", lambda s, d: (lambda c: V.table(s, d, "customer").select("c_custkey", X.cap_tier(c).alias("tier"), X.cap_tier3(c).alias("tier3")))(
    F.col("c_acctbal") * F.pow(F.lit(10.0), F.col("c_custkey") % 8)))
RULES = [("Metals", ["BRASS", "COPPER", "STEEL"]), ("Plated", ["PLATED", "ANODIZED"]), ("Promotion", ["PROMO"])]
reg("sector_bucket", "p_partkey:i bucket:s sub_bucket:s", "", """SELECT p_partkey, CASE WHEN t LIKE '%BRASS%' OR t LIKE '%COPPER%' OR t LIKE '%STEEL%' THEN 'Metals' WHEN t LIKE '%PLATED%' OR t LIKE '%ANODIZED%' THEN 'Plated' WHEN t LIKE '%PROMO%' THEN 'Promotion' ELSE 'Other' END AS bucket,
    CASE WHEN t LIKE '%PROMO%' THEN 'Promotion' END AS sub_bucket FROM (SELECT p_partkey, upper(p_type) AS t FROM part)""",
    lambda s, d: V.table(s, d, "part").select("p_partkey", X.bucket_for(F.col("p_type"), RULES).alias("bucket"), X.bucket_for(F.col("p_type"), RULES[2:], None).alias("sub_bucket")))
FAM = [("House of Building", "BUILDING"), ("Auto Group", "AUTOMOBILE")]
reg("family_name_normalise", "c_custkey:i family:s", "", """SELECT c_custkey, CASE WHEN contains(upper(nm), 'BUILDING') THEN 'House of Building' WHEN contains(upper(nm), 'AUTOMOBILE') THEN 'Auto Group' ELSE 'Customer ' || c_mktsegment_t END AS family FROM
    (SELECT c_custkey, 'Customer, ' || c_mktsegment || ' Capital Mgmt LLC' AS nm, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS c_mktsegment_t FROM customer)""",
    lambda s, d: V.table(s, d, "customer").select("c_custkey", X.family_name(F.concat(F.lit("Customer, "), "c_mktsegment", F.lit(" Capital Mgmt LLC")), FAM).alias("family")))
reg("linear_score", "ticker d score", "rets", "SELECT ticker, d, CASE WHEN r IS NULL THEN 50 ELSE least(greatest((r + 0.02) / 0.05 * 100, 0.0), 100.0) END AS score FROM rets",
    lambda s, d: with_returns(V.bars(s, d)).select("ticker", "d", SC.linear_score(F.col("r"), -0.02, 0.03).alias("score")))
reg("good_great_score", "ticker period_end:s high low", "quarters", """SELECT ticker, period_end, CASE WHEN m >= 0.4 THEN 100 WHEN m <= 0.0 THEN 0 ELSE least(greatest(50 + 50 * (m - 0.2) / 0.2, 0.0), 100.0) END AS high,
    CASE WHEN m <= 0.1 THEN 100 WHEN m >= 0.7 THEN 0 ELSE least(greatest(50 + 50 * (0.4 - m) / (0.4 - 0.1), 0.0), 100.0) END AS low FROM (SELECT *, gross_profit / revenue AS m FROM quarters)""",
    lambda s, d: (lambda m: V.quarters(s, d).select("ticker", "period_end", SC.good_great_score(m, 0.2, 0.4).alias("high"), SC.good_great_score(m, 0.4, 0.1, False).alias("low")))(F.col("gross_profit") / F.col("revenue")))
reg("absolute_band", "ticker period_end:s high low", "quarters", """SELECT ticker, period_end, CASE WHEN m <= 0.2 THEN greatest(0.0, 40 + (m - 0.0) / 0.2 * 25) WHEN m <= 0.4 THEN 65 + (m - 0.2) / 0.2 * 25 ELSE least(100.0, 90 + (m - 0.4) / 0.2 * 10) END AS high,
    CASE WHEN -m <= -0.4 THEN greatest(0.0, 40 + (-m + 0.7) / 0.3 * 25) WHEN -m <= -0.1 THEN 65 + (-m + 0.4) / 0.3 * 25 ELSE least(100.0, 90 + (-m + 0.1) / 0.3 * 10) END AS low FROM (SELECT *, gross_profit / revenue AS m FROM quarters)""",
    lambda s, d: (lambda m: V.quarters(s, d).select("ticker", "period_end", SC.absolute_band(m, 0.2, 0.4).alias("high"), SC.absolute_band(m, 0.4, 0.1, False).alias("low")))(F.col("gross_profit") / F.col("revenue")))
