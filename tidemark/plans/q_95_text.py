"""Text and news queries, scalar functions, and their oracles. The prose of the test tables is invented, so the keyword
lists are arguments here; the news lists themselves are covered by unit tests."""

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import news as X
from tidemark.plans.q_30_sources_filters import reg
from tidemark.sources import views as V

c = F.col
BULL, BEAR = ("thatin", "ononst", "thing", "ering", "ention"), ("inoran", "hehely", "orantion", "nicht", "ement")
KH = lambda t, ws: "(" + " + ".join(f"CASE WHEN contains({t}, '{w}') THEN 1 ELSE 0 END" for w in ws) + ")"
art = V.articles
BODY = "lb AS (SELECT *, lower(body) AS lo, lower(title) AS lt FROM articles)"


def a(name, cols, sql, fn, ctes=""):
    reg(name, cols, "articles", sql, lambda s, d: fn(art(s, d)), BODY + (", " + ctes if ctes else ""))


a("keyword_hits", "doc_id:i hits:i", f"SELECT doc_id, {KH('lo', BULL)} AS hits FROM lb", lambda x: x.select("doc_id", T.keyword_hits(c("body"), BULL).alias("hits")))
a("keyword_occurrences", "doc_id:i n:2", "SELECT doc_id, (length(lo) - length(replace(lo, 'ering', ''))) / 5 + (length(lo) - length(replace(lo, 'nicht', ''))) / 5 AS n FROM lb", lambda x: x.select("doc_id", (T.occurrences(c("body"), "ering") + T.occurrences(c("body"), "nicht")).alias("n")))
a("keyword_sentiment", "doc_id:i positive negative neutral score", f"SELECT doc_id, p AS positive, n AS negative, greatest(1 - p - n, 0.1) AS neutral, p - n AS score FROM (SELECT doc_id, least(b / greatest(b + r, 1) * 0.8, 0.9) AS p, least(r / greatest(b + r, 1) * 0.8, 0.9) AS n FROM (SELECT doc_id, {KH('lo', BULL)} AS b, {KH('lo', BEAR)} AS r FROM lb))",
  lambda x: x.select("doc_id", *[v.alias(k) for k, v in T.keyword_sentiment(c("body"), BULL, BEAR).items()]))
MAT = {"ering": 9, "thing": 7, "ention": 8, "on the": 6, "que": 7, "der": 5}
HITL = "[" + ", ".join(f"{{'k': '{k}', 'v': {v}}}" for k, v in MAT.items()) + "]"
GAIN = f"least(45, coalesce(list_sum(list_transform(list_filter({HITL}, lambda p: contains(lt, p.k) OR contains(lo, p.k))[1:4], lambda p: p.v)), 0))"
MATQ = f"greatest(0, least(100, 40 - CASE WHEN contains(lo, 'nicht') THEN 30 ELSE 0 END + {GAIN} - CASE WHEN contains(lt, 'is') THEN 25 ELSE 0 END - CASE WHEN contains(lower(publisher), 'src1') THEN 12 ELSE 0 END))"
mat = lambda: T.materiality(c("title"), c("body"), c("publisher"), MAT, ("nicht",), ("is",), ("src1",))
a("materiality_score", "doc_id:i score:i", f"SELECT doc_id, {MATQ} AS score FROM lb", lambda x: x.select("doc_id", mat().alias("score")))
KINDS = [("EARNINGS", ("ering", "ention")), ("DEAL", ("thing",)), ("LEGAL", ("der", "que"))]
REPD, SPECU, ANA = ("onst", "ention", "ment"), ("tion", "aux"), ("an", "en")
RX = lambda t, p: f"regexp_matches({t}, '{p}')"
CLSQ = f"""SELECT doc_id, cls, CASE WHEN cls = 'EVENT' THEN kind END AS event_kind, fig AS has_figure FROM (SELECT *, CASE WHEN said AND kind IS NOT NULL AND spec = 0 THEN 'EVENT' WHEN ana > 0 AND spec = 0 AND act THEN 'ANALYST' WHEN spec >= 1 AND rep = 0 THEN 'COMMENTARY' WHEN rep >= 1 AND kind IS NOT NULL AND spec = 0 AND (fig OR rep >= 2) THEN 'EVENT' ELSE 'COMMENTARY' END AS cls FROM
    (SELECT doc_id, {RX('bl', '[$] ?[0-9,.]+|[0-9]+([.][0-9]+)? ?%|\\bq[1-4]\\b')} AS fig, {KH('bl', REPD)} AS rep, {KH('lt', SPECU)} + CASE WHEN {RX('lt', '[?]\\s*$|^\\s*\\w+:\\s*(can|will|is|should|does|why)\\b|\\b(can|will|would|might|may)\\b[^.]{0,60}\\b(justify|beat|reach|hit|survive|continue|last)\\b')} THEN 1 ELSE 0 END
    + CASE WHEN {RX('lt', '\\b(will|would|could|should|expects? to|set to|poised to|on track to)\\b|^\\s*(prediction|forecast|outlook:|preview)|\\bin (20[0-9][0-9]|\\w+ 20[0-9][0-9])\\b')} THEN 2 ELSE 0 END AS spec, {KH('bl', ANA)} AS ana, CASE WHEN {KH('bl', KINDS[0][1])} > 0 THEN 'EARNINGS' WHEN {KH('bl', KINDS[1][1])} > 0 THEN 'DEAL' WHEN {KH('bl', KINDS[2][1])} > 0 THEN 'LEGAL' END AS kind,
    {RX('lt', '\\b(announce[sd]?|unveil[sed]*|report[sed]*|post[sed]*|sign[sed]*|complete[sd]*|acquire[sd]*)\\b')} AS said, {RX('lt', '(price target|upgrade[sd]?|downgrade[sd]?|initiat|reiterat|raises|lowers|cuts)')} AS act FROM (SELECT *, lt || ' ' || lo AS bl FROM lb)))"""


def classified(x):
    k = T.classify(c("title"), c("body"), REPD, SPECU, ANA, KINDS)
    return x.select("doc_id", k["class"].alias("cls"), k["event_kind"].alias("event_kind"), k["has_figure"].alias("has_figure"))


a("event_classify", "doc_id:i cls:s event_kind:s has_figure:i", CLSQ, classified)
SW = {"src1": 95, "src2": 80, "src3": 45}
a("source_weight", "doc_id:i weight:i", "SELECT doc_id, CASE WHEN contains(publisher, 'src1') THEN 95 WHEN contains(publisher, 'src2') THEN 80 WHEN contains(publisher, 'src3') THEN 45 ELSE 60 END AS weight FROM lb", lambda x: x.select("doc_id", T.source_weight(c("publisher"), SW).alias("weight")))
a("latin_title_ratio", "doc_id:i ratio english:i", "SELECT doc_id, r AS ratio, r > 0.85 AS english FROM (SELECT doc_id, CASE WHEN length(title) = 0 THEN 1.0 ELSE length(regexp_replace(title, '[^\\x{0000}-\\x{024F}\\s]', '', 'g')) / length(title) END AS r FROM lb)",
  lambda x: x.select("doc_id", T.latin_ratio(c("title")).alias("ratio")).withColumn("english", c("ratio") > 0.85))
a("recency_weight", "doc_id:i weight", "SELECT doc_id, exp(-(DATE '2024-02-01' - published) / 3.0) AS weight FROM lb", lambda x: x.select("doc_id", F.exp(-F.datediff(F.lit("2024-02-01").cast("date"), "published") / 3.0).alias("weight")))
NF = """nf AS (SELECT ticker, publisher, CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS v, CASE WHEN contains(lt, 'the') THEN 1.0 ELSE 0.5 END AS w, DATE '2024-01-31' - published AS age FROM lb),
ng AS (SELECT ticker, count(*) AS n, sum(w) AS ww, sum(w * v) AS wv, coalesce(sum(w) FILTER (v > 0), 0) AS wp, coalesce(sum(w) FILTER (v < 0), 0) AS wn, sum(v) AS sv, sum(v * v) AS svv, avg(v) FILTER (age <= 7) AS s7, avg(v) FILTER (age <= 30) AS s30, avg(v) FILTER (age > 7 AND age <= 30) AS sp, count(*) FILTER (age <= 7) AS n7, count(*) FILTER (age <= 30) AS n30 FROM nf GROUP BY 1),
np AS (SELECT ticker, count(*) AS publishers, max(k) AS top FROM (SELECT ticker, publisher, count(*) AS k FROM nf GROUP BY 1, 2) GROUP BY 1),
ns AS (SELECT ticker, n, n30, s7, (wp - wn) / ww AS net_sentiment, wp / ww AS positive_ratio, wv / ww AS sentiment_mean, sqrt((svv - 2 * (wv / ww) * sv + n * (wv / ww) * (wv / ww)) / n) AS dispersion, s7 AS sentiment_7d, s30 AS sentiment_30d, coalesce(s7 - sp, s7 - s30, 0) AS sentiment_trend, n7 / 7 AS velocity, CASE WHEN n30 > 0 THEN n7 / 7 / (n30 / 30) END AS volume_vs_baseline,
    CASE WHEN n30 > 0 AND n7 / 7 > 2 * (n30 / 30) THEN 1 ELSE 0 END AS volume_spike, publishers, top / n AS source_concentration FROM ng JOIN np USING (ticker))"""
tagged = lambda x: x.withColumn("in_title", F.contains(F.lower("title"), F.lit("the")))
a("sentiment_weighted_agg", "ticker n:i net_sentiment positive_ratio sentiment_mean dispersion:5 sentiment_7d sentiment_30d sentiment_trend velocity volume_vs_baseline volume_spike:i publishers:i source_concentration", "SELECT * FROM ns", lambda x: X.news_features(tagged(x), "2024-01-31"), NF)
KWT = f", kw AS (SELECT ticker, sum({KH('lo', BULL)}) AS bull, sum({KH('lo', BEAR)}) AS bear FROM lb GROUP BY 1)"
NMS = "CASE WHEN n30 < 3 THEN 50 ELSE 0.30 * least(greatest(50 + sentiment_trend * 50, 0.0), 100.0) + 0.30 * CASE WHEN bull + bear > 0 THEN 50 + (bull - bear) / (bull + bear) * 50 ELSE 50 END + 0.20 * CASE WHEN volume_vs_baseline >= 2 THEN 80 WHEN volume_vs_baseline >= 1.5 THEN 70 WHEN volume_vs_baseline >= 1 THEN 55 WHEN volume_vs_baseline >= 0.5 THEN 45 ELSE 30 END + 0.20 * least(greatest(50 + coalesce(s7, 0) * 50, 0.0), 100.0) END"


def momentum(x):
    kw = x.groupBy("ticker").agg(F.sum(T.keyword_hits(c("body"), BULL)).alias("bull"), F.sum(T.keyword_hits(c("body"), BEAR)).alias("bear"), F.sum((F.datediff(F.lit("2024-01-31").cast("date"), "published") <= 30).cast("int")).alias("n30"))
    f = X.news_features(tagged(x), "2024-01-31").select("ticker", c("sentiment_trend").alias("drift"), c("volume_vs_baseline").alias("volume_trend"), F.coalesce("sentiment_7d", F.lit(0.0)).alias("s7"))
    return X.news_momentum(f.join(kw, "ticker"))


a("news_momentum_score", "ticker news_score:4", f"SELECT ticker, {NMS} AS news_score FROM ns JOIN kw USING (ticker)", momentum, NF + KWT)
a("top_per_publisher_cap", "ticker doc_id:i publisher:s position:i", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sc DESC, doc_id) AS position FROM (SELECT ticker, doc_id, publisher, {MATQ} AS sc, row_number() OVER (PARTITION BY ticker, publisher ORDER BY {MATQ} DESC, doc_id) AS p FROM lb) WHERE p <= 4) WHERE position <= 10",
  lambda x: X.top_per_publisher(x.withColumn("sc", mat()), "ticker", "sc"))
a("social_weighted_agg", "publisher:s social_score n_posts:i dispersion high_conviction contrarian label:s", f"""SELECT *, CASE WHEN abs(social_score) > 0.3 THEN -social_score ELSE social_score END AS contrarian, CASE WHEN social_score > 0.1 THEN 'BULLISH' WHEN social_score < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM (SELECT publisher, sum(sc * w) / sum(w) AS social_score, count(*) AS n_posts, stddev_pop(sc) AS dispersion, avg(CASE WHEN abs(sc) > 0.3 THEN 1.0 ELSE 0 END) AS high_conviction FROM
    (SELECT *, least(b / greatest(b + r, 1) * 0.8, 0.9) - least(r / greatest(b + r, 1) * 0.8, 0.9) AS sc, ln(1 + greatest(doc_id % 97, 1)) * sqrt(1 + greatest(doc_id % 13, 0)) AS w FROM (SELECT *, {KH('lo', BULL)} AS b, {KH('lo', BEAR)} AS r FROM lb) WHERE len(regexp_split_to_array(trim(body), '\\s+')) >= 5) GROUP BY 1)""",
  lambda x: X.social_sentiment(x.select("publisher", c("body").alias("text"), T.keyword_sentiment(c("body"), BULL, BEAR)["score"].alias("score"), (c("doc_id") % 97).alias("up"), (c("doc_id") % 13).alias("comments")), "publisher"))
reg("news_event_count_windows", "publisher:s d n7:i n30:i spike:i", "articles", "SELECT publisher, d, n7, n30, n7 / 7 > 1.5 * (n30 / 30) AS spike FROM (SELECT p.publisher, c.d, count(*) FILTER (a.published > c.d - 7) AS n7, count(*) AS n30 FROM (SELECT DISTINCT publisher FROM articles) p, (SELECT DISTINCT published AS d FROM articles) c JOIN articles a ON a.publisher = p.publisher AND a.published <= c.d AND a.published > c.d - 30 GROUP BY 1, 2)",
    lambda s, d: article_windows(art(s, d)))


def article_windows(x):
    """7 and 30 day article counts on every day, from daily counts sent to the days they count for; a day's count is one row."""
    from tidemark.streaming.batch import trailing_counts

    return trailing_counts(x, "publisher", "published")


a("subject_name_discovery", "publisher:s name:s mentions:i", "SELECT publisher, b.t AS name, b.k AS mentions FROM (SELECT publisher, max({'k': k, 't': t}) AS b FROM (SELECT publisher, rtrim(lower(t), '.''&-') AS t, count(*) AS k FROM (SELECT publisher, unnest(regexp_extract_all(title, '\\b([A-Z][a-zA-Z''&.-]{2,})\\b', 1)) AS t FROM lb) GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT publisher, count(*) AS n FROM lb GROUP BY 1) USING (publisher) WHERE b.k >= greatest(2.0, n * 0.02)",
  lambda x: X.subject_names(x, "publisher", share=0.02))
GREEDY = f"""tw AS (SELECT published, doc_id, row_number() OVER (PARTITION BY published ORDER BY {MATQ} DESC, doc_id) AS i, list_distinct(list_filter(regexp_split_to_array(lt, '\\s+'), lambda w: length(w) > 3)) AS w FROM lb),
kp AS (WITH RECURSIVE q(published, i, kept, ids) AS (SELECT DISTINCT published, CAST(0 AS BIGINT), CAST([] AS VARCHAR[][]), CAST([] AS BIGINT[]) FROM tw UNION ALL SELECT published, i, CASE WHEN clash THEN kept ELSE list_append(kept, w) END, CASE WHEN clash THEN ids ELSE list_append(ids, doc_id) END FROM
    (SELECT q.published, tw.i, q.kept, q.ids, tw.w, tw.doc_id, len(list_filter(q.kept, lambda k: len(list_intersect(k, tw.w)) / greatest(1, least(len(k), len(tw.w))) > 0.45)) > 0 AS clash FROM q JOIN tw ON tw.published = q.published AND tw.i = q.i + 1)) SELECT * FROM q)"""
reg("greedy_dedupe_story", "published:s doc_id:i", "articles", "SELECT published, unnest(ids) AS doc_id FROM (SELECT published, arg_max(ids, i) AS ids FROM kp GROUP BY published)",
    lambda s, d: X.dedupe_stories(art(s, d, lambda x: x.select("doc_id", "published", "title", mat().alias("sc"))), ["published"], "sc"), BODY + ", " + GREEDY)
FG = {"FINANCIAL": ("ering", "tion"), "OPERATIONAL": ("der", "ent"), "STRATEGIC": ("que", "aux")}
reg("fact_extraction", "doc_id:i pos:i fact:s grp:s", "", None, lambda s, d: X.stated_facts(art(s, d).withColumn("o", c("doc_id")).withColumn("body2", F.regexp_replace("body", "#", " 5% ")), "doc_id", "body2", "o", FG, ("xqz",), "FINANCIAL").select("doc_id", "pos", "fact", "grp"))


def filings_text(s, d):
    """A business section per supplier that lists the nations it ships to and the segments it meets."""
    e = V.edges(s, d).withColumn("dst", F.replace("dst", F.lit("_"), F.lit("-")))
    g = e.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.when(c("tier") == 2, c("dst")))), ", ").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(c("tier") == 1, c("dst")))), " and ").alias("g"))
    return g.select("src", F.concat(F.lit("<p>We sell parts.</p> Our customers include "), c("n"), F.lit(". Our sales grew. We compete with "), c("g"), F.lit(". The end.")).alias("text"))


reg("relationship_extraction", "src:i kind:s name:s", "edges", "SELECT src, CASE tier WHEN 2 THEN 'customer' ELSE 'competitor' END AS kind, replace(dst, '_', '-') AS name FROM edges WHERE lower(dst) NOT IN (" + ", ".join(f"'{w}'" for w in X.NOT_COMPANIES) + ")", lambda s, d: X.relationships(filings_text(s, d), "src", "text", [("customer", "customers include"), ("competitor", "compete with")]))

# scalar and calendar functions
reg("calendar_month_ends", "x:s", "", "SELECT last_day(CAST(m AS DATE)) AS x FROM (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders), LATERAL (SELECT unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS m) WHERE last_day(CAST(m AS DATE)) BETWEEN a AND b",
    lambda s, d: V.table(s, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")).select("a", "b", F.explode(F.sequence(F.trunc("a", "month"), c("b"), F.expr("interval 1 month"))).alias("m")).select("a", "b", F.last_day("m").alias("x")).where("x between a and b"))
reg("rebalance_calendar", "q:s session:s", "bars", "SELECT q, min(d) AS session FROM (SELECT CAST(m AS DATE) AS q FROM generate_series(TIMESTAMP '1994-10-01', TIMESTAMP '2002-01-01', INTERVAL 3 MONTH) t(m)) JOIN (SELECT DISTINCT d FROM bars) ON d >= q AND d < q + INTERVAL 3 MONTH GROUP BY q",
    lambda s, d: (lambda cal: cal.select("d", F.to_date(F.trunc("d", "quarter")).alias("q")).groupBy("q").agg(F.min("d").alias("session")))(V.bars(s, d).select("d").distinct()))


def plus_sessions(day, n: int):
    """Date n weekdays later (weekends skipped, no holidays), by arithmetic on the weekday; a weekend start counts from Friday."""
    wd = F.weekday(day)
    start = F.when(wd > 4, 4).otherwise(wd)
    base = F.when(wd > 4, F.date_sub(day, wd - 4)).otherwise(day)
    return F.date_add(base, (F.floor((start + n) / 5) * 7 + (start + n) % 5 - start).cast("int"))


reg("add_trading_days", "o_orderkey:i x:s", "", "SELECT o_orderkey, b + CAST((s + 21) // 5 * 7 + (s + 21) % 5 - s AS INTEGER) AS x FROM (SELECT o_orderkey, least(w, 4) AS s, d - CAST(greatest(w - 4, 0) AS INTEGER) AS b FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, isodow(o_orderdate) - 1 AS w FROM orders))",
    lambda s, d: V.table(s, d, "orders").select("o_orderkey", plus_sessions(F.to_date("o_orderdate"), 21).alias("x")))
reg("tier_decay", "src:i dst:s decay:2", "edges", "SELECT src, dst, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 0 END AS decay FROM edges", lambda s, d: V.edges(s, d).select("src", "dst", F.when(c("tier") == 1, 1.0).when(c("tier") == 2, 0.5).when(c("tier") == 3, 0.25).otherwise(0.0).alias("decay")))
reg("json_factor_access", "event_id:i k missing", "", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, NULL AS missing FROM events", lambda s, d: V.table(s, d, "events").withColumn("m", F.from_json("props", "map<string,double>")).select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("absent")).alias("missing")))
reg("null_safe_divide", "o_orderkey:i x", "", "SELECT o_orderkey, o_totalprice / nullif(o_custkey % 5, 0) AS x FROM orders", lambda s, d: V.table(s, d, "orders").select("o_orderkey", F.try_divide("o_totalprice", (c("o_custkey") % 5).cast("double")).alias("x")))
reg("stability", "ticker stability", "quarters", "SELECT ticker, greatest(0.0, 1 - stddev_pop(m) / abs(avg(m))) AS stability FROM (SELECT ticker, gross_profit / revenue AS m FROM quarters) GROUP BY ticker HAVING count(m) >= 3 AND avg(m) <> 0",
    lambda s, d: V.quarters(s, d).select("ticker", (c("gross_profit") / c("revenue")).alias("m")).groupBy("ticker").agg(F.count("m").alias("n"), F.avg("m").alias("a"), F.stddev_pop("m").alias("sd")).where("n >= 3 and a <> 0").select("ticker", F.greatest(F.lit(0.0), 1 - c("sd") / F.abs("a")).alias("stability")))
reg("cagr", "ticker cagr", "quarters", "SELECT ticker, CASE WHEN a > 0 AND b > 0 THEN pow(b / a, 1 / (n - 1)) - 1 END AS cagr FROM (SELECT ticker, arg_min(revenue, period_end) AS a, arg_max(revenue, period_end) AS b, count(*) AS n FROM quarters GROUP BY 1)",
    lambda s, d: V.quarters(s, d).groupBy("ticker").agg(F.min_by("revenue", "period_end").alias("a"), F.max_by("revenue", "period_end").alias("b"), F.count(F.lit(1)).alias("n")).select("ticker", F.when((c("a") > 0) & (c("b") > 0), F.pow(c("b") / c("a"), 1 / (c("n") - 1)) - 1).alias("cagr")))
