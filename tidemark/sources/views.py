"""Market, filing, ownership and news tables derived from the driver's star schema (see FIXTURES.md, part B).

Each adapter reads only the columns it needs and aggregates before any window, so a window partition is at most one
row per calendar day (or quarter) of one instrument. Prices are rounded to four places, money to two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import by, dealt, rnd, running, task_parts, whole

METRICS = ["revenue", "cost_of_revenue", "gross_profit", "net_income", "op_cash_flow", "assets", "liabilities", "shares"]
DELIST_REASONS = ["bankruptcy", "performance", "acquisition", "merger", "voluntary", "exchange_transfer"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, d, o, h, l, c, v, n: one row per supplier and ship day. The rows are sorted once for all windows of this table."""
    li = table(spark, sf_dir, "lineitem")
    parts = task_parts(li)
    li = li.select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_quantity")
    daily = dealt(li, parts, "ticker", "d").groupBy("ticker", "d").agg(
        rnd(F.sum("l_extendedprice"), 2).alias("_ext"),
        F.sum("l_quantity").alias("v"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("u", F.col("_ext") / F.col("v"))
    daily = (dealt(daily, parts, "ticker") if parts else daily.repartition("ticker")).sortWithinPartitions("ticker", "d")
    r = rnd(F.greatest(F.least(0.02 * (F.col("u") / F.avg("u").over(whole()) - 1), F.lit(0.1)), F.lit(-0.1)), 8)
    c = rnd(100 * F.exp(F.sum("_r").over(running())), 4)
    df = daily.withColumn("_r", r).withColumn("c", c)
    df = df.withColumn("o", F.coalesce(F.lag("c").over(by()), F.col("c")))
    h = rnd(F.greatest("o", "c") * (1 + 0.01 * (F.col("n") % 3)), 4)
    lo = rnd(F.least("o", "c") * (1 - 0.01 * (F.col("n") % 2)), 4)
    return df.select("ticker", "d", "o", h.alias("h"), lo.alias("l"), "c", "v", "n", "u")


def bench(bars_df: DataFrame) -> DataFrame:
    """d, c: compounded mean return over the tickers. One row per calendar day, so the running product is small."""
    r = F.col("c") / F.lag("c").over(by()) - 1
    daily = bars_df.select("d", r.alias("r")).groupBy("d").agg(F.coalesce(rnd(F.avg("r"), 8), F.lit(0.0)).alias("m"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("d", rnd(100 * F.exp(F.sum(F.log1p("m")).over(w)), 4).alias("c"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, name, sic_code, bucket, market_cap, active."""
    sup, nat, reg = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    last = bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("c", "d").alias("last_c"), F.sum("v").alias("sum_v"))
    sic = F.concat(F.lpad(F.col("n_regionkey").cast("string"), 1, "0"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"),
                   (F.col("s_suppkey") % 3).cast("string"))
    return (sup.join(nat, sup.s_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)
            .join(last, sup.s_suppkey == last.ticker)
            .select("ticker", F.col("s_name").alias("name"), sic.alias("sic_code"), F.col("r_name").alias("bucket"),
                    rnd(F.col("last_c") * F.col("sum_v"), 2).alias("market_cap"),
                    (F.col("s_acctbal") > 0).alias("active")))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and ship quarter with a derived income statement and balance sheet."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    parts = task_parts(li)
    q = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    lines = (li.join(part.select("p_partkey", "p_retailprice"), li.l_partkey == part.p_partkey)
             .select(F.col("l_suppkey").alias("ticker"), q.alias("period_end"), "l_extendedprice", "l_discount", "l_quantity", "l_tax", "p_retailprice"))
    base = (dealt(lines, parts, "ticker", "period_end").groupBy("ticker", "period_end")
            .agg(rnd(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
                 rnd(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("cost_of_revenue"),
                 rnd(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 2).alias("tax"),
                 F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")))
    base = dealt(base, parts, "ticker")
    w = by("ticker", "period_end")
    m2 = lambda c: rnd(c, 2)
    df = (base.withColumn("gross_profit", m2(F.col("revenue") - F.col("cost_of_revenue")))
          .withColumn("net_income", m2(F.col("gross_profit") - F.col("tax") - 0.45 * F.col("revenue")))
          .withColumn("op_cash_flow", m2(F.col("net_income") * (1 + 0.1 * (F.col("n") % 3 - 1))))
          .withColumn("assets", m2(F.sum("revenue").over(w.rowsBetween(-7, 0))))
          .withColumn("liabilities", m2(F.sum("cost_of_revenue").over(w.rowsBetween(-3, 0))))
          .withColumn("shares", F.sum("qty").over(w.rowsBetween(-3, 0)))
          .withColumn("retained_earnings", m2(F.sum("net_income").over(w.rowsBetween(Window.unboundedPreceding, 0))))
          .withColumn("equity", m2(F.col("assets") - F.col("liabilities")))
          .withColumn("current_assets", m2(F.col("assets") * (0.35 + 0.05 * (F.col("n") % 4))))
          .withColumn("current_liabilities", m2(F.col("liabilities") * (0.4 + 0.05 * (F.col("n") % 3))))
          .withColumn("cash", m2(F.col("assets") * 0.08))
          .withColumn("debt", m2(F.col("liabilities") * 0.3))
          .withColumn("capex", m2(F.col("revenue") * 0.04 * (1 + F.col("n") % 2)))
          .withColumn("receivables", m2(F.col("revenue") * 0.15 * (1 + 0.1 * (F.col("n") % 5))))
          .withColumn("inventory", m2(F.col("cost_of_revenue") * 0.1))
          .withColumn("ppe", m2(F.col("assets") * 0.3))
          .withColumn("rd", m2(F.col("revenue") * 0.05))
          .withColumn("sga", m2(F.col("revenue") * 0.1))
          .withColumn("depreciation", m2(F.col("assets") * 0.005))
          .withColumn("interest", m2(F.col("debt") * 0.01))
          .withColumn("dividends", F.when(F.col("n") % 4 == 0, m2(F.col("revenue") * 0.01)).otherwise(F.lit(0.0)))
          .withColumn("buybacks", F.when(F.col("n") % 5 == 0, m2(F.col("revenue") * 0.02)).otherwise(F.lit(0.0)))
          .withColumn("operating_income", m2(F.col("gross_profit") - F.col("rd") - F.col("sga")))
          .withColumn("filed", F.date_add("period_end", (20 + F.col("ticker") % 45).cast("int")))
          .withColumn("q", F.row_number().over(w)))
    return df


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cik, metric, start, end, filed, val, fp, form: the long filing table with gaps in Q4 and restatements."""
    q = quarters(spark, sf_dir)
    long = q.select(F.col("ticker").alias("cik"), "period_end", "filed", "q",
                    F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "val"))
    start = F.trunc("period_end", "quarter")
    quarterly = long.where(~((F.quarter("period_end") == 4) & (F.col("cik") % 4 == 0)))
    quarterly = quarterly.select("cik", "metric", start.alias("start"), F.col("period_end").alias("end"), "filed", "val",
                                 F.concat(F.lit("Q"), F.quarter("period_end")).alias("fp"), F.lit("10-Q").alias("form"), "q")
    restated = (quarterly.where((F.col("cik") + F.col("q")) % 7 == 0)
                .withColumn("val", rnd(F.col("val") * 1.01, 2)).withColumn("filed", F.date_add("filed", 200)))
    flow = F.col("metric").isin("revenue", "cost_of_revenue", "gross_profit", "net_income", "op_cash_flow")
    annual = (long.withColumn("fy", F.year("period_end")).groupBy("cik", "metric", "fy")
              .agg(F.max("period_end").alias("end"), F.max("filed").alias("filed"), F.count(F.lit(1)).alias("k"),
                   F.sum("val").alias("s"), F.max_by("val", "period_end").alias("last"))
              .where("k = 4"))
    annual = annual.select("cik", "metric", F.when(flow, F.make_date("fy", F.lit(1), F.lit(1))).otherwise(F.col("end")).alias("start"),
                           "end", "filed", rnd(F.when(flow, F.col("s")).otherwise(F.col("last")), 2).alias("val"),
                           F.lit("FY").alias("fp"), F.lit("10-K").alias("form"))
    return quarterly.drop("q").unionByName(restated.drop("q")).unionByName(annual)


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quarter, cusip, manager, shares, value_usd, putcall."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    q = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    return (li.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), li.l_orderkey == o.o_orderkey)
            .groupBy(q.alias("quarter"), F.col("l_partkey").alias("cusip"), F.col("o_custkey").alias("manager"),
                     F.when(F.col("l_returnflag") == "R", "PUT").otherwise("").alias("putcall"))
            .agg(F.sum("l_quantity").alias("shares"), rnd(F.sum("l_extendedprice"), 2).alias("value_usd")))


def insider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issuer, filed, owner, code, shares, price, value, is_officer, is_director: one row per order line."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return (li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
            .select(F.col("l_suppkey").alias("issuer"), F.to_date("l_shipdate").alias("filed"),
                    F.col("o_custkey").alias("owner"), F.when(F.col("l_linestatus") == "O", "P").otherwise("S").alias("code"),
                    F.col("l_quantity").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                    F.col("l_extendedprice").alias("value"), (F.col("o_custkey") % 4 == 0).alias("is_officer"),
                    (F.col("o_custkey") % 7 == 0).alias("is_director"), F.col("l_orderkey").alias("accession")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight, tier, confirmed: supplier -> customer segment (tier 1) and customer nation (tier 2)."""
    li, o, cu = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (li.select("l_orderkey", "l_suppkey", "l_extendedprice").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(cu.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
         .join(nat, F.col("c_nationkey") == F.col("n_nationkey")))
    # both edge kinds come out of one pass: each line contributes to its segment and to its nation
    kinds = F.explode(F.array(F.struct(F.col("c_mktsegment").alias("dst"), F.lit(1).alias("tier")),
                              F.struct(F.col("n_name").alias("dst"), F.lit(2).alias("tier"))))
    g = (j.select(F.col("l_suppkey").alias("src"), "l_extendedprice", kinds.alias("k"))
         .groupBy("src", F.col("k.dst").alias("dst"), F.col("k.tier").alias("tier"))
         .agg(rnd(F.sum("l_extendedprice"), 2).alias("rev")))
    w = Window.partitionBy("src", "tier")
    return g.select("src", "dst", "tier", rnd(F.col("rev") / F.sum("rev").over(w), 8).alias("weight"),
                    ((F.col("src") + F.length("dst")) % 5 != 0).alias("confirmed"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, generated_at, model, signal, id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("ticker"), F.col("ts").alias("generated_at"), F.col("event_type").alias("model"),
                    (F.col("value") - 50).alias("signal"), F.col("event_id").alias("id"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ts, price, size, id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("ticker"), "ts", (100 + F.col("value")).alias("price"),
                    F.get_json_object("props", "$.k").cast("double").alias("size"), F.col("event_id").alias("id"))


def articles(spark: SparkSession, sf_dir: str, of=None) -> DataFrame:
    """doc_id, ticker, published, publisher, title, body, sentiment. `of` selects from the articles before their labels are joined
    (doc_id among it): a body it has read and does not keep is not shuffled."""
    doc, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n_sup = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_sup"))
    sent = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("sentiment")
    cols = ["doc_id", (F.col("doc_id") % F.col("n_sup")).alias("ticker"),
            F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("doc_id") * 7) % 30).cast("int")).alias("published"),
            F.col("source").alias("publisher"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body")]
    if of is not None:
        kept = of(doc.crossJoin(n_sup).select(*cols))
        return kept.join(lab, "doc_id", "left").select(*kept.columns, sent)
    return doc.join(lab, "doc_id", "left").crossJoin(n_sup).select(*cols, sent)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """underlying, strike, days_to_expiry, iv, oi_call, oi_put, vol_call, vol_put, one row per contract."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = li.select("l_partkey", "l_quantity", "l_linestatus", "l_returnflag").join(
        p.select("p_partkey", "p_brand", "p_retailprice", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    is_o = F.col("l_linestatus") == "O"
    q = F.col("l_quantity")
    return (j.groupBy(F.col("p_brand").alias("underlying"), (F.floor(F.col("p_retailprice") / 10 + 0.5) * 10.0).alias("strike"),
                      (F.col("p_size") * 7).alias("days_to_expiry"), (0.15 + 0.01 * (F.col("p_size") % 20)).alias("iv"))
            .agg(F.sum(F.when(is_o, q).otherwise(0.0)).alias("oi_call"), F.sum(F.when(~is_o, q).otherwise(0.0)).alias("oi_put"),
                 F.sum(F.when(is_o & (F.col("l_returnflag") == "N"), q).otherwise(0.0)).alias("vol_call"),
                 F.sum(F.when(~is_o & (F.col("l_returnflag") == "R"), q).otherwise(0.0)).alias("vol_put")))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ipo, delist, reason."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("ticker")).agg(F.to_date(F.min("l_shipdate")).alias("ipo"),
                                                          F.to_date(F.max("l_shipdate")).alias("last_d"))
    gone = F.col("ticker") % 9 == 0
    reason = F.element_at(F.array(*[F.lit(x) for x in DELIST_REASONS]), ((F.col("ticker") / 9).cast("int") % 6 + 1).cast("int"))
    return g.select("ticker", "ipo", F.when(gone, F.col("last_d")).alias("delist"), F.when(gone, reason).alias("reason"))


def factor_returns(spark: SparkSession, sf_dir: str, rets: DataFrame) -> DataFrame:
    """d, f, fr: mean return of the instruments of each region; a handful of factor series."""
    sup, nat = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    m = sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(F.col("s_suppkey").alias("ticker"), F.col("n_regionkey").alias("f"))
    return (rets.where("r is not null").select("ticker", "d", "r").join(m, "ticker").groupBy("d", "f")
            .agg(rnd(F.avg("r"), 8).alias("fr")))
