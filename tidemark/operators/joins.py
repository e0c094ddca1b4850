"""As-of, range and dimension joins.

An as-of join is a union of both sides ordered by time with a running last value: one shuffle on the key, no range
condition. Where one key can hold a large share of the rows, `bucket` splits its time line: the running value is taken
inside (key, bucket) and the last value of the earlier buckets is carried in over the much smaller bucket table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str],
              bucket: Column | None = None, prefix: str = "", forward: bool = False) -> DataFrame:
    """Adds to every left row the values of the newest right row with right_ts <= left_ts (null when none), or with
    forward=True of the first one with right_ts >= left_ts.
    Of several right rows with one timestamp the one with the greatest `values` tuple is used."""
    if forward and bucket is not None:
        raise ValueError("bucket is for the backward form")
    cols = left.columns
    ls = left.select(F.struct(*cols).alias("_row"), F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
                     F.lit(None).cast(right.select(F.struct(F.col(right_ts).alias("_ts"), *values).alias("x")).schema["x"].dataType).alias("_v"))
    rs = right.groupBy(F.col(key).alias("_k"), F.col(right_ts).alias("_t")).agg(F.max(F.struct(F.col(right_ts).alias("_ts"), *values)).alias("_v"))
    rs = rs.select(F.lit(None).cast(ls.schema["_row"].dataType).alias("_row"), "_k", "_t", F.lit(0).alias("_side"), "_v")
    u = ls.unionByName(rs)
    if bucket is None:
        time = F.col("_t").desc() if forward else F.col("_t")
        w = Window.partitionBy("_k").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_m", F.last("_v", ignorenulls=True).over(w))
    else:
        u = u.withColumn("_b", bucket)
        w = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        tails = u.where("_side = 0").groupBy("_k", "_b").agg(F.max_by("_v", "_t").alias("_tail"))
        spine = u.select("_k", "_b").distinct().join(tails, ["_k", "_b"], "left")
        wc = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carry = spine.select("_k", "_b", F.last("_tail", ignorenulls=True).over(wc).alias("_carry"))
        u = u.withColumn("_m", F.last("_v", ignorenulls=True).over(w)).join(carry, ["_k", "_b"]).withColumn("_m", F.coalesce("_m", "_carry"))
    out = u.where("_side = 1").select("_row.*", *[F.col(f"_m.{v}").alias(prefix + v) for v in values])
    return out


def close_on_or_after(bars: DataFrame, points: DataFrame, slip: int = 10) -> DataFrame:
    """First close within [x, x + slip] days for points (ticker, x)."""
    return _slip(bars, points, F.col("x"), F.date_add("x", slip), slip, F.min_by)


def close_on_or_before(bars: DataFrame, points: DataFrame, slip: int = 10) -> DataFrame:
    """Last close within [x - slip, x] days; only for a current point, never for history."""
    return _slip(bars, points, F.date_sub("x", slip), F.col("x"), slip, F.max_by)


def _slip(bars, points, low, high, slip, pick):
    """The join is equi over buckets of slip + 1 days: a point goes to the one or two that its days fall in. A row for each day would be
    eleven times the rows that the planner expects, and it would broadcast them."""
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(slip + 1))
    cand = points.select("ticker", "x", low.alias("_low"), high.alias("_high")).where("x is not null")
    cand = cand.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(F.col("_low")), bucket(F.col("_high"))))))
    days = bars.select("ticker", "d", "c", bucket(F.col("d")).alias("_b"))
    hit = cand.join(days, ["ticker", "_b"]).where("d between _low and _high").groupBy("ticker", "x").agg(pick("c", "d").alias("c"))
    return points.join(hit, ["ticker", "x"], "left")


def nearest_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, tol: int = 45, bucket_days: int = 91) -> DataFrame:
    """Value whose date is nearest within tol days; the earlier date wins a tie. Time is cut into buckets wider than
    2 x tol, and a right row is sent to each bucket its tolerance reaches, so the join is on (key, bucket)."""
    day = lambda c: F.unix_date(c)
    r = right.select(F.col(key), F.col(right_ts).alias("_rt"), F.col(value).alias("_rv"),
                     F.explode(F.array_distinct(F.array(F.floor((day(right_ts) - tol) / bucket_days), F.floor(day(right_ts) / bucket_days),
                                                        F.floor((day(right_ts) + tol) / bucket_days)))).alias("_b"))
    lft = left.withColumn("_b", F.floor(day(left_ts) / bucket_days))
    gap = F.abs(F.datediff(F.col(left_ts), F.col("_rt")))
    m = lft.join(r, [key, "_b"]).where(gap <= tol).groupBy(key, left_ts).agg(F.min(F.struct(gap.alias("g"), F.col("_rt"), F.col("_rv"))).alias("_m"))
    m = m.select(key, left_ts, F.col("_m._rv").alias("nearest_" + value), F.col("_m.g").alias("gap_days"), F.col("_m._rt").alias("matched"))
    return left.join(m, [key, left_ts], "left")


def year_ago(q: DataFrame, key: str, ts: str, value: str, tol: int = 45, last: bool = False) -> DataFrame:
    """Row of the same series nearest to 365 days earlier within tol days (the earlier one wins a tie), or with last=True the newest
    candidate. Frames are ranges of days, so the match does not depend on how many rows a series has in a year."""
    rows = q.withColumn("_day", F.unix_date(ts))
    over = lambda agg, lo, hi: agg.over(Window.partitionBy(key).orderBy("_day").rangeBetween(lo, min(hi, -1)))
    row = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    if last:
        rows = rows.withColumn("_c", over(F.max(row), -365 - tol, -365 + tol))
    else:
        rows = rows.withColumn("_b", over(F.max(F.struct(F.col(ts).alias("t"), (-F.col(value)).alias("v"))), -365 - tol, -365)).withColumn("_a", over(F.min(row), -365, -365 + tol))
        side = lambda t, v: F.when(t.isNotNull(), F.struct(F.abs(F.datediff(F.date_sub(F.col(ts), 365), t)).alias("g"), t.alias("t"), v.alias("v")))
        rows = rows.withColumn("_c", F.array_min(F.array(side(F.col("_b.t"), -F.col("_b.v")), side(F.col("_a.t"), F.col("_a.v"))))).drop("_a", "_b")
    return rows.withColumn("prior_end", F.col("_c.t")).withColumn("prior", F.col("_c.v")).drop("_c", "_day")


def forward_exit(bars: DataFrame, points: DataFrame, days: int, slip: int = 10) -> DataFrame:
    """Entry: first close after x; exit: first close on or after x + days, at most slip days later (null if not matured).
    Both are forward as-of joins, so a bar is read once per join and not once per point."""
    b = bars.select("ticker", "d", "c")
    x = points.select("ticker", "x").distinct().withColumn("_from", F.date_add("x", 1)).withColumn("_to", F.date_add("x", days))
    x = asof_join(x, b, "ticker", "_from", "d", ["c"], prefix="in_", forward=True)
    x = asof_join(x, b, "ticker", "_to", "d", ["d", "c"], prefix="out_", forward=True)
    x = x.where(F.col("out_d") <= F.date_add("x", days + slip))
    return x.select("ticker", "x", F.col("in_c").alias("entry"), F.col("out_c").alias("exit")).withColumn("ret", F.col("exit") / F.col("entry") - 1)


def base_pair_stats(series: DataFrame, base: int, market: DataFrame, min_days: int = 120) -> DataFrame:
    """One base instrument against every other on shared days: correlation, market-residual correlation, beta.

    The base series is one row per day, so the join is on the day and each peer is aggregated once; no pair of peers
    is ever formed. Residual correlation is the partial correlation given the market."""
    b = series.where(F.col("ticker") == base).select("d", F.col("c").alias("bc"))
    w = Window.partitionBy("ticker").orderBy("d")
    x = series.where(F.col("ticker") != base).select("ticker", "d", "c").join(b, "d").join(market.select("d", F.col("c").alias("mc")), "d")
    x = x.select("ticker", F.log(F.col("c") / F.lag("c").over(w)).alias("y"), F.log(F.col("bc") / F.lag("bc").over(w)).alias("x"),
                 F.log(F.col("mc") / F.lag("mc").over(w)).alias("m")).where("y is not null")
    g = x.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.corr("x", "y").alias("correlation"), F.corr("x", "m").alias("rxm"), F.corr("y", "m").alias("rym"),
                                (F.covar_samp("x", "y") / F.var_pop("x")).alias("beta_to_base"))
    part = (F.col("correlation") - F.col("rxm") * F.col("rym")) / F.sqrt((1 - F.col("rxm") ** 2) * (1 - F.col("rym") ** 2))
    return g.where(F.col("days") >= min_days - 1).select("ticker", "days", "correlation", part.alias("residual_correlation"), "beta_to_base")


def concurrency(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Number of label spans [t0, t1] open on every bar: +1/-1 marks and a running sum instead of a range join."""
    marks = events.select("ticker", F.explode(F.array(F.struct(F.col("t0").alias("d"), F.lit(1).alias("x")),
                                                      F.struct(F.date_add("t1", 1).alias("d"), F.lit(-1).alias("x")))).alias("m"))
    marks = marks.groupBy("ticker", F.col("m.d").alias("d")).agg(F.sum("m.x").alias("x"))
    u = marks.withColumn("bar", F.lit(0)).unionByName(bars.select("ticker", "d", F.lit(0).cast("bigint").alias("x"), F.lit(1).alias("bar")))
    w = Window.partitionBy("ticker").orderBy("d", "bar").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("open_spans", F.sum("x").over(w)).where("bar = 1").select("ticker", "d", "open_spans")


def peer_group(universe: DataFrame) -> DataFrame:
    """Narrowest peer key with enough names: 4-digit code (4), 3-digit (8), 2-digit (8), then the bucket; Other has none."""
    from tidemark.operators.filters import sic_levels

    s4, s3, s2 = sic_levels(F.col("sic_code"))
    x = universe.withColumn("s4", s4).withColumn("s3", s3).withColumn("s2", s2)
    for k in ("s4", "s3", "s2"):
        cnt = x.where(F.col(k).isNotNull()).groupBy("bucket", k).agg(F.count(F.lit(1)).alias("n_" + k))
        x = x.join(cnt, ["bucket", k], "left")
    key = (F.when(F.col("bucket") == "Other", None).when(F.col("n_s4") >= 4, F.concat(F.lit("4:"), "s4"))
           .when(F.col("n_s3") >= 8, F.concat(F.lit("3:"), "s3")).when(F.col("n_s2") >= 8, F.concat(F.lit("2:"), "s2"))
           .otherwise(F.concat(F.lit("b:"), "bucket")))
    return x.select("ticker", "bucket", "sic_code", key.alias("peer_key"))


#: Words that company names are compared without.
NAME_SUFFIXES = r"\b(inc|corp|corporation|company|co|ltd|limited|plc|llc|lp|holdings?|group|technologies|technology|systems|solutions|industries|international|n\.?v|s\.?a|a\.?g|s\.?e|kk|ab|as|oyj)\b\.?"


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), NAME_SUFFIXES, ""), "[^a-z0-9 ]", ""))


def name_index(names: DataFrame) -> DataFrame:
    """key, ticker: whole names of four letters and more (the smallest ticker of equal names), and first words of five and more that
    one name only begins with and that are no whole name."""
    u = names.select(name_key(F.col("name")).alias("key"), "ticker")
    whole = u.where("length(key) >= 4").groupBy("key").agg(F.min("ticker").alias("ticker"))
    first = u.select(F.substring_index("key", " ", 1).alias("key"), "ticker").where("length(key) >= 5").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ticker").alias("ticker"))
    return whole.unionByName(first.where("n = 1").drop("n").join(whole, "key", "left_anti"))


def resolve_entities(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mentions (id, name) -> ticker and rule by normalised name: `exact`; the longest run of leading `words` of five letters and more;
    or a `prefix`: names that begin with a mention of six letters and more, or that it begins with (five and more), if all are one
    ticker's. Distinct mentions are resolved once. Both prefix directions are equi-joins over exploded prefixes, where names with a
    common prefix are first reduced to their least and largest ticker."""
    index = name_index(names)
    keyed = mentions.select("id", name_key(F.col("name")).alias("key"))
    k = keyed.select("key").distinct().where("key <> ''")
    exact = k.join(index, "key").select("key", F.lit(3).alias("by"), F.lit(0).alias("n"), "ticker")
    words = F.filter(F.split("key", " +"), lambda w: w != "")
    runs = k.select("key", words.alias("w")).select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.lit(1), n), " ").alias("head")))).alias("r")).select("key", "r.*")
    run = runs.where("length(head) >= 5").join(index.withColumnRenamed("key", "head"), "head").select("key", F.lit(2).alias("by"), "n", "ticker")
    heads = lambda c, least: F.explode(F.transform(F.sequence(F.lit(least), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n))).alias("head")
    long = k.where("length(key) >= 6")
    inside = long.select("key", heads("key", 5)).join(index.withColumnRenamed("key", "head"), "head").select("key", F.col("ticker").alias("low"), F.col("ticker").alias("high"))
    begun = index.where("length(key) >= 6").select("ticker", heads("key", 6)).groupBy("head").agg(F.min("ticker").alias("low"), F.max("ticker").alias("high"))
    around = long.join(begun.withColumnRenamed("head", "key"), "key").select("key", "low", "high")
    prefix = inside.unionByName(around).groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high").select("key", F.lit(1).alias("by"), F.lit(0).alias("n"), F.col("low").alias("ticker"))
    best = exact.unionByName(run).unionByName(prefix).groupBy("key").agg(F.max(F.struct("by", "n", "ticker")).alias("b"))
    rule = F.when(F.col("b.by") == 3, "exact").when(F.col("b.by") == 2, "words").when(F.col("b.by") == 1, "prefix")
    return keyed.join(best, "key", "left").select("id", F.col("b.ticker").alias("ticker"), rule.alias("rule"))


def network_momentum(edges: DataFrame, shocks: DataFrame, floor: float = 0.10, centrality: float = 1.0, attention: float = 1.0) -> DataFrame:
    """Sum of neighbour shock x weight x tier decay over confirmed edges above the floor, with the strongest neighbour."""
    decay = F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.5).when(F.col("tier") == 3, 0.25).otherwise(0.0)
    x = edges.where(F.col("confirmed") & (F.col("weight") >= floor)).join(shocks, "dst")
    x = x.withColumn("c", F.col("shock") * F.col("weight") * decay * centrality * attention)
    return x.groupBy("src").agg(F.sum("c").alias("momentum"), F.count(F.lit(1)).alias("n_edges"),
                                F.max(F.struct(F.abs("c").alias("a"), F.col("dst").alias("dst"))).alias("_t")).select(
        "src", "momentum", "n_edges", F.col("_t.dst").alias("top_neighbour"))
