"""Window operators: cross-sectional ranks and normalisation, running statistics, runs and filing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ewm import with_ewms
from tidemark.functions.frames import by, clip, running, with_tail
from tidemark.functions.normal import norm_ppf
from tidemark.functions.ranks import avg_rank, with_rank_stats


def cs_rank_pct(df: DataFrame, value: str, day: str = "d") -> Column:
    """Average-rank percentile inside a date; 0.5 for everyone when under five values, null stays null otherwise."""
    n = F.count(value).over(Window.partitionBy(day))
    return F.when(n < 5, 0.5).otherwise(avg_rank(value, day) / n)


def cs_rank_minmax(value: str, day: str = "d", tie: str = "ticker") -> Column:
    """Non-null values to position/(n-1), ties by the tiebreak column; null when fewer than two."""
    w = Window.partitionBy(day, F.col(value).isNull()).orderBy(value, tie)
    n = F.count(value).over(Window.partitionBy(day))
    return F.when(F.col(value).isNotNull() & (n >= 2), (F.row_number().over(w) - 1) / (n - 1))


def cs_robust(df: DataFrame, value: str, day: str = "d") -> DataFrame:
    """(x - median)/IQR clipped to +-3; the sample deviation stands in for a zero IQR; null under five values.
    The date statistics are one aggregation joined back."""
    g = df.groupBy(day).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"), F.count(value).alias("_n"), F.stddev_samp(value).alias("_s"))
    iqr = F.col("_p")[2] - F.col("_p")[0]
    scale = F.when(iqr > 0, iqr).otherwise(F.col("_s") + 1e-10)
    return df.join(g, day).withColumn("robust", F.when(F.col("_n") >= 5, clip((F.col(value) - F.col("_p")[1]) / scale, -3, 3))).drop("_p", "_n", "_s")


def cs_past_only(df: DataFrame, as_of: DataFrame, value: str, back: int = 60) -> DataFrame:
    """Cross-section of each as_of date scaled by median and IQR of the `back` earlier cross-sections, then ranked and sent
    through the normal quantile. A row goes only to the few as_of dates whose look-back holds it. as_of: d (sessions)."""
    days = df.select("d").distinct()
    w = Window.orderBy("d")  # one row per session
    cal = days.withColumn("i", F.row_number().over(w))
    ask = cal.join(as_of.select("d"), "d", "left_semi").withColumnRenamed("d", "as_of").withColumnRenamed("i", "ai")
    need = ask.select("as_of", F.explode(F.sequence(F.greatest(F.col("ai") - back, F.lit(1)), F.col("ai") - 1)).alias("i")).where("i >= 1")
    past = df.join(cal.join(need, "i").select("d", "as_of"), "d")
    par = past.groupBy("as_of").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"))
    cur = df.withColumnRenamed("d", "as_of").join(par, "as_of").where(F.col(value).isNotNull())
    iqr = F.col("_p")[2] - F.col("_p")[0]
    cur = cur.withColumn("z", clip((F.col(value) - F.col("_p")[1]) / F.when(iqr == 0, 1.0).otherwise(iqr), -3, 3))
    n = F.count("z").over(Window.partitionBy("as_of"))
    return cur.withColumn("pct", clip(avg_rank("z", "as_of") / n, 0.01, 0.99)).withColumn("normal_score", norm_ppf(F.col("pct"))).select("ticker", "as_of", "z", "pct", "normal_score")


def percentile_ranks(df: DataFrame, keys: list[str], value: str, prefix: str = "") -> DataFrame:
    """Midpoint percentile (0..100) and strictly-below share, null under five values. Groups may be of any size."""
    x = with_rank_stats(df, keys, value, prefix="_p_")
    ok = F.col("_p_n") >= 5
    return x.withColumn(prefix + "pct_mid", F.when(ok, 100.0 * (F.col("_p_n_less") + 0.5 * F.col("_p_n_equal")) / F.col("_p_n"))).withColumn(
        prefix + "pct_below", F.when(ok, F.col("_p_n_less") / F.col("_p_n"))).drop("_p_n", "_p_n_less", "_p_n_equal")


def drawdown(b: DataFrame) -> DataFrame:
    m = F.max("c").over(running())
    return b.select("ticker", "d", "c", m.alias("peak"), (F.col("c") / m - 1).alias("dd"))


def drawdown_duration(b: DataFrame) -> DataFrame:
    """Deepest drawdown, days from its peak to recovery (or the end), share of days under water."""
    x = drawdown(b).withColumn("_pp", F.lag("peak").over(by()))
    x = x.withColumn("peak_d", F.last(F.when(F.col("_pp").isNull() | (F.col("c") > F.col("_pp")), F.col("d")), ignorenulls=True).over(running()))
    w = Window.partitionBy("ticker")
    t = F.min(F.struct("dd", "d", "peak", "peak_d")).over(w)
    x = x.withColumn("_t", t)
    rec = F.min(F.when((F.col("d") > F.col("_t.d")) & (F.col("c") >= F.col("_t.peak")), F.col("d")))
    g = x.groupBy("ticker").agg(F.min("dd").alias("max_drawdown"), F.first("_t.peak_d").alias("p"), rec.alias("rec"), F.max("d").alias("last"),
                                F.avg(F.when(F.col("dd") < -0.001, 1.0).otherwise(0.0)).alias("underwater_share"))
    return g.select("ticker", "max_drawdown", F.datediff(F.coalesce("rec", "last"), "p").alias("duration_days"), "underwater_share", F.col("rec").isNotNull().alias("recovered"))


def ewm_adjusted(df: DataFrame, alpha: float, first: int = 2) -> DataFrame:
    """Bias-corrected exponentially weighted deviation of r, and beta to mr, from running weighted sums (no weights join)."""
    k = F.col("rn") - first + 1
    q = 1 - alpha
    start = F.col("rn") == first
    cols = {"_x": F.col("r"), "_xx": F.col("r") ** 2, "_m": F.col("mr"), "_mm": F.col("mr") ** 2, "_xm": F.col("r") * F.col("mr")}
    for name, c in cols.items():
        df = df.withColumn(name, F.when(start, c * alpha).otherwise(c))
    df = with_ewms(df, {"_s" + n: (n, alpha) for n in cols}, first=first)
    sw, sw2 = (1 - F.pow(F.lit(q), k)) / (1 - q), (1 - F.pow(F.lit(q), 2 * k)) / (1 - q * q)
    mean = lambda n: F.col("_s" + n) / alpha / sw
    corr = sw * sw / (sw * sw - sw2)
    var = (mean("_xx") - mean("_x") ** 2) * corr
    cov, vm = mean("_xm") - mean("_x") * mean("_m"), mean("_mm") - mean("_m") ** 2
    return df.where(k >= 10).select("ticker", "d", F.sqrt(F.greatest(var, F.lit(0.0))).alias("ewm_std"), (cov / (vm + 1e-10 / corr)).alias("ewm_beta"))


def last_n_slopes(b: DataFrame, n: int = 63) -> DataFrame:
    """Least-squares slopes of the last n closes, on-balance volumes and money-flow lines, each over its own mean."""
    sign = F.coalesce(F.signum("r"), F.lit(0.0))
    flow = F.when(F.col("h") == F.col("l"), 0.0).otherwise(F.try_divide(2 * F.col("c") - F.col("l") - F.col("h"), F.col("h") - F.col("l"))) * F.col("v")
    x = with_tail(b).withColumn("obv", F.sum(F.col("v") * sign).over(running())).withColumn("ad", F.sum(flow).over(running())).where(F.col("k") < n)
    x = x.withColumn("i", (-F.col("k")).cast("double"))
    sl = lambda c, a: F.regr_slope(c, "i") / (a + 1e-9)
    return x.groupBy("ticker").agg(sl("obv", F.abs(F.avg("obv"))).alias("obv_slope"), sl("c", F.avg("c")).alias("price_slope"), sl("ad", F.abs(F.avg("ad"))).alias("ad_line_slope")).withColumn(
        "price_vol_divergence", F.col("obv_slope") - F.col("price_slope"))


def ttm(series: DataFrame, key: str = "cik", lo: int = 230, hi: int = 320) -> DataFrame:
    """Sum of four consecutive quarters whose ends span lo..hi days; known when the last of the four is filed."""
    w4 = Window.partitionBy(key).orderBy("end").rowsBetween(-3, 0)
    w = Window.partitionBy(key).orderBy("end")
    x = series.select(key, "end", F.sum("val").over(w4).alias("ttm"), F.max("filed").over(w4).alias("knowable"), F.datediff("end", F.lag("end", 3).over(w)).alias("span"))
    return x.where(F.col("span").between(lo, hi)).drop("span")


def q4_synthesis(quarterly: DataFrame, annual: DataFrame) -> DataFrame:
    """Fourth quarter = year minus exactly three quarters that end inside it, when positive and not filed itself.
    A quarter can only belong to a year that ends in its own or the next calendar year, so the join is on (key, year)."""
    miss = annual.join(quarterly.select("cik", "end"), ["cik", "end"], "left_anti").select("cik", F.col("end").alias("ae"), F.col("val").alias("av"), F.col("filed").alias("af"))
    gap = F.datediff("ae", "end")
    near = quarterly.select("cik", "end", "val", "filed", F.explode(F.array(F.year("end"), F.year("end") + 1)).alias("_y"))
    j = miss.withColumn("_y", F.year("ae")).join(near, ["cik", "_y"]).where((gap > 0) & (gap < 380) & (gap <= 320))
    g = j.groupBy("cik", "ae", "av", "af").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("s"), F.max("filed").alias("qf"))
    add = g.where((F.col("n") == 3) & (F.col("av") - F.col("s") > 0)).select("cik", F.col("ae").alias("end"), (F.col("av") - F.col("s")).alias("val"), F.greatest("af", "qf").alias("filed"))
    return quarterly.select("cik", "end", "val", "filed").unionByName(add)


def cumulative_to_discrete(points: DataFrame) -> DataFrame:
    """Year-to-date values to quarters: inside one fiscal-year start, value minus the value before it. Points are classed
    by length; a point with a frame is preferred among several of one window."""
    n = F.datediff("end", "start")
    cls = F.when(n.between(85, 95), 1).when(n.between(175, 195), 2).when(n.between(265, 285), 3).when(n.between(350, 380), 4)
    x = points.withColumn("cls", cls).where("cls is not null")
    x = x.groupBy("cik", "start", "end").agg(F.max_by("val", F.struct(F.col("framed").cast("int"), F.col("filed"))).alias("val"))
    w = Window.partitionBy("cik", "start").orderBy("end")
    return x.select("cik", "end", (F.col("val") - F.coalesce(F.lag("val").over(w), F.lit(0.0))).alias("val"))


def streak(df: DataFrame, key: str, order: str, ok: Column, out: str = "streak") -> DataFrame:
    """Number of newest consecutive rows for which `ok` holds; the first failing or missing row ends it."""
    x = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    w = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_bad", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(w))
    return x.groupBy(key).agg(F.sum(F.when(F.col("_bad") == 0, 1).otherwise(0)).alias(out))


def accumulation_streak(b: DataFrame, bar: float = 0.55) -> DataFrame:
    """Newest consecutive five-row weeks whose up-day share of volume is over the bar."""
    x = with_tail(b).withColumn("wk", F.floor(F.col("k") / 5)).withColumn("up", F.when(F.col("c") > F.lag("c").over(by()), F.col("v")).otherwise(0.0))
    g = x.where("rn > 1").groupBy("ticker", "wk").agg((F.sum("up") / F.sum("v")).alias("share"), F.count(F.lit(1)).alias("n")).where("n = 5").withColumn("neg", -F.col("wk"))
    return streak(g, "ticker", "neg", F.col("share") > bar, "accum_streak_weeks")


def first_durable_rise(df: DataFrame, key: str, order: str, value: str, k: int = 3) -> DataFrame:
    """Start (the row before the first rise) of the first run of at least k consecutive rises."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.select(key, order, (F.col(value) > F.lag(value).over(w)).alias("up"), F.lag(order).over(w).alias("prev"), F.row_number().over(w).alias("i")).where("up")
    x = x.withColumn("isl", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy(order)))
    runs = x.groupBy(key, "isl").agg(F.count(F.lit(1)).alias("n"), F.min("prev").alias("start"))
    return runs.where(F.col("n") >= k).groupBy(key).agg(F.min("start").alias("rise_start"))


def run_lengths(df: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Mean closed run length per state (the last run is open and not counted) and persistence from pair counts."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.withColumn("nxt", F.lead(state).over(w)).withColumn("new", F.when(F.col(state) == F.lag(state).over(w), 0).otherwise(1))
    x = x.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = x.groupBy(key, "run", state).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("nxt") == F.col(state)).cast("int")).alias("stay"), F.count("nxt").alias("pairs"),
                                         F.max(F.col("nxt").isNull().cast("int")).alias("open"))
    g = r.groupBy(state).agg(F.avg(F.when(F.col("open") == 0, F.col("n"))).alias("mean_run"), (F.sum("stay") / F.sum("pairs")).alias("p_stay"))
    return g.withColumn("persistence", F.when(F.col("p_stay") < 1, 1 / (1 - F.col("p_stay"))))


def cluster_levels(levels: DataFrame, pct: float = 0.01) -> DataFrame:
    """levels (ticker, kind, level): sorted levels of one kind chained while the gap to the previous is under pct."""
    w = Window.partitionBy("ticker", "kind").orderBy("level")
    x = levels.withColumn("_n", F.when(F.col("level") / F.lag("level").over(w) - 1 < pct, 0).otherwise(1))
    x = x.withColumn("cluster", F.sum("_n").over(Window.partitionBy("ticker", "kind").orderBy("level", F.col("_n").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("ticker", "kind", "cluster").agg(F.avg("level").alias("level"), F.count(F.lit(1)).alias("n"))


def price_ladder(bars: DataFrame, windows=(1, 3, 7, 14, 30, 60, 90)) -> DataFrame:
    """Return of the newest close over each window, against the last close on or before the target day. One pass."""
    x = bars.withColumn("t", F.max("d").over(Window.partitionBy("ticker")))
    g = x.groupBy("ticker").agg(F.max_by("c", "d").alias("now"), *[F.max_by("c", F.when(F.col("d") <= F.date_sub("t", k), F.col("d"))).alias(f"p{k}") for k in windows])
    return g.select("ticker", *[(F.col("now") / F.col(f"p{k}") - 1).alias(f"ret_{k}d") for k in windows])
