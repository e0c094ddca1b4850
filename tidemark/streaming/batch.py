"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def trailing_counts(x: DataFrame, key: str, day: str, spike: float = 1.5) -> DataFrame:
    """7 and 30 day counts per key on every day that any key has rows. Rows are first counted per day; each daily count
    is then sent to the (at most 30) days it is part of."""
    daily = x.groupBy(key, F.col(day).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    cal = x.select(F.col(day).alias("d")).distinct()
    e = daily.select(key, "p", "n", F.explode(F.sequence("p", F.date_add("p", 29))).alias("d")).join(cal, "d", "left_semi")
    g = e.groupBy(key, "d").agg(F.sum(F.when(F.datediff("d", "p") < 7, F.col("n")).otherwise(0)).alias("n7"), F.sum("n").alias("n30"))
    return g.withColumn("spike", F.col("n7") / 7 > spike * (F.col("n30") / 30))


def tick_bars(t: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Open, high, low, close, volume, vwap per instrument and interval; ties on time are broken by id. Partial
    aggregates are merged map-side, so one busy instrument does not travel row by row."""
    o = F.struct("ts", "id")
    g = t.groupBy("ticker", F.window("ts", width).alias("w")).agg(F.min_by("price", o).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", o).alias("c"), F.sum("size").alias("v"), F.sum(F.col("price") * F.col("size")).alias("pv"), F.count(F.lit(1)).alias("n"))
    return g.select("ticker", F.col("w.start").alias("start"), "o", "h", "l", "c", "v", F.when(F.col("v") > 0, F.col("pv") / F.col("v")).alias("vwap"), "n", (F.col("c") / F.col("o") - 1).alias("change"))


def bar_parts(t: DataFrame, minutes: int = 5) -> DataFrame:
    """Every tick as a part of its 5-minute bar: the batch twin of `jobs.closed_bars`."""
    us = F.unix_micros("ts")
    price, one = F.col("price"), F.lit(1).cast("long")
    start = F.timestamp_micros((us - F.pmod(us, F.lit(minutes * 60_000_000))).cast("long"))
    return t.select("ticker", start.alias("start"), us.alias("first_us"), F.col("id").alias("first_id"), price.alias("o"), price.alias("h"), price.alias("l"), us.alias("last_us"), F.col("id").alias("last_id"), price.alias("c"), F.col("size").alias("v"), (price * F.col("size")).alias("pv"), one.alias("n"))


def drift_cusum(b: DataFrame, threshold: float = 5.0, slack: float = 0.5) -> DataFrame:
    """Two-sided CUSUM of standardised returns; both sides restart after an alert. Folded over the daily array."""
    x = b.where("r is not null")
    g = x.groupBy("ticker").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.sort_array(F.collect_list(F.struct("d", "r"))).alias("a"))
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.lit(0).alias("k"), F.lit(None).cast("date").alias("last"))

    def step(acc, e):
        z = (e["r"] - F.col("m")) / (F.col("s") + 1e-10)
        p, n = F.greatest(F.lit(0.0), acc["p"] + z - slack), F.greatest(F.lit(0.0), acc["n"] - z - slack)
        hit = (p > threshold) | (n > threshold)
        return F.struct(F.when(hit, 0.0).otherwise(p).alias("p"), F.when(hit, 0.0).otherwise(n).alias("n"), (acc["k"] + hit.cast("int")).alias("k"), F.when(hit, e["d"]).otherwise(acc["last"]).alias("last"))

    f = F.aggregate("a", zero, step)
    return g.select("ticker", f.alias("f")).select("ticker", F.col("f.k").alias("n_alerts"), F.col("f.last").alias("last_alert"), F.col("f.p").alias("s_plus"), F.col("f.n").alias("s_minus"))


def drawdown_governor(b: DataFrame) -> DataFrame:
    """Running high-water mark and the documented exposure tiers."""
    from tidemark.operators.portfolio import drawdown_tier
    from tidemark.operators.windows import drawdown

    dd = drawdown(b)
    s, t = drawdown_tier(F.col("dd"))
    return dd.select("ticker", "d", "dd", s.alias("scale"), t.alias("status"))


def fill_outcomes(signals: DataFrame, closes: DataFrame, horizons=(5, 21, 63)) -> DataFrame:
    """ret_h of matured signals: entry and exit are the first closes on or after their dates (weekdays only are counted);
    a value that is there is never overwritten. signals: id, ticker, d and optional ret_<h> columns."""
    from tidemark.operators.joins import close_on_or_after

    wd = F.weekday("d")
    s0 = F.when(wd > 4, 4).otherwise(wd)
    base = F.when(wd > 4, F.date_sub("d", wd - 4)).otherwise(F.col("d"))
    x = signals
    pts = x.select("ticker", F.explode(F.array(F.col("d"), *[F.date_add(base, (F.floor((s0 + h) / 5) * 7 + (s0 + h) % 5 - s0).cast("int")) for h in horizons])).alias("x")).distinct()
    px = close_on_or_after(closes, pts).where("c is not null")
    x = x.join(px.select("ticker", F.col("x").alias("d"), F.col("c").alias("entry")), ["ticker", "d"], "left")
    for h in horizons:
        due = F.date_add(base, (F.floor((s0 + h) / 5) * 7 + (s0 + h) % 5 - s0).cast("int"))
        x = x.withColumn("_due", due).join(px.select("ticker", F.col("x").alias("_due"), F.col("c").alias("_exit")), ["ticker", "_due"], "left")
        new = F.col("_exit") / F.col("entry") - 1
        x = x.withColumn(f"ret_{h}", F.coalesce(F.col(f"ret_{h}"), new) if f"ret_{h}" in signals.columns else new).drop("_due", "_exit")
    return x


def merge_outcomes(old: DataFrame, new: DataFrame, closes: DataFrame, horizons=(5, 21, 63)) -> DataFrame:
    """Stored signals and new ones: every signal that still lacks a return is filled again, so one that matures later gets it then."""
    returns = [f"ret_{h}" for h in horizons]
    lacks = F.greatest(*(F.col(r).isNull() for r in returns))
    pending = old.where(lacks).unionByName(new, allowMissingColumns=True)
    return old.where(~lacks).unionByName(fill_outcomes(pending, closes, horizons).select(*old.columns))


def first_rows(x: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key; a min over a struct merges map-side."""
    rest = [c for c in x.columns if c not in (key, order)]
    g = x.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r"))
    return g.select(key, "r.*")


def vol_path(b: DataFrame, lam: float = 0.94) -> DataFrame:
    """Exponential variance started at the first squared return, as a yearly deviation."""
    from tidemark.functions.ewm import with_ewm

    return with_ewm(b, "var", F.col("r") * F.col("r"), 1 - lam, first=2).where("rn > 1").select("ticker", "d", F.sqrt(F.col("var") * 252).alias("ewma_vol"))


