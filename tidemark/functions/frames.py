"""Row-frame helpers.

Every per-instrument window in this package runs over *daily* rows: intraday rows are first aggregated to one row
per (ticker, day), so a window partition holds at most one row per calendar day however hot the instrument is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "ticker"
DAY = "d"


def by(key=KEY, order=DAY) -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def last_n(n: int, key=KEY, order=DAY) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return by(key, order).rowsBetween(-(n - 1), 0)


def between(lo: int, hi: int, key=KEY, order=DAY) -> WindowSpec:
    return by(key, order).rowsBetween(lo, hi)


def running(key=KEY, order=DAY) -> WindowSpec:
    return by(key, order).rowsBetween(Window.unboundedPreceding, 0)


def whole(key=KEY) -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key))


def full(agg, value, n: int, key=KEY, order=DAY) -> Column:
    """Rolling aggregate that stays null until the frame holds n non-null values."""
    v = F.col(value) if isinstance(value, str) else value
    w = last_n(n, key, order)
    return F.when(F.count(v).over(w) == n, agg(v).over(w))


def task_parts(rows: DataFrame, per_task: int = 250_000) -> int:
    """Number of partitions that gives a task about `per_task` of the rows; 0 where the session's own tasks are as many. A table read
    from Parquet is counted from its file footers."""
    n = rows.count() // per_task
    return n if n > rows.sparkSession.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, n: int, *keys) -> DataFrame:
    """Deals rows by `keys` to `n` partitions, so that memory of a task does not grow with the table; as it is for n = 0."""
    return df.repartition(n, *keys) if n else df


def _built(df: DataFrame, one: Column, sizes, name: str, merge, w: WindowSpec) -> tuple[DataFrame, dict[int, str]]:
    """Frames of the newest n rows put together from shorter ones that end a few rows earlier, so that a row costs a few lags and not n
    rows. `one` is the state of a single row (null: no value), `merge(a, na, b, nb)` that of two neighbouring frames."""
    made = {1: f"_{name}1"}
    df = df.withColumn(made[1], one)

    def build(df: DataFrame, n: int) -> DataFrame:
        if n in made:
            return df
        a = max((k for k in made if k < n <= 2 * k), default=(n + 1) // 2)
        df = build(build(df, a), n - a)
        made[n] = f"_{name}{n}"
        x, y = F.col(made[a]), F.lag(made[n - a], a).over(w)
        df = df.withColumn("_y", y)
        return df.withColumn(made[n], F.when(x.isNotNull() & F.col("_y").isNotNull(), merge(x, a, F.col("_y"), n - a))).drop("_y")

    for n in sorted(sizes):
        df = build(df, n)
    return df, made


def with_rolled(df: DataFrame, value: str, sizes, out: str, key=KEY, order=DAY) -> DataFrame:
    """Adds `{out}s_{n}` and `{out}d_{n}`, sum and sample deviation of the newest n values, for every n of `sizes`; null until the frame
    holds n non-null values. As `full` of F.sum and F.stddev_samp, without going through n rows for each row. Moments are merged, never
    subtracted, so equal values have a deviation of 0."""
    v = F.col(value).cast("double")
    one = F.when(v.isNotNull(), F.struct(v.alias("s"), v.alias("m"), F.lit(0.0).alias("q")))

    def merge(a: Column, na: int, b: Column, nb: int) -> Column:
        gap, n = b["m"] - a["m"], na + nb
        return F.struct((a["s"] + b["s"]).alias("s"), (a["m"] + gap * (nb / n)).alias("m"), (a["q"] + b["q"] + gap * gap * (na * nb / n)).alias("q"))

    df, made = _built(df, one, sizes, out, merge, by(key, order))
    cols = [x for n in sizes for x in (F.col(made[n])["s"].alias(f"{out}s_{n}"), F.sqrt(F.try_divide(F.col(made[n])["q"], F.lit(float(n - 1)))).alias(f"{out}d_{n}"))]
    return df.select("*", *cols).drop(*made.values())


def with_pair_rolled(df: DataFrame, x: str, y: str, n: int, out: str = "_x", key=KEY, order=DAY) -> DataFrame:
    """Adds the struct `out` of the newest n rows, null where a key has fewer: sums sx and sy, and the sums of products of deviations
    qxx, qyy and qxy. x and y are not null."""
    a, b, zero = F.col(x).cast("double"), F.col(y).cast("double"), F.lit(0.0)
    one = F.struct(a.alias("sx"), b.alias("sy"), a.alias("mx"), b.alias("my"), zero.alias("qxx"), zero.alias("qyy"), zero.alias("qxy"))

    def merge(p: Column, np_: int, q: Column, nq: int) -> Column:
        gx, gy, k, f = q["mx"] - p["mx"], q["my"] - p["my"], np_ + nq, np_ * nq / (np_ + nq)
        return F.struct((p["sx"] + q["sx"]).alias("sx"), (p["sy"] + q["sy"]).alias("sy"), (p["mx"] + gx * (nq / k)).alias("mx"), (p["my"] + gy * (nq / k)).alias("my"),
                        (p["qxx"] + q["qxx"] + gx * gx * f).alias("qxx"), (p["qyy"] + q["qyy"] + gy * gy * f).alias("qyy"), (p["qxy"] + q["qxy"] + gx * gy * f).alias("qxy"))

    df, made = _built(df, one, [n], out, merge, by(key, order))
    return df.withColumn(out, F.col(made[n])).drop(*made.values())


def with_rolled_max(df: DataFrame, value: str, n: int, out: str, key=KEY, order=DAY) -> DataFrame:
    """Adds the largest of the newest n values (fewer at the start of a key), put together from frames of half the length."""
    w = by(key, order)
    df, m = df.withColumn(out, F.col(value)), 1
    while m < n:
        step = min(m, n - m)
        df, m = df.withColumn(out, F.greatest(out, F.lag(out, step).over(w))), m + step
    return df


def with_returns(bars: DataFrame) -> DataFrame:
    """Adds rn (1-based row number), r (simple return) and lr (log return) per ticker."""
    w = by()
    prev = F.lag("c", 1).over(w)
    return bars.select(
        "*",
        F.row_number().over(w).alias("rn"),
        (F.col("c") / prev - 1).alias("r"),
        F.log(F.col("c") / prev).alias("lr"),
    )


def with_tail(b: DataFrame) -> DataFrame:
    """Adds k, the distance from the newest row of the ticker (0 = newest), to the output of with_returns."""
    return b.withColumn("k", F.count(F.lit(1)).over(whole()) - F.col("rn"))


def latest(df: DataFrame, key=KEY, order=DAY, n: int = 1) -> DataFrame:
    """The newest n rows per key. The rank filter is pushed below the shuffle as a per-task top-n."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")


def sdiv(a, b) -> Column:
    """Null when the denominator is zero or null."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp that keeps null (greatest/least would skip it)."""
    return F.when(c.isNull(), None).otherwise(F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def rnd(c, places: int = 0) -> Column:
    """Half-up rounding on the binary value, the same on every engine (decimal-text rounding is not)."""
    c = F.col(c) if isinstance(c, str) else c
    f = float(10 ** places)
    return F.floor(c.cast("double") * f + 0.5) / f


def with_lead_split(df: DataFrame, key: str, order: list[str], value: str, n: int, name: str, rows: int = 100_000) -> DataFrame:
    """Adds `name`: the value `n` rows later of the same key, without a window over a whole key.

    A key of more than `rows` rows is cut at split points of equal depth of the first order column (a timestamp) into blocks of about
    `rows` rows. The first `n` rows of a block are also sent to the `n` blocks with rows before it, as a halo that is dropped again, so
    a task sees one block and at most n * n rows more. Rows of one timestamp stay together."""
    from tidemark.functions.ranks import _place, split_points

    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > rows).select(key)
    cuts = split_points(df.join(large, key, "left_semi").select(key, at.alias("_v"), F.lit(1).alias("_c")), [key], "_v")
    parts = F.least(F.lit(257), F.ceil(F.col("_n") / rows))
    block = F.when(F.col("_n").isNull(), 0).otherwise(F.floor(_place(at, F.col("_splits")) * parts / 257)).cast("int")
    x = df.join(cuts, key, "left").withColumn("_block", block).drop("_n", "_splits")
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    heads = x.join(large, key, "left_semi").select(key, *order, value, "_block").withColumn("_i", F.row_number().over(inside)).where(F.col("_i") <= n).drop("_i")
    nth = heads.select(key, "_block").distinct().withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy("_block")))  # a row per block
    sent = nth.select(key, "_block", F.explode(F.sequence(F.col("_at") - n, F.col("_at") - 1)).alias("_at")).join(nth.select(key, "_at", F.col("_block").alias("_to")), [key, "_at"])
    halo = heads.join(sent.drop("_at"), [key, "_block"]).drop("_block").withColumnRenamed("_to", "_block")
    both = x.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)), allowMissingColumns=True)
    return both.withColumn(name, F.lead(value, n).over(inside)).where("not _halo").drop("_halo", "_block")
