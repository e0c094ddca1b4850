"""Ranks that do not need a whole group in one task.

Per-date cross-sections use plain windows: there are thousands of dates and a date holds one row per instrument.
Where a few groups hold everything (a sector, a horizon, the whole table) `with_rank_stats` is used instead: equal
values are counted first, the distinct values of each group are cut at split points of equal depth, and a row's position
is the count of the lower parts plus its position inside its own part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def avg_rank(value, key, ) -> Column:
    """Average rank (ties share the mean rank) of non-null values inside a window partition."""
    v = F.col(value) if isinstance(value, str) else value
    keys = [key] if isinstance(key, str) else list(key)
    null = v.isNull()
    wr = Window.partitionBy(*keys, null).orderBy(v)
    wt = Window.partitionBy(*keys, v)
    return F.when(~null, F.rank().over(wr) + (F.count(F.lit(1)).over(wt) - 1) / 2.0)


def _place(value: Column, splits: Column) -> Column:
    """Number of split points (an array of arrays, both ascending) at or below a value: first the block, then the place in it."""
    block = F.size(F.filter(splits, lambda b: b[0] <= value))
    inside = F.size(F.filter(F.get(splits, block - 1), lambda v: v <= value))
    return F.when(block > 0, (block - 1) * F.size(splits[0]) + inside).otherwise(0)


def split_points(hist: DataFrame, keys: list[str], value: str, side: int = 16) -> DataFrame:
    """keys, _splits: side * side points that cut the distinct values of a group into parts of equal size, from a mergeable quantile
    sketch (one per group and task); whatever the distribution, a part holds about 1 / side**2 of them."""
    n = side * side
    sketch = F.percentile_approx(value, [(i + 1) / (n + 1) for i in range(n)], 20 * n)
    blocks = F.array(*[F.slice("_q", 1 + i * side, side) for i in range(side)])
    return hist.groupBy(*keys).agg(sketch.alias("_q"), F.sum("_c").alias("_n")).select(*keys, "_n", blocks.alias("_splits"))


def rank_table(hist: DataFrame, kn: list[str]) -> DataFrame:
    """Of counted values (kn, _v, _c): kn, _v, _c, _n (rows of the group) and _less (rows with a smaller value)."""
    binned = hist.join(split_points(hist, kn, "_v"), kn).withColumn("_bin", _place(F.col("_v"), F.col("_splits"))).drop("_splits")
    inside = Window.partitionBy(*kn, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*kn).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (binned.groupBy(*kn, "_bin").agg(F.sum("_c").alias("_b"))
               .select(*kn, "_bin", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_off")))
    less = F.col("_off") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    return binned.join(offsets, [*kn, "_bin"]).select(*kn, "_v", "_c", "_n", less.alias("_less"))


def ranked_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values of several columns with their ranks: _column, _v, _c, _n, _less."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(x).alias("_column"), F.col(x).cast("double").alias("_v")) for x in cols])).alias("_e")).select("_e.*")
    hist = long.where(F.col("_v").isNotNull()).groupBy("_column", "_v").agg(F.count(F.lit(1)).alias("_c"))
    return rank_table(hist, ["_column"])


def exact_quantiles(df: DataFrame, cols: list[str], parts: int = 100) -> DataFrame:
    """_column, i, q: the i / parts quantiles of each column (0 <= i <= parts), linear between neighbours, from exact ranks.

    No task holds the values of a column: a value finds the quantiles whose lower or upper neighbour it is from its own ranks, so what
    is brought together are two numbers for each quantile."""
    a, end, gaps = F.col("_less"), F.col("_less") + F.col("_c"), F.greatest(F.col("_n") - 1, F.lit(1))
    up = lambda x: F.floor((x + gaps - 1) / gaps)
    lower = (up(a * parts), F.least(up(end * parts) - 1, F.lit(parts)))
    upper = (F.when(a > 0, F.floor((a - 1) * parts / gaps) + 1).otherwise(0), F.least(F.floor((end - 1) * parts / gaps), F.lit(parts)))
    one = F.col("_n") == 1
    spread = lambda lo, hi: F.when(one, F.sequence(F.lit(0), F.lit(parts))).when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int")))
    x = ranked_values(df, cols)
    ends = [x.select("_column", "_n", "_v", F.explode(spread(*r)).alias("i"), F.lit(side).alias("side")) for side, r in (("lower", lower), ("upper", upper))]
    g = ends[0].unionByName(ends[1]).groupBy("_column", "i").agg(F.max("_n").alias("n"), F.max(F.when(F.col("side") == "lower", F.col("_v"))).alias("lo"), F.max(F.when(F.col("side") == "upper", F.col("_v"))).alias("hi"))
    at = F.col("i") * (F.col("n") - 1) / parts
    return g.select("_column", "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))).alias("q"))


def upper_middles(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with a column for each of `cols`: the smallest value with more than half of the values at or below it."""
    half = F.floor(F.col("_n") / 2)
    hit = (F.col("_less") <= half) & (half < F.col("_less") + F.col("_c"))
    return ranked_values(df, cols).agg(*[F.max(F.when(hit & (F.col("_column") == x), F.col("_v"))).alias(x) for x in cols])


def with_rank_stats(df: DataFrame, keys: list[str], value: str, prefix: str = "") -> DataFrame:
    """Adds n (non-null values of the group), n_less and n_equal (self included) as long columns.

    Exact for any distribution: the split points only decide where the counting happens. The input is read by several branches,
    so it is kept (memory, then disk) for the time of the query.
    """
    df = df.persist()
    src = df if keys else df.withColumn("_all", F.lit(1))
    kn = keys or ["_all"]
    hist = src.where(F.col(value).isNotNull()).groupBy(*kn, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    named = {"_n": prefix + "n", "_c": prefix + "n_equal", "_less": prefix + "n_less"}
    r = rank_table(hist, kn).withColumnsRenamed({**named, **{k: "_k_" + k for k in kn}})
    cond = F.col(value).eqNullSafe(F.col("_v"))
    for k in kn:
        cond = cond & F.col(k).eqNullSafe(F.col("_k_" + k))
    return src.join(r, cond, "left").drop("_v", "_all", *["_k_" + k for k in kn])
