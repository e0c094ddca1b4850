"""Exponential moving averages as window sums.

The recursion y_k = a*x_k + (1-a)*y_(k-1) is linear, so y_k = q^k * sum_i w_i x_i q^-i with q = 1-a. To keep q^-i
inside double range for any history length the rows are cut into blocks of 1024; a block is summed on its own and the
tails of the earlier blocks (a handful, one per 1024 daily rows) are folded into a carry. Both windows sort by
(key, block, day), so any number of averages shares one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def _carry(decay: float):
    return lambda acc, x: acc * decay + x


def with_ewms(df: DataFrame, specs: dict[str, tuple[str, float]], key="ticker", order="d", rn: str = "rn",
              first: int = 1) -> DataFrame:
    """Adds one recursive (adjust=False) average per entry {out: (value column, alpha)}, started at row number `first`
    and null before it. `rn` is the 1-based row number of the key; values from `first` on must be non-null."""
    keys = [key] if isinstance(key, str) else list(key)
    for _, a in specs.values():
        if not 0 < a <= 0.5:
            raise ValueError("alpha must be in (0, 0.5]")
    df = df.withColumn("_pos", F.pmod(F.col(rn) - 1, F.lit(BLOCK))).withColumn("_blk", F.floor((F.col(rn) - 1) / F.lit(BLOCK)))
    live, start = F.col(rn) >= first, F.col(rn) == first
    wb = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    wk = Window.partitionBy(*keys).orderBy("_blk", order).rowsBetween(Window.unboundedPreceding, -1)

    def powq(a: float, e: Column) -> Column:
        return F.pow(F.lit(1.0 - a), e)

    local = []
    for out, (value, a) in specs.items():
        x = F.when(live, F.when(start, F.col(value)).otherwise(F.col(value) * a) * powq(a, -F.col("_pos")))
        local.append((F.sum(x).over(wb) * powq(a, F.col("_pos"))).alias("_loc_" + out))
    df = df.select("*", *local)
    tails = [F.collect_list(F.when(F.col("_pos") == BLOCK - 1, F.col("_loc_" + o))).over(wk).alias("_tail_" + o) for o in specs]
    df = df.select("*", *tails)
    outs = []
    for out, (_, a) in specs.items():
        carry = F.aggregate("_tail_" + out, F.lit(0.0), _carry((1.0 - a) ** BLOCK))
        y = F.coalesce(F.col("_loc_" + out), F.lit(0.0)) + F.when(F.col("_blk") > 0, carry * powq(a, F.col("_pos") + 1)).otherwise(0.0)
        outs.append(F.when(live, y).alias(out))
    drop = ["_pos", "_blk", *["_loc_" + o for o in specs], *["_tail_" + o for o in specs]]
    return df.select("*", *outs).drop(*drop)


def with_ewm(df: DataFrame, out: str, value, alpha: float, first: int = 1, **kw) -> DataFrame:
    """One average; `value` may be a column expression."""
    if isinstance(value, str):
        return with_ewms(df, {out: (value, alpha)}, first=first, **kw)
    return with_ewms(df.withColumn("_val", value), {out: ("_val", alpha)}, first=first, **kw).drop("_val")


def span(n: int) -> float:
    return 2.0 / (n + 1.0)
