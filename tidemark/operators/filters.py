"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import by, with_tail

# Capitalisation tiers, name suffixes, industry keyword rules, delisting returns.
CAP_TIERS = (("nano", 0.0, 50e6), ("micro", 50e6, 300e6), ("small", 300e6, 2e9), ("mid", 2e9, 10e9), ("large", 10e9, 200e9),
             ("mega", 200e9, float("inf")))
SHELL_PHRASES = ("BLANK CHECK",)


def pit_as_of(facts: DataFrame, as_of: str, column: str = "filed", lag_days: int = 0) -> DataFrame:
    """Rows knowable on as_of: filed on or before it, less an optional lag. The fiscal period plays no part."""
    return facts.where(F.col(column) <= F.date_sub(F.lit(as_of).cast("date"), lag_days))


def prices_before(bars: DataFrame, as_of: str, lookback: int = 252) -> DataFrame:
    """Strictly before as_of and at most 1.5 x lookback calendar days back."""
    t = F.lit(as_of).cast("date")
    return bars.where((F.col("d") < t) & (F.col("d") >= F.date_sub(t, int(1.5 * lookback))))


def universe_as_of(members: DataFrame, as_of: str) -> DataFrame:
    """Listed by then and not yet delisted; names that are delisted later stay in."""
    t = F.lit(as_of).cast("date")
    return members.where((F.col("ipo") <= t) & (F.col("delist").isNull() | (F.col("delist") > t)))


def liquid_universe(bars: DataFrame, top_n: int, min_price: float, min_dollar_vol: float, sessions: int = 7) -> DataFrame:
    """Mean dollar volume over the newest sessions of the market; the price floor applies per row, three sessions needed."""
    days = bars.select("d").distinct().orderBy(F.col("d").desc()).limit(sessions)
    g = (bars.join(days, "d", "left_semi").where(F.col("c") >= min_price).groupBy("ticker")
         .agg(F.avg(F.col("c") * F.col("v")).alias("avg_dv"), F.count(F.lit(1)).alias("k")))
    return g.where((F.col("k") >= 3) & (F.col("avg_dv") >= min_dollar_vol)).orderBy(F.col("avg_dv").desc(), "ticker").limit(top_n)


def price_prefilter(bars: DataFrame, as_of: str, min_dd: float = 0.35, min_price: float = 2.0, min_adv: float = 1e6) -> DataFrame:
    """Names with 200 bars in three years, deep enough below their high, dear and liquid enough. One aggregation."""
    t = F.lit(as_of).cast("date")
    w = Window.partitionBy("ticker").orderBy(F.col("d").desc())
    x = bars.where((F.col("d") <= t) & (F.col("d") >= F.date_sub(t, 3 * 366))).withColumn("_k", F.row_number().over(w))
    hi = F.max(F.when(F.col("d") >= F.date_sub(t, 1095), F.col("c")))
    g = x.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"), (1 - F.max(F.when(F.col("_k") == 1, F.col("c"))) / hi).alias("drawdown"),
                                F.max(F.when(F.col("_k") == 1, F.col("c"))).alias("price"),
                                F.avg(F.when(F.col("_k") <= 60, F.col("c") * F.col("v"))).alias("adv"))
    return g.where((F.col("n_bars") >= 200) & (F.col("drawdown") >= min_dd) & (F.col("price") >= min_price) & (F.col("adv") >= min_adv))


def is_shell(text: Column) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in SHELL_PHRASES]), lambda p: F.contains(F.upper(text), p)), F.lit(False))


def cut_after_break(series: DataFrame, value: str = "c", limit: float = 0.60) -> DataFrame:
    """Keeps the rows from the last one-session move over the limit on."""
    move = F.abs(F.col(value) / F.lag(value).over(by()) - 1)
    x = series.withColumn("_m", move)
    x = x.withColumn("_cut", F.max(F.when(F.col("_m") > limit, F.col("d"))).over(Window.partitionBy("ticker")))
    return x.where(F.col("_cut").isNull() | (F.col("d") >= F.col("_cut"))).drop("_m", "_cut")


def clean_quarters(q: DataFrame, key="cik", order="end", value="val", floor: float = 0.20) -> DataFrame:
    """Drops a quarter that is positive but under floor x the median of its positive neighbours, two on each side."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    near = F.array(*[f(value, k).over(w) for f in (F.lag, F.lead) for k in (1, 2)])
    x = q.withColumn("_n", n).withColumn("_a", F.array_sort(F.filter(near, lambda v: v > 0))).withColumn("_m", F.size("_a"))
    mid = (F.try_element_at("_a", F.floor((F.col("_m") + 1) / 2).cast("int")) + F.try_element_at("_a", F.floor(F.col("_m") / 2 + 1).cast("int"))) / 2
    bad = (F.col("_n") >= 3) & (F.col(value) > 0) & (F.col(value) < floor * mid)
    return x.where(~F.coalesce(bad, F.lit(False))).drop("_n", "_a", "_m")


def valid_shares(q: DataFrame, primary="diluted", fallback="basic", order="period_end", floor: float = 1e6) -> DataFrame:
    """First of the two counts above the floor, carried forward and then backward."""
    ok = F.when(F.col(primary) > floor, F.col(primary)).when(F.col(fallback) > floor, F.col(fallback))
    w = by("ticker", order)
    x = q.withColumn("_s", ok)
    fwd = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first("_s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return x.withColumn("valid_shares", F.coalesce(fwd, back)).drop("_s")


def validate_prices(b: DataFrame, max_move: float = 0.5, z: float = 4.0) -> DataFrame:
    """Issue counts per ticker: non-positive prices (dropped first), extreme log moves, |z| outliers."""
    good = b.where(F.col("c") > 0)
    x = good.select("ticker", F.log(F.col("c") / F.lag("c").over(by())).alias("x"))
    w = Window.partitionBy("ticker")
    x = x.withColumn("_z", (F.col("x") - F.avg("x").over(w)) / (F.stddev_samp("x").over(w) + 1e-10))
    bad = b.groupBy("ticker").agg(F.sum((F.col("c") <= 0).cast("int")).alias("n_nonpositive"))
    flags = x.groupBy("ticker").agg(F.sum((F.abs("x") > max_move).cast("int")).alias("n_extreme"), F.sum((F.abs("_z") > z).cast("int")).alias("n_outliers"))
    return bad.join(flags, "ticker", "left")


def lookahead_violations(features: DataFrame, sources: DataFrame) -> DataFrame:
    """Feature rows (ticker, as_of) that read a source row dated after as_of."""
    last = sources.groupBy("ticker").agg(F.max("ts").alias("max_ts"))
    return features.join(last, "ticker").where(F.col("max_ts") > F.col("as_of")).withColumn("severity", F.lit("CRITICAL"))


def cap_tier(cap: Column) -> Column:
    c = F.when(cap.isNull() | (cap <= 0), "unknown")
    for name, _, hi in CAP_TIERS:
        c = c.when(cap < hi, name)
    return c.otherwise("unknown")


def cap_tier3(cap: Column, small: float = 300e6, mid: float = 2e9, large: float = 10e9) -> Column:
    return F.when(cap >= large, "large").when(cap >= mid, "mid").when(cap >= small, "small")


def bucket_for(text: Column, rules: list[tuple[str, list[str]]], default: str | None = "Other") -> Column:
    """First rule with a keyword inside the text; the default when none."""
    up = F.upper(text)
    hits = [F.when(F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(up, k)), name) for name, keys in rules]
    return F.coalesce(*hits, F.lit(default))


def sic_levels(code: Column) -> list[Column]:
    """Four, three and two digit keys, null for codes that are not numeric."""
    z = F.lpad(F.trim(code), 4, "0")
    ok = z.rlike("^[0-9]{4}$")
    return [F.when(ok, F.substring(z, 1, n)) for n in (4, 3, 2)]


LEGAL_WORDS = ("LLC|L\\.?P|INC|CORP|CO|LTD|PLC|GROUP|HOLDINGS|ADVISORS?|ADVISERS?|MANAGEMENT|MGMT|CAPITAL|PARTNERS|TRUST|BANK|"
               "INVESTMENTS?|ASSET|INTERNATIONAL|GLOBAL|COMPANY")


def family_name(name: Column, families: list[tuple[str, str]]) -> Column:
    """Parent of a manager: first listed needle inside the name, else the name without legal words, title-cased."""
    up = F.upper(name)
    listed = [F.when(F.contains(up, F.lit(needle)), label) for label, needle in families]
    base = F.regexp_replace(F.regexp_replace(name, "[.,]", " "), f"(?i)\\b({LEGAL_WORDS})\\b", " ")
    base = F.trim(F.regexp_replace(base, "\\s+", " "))
    return F.coalesce(*listed, F.when(F.length(base) > 0, F.initcap(base)), name, F.lit("unknown"))


def newest_features(b: DataFrame) -> DataFrame:
    """Newest row per ticker of a with_returns frame."""
    return with_tail(b).where("k = 0").drop("k")
