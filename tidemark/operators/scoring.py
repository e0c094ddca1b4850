"""Signal scoring: a catalog is a table, scoring is a join, roll-ups are aggregations; there is no code per signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import with_rank_stats
from tidemark.functions.scores import absolute_band
from tidemark.operators.aggregates import verdict, weighted_rollup

c = F.col
CATALOG_SCHEMA = ("module string, category string, id string, field string, weight double, category_weight double, module_weight double, higher boolean, good double, great double, "
                  "floor double, floor_score double, cap double, cap_score double, ranked boolean, status string")


def catalog(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Spec rows of a scoring catalog as a table."""
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def score_signals(features: DataFrame, spec: DataFrame, group: str = "bucket") -> DataFrame:
    """features: ticker, group, field, value (long). Percentile among the group's values of the field when it has five,
    else the absolute band; floor and cap then clamp. Reference and pending signals carry no score."""
    x = with_rank_stats(features, [group, "field"], "value", prefix="_p_")
    x = x.join(spec, "field")
    pct = 100.0 * (c("_p_n_less") + 0.5 * c("_p_n_equal")) / c("_p_n")
    pct = F.when(c("ranked") & (c("_p_n") >= 5), F.when(c("higher"), pct).otherwise(100 - pct))
    raw = F.coalesce(pct, absolute_band(c("value"), c("good"), c("great"), c("higher")))
    worse = lambda t: F.when(c("higher"), c("value") < t).otherwise(c("value") > t)
    better = lambda t: F.when(c("higher"), c("value") > t).otherwise(c("value") < t)
    s = F.when(c("floor").isNotNull() & worse(c("floor")), F.least(raw, c("floor_score"))).otherwise(raw)
    s = F.when(c("cap").isNotNull() & better(c("cap")), F.greatest(s, c("cap_score"))).otherwise(s)
    method = (F.when(c("status") == "reference", "reference").when(c("status") == "needs_source", "needs_source").when(c("value").isNull(), "missing")
              .when(pct.isNotNull(), "percentile").otherwise("absolute"))
    return x.withColumn("method", method).withColumn("score", F.when(c("method").isin("percentile", "absolute"), F.floor(s * 10 + 0.5) / 10)).drop("_p_n", "_p_n_less", "_p_n_equal")


def module_scores(scored: DataFrame) -> DataFrame:
    """Signal -> category -> module; each level is rounded before the next."""
    cat = weighted_rollup(scored, ["ticker", "module", "category", "category_weight", "module_weight"])
    return weighted_rollup(cat, ["ticker", "module", "module_weight"], weight="category_weight")


def conviction(modules: DataFrame, registered: float) -> DataFrame:
    """Weighted mean of the live module scores, coverage of the registered weight, verdict."""
    live = F.when(c("score").isNotNull(), c("module_weight"))
    g = modules.groupBy("ticker").agg((F.floor(F.sum(c("score") * c("module_weight")) / F.sum(live) * 10 + 0.5) / 10).alias("conviction"), (F.sum(live) / registered).alias("coverage"), F.count("score").alias("live_modules"))
    return g.withColumn("verdict", verdict(c("conviction")))


def peer_advantages(own: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Each field less the exact median of the group, the group's revenue share. One aggregation per group, joined back."""
    med = own.groupBy(group).agg(*[F.percentile(f, F.lit(0.5)).alias("_m_" + f) for f in fields], F.sum("revenue").alias("_rev"), F.count(F.lit(1)).alias("peers"))
    return own.join(med, group).where("peers >= 5").select("ticker", group, *[(c(f) - c("_m_" + f)).alias(f + "_advantage") for f in fields], (c("revenue") / c("_rev")).alias("market_share"),
                                                           F.when(c("growth") - c("_m_growth") < -0.05, 1.0).otherwise(0.0).alias("share_loss_risk"))


def field_percentiles(long: DataFrame, group: str) -> DataFrame:
    """Strictly-below share of every field inside the group (at least five values)."""
    x = with_rank_stats(long, [group, "field"], "value", prefix="_p_")
    return x.withColumn("pct", F.when(c("_p_n") >= 5, c("_p_n_less") / c("_p_n"))).drop("_p_n", "_p_n_less", "_p_n_equal")


def rank_composite(pct: DataFrame, group: str) -> DataFrame:
    """Mean percentile and the shares of fields in the top and bottom quartile."""
    return pct.groupBy("ticker", group).agg(F.avg("pct").alias("composite"), F.avg((c("pct") >= 0.75).cast("double")).alias("top_quartile"), F.avg((c("pct") <= 0.25).cast("double")).alias("bottom_quartile"), F.count("pct").alias("n_fields"))


def style_ensemble(f: DataFrame) -> DataFrame:
    """Logistic style scores (value, momentum, quality, growth), fixed-weight blend, agreement and probability."""
    logit = lambda x: 1 / (1 + F.exp(-x))
    z = lambda col, mid, width: F.when(c(col).isNotNull(), logit((c(col) - mid) / width))
    inv = lambda x: F.when(x.isNotNull(), 1 - x)

    def mean(*xs: Column) -> Column:
        a = F.array_compact(F.array(*xs))
        return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))

    m = {"value": mean(inv(z("pe", 25.0, 12.0)), z("earnings_yield", 0.04, 0.03)), "momentum": mean(z("mom_6m", 0.0, 0.15), z("mom_3m", 0.0, 0.1)), "quality": mean(z("roic", 0.12, 0.08), z("roe", 0.15, 0.1), z("net_margin", 0.1, 0.08)), "growth": mean(z("growth", 0.05, 0.1))}
    wt = {"value": 0.20, "momentum": 0.22, "quality": 0.24, "growth": 0.22}
    x = f.select("ticker", *[v.alias(k) for k, v in m.items()])
    num = sum((F.coalesce(c(k) * w, F.lit(0.0)) for k, w in wt.items()), F.lit(0.0))
    den = sum((F.when(c(k).isNotNull(), w).otherwise(0.0) for k, w in wt.items()), F.lit(0.0))
    cnt = lambda cond: sum((F.coalesce(cond(c(k)).cast("int"), F.lit(0)) for k in wt), F.lit(0))
    n = sum((c(k).isNotNull().cast("int") for k in wt), F.lit(0))
    x = x.withColumn("ensemble", num / den).withColumn("agreement", F.greatest(cnt(lambda v: v > 0.55), cnt(lambda v: v < 0.45)) / n)
    return x.withColumn("up_probability", logit((c("ensemble") - 0.5) * 6)).withColumn("conviction", F.abs(c("ensemble") - 0.5) * 2)


def ic_weights(ics: DataFrame, key: str, order: str, back: int = 12) -> DataFrame:
    """Exponentially weighted recent coefficient per model, negative ones dropped, normalised; equal when nothing is left."""
    w = Window.partitionBy(key).orderBy(c(order).desc())
    x = ics.withColumn("k", F.row_number().over(w)).where(c("k") <= back)
    x = x.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    e = F.exp(F.when(c("n") > 1, -(c("k") - 1) / (c("n") - 1)).otherwise(-1.0))
    g = x.groupBy(key).agg((F.sum(c("ic") * e) / F.sum(e)).alias("recent_ic"))
    t = g.agg(F.sum(F.greatest("recent_ic", F.lit(0.0))).alias("t"), F.count(F.lit(1)).alias("m"))
    return g.crossJoin(t).select(key, "recent_ic", F.when(c("t") < 0.001, 1 / c("m")).otherwise(F.greatest("recent_ic", F.lit(0.0)) / c("t")).alias("weight"))
