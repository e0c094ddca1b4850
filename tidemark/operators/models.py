"""Cross-sectional models with pyspark.ml: every fit and prediction is a distributed job over the panel.

`build` arguments are functions that return a pyspark.ml estimator with columns `features`, `label` and `prediction`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import exact_quantiles

c = F.col


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    x = df.select("*", *[F.coalesce(c(f), F.lit(0.0)).alias("_f_" + f) for f in features])
    return VectorAssembler(inputCols=["_f_" + f for f in features], outputCol=out).transform(x).drop(*["_f_" + f for f in features])


def ridge(n_rows: int, l2: float = 10.0) -> LinearRegression:
    """Ridge on standardised features; the penalty is per row here, so l2 is divided by the row count."""
    return LinearRegression(regParam=l2 / max(n_rows, 1), elasticNetParam=0.0, standardization=True)


def boosted(depth: int = 4, rounds: int = 20) -> GBTRegressor:
    return GBTRegressor(maxDepth=depth, maxIter=rounds, stepSize=0.1, seed=7)


def fit_predict(train: DataFrame, test: DataFrame, build: Callable[[], Estimator]) -> DataFrame:
    return build().fit(train).transform(test)


def out_of_fold(df: DataFrame, build: Callable[[], Estimator], index: str = "i", n_folds: int = 3, embargo: int = 5, min_train: int = 40) -> DataFrame:
    """Predictions of expanding folds on rows no fold was trained on. `index` is the position of the row's date, the loop
    runs over a handful of folds and only plans work; every fit is one distributed job."""
    n = df.agg((F.max(index) + 1).alias("n")).first()["n"]
    size = max(5, (n - min_train - embargo) // n_folds)
    out = None
    for k in range(n_folds):
        end = min_train + k * size
        lo, hi = end + embargo, min(end + embargo + size, n)
        if lo >= n or hi - lo < 2:
            break
        p = fit_predict(df.where(c(index) < end), df.where((c(index) >= lo) & (c(index) < hi)), build).withColumn("fold", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


def oof_ensemble(df: DataFrame, builders: dict[str, Callable[[], Estimator]], weights: dict[str, float], keys: list[str], **folds) -> DataFrame:
    """Weighted mean of several models on the rows all of them predict."""
    out = None
    for name, b in builders.items():
        p = out_of_fold(df, b, **folds).select(*keys, c("prediction").alias(name))
        out = p if out is None else out.join(p, keys)
    tot = sum(weights[n] for n in builders)
    return out.withColumn("ensemble", sum((c(n) * weights[n] for n in builders), F.lit(0.0)) / tot)


def importances(df: DataFrame, features: list[str], seed: int = 7) -> DataFrame:
    """Impurity importance of a forest, permutation importance and the single-feature score, with their .2/.4/.4 mean.

    A feature is permuted by joining it back at a shifted row position inside the same date, so no column is collected."""
    x = df.where("label is not null").withColumn("y", (c("label") > 0.5).cast("double"))
    rf = RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=4, seed=seed)
    model = rf.fit(assemble(x, features))
    acc = lambda d: d.agg(F.avg((c("prediction") == c("y")).cast("double")).alias("a")).first()["a"]
    base = acc(model.transform(assemble(x, features)))
    w = Window.partitionBy("d").orderBy(F.xxhash64("ticker"))
    rows = []
    for i, f in enumerate(features):
        shuffled = x.withColumn(f, F.coalesce(F.lead(f).over(w), F.first(f).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        single = rf.fit(assemble(x, [f])).transform(assemble(x, [f]))
        rows.append((f, float(model.featureImportances[i]), base - acc(model.transform(assemble(shuffled, features))), acc(single)))
    t = df.sparkSession.createDataFrame(rows, "feature string, mdi double, mda double, sfi double")
    return t.withColumn("consensus", 0.2 * c("mdi") + 0.4 * c("mda") + 0.4 * c("sfi"))


def meta_model(df: DataFrame, features: list[str]) -> DataFrame:
    """P(primary call is right) from the features, the prediction and its size; needs five rows of each class."""
    k = df.groupBy("correct").agg(F.count(F.lit(1)).alias("k")).where("k >= 5").count()
    if k < 2:
        return df.withColumn("p_correct", F.lit(0.5))
    x = assemble(df.withColumn("abs_pred", F.abs("prediction")), [*features, "prediction", "abs_pred"], "mf").withColumn("w", F.lit(1.0))
    m = GBTClassifier(labelCol="correct", featuresCol="mf", predictionCol="meta_prediction", maxDepth=3, maxIter=10, seed=7, weightCol="w").fit(x)
    return m.transform(x).withColumn("p_correct", vector_to_array("probability")[1])


def regime_clusters(df: DataFrame, features: list[str], k: int = 5, seed: int = 7) -> DataFrame:
    """Clusters of standardised market state, numbered by mean return less half the volatility."""
    v = assemble(df, features, "raw")
    v = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    p = KMeans(k=k, seed=seed).fit(v).transform(v)
    o = p.groupBy("prediction").agg((F.avg(features[0]) - 0.5 * F.avg(features[1])).alias("s"))
    o = o.withColumn("regime", F.row_number().over(Window.orderBy("s")) - 1)  # k rows
    return p.join(o, "prediction").drop("raw", "features", "s", "prediction")


def percentile_position(values: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """Raw values to their place among the 101 training percentiles (strictly-below count / 100, missing is .5).
    The percentiles are one row of arrays."""
    arrays = exact_quantiles(train, cols).groupBy("_column").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda e: e["q"]).alias("q"))  # 101 each
    t = arrays.agg(*[F.max(F.when(c("_column") == f, c("q"))).alias("_q_" + f) for f in cols])
    pos = lambda f: F.when(c(f).isNull(), 0.5).otherwise(F.least(F.size(F.filter("_q_" + f, lambda v: v < c(f))) / 100, F.lit(1.0)))
    return values.crossJoin(t).select(*[k for k in values.columns if k not in cols], *[pos(f).alias(f) for f in cols])


class FeatureRegistry:
    """Named feature functions (bars -> ticker, d, value) and the versioned long table they fill."""

    def __init__(self) -> None:
        self._fns: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}

    def register(self, name: str, category: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        if name in self._fns:
            raise ValueError(f"feature {name} is already registered")
        self._fns[name] = (category, fn)

    def compute(self, bars: DataFrame, version: int = 1) -> DataFrame:
        """All features as rows (ticker, as_of, feature, category, version, value)."""
        out = None
        for name, (cat, fn) in self._fns.items():
            x = fn(bars).select("ticker", c("d").alias("as_of"), F.lit(name).alias("feature"), F.lit(cat).alias("category"), F.lit(version).alias("version"), "value")
            out = x if out is None else out.unionByName(x)
        return out

    @staticmethod
    def get(table: DataFrame, feature: str, as_of: str) -> DataFrame:
        """Newest value of a feature per ticker as of a date, highest version first."""
        x = table.where((c("feature") == feature) & (c("as_of") <= F.lit(as_of).cast("date")) & c("value").isNotNull())
        return x.groupBy("ticker").agg(F.max_by("value", F.struct("as_of", "version")).alias("value"), F.max("as_of").alias("as_of"))
