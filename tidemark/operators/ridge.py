"""Walk-forward ridge from prefix sums: every expanding fold is fitted from one pass over the panel.

A date is reduced to the sums of products of its labelled rows (features with nulls as zero, marks of nulls, label, one). Prefix sums
over dates give the moments of every training window; the window's medians fill in for nulls algebraically, so rows are read once to
fit and once to predict, whatever the number of folds. What a fold is solved from is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import rank_table

c = F.col


def dated(panel: DataFrame, date: str, index: str = "i") -> DataFrame:
    """The panel with the position of each row's date."""
    dates = panel.select(date).distinct().withColumn(index, (F.row_number().over(Window.orderBy(date)) - 1).cast("long"))  # a row per date
    return panel.join(dates, date)


def monthly_folds(panel: DataFrame, min_train: int = 12, index: str = "i") -> DataFrame:
    """Fold k is trained on the dates before k and tested on date k."""
    n = panel.select(index).distinct().where(c(index) >= min_train)
    return n.select(c(index).alias("fold"), c(index).alias("train_end"), c(index).alias("lo"), (c(index) + 1).alias("hi"))


def expanding_folds(panel: DataFrame, n_folds: int = 3, embargo: int = 5, min_train: int = 40, index: str = "i") -> DataFrame:
    """Folds of equal test blocks, each with a gap before it; a block of fewer than two dates is none."""
    n = panel.agg((F.max(index) + 1).alias("n"))
    size = F.greatest(F.lit(5), F.floor((c("n") - min_train - embargo) / n_folds))
    x = n.select("n", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    x = x.select(c("fold").cast("long").alias("fold"), (min_train + c("fold") * c("size")).alias("train_end"), "n", "size")
    x = x.withColumn("lo", c("train_end") + embargo).withColumn("hi", F.least(c("train_end") + embargo + c("size"), c("n")))
    return x.where("hi - lo >= 2").select("fold", *(c(k).cast("long").alias(k) for k in ("train_end", "lo", "hi")))


def window_middles(panel: DataFrame, folds: DataFrame, features: list[str], label: str, index: str) -> DataFrame:
    """fold, med: the upper middle value of each feature in each training window (0 for one without nulls, where it is not used)."""
    nulls = panel.agg(*[F.count_if(c(f).isNull()).alias(f) for f in features]).first()
    some = [f for f in features if nulls[f]]
    if not some:
        return folds.select("fold", F.array(*[F.lit(0.0)] * len(features)).alias("med"))
    rows = panel.where(c(label).isNotNull()).join(folds.select("fold", "train_end"), c(index) < c("train_end"))
    long = rows.select("fold", F.explode(F.array(*[F.struct(F.lit(f).alias("_column"), c(f).alias("_v")) for f in some])).alias("_e")).select("fold", "_e.*")
    ranks = rank_table(long.where("_v is not null").groupBy("fold", "_column", "_v").agg(F.count(F.lit(1)).alias("_c")), ["fold", "_column"])
    half = F.floor(c("_n") / 2)
    mids = ranks.where((c("_less") <= half) & (half < c("_less") + c("_c"))).groupBy("fold").agg(*[F.max(F.when(c("_column") == f, c("_v"))).alias(f) for f in some])
    return folds.select("fold").join(mids, "fold", "left").select("fold", F.array(*[F.coalesce(c(f), F.lit(0.0)) if f in some else F.lit(0.0) for f in features]).alias("med"))


def moments(panel: DataFrame, features: list[str], label: str, index: str) -> DataFrame:
    """One row per date with the sums of products of all rows before and on it, as one array (upper triangle, row by row)."""
    u = [F.coalesce(c(f), F.lit(0.0)) for f in features] + [c(f).isNull().cast("double") for f in features] + [c(label), F.lit(1.0)]
    labelled = c(label).isNotNull()
    sums = [F.sum(F.when(labelled, u[i] * u[j])) for i in range(len(u)) for j in range(i, len(u))]
    names = [f"g{k}" for k in range(len(sums))]
    daily = panel.groupBy(index).agg(*[s.alias(n) for s, n in zip(sums, names)])
    before = Window.orderBy(index).rowsBetween(Window.unboundedPreceding, 0)  # a row per date
    return daily.select(index, F.array(*[F.coalesce(F.sum(n).over(before), F.lit(0.0)) for n in names]).alias("g"))


def solve(g: np.ndarray, med: np.ndarray, p: int, l2: float) -> tuple:
    """Means, deviations (1 for a constant), weights and the label's mean from the moments of one window."""
    full = np.zeros((2 * p + 2, 2 * p + 2))
    full[np.triu_indices(2 * p + 2)] = g
    full = full + np.triu(full, 1).T
    fill = np.zeros((2 * p + 2, p + 2))  # the imputed features, label and one, from the sums' columns
    fill[:p, :p], fill[p : 2 * p, :p], fill[2 * p :, p:] = np.eye(p), np.diag(med), np.eye(2)
    s = fill.T @ full @ fill
    n = s[-1, -1]
    mean, y_mean = s[:p, -1] / n, s[p, -1] / n
    cov = s[:p, :p] / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    std[std <= 1e-12 * np.abs(mean)] = 0
    std[std == 0] = 1
    a = n * cov / np.outer(std, std) + l2 * np.eye(p)
    b = (s[:p, p] - n * mean * y_mean) / std
    return n, mean, std, np.linalg.solve(a, b), y_mean


def fits(panel: DataFrame, features: list[str], folds: DataFrame, label: str = "label", index: str = "i", l2: float = 10.0, least: int = 100) -> DataFrame:
    """One row per fold: fold, lo, hi, med, mean, std, w, y_mean; folds with fewer than `least` labelled rows are left out."""
    p = len(features)
    rows = folds.join(moments(panel, features, label, index).withColumnRenamed(index, "_last"), c("_last") == c("train_end") - 1)
    rows = rows.join(window_middles(panel, folds, features, label, index), "fold").select("fold", "lo", "hi", "med", "g")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for r in x.itertuples():
                if r.g[-1] >= least:
                    _, mean, std, w, y_mean = solve(np.asarray(r.g), np.asarray(r.med), p, l2)
                    out.append((r.fold, r.lo, r.hi, r.med, mean, std, w, y_mean))
            yield pd.DataFrame(out, columns=["fold", "lo", "hi", "med", "mean", "std", "w", "y_mean"])

    return rows.mapInPandas(run, "fold long, lo long, hi long, med array<double>, mean array<double>, std array<double>, w array<double>, y_mean double")


def predict(panel: DataFrame, features: list[str], fitted: DataFrame, index: str = "i") -> DataFrame:
    """Test rows of every fold with fold and prediction. Fitted folds are a row per date at most."""
    at = fitted.withColumn(index, F.explode(F.sequence("lo", c("hi") - 1))).drop("lo", "hi")
    x = panel.join(at, index)
    terms = [F.get("w", j) * (F.coalesce(c(f), F.get("med", j)) - F.get("mean", j)) / F.get("std", j) for j, f in enumerate(features)]
    return x.withColumn("prediction", c("y_mean") + sum(terms, F.lit(0.0))).drop("med", "mean", "std", "w", "y_mean")


def walk_forward(panel: DataFrame, features: list[str], folds: DataFrame, **kw) -> DataFrame:
    return predict(panel, features, fits(panel, features, folds, **kw))


def oracle(features: list[str], panel: str, folds: str, l2: float = 10.0, least: int = 100) -> str:
    """CTEs ending in `rp` (fold, prediction and the panel's columns): the same fit by elimination, from a panel with `i` and folds."""
    p = range(len(features))
    med = ", ".join(f"coalesce(list_sort(list({f}) FILTER ({f} IS NOT NULL))[count({f}) // 2 + 1], 0) AS q{j}" for j, f in enumerate(features))
    filled = ", ".join(f"coalesce({f}, q{j}) AS x{j}" for j, f in enumerate(features))
    st = ", ".join(f"avg(x{j}) AS m{j}, CASE WHEN min(x{j}) = max(x{j}) THEN 1 ELSE stddev_pop(x{j}) END AS s{j}" for j in p)
    co = ", ".join(f"count(*) * covar_pop(x{j}, x{k}) AS c{j}_{k}" for j in p for k in p if k >= j) + ", " + ", ".join(f"count(*) * covar_pop(x{j}, label) AS d{j}" for j in p)
    up = lambda j, k: f"c{min(j, k)}_{max(j, k)}"
    first = ", ".join(f"{up(j, k)} / (s{j} * s{k}) + {l2 if j == k else 0} AS a{j}_{k}" for j in p for k in p) + ", " + ", ".join(f"d{j} / s{j} AS b{j}" for j in p)
    steps = []
    for z in p:
        row = ", ".join((f"a{j}_{k}" if j == z else f"a{j}_{k} - a{j}_{z} / a{z}_{z} * a{z}_{k}") + f" AS a{j}_{k}" for j in p for k in p)
        right = ", ".join((f"b{j}" if j == z else f"b{j} - a{j}_{z} / a{z}_{z} * b{z}") + f" AS b{j}" for j in p)
        steps.append(f"e{z + 1} AS (SELECT fold, {row}, {right} FROM e{z})")
    score = " + ".join(f"b{j} / a{j}_{j} * (x{j} - m{j}) / s{j}" for j in p)
    return f"""pm AS ({panel}), fo AS ({folds}),
    md AS (SELECT fold, count(*) AS n, {med} FROM fo JOIN pm ON i < train_end AND label IS NOT NULL GROUP BY fold HAVING count(*) >= {least}),
    tf AS (SELECT fold, label, {filled} FROM md JOIN fo USING (fold) JOIN pm ON i < train_end AND label IS NOT NULL),
    mo AS (SELECT fold, avg(label) AS ym, {st}, {co} FROM tf GROUP BY fold), e0 AS (SELECT fold, {first} FROM mo), {', '.join(steps)},
    rp AS (SELECT t.*, ym + {score} AS prediction FROM (SELECT pm.*, fold, {filled} FROM md JOIN fo USING (fold) JOIN pm ON i >= lo AND i < hi) t JOIN mo USING (fold) JOIN e{len(features)} USING (fold))"""
