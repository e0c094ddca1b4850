"""Quality rules: base counts and robust multivariate outliers (operator 8).

Every document gets counts; transformed, they form a statistic vector. Per language and source a minimum-covariance-determinant
estimate is found by concentration steps: distances of all rows to the present centre are binned on a log scale, sums and cross
products are added up per (group, bin) on the map side, and the bins nearest to the centre that hold `SUPPORT` of the group give the
next centre and covariance. Steps go from two starts (medians with quartile ranges; mean and covariance of all rows) until no
determinant falls any more, and the estimate of the least determinant holds. A task meets at most `BINS` rows of a group, so a source
that holds a third of all documents is no larger than others. Squared Mahalanobis distances are divided by the consistency factor of
`SUPPORT`; documents beyond `CUT`, the chi-square quantile of `LEVEL`, are rejected.

Groups with fewer than `LEAST` judged documents are pooled by language, and pools that are still too small over all languages;
with fewer than `LEAST` documents in the last pool nothing is rejected by distance. `FLOORS` are added to the covariance, so that a
statistic without any spread (no symbols at all) does not reject by itself.

Rows: a null text has no words and fails the base rule, as an empty one does. Null language or source count as an empty string.
Repeated rows are judged each. An empty table gives no rows. Extra columns pass through; those named like outputs are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import written
from tidemark.llm.tokens import slices

SUPPORT, LEVEL, LEAST, BINS = 0.75, 0.99, 60, 256
#: A fall of the log determinant that calls for another step.
FALL = 1e-3
#: Standard deviations that no statistic goes below: symbols, duplicate lines, repeated words, capitals, marks (roots of shares), log word length.
FLOORS = (0.03, 0.12, 0.12, 0.02, 0.02, 0.03)
D = len(FLOORS)


def chi_square(x: float, degrees: int) -> float:
    """Share below x; even degrees only."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


CUT = chi_square_quantile(LEVEL, D)
#: The covariance of the nearest SUPPORT of a normal group is smaller by this factor than the group's.
CONSISTENCY = SUPPORT / chi_square(chi_square_quantile(SUPPORT, D), D + 2)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: Fixed values of the counts' contract.
MIN_WORDS, REPEAT_SHARE = 50, 50
SPACES, SYMBOLS, MARKS = " \t\n\x0b\x0c\r", "#*$%&|<>", "!?.,;:()[]{}\"'/\\=+_~^@-"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    m = len(number)
    if m == len(words):
        return 0
    if m < 2_000_000:
        key = (w[:-2] * m + w[1:-1]) * m + w[2:]
    else:  # three numbers no longer fit in 63 bits
        _, pairs = np.unique(w[:-2] * m + w[1:-1], return_inverse=True)
        key = pairs * m + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(1 for _ in filter(str.isupper, text)) if not text.islower() else 0
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, sum(map(text.count, MARKS)))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and COUNTS for every document."""
    keep = [c for c in keep if c not in COUNTS]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4_000_000):
            got = np.array([counts(t or "") for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x) for x in got.T)], [*keep, *COUNTS])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def vector() -> list[Column]:
    """Transformed statistics of a document with words; null without."""
    share = lambda a, b: F.sqrt(F.try_divide(a, b))
    return [share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars"), share("n_marks", "word_chars"), F.log(F.try_divide("word_chars", "n_words"))]


def grouped(stats: DataFrame) -> DataFrame:
    """Adds base_failed, the statistics x0.. and the estimation group."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_SHARE)
    rows = stats.withColumn("base_failed", failed)
    rows = rows.withColumns({f"x{i}": x for i, x in enumerate(vector())}).withColumns({"_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_source": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    sizes = rows.filter(~failed).groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    small = F.sum(F.when(F.col("n") < LEAST, F.col("n"))).over(Window.partitionBy("_lang"))
    group = F.when(F.col("n") >= LEAST, F.concat_ws("\x1f", F.lit("s"), "_lang", "_source")).when(small >= LEAST, F.concat_ws("\x1f", F.lit("l"), "_lang")).otherwise(F.lit("*"))
    return rows.join(sizes.select("_lang", "_source", group.alias("_group")), ["_lang", "_source"], "left")


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. to `centre` with `inverse`."""
    dev = [F.col(f"x{i}") - F.col("centre")[i] for i in range(D)]
    return sum((dev[i] * dev[j] * F.col("inverse")[i * D + j] * (1 if i == j else 2) for i in range(D) for j in range(i, D)), F.lit(0.0))


def concentrate(bins: pd.DataFrame) -> pd.DataFrame:
    """Centre and inverse covariance of the bins nearest to the present centre; at most BINS rows of one group."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy()
    if n.sum() < LEAST:
        return pd.DataFrame({"_group": [], "centre": [], "inverse": [], "det": []})
    used = np.searchsorted(np.cumsum(n), math.ceil(SUPPORT * n.sum())) + 1
    near, total = bins.iloc[:used], float(n[:used].sum())
    centre = np.array([near[f"s{i}"].sum() for i in range(D)]) / total
    cov = np.empty((D, D))
    for i in range(D):
        for j in range(i, D):
            cov[i, j] = cov[j, i] = near[f"c{i}_{j}"].sum() / total - centre[i] * centre[j]
    cov += np.diag(np.square(FLOORS))
    return pd.DataFrame({"_group": [bins["_group"].iloc[0]], "centre": [centre.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()], "det": [float(np.linalg.slogdet(cov)[1])]})


def concentrate_start(bins: pd.DataFrame) -> pd.DataFrame:
    """The same for the bins of one start."""
    return concentrate(bins).assign(start=bins["start"].iloc[0])


def estimates(rows: DataFrame) -> DataFrame:
    """One row per group: centre and inverse covariance of the least determinant that concentration steps from both starts reach."""
    xs = [f"x{i}" for i in range(D)]
    judged = written(rows.filter(~F.col("base_failed")).select("_group", *xs), "rule-judged")
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)] + [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"c{i}_{j}") for i in range(D) for j in range(i, D)]

    def fitted(binned: DataFrame) -> DataFrame:
        bins = binned.groupBy("_group", "start", "bin").agg(F.count("*").alias("n"), *sums)
        return bins.groupBy("_group", "start").applyInPandas(concentrate_start, "_group string, centre array<double>, inverse array<double>, det double, start int")

    quarters = judged.groupBy("_group").agg(F.count("*").alias("n"), *(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in xs)).filter(F.col("n") >= LEAST)
    scale = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(FLOORS[i])) for i, x in enumerate(xs)]
    medians = written(quarters.select("_group", F.array(*(F.col(x)[1] for x in xs)).alias("centre"), F.array(*(1 / (scale[i] * scale[i]) if i == j else F.lit(0.0) for i in range(D) for j in range(D))).alias("inverse"), F.lit(math.inf).alias("det"), F.lit(0).alias("start")), "rule-medians")
    large = medians.select("_group")
    means = fitted(judged.join(large, "_group", "left_semi").withColumns({"start": F.lit(1), "bin": F.lit(0)})).withColumn("det", F.lit(math.inf))  # one bin: all rows
    moving, reached = written(medians.unionByName(means), "rule-starts"), []
    while not moving.isEmpty():
        near = judged.join(moving, "_group").withColumn("bin", F.least(F.floor(F.log2(1 + distance()) * 12), F.lit(BINS - 1)).cast("int"))
        before = moving.select("_group", "start", F.col("det").alias("_det"))
        moving = written(fitted(near).join(before, ["_group", "start"]).filter(F.col("det") < F.col("_det") - FALL).drop("_det"), "rule-step")
        reached.append(moving)
    found = reduce(DataFrame.unionByName, reached) if reached else moving
    return found.groupBy("_group").agg(F.min(F.struct("det", "start", "centre", "inverse")).alias("_least")).select("_group", "_least.centre", "_least.inverse")


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all of them by default), COUNTS, base_failed, distance and kept."""
    out = (*COUNTS, "base_failed", "distance", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    stats = written(measured(docs, list(dict.fromkeys([*keep, "lang", "source"]))), "rule-statistics")
    rows = grouped(stats)
    few = rows.select("base_failed", "_group", *(f"x{i}" for i in range(D)))
    judged = rows.join(written(estimates(few), "rule-estimates"), "_group", "left").withColumn("distance", distance() / CONSISTENCY)
    far = F.coalesce(F.col("distance") > CUT, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).select(*keep, *COUNTS, "base_failed", "distance", "kept")
