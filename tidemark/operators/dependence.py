"""Dependence between series: factor covariance, stress, tails and crowding.

Matrices are taken over a fixed, short list of factor series laid out as columns, so each statistic of every pair is one
aggregate expression of a single pass; no rows are paired. Instruments are compared with a market or factor series only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ANN = math.sqrt(252)


def wide(series: DataFrame, names: list[int]) -> DataFrame:
    """d and one column f<k> per factor; only days on which every factor has a value."""
    g = series.groupBy("d").pivot("f", names).agg(F.first("fr"))
    g = g.select("d", *[F.col(str(k)).alias(f"f{k}") for k in names])
    return g.where(" and ".join(f"f{k} is not null" for k in names))


def pairs_long(agg_row: DataFrame, names: list[int], fields: list[str]) -> DataFrame:
    """One row with columns <field>_<a>_<b> -> long (a, b, field...)."""
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.col(f"{f}_{a}_{b}").alias(f) for f in fields]) for a in names for b in names if a <= b]
    return agg_row.select(F.explode(F.array(*items)).alias("p")).select("p.*")


def covariance_long(w: DataFrame, names: list[int], lam: float = 0.94) -> DataFrame:
    """Sample covariance, correlation and exponentially weighted covariance (started from the sample matrix)."""
    last = w.agg(F.count(F.lit(1)).alias("t"))
    x = w.withColumn("i", F.row_number().over(Window.orderBy("d"))).crossJoin(last)  # one row per session
    k = F.pow(F.lit(lam), F.col("t") - F.col("i"))
    ag = []
    for a in names:
        for b in names:
            if a <= b:
                fa, fb = F.col(f"f{a}"), F.col(f"f{b}")
                cov = F.covar_samp(fa, fb)
                ag += [cov.alias(f"cov_{a}_{b}"), F.corr(fa, fb).alias(f"corr_{a}_{b}"),
                       (cov * F.pow(F.lit(lam), F.max("t")) + (1 - lam) * F.sum(k * fa * fb)).alias(f"ewma_{a}_{b}")]
    return pairs_long(x.agg(*ag), names, ["cov", "corr", "ewma"])


def correlation_stress(cov: DataFrame, multiplier: float = 1.5, cap: float = 0.95, crisis: float = 0.90) -> DataFrame:
    """Off-diagonal correlations raised towards one, and the constant-correlation crisis form."""
    same = F.col("a") == F.col("b")
    return cov.select("a", "b", F.when(same, 1.0).otherwise(F.least(F.col("corr") * multiplier, F.lit(cap))).alias("stressed"), F.when(same, 1.0).otherwise(crisis).alias("crisis"))


def correlation_instability(w: DataFrame, names: list[int], n: int = 21) -> DataFrame:
    """Frobenius distance of the correlation matrices of the newest n rows and the n before, over sqrt(size)."""
    x = w.withColumn("k", F.row_number().over(Window.orderBy(F.col("d").desc())))  # one row per session
    rec, pri = F.col("k") <= n, (F.col("k") > n) & (F.col("k") <= 2 * n)
    ag = []
    for a in names:
        for b in names:
            if a < b:
                c = lambda m: F.corr(F.when(m, F.col(f"f{a}")), F.when(m, F.col(f"f{b}")))  # noqa: B023, E731
                ag += [c(rec).alias(f"r_{a}_{b}"), c(pri).alias(f"p_{a}_{b}")]
    row = x.where(F.col("k") <= 2 * n).agg(*ag)
    ps = [(a, b) for a in names for b in names if a < b]
    dist = F.sqrt(sum((2 * (F.col(f"r_{a}_{b}") - F.col(f"p_{a}_{b}")) ** 2 for a, b in ps), F.lit(0.0)))
    mean = lambda z: sum((F.col(f"{z}_{a}_{b}") for a, b in ps), F.lit(0.0)) / len(ps)
    out = row.select(dist.alias("frobenius"), (dist / math.sqrt(len(names))).alias("score"), mean("r").alias("avg_recent"), mean("p").alias("avg_prior"))
    return out.withColumn("action", F.when(F.col("score") > 1, "REDUCE").when(F.col("score") > 0.5, "MONITOR").otherwise("NORMAL"))


def tail_pairs(w: DataFrame, names: list[int], q: float = 0.05) -> DataFrame:
    """Lower-tail dependence (weak and strict form) and the correlation on joint tail days."""
    cut = w.agg(*[F.percentile(f"f{k}", F.lit(q)).alias(f"q{k}") for k in names])
    x = w.crossJoin(cut)
    ag = []
    for a in names:
        for b in names:
            if a < b:
                le = (F.col(f"f{a}") <= F.col(f"q{a}")) & (F.col(f"f{b}") <= F.col(f"q{b}"))
                lt = (F.col(f"f{a}") < F.col(f"q{a}")) & (F.col(f"f{b}") < F.col(f"q{b}"))
                n = F.sum(lt.cast("int"))
                ag += [(F.sum(le.cast("int")) / F.sum((F.col(f"f{a}") <= F.col(f"q{a}")).cast("int"))).alias(f"ltd_{a}_{b}"), (F.avg(lt.cast("double")) / q).alias(f"strict_{a}_{b}"),
                       F.when(n > 5, F.corr(F.when(lt, F.col(f"f{a}")), F.when(lt, F.col(f"f{b}")))).otherwise(0.0).alias(f"tail_corr_{a}_{b}"), n.alias(f"n_{a}_{b}")]
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.col(f"{f}_{a}_{b}").alias(f) for f in ("ltd", "strict", "tail_corr", "n")]) for a in names for b in names if a < b]
    return x.agg(*ag).select(F.explode(F.array(*items)).alias("p")).select("p.*")


def covar(x: DataFrame, q: float = 0.05) -> DataFrame:
    """System percentile given the instrument's distress less the one given its median band. x: ticker, r, mr."""
    c = x.groupBy("ticker").agg(F.percentile("r", F.array(F.lit(q), F.lit(0.45), F.lit(0.55))).alias("p"))
    j = x.join(c, "ticker")
    bad, mid = F.col("r") <= F.col("p")[0], F.col("r").between(F.col("p")[1], F.col("p")[2])
    g = j.groupBy("ticker").agg(F.first(F.col("p")[0]).alias("var_i"), F.sum(bad.cast("int")).alias("nb"), F.sum(mid.cast("int")).alias("nm"), F.percentile(F.when(bad, F.col("mr")), F.lit(q)).alias("cb"),
                                F.percentile(F.when(mid, F.col("mr")), F.lit(q)).alias("cm"))
    ok = (F.col("nb") >= 5) & (F.col("nm") >= 5)
    return g.select("ticker", "var_i", F.when(ok, F.col("cb")).otherwise(0.0).alias("covar"), F.when(ok, F.col("cb") - F.col("cm")).otherwise(0.0).alias("delta_covar"))


def proxy_betas(rets: DataFrame, proxies: DataFrame, names: list[int], back: int = 252) -> DataFrame:
    """Beta (population) and correlation of every instrument to each proxy over the newest shared rows."""
    j = rets.where("r is not null").select("ticker", "d", "r").join(proxies, "d")
    n = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("d").desc()))
    j = j.withColumn("k", n).where(F.col("k") < back)
    half = F.col("k") <= (back - 1) // 2
    f0 = F.col(f"f{names[0]}")
    b = lambda m: F.covar_pop(F.when(m, F.col("r")), F.when(m, f0)) / F.var_pop(F.when(m, f0))
    ok = F.count(F.lit(1)) >= 40
    return j.groupBy("ticker").agg(*[F.when(ok, F.covar_pop("r", f"f{k}") / F.var_pop(f"f{k}")).alias(f"beta_{k}") for k in names], *[F.when(ok, F.corr("r", f"f{k}")).alias(f"corr_{k}") for k in names],
                                   (1 - F.least(F.lit(1.0), F.abs(b(half) - b(~half)))).alias("beta_stability"))


def capm_beta(x: DataFrame) -> DataFrame:
    """Regression beta of the whole history and the newest exponentially weighted beta (span 63), shrunk to one.
    x: ticker, d, rn, r, mr with the first return in row 2."""
    from tidemark.operators.windows import ewm_adjusted

    e = ewm_adjusted(x, 2.0 / 64).groupBy("ticker").agg(F.max_by("ewm_beta", "d").alias("beta_raw"))
    g = x.where("r is not null and mr is not null").groupBy("ticker").agg(F.regr_slope("r", "mr").alias("beta"))
    shr = 0.6 * F.col("beta_raw") + 0.4
    return g.join(e, "ticker").select("ticker", "beta", "beta_raw", shr.alias("beta_shrunk"), (1 - shr).alias("bab_signal"))


def factor_exposures(j: DataFrame, names: list[str], back: int = 252) -> DataFrame:
    """Least squares of r on the factor columns over the newest rows: annual alpha, betas, R2, idiosyncratic deviation.

    The normal equations are sums, built by one aggregation per ticker; only the small solve (k x k per row) is done in
    Arrow batches. j: ticker, d, r, factor columns."""
    import pandas as pd

    n = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("d").desc()))
    x = j.withColumn("_k", n).where(F.col("_k") <= back)
    cols = ["one", *names]
    x = x.withColumn("one", F.lit(1.0))
    g = x.groupBy("ticker").agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a in cols for b in cols]).alias("xx"), F.array(*[F.sum(F.col(a) * F.col("r")) for a in cols]).alias("xy"),
                                F.sum(F.col("r") ** 2).alias("yy"), F.sum("r").alias("sy"), F.count(F.lit(1)).alias("n"))
    k = len(cols)
    schema = "ticker long, alpha double, " + ", ".join(f"b_{c} double" for c in names) + ", r_squared double, idio_risk double"
    out_names = list(names)

    def solve(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for t, xx, xy, yy, sy, m in zip(pdf["ticker"], pdf["xx"], pdf["xy"], pdf["yy"], pdf["sy"], pdf["n"]):
                a, v = np.asarray(xx, dtype=float).reshape(k, k), np.asarray(xy, dtype=float)
                w = np.linalg.solve(a, v)
                res = max(yy - w @ v, 0.0)
                rows.append([t, w[0] * 252, *w[1:], 1 - res / (yy - sy * sy / m + 1e-10), np.sqrt(res / m * 252)])
            yield pd.DataFrame(rows, columns=["ticker", "alpha", *[f"b_{c}" for c in out_names], "r_squared", "idio_risk"])

    return g.where(F.col("n") > k).mapInPandas(solve, schema)


def crowding_score(series: DataFrame, short_interest: Column | None = None) -> DataFrame:
    """Momentum of the newest 63 rows and persistence of monthly Sharpe ratios, divided by the number of components.
    series: f, d, fr."""
    k = F.row_number().over(Window.partitionBy("f").orderBy(F.col("d").desc()))
    x = series.withColumn("k", k)
    rec = F.when(F.col("k") <= 63, F.col("fr"))
    mom = x.groupBy("f").agg((F.avg(rec) / (F.stddev_samp(rec) + 1e-10) * ANN).alias("sh"))
    mon = x.groupBy("f", F.last_day("d").alias("m")).agg((F.avg("fr") / (F.stddev_samp("fr") + 1e-10) * ANN).alias("s"))
    last = mon.withColumn("j", F.row_number().over(Window.partitionBy("f").orderBy(F.col("m").desc()))).where("j <= 12").groupBy("f").agg(F.avg((F.col("s") > 0.5).cast("double")).alias("pers"))
    g = mom.join(last, "f")
    ms, ps = F.least(F.greatest(F.col("sh") / 3, F.lit(0.0)), F.lit(1.0)), F.least(F.col("pers"), F.lit(1.0))
    score = (0.40 * ms + 0.30 * ps) / 2
    return g.select("f", F.col("sh").alias("recent_sharpe"), F.col("pers").alias("persistence"), score.alias("crowding"), (1 / (1 + F.exp(-(score - 0.65) * 10))).alias("unwind_prob"))


def crowding_pca(w: DataFrame, names: list[int], n: int = 63) -> DataFrame:
    """Entropy of explained variance of the newest n standardised rows, effective factor count and top share.

    The correlations are one row of aggregates, whatever n is; only that row is decomposed. A constant factor has no variance."""
    f = [f"f{k}" for k in names]
    size = len(f)
    pairs = [F.coalesce(F.corr(f[i], f[j]), F.lit(0.0)) if i != j else F.coalesce((F.var_pop(f[i]) > 0).cast("double"), F.lit(0.0)) for i in range(size) for j in range(size)]
    one = w.orderBy(F.col("d").desc()).limit(n).agg(F.array(*pairs).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 0")

    def shares(frames):
        import numpy as np
        import pandas as pd

        for x in frames:
            ev = [np.sort(np.maximum(np.linalg.eigvalsh(np.nan_to_num(np.asarray(m, float)).reshape(size, size)), 0))[::-1] for m in x["m"]]
            yield pd.DataFrame({"shares": [e / max(e.sum(), 1e-300) for e in ev]})

    x = one.select("m").mapInPandas(shares, "shares array<double>")
    x = x.select((-F.aggregate("shares", F.lit(0.0), lambda t, e: t + e * F.log(e + 1e-10))).alias("entropy"), F.col("shares")[0].alias("top_share")).withColumn("effective_n", F.exp("entropy"))
    low, mid = (F.col("effective_n") < 2) | (F.col("top_share") > 0.6), (F.col("effective_n") < 3) | (F.col("top_share") > 0.4)
    return x.withColumn("level", F.when(low, "HIGH").when(mid, "MEDIUM").otherwise("LOW"))


def jacobi_sql(size: int, start: str, sweeps: int = 7) -> str:
    """CTEs that end in `eigen` (ev): eigenvalues of the symmetric matrix in the row `start` (a0_0, a0_1, ...), by plane rotations."""
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    out, last = [], start
    for t, (p, q) in enumerate([(p, q) for _ in range(sweeps) for p in range(size) for q in range(p + 1, size)]):
        c, s = "cos(th)", "sin(th)"
        new = {at(p, p): f"{c} * {c} * {at(p, p)} + 2 * {c} * {s} * {at(p, q)} + {s} * {s} * {at(q, q)}", at(q, q): f"{s} * {s} * {at(p, p)} - 2 * {c} * {s} * {at(p, q)} + {c} * {c} * {at(q, q)}", at(p, q): "0.0"}
        for k in range(size):
            if k not in (p, q):
                new[at(k, p)], new[at(k, q)] = f"{c} * {at(k, p)} + {s} * {at(k, q)}", f"{c} * {at(k, q)} - {s} * {at(k, p)}"
        row = ", ".join(f"{new.get(at(i, j), at(i, j))} AS {at(i, j)}" for i, j in cells)
        out.append(f"jr{t} AS MATERIALIZED (SELECT {row} FROM (SELECT *, 0.5 * atan2(2 * {at(p, q)}, {at(p, p)} - {at(q, q)}) AS th FROM {last}))")
        last = f"jr{t}"
    return ", ".join(out) + f", eigen AS (SELECT unnest([{', '.join(at(i, i) for i in range(size))}]) AS ev FROM {last})"


def factor_dispersion(loadings: DataFrame, threshold: float = 0.3) -> DataFrame:
    g = loadings.groupBy("f").agg((F.stddev_samp("b") / F.abs(F.avg("b"))).alias("dispersion"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("crowded", F.col("dispersion") < threshold)


