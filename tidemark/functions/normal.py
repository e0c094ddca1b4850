"""Standard normal distribution as column expressions (there is no erf in Spark SQL)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational approximations of the normal cdf (Hart 1968) and quantile (Acklam 2003).
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
           440.413735824752)
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
PPF_LOW = 0.02425


def horner(coef, x):
    acc = None
    for c in coef:
        acc = F.lit(c) if acc is None else acc * x + c
    return acc


def norm_cdf(x: Column) -> Column:
    a = F.abs(x)
    tail = F.exp(-a * a / 2) * horner(CDF_NUM, a) / horner(CDF_DEN, a)
    tail = F.when(a > 7.07, 0.0).otherwise(tail)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_ppf(p: Column) -> Column:
    """Quantile for 0 < p < 1 (null outside), about 1e-9 relative."""
    q = p - 0.5
    r = q * q
    mid = horner(PPF_A, r) * q / horner(PPF_B, r)
    lo = F.sqrt(-2 * F.log(p))
    hi = F.sqrt(-2 * F.log(1 - p))
    return (F.when((p <= 0) | (p >= 1), None).when(p < PPF_LOW, horner(PPF_C, lo) / horner(PPF_D, lo))
            .when(p <= 1 - PPF_LOW, mid).otherwise(-horner(PPF_C, hi) / horner(PPF_D, hi)))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
