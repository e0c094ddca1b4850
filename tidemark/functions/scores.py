"""Score shapes shared by the scoring operators. A missing input scores a neutral 50 unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.frames import clip


def linear_score(v: Column, low: float, high: float) -> Column:
    """0 at low, 100 at high, clamped; null, NaN or an empty range gives 50."""
    if high == low:
        return F.lit(50.0)
    return F.when(v.isNull() | F.isnan(v), 50.0).otherwise(clip((v - low) / (high - low) * 100, 0, 100))


def good_great_score(v: Column, good: float, great: float, higher: bool = True) -> Column:
    """50 at good, 100 at great, linear with the same step below good down to 0; mirrored when lower is better."""
    s = 1.0 if higher else -1.0
    x, g, gg = v * s, good * s, great * s
    zero = g - (gg - g)
    below = F.when(x <= zero, 0.0).otherwise((x - zero) / (g - zero) * 50)
    return F.when(v.isNull(), 50.0).when(x >= gg, 100.0).when(x >= g, 50 + (x - g) / (gg - g) * 50).otherwise(below)


def absolute_band(v: Column, good, great, higher=True) -> Column:
    """40..65 up to good (never under 0), 65..90 between good and great, 90..100 above. Arguments may be columns."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    s = F.when(lit(higher), 1.0).otherwise(-1.0)
    x, g, gg = v * s, lit(good) * s, lit(great) * s
    step = gg - g
    low = F.greatest(F.lit(0.0), 40 + F.try_divide(x - (g - step), step) * 25)
    return (F.when(v.isNull(), None).when(x <= g, low).when(x <= gg, 65 + F.try_divide(x - g, step) * 25)
            .otherwise(F.least(F.lit(100.0), 90 + F.try_divide(x - gg, step) * 10)))
