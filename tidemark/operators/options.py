"""Options chain tables, all underlyings at once. chain: underlying, strike, days_to_expiry, iv, oi_call, oi_put; spot: underlying, spot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normal import norm_pdf



def gamma_exposure(chain: DataFrame, spot: DataFrame, rate: float = 0.05) -> DataFrame:
    """Dealer gamma per contract row in billions: calls add, puts subtract."""
    x = chain.join(spot, "underlying").where("strike > 0 and days_to_expiry > 0 and iv > 0")
    t = F.col("days_to_expiry") / 365
    sd = F.col("iv") * F.sqrt(t)
    d1 = (F.log(F.col("spot") / F.col("strike")) + (rate + F.col("iv") ** 2 / 2) * t) / sd
    gex = norm_pdf(d1) / (F.col("spot") * sd) * (F.col("oi_call") - F.col("oi_put")) * 100 * F.col("spot") * F.col("spot") / 1e9
    return x.withColumn("gex", gex)


def gex_by_strike(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """Value of a strike is that of its last row (longest expiry here), the total counts every row."""
    x = gamma_exposure(chain, spot)
    tot = x.groupBy("underlying").agg(F.sum("gex").alias("total_gex"), F.first("spot").alias("spot"))
    per = x.groupBy("underlying", "strike").agg(F.max_by("gex", F.struct("days_to_expiry", "iv")).alias("gex"))
    return per.join(tot, "underlying")


def gamma_flip(per_strike: DataFrame) -> DataFrame:
    """First sign change by strike, linearly interpolated; the spot when there is none."""
    w = Window.partitionBy("underlying").orderBy("strike")
    x = per_strike.withColumn("k2", F.lead("strike").over(w)).withColumn("g2", F.lead("gex").over(w))
    at = F.when(F.col("gex") * F.col("g2") < 0, F.col("strike"))
    lvl = F.col("strike") + (F.col("k2") - F.col("strike")) * (-F.col("gex")) / (F.col("g2") - F.col("gex") + 1e-10)
    return x.groupBy("underlying").agg(F.coalesce(F.min_by(F.when(at.isNotNull(), lvl), at), F.first("spot")).alias("gamma_flip"), F.first("total_gex").alias("total_gex"))


def max_pain(chain: DataFrame) -> DataFrame:
    """Strike with the least payout. Pain at every strike comes from running sums over the sorted strikes, so the strikes
    are never paired: sum of oi above times (K_i - K) and of oi below times (K - K_i)."""
    s = chain.groupBy("underlying", "strike").agg(F.sum("oi_call").alias("c"), F.sum("oi_put").alias("p"))
    up = Window.partitionBy("underlying").orderBy(F.col("strike").desc()).rowsBetween(Window.unboundedPreceding, -1)
    dn = Window.partitionBy("underlying").orderBy("strike").rowsBetween(Window.unboundedPreceding, -1)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    pain = z(F.sum(F.col("c") * F.col("strike")).over(up)) - F.col("strike") * z(F.sum("c").over(up)) + F.col("strike") * z(F.sum("p").over(dn)) - z(F.sum(F.col("p") * F.col("strike")).over(dn))
    return s.withColumn("pain", pain).groupBy("underlying").agg(F.min(F.struct("pain", "strike")).alias("m")).select("underlying", F.col("m.strike").alias("max_pain"), F.col("m.pain").alias("pain"))


def iv_term_skew(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """At-the-money volatility per expiry, mean volatility of the out-of-the-money bands, skew."""
    x = chain.join(spot, "underlying")
    atm = x.groupBy("underlying", "days_to_expiry").agg(F.min_by("iv", F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))).alias("atm_iv"))
    x = x.join(atm, ["underlying", "days_to_expiry"])
    r = F.col("spot") * F.col("atm_iv") * F.sqrt(F.col("days_to_expiry") / 365) * 0.5
    put, call = (F.col("strike") < F.col("spot") - r) & (F.col("strike") > F.col("spot") - 2 * r), (F.col("strike") > F.col("spot") + r) & (F.col("strike") < F.col("spot") + 2 * r)
    g = x.groupBy("underlying", "days_to_expiry").agg(F.first("atm_iv").alias("atm_iv"), F.avg(F.when(put, F.col("iv"))).alias("p"), F.avg(F.when(call, F.col("iv"))).alias("c"))
    g = g.withColumn("skew_25d", F.coalesce("p", "atm_iv") - F.coalesce("c", "atm_iv"))
    w = Window.partitionBy("underlying")
    slope = F.max_by("atm_iv", "days_to_expiry").over(w) - F.min_by("atm_iv", "days_to_expiry").over(w)
    return g.select("underlying", "days_to_expiry", "atm_iv", "skew_25d", slope.alias("term_slope"), (slope > 0).alias("contango"))


def option_flow(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """Put/call ratios of volume and open interest, volatility skew of the three strikes nearest the spot per side."""
    x = chain.join(spot, "underlying")
    w = lambda oi: Window.partitionBy("underlying", F.col(oi) > 0).orderBy(F.abs(F.col("strike") - F.col("spot")), "strike", "days_to_expiry", "iv")
    x = x.withColumn("rc", F.row_number().over(w("oi_call"))).withColumn("rp", F.row_number().over(w("oi_put")))
    civ, piv = F.avg(F.when((F.col("oi_call") > 0) & (F.col("rc") <= 3), F.col("iv"))), F.avg(F.when((F.col("oi_put") > 0) & (F.col("rp") <= 3), F.col("iv")))
    g = x.groupBy("underlying").agg(civ.alias("call_iv"), piv.alias("put_iv"), (F.sum("vol_put") / F.greatest(F.sum("vol_call"), F.lit(1.0))).alias("pc_volume"), (F.sum("oi_put") / F.greatest(F.sum("oi_call"), F.lit(1.0))).alias("pc_oi"))
    sk = F.col("put_iv") - F.col("call_iv")
    return g.select("underlying", "call_iv", "put_iv", sk.alias("iv_skew"), "pc_volume", "pc_oi", F.when((F.col("pc_volume") < 0.7) & (sk < 0.02), "BULLISH").when((F.col("pc_volume") > 1.5) & (sk > 0.05), "BEARISH").otherwise("NEUTRAL").alias("flow"))
