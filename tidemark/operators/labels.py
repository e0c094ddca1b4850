"""Labels, event sampling and validation folds.

A label looks at a bounded number of future rows of one instrument, so it is a forward row frame, not a range join.
Fold tables work on the session calendar: one row per (fold, session), never one per pair of sessions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import between, by, clip, full, last_n
from tidemark.functions.normal import norm_cdf
from tidemark.functions.ranks import upper_middles



def _first_touch(path: Column, hit) -> Column:
    """1-based position of the first element that satisfies `hit`, null when none."""
    p = F.array_position(F.transform(path, hit), True)
    return F.when(p > 0, p)


def triple_barrier(b: DataFrame, h: int = 10, pt: float = 1.5, sl: float = 1.5, min_ret: float = 0.0, vol_rows: int = 21) -> DataFrame:
    """First touch on the close within h rows of p0(1 +- k vol sqrt(h)); profit is tested first; the last row is the time stop."""
    x = b.withColumn("vol", full(F.stddev_samp, "r", vol_rows)).withColumn("path", F.collect_list(F.struct("d", "c")).over(between(1, h)))
    x = x.where(F.col("vol").isNotNull() & (F.size("path") > 0))
    up, lo = F.col("c") * (1 + pt * F.col("vol") * h ** 0.5), F.col("c") * (1 - sl * F.col("vol") * h ** 0.5)
    x = x.withColumn("up", up).withColumn("lo", lo)
    x = x.withColumn("iu", _first_touch(F.col("path"), lambda e: e["c"] >= F.col("up"))).withColumn("il", _first_touch(F.col("path"), lambda e: e["c"] <= F.col("lo")))
    i = F.coalesce(F.least("iu", "il"), F.size("path")).cast("int")
    kind = F.when(F.col("iu").isNull() & F.col("il").isNull(), "time").when(F.col("il").isNull() | (F.col("iu") < F.col("il")), "profit").otherwise("stop")
    x = x.withColumn("e", F.element_at("path", i)).withColumn("barrier", kind)
    ret = F.col("e.c") / F.col("c") - 1
    lab = F.when(F.abs(ret) < min_ret, 0).when(F.col("barrier") == "profit", 1).when(F.col("barrier") == "stop", -1).otherwise(0)
    return x.select("ticker", F.col("d").alias("t0"), F.col("e.d").alias("t1"), ret.alias("ret"), lab.alias("label"), "barrier", "vol")


def log_labels(b: DataFrame, horizons=(5, 21, 63, 252), mult: float = 2.0) -> DataFrame:
    """Realised log returns: barrier exits at +-mult sigma up to 21 rows, terminal beyond; only rows where the longest fits.
    Sigma needs five returns and is never filled backward."""
    w20 = last_n(20)
    s = F.when(F.count("lr").over(w20) >= 5, F.stddev_samp("lr").over(w20))
    x = b.withColumn("s", s).withColumn("path", F.collect_list("c").over(between(1, 21)))
    x = x.select("*", *[F.lead("c", h).over(by()).alias(f"c{h}") for h in horizons]).where(F.col("s").isNotNull() & (F.col("s") > 0) & F.col(f"c{max(horizons)}").isNotNull())
    out = []
    for h in horizons:
        end = F.log(F.col(f"c{h}") / F.col("c"))
        if h <= 21:
            p = F.slice("path", 1, h)
            iu, il = _first_touch(p, lambda e: e >= F.col("c") * F.exp(mult * F.col("s"))), _first_touch(p, lambda e: e <= F.col("c") * F.exp(-mult * F.col("s")))
            end = F.when(iu.isNull() & il.isNull(), end).when(il.isNull() | (iu < il), mult * F.col("s")).otherwise(-mult * F.col("s"))
        out.append(end.alias(f"label_{h}"))
    return x.select("ticker", "d", *out)


def touch_labels(b: DataFrame, days: int = 21, k: float = 1.0) -> DataFrame:
    """Earliest touch of +-k target on a calendar-day path. Form one: a return under .1 target is 0. Form two: a time stop
    takes the sign of its return, and a touch on the last row counts as one."""
    day = F.unix_date("d")
    w = Window.partitionBy("ticker").orderBy(day).rangeBetween(1, days)
    x = b.withColumn("target", full(F.stddev_samp, "r", 21) * days ** 0.5).withColumn("path", F.collect_list("c").over(w)).where("target is not null and size(path) > 0")
    t = F.col("target")
    x = x.withColumn("iu", _first_touch(F.col("path"), lambda e: e / F.col("c") - 1 >= k * t)).withColumn("il", _first_touch(F.col("path"), lambda e: e / F.col("c") - 1 <= -k * t))
    i = F.coalesce(F.least("iu", "il"), F.size("path")).cast("int")
    x = x.withColumn("i", i).withColumn("ret", F.element_at("path", F.col("i")) / F.col("c") - 1)
    timeout = (F.col("iu").isNull() & F.col("il").isNull()) | (F.col("i") == F.size("path"))
    return x.select("ticker", "d", "ret", F.when(F.abs("ret") < 0.1 * t, 0).otherwise(F.signum("ret")).cast("int").alias("label"), timeout.alias("timeout"))


def cusum_events(b: DataFrame, h_mult: float = 1.0, vol_rows: int = 21) -> DataFrame:
    """Symmetric CUSUM of log returns against h x volatility; only the side that fired starts again.

    The two sums are folded over the ticker's daily array; an event is recorded by its position."""
    x = b.withColumn("h", h_mult * F.coalesce(full(F.stddev_samp, "r", vol_rows), F.lit(0.01))).where("lr is not null")
    g = x.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("d", "lr", "h"))).alias("a"))
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.expr("cast(array() as array<struct<d:date,side:int>>)").alias("ev"))

    def step(acc, e):
        p, n = F.greatest(F.lit(0.0), acc["p"] + e["lr"]), F.least(F.lit(0.0), acc["n"] + e["lr"])
        up = p > e["h"]
        dn = (~up) & (n < -e["h"])
        ev = F.when(up, F.array_append(acc["ev"], F.struct(e["d"].alias("d"), F.lit(1).alias("side")))).when(dn, F.array_append(acc["ev"], F.struct(e["d"].alias("d"), F.lit(-1).alias("side")))).otherwise(acc["ev"])
        return F.struct(F.when(up, 0.0).otherwise(p).alias("p"), F.when(dn, 0.0).otherwise(n).alias("n"), ev.alias("ev"))

    return g.select("ticker", F.explode(F.aggregate("a", zero, step)["ev"]).alias("e")).select("ticker", "e.d", "e.side")


def forward_labels(b: DataFrame, horizons=(5, 21, 63, 126, 252), cost: float = 0.001) -> DataFrame:
    w = by()
    return b.select("ticker", "d", *[(F.log(F.lead("c", h).over(w) / F.lead("c", 1).over(w)) - cost).alias(f"fwd_{h}") for h in horizons])


# Return of a delisted name by reason; unknown reasons take the last entry.
DELIST_RETURNS = {"bankruptcy": -0.70, "performance": -0.40, "acquisition": 0.15, "merger": 0.10, "voluntary": -0.15, "exchange_transfer": 0.00}
DELIST_DEFAULT = -0.30


def delist_return(reason: Column) -> Column:
    m = F.create_map(*[y for k, v in DELIST_RETURNS.items() for y in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, reason), F.lit(DELIST_DEFAULT))


def outcome_label(reached: Column, exit_type: Column, excess: Column, revenue_mult: Column, roic_up: Column, bankrupt: Column, dilution: Column,
                  market: float = 3.0, business: float = 2.0, max_dilution: float = 1.0) -> Column:
    market_ok = F.coalesce(excess >= market, F.lit(False))
    business_ok = F.coalesce(revenue_mult >= business, F.lit(False)) & F.coalesce(roic_up, F.lit(False))
    survival = ~bankrupt & F.coalesce(dilution <= max_dilution, F.lit(True))
    win = lambda ok: F.when(ok, "WINNER").otherwise("NON_WINNER")
    return (F.when(~reached, "CENSORED").when(exit_type == "merged_continues", "FOLLOW_SUCCESSOR").when(exit_type.isin("bankrupt", "acquired_below"), "NON_WINNER")
            .when(exit_type == "acquired_premium", win(market_ok)).otherwise(win(market_ok & business_ok & survival)))


def bet_size(p: Column, max_size: float = 1.0, concentration: float = 1.0) -> Column:
    q = clip(p, 0.001, 0.999)
    z = (q - 0.5) / F.sqrt(q * (1 - q))
    return clip((2 * norm_cdf(concentration * z) - 1) * max_size, 0, max_size)


def uniqueness(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Two weights per label span: one over the mean number of open spans, and the mean of one over it.
    Prefix sums over the bars give any span's mean with two lookups, so no span-by-bar join is formed."""
    from tidemark.operators.joins import concurrency

    w = Window.partitionBy("ticker").orderBy("d")
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    c = concurrency(events, bars).select("ticker", "d", F.sum("open_spans").over(cum).alias("s"), F.sum(F.coalesce(F.try_divide(F.lit(1.0), F.col("open_spans")), F.lit(0.0))).over(cum).alias("q"), F.row_number().over(w).alias("i"),
                                         F.col("open_spans").alias("o"))
    c = c.withColumn("v", F.struct("s", "q", "i"))
    from tidemark.operators.joins import asof_join

    end = asof_join(events, c.select("ticker", "d", "v"), "ticker", "t1", "d", ["v"])
    j = end.join(c.select("ticker", F.col("d").alias("t0"), F.col("s").alias("s0"), F.col("q").alias("q0"), F.col("i").alias("i0"), "o"), ["ticker", "t0"])
    n = F.col("v.i") - F.col("i0") + 1
    mean_o, mean_q = (F.col("v.s") - F.col("s0") + F.col("o")) / n, (F.col("v.q") - F.col("q0") + F.try_divide(F.lit(1.0), F.col("o"))) / n
    return j.select("ticker", "t0", "t1", (1 / F.greatest(mean_o, F.lit(1.0))).alias("tb_weight"), mean_q.alias("ma_weight"))


def time_decay(w: DataFrame, weight: str, order: str, decay: float = 0.5) -> DataFrame:
    """Linear in cumulative weight, 1 at the newest, scaled to mean 1 per ticker."""
    p = Window.partitionBy("ticker")
    cw = F.sum(weight).over(p.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    x = w.withColumn("_cw", cw).withColumn("_tot", F.sum(weight).over(p))
    slope = (1 - decay) / F.col("_tot")
    x = x.withColumn("_dec", F.greatest(F.lit(0.0), 1 - slope * F.col("_tot") + slope * F.col("_cw")))
    return x.withColumn("decayed", F.col("_dec") / F.avg("_dec").over(p)).drop("_cw", "_tot", "_dec")


def drop_rare(events: DataFrame, min_pct: float = 0.05) -> DataFrame:
    tot = events.agg(F.count(F.lit(1)).alias("n"))
    keep = events.groupBy("label").agg(F.count(F.lit(1)).alias("k")).crossJoin(tot).where(F.col("k") / F.col("n") >= min_pct)
    return events.join(keep.select("label"), "label", "left_semi")


def numbered(calendar: DataFrame, day: str = "d", horizon: int = 21) -> DataFrame:
    """Sessions with index i (0-based), their count n and the index t1 of the label end. One row per calendar day."""
    w = Window.orderBy(day)
    x = calendar.select(day).distinct().withColumn("i", F.row_number().over(w) - 1)
    return x.crossJoin(calendar.agg(F.countDistinct(day).alias("n"))).withColumn("t1", F.least(F.col("i") + horizon, F.col("n") - 1))


def purged_kfold(rows: DataFrame, k: int = 5, embargo: float = 0.01, as_coded: bool = True) -> DataFrame:
    """(fold, i, role). as_coded drops every row whose label ends at or after the test start (all later rows go);
    otherwise only true overlap is purged. Rows: i, n, t1."""
    fold = F.explode(F.expr(f"sequence(0, {k - 1})")).alias("fold")
    x = rows.select("i", "n", "t1", fold)
    if as_coded:
        lo, hi = F.floor((F.col("n") - 1) * F.col("fold") / k), F.floor((F.col("n") - 1) * (F.col("fold") + 1) / k)
    else:
        lo, hi = F.floor(F.col("n") / k) * F.col("fold"), F.when(F.col("fold") == k - 1, F.col("n")).otherwise(F.floor(F.col("n") / k) * (F.col("fold") + 1))
    x = x.withColumn("lo", lo).withColumn("hi", hi).withColumn("e", F.floor(F.col("n") * embargo))
    test = (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))
    if as_coded:
        drop = (F.col("t1") >= F.col("lo")) | ((F.col("i") > F.col("hi")) & (F.col("i") < F.col("hi") + F.col("e")))
    else:
        drop = ((F.col("t1") >= F.col("lo")) & (F.col("i") <= F.col("hi") - 1)) | ((F.col("i") >= F.col("hi")) & (F.col("i") < F.col("hi") + F.col("e")))
    return x.select("fold", "i", F.when(test, "test").when(~drop, "train").alias("role")).where("role is not null")


def combinatorial_purged(rows: DataFrame, n_splits: int = 6, k: int = 2, embargo: float = 0.01, purge: bool = True, min_train: int = 50) -> DataFrame:
    """(combo, i, role) over all C(n_splits, k) test sets. With purge, a row whose label ends at or after the first test
    row goes, the embargo applies after the last test row, and sets with too little training are skipped."""
    combos = F.explode(F.array(*[F.struct(F.lit(j).alias("combo"), F.array(*[F.lit(v) for v in c]).alias("t")) for j, c in enumerate(combinations(range(n_splits), k))])).alias("c")
    x = rows.select("i", "n", "t1", combos).select("i", "n", "t1", "c.*")
    size = F.floor(F.col("n") / n_splits)
    grp = F.when(F.col("i") < size * n_splits, F.floor(F.col("i") / size)).cast("int")
    test = F.coalesce(F.array_contains("t", grp), F.lit(False))
    first, last = F.array_min("t") * size, (F.array_max("t") + 1) * size - 1
    drop = (F.col("t1") >= first) | ((F.col("i") > last) & (F.col("i") <= last + F.floor(F.col("n") * embargo))) if purge else F.lit(False)
    x = x.select("combo", "i", F.when(test, "test").when(~drop, "train").alias("role")).where("role is not null")
    ok = x.where("role = 'train'").groupBy("combo").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= (min_train if purge else 1)).select("combo")
    return x.join(ok, "combo", "left_semi")


def walk_forward(rows: DataFrame, n_folds: int = 5, embargo: int = 5, min_train: int = 40) -> DataFrame:
    """Expanding folds: the first min_train rows only train, the rest is cut into equal test blocks with a gap before each."""
    x = rows.select("i", "n", F.explode(F.expr(f"sequence(0, {n_folds - 1})")).alias("fold"))
    size = F.floor((F.col("n") - min_train) / n_folds)
    lo = min_train + F.col("fold") * size
    hi = F.when(F.col("fold") == n_folds - 1, F.col("n")).otherwise(lo + size)
    role = F.when((F.col("i") >= lo) & (F.col("i") < hi), "test").when(F.col("i") < lo - embargo, "train")
    return x.select("fold", "i", role.alias("role")).where("role is not null")


def median_impute(df: DataFrame, cols: list[str], z: float = 5.0) -> DataFrame:
    """Nulls to the upper middle value of the column, then z-clipped. The statistics are one row, joined back."""
    st = df.agg(*[F.avg(c).alias("_m_" + c) for c in cols], *[F.stddev_samp(c).alias("_s_" + c) for c in cols])
    mids = upper_middles(df, cols).withColumnsRenamed({c: "_mid_" + c for c in cols})
    x = df.crossJoin(st).crossJoin(mids)  # one row each
    out = [clip((F.coalesce(F.col(c), F.col("_mid_" + c)) - F.col("_m_" + c)) / F.col("_s_" + c), -z, z).alias(c + "_z") for c in cols]
    keep = [F.coalesce(F.col(c), F.col("_mid_" + c)).alias(c) for c in cols]
    return x.select(*[c for c in df.columns if c not in cols], *keep, *out)


def promotion_gate(v: DataFrame, lift: float = 1.5, t: float = 3.0, tol: float = 0.10, regimes: int = 2) -> DataFrame:
    """All failed conditions of a validation block, in order; passed when there are none."""
    bad = F.array_compact(F.array(
        F.when(F.length(F.trim(F.coalesce("mechanism", F.lit("")))) == 0, "no_mechanism"), F.when(~F.coalesce("cost_survived", F.lit(False)), "costs"), F.when(F.coalesce(F.col("lift") < lift, F.lit(True)), "lift"),
        F.when(F.coalesce(F.col("t_stat") < t, F.lit(True)), "t_stat"), F.when(F.coalesce(F.col("calibration_max_dev") > tol, F.lit(True)), "calibration"), F.when(F.coalesce("n_regimes_passed", F.lit(0)) < regimes, "regimes")))
    return v.withColumn("reasons", F.array_join(bad, ",")).withColumn("passed", F.size(bad) == 0)
