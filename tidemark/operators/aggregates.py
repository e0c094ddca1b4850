"""Aggregations: information coefficients, ownership, insiders, event studies, risk summaries and drift statistics."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import running
from tidemark.functions.normal import norm_cdf, norm_ppf
from tidemark.functions.ranks import avg_rank

ANN = math.sqrt(252)


def rank_ic(panel: DataFrame, keys: list[str], pred: str, real: str, floor: int = 5, ordinal: bool = False, tie: str = "ticker") -> DataFrame:
    """Spearman correlation of two columns per key; ordinal=True breaks ties by `tie` instead of sharing ranks."""
    x = panel.where(F.col(pred).isNotNull() & F.col(real).isNotNull())
    if ordinal:
        pos = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, tie)).cast("double")
        x = x.select(*keys, pos(pred).alias("_a"), pos(real).alias("_b"))
    else:
        x = x.select(*keys, avg_rank(pred, keys).alias("_a"), avg_rank(real, keys).alias("_b"))
    g = x.groupBy(*keys).agg(F.corr("_a", "_b").alias("ic"), F.count(F.lit(1)).alias("n"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"))
    return g.where((F.col("n") >= floor) & (F.col("_sa") > 0) & (F.col("_sb") > 0)).select(*keys, "ic", "n")


def daily_ic(matured: DataFrame, as_of: Column | str, models: list[str], days: int = 90, newest: int = 500, chunk: int = 21, starts: int = 42, floor: int = 5) -> DataFrame:
    """One row: ic, hit_rate, n_signals, icir and ic_<model> of the newest matured signals of the last `days` days before `as_of`.

    icir is the mean over the population deviation of the coefficients of the chunks [i, i + chunk), newest first, for every i below
    min(n - floor, starts); at least three of them. A model's value is 0 where the row has none. Under `floor` signals n_signals is 0
    and the rest null. matured: id, generated_at, model, signal, ret. A missing signal counts as 0; a row without ret has not matured.
    """
    when = F.col("generated_at")
    top = matured.where(F.col("ret").isNotNull() & (when >= F.lit(as_of) - F.make_dt_interval(F.lit(days))) & (when <= F.lit(as_of)))
    top = top.withColumn("signal", F.coalesce("signal", F.lit(0.0))).orderBy(when.desc(), "id").limit(newest)  # a top-k: only k rows per task travel
    rows = top.withColumn("i", F.row_number().over(Window.orderBy(when.desc(), "id")) - 1)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).where(F.col("n") >= floor)
    last = F.least(F.col("i"), F.least(F.col("n") - floor, F.lit(starts)) - 1).cast("int")
    first = F.greatest(F.col("i") - chunk + 1, F.lit(0))
    chunks = rows.where(first <= last).select("id", "signal", "ret", F.explode(F.sequence(first, last)).alias("start"))
    ics = rank_ic(chunks, ["start"], "signal", "ret", floor).agg(F.count("ic").alias("k"), F.avg("ic").alias("m"), F.stddev_pop("ic").alias("sd"))
    icir = ics.select(F.when((F.col("k") >= 3) & (F.col("sd") > 0), F.col("m") / F.col("sd")).alias("icir"))
    whole = rank_ic(rows.withColumn("one", F.lit(1)), ["one"], "signal", "ret", floor).agg(F.max("ic").alias("whole"))
    hit = rows.agg(F.avg(((F.col("signal") > 0) == (F.col("ret") > 0)).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n_signals"))
    by = rows.withColumn("m", F.explode(F.array(*map(F.lit, models)))).select("id", "ret", "m", F.when(F.col("model") == F.col("m"), F.col("signal")).otherwise(0.0).alias("v"))
    by = rank_ic(by, ["m"], "v", "ret", floor).agg(*(F.max(F.when(F.col("m") == m, F.col("ic"))).alias(f"ic_{m}") for m in models))
    ic = F.when(F.col("n_signals") > 0, F.coalesce("whole", F.lit(0.0))).alias("ic")
    return hit.crossJoin(whole).crossJoin(icir).crossJoin(by).select(ic, "hit_rate", "n_signals", "icir", *(f"ic_{m}" for m in models))


def spaced_dates(dates: DataFrame, day: str, gap: int) -> DataFrame:
    """Greedy choice of dates at least `gap` days apart, from the first on. The calendar is folded as one sorted array."""
    arr = dates.agg(F.array_sort(F.collect_set(day)).alias("a"))
    pick = F.aggregate("a", F.expr("cast(array() as array<date>)"), lambda acc, x: F.when(
        (F.size(acc) == 0) | (F.datediff(x, F.try_element_at(acc, F.lit(-1))) >= gap), F.array_append(acc, x)).otherwise(acc))
    return arr.select(F.explode(pick).alias(day))


def ic_summary(ics: DataFrame, value: str = "ic") -> DataFrame:
    n, m, s = F.count(value), F.avg(value), F.stddev_samp(value)
    return ics.agg(n.alias("n"), m.alias("mean_ic"), F.stddev_pop(value).alias("std_pop"), F.when((n >= 3) & (s > 0), m / (s / F.sqrt(n))).alias("t_stat"), (m / s).alias("icir"),
                   F.avg((F.col(value) > 0).cast("double")).alias("positive_share"))


#: Words that issuers are matched without.
ISSUER_SUFFIXES = r"\b(INC|CORP|CORPORATION|CO|COMPANY|LTD|PLC|HOLDINGS|GROUP|CLASS [A-C]|COM)\b"


def issuer_stem(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.upper(name), "[^A-Z ]", " "), ISSUER_SUFFIXES, " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def match_issuers(companies: DataFrame, positions: DataFrame, most: int = 5, slack: float = 1.05) -> DataFrame:
    """companies (ticker, name, outstanding) -> cusip and total_shares of the security they are in positions (cusip, issuer, shares).

    Candidates are the `most` largest securities whose issuer begins with the first word of the company's name; the first one that
    holds no more than `slack` times the shares outstanding is it. Issuers meet first words over their exploded prefixes, and the
    largest are taken once for each first word."""
    stem = issuer_stem(F.col("name"))
    asked = companies.select("ticker", "outstanding", stem.alias("stem")).where("length(stem) >= 3").withColumn("word", F.lower(F.substring_index("stem", " ", 1)))
    held = positions.groupBy("cusip").agg(F.max("issuer").alias("issuer"), F.sum("shares").alias("total_shares"), F.array_distinct(F.collect_set(F.lower("issuer"))).alias("said"))  # an issuer's few spellings
    heads = held.select("cusip", "total_shares", F.explode("said").alias("said")).select("cusip", "total_shares", F.explode(F.transform(F.sequence(F.lit(1), F.length("said")), lambda n: F.substring("said", F.lit(1), n))).alias("word"))
    near = heads.join(asked.select("word").distinct(), "word", "left_semi").distinct()
    w = Window.partitionBy("word").orderBy(F.col("total_shares").desc(), "cusip")
    near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    fits = F.coalesce(F.col("outstanding"), F.lit(0.0)) == 0
    pick = asked.join(near, "word").where(fits | (F.col("total_shares") <= F.col("outstanding") * slack))
    return pick.groupBy("ticker", "outstanding").agg(F.min(F.struct("_r", "cusip", "total_shares")).alias("p")).select("ticker", "outstanding", "p.cusip", "p.total_shares")


def ownership_by_issuer(companies: DataFrame, positions: DataFrame, most: int = 15) -> DataFrame:
    """Per company: the largest holder families of its security. positions: cusip, issuer, manager, family, shares, value_usd."""
    found = match_issuers(companies, positions)
    fam = positions.join(found.select("cusip").distinct(), "cusip", "left_semi").groupBy("cusip", "family").agg(F.sum("shares").alias("s"), F.sum("value_usd").alias("v"), F.countDistinct("manager").alias("entities"))
    rank = F.row_number().over(Window.partitionBy("cusip").orderBy(F.col("s").desc(), "family"))
    top = fam.withColumn("rank", rank).where(F.col("rank") <= most)
    pct = F.when(F.coalesce(F.col("outstanding"), F.lit(0.0)) != 0, F.col("s") / F.col("outstanding") * 100)
    return found.join(top, "cusip").select("ticker", "cusip", "total_shares", "family", "s", "v", "entities", "rank", pct.alias("pct"))


def ownership_concentration(positions: DataFrame, issuer: str, holder: str, outstanding: DataFrame) -> DataFrame:
    """Per issuer: holder groups, share of the largest 1/3/10, mean share, holders over 5 %, Herfindahl of held shares.
    Holder totals are pre-aggregated, so an issuer group has one row per holder group. outstanding: issuer, out."""
    g = positions.groupBy(issuer, holder).agg(F.sum("shares").alias("s"))
    w = Window.partitionBy(issuer).orderBy(F.col("s").desc(), holder)
    g = g.withColumn("r", F.row_number().over(w)).join(outstanding, issuer)
    top = lambda k: F.sum(F.when(F.col("r") <= k, F.col("s"))) / F.first("out") * 100
    return g.groupBy(issuer).agg(F.count(F.lit(1)).alias("families"), top(1).alias("top1_pct"), top(3).alias("top3_pct"), top(10).alias("top10_pct"), (F.avg("s") / F.first("out") * 100).alias("avg_pct"),
                                 F.sum((F.col("s") / F.col("out") > 0.05).cast("int")).alias("n_over_5"), (F.sum(F.col("s") * F.col("s")) / (F.sum("s") * F.sum("s"))).alias("hhi"))


def insider_activity(trades: DataFrame, key: str = "issuer") -> DataFrame:
    buy, sell = F.col("code") == "P", F.col("code") == "S"
    n = lambda c: F.sum(c.cast("int"))
    v = lambda c: F.sum(F.when(c, F.col("value")).otherwise(0.0))
    return trades.groupBy(key).agg(
        n(buy).alias("buys"), n(sell).alias("sells"), v(buy).alias("buy_value"), v(sell).alias("sell_value"), (v(buy) / (v(buy) + v(sell))).alias("buy_ratio"),
        F.countDistinct(F.when(buy, F.col("owner"))).alias("buyers"), F.countDistinct(F.when(sell, F.col("owner"))).alias("sellers"),
        (n(buy & F.col("is_officer")) - n(sell & F.col("is_officer"))).alias("officer_net"), (n(buy & F.col("is_director")) - n(sell & F.col("is_director"))).alias("director_net"),
        (F.countDistinct(F.when(buy, F.col("owner"))) >= 3).alias("cluster"))


def insider_cluster(buys: DataFrame, as_of: str, window: int = 90, min_buyers: int = 2) -> DataFrame:
    """Purchases filed in the window before as_of, grouped by owner and then by issuer."""
    t = F.lit(as_of).cast("date")
    o = buys.where((F.col("code") == "P") & F.col("filed").between(F.date_sub(t, window), t)).groupBy("issuer", "owner").agg(
        F.sum("value").alias("v"), F.count(F.lit(1)).alias("k"), F.bool_or("is_officer").alias("off"), F.bool_or("is_director").alias("dir"))
    return o.groupBy("issuer").agg(F.count(F.lit(1)).alias("n_buyers"), F.sum("k").alias("n_purchases"), F.sum("v").alias("total_value"), F.sum(F.col("off").cast("int")).alias("n_officers"),
                                   F.sum(F.col("dir").cast("int")).alias("n_directors")).withColumn("cluster", F.col("n_buyers") >= min_buyers)


def proportion_test(events: DataFrame, selected: str, win: str, n_tests: int = 1) -> DataFrame:
    """Base rate, selected rate, lift and the corrected one-sample statistic."""
    w = F.col(win).cast("double")
    g = events.agg(F.avg(w).alias("base"), F.avg(F.when(F.col(selected), w)).alias("sel"), F.sum(F.col(selected).cast("int")).alias("n"))
    b, s = F.col("base"), F.coalesce(F.col("sel"), F.lit(0.0))
    t = F.when((F.col("n") == 0) | b.isin(0.0, 1.0), 0.0).otherwise(F.try_divide(s - b, F.sqrt(b * (1 - b) / F.col("n"))) / math.sqrt(max(n_tests, 1)))
    return g.select("base", s.alias("selected_rate"), F.when(b > 0, s / b).otherwise(F.lit(float("inf"))).alias("lift"), t.alias("t_stat"))


def decile_of(i: Column, n: Column, k: int = 10) -> Column:
    """Index decile: row i (0-based) of n is in d iff floor(d*n/k) <= i < floor((d+1)*n/k)."""
    d = F.floor(i * k / n)
    return F.when(F.floor((d + 1) * n / k) <= i, d + 1).otherwise(d)


def event_study(events: DataFrame, cost: float) -> DataFrame:
    """Net excess of passers against controls: spread per date, its t over dates, win rates and lift.
    events: as_of, passed, ret, bench."""
    x = events.where("ret is not null and bench is not null").withColumn("x", F.col("ret") - F.col("bench") - cost)
    p, c = F.when(F.col("passed"), F.col("x")), F.when(~F.col("passed"), F.col("x"))
    win = lambda z: F.sum((z > 0).cast("int"))
    d = x.groupBy("as_of").agg((F.avg(p) - F.avg(c)).alias("spread"), F.count(p).alias("np"), F.count(c).alias("nc"), win(p).alias("wp"), win(c).alias("wc"), F.sum(p).alias("sp"), F.sum(c).alias("sc"))
    s, k = F.stddev_samp("spread"), F.count("spread")
    pw, cw = F.sum("wp") / F.sum("np"), F.sum("wc") / F.sum("nc")
    return d.agg(F.count(F.lit(1)).alias("n_dates"), F.sum("np").alias("n_pass"), F.sum("nc").alias("n_ctrl"), F.avg("spread").alias("mean_spread"), F.when((k >= 3) & (s > 0), F.avg("spread") / (s / F.sqrt(k))).alias("t_stat"),
                 pw.alias("passer_win"), cw.alias("control_win"), (pw / cw).alias("lift"), (F.sum("sp") / F.sum("np")).alias("mean_passer"), (F.sum("sc") / F.sum("nc")).alias("mean_control"))


def two_proportion(events: DataFrame) -> DataFrame:
    """Healthy against control: hit rates, median days, pooled z. events: healthy, recovered, days."""
    r = F.col("recovered").cast("int")
    h, c = F.col("healthy"), ~F.col("healthy")
    g = events.agg(*[f for nm, k in (("h", h), ("c", c)) for f in (F.sum(k.cast("int")).alias("n_" + nm), F.sum(F.when(k, r).otherwise(0)).alias("k_" + nm), F.percentile(F.when(k & F.col("recovered"), F.col("days")), F.lit(0.5)).alias("days_" + nm))])
    n1, n2, k1, k2 = (F.col(x) for x in ("n_h", "n_c", "k_h", "k_c"))
    pool = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    return g.select("n_h", "n_c", (k1 / n1).alias("rate_h"), (k2 / n2).alias("rate_c"), "days_h", "days_c", (k1 / n1 - k2 / n2).alias("edge"), F.when(se > 0, (k1 / n1 - k2 / n2) / se).otherwise(0.0).alias("z"))


def risk_summary(b: DataFrame, rf: float = 0.05) -> DataFrame:
    """Return, volatility, ratios, exact percentiles and tail means per ticker. Percentiles are joined back once for the tails."""
    x = b.where("r is not null")
    w = running()
    nav = F.exp(F.sum(F.log1p("r")).over(w))
    x = x.withColumn("nav", nav).withColumn("dd", F.col("nav") / F.max("nav").over(w) - 1)
    q = x.groupBy("ticker").agg(F.percentile("r", F.array(*[F.lit(v) for v in (0.01, 0.05, 0.95)])).alias("q"))
    x = x.join(q, "ticker")
    th = rf / 252
    n = F.count(F.lit(1))
    g = x.groupBy("ticker").agg(
        n.alias("n"), (F.exp(F.sum(F.log1p("r")) * 252 / n) - 1).alias("annual_return"), (F.stddev_samp("r") * ANN).alias("annual_volatility"), (F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * ANN).alias("down"),
        F.min("dd").alias("max_drawdown"), F.sum(F.when(F.col("r") > th, F.col("r"))).alias("g"), F.abs(F.sum(F.when(F.col("r") < th, F.col("r")))).alias("l"), F.first("q").alias("q"),
        F.avg(F.when(F.col("r") <= F.col("q")[1], F.col("r"))).alias("cvar_95"), F.avg(F.when(F.col("r") <= F.col("q")[0], F.col("r"))).alias("cvar_99"), F.skewness("r").alias("skewness"), F.kurtosis("r").alias("excess_kurtosis"),
        F.sqrt(F.avg(F.col("dd") ** 2)).alias("ulcer_index"), F.avg(F.when(F.col("dd") < 0, F.col("dd"))).alias("avg_dd"))
    ar, e = F.col("annual_return"), 1e-10
    return g.where("n >= 21").select(
        "ticker", "annual_return", "annual_volatility", ((ar - rf) / (F.col("annual_volatility") + e)).alias("sharpe"), ((ar - rf) / (F.col("down") + e)).alias("sortino"), (ar / (F.abs("max_drawdown") + e)).alias("calmar"),
        (F.col("g") / (F.col("l") + e)).alias("omega"), "max_drawdown", F.col("q")[1].alias("var_95"), F.col("q")[0].alias("var_99"), "cvar_95", "cvar_99", (F.abs(F.col("q")[2]) / (F.abs(F.col("q")[1]) + e)).alias("tail_ratio"),
        "skewness", "excess_kurtosis", "ulcer_index", (ar / (F.abs(F.coalesce("avg_dd", F.lit(-0.01))) + e)).alias("sterling"))


def performance_report(x: DataFrame, rf: float = 0.05) -> DataFrame:
    """Strategy against benchmark on shared days. x: key columns ticker, r, mr."""
    n, d = F.count(F.lit(1)), rf / 252
    down = F.when(F.col("r") < d, F.col("r") - d)
    pos, neg = F.sum(F.when(F.col("r") > 0, F.col("r"))), F.abs(F.sum(F.when(F.col("r") < 0, F.col("r"))))
    ex = F.col("r") - F.col("mr")
    g = x.groupBy("ticker").agg(n.alias("n"), (F.exp(F.sum(F.log1p("r")) * 252 / n) - 1).alias("annual_return"), (F.stddev_samp("r") * ANN).alias("annual_vol"), (F.stddev_samp(down) * ANN).alias("dd"), F.regr_slope("r", "mr").alias("beta"),
                                F.regr_intercept(F.col("r") - d, F.col("mr") - d).alias("a"), F.regr_r2("r", "mr").alias("r_squared"), (F.avg(ex) / F.stddev_samp(ex) * ANN).alias("information_ratio"), (F.stddev_samp(ex) * ANN).alias("tracking_error"),
                                F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.avg(F.when(F.col("r") > 0, F.col("r"))).alias("avg_win"), F.avg(F.when(F.col("r") < 0, F.col("r"))).alias("avg_loss"),
                                F.when(neg > 0, pos / neg).otherwise(999.0).alias("profit_factor"))
    ar = F.col("annual_return")
    return g.select("ticker", "annual_return", "annual_vol", ((ar - rf) / F.col("annual_vol")).alias("sharpe"), F.when(F.col("dd") > 0, (ar - rf) / F.col("dd")).otherwise(0.0).alias("sortino"), (F.col("a") * 252).alias("alpha"), "beta", "r_squared",
                    "information_ratio", "tracking_error", "win_rate", "avg_win", "avg_loss", "profit_factor")


def trading_risk(b: DataFrame) -> DataFrame:
    """Order-statistic value at risk and tail mean, gap frequency; k = max(1, floor(n/20)) of the ordered returns."""
    x = b.where("r is not null")
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("ticker").orderBy("r"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    k = F.greatest(F.lit(1), F.floor(0.05 * F.col("n")))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("r")))
    return x.where("n >= 59").groupBy("ticker").agg(at(k).alias("var_5pct"), F.avg(F.when(F.col("i") <= k, F.col("r"))).alias("cvar_5pct"), F.avg((F.abs("r") > 0.02).cast("double")).alias("gap_risk_freq"),
                                                    F.abs(at(F.floor(0.95 * F.col("n")) + 1) / at(F.floor(0.05 * F.col("n")) + 1)).alias("tail_ratio"))


def drawdown_risk(b: DataFrame) -> DataFrame:
    x = b.withColumn("dd", F.col("c") / F.max("c").over(running()) - 1)
    g = x.groupBy("ticker").agg(F.sqrt(F.avg(F.col("dd") ** 2)).alias("ulcer_index"), F.abs(F.avg("dd")).alias("pain_index"), F.min("dd").alias("m"), F.max_by("c", "d").alias("last"), F.min_by("c", "d").alias("first"))
    return g.select("ticker", "ulcer_index", "pain_index", F.when(F.col("m") < 0, (F.col("last") / F.col("first") - 1) / F.abs("m")).alias("recovery_factor"))


def deflated_sharpe(b: DataFrame, n_trials: int, rf: float = 0.05) -> DataFrame:
    """Probability that the daily Sharpe ratio beats the expected best of n_trials null strategies."""
    d = rf / 252
    g = b.where("r is not null").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), ((F.avg("r") - d) / F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("sk"), (F.kurtosis("r") + 3).alias("ku"))
    star = (1 - 0.5772156649) * norm_ppf(F.lit(1 - 1 / n_trials)) + 0.5772156649 * norm_ppf(F.lit(1 - 1 / (n_trials * math.e))) if n_trials > 1 else F.lit(0.0)
    var = 1 - F.col("sk") * F.col("sr") + (F.col("ku") - 1) / 4 * F.col("sr") ** 2
    g = g.withColumn("z", (F.col("sr") - star / F.sqrt(F.col("n") - 1)) / F.sqrt(var / (F.col("n") - 1)))
    return g.select("ticker", "sr", F.when((F.col("n") < 30) | (var <= 0), 0.5).otherwise(norm_cdf(F.col("z"))).alias("dsr"))


def pbo_cscv(returns: DataFrame, n_slices: int = 8) -> DataFrame:
    """Probability of back-test overfitting. returns: strategy, i (0-based period), r, one row each.

    Sharpe ratios per (strategy, slice) are aggregated first; the C(n, n/2) splits are a literal table that each
    strategy's slice ratios are summed against, so the work is strategies x splits."""
    t = returns.agg((F.max("i") + 1).alias("t"))
    x = returns.crossJoin(t).withColumn("size", F.floor(F.col("t") / n_slices)).where(F.col("i") < F.col("size") * n_slices)
    sh = x.groupBy("strategy", F.floor(F.col("i") / F.col("size")).alias("s")).agg((F.avg("r") / (F.stddev_pop("r") + 1e-10) * ANN).alias("sh"))
    wide = sh.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("s", "sh"))).alias("a"))
    splits = [list(c) for c in combinations(range(n_slices), n_slices // 2)]
    sp = F.explode(F.array(*[F.struct(F.lit(k).alias("split"), F.array(*[F.lit(v) for v in c]).alias("tr")) for k, c in enumerate(splits)]))
    y = wide.select("strategy", "a", sp.alias("p"))
    part = lambda cond: F.aggregate(F.filter("a", cond), F.lit(0.0), lambda acc, e: acc + e["sh"]) / (n_slices // 2)
    y = y.select("strategy", F.col("p.split").alias("split"), part(lambda e: F.array_contains(F.col("p.tr"), e["s"].cast("int"))).alias("train"), part(lambda e: ~F.array_contains(F.col("p.tr"), e["s"].cast("int"))).alias("test"))
    win = y.groupBy("split").agg(F.max_by("test", F.struct("train", (-F.col("strategy")).alias("k"))).alias("wt"), F.count(F.lit(1)).alias("n"))
    z = y.join(win, "split").groupBy("split").agg((F.sum((F.col("wt") > F.col("test")).cast("int")) / (F.first("n") - 1)).alias("rank"))
    p = F.least(F.greatest(F.col("rank"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return z.withColumn("logit", F.log(p / (1 - p))).agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.avg("logit").alias("logit_mean"), F.stddev_pop("logit").alias("logit_std"), F.count(F.lit(1)).alias("n_splits"))


def psi(expected: DataFrame, actual: DataFrame, key: str, value: str, bins: int = 10) -> DataFrame:
    """Population stability per key over equal-width bins of the expected range; actual values outside fall in no bin."""
    lim = expected.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("ne"))
    na = actual.groupBy(key).agg(F.count(value).alias("na"))
    lim = lim.join(na, key)
    b = F.when(F.col(value) == F.col("hi"), bins - 1).otherwise(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    both = expected.select(key, value, F.lit(1).alias("e")).unionByName(actual.select(key, value, F.lit(0).alias("e")))
    cnt = both.join(lim, key).where(F.col(value).between(F.col("lo"), F.col("hi"))).groupBy(key, b.alias("bin")).agg(F.sum("e").alias("ce"), F.sum(1 - F.col("e")).alias("ca"))
    grid = lim.select(key, "ne", "na", F.explode(F.expr(f"sequence(0L, {bins - 1}L)")).alias("bin"))
    x = grid.join(cnt, [key, "bin"], "left")
    share = lambda c, n: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.col(n), F.lit(1e-6))
    e, a = share("ce", "ne"), share("ca", "na")
    return x.groupBy(key).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def ks_two_sample(both: DataFrame, key: str, value: str, first: str) -> DataFrame:
    """Largest distance of the two empirical distributions per key and its asymptotic p-value. `first` marks sample one.
    Equal values are counted before the running sums, so a step is taken once."""
    c = both.groupBy(key, value).agg(F.sum(F.col(first).cast("int")).alias("a"), F.sum((~F.col(first)).cast("int")).alias("b"))
    w, p = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    x = c.select(key, F.abs(F.sum("a").over(w) / F.sum("a").over(p) - F.sum("b").over(w) / F.sum("b").over(p)).alias("gap"), F.sum("a").over(p).alias("n1"), F.sum("b").over(p).alias("n2"))
    g = x.groupBy(key).agg(F.max("gap").alias("ks"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    lam = F.col("ks") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    pv = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * F.col("lam") * F.col("lam")))
    g = g.withColumn("lam", lam).withColumn("p_value", F.least(F.greatest(pv, F.lit(0.0)), F.lit(1.0)))
    return g.select(key, "ks", "p_value", F.when(F.col("p_value") < 0.01, "HIGH").when(F.col("p_value") < 0.05, "MEDIUM").otherwise("NONE").alias("severity"))


def return_entropy(b: DataFrame, bins: int = 20) -> DataFrame:
    """Natural-log entropy of the return histogram over equal-width bins of the ticker's own range."""
    x = b.where("r is not null").select("ticker", "r")
    lim = x.groupBy("ticker").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n"))
    bin_ = F.least(F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    c = x.join(lim, "ticker").groupBy("ticker", bin_.alias("bin")).agg((F.count(F.lit(1)) / F.first("n")).alias("p"))
    return c.groupBy("ticker").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def weighted_rollup(df: DataFrame, keys: list[str], weight: str = "weight", score: str = "score") -> DataFrame:
    """Weighted mean over scored children (1 place) and the weight share that is scored (3 places)."""
    live = F.when(F.col(score).isNotNull(), F.col(weight))
    g = df.groupBy(*keys).agg(F.sum(F.col(score) * F.col(weight)).alias("_s"), F.sum(live).alias("_a"), F.sum(weight).alias("_t"))
    r1 = lambda c, f: F.floor(c * f + 0.5) / f
    return g.select(*keys, r1(F.col("_s") / F.col("_a"), 10.0).alias("score"), F.coalesce(r1(F.col("_a") / F.col("_t"), 1000.0), F.lit(0.0)).alias("confidence"))


def verdict(score: Column) -> Column:
    return F.when(score.isNull(), "NO_DATA").when(score >= 80, "STRONG_BUY").when(score >= 65, "BUY").when(score >= 45, "NEUTRAL").when(score >= 30, "SELL").otherwise("STRONG_SELL")
