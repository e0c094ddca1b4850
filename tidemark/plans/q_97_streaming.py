"""Streaming queries: the stream is run to the end of its input and the written table is compared with the batch SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import full
from tidemark.operators.portfolio import DRAWDOWN_TIERS
from tidemark.plans.oracle import W
from tidemark.plans.q_10_technical import rets
from tidemark.plans.q_30_sources_filters import COR, UPS, corrections, reg
from tidemark.plans.q_70_labels import CUS
from tidemark.plans.q_80_portfolio import TIER
from tidemark.sources import stores as S
from tidemark.sources import views as V
from tidemark.streaming import batch as B
from tidemark.streaming import jobs as J

c = F.col
ticks = lambda s, d: J.tick_source(J.file_stream(s, d, "events.parquet"))
TK = "tk AS (SELECT * FROM ticks JOIN (SELECT event_id AS id, event_type FROM events) USING (id) WHERE event_type = 'purchase')"
reg("tick_source", "ticker ts:s price:4 size:4 id:i", "ticks", "SELECT ticker, ts, coalesce(price, 0) AS price, coalesce(size, 0) AS size, id FROM tk", lambda s, d: J.run_append(ticks(s, d), "ticks"), TK)
BEGINS = {"5 minutes": "make_timestamp(epoch_us(ts) - epoch_us(ts) % 300000000)", "15 minutes": "make_timestamp(epoch_us(ts) - epoch_us(ts) % 900000000)", **{k: f"CAST(date_trunc('{k}', ts) AS TIMESTAMP)" for k in ("day", "week", "month")}}
BARS = "bw AS (" + " UNION ALL ".join(f"""SELECT ticker, '{k}' AS width, {x} AS start, arg_min(price, {{'t': ts, 'i': id}}) AS o, max(price) AS h, min(price) AS l, arg_max(price, {{'t': ts, 'i': id}}) AS c, sum(coalesce(size, 0)) AS v,
    CASE WHEN sum(coalesce(size, 0)) > 0 THEN round(sum(price * coalesce(size, 0)), 6) / sum(coalesce(size, 0)) END AS vwap, count(*) AS n FROM tk GROUP BY 1, 2, 3""" for k, x in BEGINS.items()) + ")"


def delivered(s, d):
    """Events in the order in which they arrive: every tenth comes five days late. At last a heartbeat, so that open bars are closed."""
    e = V.table(s, d, "events")
    behind = F.when(c("event_id") % 10 == 3, F.expr("interval 5 days")).otherwise(F.expr("interval 0 days"))
    e = e.withColumn("arrived", c("ts") + behind)
    for folder in J.arrivals(e, "ticks", "arrived", 3):
        yield folder
    beat = e.agg((F.max("ts") + F.expr("interval 60 days")).alias("ts")).select(F.lit(None).cast("long").alias("event_id"), "ts", F.lit(None).cast("long").alias("user_id"), F.lit("purchase").alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"), c("ts").alias("arrived"))
    beat.select(*e.columns).write.mode("append").parquet(folder)
    yield folder


def tick_to_bars(s, d):
    """Bars of all chart intervals: 5-minute bars closed by event-time timers, with the side table of late ticks merged in."""
    return J.rolled_bars(J.read_parts(s, J.run_closed_bars(delivered(s, d), s, J.tick_source)))


def corrected(s, d):
    """Corrections arrive in three ranges of days; each merges into the months it touches."""
    bars = V.bars(s, d).drop("n", "u")
    store, state = S.MonthStore(s, J.work_dir(s, "bars-store"), bars.schema), J.work_dir(s, "bars-state")
    store.write(bars, 0)
    for folder in J.arrivals(corrections(V.bars(s, d)), "corrections", "d", 3):
        J.merge_batches(J.file_stream(s, folder), store, S.upsert_bars, state)
    return store.read()


reg("tick_to_bars", "ticker width:s start:s o:4 h:4 l:4 c:4 v:4 vwap:4 n:i", "ticks", "SELECT * FROM bw", tick_to_bars, f"{TK}, {BARS}")
reg("tick_chart_periods", "ticker width:s n_bars:i change:4 change_pct:4 period_high:4 period_low:4 avg_volume:4", "ticks", """SELECT ticker, width, count(*) AS n_bars, arg_max(c, start) - arg_min(o, start) AS change, CASE WHEN arg_min(o, start) <> 0 THEN (arg_max(c, start) - arg_min(o, start)) / arg_min(o, start) * 100 ELSE 0 END AS change_pct, max(h) AS period_high, min(l) AS period_low, avg(v) AS avg_volume FROM bw GROUP BY 1, 2""",
    lambda s, d: J.chart_periods(J.rolled_bars(B.bar_parts(J.tick_source(V.table(s, d, "events"))))), f"{TK}, {BARS}")
reg("late_bar_correction", "ticker d o:4 h:4 l:4 c:5 v:2", "bars", UPS, corrected, COR)
reg("dedupe_first_seen", "ticker generated_at:s model:s signal:4", "signals", "SELECT ticker, min(generated_at) AS generated_at, arg_min(model, {'g': generated_at, 'i': id}) AS model, arg_min(signal, {'g': generated_at, 'i': id}) AS signal FROM signals GROUP BY 1",
    lambda s, d: J.run_update(J.first_seen(J.file_stream(s, J.materialise(V.signals(s, d), "signals"), per_trigger=1)), ["ticker"], "first-seen"))


def folded(s, df, name, *state):
    """A stateful fold over days that arrive in three ranges; each run goes on from the state of the one before."""
    return J.run_arrivals(s, J.arrivals(df, name, "d", 3), lambda stream: J.stateful(stream, "ticker", "d", *state), name + "-out")


reg("online_ewma_vol", "ticker d ewma_vol", "rets", f"SELECT ticker, d, sqrt(v * 252) AS ewma_vol FROM (SELECT ticker, d, pow(0.94, rn - 2) * sum(CASE WHEN rn = 2 THEN r * r ELSE 0.06 * r * r * pow(0.94, 2 - rn) END) OVER (w ROWS UNBOUNDED PRECEDING) AS v FROM rets WHERE r IS NOT NULL {W})",
    lambda s, d: folded(s, rets(s, d).where("r is not null").select("ticker", "d", "r"), "rets", (-1.0,), J.ewma_update(0.94), "var double", "ticker long, d date, ewma_vol double"))
reg("online_drawdown_governor", "ticker d dd scale status:s", "bars", f"SELECT ticker, d, dd, {TIER} AS scale, CASE WHEN dd <= -0.20 THEN 'HALT' WHEN dd <= -0.15 THEN 'CRITICAL' WHEN dd <= -0.10 THEN 'WARNING' WHEN dd <= -0.05 THEN 'CAUTION' ELSE 'NORMAL' END AS status FROM (SELECT ticker, d, c / max(c) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars)",
    lambda s, d: folded(s, V.bars(s, d).select("ticker", "d", "c"), "closes", (0.0,), J.governor_update(DRAWDOWN_TIERS), "hwm double", "ticker long, d date, dd double, scale double, status string"))


def thresholds(s, d):
    return rets(s, d).withColumn("h", F.coalesce(full(F.stddev_samp, "r", 21), F.lit(0.01))).where("lr is not null").select("ticker", "d", "lr", "h")


reg("online_cusum", "ticker d side:i", "rets", "SELECT ticker, d, side FROM cz WHERE side <> 0", lambda s, d: folded(s, thresholds(s, d), "cusum", (0.0, 0.0), J.cusum_update(), "p double, n double", "ticker long, d date, side int"), CUS)
DRI = """zz AS (SELECT ticker, d, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i, (r - avg(r) OVER (PARTITION BY ticker)) / (stddev_samp(r) OVER (PARTITION BY ticker) + 1e-10) AS z FROM rets WHERE r IS NOT NULL),
dz AS (WITH RECURSIVE q(ticker, i, d, p, n, hit, kind, value) AS (SELECT ticker, 0, CAST(NULL AS DATE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), false, '', CAST(0 AS DOUBLE) FROM (SELECT DISTINCT ticker FROM zz) UNION ALL SELECT x.ticker, x.i, x.d, CASE WHEN x.pp > 5 OR x.nn > 5 THEN 0 ELSE x.pp END, CASE WHEN x.pp > 5 OR x.nn > 5 THEN 0 ELSE x.nn END, x.pp > 5 OR x.nn > 5, CASE WHEN x.pp > 5 THEN 'UPWARD' ELSE 'DOWNWARD' END, greatest(x.pp, x.nn) FROM
    (SELECT zz.ticker, zz.i, zz.d, greatest(0.0, q.p + zz.z - 0.5) AS pp, greatest(0.0, q.n - zz.z - 0.5) AS nn FROM q JOIN zz ON zz.ticker = q.ticker AND zz.i = q.i + 1) x) SELECT * FROM q)"""


def standardised(s, d):
    p = Window.partitionBy("ticker")
    return rets(s, d).where("r is not null").select("ticker", "d", ((c("r") - F.avg("r").over(p)) / (F.stddev_samp("r").over(p) + 1e-10)).alias("z"))


reg("online_drift_cusum", "ticker d kind:s value", "rets", "SELECT ticker, d, kind, value FROM dz WHERE hit", lambda s, d: folded(s, standardised(s, d), "drift", (0.0, 0.0), J.drift_update(5.0, 0.5), "p double, n double", "ticker long, d date, kind string, value double"), DRI)
SIG = """sg AS (SELECT ticker * 100000 + (d - DATE '1990-01-01') AS id, ticker, d, CASE WHEN n = 4 THEN 0.5 END AS ret_5 FROM bars WHERE n >= 3), du AS (SELECT id, ticker, d, ret_5, hh, b + CAST((s + hh) // 5 * 7 + (s + hh) % 5 - s AS INTEGER) AS due FROM (SELECT *, least(isodow(d) - 1, 4) AS s, d - CAST(greatest(isodow(d) - 5, 0) AS INTEGER) AS b FROM sg), (SELECT unnest([5, 21, 63]) AS hh)),
en AS (SELECT sg.id, arg_min(b.c, b.d) AS entry FROM sg JOIN bars b ON b.ticker = sg.ticker AND b.d BETWEEN sg.d AND sg.d + 10 GROUP BY 1), ex AS (SELECT du.id, hh, arg_min(b.c, b.d) AS x FROM du JOIN bars b ON b.ticker = du.ticker AND b.d BETWEEN due AND due + 10 GROUP BY 1, 2)"""


def outcome_stream(s, d):
    """Signals arrive in three ranges of days. A batch knows the closes up to its newest signal; what has not matured by then is filled
    by a later batch, or by the last run over all closes. Filled values stay. Signals of five months back may still be open."""
    b = V.bars(s, d)
    sig = b.where("n >= 3").select((c("ticker") * 100000 + F.datediff("d", F.lit("1990-01-01").cast("date"))).alias("id"), "ticker", "d", F.when(c("n") == 4, 0.5).alias("ret_5"))
    closes = b.select("ticker", "d", "c")
    empty = B.fill_outcomes(sig.where("1 = 0"), closes.where("1 = 0")).select("id", "ticker", "d", "ret_5", "ret_21", "ret_63")
    store, state = S.MonthStore(s, J.work_dir(s, "outcomes"), empty.schema), J.work_dir(s, "outcomes-state")

    def merge(old, new):
        known = closes.crossJoin(new.agg(F.max("d").alias("today"))).where("d <= today").drop("today")
        return B.merge_outcomes(old, new, known)

    for folder in J.arrivals(sig, "signals", "d", 3):
        J.merge_batches(J.file_stream(s, folder), store, merge, state, back=5)
    done = store.read()
    return B.merge_outcomes(done, done.where("1 = 0"), closes)


reg("signal_outcome_fill", "id:i ticker ret_5 ret_21 ret_63", "bars", """SELECT sg.id, sg.ticker, coalesce(sg.ret_5, max(x) FILTER (hh = 5) / max(entry) - 1) AS ret_5, max(x) FILTER (hh = 21) / max(entry) - 1 AS ret_21, max(x) FILTER (hh = 63) / max(entry) - 1 AS ret_63 FROM sg LEFT JOIN en USING (id) LEFT JOIN ex USING (id) GROUP BY sg.id, sg.ticker, sg.ret_5""", outcome_stream, SIG)
