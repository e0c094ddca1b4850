"""Structured Streaming operators.

A run reads files, works in micro-batches with its state and offsets under the checkpoint folder, and writes a table.
Everything a restart needs is in that folder, so a lost executor or driver repeats at most one micro-batch; a repeated
batch writes the same rows under the same batch number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.stores import MonthStore

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd

c = F.col


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this run below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is read from the files once."""
    r = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    s = spark.readStream.schema(r.parquet(folder).schema).option("maxFilesPerTrigger", per_trigger)
    return (s if glob is None else s.option("pathGlobFilter", glob)).parquet(folder)


def materialise(df: DataFrame, name: str, parts: int = 2, by: str | None = None) -> str:
    """Writes a table to a new folder so that it can be replayed as a stream; `by` deals its rows to the files in ranges of a column."""
    folder = work_dir(df.sparkSession, name)
    (df.repartition(parts) if by is None else df.repartitionByRange(parts, by)).write.parquet(folder)
    return folder


def run_append(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Runs an append query over what is available and returns the written table. A call with the `base` of an earlier one goes on
    where that one stopped."""
    spark = stream.sparkSession
    base = base or work_dir(spark, name)
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", base + "/state").trigger(availableNow=True).start(base + "/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/out")


def arrivals(df: DataFrame, name: str, by: str, n: int = 3) -> Iterator[str]:
    """Lets a table arrive in `n` ranges of a column of equal size: appends a range to a folder and yields the folder, n times."""
    spark, folder, whole = df.sparkSession, work_dir(df.sparkSession, name), work_dir(df.sparkSession, name + "-all")
    df.write.parquet(whole)
    rows = spark.read.schema(df.schema).parquet(whole)
    at = F.unix_micros(c(by).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 1000)).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.where(at > low)
        (part if high is None else part.where(at <= high)).write.mode("append").parquet(folder)
        yield folder


def run_arrivals(spark: SparkSession, folders: Iterator[str], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Runs an append query once for each arrival; every run starts from the state and offsets that the one before left."""
    base, out = work_dir(spark, name), None
    for folder in folders:
        out = run_append(build(file_stream(spark, folder)), name, base)
    return out


def run_update(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs an aggregation in update mode; every batch writes its changed rows under its number, and the newest row of
    each key is the result."""
    spark = stream.sparkSession
    base = work_dir(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", base + "/state").trigger(availableNow=True).start()
    q.awaitTermination()
    t = spark.read.parquet(base + "/out")
    rest = [x for x in stream.columns if x not in keys]
    return t.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def tick_source(stream: DataFrame, kind: str = "purchase") -> DataFrame:
    """Trades of one event kind: ticker, ts, price, size; a missing field is 0."""
    k = F.from_json("props", "k double")["k"]
    return stream.where(c("event_type") == kind).select(c("user_id").alias("ticker"), c("ts").cast("timestamp").alias("ts"), F.coalesce(100 + c("value"), F.lit(0.0)).alias("price"), F.coalesce(k, F.lit(0.0)).alias("size"), c("event_id").alias("id"))


#: What is known of a bar, or of a part of one: `first` and `last` are (microseconds, id) of the ticks that gave o and c.
BAR_STATE = "first_us long, first_id long, o double, h double, l double, last_us long, last_id long, c double, v double, pv double, n long"
BAR_ROW = "ticker long, start_us long, " + BAR_STATE + ", late boolean"
BAR_PART = BAR_ROW.replace("start_us long", "start timestamp")


def merged_parts(parts: DataFrame, keys: list) -> DataFrame:
    """Parts of bars put together by `keys`; an aggregation that combines map-side. The turnover is rounded to a millionth before it
    is divided, so that the order of addition does not show."""
    first, last = F.struct("first_us", "first_id"), F.struct("last_us", "last_id")
    g = parts.groupBy(*keys).agg(F.min_by("o", first).alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", last).alias("c"), F.sum("v").alias("v"), F.sum("pv").alias("pv"), F.sum("n").alias("n"))
    return g.withColumn("vwap", F.when(c("v") > 0, F.round("pv", 6) / c("v"))).drop("pv")


def folded_parts(x: pd.DataFrame) -> pd.DataFrame:
    """Parts of bars (columns as in BAR_ROW, without `late`) put together by ticker and start; sums and extremes leave out NaN."""
    import numpy as np
    import pandas as pd

    def ordered(us: str, no: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.lexsort((x[no], x[us], x["start_us"], x["ticker"]))
        keys = x[["ticker", "start_us"]].to_numpy()[at]
        return at, np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))

    if not len(x):
        return x
    at, heads = ordered("first_us", "first_id")
    out = {k: x[k].to_numpy()[at][heads] for k in ("ticker", "start_us", "first_us", "first_id", "o")}
    reduced = lambda f, k: f.reduceat(x[k].to_numpy()[at], heads)
    out |= {"h": reduced(np.fmax, "h"), "l": reduced(np.fmin, "l")}
    last, to = ordered("last_us", "last_id")
    ends = np.append(to[1:], len(x)) - 1
    out |= {k: x[k].to_numpy()[last][ends] for k in ("last_us", "last_id", "c")}
    out |= {k: np.add.reduceat(x[k].fillna(0).to_numpy()[at], heads) for k in ("v", "pv", "n")}
    return pd.DataFrame(out)


class BarCloser(StatefulProcessor):
    """State machine of the bars of one slot of tickers that start in one period: ticks are folded into their bars; a timer at the end of
    the first open bar, in event time, emits all bars that the watermark has passed and forgets them. Ticks of a bar that the
    watermark has already closed leave at once, each as a late part of its own. A slot's bars are one value of the state, so calls
    grow with slots and periods, not with bars."""

    def __init__(self, width_us: int):
        self.width_us = width_us

    def init(self, handle) -> None:
        self.handle = handle
        self.bars = handle.getValueState("bars", "rows binary")

    def ends(self, bars: pd.DataFrame) -> pd.Series:
        return (bars["start_us"] + self.width_us) // 1000

    def keep(self, bars: pd.DataFrame) -> None:
        import pyarrow as pa

        if not len(bars):
            self.bars.clear()
            return
        rows = pa.RecordBatch.from_pandas(bars, preserve_index=False)
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            self.bars.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(self.ends(bars).min()))

    def kept(self) -> pd.DataFrame | None:
        import pyarrow as pa

        held = self.bars.get()
        return None if held is None else pa.ipc.open_stream(bytes(held[0])).read_pandas()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        if key[0] == HEARTBEAT:  # a filter in the plan would be moved below the watermark
            return
        bars, watermark = self.kept(), timerValues.getCurrentWatermarkInMs()
        for x in rows:
            x = pd.DataFrame({
                "ticker": x["ticker"], "start_us": x["start_us"], "first_us": x["us"], "first_id": x["id"], "o": x["price"], "h": x["price"], "l": x["price"],
                "last_us": x["us"], "last_id": x["id"], "c": x["price"], "v": x["size"], "pv": x["price"] * x["size"], "n": 1})
            closed = self.ends(x) <= watermark
            if closed.any():
                yield x[closed].assign(late=True)
                x = x[~closed]
            bars = folded_parts(x if bars is None else pd.concat([bars, x], ignore_index=True))
        if bars is not None:
            self.keep(bars)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        bars = self.kept()
        if bars is None:
            return
        closed = self.ends(bars) <= timerValues.getCurrentWatermarkInMs()
        if closed.any():
            self.keep(bars[~closed])
            yield bars[closed].assign(late=False)

    def close(self) -> None:
        pass


#: Slots of tickers and the period of starts that share a state: a state holds a day's bars of one slot. The slot of ticks without ticker.
SLOTS, PERIOD_US, HEARTBEAT = 32, 86_400_000_000, -1
#: A null id among the numbers: it comes before all others.
NO_ID = -(1 << 63)


def closed_bars(ticks: DataFrame, minutes: int = 5, late: str = "1 day") -> DataFrame:
    """Parts of bars (BAR_PART) of a tick stream: a bar when the watermark passes its end, and every tick that comes later.

    The watermark is taken from `ts`; the state machine reads the time as a number, so that Spark does not drop late ticks before it.
    A tick without ticker only moves the watermark on (a heartbeat)."""
    width = minutes * 60_000_000
    us, slot = F.unix_micros("ts"), F.pmod(F.xxhash64("ticker"), F.lit(SLOTS)).cast("int")
    x = ticks.withWatermark("ts", late).select(F.coalesce("ticker", F.lit(0)).alias("ticker"), us.alias("us"), "price", "size", F.coalesce("id", F.lit(NO_ID)).alias("id"), F.when(c("ticker").isNull(), HEARTBEAT).otherwise(slot).alias("slot"))
    x = x.withColumn("start_us", c("us") - F.pmod(c("us"), F.lit(width)))
    x = x.withColumn("period", c("start_us") - F.pmod(c("start_us"), F.lit(PERIOD_US)))
    bars = x.groupBy("slot", "period").transformWithStateInPandas(BarCloser(width), BAR_ROW, "Append", "EventTime")
    ids = {k: F.when(c(k) != NO_ID, c(k)) for k in ("first_id", "last_id")}
    return bars.withColumns(ids).withColumn("start_us", F.timestamp_micros("start_us")).withColumnRenamed("start_us", "start")


def run_closed_bars(folders: Iterator[str], spark: SparkSession, source: Callable[[DataFrame], DataFrame], minutes: int = 5, late: str = "1 day") -> str:
    """Runs `closed_bars` once per arrival. The result folder has bars closed in time below `late=false`, the side table below `late=true`."""
    base, name = work_dir(spark, "closed-bars"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for folder in folders:
            bars = closed_bars(source(file_stream(spark, folder)), minutes, late)
            q = bars.writeStream.outputMode("append").format("parquet").partitionBy("late").option("checkpointLocation", base + "/state").trigger(availableNow=True).start(base + "/out")
            q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return base + "/out"


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BAR_PART).parquet(folder)


def rolled_bars(parts: DataFrame) -> DataFrame:
    """Bars of all chart intervals (5 and 15 minutes, day, week, month) from parts of 5-minute bars: a part goes to one bar of each."""
    quarter = F.timestamp_micros((F.unix_micros("start") - F.pmod(F.unix_micros("start"), F.lit(900_000_000))).cast("long"))
    begins = {"5 minutes": c("start"), "15 minutes": quarter, **{k: F.date_trunc(k, "start") for k in ("day", "week", "month")}}
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("width"), v.alias("begin")) for k, v in begins.items()]))
    x = parts.withColumn("_at", at).withColumn("width", c("_at.width")).withColumn("begin", c("_at.begin"))
    return merged_parts(x, ["ticker", "width", "begin"]).withColumnRenamed("begin", "start")


def chart_periods(bars: DataFrame) -> DataFrame:
    """Per ticker and interval: bars, change from the first open to the last close, highest, lowest, mean volume."""
    g = bars.groupBy("ticker", "width").agg(F.count(F.lit(1)).alias("n_bars"), F.min_by("o", "start").alias("first_open"), F.max_by("c", "start").alias("last_close"), F.max("h").alias("period_high"), F.min("l").alias("period_low"), F.avg("v").alias("avg_volume"))
    change = c("last_close") - c("first_open")
    return g.withColumn("change", change).withColumn("change_pct", F.when(c("first_open") != 0, change / c("first_open") * 100).otherwise(0.0))


def tick_bars(ticks: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    """Streaming bars per instrument and interval with a watermark; combines map-side like the batch form."""
    o = F.struct("ts", "id")
    g = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.min_by("price", o).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", o).alias("c"), F.sum("size").alias("v"), F.sum(c("price") * c("size")).alias("pv"), F.count(F.lit(1)).alias("n"))
    return g.select("ticker", c("w.start").alias("start"), "o", "h", "l", "c", "v", F.when(c("v") > 0, c("pv") / c("v")).alias("vwap"), "n")


def first_seen(stream: DataFrame) -> DataFrame:
    return stream.groupBy("ticker").agg(F.min_by(F.struct("generated_at", "model", "signal"), F.struct("generated_at", "id")).alias("x")).select("ticker", "x.*")


def merge_batches(stream: DataFrame, store: MonthStore, merge: Callable[[DataFrame, DataFrame], DataFrame], state: str, back: int = 0) -> None:
    """Merges every micro-batch into the months of the store that it touches (and `back` months before its first one). The store's
    version is the batch number, kept beside its data, so a repeated batch writes the same version and a restart goes on from it."""

    def write(batch: DataFrame, number: int) -> None:
        store.merge(batch, number + 1, merge, back)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def stateful(stream: DataFrame, key: str, order: str, init: tuple, update, state_schema: str, out_schema: str) -> DataFrame:
    """Per-key state machine: the rows of a key in a batch are put in order and folded by `update(state, rows)`, which
    returns the new state and the output frame. A batch holds at most one row per key and day."""

    def step(k, frames, state):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values(order)
        st, out = update(state.get if state.exists else init, rows)
        state.update(st)
        yield out

    return stream.groupBy(key).applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def ewma_update(lam: float):
    """var = lam*var + (1-lam)*r^2, started at the first squared return."""

    def update(state, rows):
        import numpy as np

        (var,) = state
        out = []
        for r in rows["r"].to_numpy():
            var = r * r if var < 0 else lam * var + (1 - lam) * r * r
            out.append(var)
        res = rows[["ticker", "d"]].copy()
        res["ewma_vol"] = np.sqrt(np.asarray(out) * 252)
        return (float(var),), res

    return update


def governor_update(tiers):
    """High-water mark and the deepest drawdown tier reached."""
    tiers = tuple(tiers)

    def update(state, rows):
        (hwm,) = state
        dd, scale, status = [], [], []
        for v in rows["c"].to_numpy():
            hwm = max(hwm, v)
            x = v / hwm - 1
            hit = next(((s, n) for limit, s, n in tiers if x <= limit), (1.0, "NORMAL"))
            dd.append(x)
            scale.append(hit[0])
            status.append(hit[1])
        return (float(hwm),), rows[["ticker", "d"]].assign(dd=dd, scale=scale, status=status)

    return update


def cusum_update():
    """Symmetric CUSUM; only the side that fired starts again. Rows carry the threshold h."""

    def update(state, rows):
        p, n = state
        side = []
        for r, h in zip(rows["lr"].to_numpy(), rows["h"].to_numpy()):
            p, n, s = max(0.0, p + r), min(0.0, n + r), 0
            if p > h:
                p, s = 0.0, 1
            elif n < -h:
                n, s = 0.0, -1
            side.append(s)
        out = rows[["ticker", "d"]].assign(side=side)
        return (float(p), float(n)), out[out["side"] != 0]

    return update


def drift_update(threshold: float, slack: float):
    """Two-sided CUSUM of standardised values; both sides start again after an alert, which names its side and size. Rows carry z."""

    def update(state, rows):
        p, n = state
        kind, value = [], []
        for z in rows["z"].to_numpy():
            p, n = max(0.0, p + z - slack), max(0.0, n - z - slack)
            hit = p > threshold or n > threshold
            kind.append(("UPWARD" if p > threshold else "DOWNWARD") if hit else None)
            value.append(max(p, n))
            if hit:
                p = n = 0.0
        out = rows[["ticker", "d"]].assign(kind=kind, value=value)
        return (float(p), float(n)), out[out["kind"].notna()]

    return update
