"""Streams equal their batch twins, also when state is carried over several micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.frames import with_returns
from tidemark.streaming import batch, jobs
from tests.test_operators import bars


def test_ewma_state_is_carried_between_batches(spark):
    b = with_returns(bars(spark, n=90)).where("r is not null").select("ticker", "d", "r")
    folder = jobs.work_dir(spark, "two-files")
    cut = dt.date(2020, 2, 15)
    b.where(F.col("d") < F.lit(cut)).coalesce(1).write.parquet(folder)
    b.where(F.col("d") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(folder)
    st = jobs.stateful(jobs.file_stream(spark, folder, per_trigger=1), "ticker", "d", (-1.0,), jobs.ewma_update(0.94), "var double", "ticker long, d date, ewma_vol double")
    got = {(r["ticker"], r["d"]): r["ewma_vol"] for r in jobs.run_append(st, "ewma").collect()}
    want = {(r["ticker"], r["d"]): r["ewma_vol"] for r in batch.vol_path(with_returns(bars(spark, n=90))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bars_from_shuffled_ticks_equal_the_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1 + i % 2, t0 + dt.timedelta(seconds=40 * i), 100.0 + (i * 37) % 11, float(i % 5), i) for i in range(200)]
    t = spark.createDataFrame(rows, "ticker long, ts timestamp, price double, size double, id long")
    stream = jobs.file_stream(spark, jobs.materialise(t.orderBy(F.xxhash64("id")), "ticks", 3), per_trigger=1)
    key = lambda r: (r["ticker"], r["start"])
    got = {key(r): r.asDict() for r in jobs.run_update(jobs.tick_bars(stream, "5 minutes"), ["ticker", "start"], "bars").collect()}
    want = {key(r): r.asDict() for r in batch.tick_bars(t).drop("change").collect()}
    assert got == want


def test_outcomes_that_mature_between_batches_are_filled(spark):
    closes = bars(spark, n=120).select("ticker", "d", "c")
    days = [r["d"] for r in closes.select("d").distinct().orderBy("d").collect()]
    sig = closes.select((F.col("ticker") * 100000 + F.datediff("d", F.lit(days[0]))).alias("id"), "ticker", "d", F.lit(None).cast("double").alias("ret_5"))
    table = batch.fill_outcomes(sig.where("1 = 0"), closes).select("id", "ticker", "d", "ret_5", "ret_21", "ret_63")
    seen, last = [], days[0] - dt.timedelta(days=1)
    for today in (days[14], days[60], days[-1]):
        new = sig.where((F.col("d") > F.lit(last)) & (F.col("d") <= F.lit(today)))
        rows = batch.merge_outcomes(table, new, closes.where(F.col("d") <= F.lit(today))).collect()
        table, last = spark.createDataFrame(rows, table.schema), today
        seen.append({r["id"]: (r["ret_5"], r["ret_21"], r["ret_63"]) for r in rows})
    whole = batch.fill_outcomes(sig, closes).collect()
    assert seen[-1] == {r["id"]: (r["ret_5"], r["ret_21"], r["ret_63"]) for r in whole}
    first = min(seen[0])
    assert seen[0][first][0] is not None and seen[0][first][1] is None and seen[1][first][1] is not None
    assert seen[1][first][2] is None and seen[2][first][2] is not None


def tick_rows(days, per_day=6, shift=0):
    t0 = dt.datetime(2024, 1, 1)
    return [(1 + i % 2, t0 + dt.timedelta(days=day, minutes=97 * i + shift), 100.0 + (i * 37 + day) % 11, float(i % 5), 1000 * day + 10 * i + shift) for day in days for i in range(per_day)]


def test_timers_close_bars_and_late_ticks_go_to_the_side_table(spark):
    """Three arrivals over five weeks with a watermark of a day, and a heartbeat; the stream is started anew for each."""
    from tidemark.streaming.batch import bar_parts

    first, second = tick_rows(range(12)), tick_rows(range(12, 24))
    second += tick_rows(range(3, 6), shift=2)  # of bars that are closed by then
    third = tick_rows(range(24, 36)) + tick_rows([1, 22], shift=3)
    schema = "ticker long, ts timestamp, price double, size double, id long"
    rows = first + second + third

    def arriving():
        folder = jobs.work_dir(spark, "late-ticks")
        for part in (first, second, third, [(None, dt.datetime(2024, 6, 1), 0.0, 0.0, None)]):
            spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(folder)
            yield folder

    parts = jobs.read_parts(spark, jobs.run_closed_bars(arriving(), spark, lambda s: s)).persist()
    late = {r["first_id"] for r in parts.where("late").collect()}
    surely = {x[4] for x in tick_rows(range(3, 6), shift=2) + tick_rows([1], shift=3)}
    assert surely <= late <= surely | {x[4] for x in tick_rows([22], shift=3)}
    whole = bar_parts(spark.createDataFrame(rows, schema))
    key = lambda r: (r["ticker"], r["width"], r["start"])
    got = {key(r): r.asDict() for r in jobs.rolled_bars(parts).collect()}
    want = {key(r): r.asDict() for r in jobs.rolled_bars(whole).collect()}
    assert {k[1] for k in want} == {"5 minutes", "15 minutes", "day", "week", "month"}
    assert got.keys() == want.keys()
    for k in want:
        assert all(got[k][c] == want[k][c] or abs(got[k][c] - want[k][c]) < 1e-9 for c in want[k])
    on_time = jobs.rolled_bars(parts.where("not late")).agg(F.sum("n")).first()[0]
    assert on_time < jobs.rolled_bars(whole).agg(F.sum("n")).first()[0]


def test_month_store_writes_touched_months_only_and_survives_a_repeated_version(spark):
    from tidemark.sources.stores import MonthStore, upsert_bars

    rows = bars(spark, n=120).select("ticker", "d", "o", "h", "l", "c", "v")
    store = MonthStore(spark, jobs.work_dir(spark, "months"), rows.schema, files=2)
    assert store.read().count() == 0 and store.newest() == -1
    store.write(rows, 0)
    before = store.versions()
    assert len(before) >= 4 and set(before.values()) == {0}
    month = sorted(before)[1]
    late = rows.where(F.date_format("d", "yyyy-MM") == month).withColumn("c", F.col("c") + 1).withColumn("o", F.lit(-1.0))
    assert store.merge(late, 1, upsert_bars) == [month]
    assert store._files("data/b=1") and [x for x in store._files("data/b=1") if x.startswith("month=")] == [f"month={month}"]
    assert store.versions() == {**before, month: 1}
    want = sorted(map(tuple, upsert_bars(rows, late).collect()))
    assert sorted(map(tuple, store.read().collect())) == want
    store.write(rows.where("1 = 0"), 5)  # an empty version changes nothing
    assert store.merge(rows.where("1 = 0"), 6, upsert_bars) == []
    assert store.merge(late, 1, upsert_bars) == [month] and sorted(map(tuple, store.read().collect())) == want  # a second attempt
    again = MonthStore(spark, store.folder, rows.schema)
    assert again.newest() == 1 and sorted(map(tuple, again.read([month]).collect())) == [r for r in want if r[1].strftime("%Y-%m") == month]


def test_merged_stream_goes_on_after_a_restart(spark):
    from tidemark.sources.stores import MonthStore, upsert_bars

    rows = bars(spark, n=120).select("ticker", "d", "o", "h", "l", "c", "v")
    late = rows.where("day(d) % 3 = 0").withColumn("c", F.col("c") * 2)
    store, state, versions = MonthStore(spark, jobs.work_dir(spark, "merged"), rows.schema), jobs.work_dir(spark, "merged-state"), []
    store.write(rows, 0)
    for folder in jobs.arrivals(late, "late", "d", 3):
        jobs.merge_batches(jobs.file_stream(spark, folder), store, upsert_bars, state)
        versions.append(store.newest())
    assert versions == [1, 2, 3]
    jobs.merge_batches(jobs.file_stream(spark, folder), store, upsert_bars, state)  # nothing new
    assert store.newest() == 3
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, upsert_bars(rows, late).collect()))


def test_a_state_holds_the_bars_of_a_slot_and_its_calls_do_not_grow_with_them():
    import numpy as np
    import pandas as pd

    calls = {"update": 0, "clear": 0, "timer": []}

    class State:
        held = None

        def get(self):
            return self.held

        def update(self, row):
            calls["update"], self.held = calls["update"] + 1, row

        def clear(self):
            calls["clear"], self.held = calls["clear"] + 1, None

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return State()

        def registerTimer(self, ms):  # noqa: N802
            calls["timer"].append(ms)

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    width = 300_000_000
    random = np.random.default_rng(5)
    us = random.integers(0, 288 * width, 20_000)
    x = pd.DataFrame({"ticker": random.integers(0, 40, 20_000), "us": us, "price": random.integers(50, 150, 20_000) / 4, "size": random.integers(0, 9, 20_000) * 1.0, "id": np.arange(20_000), "start_us": us - us % width})
    x.loc[7, "price"] = np.nan
    closer = jobs.BarCloser(width)
    closer.init(Handle())
    assert list(closer.handleInputRows((jobs.HEARTBEAT, 0), iter([x]), At(0))) == []
    assert list(closer.handleInputRows((3, 0), iter([x[:9_000], x[9_000:15_000]]), At(0))) == []
    first = (x[:15_000]["start_us"].min() + width) // 1000
    assert calls == {"update": 1, "clear": 0, "timer": [first]}
    half = 144 * width // 1000
    closed = pd.concat(closer.handleExpiredTimer((3, 0), At(half), None))
    assert len(calls["timer"]) == 2 and calls["timer"][1] > half
    late = pd.concat(closer.handleInputRows((3, 0), iter([x[15_000:]]), At(half)))
    rest = x[15_000:]
    assert sorted(late["first_id"]) == sorted(rest[rest["start_us"] < 144 * width]["id"]) and late["late"].all() and (late["n"] == 1).all()
    closed = pd.concat([closed, *closer.handleExpiredTimer((3, 0), At(288 * width // 1000), None)])
    assert calls["clear"] == 1 and calls["update"] == 3 and list(closer.handleExpiredTimer((3, 0), At(10**12), None)) == []
    on_time = x.drop(index=late["first_id"]).sort_values(["us", "id"])
    want = on_time.assign(pv=on_time["price"] * on_time["size"]).groupby(["ticker", "start_us"]).agg(
        first_us=("us", "min"), first_id=("id", lambda s: s.iloc[0]), o=("price", lambda s: s.iloc[0]), h=("price", "max"), l=("price", "min"), last_us=("us", "max"), last_id=("id", lambda s: s.iloc[-1]), c=("price", lambda s: s.iloc[-1]), v=("size", "sum"), pv=("pv", "sum"), n=("id", "size"))
    got = closed.drop(columns="late").set_index(["ticker", "start_us"]).sort_index()
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_ticks_without_ticker_leave_the_bars_of_others_as_they_are(spark):
    """They come in one batch with other ticks, and turn the numbers beside them into floats there."""
    from tidemark.streaming.batch import bar_parts

    schema = "ticker long, ts timestamp, price double, size double, id long"
    rows = tick_rows(range(2), per_day=20)
    nameless = [(None, *x[1:4], 5_000 + i) for i, x in enumerate(rows[::4])]

    def arriving():
        folder = jobs.work_dir(spark, "nameless-ticks")
        for part in (rows + nameless, [(None, dt.datetime(2024, 6, 1), 0.0, 0.0, None)]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
            yield folder

    key = lambda r: (r["ticker"], r["width"], r["start"])
    got = {key(r): r["n"] for r in jobs.rolled_bars(jobs.read_parts(spark, jobs.run_closed_bars(arriving(), spark, lambda s: s))).collect()}
    assert got == {key(r): r["n"] for r in jobs.rolled_bars(bar_parts(spark.createDataFrame(rows, schema))).collect()}
