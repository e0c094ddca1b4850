"""Bar store, snapshot and filing sources and sinks, as merges of DataFrames.

A sink returns the new content of the table (or writes it partition by partition), so a lost executor only repeats
its own tasks; nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def bars_scan(bars: DataFrame, start: str, end: str, tickers: list[str] | None = None) -> DataFrame:
    """Closed date range, ascending; end = as_of makes the read point-in-time. Named tickers are upper-cased."""
    df = bars.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return df.where(F.col("ticker").isin([t.upper() for t in tickers])) if tickers else df


def bars_on_day(bars: DataFrame, day: str) -> DataFrame:
    return bars.where(F.col("d") == F.lit(day).cast("date")).select("ticker", "c")


def nearest_session(calendar: DataFrame, wanted: DataFrame, back: int = 7) -> DataFrame:
    """Last session within `back` calendar days ending at each wanted date; the date itself when there is none.
    Both sides are calendars. Each wanted date is exploded to its candidate days, so the join is an equi-join."""
    cand = wanted.select("x", F.explode(F.sequence(F.date_sub("x", back - 1), F.col("x"))).alias("d"))
    hit = cand.join(calendar.select("d").distinct(), "d").groupBy("x").agg(F.max("d").alias("session"))
    return wanted.join(hit, "x", "left").select("x", F.coalesce("session", "x").alias("session"))


def upsert_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Late correction rule: a row that is already stored keeps its o, h, l and takes the new c and v."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, (F.col("o.ticker") == F.col("n.ticker")) & (F.col("o.d") == F.col("n.d")), "full_outer")
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    take = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return j.select(*[keep(c) for c in ("ticker", "d", "o", "h", "l")], take("c"), take("v"))


def missing_sessions(ledger: DataFrame, start, end, spark: SparkSession) -> DataFrame:
    """Weekdays of [start, end] that are not in the ledger of fetched days (empty days are in it, so stay fetched)."""
    cal = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    return cal.where(F.dayofweek("d").between(2, 6)).join(ledger.select("d").distinct(), "d", "left_anti")


def store_coverage(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.min("d").alias("first_d"),
                    F.max("d").alias("last_d"), F.countDistinct("d").alias("n_days"))


def keep_last_snapshots(snapshots: DataFrame, keep: int = 3) -> DataFrame:
    """The rows of the newest `keep` scan times. The cut is a top-k over distinct times, joined back as a semi join."""
    newest = snapshots.select("scan_time").distinct().orderBy(F.col("scan_time").desc()).limit(keep)
    return snapshots.join(newest, "scan_time", "left_semi")


def prune_snapshots(snapshots: DataFrame, now: str, keep_days: int = 120) -> DataFrame:
    return snapshots.where(F.col("scan_time") >= F.date_sub(F.lit(now).cast("date"), keep_days))


def first_seen(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("ticker").agg(F.min("scan_time").alias("first_seen"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated filing table; rows with fewer fields than the header are dropped."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="DROPMALFORMED", quote="")


def load_13f(submission: DataFrame, cover: DataFrame, info: DataFrame) -> DataFrame:
    """Position table from the three filing tables: only 13F-HR filings with a readable period, only share positions
    without an option side, first line per (period, cusip, manager) in file order (info.line)."""
    month = F.coalesce(*[F.when(F.upper(F.substring("period", 4, 3)) == m, F.lit(i + 1)) for i, m in enumerate(
        ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"))])
    part = lambda a, n: F.substring("period", a, n).try_cast("int")
    sub = submission.where(F.col("type").startswith("13F-HR")).select(
        "accession", F.when(F.col("period").rlike("^[0-9]{2}-[A-Za-z]{3}-[0-9]{4}$"), F.try_make_timestamp(
            part(8, 4), month, part(1, 2), F.lit(0), F.lit(0), F.lit(0.0)).cast("date")).alias("quarter")).where("quarter is not null")
    pos = info.where((F.coalesce(F.col("putcall"), F.lit("")) == "") & (F.upper(F.trim("kind")) == "SH"))
    j = pos.join(sub, "accession").join(cover.where(F.length("manager") > 0), "accession")
    w = Window.partitionBy("quarter", "cusip", "manager").orderBy("line")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("quarter", "cusip", "manager", "shares", "value")


def annual_series(facts: DataFrame, metrics: dict[str, list[str]]) -> DataFrame:
    """(cik, metric, fy, val, filed) from yearly 10-K facts. Tags of a metric are tried in order: the first row wins
    unless its value is zero and a later one is not. Gross profit falls back to revenue minus cost."""
    prio = F.create_map(*[x for m, tags in metrics.items() for i, t in enumerate(tags) for x in (F.lit(t), F.struct(F.lit(m).alias("m"), F.lit(i).alias("i")))])
    x = facts.where((F.col("fp") == "FY") & (F.col("form") == "10-K")).withColumn("_p", F.try_element_at(prio, F.col("metric"))).where("_p is not null")
    x = x.select("cik", F.col("_p.m").alias("metric"), F.col("_p.i").alias("i"), F.year("end").alias("fy"), "val", "filed")
    w = Window.partitionBy("cik", "metric", "fy").orderBy((F.col("val") == 0).cast("int"), "i", "filed")
    x = x.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "i")
    rev = x.where("metric = 'revenue'").select("cik", "fy", F.col("val").alias("rv"), F.col("filed").alias("rf"))
    cost = x.where("metric = 'cost_of_revenue'").select("cik", "fy", F.col("val").alias("cv"), F.col("filed").alias("cf"))
    have = x.where("metric = 'gross_profit'").select("cik").distinct()
    synth = rev.join(cost, ["cik", "fy"]).join(have, "cik", "left_anti").select(
        "cik", F.lit("gross_profit").alias("metric"), "fy", (F.col("rv") - F.col("cv")).alias("val"), F.greatest("rf", "cf").alias("filed"))
    return x.unionByName(synth)


def quarterly_series(facts: DataFrame, metric: str, lo: int = 80, hi: int = 100) -> DataFrame:
    """(cik, end, val, filed) of flow facts whose window is lo..hi days, one row per period: the earliest filing,
    unless its value is zero and another is not."""
    x = facts.where((F.col("metric") == metric) & F.datediff("end", "start").between(lo, hi))
    return _earliest(x)


def instant_series(facts: DataFrame, metric: str) -> DataFrame:
    return _earliest(facts.where((F.col("metric") == metric) & (F.col("fp") != "FY")))


def _earliest(x: DataFrame) -> DataFrame:
    """min_by with a composite key merges map-side, so restated duplicates never cross the network."""
    g = x.groupBy("cik", "metric", "end").agg(F.min(F.struct((F.col("val") == 0).cast("int").alias("z"), F.col("filed"), F.col("val"))).alias("b"))
    return g.select("cik", "metric", "end", F.col("b.val").alias("val"), F.col("b.filed").alias("filed"))


def panel_meta(panel: DataFrame, labels: list[str]) -> DataFrame:
    """One row of panel statistics for the JSON written beside it."""
    aggs = [f(c).alias(f"{c}_{n}") for c in labels for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return panel.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.countDistinct("d").alias("n_dates"), *aggs)


def write_panel(panel: DataFrame, path: str, labels: list[str]) -> None:
    """Panel by month, with its statistics beside it."""
    panel.withColumn("month", F.date_format("d", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(path + "/panel")
    panel_meta(panel, labels).write.mode("overwrite").json(path + "/meta")


def insert_if_new(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert with do-nothing on conflict: stored rows stay, of several new rows the first by `order` is taken."""
    w = Window.partitionBy(*keys).orderBy(order)
    add = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").join(old.select(*keys), keys, "left_anti")
    return old.unionByName(add)


class MonthStore:
    """A table in versions of its months. Version n writes only the months it changes, to `data/b=n/month=M`, and then names them in
    `log/b=n`; the newest version of a month that the log names is its content. A version that failed before its log was written does
    not count and is written again whole. What the driver reads of the log is one row per month and version."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, day: str = "d", files: int = 1):
        self.spark, self.folder, self.schema, self.day, self.files = spark, folder.rstrip("/"), schema, day, files

    def _files(self, path: str) -> list[str]:
        """Names in a folder of the store, none where it does not exist."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self, before: int | None = None) -> dict[str, int]:
        """Month to the number of its newest version (below `before`)."""
        if not self._files("log"):
            return {}
        log = self.spark.read.schema("month string, b int").parquet(f"{self.folder}/log")
        log = log if before is None else log.where(F.col("b") < before)
        return {r["month"]: r["v"] for r in log.groupBy("month").agg(F.max("b").alias("v")).collect()}

    def newest(self) -> int:
        """Number of the newest version, -1 where there is none."""
        return max(self.versions().values(), default=-1)

    def read(self, months: list[str] | None = None, before: int | None = None) -> DataFrame:
        """The content, of the given months only: other months' files are not touched."""
        at = self.versions(before)
        paths = [f"{self.folder}/data/b={v}/month={m}" for m, v in sorted(at.items()) if months is None or m in set(months)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, version: int) -> None:
        """The months of `rows`, whole, as version `version`; a month goes to `files` files, dealt by a digest of the row."""
        rows = rows.select(*self.schema.names, F.date_format(self.day, "yyyy-MM").alias("month"))
        rows = rows.repartition("month", F.pmod(F.xxhash64(*self.schema.names), F.lit(self.files)))
        rows.write.mode("overwrite").partitionBy("month").parquet(f"{self.folder}/data/b={version}")
        months = [(x.partition("=")[2],) for x in self._files(f"data/b={version}") if x.startswith("month=")]
        self.spark.createDataFrame(months, "month string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/b={version}")

    def merge(self, batch: DataFrame, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame], back: int = 0) -> list[str]:
        """Merges a batch into the months that it touches (with `back`, into all stored months from so many before its first to its
        last one) and returns them. A batch without rows makes no version."""
        batch = batch.persist()
        try:
            own = [r["m"] for r in batch.select(F.date_format(self.day, "yyyy-MM").alias("m")).distinct().collect()]
            if not own:
                return []
            year, month = map(int, min(own).split("-"))
            low = f"{(12 * year + month - 1 - back) // 12:04d}-{(month - 1 - back) % 12 + 1:02d}"
            months = sorted({*own, *(m for m in self.versions(version) if back and low <= m <= max(own))})
            self.write(merge(self.read(months, version), batch), version)
            return months
        finally:
            batch.unpersist()
