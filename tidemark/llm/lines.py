"""Line dedup by site-relative frequency (operator 6).

Pages are grouped by host. A line of a host is boilerplate when more than `ratio` of the host's pages, and `min_pages` at least, hold
it; such lines are dropped from all pages of the host. Lines are counted once per page, as 64-bit digests with their lengths, and
summed on the map side. The lines found per host are few by nature: their shares sum to the mean number of lines per page, so a host
has fewer than that divided by `ratio`. They are sent to all executors only after their number has been checked; beyond
`BROADCAST_LINES` the host is joined by shuffle.

Rows: a null text is a page without lines and stays null; an empty text stays empty; lines without visible characters are never
dropped. A null host is a host of its own. Repeated rows are pages each, or with `distinct` one page per host and text: copies of a
text then do not make its lines boilerplate, and the copies keep them. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

RATIO, MIN_PAGES, BROADCAST_LINES = 0.05, 5, 500_000


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _digest(line: Column) -> Column:
    return F.xxhash64(line, F.length(line))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """Per host with boilerplate: `_host` and the digests of its lines. `distinct`: equal texts of a host are one page, in its total too."""
    key = F.struct(F.col(host).isNull().alias("none"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("name")).alias("_host")
    own = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.length(F.trim(x)) > 0), _digest))
    rows = pages.select(key, own.alias("own"), F.xxhash64(text).alias("_text"), F.length(text).alias("_size"))
    if distinct:  # digests of lines only are shuffled, once per text and task
        rows = written(rows.groupBy("_host", "_text", "_size").agg(F.first("own").alias("own")), "distinct-texts")
    totals = rows.groupBy("_host").agg(F.count("*").alias("pages"))
    held = rows.select("_host", F.explode("own").alias("line")).groupBy("_host", "line").agg(F.count("*").alias("n"))
    often = held.filter(F.col("n") >= min_pages).join(totals, "_host").filter(F.col("n") > F.col("pages") * ratio)
    return often.groupBy("_host").agg(F.collect_list("line").alias("_dropped"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """All columns, the text without its host's boilerplate lines, n_lines and n_dropped."""
    found = written(boilerplate(pages, host, text, ratio, min_pages, distinct), "boilerplate")
    if found.agg(F.coalesce(F.sum(F.size("_dropped")), F.lit(0))).first()[0] <= BROADCAST_LINES:
        found = found.hint("broadcast")
    keep = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    key = F.struct(F.col(host).isNull().alias("none"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("name"))
    rows = pages.select(*keep, key.alias("_host")).join(found, "_host", "left").withColumn("_lines", _lines(text))
    left = F.when(F.col("_dropped").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains("_dropped", _digest(x))))
    rows = rows.withColumn("_left", left)
    sizes = {"n_lines": F.coalesce(F.size("_lines"), F.lit(0)), "n_dropped": F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0))}
    return rows.select(*(F.array_join("_left", "\n").alias(text) if c == text else F.col(c) for c in keep), *((F.when(F.col("_lines").isNull(), 0).otherwise(v)).cast("long").alias(k) for k, v in sizes.items()))


def oracle(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    return f"""
    WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
    p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
    l AS (SELECT d.source, u.line, count(*) AS n FROM d, unnest(list_distinct(d.lines)) AS u(line) WHERE trim(u.line, ' ') <> '' GROUP BY ALL),
    b AS (SELECT l.source, list(l.line) AS dropped FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source WHERE l.n >= {min_pages} AND l.n > p.pages * {ratio} GROUP BY l.source),
    k AS (SELECT d.*, CASE WHEN b.dropped IS NULL THEN d.lines ELSE list_filter(d.lines, lambda x: NOT list_contains(b.dropped, x)) END AS kept
          FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
           CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped FROM k"""
