"""Registry of queries. The column list of a query is written once and shapes both the Spark result and its oracle.

Column spec: space separated `name[:code]`. A digit rounds to that many places, `i` casts to bigint, `s` to string.
Defaults: ticker -> i, d -> s, everything else 6 places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.frames import rnd


@dataclass(frozen=True)
class Query:
    name: str
    cols: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(self.build(spark, sf_dir), self.cols)


REGISTRY: dict[str, Query] = {}
_DEFAULT = {"ticker": "i", "d": "s", "as_of": "s"}


def parse(cols: str) -> tuple[tuple[str, str], ...]:
    out = []
    for tok in cols.split():
        name, _, code = tok.partition(":")
        out.append((name, code or _DEFAULT.get(name, "6")))
    return tuple(out)


def shape(df: DataFrame, cols) -> DataFrame:
    sel = []
    for name, code in cols:
        c = F.col(name)
        if code == "i":
            c = c.cast("bigint")
        elif code == "s":
            c = c.cast("string")
        else:
            c = rnd(c, int(code))
        sel.append(c.alias(name))
    return df.select(*sel)


def shape_sql(body: str, cols) -> str:
    sel = []
    for name, code in cols:
        if code == "i":
            sel.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif code == "s":
            sel.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
        else:
            sel.append(f'floor(CAST("{name}" AS DOUBLE) * 1e{code} + 0.5) / 1e{code} AS "{name}"')
    return f"SELECT {', '.join(sel)} FROM (\n{body}\n) AS shaped"


def query(name: str, cols: str, sql: str | None = None):
    spec = parse(cols)

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, spec, fn, shape_sql(sql, spec) if sql else None)
        return fn

    return deco
