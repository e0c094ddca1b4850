"""Work tables in the folder that all executors share, and small column helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Shuffle files are removed with the end of the execution that made them. An executor lost before that end is made good as ever.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the executions inside."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`. Only where the setting is absent (tests, one machine) it is set to a scratch folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the frame to the shared folder and read it back with its schema. The shuffles of the write leave no files."""
    spark = df.sparkSession
    path = workspace(spark, name)
    with settings(spark, TIDY):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salt(key: Column, n: int) -> Column:
    """A number in [0, n) that depends on the key alone, so that a retried task deals its rows as before."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
