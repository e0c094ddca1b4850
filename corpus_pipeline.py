"""Corpus pipeline: quality rules, quality classifier, line dedup, near duplicates, packing. Each stage works on what the one before kept.

Rows: every case is the operator's own (nulls, empty and very long texts, repeated rows, empty tables); columns of `documents`, extra
ones too, keep their names and values, but for `text` and `n_chars` after line dedup.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cotrain, jaccard, lines, packing, records, rules
from tidemark.llm.shared import table, written

#: Columns that the operators add while a stage runs.
ADDED = {*rules.COUNTS, "base_failed", "distance", "kept", "text_score", "meta_score", "score", "n_dropped"}


def _aside(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in ADDED})


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"_own_{c}" if c in ADDED else c).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie within their group's robust distance."""
    with jaccard.small_batches(spark):
        return _back(rules.judge(_aside(docs)).filter("kept"), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    with jaccard.small_batches(spark):
        return _back(cotrain.classify(_aside(docs), table(spark, sf_dir, "labels")).filter("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source. Equal texts count as one page: the next stage removes the copies."""
    rows = _back(lines.drop_boilerplate(_aside(docs), distinct=True), docs)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8: the one with the smallest id."""
    found = jaccard.join(docs, k=5, num=80, den=100)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_stays")), "left_semi").dropDuplicates(["doc_id", "text"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents kept, placed in sequences of at most 1,024 tokens."""
    return packing.pack_documents(docs, records.with_end(public_tokenizers.path("byte_bpe_50k.json"), 0, spaced=True))


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("line dedup", line_dedup), ("n-gram jaccard join", near_duplicates), ("packing", pack)]
#: Model fits, similarity joins and packing are not SQL: tests/llm/ hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again as the next stage's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
