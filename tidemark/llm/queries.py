"""Queries of the numbered operators: what they return, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import align, ann, bpe, chat, cotrain, jaccard, lines, minmax, packing, records, rules, trie, urls
from tidemark.llm.shared import table


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter("vec_id % 100 = 0"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.conversation_pairs(table(spark, sf_dir, "conversations")), "conv_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end=1)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), records.with_end(public_tokenizers.path("byte_bpe_50k.json"), 0, spaced=True))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.dedup(table(spark, sf_dir, "documents"), k=2, num=80, den=100)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


QUERIES = {"op1_cotraining": op1_cotraining, "op2_url_templates": op2_url_templates, "op3_kmeans_tree": op3_kmeans_tree, "op4_bpe": op4_bpe, "op5_preferences": op5_preferences, "op6_line_dedup": op6_line_dedup, "op7_records": op7_records, "op8_quality_rules": op8_quality_rules, "op9_packing": op9_packing, "op10_jaccard_join": op10_jaccard_join, "op11_minmax_dedup": op11_minmax_dedup, "op12_prefix_trie": op12_prefix_trie, "op13_token_alignment": op13_token_alignment}
SQL: dict[str, str] = {"op2_url_templates": urls.oracle(), "op5_preferences": chat.oracle(), "op6_line_dedup": lines.oracle(), "op12_prefix_trie": trie.oracle()}
