"""From documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import decontam, line_dedup, near_dup, packing, quality, tokens
from skyloom.llm._common import discard, new_path, scratch, table


LEAST_WORDS = next(least for _, metric, least, _ in quality.RULES if metric == "n_words")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, as they are. Null and empty texts go; repeated rows, null ids and other columns, whatever their names, are no matter."""
    return quality.keep(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines that an earlier row, or line, has; a row that is left with fewer words than the quality rules ask for goes.

    Rows with a null doc_id come first; rows that share a doc_id go by their own lines; null texts stay null; ``n_chars``
    follows the text.
    """
    return line_dedup.dedup(docs, least_words=LEAST_WORDS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at 0.80 or more: that of the least doc_id, and one of rows that repeat it. Rows with a null doc_id or without a word stay."""
    return near_dup.keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of ``benchmark``; null or empty texts and items hold nothing, null ids go by their text."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that hold all ids of all rows; null text has the end id alone, each row is a document of its own."""
    return packing.pack(docs, tokens.vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("minhash_near_dup", near_deduplication),
    ("decontamination", decontamination),
    ("retrieval_packing", retrieval_packing),
]
#: Min-hashing, BM25 and packing have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
