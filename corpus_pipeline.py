"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing and byte-level BPE over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Every stage's result is written as Parquet
and read again as the next one's docs, in the shared folder that the session names. All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, line_dedup, mixing, near_dup, quality
from tributary.llm.common import read_table, remove_folder
from tributary.llm.queries import multi_ranks
from tributary.llm.token_files import fresh_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base check or are depleted, and without frequent lines."""
    return quality.clean(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of repeated line runs; documents left without a word go."""
    return line_dedup.remove_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8."""
    return near_dup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mix with tempered source weights; a source that runs out leaves it."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the number of bytes that decoding gives back."""
    ranks = multi_ranks()
    encoded = bpe.encode(docs, ranks, sample_rows=2048)  # less on a driver that four stages have already used
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.octet_length(bpe.decode(F.col("ids"), ranks)).cast("bigint").alias("n_bytes"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near duplicates", near_duplicates),
    ("mixing", mixture),
    ("byte-level BPE", encoding),
]

#: SQL can't express the near-duplicate and BPE stages; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. What lies between two stages is removed once it is read; the last result stays."""
    docs, folder = read_table(spark, sf_dir, "documents"), fresh_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
