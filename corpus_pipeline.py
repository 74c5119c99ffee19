"""A corpus from raw documents: rejected texts go, repeated lines, near copies and benchmark leaks go, ids remain."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm import byte_bpe, decontaminate, line_dedup, quality_rules, shingle_join
from lapwing.llm.queries import BATCH_ROWS, table
from lapwing.session import durable


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    return quality_rules.filter_quality(docs, table(spark, folder, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    return line_dedup.dedup_lines(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return shingle_join.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, folder, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each document, with the size and the digest of what they decode to; ``id`` is ``doc_id`` again."""
    file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(docs, file, pattern, keep_ids=True).select(
        F.col("id").alias("doc_id"), "id", "ids", "n_tokens", F.octet_length("decoded").alias("n_bytes"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: Rules are learned and ids come from merge ranks: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
