"""Queries of the operators over the test tables: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm import (
    byte_bpe,
    collocations,
    decontaminate,
    line_dedup,
    main_text,
    packing,
    pii,
    quality_rules,
    secret_scan,
    shingle_join,
    spelling,
    token_blocks,
    toxicity,
)
from lapwing.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows in an Arrow batch: bounds what a Python worker holds of long texts.
BATCH_ROWS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_token_blocks")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_blocks.write_tokens(
        table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )
    return token_blocks.read_tokens(spark, path).withColumnRenamed("id", "doc_id")


@query("op2_shingle_join", shingle_join.ORACLE_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return shingle_join.similar_documents(docs, words=4, percent=85).withColumnRenamed("id", "doc_id")


@query("op3_line_dedup", line_dedup.ORACLE_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_digest(table(spark, folder, "documents"))


@query("op4_secret_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_documents(table(spark, folder, "documents")))


@query("op5_byte_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = byte_bpe.round_trip(table(spark, folder, "documents"), file, pattern)
    return decoded.select(
        F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_pii")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_digest(table(spark, folder, "documents"))


@query("op8_main_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract_pages(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_decontaminate")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query("op11_spelling_variants", spelling.ORACLE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op12_packing")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.withColumnRenamed("id", "doc_id")


@query("op13_collocations", collocations.ORACLE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
