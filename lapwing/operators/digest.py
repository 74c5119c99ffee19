"""Order-free table digests and keyed deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions.values import stable_json


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count plus XOR and sum of 60-bit row digests; order does not matter."""
    row = F.conv(F.substring(F.sha2(stable_json(columns), 256), 1, 15), 16, 10).cast("long")
    return df.select(row.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("h").alias("xor_digest"),
        F.sum(F.pmod(F.col("h"), F.lit(1000003))).alias("sum_digest"),
    )


def dedupe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: of conflicting copies the smallest JSON wins.

    Adds ``copies`` and ``conflicting``.  Identical copies collapse before the
    shuffle; the result does not depend on input order.
    """
    fields = df.columns
    variants = df.withColumn("__json", stable_json(fields))
    return (
        variants.groupBy(*keys)
        .agg(
            F.min_by(F.struct(*[c for c in fields if c not in keys]), "__json").alias("__row"),
            F.count(F.lit(1)).alias("copies"),
            (F.min("__json") != F.max("__json")).alias("conflicting"),
        )
        .select(*keys, "__row.*", "copies", "conflicting")
    )


def rejections(df: DataFrame, reason: str = "reason") -> DataFrame:
    """How many rows each reason rejected."""
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("rows"))
