"""Exact percentiles that never gather a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.operators.scan import join_same, running_sum, scan, series


def _with_totals(running: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    if not keys:
        return running.withColumn("__total", totals.scalar())
    return join_same(running, totals, keys)


def grouped_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    chunk_rows: int,
) -> DataFrame:
    """Linearly interpolated percentiles (index ``q * (n - 1)``) per key.

    Values are first counted, then the counts are accumulated in value order
    in chunks of about ``chunk_rows`` values; only the two neighbours of each index are kept.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    running = scan(counts, series(keys, ("__v",), chunk_rows), __upto=running_sum(F.col("__n")))
    joined = _with_totals(running, counts, keys)
    low_index = F.col("__upto") - F.col("__n")
    picks = []
    for name, q in quantiles.items():
        exact = F.lit(q) * (F.col("__total") - 1)
        for side, index in (("lo", F.floor(exact)), ("hi", F.ceil(exact))):
            inside = (low_index <= index) & (index < F.col("__upto"))
            picks.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{side}_{name}"))
    found = joined.groupBy(*keys).agg(F.max("__total").alias("samples"), *picks)
    outputs = []
    for name, q in quantiles.items():
        exact = F.lit(q) * (F.col("samples") - 1)
        lo, hi = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        outputs.append((lo + (hi - lo) * (exact - F.floor(exact))).alias(name))
    return found.select(*keys, "samples", *outputs)


def conformal_rank(
    df: DataFrame, keys: Sequence[str], residual: str, coverages: dict[str, float], chunk_rows: int
) -> DataFrame:
    """Half-chunk_rows at rank ``min(n, ceil((n + 1) * coverage))`` of |residual|."""
    counts = (
        df.where(F.col(residual).isNotNull())
        .groupBy(*keys, F.abs(F.col(residual)).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    running = scan(counts, series(keys, ("__v",), chunk_rows), __upto=running_sum(F.col("__n")))
    joined = _with_totals(running, counts, keys)
    picks = []
    for name, coverage in coverages.items():
        rank = F.least(F.col("__total"), F.ceil((F.col("__total") + 1) * F.lit(coverage)))
        inside = (F.col("__upto") - F.col("__n") < rank) & (rank <= F.col("__upto"))
        picks.append(F.max(F.when(inside, F.col("__v"))).alias(name))
    return joined.groupBy(*keys).agg(F.max("__total").alias("samples"), *picks)
