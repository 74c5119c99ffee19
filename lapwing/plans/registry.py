"""Registry of runnable queries and their independent SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` and its SQL twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def sql_round(expr: str, digits: int) -> str:
    """SQL twin of ``round_binary``: exact binary rounding, ties to even."""
    s = f"1e{digits}"
    return (
        f"(SELECT CASE WHEN x IS NULL THEN NULL ELSE (floor(x*{s}) + CASE WHEN x*{s}-floor(x*{s}) > 0.5"
        f" OR (x*{s}-floor(x*{s}) = 0.5 AND (hi*{s} - x*{s}) + (x-hi)*{s} > 0)"
        f" OR (x*{s}-floor(x*{s}) = 0.5 AND (hi*{s} - x*{s}) + (x-hi)*{s} = 0 AND floor(x*{s}) % 2 = 1)"
        f" THEN 1 ELSE 0 END) / {s} END"
        f" FROM (SELECT x, x*134217729.0::DOUBLE - (x*134217729.0::DOUBLE - x) AS hi"
        f" FROM (SELECT CAST({expr} AS DOUBLE) AS x)))"
    )
