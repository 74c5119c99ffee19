"""Heterogeneous JSON rows kept cell by cell without loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lossless_cells(rows: DataFrame, json: str = "json") -> DataFrame:
    """Each row's fields as JSON text cells; a missing key is an absent field.

    A present null is the cell ``null``, so absence and null stay apart.
    """
    fields = F.from_json(json, "map<string,variant>")
    return rows.withColumn(
        "cells", F.transform_values(fields, lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))
    )


def restore_cells(rows: DataFrame, out: str = "json") -> DataFrame:
    """The original object with keys in sorted order."""
    entries = F.array_sort(F.map_entries("cells"))
    body = F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    return rows.withColumn(out, F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}")))


def cell_columns(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One text column and one presence column per key."""
    out = rows
    for k in keys:
        out = out.withColumn(k, F.element_at("cells", k)).withColumn(
            f"{k}_present", F.map_contains_key("cells", k)
        )
    return out
