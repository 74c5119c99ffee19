"""As-of, bracketing and interval lookups between two keyed series.

Each lookup is a union of both sides followed by an ordered scan, so it costs
one shuffle of either side, never a range join or a pairing of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.operators.scan import latest, running_sum, scan, series, upcoming


def _merged(left: DataFrame, right: DataFrame, by, left_on, right_on, values, left_side):
    lrow = left.select(
        *by,
        F.col(left_on).alias("__t"),
        F.lit(left_side).alias("__side"),
        F.struct(*left.columns).alias("__row"),
    )
    rrow = right.where(F.col(right_on).isNotNull()).select(
        *by,
        F.col(right_on).alias("__t"),
        F.lit(1).alias("__side"),
        F.struct(*[F.col(c) for c in values]).alias("__r"),
    )
    return lrow.where(F.col("__t").isNotNull()).unionByName(rrow, allowMissingColumns=True)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    chunk_rows: int | None = None,
    strict: bool = False,
    how: str = "left",
) -> DataFrame:
    """Latest right row with ``right_on <= left_on`` (``<`` when strict).

    Equal right times resolve to the largest ``values`` tuple.  Left rows with
    a NULL time keep NULL values under ``how='left'``.
    """
    both = _merged(left, right, by, left_on, right_on, values, 0 if strict else 2)
    s = series(by, ("__t", "__side", "__r"), chunk_rows)
    found = (
        scan(both, s, __hit=latest(F.col("__r")))
        .where(F.col("__row").isNotNull())
        .select("__row.*", *[F.col(f"__hit.{c}").alias(c) for c in values])
    )
    if how == "inner":
        return found.where(F.coalesce(*[F.col(c).isNotNull() for c in values]))
    missing = left.where(F.col(left_on).isNull())
    return found.unionByName(missing, allowMissingColumns=True)


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    chunk_rows: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Earliest right row with ``right_on > left_on`` (``>=`` when not strict)."""
    both = _merged(left, right, by, left_on, right_on, values, 2 if strict else 0)
    s = series(by, ("__t", "__side", "__r"), chunk_rows)
    return (
        scan(both, s, __hit=upcoming(F.col("__r")))
        .where(F.col("__row").isNotNull())
        .select("__row.*", *[F.col(f"__hit.{c}").alias(c) for c in values])
    )


def bracket(
    points: DataFrame,
    samples: DataFrame,
    by: Sequence[str],
    point_on: str,
    sample_on: str,
    values: Sequence[str],
    chunk_rows: int | None = None,
) -> DataFrame:
    """Samples around each point as structs ``before`` (<=) and ``after`` (>)."""
    both = _merged(points, samples, by, point_on, sample_on, values, 2)
    s = series(by, ("__t", "__side", "__r"), chunk_rows)
    return (
        scan(both, s, before=latest(F.col("__r")), after=upcoming(F.col("__r")))
        .where(F.col("__row").isNotNull())
        .select("__row.*", "before", "after")
    )


def count_within(
    spans: DataFrame,
    points: DataFrame,
    by: Sequence[str],
    ident: Sequence[str],
    start: str,
    end: str,
    at: str,
    flags: dict,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Per span, how many points with each flag lie in ``(start, end]``.

    Computed as the difference of two running counts, so long or overlapping
    spans cost the same as short ones.  ``ident`` identifies a span row.
    """
    edges = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *dict.fromkeys([*by, *ident]),
        F.explode(
            F.array(
                F.struct(F.col(start).alias("__t"), F.lit(-1).alias("__sign")),
                F.struct(F.col(end).alias("__t"), F.lit(1).alias("__sign")),
            )
        ).alias("__e"),
    )
    edges = edges.select(
        *dict.fromkeys([*by, *ident]), "__e.__t", "__e.__sign", F.lit(1).alias("__side")
    )
    marks = points.where(F.col(at).isNotNull()).select(
        *by,
        F.col(at).alias("__t"),
        F.lit(0).alias("__side"),
        *[F.when(cond, 1).otherwise(0).cast("long").alias(name) for name, cond in flags.items()],
    )
    both = edges.unionByName(marks, allowMissingColumns=True)
    steps = {f"__n_{n}": running_sum(F.col(n)) for n in flags}
    scanned = scan(both, series(by, ("__t", "__side"), chunk_rows), **steps)
    counts = (
        scanned.where(F.col("__side") == 1)
        .groupBy(*dict.fromkeys([*by, *ident]))
        .agg(
            *[
                F.sum(F.col("__sign") * F.coalesce(F.col(f"__n_{n}"), F.lit(0))).alias(n)
                for n in flags
            ]
        )
    )
    return spans.join(counts, list(dict.fromkeys([*by, *ident])), "left")


def unique_within(
    points: DataFrame,
    candidates: DataFrame,
    by: Sequence[str],
    ident: Sequence[str],
    at: str,
    candidate_at: str,
    value: str,
    tolerance: int,
    chunk_rows: int | None = None,
) -> DataFrame:
    """The one candidate within ``tolerance`` of each point, NULL unless unique.

    A candidate count is read at both edges of the band and the newest candidate
    at the upper edge; if exactly one lies between, it is that one.  No pairs of
    points and candidates are formed, however dense the band.
    """
    cols = list(dict.fromkeys([*by, *ident]))
    edges = points.where(F.col(at).isNotNull()).select(
        *cols,
        F.explode(
            F.array(
                F.struct((F.col(at) - tolerance - 1).alias("t"), F.lit(-1).alias("sign")),
                F.struct((F.col(at) + tolerance).alias("t"), F.lit(1).alias("sign")),
            )
        ).alias("__e"),
    ).select(*cols, F.col("__e.t").alias("__t"), F.col("__e.sign").alias("__sign"), F.lit(1).alias("__side"))
    marks = candidates.where(F.col(candidate_at).isNotNull()).select(
        *by, F.col(candidate_at).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v")
    )
    both = edges.unionByName(marks, allowMissingColumns=True)
    scanned = scan(
        both,
        series(by, ("__t", "__side"), chunk_rows),
        __n=running_sum(F.when(F.col("__side") == 0, 1).otherwise(0).cast("long")),
        __hit=latest(F.col("__v")),
    )
    found = (
        scanned.where(F.col("__side") == 1)
        .groupBy(*cols)
        .agg(
            F.sum(F.col("__sign") * F.col("__n")).alias("nearby"),
            F.max(F.when(F.col("__sign") == 1, F.col("__hit"))).alias("__hit"),
        )
        .select(*cols, "nearby", F.when(F.col("nearby") == 1, F.col("__hit")).alias(f"near_{value}"))
    )
    return points.join(found, cols, "left")
