"""Archive quality verdict per race."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.operators.scan import previous, scan, series

# Inclusive domain of each checked column.
LIMITS = {
    "grid_position": (0, 30),
    "finish_position": (1, 30),
    "laps_completed": (0, 200),
    "lap_number": (1, 200),
    "position": (1, 30),
    "stop_number": (1, None),
    "pit_lap_number": (1, 200),
}


def out_of_range(c: Column, low: int | None, high: int | None) -> Column:
    """1 for a present value outside the domain, else 0."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return F.when(bad, 1).otherwise(0)


def invalid_counts(df: DataFrame, keys: Sequence[str], limits: dict[str, tuple]) -> DataFrame:
    """Per key, how many present values lie outside each domain."""
    return df.groupBy(*keys).agg(
        *[F.sum(out_of_range(F.col(c), *lim)).alias(f"invalid_{c}") for c, lim in limits.items()]
    )


def duplicate_count(df: DataFrame, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Rows minus distinct identities per key, through a two-level count."""
    return (
        df.groupBy(*keys, *[c for c in identity if c not in keys])
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))
    )


def sequence_gaps(stops: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Whether the set of numbers differs from 1..max."""
    return (
        stops.groupBy(*keys, number)
        .agg(F.lit(1))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("stops"),
            F.max(number).alias("last_stop"),
            ((F.min(number) != 1) | (F.max(number) != F.count(F.lit(1)))).alias("has_gap"),
        )
    )


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(*keys), list(keys), "left_anti")


def evaluate(
    results: DataFrame,
    laps: DataFrame,
    pits: DataFrame,
    seasons: DataFrame,
    order: str = "row_index",
    limits: dict[str, tuple] | None = None,
) -> DataFrame:
    """Counters, verdict and reasons for every race of ``seasons``.

    Rows carry ``race_id`` (the race they were filed under) and their own
    ``session_id``.  ``order`` gives the row order of laps.  Each table is
    reduced per (race, driver) before anything is joined.
    """
    lim = {**LIMITS, **(limits or {})}
    rk = ["race_id", "driver_id"]

    def bad(column: str, name: str | None = None) -> Column:
        return F.sum(out_of_range(F.col(column), *lim[name or column]))

    def off(df: DataFrame) -> Column:
        return F.sum(F.when(F.col("session_id").eqNullSafe(F.col("race_id")), 0).otherwise(1))

    r = results.groupBy(*rk).agg(
        F.count(F.lit(1)).alias("result_rows"),
        bad("grid_position").alias("invalid_grid_positions"),
        bad("finish_position").alias("invalid_finish_positions"),
        bad("laps_completed").alias("invalid_result_lap_counts"),
        F.count("grid_position").alias("grids"),
        off(results).alias("off_r"),
    )
    ordered = scan(laps, series(rk, (order, "lap_number")), __prev=previous(F.col("lap_number")))
    l = (
        ordered.groupBy(*rk, "lap_number")
        .agg(
            F.count(F.lit(1)).alias("n"),
            bad("lap_number").alias("bad_n"),
            bad("position").alias("bad_p"),
            F.sum(F.when(F.col("lap_time_ms") <= 0, 1).otherwise(0)).alias("bad_t"),
            F.count("lap_time_ms").alias("timed"),
            F.count("position").alias("placed"),
            F.sum(F.when(F.col("lap_number") <= F.col("__prev"), 1).otherwise(0)).alias("back"),
            off(laps).alias("off_l"),
        )
        .groupBy(*rk)
        .agg(
            F.sum("n").alias("lap_rows"),
            (F.sum("n") - F.count(F.lit(1))).alias("duplicate_driver_laps"),
            F.sum("bad_n").alias("invalid_lap_numbers"),
            F.sum("bad_p").alias("invalid_lap_positions"),
            F.sum("bad_t").alias("invalid_lap_times"),
            F.sum("timed").alias("timed_laps"),
            F.sum("placed").alias("placed_laps"),
            F.sum("back").alias("non_monotonic_driver_laps"),
            F.sum("off_l").alias("off_l"),
        )
    )
    p = (
        pits.groupBy(*rk, "stop_number")
        .agg(
            F.count(F.lit(1)).alias("n"),
            bad("stop_number").alias("bad_s"),
            bad("lap_number", "pit_lap_number").alias("bad_l"),
            F.sum(F.when(F.col("duration_ms") <= 0, 1).otherwise(0)).alias("bad_d"),
            off(pits).alias("off_p"),
        )
        .groupBy(*rk)
        .agg(
            F.sum("n").alias("pit_stop_rows"),
            (F.sum("n") - F.count(F.lit(1))).alias("duplicate_driver_pit_stops"),
            F.sum("bad_s").alias("invalid_pit_stop_numbers"),
            F.sum("bad_l").alias("invalid_pit_lap_numbers"),
            F.sum("bad_d").alias("invalid_pit_durations"),
            F.when(
                (F.min("stop_number") != 1) | (F.max("stop_number") != F.count(F.lit(1))), 1
            ).otherwise(0).alias("pit_stop_sequence_gaps"),
            F.sum("off_p").alias("off_p"),
        )
    )
    joined = r.join(l, rk, "full").join(p, rk, "full")
    no_result = F.col("result_rows").isNull()
    counters = [c for c in (*r.columns, *l.columns, *p.columns) if c not in rk]
    race = joined.groupBy("race_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters],
        F.coalesce(F.sum(F.col("result_rows") - 1), F.lit(0)).alias("duplicate_result_drivers"),
        F.coalesce(F.sum(F.when(no_result, F.col("lap_rows"))), F.lit(0)).alias("orphan_lap_drivers"),
        F.coalesce(F.sum(F.when(no_result, F.col("pit_stop_rows"))), F.lit(0)).alias("orphan_pit_drivers"),
    )
    ids = (
        results.select("race_id", "session_id")
        .unionByName(laps.select("race_id", "session_id"))
        .unionByName(pits.select("race_id", "session_id"))
        .where(F.col("session_id").isNotNull())
        .distinct()
        .groupBy("race_id")
        .agg((F.count(F.lit(1)) - 1).alias("mismatched_session_ids"))
    )
    table = (
        seasons.select("race_id", "season")
        .join(race, "race_id", "left")
        .join(ids, "race_id", "left")
        .na.fill(0)
        .withColumn("unexpected_session_id_rows", F.col("off_r") + F.col("off_l") + F.col("off_p"))
    )
    n = F.col
    untimed = (n("lap_rows") > 0) & (n("timed_laps") == 0)
    late_no_pits = (n("season") >= 2011) & (n("pit_stop_rows") == 0)
    defects = F.lit(0)
    for c in STRUCTURAL:
        defects = defects + n(c)
    status = (
        F.when(n("result_rows") == 0, "unusable")
        .when(defects > 0, "degraded")
        .when(n("lap_rows") == 0, "partial")
        .when(untimed | (n("pit_stop_sequence_gaps") > 0) | late_no_pits, "good")
        .otherwise("verified")
    )
    # Reason codes in reporting order.
    rules = [
        (n("duplicate_result_drivers") > 0, "duplicate_result_driver"),
        (n("result_rows") == 0, "missing_results"),
        (n("invalid_grid_positions") > 0, "invalid_grid_position"),
        (n("invalid_finish_positions") > 0, "invalid_finish_position"),
        (n("invalid_result_lap_counts") > 0, "invalid_result_lap_count"),
        (n("mismatched_session_ids") > 0, "mixed_session_identity"),
        (n("unexpected_session_id_rows") > 0, "unexpected_session_identity"),
        (n("invalid_lap_times") > 0, "non_positive_lap_time"),
        (untimed, "lap_times_not_present"),
        ((n("lap_rows") == 0) & (n("result_rows") > 0), "missing_lap_data"),
        (n("duplicate_driver_laps") > 0, "duplicate_driver_lap"),
        (n("orphan_lap_drivers") > 0, "lap_driver_missing_result"),
        (n("invalid_lap_numbers") > 0, "invalid_lap_number"),
        (n("invalid_lap_positions") > 0, "invalid_lap_position"),
        (n("non_monotonic_driver_laps") > 0, "non_monotonic_driver_laps"),
        (n("invalid_pit_durations") > 0, "non_positive_pit_duration"),
        (n("duplicate_driver_pit_stops") > 0, "duplicate_driver_pit_stop"),
        (n("orphan_pit_drivers") > 0, "pit_driver_missing_result"),
        (n("invalid_pit_stop_numbers") > 0, "invalid_pit_stop_number"),
        (n("invalid_pit_lap_numbers") > 0, "invalid_pit_lap_number"),
        (n("pit_stop_sequence_gaps") > 0, "pit_stop_sequence_gap"),
        ((F.col("status") == "good") & late_no_pits, "pit_stop_rows_not_present"),
    ]
    return (
        table.withColumn("status", status)
        .withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules])))
        .select(
            "race_id", "season", "status", "reasons", "result_rows", "lap_rows", "pit_stop_rows",
            *STRUCTURAL, "pit_stop_sequence_gaps",
            (n("result_rows") > 0).alias("cap_results"),
            (n("grids") > 0).alias("cap_grid"),
            (n("timed_laps") > 0).alias("cap_lap_times"),
            (n("placed_laps") > 0).alias("cap_lap_positions"),
            (n("pit_stop_rows") > 0).alias("cap_pit_stops"),
        )
    )


STRUCTURAL = (
    "duplicate_result_drivers",
    "invalid_grid_positions",
    "invalid_finish_positions",
    "invalid_result_lap_counts",
    "mismatched_session_ids",
    "unexpected_session_id_rows",
    "duplicate_driver_laps",
    "orphan_lap_drivers",
    "invalid_lap_numbers",
    "invalid_lap_positions",
    "non_monotonic_driver_laps",
    "invalid_lap_times",
    "duplicate_driver_pit_stops",
    "orphan_pit_drivers",
    "invalid_pit_stop_numbers",
    "invalid_pit_lap_numbers",
    "invalid_pit_durations",
)
