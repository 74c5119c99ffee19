"""Validation report: one row per defect of the canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.operators.scan import latest, previous, running_max, scan, series


def _issue(df: DataFrame, level: str, code: str, table: str, key: Column) -> DataFrame:
    return df.select(
        "session_id", F.lit(level).alias("level"), F.lit(code).alias("code"),
        F.lit(table).alias("table_name"), key.alias("row_key"),
    )


def _flags(df: DataFrame, table: str, key: Column, rules) -> DataFrame:
    """Several row-level rules in one pass over the table."""
    found = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
                for cond, level, code in rules
            ]
        )
    )
    return df.select("session_id", key.alias("row_key"), F.explode(found).alias("i")).select(
        "session_id", "i.level", "i.code", F.lit(table).alias("table_name"), "row_key"
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _key(*names: str) -> Column:
    return F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(c).cast("string")) for n, c in (x.split(":") for x in names)])


def duplicates(df: DataFrame, keys: list[str], level: str, code: str, table: str, key: Column) -> DataFrame:
    many = df.groupBy("session_id", *keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return _issue(many, level, code, table, key)


def missing_parent(df: DataFrame, parent: DataFrame, on: list[str], level: str, code: str, table: str, key: Column) -> DataFrame:
    lost = df.join(parent.select("session_id", *on).distinct(), ["session_id", *on], "left_anti")
    return _issue(lost, level, code, table, key)


def lap_issues(laps: DataFrame, roster: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    key = _key("driver:driver_id", "lap:lap_number")
    s = series(("session_id", "driver_id"), ("lap_number", "lap_end_time_ms"), chunk_rows)
    seen = scan(
        laps, s, __end=latest(F.col("lap_end_time_ms"), inclusive=False), __lap=previous(F.col("lap_number")),
    )
    back = (F.col("lap_end_time_ms") < F.col("__end")) | (F.col("lap_number") <= F.col("__lap"))
    span = F.col("lap_end_time_ms") - F.col("lap_start_time_ms")
    return _union(
        [
            duplicates(laps, ["driver_id", "lap_number"], "error", "duplicate-lap-key", "laps", key),
            missing_parent(laps, roster, ["driver_id"], "error", "unknown-driver-reference", "laps", key),
            _flags(seen, "laps", key, [(back, "error", "nonmonotonic-lap-time")]),
            _flags(laps, "laps", key, [(span != F.col("lap_time_ms"), "warning", "lap-duration-mismatch")]),
        ]
    )


def stint_issues(stints: DataFrame, laps: DataFrame, roster: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    key = _key("driver:driver_id", "stint:stint_number")
    id_cols = ["session_id", "driver_id", "stint_number"]
    observed = laps.where(F.col("stint_number").isNotNull()).groupBy(*id_cols).agg(
        F.min("lap_number").alias("__lo"), F.max("lap_number").alias("__hi")
    )
    ranged = stints.join(observed, id_cols, "left")
    bad_range = F.col("__lo").isNull() | (F.col("__lo") != F.col("start_lap")) | ~F.col("__hi").eqNullSafe(F.col("end_lap"))
    s = series(("session_id", "driver_id"), ("stint_number", "start_lap"), chunk_rows)
    chain = scan(stints, s, __p=previous(F.struct("start_lap", "end_lap", "end_time_ms")))
    p = F.col("__p")
    starts = stints.withColumn("lap_number", F.col("start_lap"))
    ends = stints.where(F.col("end_lap").isNotNull()).withColumn("lap_number", F.col("end_lap"))
    lap_key = ["driver_id", "lap_number"]
    return _union(
        [
            duplicates(stints, ["driver_id", "stint_number"], "error", "duplicate-stint-key", "stints", key),
            missing_parent(stints, roster, ["driver_id"], "error", "unknown-driver-reference", "stints", key),
            _flags(ranged, "stints", key, [(bad_range, "warning", "stint-range-mismatch")]),
            missing_parent(starts, laps, lap_key, "warning", "stint-start-lap-missing", "stints", key),
            missing_parent(ends, laps, lap_key, "warning", "stint-end-lap-missing", "stints", key),
            _flags(
                chain, "stints", key,
                [
                    (F.col("start_lap") < p["start_lap"], "error", "nonmonotonic-stint-range"),
                    (F.col("start_lap") <= p["end_lap"], "error", "overlapping-stint-range"),
                    (F.col("start_time_ms") < p["end_time_ms"], "error", "overlapping-stint-time"),
                ],
            ),
        ]
    )


def pit_issues(pits: DataFrame, laps: DataFrame, roster: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    key = _key("driver:driver_id", "stop:stop_number")
    at = F.coalesce("pit_in_time_ms", "pit_out_time_ms")
    s = series(("session_id", "driver_id"), ("stop_number",), chunk_rows)
    chain = scan(pits.withColumn("__at", at), s, __before=latest(F.col("__at"), inclusive=False))
    lane = F.col("pit_out_time_ms") - F.col("pit_in_time_ms")
    return _union(
        [
            duplicates(pits, ["driver_id", "stop_number"], "error", "duplicate-pit-key", "pit_stops", key),
            missing_parent(pits, roster, ["driver_id"], "error", "unknown-driver-reference", "pit_stops", key),
            missing_parent(
                pits.where(F.col("lap_number").isNotNull()), laps, ["driver_id", "lap_number"],
                "warning", "pit-lap-missing", "pit_stops", key,
            ),
            _flags(
                chain, "pit_stops", key,
                [
                    (lane.isNotNull() & ~lane.eqNullSafe(F.col("pit_lane_duration_ms")), "error", "pit-duration-mismatch"),
                    (F.col("__at") < F.col("__before"), "error", "nonmonotonic-pit-time"),
                ],
            ),
        ]
    )


def timed_issues(
    df: DataFrame, table: str, order: str, identity: list[str], chunk_rows: int | None = None,
    roster: DataFrame | None = None, laps: DataFrame | None = None,
) -> DataFrame:
    """Checks of a timed table stored in ``order``: time, identity, references."""
    s = series(("session_id",), (order, "session_time_ms"), chunk_rows)
    chain = scan(df, s, __max=running_max(F.col("session_time_ms"), inclusive=False))
    back = chain.where(F.col("session_time_ms") < F.col("__max")).select("session_id").distinct()
    parts = [
        _issue(back, "error", f"nonmonotonic-{table.replace('_', '-')}-time", table, F.lit(None).cast("string")),
        duplicates(
            df, ["session_time_ms", *identity], "error", "duplicate-canonical-key", table, _key("time:session_time_ms")
        ),
    ]
    driver_key = _key("driver:driver_id", "time:session_time_ms")
    if roster is not None:
        rows = df.where(F.col("driver_id").isNotNull())
        parts.append(missing_parent(rows, roster, ["driver_id"], "error", "unknown-driver-reference", table, driver_key))
    if laps is not None:
        rows = df.where(F.col("lap_number").isNotNull())
        parts.append(
            missing_parent(
                rows, laps, ["driver_id", "lap_number"], "error", "unknown-lap-reference", table,
                _key("driver:driver_id", "lap:lap_number"),
            )
        )
    return _union(parts)


def index_issues(index: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Telemetry ranges: duplicate keys, empty ranges, order per driver."""
    s = series(("session_id", "driver_id"), ("row_index",), chunk_rows)
    chain = scan(index, s, __before=latest(F.col("start_time_ms"), inclusive=False))
    key = F.col("data_key")
    return _union(
        [
            duplicates(index, ["data_key"], "error", "duplicate-telemetry-key", "telemetry_index", key),
            _flags(
                chain, "telemetry_index", key,
                [
                    (
                        (F.col("sample_count") == 0) & (F.col("end_time_ms") > F.col("start_time_ms")),
                        "warning", "empty-telemetry-range",
                    ),
                    (F.col("start_time_ms") < F.col("__before"), "error", "nonmonotonic-telemetry-time"),
                ],
            ),
        ]
    )


def roster_issues(sessions: DataFrame, drivers: DataFrame, laps: DataFrame) -> DataFrame:
    """Sessions without drivers or laps, and repeated drivers."""
    none = F.lit(None).cast("string")
    return _union(
        [
            _issue(sessions.join(drivers.select("session_id"), "session_id", "left_anti"), "error", "missing-drivers", "drivers", none),
            _issue(sessions.join(laps.select("session_id"), "session_id", "left_anti"), "error", "missing-laps", "laps", none),
            duplicates(drivers, ["driver_id"], "error", "duplicate-driver-id", "drivers", F.col("driver_id").cast("string")),
        ]
    )


# Smallest allowed value of each canonical column.
MINIMUMS = {
    "lap_number": 1, "lap_start_time_ms": 0, "lap_end_time_ms": 0, "lap_time_ms": 0, "sector_1_time_ms": 0,
    "sector_2_time_ms": 0, "sector_3_time_ms": 0, "stint_number": 1, "tyre_life_laps": 0, "start_lap": 1,
    "end_lap": 1, "start_time_ms": 0, "end_time_ms": 0, "stop_number": 1, "pit_in_time_ms": 0,
    "pit_out_time_ms": 0, "pit_lane_duration_ms": 0, "stationary_duration_ms": 0,
}
ORDERED = (
    ("lap_start_time_ms", "lap_end_time_ms"), ("start_lap", "end_lap"),
    ("start_time_ms", "end_time_ms"), ("pit_in_time_ms", "pit_out_time_ms"),
)


def constraint_issues(df: DataFrame, table: str, key: Column) -> DataFrame:
    """Record-level rules: column minimums and end not before start."""
    rules = [
        (F.col(c) < low, "error", f"below-minimum:{c}") for c, low in MINIMUMS.items() if c in df.columns
    ]
    rules += [
        (F.col(b) < F.col(a), "error", f"reversed-range:{b}")
        for a, b in ORDERED
        if a in df.columns and b in df.columns
    ]
    return _flags(df, table, key, rules)
