"""Catalog filters, rollups, capability tiers and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _has(array: str, term: str) -> Column:
    return F.exists(F.coalesce(F.col(array), F.array().cast("array<string>")),
                    lambda x: F.lower(x).contains(term.lower()))


def catalog_query(
    events: DataFrame,
    season: int | None = None,
    status: str | None = None,
    circuit: str | None = None,
    driver: str | None = None,
    team: str | None = None,
    capability: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Events matching every given facet; sort with ``newest_first``.

    ``drivers`` and ``teams`` are name arrays, ``capabilities`` a
    map<string, boolean>.
    """
    out = events
    if season is not None:
        out = out.where(F.col("season") == season)
    if status is not None:
        out = out.where(F.col("status") == status)
    if circuit:
        out = out.where(F.lower("circuit_name").contains(circuit.lower()))
    if driver:
        out = out.where(_has("drivers", driver))
    if team:
        out = out.where(_has("teams", team))
    if capability:
        out = out.where(F.coalesce(F.element_at("capabilities", capability), F.lit(False)))
    if text:
        haystack = F.concat_ws(
            " ", "event_name", "official_name", "circuit_name",
            F.coalesce("country", F.lit("")), "drivers", "teams",
        )
        out = out.where(F.lower(haystack).contains(text.lower()))
    return out


def newest_first() -> list[Column]:
    return [F.col("season").desc(), F.col("round_number").desc(), F.col("event_id").desc()]


def season_index(events: DataFrame) -> DataFrame:
    """Events, completed events and the latest date per season."""
    return events.groupBy(F.col("season").alias("year")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count(F.when(F.col("status") == "completed", 1)).alias("completed_event_count"),
        F.max("event_date").alias("latest_event_date"),
    )


def catalog_counts(events: DataFrame) -> DataFrame:
    """How many events per status, quality and capability tier."""
    return (
        events.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(k).alias("dimension"), F.col(c).alias("value"))
                        for k, c in (("status", "status"), ("quality", "quality_status"), ("tier", "tier"))
                    ]
                )
            ).alias("x")
        )
        .groupBy("x.dimension", "x.value")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def tier(flag) -> Column:
    """Capability tier; ``flag(name)`` gives the boolean column of a capability."""
    full = flag("telemetry")
    for name in (
        "track_positions", "weather", "race_control", "compounds", "ml_intelligence",
        "strategy_simulation",
    ):
        full = full & flag(name)
    lap = flag("lap_times") | flag("lap_positions")
    return (
        F.when(full, "full")
        .when(flag("telemetry") | flag("track_positions"), "telemetry")
        .when(
            flag("weather") | flag("race_control") | flag("stints") | flag("compounds"),
            "detailed-timing",
        )
        .when(lap & flag("pit_stops"), "lap-and-pit")
        .when(lap, "lap-data")
        .otherwise("archive")
    )


# Table whose rows prove each capability.
EVIDENCE = {
    "results": "driver_classifications",
    "lap_times": "laps",
    "lap_positions": "race_positions",
    "pit_stops": "pit_stops",
    "stints": "stints",
    "compounds": "stints",
    "weather": "weather",
    "race_control": "race_control",
    "track_positions": "track_positions",
    "telemetry": "telemetry_index",
}
# Channel names that prove each telemetry capability.
CHANNELS = {
    "speed": ("speed",),
    "throttle": ("throttle",),
    "brake": ("brake",),
    "gear": ("ngear", "gear"),
    "rpm": ("rpm",),
    "drs": ("drs",),
}


def capabilities(counts: DataFrame, channels: DataFrame, modelled: DataFrame | None = None) -> DataFrame:
    """Capability flags and tier per session.

    ``counts`` is (session_id, table_name, rows); ``channels`` is
    (session_id, channel) and ``modelled`` lists sessions with model support.
    """
    pivot = counts.groupBy("session_id").agg(
        *[
            (F.coalesce(F.sum(F.when(F.col("table_name") == t, F.col("rows"))), F.lit(0)) > 0).alias(c)
            for c, t in EVIDENCE.items()
        ]
    ).withColumn("grid", F.lit(True))
    present = channels.groupBy("session_id").agg(
        *[
            F.bool_or(F.lower("channel").isin(*names)).alias(c) for c, names in CHANNELS.items()
        ]
    )
    out = pivot.join(present, "session_id", "left")
    if modelled is None:
        out = out.withColumn("ml_intelligence", F.lit(False))
    else:
        ids = modelled.select("session_id").distinct().withColumn("ml_intelligence", F.lit(True))
        out = out.join(ids, "session_id", "left")
    out = out.na.fill(False)
    out = out.withColumn("strategy_simulation", F.col("ml_intelligence"))
    return out.withColumn("tier", tier(F.col))


def merge_catalog(old: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """Old events not replaced by a new one, plus the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def select_sessions(
    sessions: DataFrame,
    season: int | None = None,
    from_season: int | None = None,
    session_ids: Sequence | None = None,
    session_types: Sequence[str] | None = None,
    first_season: int = 2018,
) -> DataFrame:
    """Completed sessions by season, id and type; bad filters are errors."""
    if season is not None and from_season is not None:
        raise ValueError("season and from_season are mutually exclusive")
    for value in (season, from_season):
        if value is not None and value < first_season:
            raise ValueError("season filter is before the first season")
    if session_ids is not None and not session_ids:
        raise ValueError("session ids are empty")
    if session_types is not None and not session_types:
        raise ValueError("session types are empty")
    out = sessions.where((F.col("state") == "completed") & (F.col("season") >= first_season))
    if season is not None:
        out = out.where(F.col("season") == season)
    if from_season is not None:
        out = out.where(F.col("season") >= from_season)
    if session_ids is not None:
        out = out.where(F.col("session_id").isin(*session_ids))
    if session_types is not None:
        out = out.where(F.col("session_type").isin(*session_types))
    return out


def duplicate_identities(sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Identities that occur more than once; must be empty before selection."""
    return sessions.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def telemetry_sessions(
    sessions: DataFrame,
    season: int | None = None,
    session_type: str | None = None,
    event: str | None = None,
    circuit: str | None = None,
    driver=None,
) -> DataFrame:
    """Telemetry sessions by season, type, event text, circuit text and driver."""
    out = sessions
    if season is not None:
        out = out.where(F.col("season") == season)
    if session_type is not None:
        out = out.where(F.col("session_type") == session_type)
    if event:
        out = out.where(F.lower("event_name").contains(event.lower()))
    if circuit:
        out = out.where(F.lower("circuit_name").contains(circuit.lower()))
    if driver is not None:
        out = out.where(F.array_contains("drivers", driver))
    return out


def session_slice(
    df: DataFrame,
    session_id=None,
    driver_id=None,
    lap_range: tuple[int | None, int | None] = (None, None),
    ms_range: tuple[int | None, int | None] = (None, None),
    time: str = "session_time_ms",
) -> DataFrame:
    """Rows of one session by driver, lap span and time span (inclusive)."""
    out = df
    if session_id is not None:
        out = out.where(F.col("session_id") == F.lit(session_id))
    if driver_id is not None:
        out = out.where(F.col("driver_id") == F.lit(driver_id))
    for column, (low, high) in (("lap_number", lap_range), (time, ms_range)):
        if low is not None:
            out = out.where(F.col(column) >= low)
        if high is not None:
            out = out.where(F.col(column) <= high)
    return out


def board_at_lap(laps: DataFrame, results: DataFrame, lap: int) -> DataFrame:
    """Timing board of a lap with the result row; unplaced drivers last."""
    return (
        laps.where(F.col("lap_number") == lap)
        .join(results, ["session_id", "driver_id"], "left")
        .orderBy("session_id", F.col("position").asc_nulls_last(), "driver_id")
    )


def link_context(telemetry: DataFrame, replays: DataFrame, races: DataFrame) -> DataFrame:
    """Attach the replay and the race of the same (season, round).

    A race must be the only one of its round and pass the quality gate; a
    replay must be the only stored one.
    """
    key = ["season", "round_number"]

    def unique(df: DataFrame, eligible: Column, out: str) -> DataFrame:
        return df.groupBy(*key).agg(
            F.count(F.lit(1)).alias("__n"), F.max(F.when(eligible, F.col("session_id"))).alias(out)
        ).where((F.col("__n") == 1) & F.col(out).isNotNull()).drop("__n")

    gate = (F.col("status") == "completed") & F.col("quality_status").isin("verified", "good")
    return telemetry.join(unique(replays, F.lit(True), "replay_session_id"), key, "left").join(
        unique(races, gate, "race_session_id"), key, "left"
    )
