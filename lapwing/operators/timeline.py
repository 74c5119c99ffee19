"""Event timeline: typed candidates, one order, contiguous sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.operators.scan import position, previous, scan, series

# Order of event types at the same instant.
PRIORITY = {
    "session-marker": 0,
    "track-status-changed": 10,
    "weather-observed": 20,
    "race-control-event": 30,
    "driver-stint-changed": 40,
    "driver-pit-entered": 50,
    "driver-position-changed": 60,
    "driver-lap-completed": 70,
    "driver-pit-exited": 80,
    "driver-status-changed": 90,
}
# Payload columns by event type; absent ones are NULL.
PAYLOAD = {
    "session-marker": ("marker",),
    "weather-observed": ("air_temperature_c", "humidity_percent", "rainfall", "track_temperature_c"),
    "race-control-event": ("lap_number", "message", "source_kind"),
    "track-status-changed": ("track_status",),
    "driver-stint-changed": ("compound", "start_lap", "stint_number", "tyre_age_laps"),
    "driver-pit-entered": ("lap_number", "stop_number"),
    "driver-pit-exited": ("lap_number", "stop_number"),
    "driver-position-changed": ("lap_number", "position"),
    "driver-lap-completed": ("compound", "lap_number", "lap_time_ms", "stint_number", "tyre_age_laps"),
    "driver-status-changed": ("status",),
}


def status_changes(control: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Control rows whose known track status differs from the last known one."""
    known = control.where(F.col("track_status") != "unknown")
    s = series(("session_id",), ("session_time_ms", "event_id"), chunk_rows)
    marked = scan(known, s, __p=previous(F.col("track_status")))
    return marked.where(~F.col("track_status").eqNullSafe(F.col("__p"))).drop("__p")


def _events(df: DataFrame, kind: str, time: Column, key: Column, driver: Column | None = None, **payload: Column) -> DataFrame:
    types = {"session_id": F.col("session_id"), "session_time_ms": time.cast("long")}
    return df.select(
        types["session_id"],
        types["session_time_ms"].alias("session_time_ms"),
        F.lit(PRIORITY[kind]).alias("priority"),
        F.lit(kind).alias("event_type"),
        (F.lit(None).cast("int") if driver is None else driver).alias("driver_id"),
        key.alias("source_key"),
        *[c.alias(n) for n, c in payload.items()],
    )


def _id(prefix: str, *parts: str) -> Column:
    return F.concat_ws("-", F.lit(prefix), *[F.col(p).cast("string") for p in parts])


def candidates(
    laps: DataFrame, stints: DataFrame, pits: DataFrame, positions: DataFrame,
    weather: DataFrame, control: DataFrame, chunk_rows: int | None = None,
) -> DataFrame:
    """Every event the canonical tables support; final results are never read.

    Deleted laps and rows without a time yield no event.
    """
    c = F.col
    marker = laps.select("session_id").unionByName(weather.select("session_id")).unionByName(
        control.select("session_id")
    ).distinct()
    changes = status_changes(control, chunk_rows)
    control_key = _id("control", "session_time_ms", "event_id")
    parts = [
        _events(marker, "session-marker", F.lit(0), F.lit("session-origin"), marker=F.lit("session-origin")),
        _events(
            weather, "weather-observed", c("session_time_ms"), _id("weather", "session_time_ms", "event_id"),
            air_temperature_c=c("air_temperature_c"), track_temperature_c=c("track_temperature_c"),
            humidity_percent=c("humidity_percent"), rainfall=c("rainfall"),
        ),
        _events(
            control, "race-control-event", c("session_time_ms"), control_key, c("driver_id"),
            message=c("message"), source_kind=c("source_kind"),
        ),
        _events(
            changes, "track-status-changed", c("session_time_ms"),
            F.concat(control_key, F.lit("-track-status")), track_status=c("track_status"),
        ),
        _events(
            stints.where(c("start_time_ms").isNotNull()), "driver-stint-changed", c("start_time_ms"),
            _id("stint", "driver_id", "stint_number"), c("driver_id"),
            stint_number=c("stint_number"), compound=c("compound"),
            tyre_age_laps=c("tyre_life_start_laps"), start_lap=c("start_lap"),
        ),
        _events(
            pits.where(c("pit_in_time_ms").isNotNull()), "driver-pit-entered", c("pit_in_time_ms"),
            F.concat(_id("pit", "driver_id", "stop_number"), F.lit("-in")), c("driver_id"),
            stop_number=c("stop_number"), lap_number=c("lap_number"),
        ),
        _events(
            pits.where(c("pit_out_time_ms").isNotNull()), "driver-pit-exited", c("pit_out_time_ms"),
            F.concat(_id("pit", "driver_id", "stop_number"), F.lit("-out")), c("driver_id"),
            stop_number=c("stop_number"), lap_number=c("lap_number"),
        ),
        _events(
            positions, "driver-position-changed", c("session_time_ms"),
            _id("position", "driver_id", "session_time_ms"), c("driver_id"),
            position=c("position"), lap_number=c("lap_number"),
        ),
        _events(
            laps.where(c("lap_end_time_ms").isNotNull() & ~F.coalesce(c("is_deleted"), F.lit(False))),
            "driver-lap-completed", c("lap_end_time_ms"), _id("lap", "driver_id", "lap_number"), c("driver_id"),
            lap_number=c("lap_number"), lap_time_ms=c("lap_time_ms"), stint_number=c("stint_number"),
            compound=c("compound"), tyre_age_laps=c("tyre_life_laps"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def status_events(statuses: DataFrame) -> DataFrame:
    """Driver status events supplied from outside the canonical tables."""
    c = F.col
    return _events(
        statuses, "driver-status-changed", c("session_time_ms"),
        _id("status", "driver_id", "session_time_ms", "event_id"), c("driver_id"), status=c("status"),
    )


def payload_json(df: DataFrame) -> Column:
    """Canonical JSON of the columns that belong to the event's type."""
    out = F.lit(None).cast("string")
    for kind, names in PAYLOAD.items():
        known = [n for n in names if n in df.columns]
        body = F.to_json(F.struct(*known), {"ignoreNullFields": "false"}) if known else F.lit("{}")
        out = F.when(F.col("event_type") == kind, body).otherwise(out)
    return out


def build_timeline(events: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Distinct events numbered from 0 per session in identity order."""
    keyed = events.dropDuplicates().withColumn(
        "__driver", F.coalesce(F.col("driver_id").cast("string"), F.lit(""))
    ).withColumn("payload_json", payload_json(events))
    order = ("session_time_ms", "priority", "event_type", "__driver", "source_key", "payload_json")
    numbered = scan(keyed, series(("session_id",), order, chunk_rows), __n=position())
    return numbered.withColumn("sequence", F.col("__n") - 1).drop("__n", "__driver")


def sequence_issues(events: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Rows of a stored log whose sequence is not contiguous or goes back in time."""
    s = series(("session_id",), ("sequence", "session_time_ms"), chunk_rows)
    rows = scan(events, s, __n=position(), __t=previous(F.col("session_time_ms")))
    issue = F.when(F.col("sequence") != F.col("__n") - 1, "noncontiguous-sequence").when(
        F.col("session_time_ms") < F.col("__t"), "time-moved-backward"
    )
    return rows.withColumn("issue", issue).where(F.col("issue").isNotNull()).drop("__n", "__t")


def decode_payload(events: DataFrame, schema: str) -> DataFrame:
    """Payload JSON back to typed columns."""
    return events.withColumn("payload", F.from_json("payload_json", schema))


def timeline_slice(events: DataFrame, from_ms=None, to_ms=None, types=None) -> DataFrame:
    out = events
    if from_ms is not None:
        out = out.where(F.col("session_time_ms") >= from_ms)
    if to_ms is not None:
        out = out.where(F.col("session_time_ms") <= to_ms)
    if types:
        out = out.where(F.col("event_type").isin(*types))
    return out


def significant(events: DataFrame) -> DataFrame:
    """Drop markers, positions, laps and weather without rain."""
    quiet = F.col("event_type").isin("driver-position-changed", "driver-lap-completed", "session-marker")
    dry = (F.col("event_type") == "weather-observed") & ~F.coalesce(F.col("rainfall"), F.lit(False))
    return events.where(~quiet & ~dry)


def leader_laps(positions: DataFrame) -> DataFrame:
    """Earliest first-place observation of each lap."""
    return (
        positions.where((F.col("position") == 1) & F.col("lap_number").isNotNull())
        .groupBy("session_id", "lap_number")
        .agg(F.min("session_time_ms").alias("session_time_ms"))
    )


def lap_cursors(positions: DataFrame, laps: DataFrame) -> DataFrame:
    """Start and end of lap N taken from its first leader's own lap.

    Laps without a leader, a start or with a reversed range are left out.
    """
    leaders = (
        positions.where((F.col("position") == 1) & F.col("lap_number").isNotNull())
        .groupBy("session_id", "lap_number")
        .agg(F.min(F.struct("session_time_ms", F.col("driver_id").cast("string").alias("d"), "driver_id")).alias("x"))
        .select("session_id", "lap_number", F.col("x.session_time_ms").alias("end_time_ms"), F.col("x.driver_id").alias("driver_id"))
    )
    own = laps.select("session_id", "lap_number", "driver_id", F.col("lap_start_time_ms").alias("start_time_ms"))
    return leaders.join(own, ["session_id", "lap_number", "driver_id"]).where(
        F.col("start_time_ms").isNotNull() & (F.col("end_time_ms") >= F.col("start_time_ms"))
    )
