"""Provider rows to canonical tables.

Each function takes raw rows of any number of sessions, keeps one row per
canonical key (the smallest JSON of conflicting copies) and cleans every column
with built-in expressions.  ``copies``/``conflicting`` stay for the warnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.values import (
    as_float,
    as_int,
    as_text,
    instant_to_session_ms,
    number_to_session_ms,
    record_id,
)
from lapwing.functions.vocab import TRACK_STATUSES, TYRE_COMPOUNDS, driver_status, parse_enum
from lapwing.operators.digest import dedupe


def _keyed(raw: DataFrame, **keys: Column) -> DataFrame:
    """One raw row per canonical key."""
    named = raw.withColumns({f"__{n}": c for n, c in keys.items()})
    kept = dedupe(named, ["session_id", *[f"__{n}" for n in keys]])
    return kept


def _ms(c: str) -> Column:
    return number_to_session_ms(F.col(c).cast("string"))


def normalize_drivers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roster, classification); a classification needs one of its four fields."""
    rows = _keyed(raw.where(as_int(F.col("driver_number")).isNotNull()), number=as_int(F.col("driver_number")))
    roster = rows.select(
        "session_id", F.col("__number").alias("driver_id"),
        as_text(F.col("abbreviation")).alias("abbreviation"),
        as_text(F.col("full_name")).alias("full_name"),
        as_text(F.col("team_name")).alias("team_name"), "conflicting",
    )
    code, status = as_text(F.col("classified_position")), as_text(F.col("status"))
    place, points = as_int(F.col("position")), as_float(F.col("points"))
    present = code.isNotNull() | status.isNotNull() | place.isNotNull() | points.isNotNull()
    classified = rows.where(present).select(
        "session_id", F.col("__number").alias("driver_id"),
        F.coalesce(as_int(code), place).alias("classified_position"),
        driver_status(code, status).alias("status"),
        points.alias("points"), status.alias("raw_status"),
    )
    return roster, classified


def normalize_laps(raw: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Canonical laps; a start is relative, else an instant minus the origin.

    ``sessions`` is (session_id, origin); an instant without an origin leaves
    the start NULL and sets ``unplaced_start``.
    """
    rows = _keyed(raw, driver=as_int(F.col("driver_number")), lap=as_int(F.col("lap_number"))).where(
        F.col("__driver").isNotNull() & F.col("__lap").isNotNull()
    )
    if sessions is None:
        rows = rows.withColumn("origin", F.lit(None).cast("timestamp"))
    else:
        rows = rows.join(sessions.select("session_id", "origin"), "session_id", "left")
    relative = _ms("lap_start_time")
    instant = instant_to_session_ms(F.col("lap_start_date").try_cast("timestamp"), F.col("origin"))
    raw_compound = as_text(F.col("compound"))
    return rows.select(
        "session_id", F.col("__driver").alias("driver_id"), F.col("__lap").cast("int").alias("lap_number"),
        F.coalesce(relative, instant).alias("lap_start_time_ms"),
        _ms("time").alias("lap_end_time_ms"),
        _ms("lap_time").alias("lap_time_ms"),
        as_int(F.col("stint")).cast("int").alias("stint_number"),
        parse_enum(raw_compound, TYRE_COMPOUNDS).alias("compound"),
        raw_compound.alias("raw_compound"),
        as_float(F.col("tyre_life")).alias("tyre_life_laps"),
        F.col("is_accurate"), F.col("deleted").alias("is_deleted"),
        as_text(F.col("deleted_reason")).alias("deleted_reason"),
        as_text(F.col("track_status")).alias("raw_track_status"),
        (relative.isNull() & F.col("lap_start_date").isNotNull() & F.col("origin").isNull()).alias("unplaced_start"),
        "conflicting",
    )


def normalize_weather(raw: DataFrame) -> DataFrame:
    """One observation per session time."""
    rows = _keyed(raw, t=_ms("time")).where(F.col("__t").isNotNull())
    return rows.select(
        "session_id", F.col("__t").alias("session_time_ms"),
        *[
            as_float(F.col(c)).alias(out)
            for c, out in (
                ("air_temp", "air_temperature_c"), ("track_temp", "track_temperature_c"),
                ("humidity", "humidity_percent"),
            )
        ],
        F.col("rainfall"), "conflicting",
    )


def normalize_control(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """Race control from its three feeds; rows that cannot be placed are flagged.

    ``issue`` is ``unplaced-time`` or ``missing-message`` for rows the canonical
    table leaves out and NULL for the rest.
    """
    joined = raw.join(sessions.select("session_id", "origin"), "session_id", "left")
    instant = instant_to_session_ms(F.col("utc_time").try_cast("timestamp"), F.col("origin"))
    placed = joined.withColumn("__t", F.coalesce(_ms("session_time"), instant)).drop("origin")
    text = {c: as_text(F.col(c)) for c in ("source_kind", "message", "status", "flag", "category")}
    rows = _keyed(
        placed.where(F.col("__t").isNotNull()),
        kind=text["source_kind"], message=text["message"], state=text["status"], flag=text["flag"],
        category=text["category"], at=F.col("__t"),
    )
    message = F.coalesce(F.col("__message"), F.col("__state"), F.col("__flag"))
    status = (
        F.when(F.col("__kind") == "track_status", parse_enum(F.col("__state"), TRACK_STATUSES))
        .when(F.col("__kind") == "race_control_message", parse_enum(F.col("__flag"), TRACK_STATUSES))
        .otherwise("unknown")
    )
    kept = rows.select(
        "session_id", F.col("__at").alias("session_time_ms"), F.col("__kind").alias("source_kind"),
        message.alias("message"), status.alias("track_status"),
        F.coalesce("__state", "__flag").alias("raw_status"), F.col("__category").alias("category"),
        F.when(message.isNull(), "missing-message").alias("issue"),
    )
    lost = placed.where(F.col("__t").isNull()).select(
        "session_id", F.lit(None).cast("long").alias("session_time_ms"), text["source_kind"].alias("source_kind"),
        text["message"].alias("message"), F.lit("unknown").alias("track_status"),
        F.lit(None).cast("string").alias("raw_status"), text["category"].alias("category"),
        F.lit("unplaced-time").alias("issue"),
    )
    return kept.unionByName(lost)


def normalize_positions(raw: DataFrame) -> DataFrame:
    """Race positions, one per (driver, time, lap)."""
    rows = _keyed(
        raw, driver=as_int(F.col("driver_number")), t=_ms("time"), lap=as_int(F.col("lap_number"))
    )
    place = as_int(F.col("position"))
    return rows.where(F.col("__driver").isNotNull() & F.col("__t").isNotNull() & place.isNotNull()).select(
        "session_id", F.col("__driver").alias("driver_id"), F.col("__t").alias("session_time_ms"),
        place.cast("int").alias("position"), F.col("__lap").cast("int").alias("lap_number"), "conflicting",
    )


def observed_only(raw: DataFrame) -> DataFrame:
    """Samples whose source is ``observed``."""
    return raw.where(F.lower(F.trim("source")) == "observed")


def rejected_sources(raw: DataFrame) -> DataFrame:
    """How many samples each other source contributed."""
    source = F.coalesce(F.lower(F.trim("source")), F.lit("<missing>"))
    return raw.where(source != "observed").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("samples"))


def normalize_track(raw: DataFrame, scale: float | None) -> DataFrame:
    """Observed, complete samples in metres, one per (driver, time).

    The smallest (x, y, z, status) of equal keys stays.  Copies collapse in a
    map-side minimum, so dense feeds need no sort.  Without a verified scale
    there are no rows.
    """
    good = observed_only(raw)
    if scale is None or scale <= 0:
        good = good.where(F.lit(False))
        scale = 1.0
    t = F.col("session_time").cast("long")
    factor = F.lit(float(scale))
    rows = good.select(
        "session_id", F.col("driver_number").try_cast("long").alias("driver_id"), t.alias("session_time_ms"),
        F.struct(
            (F.col("x").cast("double") * factor).alias("x_m"),
            (F.col("y").cast("double") * factor).alias("y_m"),
            # NULLs sort after values in the source's order.
            F.col("z").isNull().alias("z_missing"),
            (F.col("z").cast("double") * factor).alias("z_m"),
            F.col("status").isNull().alias("status_missing"),
            F.col("status").alias("raw_status"),
        ).alias("p"),
    ).where(
        F.col("driver_id").isNotNull() & (F.col("session_time_ms") >= 0)
        & F.col("p.x_m").isNotNull() & F.col("p.y_m").isNotNull()
    )
    merged = rows.groupBy("session_id", "driver_id", "session_time_ms").agg(
        F.min("p").alias("q"), F.count(F.lit(1)).alias("copies"), (F.min("p") != F.max("p")).alias("conflicting")
    )
    return merged.select(
        "session_id", "driver_id", "session_time_ms", "q.x_m", "q.y_m", "q.z_m", "q.raw_status",
        "copies", "conflicting",
    )


def normalize_index(raw: DataFrame) -> DataFrame:
    """Telemetry ranges with sorted distinct channel names."""
    names = F.array_sort(
        F.array_distinct(F.filter(F.transform("channel_names", as_text), lambda x: x.isNotNull()))
    )
    rows = _keyed(
        raw, driver=as_int(F.col("driver_number")), key=as_text(F.col("data_key")),
    )
    return rows.select(
        "session_id", F.col("__driver").alias("driver_id"), F.col("__key").alias("data_key"),
        _ms("start_time").alias("start_time_ms"), _ms("end_time").alias("end_time_ms"),
        F.coalesce(names, F.array().cast("array<string>")).alias("channel_names"),
        as_int(F.col("sample_count")).alias("sample_count"),
    )


def session_quality(availability: DataFrame) -> DataFrame:
    """complete, partial or degraded from each session's dataset states."""
    lacking = F.col("availability").isin("empty", "not-requested", "unsupported")
    return availability.groupBy("session_id").agg(
        F.when(F.bool_or(F.col("availability") == "error"), "degraded")
        .when(F.bool_or(lacking), "partial")
        .otherwise("complete")
        .alias("data_quality")
    )


def with_record_id(df: DataFrame, source: str, columns) -> DataFrame:
    """Stable provenance id of each row."""
    return df.withColumn("source_record_id", F.concat(F.lit("record-"), record_id(F.lit(source), columns)))
