"""Nested JSON and text feeds to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.values import as_int, as_text, parse_duration_ms
from lapwing.functions.vocab import session_type
from lapwing.operators.inventory import KNOWN_STATUSES
from lapwing.operators.scan import latest, previous, scan, series
from lapwing.session import durable

RESULTS_SCHEMA = (
    "Results array<struct<Driver:struct<driverId:string,code:string,givenName:string,familyName:string>,"
    "Constructor:struct<constructorId:string,name:string>,number:string,grid:string,position:string,"
    "positionText:string,points:string,laps:string,status:string,Time:struct<millis:string>>>"
)
LAPS_SCHEMA = "Laps array<struct<number:string,Timings:array<struct<driverId:string,position:string,time:string>>>>"
PITS_SCHEMA = "PitStops array<struct<driverId:string,stop:string,lap:string,duration:string,time:string>>"


def flatten_results(pages: DataFrame) -> DataFrame:
    """(session_id, payload) race results to one row per driver."""
    c = F.col
    name = F.trim(
        F.concat_ws(" ", F.coalesce("r.Driver.givenName", F.lit("")), F.coalesce("r.Driver.familyName", F.lit("")))
    )
    return pages.select("session_id", F.explode(F.from_json("payload", RESULTS_SCHEMA)["Results"]).alias("r")).select(
        "session_id", c("r.Driver.driverId").alias("driver_id"), as_text(c("r.Driver.code")).alias("driver_code"),
        name.alias("driver_name"), as_text(c("r.Constructor.constructorId")).alias("team_id"),
        as_text(c("r.Constructor.name")).alias("team_name"), as_int(c("r.number")).cast("int").alias("car_number"),
        as_int(c("r.grid")).cast("int").alias("grid_position"), as_int(c("r.position")).cast("int").alias("finish_position"),
        F.coalesce(c("r.points").try_cast("double"), F.lit(0.0)).alias("points"),
        as_int(c("r.laps")).cast("int").alias("laps_completed"), as_text(c("r.status")).alias("status"),
        F.coalesce(c("r.positionText").rlike("^[0-9]+$"), F.lit(False)).alias("classified"),
        as_int(c("r.Time.millis")).alias("total_time_ms"),
    )


def _last_page(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of repeated keys the row of the last page."""
    values = [c for c in rows.columns if c not in (*keys, "page", "place")]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct("page", "place")).alias("v")
    ).select(*keys, "v.*")


def flatten_laps(pages: DataFrame) -> DataFrame:
    """(session_id, page, payload) lap pages to one row per lap and driver."""
    laps = pages.select("session_id", "page", F.posexplode(F.from_json("payload", LAPS_SCHEMA)["Laps"]).alias("i", "l"))
    timings = laps.select("session_id", "page", "i", "l.number", F.posexplode("l.Timings").alias("j", "t"))
    rows = timings.select(
        "session_id", F.col("t.driverId").alias("driver_id"), as_int(F.col("number")).cast("int").alias("lap_number"),
        "page", F.struct("i", "j").alias("place"), as_int(F.col("t.position")).cast("int").alias("position"),
        parse_duration_ms(F.col("t.time")).alias("lap_time_ms"),
    )
    return _last_page(rows, ["session_id", "driver_id", "lap_number"])


def flatten_pits(pages: DataFrame) -> DataFrame:
    """(session_id, page, payload) stop pages to one row per driver and stop."""
    rows = pages.select("session_id", "page", F.posexplode(F.from_json("payload", PITS_SCHEMA)["PitStops"]).alias("place", "p")).select(
        "session_id", F.col("p.driverId").alias("driver_id"), as_int(F.col("p.stop")).cast("int").alias("stop_number"),
        "page", "place", as_int(F.col("p.lap")).cast("int").alias("lap_number"),
        parse_duration_ms(F.col("p.duration")).alias("duration_ms"), as_text(F.col("p.time")).alias("local_time"),
    )
    return _last_page(rows, ["session_id", "driver_id", "stop_number"])


SCHEDULE_FIELDS = ("round_number", "country", "location", "event_name", "gmt_offset")
SLOTS = (1, 2, 3, 4, 5)


def flatten_schedule(years: DataFrame, ident: str = "season") -> DataFrame:
    """Columnar schedule JSON (column -> row key -> value) to one row per event.

    Local session times become UTC through the event's ``±HH:MM`` offset.
    """
    fields = [*SCHEDULE_FIELDS, *[f"session{n}" for n in SLOTS], *[f"session{n}_date" for n in SLOTS]]
    schema = "struct<" + ",".join(f"{f}:map<string,string>" for f in fields) + ">"
    parsed = years.select(ident, F.from_json("payload", schema).alias("s"))
    keyed = parsed.select(ident, "s", F.explode(F.map_keys("s.round_number")).alias("row_key"))
    rows = keyed.select(ident, "row_key", *[F.element_at(F.col(f"s.{f}"), F.col("row_key")).alias(f) for f in fields])
    sign = F.when(F.substring("gmt_offset", 1, 1) == "-", -1).otherwise(1)
    seconds = sign * (
        F.substring("gmt_offset", 2, 2).cast("int") * 3600 + F.substring("gmt_offset", 5, 2).cast("int") * 60
    )
    shift = F.coalesce(seconds, F.lit(0))
    out = rows.withColumn("round_number", as_int(F.col("round_number")).cast("int"))
    for n in SLOTS:
        local = F.col(f"session{n}_date").try_cast("timestamp")
        out = out.withColumn(f"session{n}_utc", F.timestamp_seconds(F.unix_timestamp(local) - shift))
    return out


def unpivot_sessions(schedule: DataFrame, now: Column, season: str = "season") -> DataFrame:
    """One row per non-blank session slot; round 0 (testing) is left out."""
    slots = F.array(
        *[
            F.struct(F.lit(n).alias("slot"), F.col(f"session{n}").alias("label"), F.col(f"session{n}_utc").alias("scheduled_at"))
            for n in SLOTS
        ]
    )
    rows = schedule.where(F.col("round_number") != 0).withColumn("x", F.explode(slots)).select(
        F.col(season).alias("season"), "round_number", F.col("event_name"), F.col("location").alias("circuit_name"),
        "x.slot", F.trim("x.label").alias("label"), "x.scheduled_at",
        *[c for c in schedule.columns if c == "source_id"],
    ).where(F.coalesce(F.col("label"), F.lit("")) != "")
    kind = session_type(F.col("season"), F.col("label"))
    event = F.format_string("%d-%02d", F.col("season"), F.col("round_number"))
    return rows.withColumn("session_type", kind).withColumn("event_id", event).withColumn(
        "session_id",
        F.concat_ws("-", event, F.when(F.col("session_type") != "unknown", F.col("session_type")).otherwise(
            F.concat(F.lit("slot-"), F.col("slot").cast("string"))
        )),
    ).withColumn(
        "completion",
        F.when(F.col("scheduled_at").isNull(), "unknown").when(F.col("scheduled_at") >= now, "future").otherwise("past-unverified"),
    )


def split_lines(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Numbered lines of whole texts; one trailing separator is not a line."""
    text = F.regexp_replace(F.regexp_replace(F.col(body), "^﻿", ""), "\n\\z", "")
    lines = F.when(F.col(body) != "", F.split(text, "\n", -1))
    keep = [c for c in bodies.columns if c != body]
    return bodies.select(*keep, F.posexplode(lines).alias("i", "line")).select(
        *keep, (F.col("i") + 1).cast("long").alias("number"), F.regexp_replace("line", "\r\\z", "").alias("line")
    )


def parse_status_lines(lines: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Status lines (12-character clock, then JSON) with their issues and notes.

    ``lines``: session_id, number, line.  Every line stays; nothing is repaired.
    """
    c = F.col
    pattern = "^(\\d{2}):(\\d{2}):(\\d{2})\\.(\\d{3})"
    part = [F.regexp_extract("line", pattern, i).try_cast("int") for i in (1, 2, 3, 4)]
    valid = c("line").rlike(pattern) & (part[0] < 24) & (part[1] < 60) & (part[2] < 60)
    millis = F.when(valid, (((part[0] * 60 + part[1]) * 60 + part[2]) * 1000 + part[3]).cast("long"))
    value = F.try_parse_json(F.substring("line", 13, 2**30))
    status = F.try_variant_get(value, "$.Status", "string")
    # Only an object with a text Status counts.
    is_text = F.schema_of_variant(F.try_variant_get(value, "$.Status", "variant")) == "STRING"
    rows = lines.withColumns({"millis": millis, "__v": value}).withColumn("__ok", F.coalesce(is_text, F.lit(False)))
    rows = rows.withColumn("status", F.when(c("__ok"), status)).withColumn(
        "value_json", F.when(c("__ok"), F.to_json("__v"))
    ).drop("__v")
    # A scan reads its input three times: what was parsed is stored, as is what the second scan and the rest both read.
    chain = scan(
        durable(rows), series(("session_id",), ("number",), chunk_rows),
        __before=latest(c("millis"), inclusive=False),
    )
    chain = durable(chain)
    timed = chain.where(c("millis").isNotNull())
    same = scan(
        timed, series(("session_id", "millis"), ("number",), chunk_rows),
        __same=previous(F.struct("value_json")),
    )
    both = same.unionByName(chain.where(c("millis").isNull()), allowMissingColumns=True)
    clash = c("__same").isNotNull() & ~c("__same.value_json").eqNullSafe(c("value_json"))
    closing = (c("__same.value_json") == '{"Status":"Finalised"}') & (c("value_json") == '{"Status":"Ends"}')
    closing = F.coalesce(closing, F.lit(False))
    issues = F.array_compact(
        F.array(
            F.when(c("millis").isNull(), "invalid-timestamp"),
            F.when(c("__ok") & ~c("status").isin(*KNOWN_STATUSES), "unknown-status"),
            F.when(~c("__ok"), "malformed-record"),
            F.when(c("millis") < c("__before"), "nonmonotonic"),
            F.when(clash & ~closing, "timestamp-conflict"),
        )
    )
    return both.select(
        *lines.columns, "millis", "status", issues.alias("issues"),
        F.when(clash & closing, "coincident-terminal-progression").alias("note"),
    )
