"""Relational race dump: eleven linked tables to three archive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.values import as_bool_text, as_int, as_text, parse_duration_ms

# File names of the dump.
FILES = {
    "season": "formula_one_season.csv",
    "round": "formula_one_round.csv",
    "circuit": "formula_one_circuit.csv",
    "session": "formula_one_session.csv",
    "driver": "formula_one_driver.csv",
    "team": "formula_one_team.csv",
    "team_driver": "formula_one_teamdriver.csv",
    "round_entry": "formula_one_roundentry.csv",
    "session_entry": "formula_one_sessionentry.csv",
    "lap": "formula_one_lap.csv",
    "pit_stop": "formula_one_pitstop.csv",
}


def read_dump(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The dump's CSV files as text columns."""
    return {
        name: spark.read.csv(f"{folder}/{file}", header=True, inferSchema=False) for name, file in FILES.items()
    }


def race_sessions(t: dict[str, DataFrame], start: int, end: int) -> DataFrame:
    """Race sessions in the season span with their event and circuit."""
    c = F.col
    rounds = t["round"].select(
        c("id").alias("round_id"), c("season_id"), c("circuit_id"), as_int(c("number")).cast("int").alias("round_number"),
        c("name").alias("event_name"), c("date").cast("string").alias("event_date"),
    ).where(c("round_number").isNotNull())
    seasons = t["season"].select(c("id").alias("season_id"), as_int(c("year")).cast("int").alias("season")).where(
        c("season").between(start, end)
    )
    circuits = t["circuit"].select(c("id").alias("circuit_id"), c("name").alias("circuit_name"), c("reference").alias("circuit_reference"))
    return (
        t["session"].where(c("type") == "R").select(c("id").alias("race_pk"), "round_id")
        .join(rounds, "round_id").join(seasons, "season_id").join(circuits, "circuit_id", "left")
        .withColumn(
            "session_id",
            F.format_string("archive-%d-round-%02d-race", c("season"), c("round_number")),
        )
        .drop("round_id", "season_id", "circuit_id")
    )


def archive_tables(t: dict[str, DataFrame], start: int, end: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, results, laps, pit stops).

    Entries, laps and stops are the large sides; they are joined on keys and
    Spark broadcasts a dimension only below its size threshold.
    """
    c = F.col
    events = race_sessions(t, start, end)
    links = (
        t["team_driver"].select(c("id").alias("team_driver_id"), "driver_id", "team_id")
        .join(
            t["driver"].select(
                c("id").alias("driver_id"), c("reference").alias("driver_ref"), c("abbreviation").alias("driver_code"),
                "forename", "surname",
            ), "driver_id",
        )
        .join(t["team"].select(c("id").alias("team_id"), c("reference").alias("team_ref"), c("name").alias("team_name")), "team_id")
        .drop("driver_id", "team_id")
    )
    entries = (
        t["session_entry"].withColumnRenamed("id", "entry_pk").withColumnRenamed("session_id", "race_pk")
        .join(events.select("race_pk", "session_id"), "race_pk")
        .join(t["round_entry"].select(c("id").alias("round_entry_id"), "team_driver_id", "car_number"), "round_entry_id")
        .join(links, "team_driver_id")
    )
    name = F.trim(F.concat_ws(" ", F.trim(F.coalesce("forename", F.lit(""))), F.trim(F.coalesce("surname", F.lit("")))))
    results = entries.select(
        "session_id", c("driver_ref").alias("driver_id"), "driver_code", name.alias("driver_name"),
        c("team_ref").alias("team_id"), "team_name",
        as_int(c("car_number")).cast("int").alias("car_number"),
        as_int(c("grid")).cast("int").alias("grid_position"),
        as_int(c("position")).cast("int").alias("finish_position"),
        c("points").try_cast("double").alias("points"),
        as_int(c("laps_completed")).cast("int").alias("laps_completed"),
        F.coalesce(c("detail"), c("status")).alias("status"),
        as_bool_text(c("is_classified")).alias("classified"),
        parse_duration_ms(c("time")).alias("total_time_ms"),
    )
    lookup = entries.select(c("entry_pk").alias("session_entry_id"), "session_id", c("driver_ref").alias("driver_id"))
    laps = t["lap"].join(lookup, "session_entry_id").select(
        "session_id", "driver_id", as_int(c("number")).cast("int").alias("lap_number"),
        as_int(c("position")).cast("int").alias("position"),
        parse_duration_ms(c("time")).alias("lap_time_ms"),
        c("average_speed").try_cast("double").alias("average_speed_kph"),
        as_bool_text(c("is_entry_fastest_lap")).alias("is_fastest_lap"),
    )
    numbers = t["lap"].select(c("id").alias("lap_id"), as_int(c("number")).cast("int").alias("lap_number"))
    stops = t["pit_stop"].join(lookup, "session_entry_id").join(numbers, "lap_id", "left").select(
        "session_id", "driver_id", as_int(c("number")).cast("int").alias("stop_number"), "lap_number",
        parse_duration_ms(c("duration")).alias("duration_ms"), as_text(c("local_timestamp")).alias("local_time"),
    )
    return events, results, laps, stops


def load_dump(spark: SparkSession, folder: str, start: int = 2000, end: int = 2026):
    return archive_tables(read_dump(spark, folder), start, end)
