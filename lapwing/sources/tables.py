"""Canonical table reads, writes and per-driver unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Provider column -> canonical column.
NATIVE_NAMES = {
    "SessionTime": "session_time",
    "Date": "timestamp",
    "Time": "provider_time",
    "Speed": "speed",
    "RPM": "rpm",
    "nGear": "gear",
    "Throttle": "throttle",
    "Brake": "brake",
    "DRS": "drs",
    "Source": "provider_source",
    "X": "x",
    "Y": "y",
    "Z": "z",
    "Status": "status",
    "DriverNumber": "driver_number",
    "Driver": "driver_abbreviation",
    "DriverId": "driver_id",
    "LapNumber": "lap_number",
    "LapTime": "lap_time",
    "LapStartTime": "lap_start_time",
    "LapStartDate": "lap_start_timestamp",
    "Sector1Time": "sector_1_time",
    "Sector2Time": "sector_2_time",
    "Sector3Time": "sector_3_time",
    "Sector1SessionTime": "sector_1_session_time",
    "Sector2SessionTime": "sector_2_session_time",
    "Sector3SessionTime": "sector_3_session_time",
    "SpeedI1": "speed_i1",
    "SpeedI2": "speed_i2",
    "SpeedFL": "speed_fl",
    "SpeedST": "speed_st",
    "Stint": "stint",
    "Compound": "compound",
    "TyreLife": "tyre_life",
    "FreshTyre": "fresh_tyre",
    "PitInTime": "pit_in_time",
    "PitOutTime": "pit_out_time",
    "TrackStatus": "track_status",
    "Position": "position",
    "Deleted": "deleted",
    "DeletedReason": "deleted_reason",
    "IsAccurate": "is_accurate",
    "FastF1Generated": "provider_generated",
    "AirTemp": "air_temperature",
    "TrackTemp": "track_temperature",
    "Humidity": "humidity",
    "Pressure": "pressure",
    "WindSpeed": "wind_speed",
    "WindDirection": "wind_direction",
    "Rainfall": "rainfall",
    "Category": "category",
    "Message": "message",
    "Flag": "flag",
    "Scope": "scope",
    "RacingNumber": "racing_number",
    "Lap": "lap",
    "Sector": "sector",
    "Distance": "distance",
    "RelativeDistance": "relative_distance",
}
# Documented car channels in reporting order.
CAR_CHANNELS = ("Speed", "RPM", "nGear", "Throttle", "Brake", "DRS")


def read_table(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A canonical table with a pinned schema; an absent one is empty."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_range(df: DataFrame, low: float, high: float, columns: Sequence[str], time: str = "session_time_ms") -> DataFrame:
    """Columns of the rows whose time lies in the span; both reach the scan."""
    return df.where(F.col(time).between(low, high)).select(*columns)


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Zstd Parquet with statistics, optionally partitioned."""
    writer = df.write.mode(mode).option("compression", "zstd")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)


def rename_native(df: DataFrame) -> DataFrame:
    """Provider names to canonical ones; two columns of one name are an error."""
    names = [NATIVE_NAMES.get(c, c) for c in df.columns]
    if len(set(names)) != len(names) or "quality_flags" in names:
        raise ValueError("renamed columns collide")
    return df.withColumnsRenamed({c: n for c, n in zip(df.columns, names) if c != n})


def union_drivers(frames: dict[str, DataFrame], column: str = "driver_number") -> DataFrame:
    """Per-driver frames as one, with the driver as a column."""
    out = None
    for driver in sorted(frames):
        part = frames[driver].withColumn(column, F.lit(driver))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no driver frames")
    return out


def union_control(track: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Track status, race control and session status as one feed."""
    out = None
    for kind, part in (("track_status", track), ("race_control_message", messages), ("session_status", sessions)):
        tagged = part.withColumn("source_kind", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def telemetry_index(car: DataFrame, keys: Sequence[str] = ("session_id", "driver_number")) -> DataFrame:
    """Time range, sample count and channels per driver; untimed rows are counted out."""
    times = [F.col(c) for c in ("SessionTime", "Time") if c in car.columns]
    if not times:
        raise ValueError("no time channel")
    time = F.coalesce(*times)
    names = [c for c in CAR_CHANNELS if c in car.columns]
    return car.groupBy(*keys).agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time"),
        F.count(time).alias("sample_count"), (F.count(F.lit(1)) - F.count(time)).alias("discarded"),
    ).where(F.col("sample_count") > 0).withColumn("channel_names", F.array(*[F.lit(c) for c in names]))
