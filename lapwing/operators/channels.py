"""Channel quality profiles and dead-sensor evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions.channels import channel_valid

MOVING = ("speed", "rpm", "throttle", "gear")


def channel_quality(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Samples, present, missing, invalid and status per key and channel.

    All channels are counted in one wide aggregation; only its result is
    turned into rows.
    """
    aggs = [F.count(F.lit(1)).alias("samples")]
    for c in channels:
        raw = F.col(c)
        number = raw.cast("string").try_cast("double") if dict(df.dtypes)[c] == "string" else raw.cast("double")
        finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
        unreadable = raw.isNotNull() & number.isNull()
        aggs += [
            F.count(F.when(finite, 1)).alias(f"p_{c}"),
            F.count(F.when(unreadable, 1)).alias(f"u_{c}"),
            F.count(F.when(finite & ~channel_valid(F.lit(c), number), 1)).alias(f"v_{c}"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = wide.select(
        *keys, "samples",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("channel"), F.col(f"p_{c}").alias("present"),
                        F.col(f"u_{c}").alias("unreadable"), F.col(f"v_{c}").alias("implausible"),
                    )
                    for c in channels
                ]
            )
        ).alias("x"),
    )
    invalid = F.col("x.unreadable") + F.col("x.implausible")
    missing = F.col("samples") - F.col("x.present") - F.col("x.unreadable")
    status = (
        F.when(invalid > 0, "degraded")
        .when(F.col("x.present") == 0, "unavailable")
        .when(missing > 0, "partial")
        .otherwise("verified")
    )
    return rows.select(
        *keys, F.col("x.channel").alias("channel"), "samples", F.col("x.present").alias("present"),
        missing.alias("missing"), invalid.alias("invalid"), status.alias("status"),
    )


def dead_sensors(car: DataFrame, laps: DataFrame) -> DataFrame:
    """Drivers whose moving channels are all zero although clean laps exist."""
    zero = F.lit(True)
    for c in MOVING:
        zero = zero & F.coalesce(F.col(c) == 0, F.lit(False))
    sensors = (
        car.groupBy("session_id", "driver_id")
        .agg(F.count(F.lit(1)).alias("native_rows"), F.bool_and(zero).alias("all_zero"))
    )
    clean = (
        F.col("is_accurate") & (F.col("lap_time") > 0)
        & F.col("pit_in_time").isNull() & F.col("pit_out_time").isNull()
    )
    counts = laps.where(clean).groupBy("session_id", "driver_id").agg(
        F.count(F.lit(1)).alias("clean_timed_laps")
    )
    return (
        sensors.join(counts, ["session_id", "driver_id"], "left")
        .withColumn("clean_timed_laps", F.coalesce("clean_timed_laps", F.lit(0)))
        .withColumn(
            "state",
            F.when(F.col("all_zero") & (F.col("clean_timed_laps") > 0), "degraded").otherwise("available"),
        )
    )


def availability_rollup(states: DataFrame) -> DataFrame:
    """Session verdict from the per-driver channel states."""
    return states.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("partitions"),
        F.count(F.when(F.col("state") == "degraded", 1)).alias("degraded"),
        F.bool_and(F.col("state") == "available").alias("__ok"),
    ).select(
        "session_id", "partitions", "degraded",
        F.when(F.col("degraded") == 0, "available")
        .when(F.col("degraded") == F.col("partitions"), "telemetry-unsupported")
        .otherwise("partially-available").alias("car_data_state"),
        F.when(F.col("__ok"), "complete").otherwise("partial").alias("quality"),
    )


def degraded_drivers(states: DataFrame) -> DataFrame:
    """The drivers behind a session's verdict, a row each."""
    return states.where(F.col("state") == "degraded").select("session_id", "driver_id").distinct()


def unusable_laps(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Laps whose moving channels are all exactly zero (two samples or more)."""
    zero = F.lit(True)
    for c in MOVING:
        zero = zero & F.coalesce(F.col(c) == 0, F.lit(False))
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        (F.bool_and(zero) & (F.count(F.lit(1)) >= 2)).alias("all_zero_source"),
    )
