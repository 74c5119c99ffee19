"""Telemetry channel rules: plausibility ranges, quality bits, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bit of each channel in ``quality_flags``.
QUALITY_BITS = {
    "speed": 1,
    "rpm": 2,
    "gear": 4,
    "throttle": 8,
    "brake": 16,
    "drs": 32,
    "position": 64,
    "time": 128,
}
# Plausible ranges for the quality bits.
FLAG_RANGES = {"speed": (0, 450), "rpm": (0, 22000), "gear": (0, 8), "throttle": (0, 100)}
DRS_CODES = (0, 1, 2, 3, 8, 10, 12, 14)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))


def flag_columns(df: DataFrame, position: bool = False) -> Column:
    """One bit per violated channel of a sample; missing counts as violated."""
    types = dict(df.dtypes)
    bits = []

    def bit(bad: Column, name: str) -> None:
        bits.append(F.when(bad, QUALITY_BITS[name]).otherwise(0))

    for name, (low, high) in FLAG_RANGES.items():
        if name in types:
            c = F.col(name).cast("double")
            bad = ~_finite(c) | (c < low) | (c > high)
            if name == "gear":
                bad = bad | (c != F.floor(c))
            bit(bad, name)
    if "drs" in types:
        bit(~F.coalesce(F.col("drs").cast("double").isin(*DRS_CODES), F.lit(False)), "drs")
    if "brake" in types:
        bad = F.col("brake").isNull() if types["brake"] == "boolean" else F.lit(True)
        bit(bad, "brake")
    if "session_time_ms" in types:
        t = F.col("session_time_ms").cast("double")
        bit(~_finite(t) | (t < 0), "time")
    if position:
        axes = [~_finite(F.col(a)) for a in ("x", "y", "z") if a in types]
        bad = axes[0]
        for extra in axes[1:]:
            bad = bad | extra
        bit(bad, "position")
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("int")


def channel_valid(channel: Column, value: Column) -> Column:
    """Whether a finite value is plausible for the named channel."""
    whole = value == F.floor(value)
    return (
        F.when(channel == "gear", whole & value.between(0, 8))
        .when(channel == "brake", value.isin(0.0, 1.0))
        .when(channel == "throttle", value.between(0, 100))
        .when(channel == "speed", value.between(0, 450))
        .when(channel == "rpm", value.between(0, 25000))
        .when(channel == "drs", value.isin(*[float(c) for c in DRS_CODES]))
        .when(channel == "distance", value >= 0)
        .when(channel == "relative_distance", value.between(0, 1))
        .otherwise(True)
    )


def masked(df: DataFrame, channels: dict[str, str]) -> DataFrame:
    """Blank out channels whose quality bit is set; keep a validity column each."""
    out = df
    for column, bit in channels.items():
        ok = F.col("quality_flags").bitwiseAND(F.lit(QUALITY_BITS[bit])) == 0
        out = out.withColumn(f"{column}_valid", ok & F.col(column).isNotNull())
        out = out.withColumn(column, F.when(ok, F.col(column)))
    return out
