"""Column-level cleaning: text, numbers, clocks, intervals, identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(c: Column) -> Column:
    """Trimmed text, empty becomes NULL."""
    trimmed = F.regexp_replace(c.cast("string"), "^\\s+|\\s+$", "")
    return F.when(trimmed != "", trimmed)


def as_int(c: Column) -> Column:
    """Integral values only; anything else is NULL (see ``is_bad_int``)."""
    number = F.regexp_replace(c.cast("string"), "^\\s+|\\s+$", "").try_cast("decimal(38,9)")
    return F.when(number == F.floor(number), number.cast("long"))


def is_bad_int(c: Column) -> Column:
    """True when a value is present but is not integral."""
    return c.isNotNull() & as_int(c).isNull()


def as_float(c: Column) -> Column:
    """Finite doubles, NaN and infinities become NULL."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def as_bool_text(c: Column) -> Column:
    """``t/true/1/yes`` is true, other text is false, blank is NULL."""
    text = as_text(c)
    return F.when(text.isNotNull(), F.lower(text).isin("t", "true", "1", "yes"))


def micros_to_session_ms(us: Column) -> Column:
    """Half-up milliseconds from microseconds; negatives are rejected."""
    return F.when(us >= 0, F.floor((us + 500) / F.lit(1000)).cast("long"))


def instant_to_session_ms(ts: Column, origin: Column) -> Column:
    return micros_to_session_ms(F.unix_micros(ts) - F.unix_micros(origin))


def number_to_session_ms(c: Column) -> Column:
    """Half-up milliseconds from a decimal count of milliseconds."""
    value = F.round(c.try_cast("decimal(38,6)"), 0).cast("long")
    return F.when(value >= 0, value)


def parse_duration_ms(c: Column) -> Column:
    """``[h:]m:ss.fff`` or plain ``ss.fff`` to milliseconds, otherwise NULL."""
    text = as_text(c)
    pattern = "^(?:(\\d+):)?(?:(\\d+):)?(\\d+(?:\\.\\d+)?)$"
    first = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("long")
    second = F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).cast("long")
    seconds = F.nullif(F.regexp_extract(text, pattern, 3), F.lit("")).cast("decimal(18,6)")
    hours = F.when(second.isNotNull(), first)
    minutes = F.coalesce(second, first)
    whole = (F.coalesce(hours, F.lit(0)) * 3600 + F.coalesce(minutes, F.lit(0)) * 60) * 1000
    return (whole + F.bround(seconds * 1000, 0)).cast("long")


def parse_interval(c: Column) -> Column:
    """Gap text as ``struct<kind, seconds, laps_down>``."""
    text = F.trim(c)
    laps = F.regexp_extract(text, "(?i)^\\+?(\\d+)\\s+LAPS?$", 1)
    number = text.try_cast("double")
    is_laps = laps != ""
    is_seconds = number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf"))
    kind = (
        F.when(c.isNull(), "unavailable")
        .when(is_laps, "laps-down")
        .when(is_seconds, "seconds")
        .otherwise("unknown")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(~is_laps & is_seconds, number).alias("seconds"),
        F.when(is_laps, laps.cast("long")).alias("laps_down"),
    )


def slug(c: Column, fallback: str = "unknown-circuit") -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    value = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(value != "", value).otherwise(F.lit(fallback))


def track_clear(c: Column) -> Column:
    """Only an explicit all-clear counts; NULL and unknown do not."""
    return F.coalesce(F.regexp_replace(c, "\\s+", "").rlike("^1+$"), F.lit(False))


def round_binary(c: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    The product with ``10**digits`` is split into its rounded value and exact
    error, so 0.15 (slightly below the decimal) goes down and 0.25 is a tie.
    """
    scale = float(10**digits)
    x = c.cast("double")
    product = x * scale
    spread = x * 134217729.0
    high = spread - (spread - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (
        (rest > 0.5)
        | ((rest == 0.5) & (error > 0))
        | ((rest == 0.5) & (error == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    )
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    # From 2^52 on every double is whole at this scale.
    return F.when(F.abs(product) >= 2.0**52, x).when(x.isNotNull(), rounded)


def stable_json(columns: Sequence[str]) -> Column:
    """JSON of the named columns in sorted order, NULLs kept."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(columns)]), {"ignoreNullFields": "false"})


def record_id(source: Column, columns: Sequence[str]) -> Column:
    """sha256 of source, a zero byte and the stable JSON of the record."""
    return F.sha2(F.concat(source, F.lit("\u0000"), stable_json(columns)), 256)


def keyed_uniform(slot: int, seed: int, *keys: Column) -> Column:
    """Uniform in (0, 1) from a digest of the seed and keys; slots 0..2 differ."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    digest = F.sha2(text, 256)
    chunk = F.substring(digest, 1 + slot * 12, 12)
    return (F.conv(chunk, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def keyed_error(width80: Column, width90: Column, seed: int, *keys: Column) -> Column:
    """Symmetric draw whose absolute value keeps the given 80 % and 90 % widths."""
    band = keyed_uniform(0, seed, *keys)
    within = keyed_uniform(1, seed, *keys)
    sign = F.when(keyed_uniform(2, seed, *keys) < 0.5, -1.0).otherwise(1.0)
    outer = F.greatest(F.lit(0.0), width90 - width80)
    size = (
        F.when(band < 0.8, within * width80)
        .when(band < 0.9, width80 + within * outer)
        .otherwise(width90 + within * width90)
    )
    return sign * size


def interpolate(left: Column, right: Column, fraction: Column, discrete: bool = False) -> Column:
    """Linear for numbers; discrete channels hold the left value."""
    if discrete:
        return left
    return left + (right - left) * fraction


def rotate(x: Column, y: Column, degrees: float, scale: float = 1.0, dx: float = 0.0, dy: float = 0.0):
    """Rotated, scaled and shifted coordinates."""
    angle = F.radians(F.lit(float(degrees)))
    return (
        (x * F.cos(angle) - y * F.sin(angle)) * scale + dx,
        (x * F.sin(angle) + y * F.cos(angle)) * scale + dy,
    )
