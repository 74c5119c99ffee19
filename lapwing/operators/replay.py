"""Race state at any cursor, rebuilt from the event log by ordered scans."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwing.functions.vocab import TERMINAL_STATUSES
from lapwing.operators.scan import latest, previous, running_max, running_sum, scan, series

_AFTER_ALL = 2**62
PAYLOAD_TYPES = {
    "position": "int", "lap_number": "int", "lap_time_ms": "long", "stint_number": "int", "compound": "string",
    "tyre_age_laps": "double", "status": "string",
}


def driver_states(
    events: DataFrame, roster: DataFrame, cursors: DataFrame, chunk_rows: int | None = None
) -> DataFrame:
    """State of every rostered driver at every cursor of its session.

    ``events`` needs session_time_ms, sequence, event_type, driver_id and the
    payload columns; ``roster`` is (session_id, driver_id); ``cursors`` is
    (session_id, cursor_ms).  Cursors travel through the scan as rows that
    change nothing, so any number of them costs one pass.  A terminal status is
    final: what follows cannot change it, only a pit exit still clears the pit.
    """
    keys = ["session_id", "driver_id"]
    order = ("session_time_ms", "sequence")
    absent = {n: F.lit(None).cast(t) for n, t in PAYLOAD_TYPES.items() if n not in events.columns}
    log = events.withColumns(absent).where(F.col("driver_id").isNotNull()).join(roster.select(*keys), keys, "left_semi")
    terminal = (
        log.where(
            (F.col("event_type") == "driver-status-changed") & F.col("status").isin(*TERMINAL_STATUSES)
        )
        .groupBy(*keys)
        .agg(F.min(F.struct(*order)).alias("end_at"))
    )
    probes = roster.select(*keys).join(cursors.select("session_id", "cursor_ms").distinct(), "session_id")
    rows = log.select(
        *keys, *order, "event_type", "position", "lap_number", "lap_time_ms", "stint_number",
        "compound", "tyre_age_laps", "status",
    ).unionByName(
        probes.select(
            *keys, F.col("cursor_ms").alias("session_time_ms"),
            F.lit(_AFTER_ALL).alias("sequence"), F.lit("cursor").alias("event_type"),
        ),
        allowMissingColumns=True,
    ).join(terminal, keys, "left")
    live = F.col("end_at").isNull() | (F.struct(*order) <= F.col("end_at"))
    kind = F.col("event_type")
    entry = (kind == "driver-pit-entered") & live
    leave = kind == "driver-pit-exited"
    state_event = (kind == "driver-status-changed") & live
    lap = kind == "driver-lap-completed"
    stint = kind == "driver-stint-changed"
    in_pit = (
        F.when(entry, True).when(leave, False).when(state_event, F.col("status") == "in-pit")
    )
    s = series(keys, order, chunk_rows)
    # Only a pit change after a non-pit state counts as a stop: decided on the
    # few rows that change the pit flag, before the full scan.
    changes = in_pit.isNotNull()
    flagged = scan(rows.where(changes), s, __was=previous(in_pit)).withColumn(
        "stop", F.when(entry & ~F.coalesce("__was", F.lit(False)), 1).otherwise(0).cast("long")
    ).drop("__was")
    full = rows.where(~changes).unionByName(flagged, allowMissingColumns=True)
    stirs = kind.isin("driver-position-changed", "driver-lap-completed", "driver-stint-changed")
    outside = (
        F.when(state_event, F.col("status")).when(live & (leave | stirs), F.lit("active"))
    )
    out = scan(
        full, s,
        position_now=latest(F.when(kind == "driver-position-changed", F.col("position"))),
        laps_completed=running_max(F.when(lap, F.col("lap_number"))),
        __last_lap=latest(F.when(lap, F.struct(F.col("lap_time_ms").alias("v")))),
        current_stint=latest(F.when(stint | lap, F.col("stint_number"))),
        compound_now=latest(F.when(stint | lap, F.col("compound"))),
        __age=latest(
            F.when(stint | (lap & F.col("tyre_age_laps").isNotNull()), F.struct(F.col("tyre_age_laps").alias("v")))
        ),
        __pit_lap=latest(F.when(entry, F.struct(F.col("lap_number").alias("v")))),
        __in=latest(in_pit),
        __outside=latest(outside),
        pit_stop_count=running_sum(F.coalesce("stop", F.lit(0))),
    )
    inside = F.coalesce(F.col("__in"), F.lit(False))
    return out.where(kind == "cursor").select(
        *keys,
        F.col("session_time_ms").alias("cursor_ms"),
        F.col("position_now").alias("position"),
        F.coalesce("laps_completed", F.lit(0)).alias("laps_completed"),
        F.col("__last_lap.v").alias("last_lap_time_ms"),
        "current_stint",
        F.col("compound_now").alias("compound"),
        F.col("__age.v").alias("tyre_age_laps"),
        inside.alias("in_pit"),
        "pit_stop_count",
        F.col("__pit_lap.v").alias("last_pit_lap"),
        F.when(inside, "in-pit").otherwise(F.coalesce("__outside", F.lit("not-started"))).alias("status"),
    )


def session_states(events: DataFrame, cursors: DataFrame, laps_at: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Track status, latest weather and reference lap at every cursor.

    ``laps_at`` holds the lap cursors; the reference lap is the highest one
    ended by then.
    """
    kind = F.col("event_type")
    log = events.where(kind.isin("track-status-changed", "weather-observed")).select(
        "session_id", "session_time_ms", "sequence", "event_type", "track_status",
        "air_temperature_c", "track_temperature_c", "humidity_percent", "rainfall",
    )
    ends = laps_at.select(
        "session_id", F.col("end_time_ms").alias("session_time_ms"), F.lit(_AFTER_ALL - 1).alias("sequence"),
        F.lit("lap-end").alias("event_type"), F.col("lap_number").alias("lap"),
    )
    probes = cursors.select("session_id", "cursor_ms").distinct().select(
        "session_id", F.col("cursor_ms").alias("session_time_ms"), F.lit(_AFTER_ALL).alias("sequence"),
        F.lit("cursor").alias("event_type"),
    )
    rows = log.unionByName(ends, allowMissingColumns=True).unionByName(probes, allowMissingColumns=True)
    fields = F.struct(
        F.col("session_time_ms").alias("observed_at_ms"), "air_temperature_c", "track_temperature_c",
        "humidity_percent", "rainfall",
    )
    out = scan(
        rows, series(("session_id",), ("session_time_ms", "sequence"), chunk_rows),
        status_now=latest(F.when(kind == "track-status-changed", F.col("track_status"))),
        weather=latest(F.when(kind == "weather-observed", fields)),
        reference_lap=running_max(F.col("lap")),
    )
    return out.where(kind == "cursor").select(
        "session_id", F.col("session_time_ms").alias("cursor_ms"),
        F.coalesce("status_now", F.lit("unknown")).alias("track_status"), "weather.*", "reference_lap",
    )


def recent_messages(events: DataFrame, cursors: DataFrame, n: int = 20, chunk_rows: int | None = None) -> DataFrame:
    """The last ``n`` race-control messages at each cursor, newest first.

    Messages and cursors are numbered in one scan; a cursor then meets at most
    ``n`` message numbers by equality.
    """
    log = events.where(F.col("event_type") == "race-control-event").select(
        "session_id", "session_time_ms", "sequence", "message"
    )
    probes = cursors.select("session_id", "cursor_ms").distinct().select(
        "session_id", F.col("cursor_ms").alias("session_time_ms"), F.lit(_AFTER_ALL).alias("sequence")
    )
    rows = log.withColumn("is_message", F.lit(1).cast("long")).unionByName(probes, allowMissingColumns=True)
    numbered = scan(
        rows, series(("session_id",), ("session_time_ms", "sequence"), chunk_rows), upto=running_sum(F.col("is_message"))
    )
    wanted = (
        numbered.where(F.col("is_message").isNull() & (F.col("upto") > 0))
        .select(
            "session_id", F.col("session_time_ms").alias("cursor_ms"), "upto",
            F.explode(F.sequence(F.greatest(F.lit(1), F.col("upto") - (n - 1)), F.col("upto"))).alias("no"),
        )
    )
    messages = numbered.where(F.col("is_message") == 1).select(
        "session_id", F.col("upto").alias("no"), F.col("session_time_ms").alias("observed_at_ms"), "message"
    )
    return wanted.join(messages, ["session_id", "no"]).select(
        "session_id", "cursor_ms", (F.col("upto") - F.col("no") + 1).cast("int").alias("recency"), "observed_at_ms", "message"
    )


def lap_cursor_points(cursors: DataFrame, phase: str = "end") -> DataFrame:
    """Cursor times of each lap's start or end."""
    if phase not in ("start", "end"):
        raise ValueError("phase must be 'start' or 'end'")
    return cursors.select("session_id", "lap_number", F.col(f"{phase}_time_ms").alias("cursor_ms"))


def finish_times(control: DataFrame) -> DataFrame:
    """When each session was first seen finished."""
    message = F.trim(F.regexp_replace(F.lower("message"), "\\s+", " "))
    status = F.lower(F.trim(F.coalesce("raw_status", F.lit(""))))
    # Session statuses that end a session.
    ended = ("finished", "finalised", "finalized", "ends", "ended")
    over = (
        message.contains("chequered")
        | (status == "chequered")
        | ((F.lower("source_kind") == "session_status") & (message.isin(*ended) | status.isin(*ended)))
    )
    return control.where(over).groupBy("session_id").agg(F.min("session_time_ms").alias("finished_at_ms"))


def finished_at(control: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Whether the session is known finished at each cutoff."""
    return cutoffs.join(finish_times(control), "session_id", "left").withColumn(
        "finished", F.coalesce(F.col("finished_at_ms") <= F.col("cursor_ms"), F.lit(False))
    )


class _Held:
    """A sample that some windows hold as their accepted one; windows that come to hold the same sample are one."""

    __slots__ = ("into", "sample", "windows")

    def __init__(self, sample: tuple | None):
        self.sample, self.windows, self.into = sample, 0, None

    def now(self) -> _Held:
        held = self
        while held.into is not None:
            held = held.into
        return held


class _Fold:
    """All windows of one driver's stretch of time, folded over its samples in one pass.

    Windows are equally long, so they close in the order in which they open.  What is kept is one entry per open
    window and the distinct samples they hold, however many samples pass by.
    """

    def __init__(self, stale_ms: int, max_speed: float):
        self.stale_ms, self.max_speed = stale_ms, max_speed
        self.waiting, self.held, self.open = _Held(None), [], deque()

    def window(self, cursor: int) -> None:
        self.waiting.windows += 1
        self.open.append((cursor, self.waiting))

    def close(self, before: int | None) -> Iterator[tuple]:
        """Windows whose cursor lies before a time (None: all), with what they hold."""
        while self.open and (before is None or self.open[0][0] < before):
            cursor, held = self.open.popleft()
            held = held.now()
            held.windows -= 1
            if held.sample is not None:
                yield (cursor, *held.sample)

    def sample(self, time: int, x: float, y: float) -> None:
        taken, left, sample = None, [], (time, x, y)
        moving = [self.waiting] if self.waiting.windows else []
        for held in self.held:
            if held.windows:
                (left if self._jumps(held.sample, sample) else moving).append(held)
        if moving:
            # The class of most windows moves on, the others join it.
            taken = max(moving, key=lambda held: held.windows)
            for held in moving:
                if held is not taken:
                    held.into, taken.windows = taken, taken.windows + held.windows
            taken.sample = sample
            if self.waiting.windows:
                self.waiting = _Held(None)
            left.append(taken)
        self.held = left

    def _jumps(self, kept: tuple, sample: tuple) -> bool:
        elapsed = (sample[0] - kept[0]) / 1000.0
        if elapsed <= 0:
            return False
        # A speed that is no number is a jump.
        return not math.sqrt((sample[1] - kept[1]) ** 2 + (sample[2] - kept[2]) ** 2) / elapsed <= self.max_speed


def latest_positions(
    positions: DataFrame, cursors: DataFrame, stale_ms: int = 5000, max_speed: float = 150.0
) -> DataFrame:
    """Newest believable position per driver at each cursor.

    Only samples of the last ``stale_ms`` count; a sample implying more than
    ``max_speed`` from the accepted one before it is skipped; equal times go by
    x, then y.  Samples and cursors are dealt by session, driver and stretch of
    time (each sample to the stretches whose cursors it can reach, two at most),
    sorted, and folded as a stream that goes on over Arrow batches: neither the
    samples of a window nor those of a stretch are gathered, and a sample is
    sent on once or twice however many cursors see it.  Samples without a time
    or coordinate and cursors that see no sample give no row.
    """
    width = F.lit(4 * max(stale_ms, 1))

    def stretch(time: Column) -> Column:
        return F.floor(time / width).cast("long")

    time = F.col("session_time_ms")
    ends = F.array_distinct(F.array(stretch(time), stretch(time + F.lit(stale_ms))))
    points = positions.where(
        F.col("session_id").isNotNull() & time.isNotNull() & F.col("x_m").isNotNull() & F.col("y_m").isNotNull()
    ).select(
        "session_id", "driver_id", F.explode(ends).alias("stretch"), time.cast("long").alias("at"), F.lit(1).alias("kind"),
        F.col("x_m").cast("double").alias("x_m"), F.col("y_m").cast("double").alias("y_m"),
    )
    asked = cursors.where(F.col("cursor_ms").isNotNull()).select(
        "session_id", F.col("cursor_ms").cast("long").alias("cursor_ms"), stretch(F.col("cursor_ms")).alias("stretch")
    ).distinct()
    seen = points.select("session_id", "driver_id", "stretch").distinct()
    # A window opens when its oldest sample may come, before the samples of that time.
    windows = seen.join(asked, ["session_id", "stretch"]).select(
        "session_id", "driver_id", "stretch", (F.col("cursor_ms") - F.lit(stale_ms)).alias("at"), F.lit(0).alias("kind")
    )
    place = ["session_id", "driver_id", "stretch"]
    stream = (
        points.unionByName(windows, allowMissingColumns=True)
        .repartition(*place)
        .sortWithinPartitions(*place, "at", "kind", "x_m", "y_m")
    )
    fields = {f.name: f.dataType for f in positions.schema.fields}
    schema = T.StructType(
        [
            *[T.StructField(c, stream.schema[c].dataType) for c in ("session_id", "driver_id")],
            T.StructField("cursor_ms", T.LongType()), T.StructField("session_time_ms", T.LongType()),
            T.StructField("x_m", T.DoubleType()), T.StructField("y_m", T.DoubleType()),
        ]
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, types = None, _Fold(stale_ms, max_speed), [], None
        for batch in batches:
            types = types or [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            for session, driver, part, at, kind, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (session, driver, part) != key:
                    if key is not None:
                        out += [(*key[:2], *found) for found in state.close(None)]
                    key, state = (session, driver, part), _Fold(stale_ms, max_speed)
                if kind == 0:
                    state.window(at + stale_ms)
                else:
                    out += [(*key[:2], *found) for found in state.close(at)]
                    state.sample(at, x, y)
                if len(out) >= 8192:
                    yield _batch(out, schema.names, types)
                    out = []
        if key is not None:
            out += [(*key[:2], *found) for found in state.close(None)]
        if out:
            yield _batch(out, schema.names, types)

    return stream.mapInArrow(fold, schema).select(
        "session_id", "cursor_ms", "driver_id",
        *[F.col(c).cast(fields[c]).alias(c) for c in ("session_time_ms", "x_m", "y_m")],
    )


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def longest_trace(positions: DataFrame) -> DataFrame:
    """The driver with most valid samples per session, ties by id."""
    counts = (
        positions.where(F.col("x_m").isNotNull() & F.col("y_m").isNotNull())
        .groupBy("session_id", "driver_id")
        .agg(F.count(F.lit(1)).alias("samples"))
        .where(F.col("samples") >= 2)
    )
    return counts.groupBy("session_id").agg(
        F.min_by("driver_id", F.struct(-F.col("samples"), F.col("driver_id").cast("string"))).alias("driver_id"),
        F.max("samples").alias("samples"),
    )


def viewport(positions: DataFrame, width: float = 720, height: float = 460, padding: float = 42) -> DataFrame:
    """Positions fitted into a drawing area, one scale per session."""
    box = positions.groupBy("session_id").agg(
        F.min("x_m").alias("x0"), F.max("x_m").alias("x1"), F.min("y_m").alias("y0"), F.max("y_m").alias("y1")
    ).where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    scale = F.least(
        F.lit(width - 2 * padding) / (F.col("x1") - F.col("x0")),
        F.lit(height - 2 * padding) / (F.col("y1") - F.col("y0")),
    )
    fitted = positions.join(box, "session_id").withColumn("__s", scale)
    left = (F.lit(width) - (F.col("x1") - F.col("x0")) * F.col("__s")) / 2
    low = (F.lit(height) - (F.col("y1") - F.col("y0")) * F.col("__s")) / 2
    return fitted.select(
        *positions.columns,
        (left + (F.col("x_m") - F.col("x0")) * F.col("__s")).alias("px"),
        (F.lit(height) - (low + (F.col("y_m") - F.col("y0")) * F.col("__s"))).alias("py"),
    )
