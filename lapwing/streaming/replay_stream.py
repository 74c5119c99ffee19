"""Race state as a stream: the replay transitions with keyed state.

Events of one (session, driver) wait in state until the watermark has passed
them, are then applied in (time, priority, sequence) order, and the driver's
state after each trigger is emitted.  Events older than the watermark are late:
Spark drops and counts them, they are never applied.

A stream's first watermark is the epoch and rows at or before it are late, so session times are set off from an origin
of their own: what happens at time 0 or before a session's start is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lapwing.functions.vocab import TERMINAL_STATUSES

EVENT_FIELDS = (
    "session_time_ms", "priority", "sequence", "event_type", "position", "lap_number", "lap_time_ms",
    "stint_number", "compound", "tyre_age_laps", "status",
)
OUTPUT = (
    "session_id int, driver_id int, applied_to_ms long, position int, laps_completed int, last_lap_time_ms long, "
    "current_stint int, compound string, tyre_age_laps double, in_pit boolean, pit_stop_count long, "
    "last_pit_lap int, status string"
)
# One row of state: the folded driver, then the waiting events as parallel arrays.
STATE = (
    "applied_to_ms long, position int, laps_completed int, last_lap_time_ms long, current_stint int, compound string, "
    "tyre_age_laps double, in_pit boolean, pit_stop_count long, last_pit_lap int, status string, "
    "waiting array<struct<session_time_ms:long,priority:int,sequence:long,event_type:string,position:int,lap_number:int,"
    "lap_time_ms:long,stint_number:int,compound:string,tyre_age_laps:double,status:string>>"
)
#: Event time of session time 0: sessions may begin as long before it.
ORIGIN_MS = 10**10
_START = (None, None, 0, None, None, None, None, False, 0, None, "not-started", [])
_APPLIED, _POS, _LAPS, _LAST, _STINT, _COMP, _AGE, _PIT, _STOPS, _PITLAP, _STATUS, _WAIT = range(12)


def _none(value):
    """NaN and NaT from pandas back to None."""
    return None if value is None or value != value else value


def _int(value):
    value = _none(value)
    return None if value is None else int(value)


def _step(s: list, e: tuple) -> None:
    """Apply one event to the driver's state."""
    time, _, _, kind, place, lap, lap_ms, stint, compound, age, status = e
    live = s[_STATUS] not in TERMINAL_STATUSES
    s[_APPLIED] = time
    if kind == "driver-pit-entered":
        if live:
            s[_STOPS] += not s[_PIT]
            s[_PIT], s[_PITLAP], s[_STATUS] = True, lap, "in-pit"
        return
    if kind == "driver-status-changed":
        if live:
            s[_STATUS], s[_PIT] = status, status == "in-pit"
        return
    if kind == "driver-pit-exited":
        s[_PIT] = False
    elif kind == "driver-position-changed":
        s[_POS] = place
    elif kind == "driver-stint-changed":
        s[_STINT], s[_COMP], s[_AGE] = stint, compound, age
    elif kind == "driver-lap-completed":
        s[_LAPS] = max(s[_LAPS], lap)
        s[_LAST] = lap_ms
        s[_STINT] = s[_STINT] if stint is None else stint
        s[_COMP] = s[_COMP] if compound is None else compound
        s[_AGE] = s[_AGE] if age is None else age
    else:
        return
    if live and not s[_PIT]:
        s[_STATUS] = "active"


def _event(row: tuple) -> tuple:
    time, priority, sequence, kind, place, lap, lap_ms, stint, compound, age, status = row
    age = _none(age)
    return (
        int(time), int(priority), int(sequence), kind, _int(place), _int(lap), _int(lap_ms), _int(stint),
        _none(compound), None if age is None else float(age), _none(status),
    )


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = list(state.get) if state.exists else list(_START)
    waiting = [tuple(w) for w in s[_WAIT]]
    mark = state.getCurrentWatermarkMs() - ORIGIN_MS
    for frame in frames:
        for row in zip(*[frame[c] for c in EVENT_FIELDS]):
            waiting.append(_event(row))
    waiting.sort(key=lambda e: e[:3])
    ready = [e for e in waiting if e[0] < mark]
    for event in ready:
        _step(s, event)
    s[_WAIT] = waiting[len(ready):]
    state.update(tuple(s))
    if s[_WAIT]:
        state.setTimeoutTimestamp(ORIGIN_MS + max(mark + 1, s[_WAIT][0][0] + 1))
    if ready:
        yield pd.DataFrame([[*key, *s[:_WAIT]]], columns=[f.split()[0] for f in OUTPUT.split(", ")])


def replay_stream(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Driver states of a streaming event log.

    ``events`` has session_id, driver_id and the replay event columns; its
    session time is the event time.  Emits the newest state of a driver whenever
    events of that driver become final.
    """
    timed = events.where(F.col("driver_id").isNotNull()).withColumn(
        "event_at", F.timestamp_millis(F.col("session_time_ms") + ORIGIN_MS)
    ).withWatermark("event_at", delay)
    return timed.select("session_id", "driver_id", "event_at", *EVENT_FIELDS).groupBy("session_id", "driver_id").applyInPandasWithState(
        _advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def late_rows(query) -> int:
    """Rows the stream dropped as late so far, from its progress reports."""
    return sum(
        op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"]
    )
