"""Replay: hand-built session, causality, order-independence, streaming."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from lapwing.operators import pits as PT
from lapwing.operators import replay as R
from lapwing.operators import timeline as T
from lapwing.streaming.replay_stream import late_rows, replay_stream

ORDER = ("session_time_ms", "priority", "sequence")


@pytest.fixture(scope="module")
def session(spark):
    laps = spark.createDataFrame(
        [(1, 1, 1, 0, 90000, 90000, 1, "soft", 1.0, False), (1, 1, 2, 90000, 180000, 90000, 2, "medium", 1.0, False),
         (1, 2, 1, 0, 91000, 91000, 1, "hard", 3.0, False)],
        "session_id int, driver_id int, lap_number int, lap_start_time_ms long, lap_end_time_ms long, lap_time_ms long, "
        "stint_number int, compound string, tyre_life_laps double, is_deleted boolean",
    )
    stints = spark.createDataFrame(
        [(1, 1, 1, 1, 0, "soft", 1.0), (1, 1, 2, 2, 95000, "medium", 1.0), (1, 2, 1, 1, 0, "hard", 3.0)],
        "session_id int, driver_id int, stint_number int, start_lap int, start_time_ms long, compound string, tyre_life_start_laps double",
    )
    pits = spark.createDataFrame(
        [(1, 1, 1, 1, 85000, 95000)],
        "session_id int, driver_id int, stop_number int, lap_number int, pit_in_time_ms long, pit_out_time_ms long",
    )
    weather = spark.createDataFrame(
        [(1, 10000, 20.0, 30.0, 50.0, False, 1), (1, 30000, 19.0, 30.0, 50.0, True, 2)],
        "session_id int, session_time_ms long, air_temperature_c double, track_temperature_c double, humidity_percent double, rainfall boolean, event_id long",
    )
    control = spark.createDataFrame(
        [(1, 5000, "TRACK CLEAR", "clear", "track_status", None, 1), (1, 50000, "SAFETY CAR", "safety-car", "track_status", None, 2),
         (1, 70000, "GREEN FLAG", "clear", "track_status", None, 3)],
        "session_id int, session_time_ms long, message string, track_status string, source_kind string, driver_id int, event_id long",
    )
    positions = spark.createDataFrame(
        [(1, 1, 90000, 1, 1), (1, 2, 91000, 2, 1), (1, 1, 180000, 1, 2)],
        "session_id int, driver_id int, session_time_ms long, position int, lap_number int",
    )
    events = T.build_timeline(T.candidates(laps, stints, pits, positions, weather, control)).cache()
    roster = spark.createDataFrame([(1, 1), (1, 2)], "session_id int, driver_id int")
    return dict(events=events, roster=roster, laps=laps, positions=positions)


def states(spark, session, times, events=None):
    cursors = spark.createDataFrame([(1, t) for t in times], "session_id int, cursor_ms long")
    rows = R.driver_states(session["events"] if events is None else events, session["roster"], cursors)
    return {(r["driver_id"], r["cursor_ms"]): r for r in rows.collect()}


def test_states(spark, session):
    got = states(spark, session, [0, 85000, 90000, 96000, 180000])
    assert got[1, 0]["status"] == "active" and got[1, 0]["compound"] == "soft"
    assert got[1, 85000]["in_pit"] and got[1, 85000]["status"] == "in-pit" and got[1, 85000]["pit_stop_count"] == 1
    assert got[1, 90000]["in_pit"] and got[1, 90000]["laps_completed"] == 1 and got[1, 90000]["position"] == 1
    assert not got[1, 96000]["in_pit"] and got[1, 96000]["status"] == "active" and got[1, 96000]["current_stint"] == 2
    assert got[1, 180000]["laps_completed"] == 2 and got[2, 180000]["position"] == 2


def test_no_future_leak(spark, session):
    future = session["events"].where(F.col("session_time_ms") <= 90000)
    assert states(spark, session, [60000, 90000]) == states(spark, session, [60000, 90000], future)


def test_sequence_is_contiguous_and_order_free(spark, session):
    events = session["events"].drop("sequence", "payload_json")
    shuffled = T.build_timeline(events.orderBy(F.rand(3)).unionByName(events))
    want = sorted((r["sequence"], r["source_key"]) for r in session["events"].collect())
    assert sorted((r["sequence"], r["source_key"]) for r in shuffled.collect()) == want
    assert [s for s, _ in want] == list(range(len(want)))


def test_track_status_and_cursors(spark, session):
    kinds = [r["track_status"] for r in session["events"].where(F.col("event_type") == "track-status-changed").orderBy("sequence").collect()]
    assert kinds == ["clear", "safety-car", "clear"]
    laps = {r["lap_number"]: (r["start_time_ms"], r["end_time_ms"]) for r in T.lap_cursors(session["positions"], session["laps"]).collect()}
    assert laps == {1: (0, 90000), 2: (90000, 180000)}


def test_terminal_status_sticks(spark, session):
    extra = spark.createDataFrame(
        [(1, 1, 87000, "retired", 1), (1, 1, 99000, "active", 2)],
        "session_id int, driver_id int, session_time_ms long, status string, event_id long",
    )
    base = session["events"].drop("sequence", "payload_json")
    events = T.build_timeline(base.unionByName(T.status_events(extra), allowMissingColumns=True))
    got = states(spark, session, [86000, 90000, 96000, 180000], events)
    assert got[1, 86000]["status"] == "in-pit"
    assert got[1, 90000]["status"] == "retired" and not got[1, 90000]["in_pit"]
    assert got[1, 180000]["status"] == "retired" and got[1, 180000]["laps_completed"] == 2


def pair(marks):
    """Plain stack pairing of one driver, written independently."""
    stack, stops = [], []
    for t, kind, lap in sorted(marks, key=lambda m: (m[0], m[1] == "out", m[2])):
        if kind == "in":
            stack.append((t, lap))
        elif stack and lap in (stack[-1][1], stack[-1][1] + 1):
            start, first = stack.pop()
            stops.append((start, t, first))
        else:
            stops.append((None, t, lap))
    return sorted(stops + [(t, None, lap) for t, lap in stack], key=str)


@pytest.mark.parametrize("rows, seed", [(None, 11), (10, 12), (3, 13)])
def test_pit_pairing_against_stack(spark, rows, seed):
    rng = random.Random(seed)
    marks = []
    for driver in range(4):
        lap = 1
        for t in sorted(rng.sample(range(400), 60)):
            lap += rng.random() < 0.4
            marks.append((1, driver, t, rng.choice(["in", "out"]), lap + rng.choice([0, 0, 0, 1])))
    # Nested entries of one lap, closed one after the other, then exits that meet none; then a driver without exits.
    marks += [(1, 8, t, "in" if t < 6 else "out", 3) for t in range(15)]
    marks += [(1, 9, t, "in", 3) for t in range(4)]
    df = spark.createDataFrame(
        [(*m[:3], m[3], m[4], i) for i, m in enumerate(marks)],
        "session_id int, driver_id int, session_time_ms long, kind string, lap_number int, event_id long",
    )
    got = PT.pair_pits(df, rows=rows).collect()
    for driver in (0, 1, 2, 3, 8, 9):
        mine = sorted(((r["pit_in_time_ms"], r["pit_out_time_ms"], r["lap_number"]) for r in got if r["driver_id"] == driver), key=str)
        assert mine == pair([(t, k, lap) for _, d, t, k, lap in marks if d == driver])
        assert sorted(r["stop_number"] for r in got if r["driver_id"] == driver) == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("rows", [None, 1000, 7])
def test_deep_stops_take_no_more_passes(spark, monkeypatch, rows):
    """Entries of one moment, as many exits later: a pass for each level of them grew with the table."""
    marks = [(1, 2, t // 40, "in" if t < 40 else "out", 3) for t in range(80)]
    marks += [(1, 3, t, "in" if t < 40 else "out", 3 + t // 39) for t in range(80)]
    marks += [(None, None, 5, "in", 3), (None, None, 9, "out", None), (None, None, 11, "out", 4)]
    df = spark.createDataFrame(
        [(*m, i) for i, m in enumerate(marks)],
        "session_id int, driver_id int, session_time_ms long, kind string, lap_number int, event_id long",
    )
    writes = []
    monkeypatch.setattr(PT, "durable", lambda df, kept=PT.durable: writes.append(df) or kept(df))
    got = PT.pair_pits(df, rows=rows).collect()
    for driver in (2, 3, None):
        mine = sorted(((r["pit_in_time_ms"], r["pit_out_time_ms"], r["lap_number"]) for r in got if r["driver_id"] == driver), key=str)
        of = [m[2:] for m in marks if m[1] == driver]
        if driver is None:
            assert mine == sorted([(None, 9, None), (5, 11, 3)], key=str)
        else:
            assert mine == pair(of)
    assert len(writes) <= 4


def test_repeated_marks_and_marks_without_a_number(spark):
    """A repeated entry is one entry, a repeated exit gives its row again; an entry without a number stays open."""
    marks = [
        (1, 1, 10, "in", 3, 1), (1, 1, 20, "in", 3, 2), (1, 1, 20, "in", 3, 2), (1, 1, 30, "out", 3, 3), (1, 1, 30, "out", 3, 3),
        (1, 1, 40, "out", 3, 4), (1, 1, 50, "in", 4, None), (1, 1, 60, "out", 4, 5), (1, 1, 70, "in", 5, 6), (1, 1, 70, "in", 5, 6),
    ]
    df = spark.createDataFrame(
        marks, "session_id int, driver_id int, session_time_ms long, kind string, lap_number int, event_id long"
    )
    want = sorted(
        [(20, 30, 3), (20, 30, 3), (10, 40, 3), (50, None, 4), (None, 60, 4), (70, None, 5), (70, None, 5)], key=str
    )
    for rows in (None, 3):
        got = [(r["pit_in_time_ms"], r["pit_out_time_ms"], r["lap_number"]) for r in PT.pair_pits(df, rows=rows).collect()]
        assert sorted(got, key=str) == want


def random_log(spark, n=400):
    rng = random.Random(23)
    rows = []
    for i in range(n):
        kind = rng.choice(["driver-pit-entered", "driver-pit-exited", "driver-position-changed", "driver-lap-completed",
                           "driver-stint-changed", "driver-status-changed"])
        status = rng.choice(["active", "in-pit", "unknown"] + (["retired"] if rng.random() < 0.1 else [])) if kind.endswith("status-changed") else None
        rows.append((
            1, rng.randrange(6), rng.randrange(1, 100) * 1000, T.PRIORITY[kind], i, kind, rng.randrange(1, 20),
            rng.randrange(1, 60), rng.choice([None, 90000 + i]), rng.choice([None, 1, 2]) if kind != "driver-stint-changed" else 3,
            rng.choice([None, "soft"]) if kind != "driver-stint-changed" else "hard", rng.choice([None, 4.0]), status,
        ))
    rows.sort(key=lambda r: (r[2], r[3], r[4]))
    schema = ("session_id int, driver_id int, session_time_ms long, priority int, sequence long, event_type string, position int, "
              "lap_number int, lap_time_ms long, stint_number int, compound string, tyre_age_laps double, status string")
    return rows, schema


def test_stream_equals_batch(spark):
    rows, schema = random_log(spark)
    # Sequence follows time order, as in a stored log.
    rows = [(*r[:4], i, *r[5:]) for i, r in enumerate(rows)]
    batch_log = spark.createDataFrame(rows, schema)
    roster = batch_log.select("session_id", "driver_id").distinct()
    cursor = spark.createDataFrame([(1, 10**9)], "session_id int, cursor_ms long")
    want = {r["driver_id"]: r for r in R.driver_states(batch_log, roster, cursor, 20000).collect()}

    folder = tempfile.mkdtemp(prefix="stream-")
    rng = random.Random(2)
    parts = [rows[i:i + 100] for i in range(0, len(rows), 100)]
    for part in parts:
        rng.shuffle(part)  # disorder within the allowed delay
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    last = [(1, 99, 10_000_000, 60, 10**6, "driver-position-changed", 1, 1, None, None, None, None, None)]
    spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    late = [(1, 0, 1000, 60, 10**6 + 1, "driver-position-changed", 19, 1, None, None, None, None, None)]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    sink = f"{folder}/out"

    def run():
        query = (
            replay_stream(stream, "200 seconds").writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", folder + "/checkpoint").option("path", sink)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination(240)
        return query

    run()
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    assert late_rows(run()) >= 1
    newest = {}
    for r in spark.read.parquet(sink).collect():
        key = r["driver_id"]
        if key not in newest or r["applied_to_ms"] >= newest[key]["applied_to_ms"]:
            newest[key] = r
    fields = ["position", "laps_completed", "last_lap_time_ms", "current_stint", "compound", "tyre_age_laps", "in_pit",
              "pit_stop_count", "last_pit_lap", "status"]
    for driver, state in want.items():
        assert [newest[driver][f] for f in fields] == [state[f] for f in fields]


def test_latest_positions_gate(spark):
    points = spark.createDataFrame(
        [(1, 1, 1000, 0.0, 0.0), (1, 1, 2000, 100.0, 0.0), (1, 1, 3000, 5000.0, 0.0), (1, 2, 500, 1.0, 1.0), (1, 1, 4000, 300.0, 0.0)],
        "session_id int, driver_id int, session_time_ms long, x_m double, y_m double",
    )
    cursors = spark.createDataFrame([(1, 3500), (1, 4500), (1, 20000)], "session_id int, cursor_ms long")
    got = {(r["driver_id"], r["cursor_ms"]): r["x_m"] for r in R.latest_positions(points, cursors).collect()}
    assert got == {(1, 3500): 100.0, (1, 4500): 300.0, (2, 3500): 1.0, (2, 4500): 1.0}


def _fold_one(points, cursor, stale, most):
    kept = None
    for t, x, y in sorted(p for p in points if 0 <= cursor - p[0] <= stale):
        if kept is not None and t > kept[0] and math.hypot(x - kept[1], y - kept[2]) / ((t - kept[0]) / 1000) > most:
            continue
        kept = (t, x, y)
    return kept


@pytest.mark.parametrize("stale", [1, 700, 5000])
def test_latest_positions_equal_a_fold_per_cursor(spark, stale):
    """One pass over many overlapping windows, equal times, jumps, missing values and times before 0."""
    rng = random.Random(stale)
    points = []
    for driver in (None, 1, 2, 3):
        at = -3000
        for _ in range(400):
            at += rng.choice([0, 40, 90, 400, 2500])
            far = 5000.0 if rng.random() < 0.2 else 0.0
            points.append((1, driver, at, rng.choice([None, at / 100.0 + far, float(rng.randrange(50))]), rng.random() * 9))
    points += [(1, 1, None, 1.0, 1.0), (None, 1, 5, 1.0, 1.0), (2, 1, 5, 1.0, 1.0)]
    cursors = [(1, rng.randrange(-4000, 150_000)) for _ in range(600)] + [(1, None), (None, 5), (3, 5)]
    frame = spark.createDataFrame(points, "session_id int, driver_id int, session_time_ms long, x_m double, y_m double")
    asked = spark.createDataFrame(cursors, "session_id int, cursor_ms long")
    found = R.latest_positions(frame, asked, stale, 60.0).collect()
    got = {(r["driver_id"], r["cursor_ms"]): (r["session_time_ms"], r["x_m"], r["y_m"]) for r in found}
    assert len(got) == len(found)
    want = {}
    for driver in (None, 1, 2, 3):
        mine = [p[2:] for p in points if p[:2] == (1, driver) and None not in p[2:]]
        for cursor in {c for s, c in cursors if s == 1 and c is not None}:
            kept = _fold_one(mine, cursor, stale, 60.0)
            if kept:
                want[driver, cursor] = kept
    assert got == want
    plan = R.latest_positions(frame, asked, stale)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def _event_row(driver, time, sequence, kind="driver-position-changed", **values):
    names = ("position", "lap_number", "lap_time_ms", "stint_number", "compound", "tyre_age_laps", "status")
    return (1, driver, time, 60, sequence, kind, *(values.get(name) for name in names))


EVENT_SCHEMA = (
    "session_id int, driver_id int, session_time_ms long, priority int, sequence long, event_type string, position int, "
    "lap_number int, lap_time_ms long, stint_number int, compound string, tyre_age_laps double, status string"
)


@pytest.mark.parametrize("begin", [0, 1, -3_600_000])
def test_stream_keeps_what_happens_at_the_start(spark, begin):
    """Events at time 0 and before, brought by files out of order, are applied and none is late."""
    folder = tempfile.mkdtemp(prefix="stream-")
    rows = [
        _event_row(1, begin, 1, "driver-stint-changed", stint_number=1, compound="soft", tyre_age_laps=1.0),
        _event_row(1, begin, 2, position=4),
        _event_row(2, begin, 3, "driver-stint-changed", stint_number=1, compound="hard", tyre_age_laps=0.0),
        _event_row(1, begin + 90_000, 4, "driver-lap-completed", lap_number=1, lap_time_ms=90_000),
        _event_row(1, begin + 95_000, 5, position=2),
        _event_row(1, begin + 99_000, 6, "driver-pit-entered", lap_number=2),
    ]
    for row in [*reversed(rows), _event_row(9, begin + 10**9, 9, position=1)]:
        spark.createDataFrame([row], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    query = (
        replay_stream(stream, "100 seconds").writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", folder + "/checkpoint").option("path", folder + "/out").trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert late_rows(query) == 0
    found = spark.read.parquet(folder + "/out").where("driver_id < 9")
    last = {r["driver_id"]: r["s"] for r in found.groupBy("driver_id").agg(F.max_by(F.struct("*"), "applied_to_ms").alias("s")).collect()}
    one, two = last[1], last[2]
    assert (one["applied_to_ms"], one["position"], one["laps_completed"]) == (begin + 99_000, 2, 1)
    assert (one["current_stint"], one["compound"], one["in_pit"], one["pit_stop_count"]) == (1, "soft", True, 1)
    assert (two["current_stint"], two["compound"], two["applied_to_ms"]) == (1, "hard", begin)
