"""Normalisation, features, learning, strategy and source fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.operators import features as M
from lapwing.operators import learning as L
from lapwing.operators import normalize as N
from lapwing.operators import strategy as S
from lapwing.operators.archive_quality import evaluate
from lapwing.operators.projection import projection_totals, stratified_distribution
from lapwing.sources import dump, feeds, lossless, schemas, tables


def raw_laps(spark, rows):
    return spark.createDataFrame(
        rows,
        "session_id int, driver_number string, lap_number double, time long, lap_start_time long, lap_start_date string, lap_time long, "
        "stint double, compound string, tyre_life string, is_accurate boolean, deleted boolean, deleted_reason string, track_status string",
    )


LAPS = [
    (1, "0", 1.0, 90000, 0, None, 90000, 1.0, "SOFT", "1", True, False, None, "1"),
    (1, "0", 2.0, 181000, 90000, None, 91000, 1.0, "C5", "NaN", None, True, "  TRACK LIMITS  ", "12"),
    (1, "0", 2.0, 181000, 90000, None, 91000, 1.0, "C5", "NaN", None, True, "  TRACK LIMITS  ", "12"),
    (1, "7", 1.0, None, None, "2024-01-01T00:00:01Z", None, None, None, None, None, None, None, None),
]


def test_normalized_laps(spark):
    rows = {(r["driver_id"], r["lap_number"]): r for r in N.normalize_laps(raw_laps(spark, LAPS)).collect()}
    assert len(rows) == 3
    second = rows[0, 2]
    assert second["compound"] == "unknown" and second["raw_compound"] == "C5" and second["deleted_reason"] == "TRACK LIMITS"
    assert second["tyre_life_laps"] is None and not second["conflicting"]
    assert rows[7, 1]["unplaced_start"] and rows[7, 1]["lap_time_ms"] is None


def test_normalisation_ignores_order(spark):
    rows = [*LAPS, (1, "0", 1.0, 90001, 0, None, 90001, 1.0, "SOFT", "1", True, False, None, "1")]
    want = sorted(map(str, N.normalize_laps(raw_laps(spark, rows)).collect()))
    for seed in range(3):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        assert sorted(map(str, N.normalize_laps(raw_laps(spark, mixed).repartition(3)).collect())) == want


def session(spark, future=0):
    laps = [(1, 1, n, (n - 1) * 90000, n * 90000, 90000 + 100 * n if n > 2 else 90000, 1 if n == 1 else 2,
             "soft" if n == 1 else "medium", float(max(1, n - 1)), False, False, True, "1") for n in range(1, 7)]
    laps += [(1, 1, 7, 540000, 630000, 200000 + future, 2, "medium", 6.0, False, False, True, "1")] if future else []
    schema = ("session_id int, driver_id int, lap_number int, lap_start_time_ms long, lap_end_time_ms long, lap_time_ms long, stint_number int, "
              "compound string, tyre_life_laps double, is_deleted boolean, is_generated boolean, is_accurate boolean, raw_track_status string")
    weather = [(1, 0, 20.0, 30.0, 50.0, False, 1)] + ([(1, 600000, 1.0, 2.0, 3.0, True, 2)] if future else [])
    sky = spark.createDataFrame(weather, "session_id int, session_time_ms long, air_temperature_c double, track_temperature_c double, humidity_percent double, rainfall boolean, event_id long")
    control = spark.createDataFrame([(1, 5000, "x", "clear", 1)], "session_id int, session_time_ms long, message string, track_status string, event_id long")
    pits = spark.createDataFrame([(1, 1, 1, 1, 85000, 95000, 10000)], "session_id int, driver_id int, stop_number int, lap_number int, pit_in_time_ms long, pit_out_time_ms long, pit_lane_duration_ms long")
    places = spark.createDataFrame([(1, 1, n * 90000, 1) for n in range(1, 7)], "session_id int, driver_id int, session_time_ms long, position int")
    return M.label_laps(spark.createDataFrame(laps, schema), sky, control, pits, places)


def test_features_are_causal(spark):
    names = list(M.FEATURES)

    def at(future):
        rows = M.features(session(spark, future)).where("lap_number <= 6").select("lap_number", "feature_reason", *names)
        return sorted(map(str, rows.collect()))

    assert at(0) == at(5000)
    rows = {r["lap_number"]: r for r in M.features(session(spark)).collect()}
    assert [rows[n]["feature_reason"] for n in (1, 2, 3)] == ["opening_lap", "pit_cycle", "insufficient_clean_history"]
    last = rows[6]
    assert last["feature_reason"] is None and last["pit_count"] == 1 and last["rolling_median_3_ms"] == 90500.0
    assert last["rolling_trend_3_ms"] == 100.0 and abs(last["rolling_std_3_ms"] - np.std([90400, 90500, 90600])) < 1e-9
    paced = {r["lap_number"]: r for r in M.pace_examples(M.features(session(spark))).collect()}
    assert paced[4]["rejection"] is None and paced[4]["target_lap_time_ms"] == 90500.0 and paced[6]["rejection"] == "pace:missing_target"


def test_restart_uses_up_the_red_flag(spark):
    feed = [(1, 10, "x", "red-flag", 1), (1, 20, " STARTED ", "clear", 2), (1, 30, "started", "clear", 3), (1, 40, "started", "red-flag", 4)]
    df = spark.createDataFrame(feed, "session_id int, session_time_ms long, message string, track_status string, event_id long")
    for width in (None, 15):
        assert sorted(r["restart_ms"] for r in M.restart_times(df, width).collect()) == [20, 40]


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) * [1, 50, 3, 0.1]
    y = x @ [2.0, 0.5, -1.0, 3.0] + rng.normal(size=200)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{n} double" for n in [*names, "y"]))
    model = L.fit_ridge(df, names, "y", 25.0)
    z = (x - x.mean(0)) / np.maximum(1.0, x.std(0))
    want = np.linalg.solve(z.T @ z + 25 * np.eye(4), z.T @ (y - y.mean()))
    assert np.allclose(model.coefficients, want)
    got = [r[0] for r in df.select(L.score_ridge(L.Ridge.from_json(model.to_json()))).collect()]
    assert np.allclose(got, y.mean() + z @ want)


def paths(spark, a, b, modes=("lower-90", "point", "upper-90"), horizon=0.0):
    rows = []
    for i in range(100):
        for s, wins in (("A", a), ("B", b)):
            rows.append((s, i, 1 if i < wins else 2, 10, 1000.0 + i + (s == "B"), i < horizon * 100, modes[i % 3]))
    return spark.createDataFrame(rows, "strategy_id string, iteration int, position int, classified_laps int, final_time_ms double, local_horizon_exceeded boolean, pit_loss_mode string")


def test_guard_reasons(spark):
    def decide(rows, limited):
        field = spark.createDataFrame([(1, limited)], "race int, limited_field boolean")
        return S.recommendations(rows.withColumn("race", F.lit(1)), field, ["race"], 100).head()

    clear = decide(paths(spark, 90, 10), False)
    assert clear["leading"] == "A" and clear["recommended"] == "A" and clear["guard_reasons"] == []
    limited = decide(paths(spark, 90, 10, horizon=0.6), True)
    assert limited["recommended"] is None
    assert limited["guard_reasons"] == ["local_tyre_horizon_exceeded", "incomplete_or_fallback_background_field"]


def test_projection_fixture(spark):
    counts = spark.createDataFrame([("old/race", 2), ("new/practice-1", 1)], "stratum string, completed_count long")
    samples = spark.createDataFrame([("old/race", 100), ("old/race", 200), ("new/practice-1", 20)], "stratum string, bytes long")
    row = projection_totals(stratified_distribution(counts, samples, 50)).head()
    assert (row["expected_bytes"], row["stress_bytes"], row["completed"]) == (320, 420, 3)


def test_quality_verdicts(spark):
    res = "race_id int, session_id int, driver_id int, grid_position int, finish_position int, laps_completed int"
    lap = "race_id int, session_id int, driver_id int, lap_number int, row_index int, position int, lap_time_ms long"
    pit = "race_id int, session_id int, driver_id int, stop_number int, lap_number int, duration_ms long"
    races = [1, 2, 3, 4, 5, 6]
    results = [(r, r, 1, 1, 1, 2) for r in races if r != 5]
    laps = [(r, r, 1, n, n, 1, 90000) for r in (1, 2, 4, 6) for n in (1, 2)] + [(3, 3, 1, 1, 1, 1, -5)]
    pits = [(1, 1, 1, 1, 1, 20000), (2, 2, 1, 2, 2, 20000), (4, 4, 9, 1, 1, 20000)]
    seasons = spark.createDataFrame([(r, 2015) for r in [*races, 7]], "race_id int, season int")
    results.append((7, 7, 1, 1, 1, 2))
    got = {r["race_id"]: r for r in evaluate(spark.createDataFrame(results, res), spark.createDataFrame(laps, lap), spark.createDataFrame(pits, pit), seasons).collect()}
    assert {k: v["status"] for k, v in got.items()} == {1: "verified", 2: "good", 3: "degraded", 4: "degraded", 5: "unusable", 6: "good", 7: "partial"}
    assert got[2]["reasons"] == ["pit_stop_sequence_gap"] and got[4]["reasons"] == ["pit_driver_missing_result"]
    assert got[6]["reasons"] == ["pit_stop_rows_not_present"] and got[7]["reasons"] == ["missing_lap_data"]


def test_table_round_trip(spark, tmp_path):
    root = str(tmp_path)
    empty = tables.read_table(spark, root, "laps", schemas.ARCHIVE["laps"])
    assert empty.count() == 0 and "lap_time_ms" in empty.columns
    df = spark.createDataFrame([("s", "d", 1, 1, 90000, None, False)], schemas.ARCHIVE["laps"])
    tables.write_table(df, f"{root}/laps", ["session_id"])
    back = tables.read_table(spark, root, "laps", schemas.ARCHIVE["laps"])
    assert back.where("session_id = 's'").head()["lap_time_ms"] == 90000
    for ddl in schemas.CANONICAL.values():
        assert spark.createDataFrame([], ddl).count() == 0
    with pytest.raises(ValueError):
        tables.rename_native(spark.createDataFrame([(1,)], "quality_flags int"))


def test_csv_dump(spark, tmp_path):
    files = {
        "season": "id,year\n1,2021", "round": "id,season_id,circuit_id,number,name,date\n5,1,9,3,GP,2021-05-01",
        "circuit": "id,name,reference\n9,Ring,ring", "session": "id,round_id,type\n7,5,R\n8,5,Q",
        "driver": "id,reference,abbreviation,forename,surname\n2,max,,Max, V ", "team": "id,reference,name\n3,rb,RB",
        "team_driver": "id,driver_id,team_id\n4,2,3", "round_entry": "id,team_driver_id,car_number\n6,4,33",
        "session_entry": "id,session_id,round_entry_id,grid,position,points,laps_completed,detail,status,is_classified,time\n"
                         "10,7,6,1.0,2,18,50,,Finished,t,1:30:00.5\n11,8,6,1,1,0,1,,Finished,t,",
        "lap": "id,session_entry_id,number,position,time,average_speed,is_entry_fastest_lap\n20,10,1,2,1:30.123,,True\n21,11,1,1,1:20.0,,",
        "pit_stop": "session_entry_id,number,lap_id,duration,local_timestamp\n10,1,20,22.5,12:00\n10,2,99,oops,",
    }
    for name, body in files.items():
        (tmp_path / dump.FILES[name]).write_text(body + "\n")
    events, results, laps, stops = dump.load_dump(spark, str(tmp_path))
    assert events.head()["session_id"] == "archive-2021-round-03-race"
    row = results.head()
    assert results.count() == 1 and row["driver_name"] == "Max V" and row["status"] == "Finished" and row["total_time_ms"] == 5400500
    assert [(r["lap_number"], r["lap_time_ms"], r["is_fastest_lap"]) for r in laps.collect()] == [(1, 90123, True)]
    assert sorted((r["stop_number"], r["lap_number"], r["duration_ms"]) for r in stops.na.fill(-1).collect()) == [(1, 1, 22500), (2, -1, -1)]


def test_lossless_round_trip(spark):
    docs = ['{"b":[1,{"x":null}],"a":"q\\"uote","c":null}', "{}", '{"n":12345678901234567890,"t":true}']
    df = spark.createDataFrame([(d,) for d in docs], "json string")
    back = [r["json"] for r in lossless.restore_cells(lossless.lossless_cells(df).drop("json")).collect()]
    assert [json.loads(b) for b in back] == [json.loads(d) for d in docs]


def test_status_stream(spark):
    body = "﻿00:00:01.000{\"Status\":\"Started\"}\r\n00:00:02.000{\"Status\":\"Finalised\"}\n00:00:02.000{\"Status\":\"Ends\"}\n00:00:01.500{}\nbad\n"
    lines = feeds.split_lines(spark.createDataFrame([(1, body)], "session_id int, body string"))
    rows = feeds.parse_status_lines(lines).orderBy("number").collect()
    assert [r["status"] for r in rows] == ["Started", "Finalised", "Ends", None, None]
    assert [r["issues"] for r in rows] == [[], [], [], ["malformed-record", "nonmonotonic"], ["invalid-timestamp", "malformed-record"]]
    assert rows[2]["note"] == "coincident-terminal-progression"


def test_schedule(spark):
    columns = {"round_number": {"0": 0, "1": 2}, "country": {"0": "A", "1": "B"}, "location": {"0": "x", "1": "y"},
               "event_name": {"0": "Test", "1": "GP"}, "gmt_offset": {"0": None, "1": "-03:00"}}
    for n in range(1, 6):
        columns[f"session{n}"] = {"0": "Day 1", "1": "Race" if n == 5 else None}
        columns[f"session{n}_date"] = {"0": None, "1": "2024-05-01T14:00:00" if n == 5 else None}
    years = spark.createDataFrame([(2024, json.dumps(columns))], "season int, payload string")
    now = F.lit("2025-01-01").cast("timestamp")
    rows = feeds.unpivot_sessions(feeds.flatten_schedule(years), now).collect()
    assert [(r["session_id"], str(r["scheduled_at"]), r["completion"]) for r in rows] == [("2024-02-race", "2024-05-01 17:00:00", "past-unverified")]
