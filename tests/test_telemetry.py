"""Telemetry contracts: constant speed, corners, gaps, no extrapolation."""

import pytest
from pyspark.sql import functions as F

from lapwing.operators import telemetry as X

LAP = "lap_id int, elapsed_s double, distance_m double, speed_kmh double, throttle_percent double, brake boolean, gear int"


def trace(spark, rows):
    return spark.createDataFrame(rows, LAP)


@pytest.fixture(scope="module")
def constant(spark):
    a = [(1, float(i), 10.0 * i, 36.0, 50.0, False, 3) for i in range(11)]
    b = [(2, 0.5 * i, 10.0 * i, 72.0, 50.0, False, 5) for i in range(11)]
    return trace(spark, a + b)


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, 1, 2)], "pair_id int, lap_a int, lap_b int")


@pytest.mark.parametrize("width", [None, 25.0])
def test_constant_speed_delta(constant, pair, width):
    rows = X.align_laps(constant, pair, ["speed_kmh", "gear"], 1.0, chunk_rows=width).orderBy("grid_index").collect()
    assert len(rows) == 101 and rows[-1]["distance_m"] == 100.0
    assert abs(rows[-1]["delta_s"] - 5.0) < 1e-9 and rows[-1]["elapsed_s_a"] == 10.0
    assert all(abs(r["delta_s"] - r["distance_m"] * 0.05) < 1e-9 for r in rows)
    assert {r["gear_a"] for r in rows} == {3}


def test_microsectors_sum_to_delta(spark, constant, pair):
    support = spark.createDataFrame([(1, 1, 2, 0.0, 100.0)], "pair_id int, lap_a int, lap_b int, start_m double, end_m double")
    sectors = X.microsectors(constant, support, 5)
    rows = sectors.collect()
    assert len(rows) == 5 and abs(sum(r["delta_s"] for r in rows) - 5.0) < 1e-9
    summary = X.microsector_summary(sectors.withColumns({c: F.round(c, 9) for c in ("time_a_s", "time_b_s", "delta_s")})).head()
    assert summary["largest_gain_b"] == 1 and summary["largest_gain_a"] is None and summary["fastest_a"] == 1
    with pytest.raises(ValueError):
        X.microsectors(constant, support, 4)


def test_gap_masks_and_no_extrapolation(spark):
    t = trace(spark, [(1, 0.0, 0.0, 10.0, 0.0, True, 1), (1, 1.0, 10.0, 20.0, 0.0, True, 2), (1, 9.0, 20.0, 30.0, 0.0, False, 3)])
    points = spark.createDataFrame([(1, 5.0), (1, 15.0), (1, 25.0), (1, 10.0), (1, 20.0)], "lap_id int, at double")
    got = {r["at"]: r for r in X.resample(t, points, ["speed_kmh", "gear", "brake"]).collect()}
    assert got[5.0]["elapsed_s"] == 0.5 and got[5.0]["gear"] == 1 and got[5.0]["brake"]
    assert got[15.0]["elapsed_s"] is None and got[25.0]["speed_kmh"] is None
    assert got[10.0]["gear"] == 2 and got[20.0]["elapsed_s"] == 9.0


def corner(spark):
    speed = [100, 90, 80, 70, 60, 50, 60, 70, 80, 90, 100]
    gear = [6, 6, 5, 5, 4, 3, 4, 5, 5, 6, 6]
    throttle = [100, 100, 0, 0, 0, 0, 40, 100, 100, 100, 100]
    return trace(spark, [(1, float(i), 10.0 * i, float(speed[i]), float(throttle[i]), 2 <= i <= 4, gear[i]) for i in range(11)])


@pytest.mark.parametrize("width", [None, 30.0])
def test_corner_metrics(spark, width):
    windows = spark.createDataFrame([(1, 1, 0.0, 100.0)], "lap_id int, window_id int, low_m double, high_m double")
    points = X.window_points(corner(spark), windows, ["speed_kmh", "throttle_percent", "brake", "gear"], chunk_rows=width)
    m = X.window_metrics(points, 0.2, width).head()
    assert (m["entry_speed"], m["minimum_speed"], m["exit_speed"], m["gear_at_minimum"], m["time_s"]) == (100.0, 50.0, 100.0, 3, 10.0)
    assert m["brake_onset_m"] == 20.0 and m["brake_release_m"] == 50.0
    assert m["throttle_pickup_m"] == 55.0
    assert abs(m["full_throttle_m"] - (60 + 10 * 58 / 60)) < 1e-9


def test_window_time_needs_every_segment(spark):
    t = trace(spark, [(1, 0.0, 0.0, 1.0, 0.0, True, 1), (1, 5.0, 50.0, 1.0, 0.0, True, 1), (1, 6.0, 60.0, 1.0, 0.0, True, 1)])
    windows = spark.createDataFrame([(1, 1, 0.0, 60.0), (1, 2, 60.0, 60.5)], "lap_id int, window_id int, low_m double, high_m double")
    got = {r["window_id"]: r["time_s"] for r in X.window_times(X.window_points(t, windows, ["speed_kmh"])).collect()}
    assert got == {1: None, 2: None}


@pytest.mark.parametrize("width", [None, 3 * 10**9])
def test_slice_edges(spark, width):
    samples = spark.createDataFrame(
        [(1, int(s * 1e9), v) for s, v in ((0.5, 10.0), (1.5, 20.0), (2.5, 30.0), (6.0, 60.0), (7.0, 70.0))],
        "car int, t_ns long, speed_kmh double",
    )
    laps = spark.createDataFrame(
        [(1, 10, 10**9, 2 * 10**9, 1.0, False, False, False, False, True), (1, 11, 2 * 10**9, 65 * 10**8, 4.5, False, False, False, False, True),
         (1, 12, 65 * 10**8, 90 * 10**8, 2.5, False, False, False, False, True), (1, 13, 90 * 10**8, 95 * 10**8, 1.0, True, False, False, False, True)],
        "car int, lap_id int, start_ns long, end_ns long, lap_time_seconds double, pit_in boolean, pit_out boolean, deleted boolean, "
        "provider_generated boolean, reliable boolean",
    )
    rows, verdicts = X.slice_laps(samples, laps, ["car"], ["speed_kmh"], chunk_rows=width)
    v = {r["lap_id"]: r for r in verdicts.collect()}
    assert v[10]["rejected"] is None and v[10]["flags"] == ["interpolated_lap_edge"]
    assert v[11]["rejected"] is None
    assert v[12]["rejected"] == "partial_lap" and v[13]["rejected"] == "pit_in"
    got = sorted((r["t_ns"], r["speed_kmh"]) for r in rows.where("lap_id = 10").collect())
    assert got == [(10**9, 15.0), (15 * 10**8, 20.0), (2 * 10**9, 25.0)]
    kept, _ = X.slice_laps(samples, laps, ["car"], ["speed_kmh"], ("partial",), chunk_rows=width)
    assert kept.where("lap_id = 12").count() == 2


def test_edge_gap_is_not_bridged(spark):
    samples = spark.createDataFrame([(1, 0, 1.0), (1, 5 * 10**9, 2.0), (1, 6 * 10**9, 3.0)], "car int, t_ns long, speed_kmh double")
    laps = spark.createDataFrame(
        [(1, 1, 3 * 10**9, 6 * 10**9, 3.0, False, False, False, False, True)],
        "car int, lap_id int, start_ns long, end_ns long, lap_time_seconds double, pit_in boolean, pit_out boolean, deleted boolean, "
        "provider_generated boolean, reliable boolean",
    )
    v = X.slice_laps(samples, laps, ["car"], ["speed_kmh"])[1].head()
    assert v["rejected"] == "partial_lap" and "lap_edge_gap" in v["flags"]


def test_corner_windows_split_at_midpoints(spark):
    corners = spark.createDataFrame([(1, 1, "", 50.0), (1, 2, "A", 150.0), (1, 3, "", 900.0)], "track int, number int, letter string, distance_m double")
    support = spark.createDataFrame([(1, 7, 0.0, 500.0)], "track int, pair_id int, start_m double, end_m double")
    got = {r["label"]: (r["low_m"], r["high_m"]) for r in X.corner_windows(corners, support, "track").collect()}
    assert got == {"1": (0.0, 100.0), "2A": (100.0, 250.0)}


@pytest.mark.parametrize("width", [None, 2])
def test_repeated_timestamps_are_flagged(spark, width):
    """Two samples at one time inside a lap count, at its edges or outside it they don't; a lap without length does."""
    at = [0, 10, 10, 20, 30, 30, 40, 50, 50, 60, 60, 60, 70, 80]
    samples = spark.createDataFrame([(1, t * 10**9, 100.0 + i) for i, t in enumerate(at)], "car int, t_ns long, speed_kmh double")
    spans = {1: (0, 30), 2: (30, 50), 3: (50, 70), 4: (70, 80), 5: (80, 80)}
    laps = spark.createDataFrame(
        [(1, lap, a * 10**9, b * 10**9, float(b - a), False, False, False, False, True) for lap, (a, b) in spans.items()],
        "car int, lap_id int, start_ns long, end_ns long, lap_time_seconds double, pit_in boolean, pit_out boolean, "
        "deleted boolean, provider_generated boolean, reliable boolean",
    )
    _, verdicts = X.slice_laps(samples, laps, ["car"], ["speed_kmh"], max_edge_gap_s=60.0, chunk_rows=width)
    got = {r["lap_id"] for r in verdicts.collect() if "duplicate_timestamp" in (r["flags"] or "")}
    assert got == {1, 3, 5}
