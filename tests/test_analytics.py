"""Hand-computed races: summaries, outcomes, head-to-head, profiles."""

import pytest
from pyspark.sql import functions as F

from lapwing.functions.values import round_binary
from lapwing.functions.vocab import outcome
from lapwing.operators import analytics as A


@pytest.fixture(scope="module")
def races(spark):
    entries = [
        (1, "a", 3, 1, 10.0, "Finished", True, "one"), (1, "b", 1, None, 0.0, "Engine", False, "two"),
        (1, "c", None, None, 0.0, "Did not start", False, "two"), (1, "d", 4, None, 0.0, "Disqualified", False, "one"),
        (2, "a", 1, 2, 6.0, "+1 Lap", True, "one"), (2, "b", 2, 1, 10.0, "Finished", True, "two"),
        (3, "a", 1, 1, 100.0, "Finished", True, "one"),
    ]
    results = spark.createDataFrame(
        [(f"s{r}", d, d.upper(), t, t, g, f, p, 50 if ok else 20, st, ok) for r, d, g, f, p, st, ok, t in entries],
        "session_id string, driver_id string, driver_name string, team_id string, team_name string, grid_position int, "
        "finish_position int, points double, laps_completed int, status string, classified boolean",
    )
    laps = spark.createDataFrame(
        [(f"s{r}", d, 1, 90000 + r, False) for r, d, *_ in entries if d != "c"],
        "session_id string, driver_id string, lap_number int, lap_time_ms long, is_fastest_lap boolean",
    )
    pits = spark.createDataFrame([("s2", "a", 22000)], "session_id string, driver_id string, duration_ms long")
    events = spark.createDataFrame(
        [(f"e{r}", f"s{r}", 2020, r, f"Race {r}", "2020-01-01", "Sao Paulo!", "completed", q, True, True, r == 2)
         for r, q in ((1, "verified"), (2, "good"), (3, "degraded"))],
        "event_id string, session_id string, season int, round_number int, event_name string, event_date string, "
        "circuit_name string, status string, quality_status string, cap_lap_times boolean, cap_lap_positions boolean, "
        "cap_pit_stops boolean",
    )
    return A.driver_race(results, laps, pits, events).cache()


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_summary(races):
    got = by(A.summary(races, ["driver_id"]), "driver_id")
    a = got["a"]
    assert (a["points"], a["wins"], a["positions_gained"], a["average_finish_samples"], a["race_count"]) == (16.0, 1, 1, 2, 2)
    assert a["pit_stops"] == 1 and got["c"]["pit_stops"] is None and got["b"]["pit_stops"] == 0
    assert (got["b"]["dnf"], got["c"]["dns"], got["d"]["dsq"]) == (1, 1, 1)


def test_outcomes_and_missing(races):
    rows = {(r["session_id"], r["driver_id"]): r for r in races.collect()}
    assert rows["s1", "b"]["outcome"] == "dnf" and rows["s1", "c"]["outcome"] == "dns" and rows["s1", "d"]["outcome"] == "dsq"
    assert rows["s1", "b"]["positions_gained"] is None
    assert rows["s1", "a"]["pit_stop_count"] is None and rows["s2", "b"]["pit_stop_count"] == 0
    assert rows["s2", "a"]["pit_durations_ms"] == [22000]
    assert ("s3", "a") not in rows
    assert rows["s1", "a"]["circuit_id"] == "sao-paulo"


@pytest.mark.parametrize(
    "status, classified, laps, want",
    [
        ("Finished", False, 50, "finished"), ("+2 Laps", False, 48, "classified"), ("Excluded", True, 50, "dsq"),
        ("Withdrew", False, 0, "dns"), ("Withdrew", False, 3, "dnf"), ("Injury", False, None, "dns"),
        ("Did not qualify", False, 0, "dns"), ("Engine", True, 40, "classified"), ("", False, 0, "other"), (None, None, None, "other"),
    ],
)
def test_outcome_rules(spark, status, classified, laps, want):
    df = spark.createDataFrame([(status, classified, laps)], "s string, c boolean, l int")
    assert df.select(outcome(F.col("s"), F.col("c"), F.col("l"))).head()[0] == want


def test_head_to_head(races):
    row = A.driver_head_to_head(races, "a", "b").head()
    assert (row["common_race_count"], row["b_finished_ahead"], row["excluded_non_comparable"], row["denominator"]) == (2, 1, 1, 1)
    teams = A.constructor_head_to_head(races, "one", "two").head()
    assert (teams["a_finished_ahead"], teams["b_finished_ahead"], teams["tied"]) == (1, 1, 0)


def test_progression_is_dense(races):
    rows = A.points_progression(races, "driver_id", "driver_name").collect()
    d = sorted((r["round_number"], r["value"]) for r in rows if r["entity_id"] == "d")
    assert d == [(1, 0.0), (2, 0.0)]


def test_bad_filters(races):
    with pytest.raises(ValueError):
        A.season_filter(races, 1999, 2005)
    with pytest.raises(ValueError):
        A.season_filter(races, 2010, 2005)
    with pytest.raises(ValueError):
        A.ranking_rows(races, "circuit_id", "circuit_name", "points")


def test_round_binary_equals_python(spark):
    values = [0.05 * i for i in range(400)] + [2.675, 1.005, 0.15, 0.25, 1e6 / 7]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", *[round_binary(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2, 3)]).collect()
    for r in got:
        assert [r[f"d{d}"] for d in (0, 1, 2, 3)] == [round(r["v"], d) for d in (0, 1, 2, 3)]
