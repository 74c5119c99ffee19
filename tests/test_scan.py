"""Chunked scans must equal plain windows, also for one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from lapwing.operators.asof import asof_backward, asof_forward, bracket, count_within, unique_within
from lapwing.operators.percentiles import conformal_rank, grouped_percentiles
from lapwing.operators.scan import (
    following,
    islands,
    latest,
    position,
    previous,
    running_max,
    running_min,
    running_sum,
    scan,
    series,
    trailing,
    upcoming,
)


def rows(seed=7, n=600):
    rng = random.Random(seed)
    return [
        (0 if rng.random() < 0.6 else rng.randrange(1, 4), rng.randrange(0, 400), i, rng.choice([None, *range(9)]))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "k int, t long, i int, v int").cache()


def collected(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("width", [1, 17, 100, 1000])
def test_steps(data, width):
    v = F.col("v")
    steps = dict(
        a=latest(v), b=latest(v, inclusive=False), c=upcoming(v), d=previous(v), e=following(v),
        f=running_sum(v), g=running_max(v), h=running_min(v), n=position(), s=running_sum(v, inclusive=False),
        u=upcoming(v, inclusive=True),
    )
    plain = scan(data, series(["k"], ["t", "i"]), **steps).na.fill(-1)
    chunked = scan(data, series(["k"], ["t", "i"], width), **steps).na.fill(-1)
    assert collected(plain) == collected(chunked)


@pytest.mark.parametrize("width", [5, 1000])
def test_null_keys_and_times_keep_their_rows(spark, width):
    """The size of a chunk never changes the answer, whatever is NULL."""
    values = [(None if k == 3 else k, "x" if i % 2 else None, None if i % 50 == 0 else t, i, v) for k, t, i, v in rows(9, 300)]
    data = spark.createDataFrame(values, "k int, g string, t long, i int, v int")
    steps = dict(a=latest(F.col("v")), d=previous(F.col("v")), e=following(F.col("v")), f=running_sum(F.col("v")), n=position())
    keys, order = ["k", "g"], ["t", "i"]
    want = scan(data, series(keys, order), **steps)
    got = scan(data, series(keys, order, width), **steps)
    assert want.count() == got.count() == 300 and got.exceptAll(want).isEmpty()
    plain, cut = (trailing(data, series(keys, order, n), 3, r=F.col("i")) for n in (None, width))
    assert cut.exceptAll(plain).isEmpty() and cut.count() == 300
    shares = grouped_percentiles(data, keys, "v", {"m": 0.5}, width)
    assert shares.count() == data.where("v IS NOT NULL").select(*keys).distinct().count()
    ranks = conformal_rank(data, keys, "v", {"w": 0.8}, width)
    assert ranks.count() == shares.count()


@pytest.mark.parametrize("width", [3, 50])
def test_trailing(data, width):
    plain = trailing(data, series(["k"], ["t", "i"]), 3, r=F.col("i")).withColumn("r", F.col("r").cast("string"))
    chunked = trailing(data, series(["k"], ["t", "i"], width), 3, r=F.col("i")).withColumn("r", F.col("r").cast("string"))
    assert collected(plain.na.fill(-1)) == collected(chunked.na.fill(-1))


def test_islands_bridge_chunks(data):
    state = F.col("t") > 200
    plain = islands(data, series(["k"], ["t", "i"]), state)
    chunked = islands(data, series(["k"], ["t", "i"], 13), state)
    assert collected(plain.na.fill(-1)) == collected(chunked.na.fill(-1))
    assert {r["island"] for r in chunked.collect()} == {1, 2}


def test_global_series(data):
    numbered = scan(data, series([], ["t", "i"], 20), n=position())
    assert sorted(r["n"] for r in numbered.collect()) == list(range(1, 601))


def test_asof_ties_and_edges(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 1), (1, None)], "k int, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "z")], "k int, at long, v string")
    got = {r["t"]: r["v"] for r in asof_backward(left, right, ["k"], "t", "at", ["v"], 3).collect()}
    assert got == {5: "a", 10: "b", 1: None, None: None}
    strict = {r["t"]: r["v"] for r in asof_backward(left, right, ["k"], "t", "at", ["v"], 3, strict=True).collect()}
    assert strict[5] is None and strict[10] == "b"
    ahead = {r["t"]: r["v"] for r in asof_forward(left, right, ["k"], "t", "at", ["v"], 3).collect()}
    assert ahead[5] == "b" and ahead[1] == "a" and ahead[10] is None


def test_bracket(spark):
    points = spark.createDataFrame([(1, 5), (1, 7)], "k int, x long")
    samples = spark.createDataFrame([(1, 5), (1, 8)], "k int, at long")
    got = {r["x"]: (r["before"]["at"], r["after"]["at"]) for r in bracket(points, samples, ["k"], "x", "at", ["at"], 2).collect()}
    assert got == {5: (5, 8), 7: (5, 8)}


def test_count_within_against_brute_force(spark):
    rng = random.Random(3)
    spans = [(1, i, rng.randrange(100), 0) for i in range(60)]
    spans = [(k, i, a, a + rng.randrange(40)) for k, i, a, _ in spans]
    points = [(1, rng.randrange(130), rng.random() < 0.5) for _ in range(200)]
    got = count_within(
        spark.createDataFrame(spans, "k int, i int, a long, b long"),
        spark.createDataFrame(points, "k int, t long, wet boolean"),
        ["k"], ["i"], "a", "b", "t", {"n": F.lit(True), "w": F.col("wet")}, 11,
    )
    for r in got.collect():
        inside = [p for p in points if r["a"] < p[1] <= r["b"]]
        assert (r["n"], r["w"]) == (len(inside), sum(p[2] for p in inside))


def test_unique_within_against_brute_force(spark):
    rng = random.Random(5)
    points = [(1, i, rng.randrange(1000)) for i in range(80)]
    others = [(1, 100 + i, rng.randrange(1000)) for i in range(60)]
    got = unique_within(
        spark.createDataFrame(points, "k int, i int, t long"), spark.createDataFrame(others, "k int, c int, u long"),
        ["k"], ["i"], "t", "u", "c", 9, 50,
    )
    for r in got.collect():
        near = [c for _, c, u in others if abs(u - r["t"]) <= 9]
        assert r["near_c"] == (near[0] if len(near) == 1 else None)


def test_percentiles_and_conformal_rank(spark):
    rng = random.Random(1)
    values = [(rng.choice("ab"), float(rng.randrange(50))) for _ in range(301)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r["g"]: r for r in grouped_percentiles(df, ["g"], "v", {"p": 0.37}, 7).collect()}
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.37)).alias("p")).collect()}
    assert all(abs(got[g]["p"] - want[g]) < 1e-9 for g in want)
    ranked = conformal_rank(df, [], "v", {"w": 0.8}, 7).head()
    ordered = sorted(v for _, v in values)
    assert ranked["w"] == ordered[min(301, -(-302 * 8 // 10)) - 1]


def test_chunks_follow_the_rows(spark):
    """Ten times the rows in the same thirty days make ten times the chunks."""
    from lapwing.operators.scan import KEY, chunked

    def chunks(n):
        month = 30 * 86_400_000
        rows = spark.range(n).select(F.lit("s").alias("k"), (F.col("id") * (month // n)).alias("t"))
        return chunked(rows, series(["k"], ["t"], 100)).select(KEY).distinct().count()

    assert (chunks(1000), chunks(10_000)) == (10, 100)


def test_remaining(spark):
    from lapwing.operators.scan import remaining_min, remaining_sum

    rows = spark.createDataFrame([("a", t, t % 7) for t in range(50)], "k string, t long, v long")
    for size in (None, 3, 20):
        got = scan(rows, series(["k"], ["t"], size), s=remaining_sum(F.col("v")), m=remaining_min(F.col("v")))
        for r in got.collect():
            after = [t % 7 for t in range(r["t"] + 1, 50)]
            assert (r["s"], r["m"]) == ((sum(after), min(after)) if after else (None, None))


def test_sample_targets_have_no_cap(spark):
    from lapwing.operators.projection import stratified_sample

    rows = spark.range(100).withColumn("kind", F.col("id") % 2)
    got = stratified_sample(rows, F.col("kind"), F.when(F.col("kind") == 0, 10).otherwise(2), F.col("id") == 4, "id")
    counts = {r["stratum"]: r["count"] for r in got.groupBy("stratum").count().collect()}
    assert counts == {0: 10, 1: 2} and got.where("pinned").count() == 1


def test_overlay_counts_entries_after_the_cursor(spark):
    from lapwing.operators.strategy import observed_overlay

    rows = spark.createDataFrame([("s", 1, 10), ("s", 1, 30), ("s", 2, 10)], "session_id string, driver_id int, cursor_ms long")
    pits = spark.createDataFrame(
        [("s", 1, 10, 12, 3), ("s", 1, 20, 22, 5), ("s", 1, 40, None, 9), ("s", 1, None, 50, 2)],
        "session_id string, driver_id int, pit_in_time_ms long, pit_out_time_ms long, lap_number int",
    )
    results = spark.createDataFrame([("s", 1, 4)], "session_id string, driver_id int, best int")
    for size in (None, 2):
        got = {(r["driver_id"], r["cursor_ms"]): (r["later_stops"], r["next_stop_lap"]) for r in observed_overlay(rows, results, pits, size).collect()}
        assert got == {(1, 10): (2, 5), (1, 30): (1, 9), (2, 10): (0, None)}


def test_large_values_and_inner_blanks(spark):
    from lapwing.functions.values import as_int, round_binary

    row = spark.range(1).select(
        round_binary(F.lit(1e17), 2).alias("big"), round_binary(F.lit(0.15), 1).alias("low"),
        as_int(F.lit("1 2")).alias("split"), as_int(F.lit(" 12 ")).alias("trimmed"),
    ).first()
    assert tuple(row) == (1e17, 0.1, None, 12)
