"""Lap traces: slicing, distance, resampling, comparison and window analysis.

A trace row is one sample of one lap; all jobs run over many laps at once,
keyed by ``lap_id``.  Slices, windows and micro-sectors are the same cut: spans
on an ordered axis meet samples in one ordered scan, never in a range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.values import interpolate
from lapwing.operators.asof import bracket
from lapwing.operators.scan import (
    following,
    latest,
    position,
    previous,
    running_sum,
    scan,
    series,
    upcoming,
)

DISCRETE = ("gear", "brake", "drs_raw")


def cut(
    samples: DataFrame, spans: DataFrame, by: Sequence[str], axis: str, low: str, high: str,
    fields: Sequence[str], chunk_rows: int | None = None,
) -> DataFrame:
    """Samples strictly inside each span plus both edges with their neighbours.

    Spans of one key must not overlap (they may touch).  Rows carry ``span``
    (all span columns), ``side`` (start, inner, end), ``at``, the structs
    ``before`` (at or before) and ``after`` of ``fields``, and whether the sample
    is ``repeated``: the one before it lies at the same place.
    """
    record = F.struct(F.col(axis).alias("__x"), *fields)
    span = F.struct(*spans.columns)
    marks = samples.select(*by, F.col(axis).alias("__at"), F.lit(1).alias("__side"), record.alias("__s"))
    edges = spans.select(
        *by, span.alias("__span"),
        F.explode(
            F.array(
                F.struct(F.col(low).alias("at"), F.lit(0).alias("side"), F.lit("open").alias("kind")),
                F.struct(F.col(low).alias("at"), F.lit(2).alias("side"), F.lit("start").alias("kind")),
                F.struct(F.col(high).alias("at"), F.lit(2).alias("side"), F.lit("end").alias("kind")),
            )
        ).alias("e"),
    ).select(*by, F.col("e.at").alias("__at"), F.col("e.side").alias("__side"), "__span", F.col("e.kind").alias("__kind"))
    rows = marks.unionByName(edges, allowMissingColumns=True)
    out = scan(
        rows, series(by, ("__at", "__side"), chunk_rows),
        __open=latest(F.when(F.col("__kind") == "open", F.col("__span"))),
        before=latest(F.col("__s")),
        after=upcoming(F.col("__s")),
        __prior=latest(F.col("__s.__x"), inclusive=False),
    )
    inner = F.col("__s").isNotNull()
    within = (F.col("__at") > F.col(f"__open.{low}")) & (F.col("__at") < F.col(f"__open.{high}"))
    kept = out.where((F.col("__kind") != "open") | (inner & F.coalesce(within, F.lit(False))))
    return kept.select(
        *by,
        F.when(inner, F.col("__open")).otherwise(F.col("__span")).alias("span"),
        F.when(inner, "inner").otherwise(F.col("__kind")).alias("side"),
        F.col("__at").alias("at"), "before", "after",
        (inner & F.coalesce(F.col("__prior") == F.col("__at"), F.lit(False))).alias("repeated"),
    )


def _at(field: str, discrete: bool, allowed: Column) -> Column:
    """Value at a cut or grid point from its neighbours, NULL where not allowed."""
    b, a = F.col("before"), F.col("after")
    if field in dict.fromkeys(DISCRETE):
        discrete = True
    fraction = (F.col("at") - b["__x"]) / (a["__x"] - b["__x"])
    exact = b["__x"] == F.col("at")
    return F.when(exact, b[field]).when(
        allowed, interpolate(b[field], a[field], fraction, discrete)
    )


REJECTIONS = ("pit_in", "pit_out", "deleted", "provider_generated", "unreliable")


def slice_laps(
    samples: DataFrame, laps: DataFrame, by: Sequence[str], channels: Sequence[str],
    allow: Sequence[str] = (), max_edge_gap_s: float = 2.0, chunk_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trace rows, one verdict per lap).

    ``samples``: by, t_ns, channels.  ``laps``: by, lap_id, start_ns, end_ns,
    lap_time_seconds and the booleans pit_in, pit_out, deleted,
    provider_generated, reliable.  Edges are interpolated when the bracketing
    gap allows; ``allow`` may name rejections to accept, ``partial`` included.
    """
    cols = [*by, "lap_id", "start_ns", "end_ns"]
    pieces = cut(samples, laps.select(*cols), by, "t_ns", "start_ns", "end_ns", channels, chunk_rows)
    gap_ok = (F.col("after.__x") - F.col("before.__x")) / 1e9 <= max_edge_gap_s
    bracketed = F.col("before").isNotNull() & F.col("after").isNotNull()
    exact = F.coalesce(F.col("before.__x") == F.col("at"), F.lit(False))
    inner = F.col("side") == "inner"
    usable = inner | exact | (bracketed & gap_ok)
    rows = pieces.select(
        F.col("span.lap_id").alias("lap_id"), F.col("span.start_ns").alias("start_ns"), F.col("span.end_ns").alias("end_ns"),
        "side", F.col("at").alias("t_ns"),
        usable.alias("usable"),
        (~inner & ~exact & bracketed & ~gap_ok).alias("edge_gap"),
        (~inner & ~exact & usable).alias("interpolated"),
        # A lap without length begins and ends at one time.
        (F.col("repeated") | (usable & (F.col("side") == "end") & (F.col("at") == F.col("span.start_ns")))).alias("repeated"),
        *[_at(c, c in DISCRETE, usable).alias(c) for c in channels],
    )
    trace = rows.where("usable").select(
        "lap_id", "side", "t_ns", ((F.col("t_ns") - F.col("start_ns")) / 1e9).alias("elapsed_s"), *channels
    )
    # A stretch without a speed has no distance, so the lap has none either.
    speed = F.col("speed_kmh").cast("double") if "speed_kmh" in channels else F.lit(0.0)
    bad_speed = speed.isNull() | F.isnan(speed) | (speed < 0) | (speed == float("inf"))
    facts = rows.groupBy("lap_id").agg(
        F.count(F.when(F.col("usable"), 1)).alias("samples"),
        F.bool_or((F.col("side") == "start") & F.col("usable")).alias("start_covered"),
        F.bool_or((F.col("side") == "end") & F.col("usable")).alias("finish_covered"),
        F.bool_or("interpolated").alias("interpolated"), F.bool_or("edge_gap").alias("edge_gap"),
        F.bool_or(F.col("usable") & bad_speed).alias("bad_speed"), F.bool_or("repeated").alias("repeated"),
    )
    joined = laps.join(facts, "lap_id", "left")
    no = F.lit(False)
    facts_by_name = {
        "pit_in": F.coalesce("pit_in", no), "pit_out": F.coalesce("pit_out", no),
        "deleted": F.coalesce("deleted", no), "provider_generated": F.coalesce("provider_generated", no),
        "unreliable": ~F.coalesce("reliable", no),
    }
    allowed = set(allow)
    pit_ok = "pit" in allowed
    reason = F.lit(None).cast("string")
    short = F.coalesce("samples", F.lit(0)) < 2
    partial = ~(F.coalesce("start_covered", no) & F.coalesce("finish_covered", no))
    rules = [
        (facts_by_name[n], n) for n in REJECTIONS
        if n not in allowed and not (pit_ok and n in ("pit_in", "pit_out"))
    ]
    rules.append((short, "insufficient_lap_overlap"))
    if "partial" not in allowed:
        rules.append((partial, "partial_lap"))
    rules.append((F.coalesce("repeated", no), "duplicate_timestamp"))
    rules.append((F.coalesce("bad_speed", no), "invalid_speed"))
    for cond, code in reversed(rules):
        reason = F.when(cond, F.lit(code)).otherwise(reason)
    flags = F.array_compact(
        F.array(
            *[F.when(facts_by_name[n], F.lit(n)) for n in REJECTIONS],
            F.when(F.coalesce("repeated", no), "duplicate_timestamp"),
            F.when(F.coalesce("interpolated", no), "interpolated_lap_edge"),
            F.when(F.coalesce("edge_gap", no), "lap_edge_gap"),
            F.when(partial & ~short, "partial_lap"),
            F.when(F.coalesce("bad_speed", no), "invalid_speed"),
        )
    )
    verdict = joined.select(
        *laps.columns, F.coalesce("samples", F.lit(0)).alias("samples"),
        F.coalesce("start_covered", no).alias("start_covered"),
        F.coalesce("finish_covered", no).alias("finish_covered"),
        flags.alias("flags"), reason.alias("rejected"),
    )
    kept = trace.join(verdict.where(F.col("rejected").isNull()).select("lap_id"), "lap_id", "left_semi")
    return kept, verdict


def integrate_distance(trace: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Distance by the trapezoid rule over speed in km/h."""
    s = series(("lap_id",), ("elapsed_s",), chunk_rows)
    paired = scan(trace, s, __p=previous(F.struct("elapsed_s", "speed_kmh")))
    step = (F.col("__p.speed_kmh") + F.col("speed_kmh")) / 7.2 * (F.col("elapsed_s") - F.col("__p.elapsed_s"))
    stepped = paired.withColumn("__d", F.when(F.col("__p").isNull(), 0.0).otherwise(step)).drop("__p")
    return scan(stepped, s, distance_m=running_sum(F.col("__d"))).drop("__d")


def order_flags(df: DataFrame, keys: Sequence[str], row: str, value: str, chunk_rows: int | None = None) -> DataFrame:
    """Whether a column repeats, decreases or is not finite in stored order."""
    chain = scan(df, series(keys, (row,), chunk_rows), __p=previous(F.col(value)))
    v, p = F.col(value), F.col("__p")
    finite = ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    no = F.lit(False)
    return chain.groupBy(*keys).agg(
        F.bool_or(F.coalesce(v == p, no)).alias(f"duplicate_{value}"),
        F.bool_or(F.coalesce(v < p, no)).alias(f"decreasing_{value}"),
        F.bool_or(~F.coalesce(finite, no)).alias(f"nonfinite_{value}"),
    )


def distance_grid(
    trace: DataFrame, pairs: DataFrame, spacing_m: float = 1.0, union: bool = False, chunk_rows: int | None = None,
) -> DataFrame:
    """Grid of each pair on its common support.

    Fixed spacing from the common start plus the common end, or with ``union``
    every native distance of both laps, numbered in chunks of ``chunk_rows``.
    Pairs without overlap have no grid; ``comparison_summary`` names them.
    """
    support = trace.groupBy("lap_id").agg(F.min("distance_m").alias("lo"), F.max("distance_m").alias("hi"))
    a = support.select(F.col("lap_id").alias("lap_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    b = support.select(F.col("lap_id").alias("lap_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    common = (
        pairs.select("pair_id", "lap_a", "lap_b").join(a, "lap_a").join(b, "lap_b")
        .withColumn("start_m", F.greatest("lo_a", "lo_b"))
        .withColumn("end_m", F.least("hi_a", "hi_b"))
        .where(F.col("end_m") > F.col("start_m"))
    )
    head = ["pair_id", "lap_a", "lap_b", "start_m", "end_m"]
    if not union:
        count = F.ceil((F.col("end_m") - F.col("start_m")) / F.lit(spacing_m)).cast("int")
        return (
            common.withColumn("n", count)
            .select(*head, "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("grid_index"))
            .withColumn(
                "at",
                F.when(F.col("grid_index") == F.col("n"), F.col("end_m")).otherwise(
                    F.col("start_m") + F.col("grid_index") * F.lit(float(spacing_m))
                ),
            )
            .drop("n")
        )
    sides = common.select(*head, F.explode(F.array("lap_a", "lap_b")).alias("lap_id"))
    native = sides.join(trace.select("lap_id", F.col("distance_m").alias("at")), "lap_id").where(
        F.col("at").between(F.col("start_m"), F.col("end_m"))
    ).select(*head, "at")
    ends = common.select(*head, F.explode(F.array("start_m", "end_m")).alias("at"))
    points = native.unionByName(ends).distinct()
    return scan(points, series(("pair_id",), ("at",), chunk_rows), grid_index=position()).withColumn(
        "grid_index", (F.col("grid_index") - 1).cast("int")
    )


def resample(
    trace: DataFrame, points: DataFrame, channels: Sequence[str],
    max_gap_m: float = 100.0, max_gap_s: float = 2.0, chunk_rows: int | None = None,
) -> DataFrame:
    """Time and channels at each (lap_id, at); gaps too wide give NULL.

    Discrete channels hold the value on the left; nothing is extrapolated.
    """
    samples = trace.select(
        "lap_id", F.col("distance_m").alias("__x"), F.col("elapsed_s"), *channels
    )
    near = bracket(points, samples, ["lap_id"], "at", "__x", ["__x", "elapsed_s", *channels], chunk_rows)
    b, a = F.col("before"), F.col("after")
    ok = ((a["__x"] - b["__x"]) <= max_gap_m) & ((a["elapsed_s"] - b["elapsed_s"]) <= max_gap_s)
    return near.select(
        *points.columns,
        _at("elapsed_s", False, ok).alias("elapsed_s"),
        *[_at(c, c in DISCRETE, ok).alias(c) for c in channels],
        (b["__x"] == F.col("at")).alias("native"),
    )


def align_laps(
    trace: DataFrame, pairs: DataFrame, channels: Sequence[str], spacing_m: float = 1.0,
    max_gap_m: float = 100.0, max_gap_s: float = 2.0, union: bool = False, chunk_rows: int | None = None,
) -> DataFrame:
    """Both laps of each pair on one grid; delta is time A minus time B."""
    grid = distance_grid(trace, pairs, spacing_m, union, chunk_rows)
    points = grid.select(
        "pair_id", "grid_index", "at",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("lap_a").alias("lap_id")),
                F.struct(F.lit("b").alias("side"), F.col("lap_b").alias("lap_id")),
            )
        ).alias("x"),
    ).select("pair_id", "grid_index", "at", "x.side", "x.lap_id")
    both = resample(trace, points, channels, max_gap_m, max_gap_s, chunk_rows)

    def pick(side: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}_{side}")

    merged = both.groupBy("pair_id", "grid_index").agg(
        F.max("at").alias("distance_m"),
        *[pick(side, c) for side in ("a", "b") for c in ("elapsed_s", *channels)],
    )
    return merged.withColumn("delta_s", F.col("elapsed_s_a") - F.col("elapsed_s_b"))


def comparison_summary(aligned: DataFrame, trace: DataFrame, pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """End delta, observed delta and their agreement of every pair.

    A pair that cannot be compared has ``refused``: ``trace_rejected`` if a lap has no trace, ``no_common_distance`` if
    the laps share no stretch.
    """
    ends = aligned.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.min("distance_m").alias("start_m"), F.max("distance_m").alias("end_m"),
        F.max_by("delta_s", "grid_index").alias("end_delta_s"),
        F.bool_or(F.col("delta_s").isNull()).alias("interpolation_gaps"),
    )
    facts = trace.groupBy("lap_id").agg(F.min("distance_m").alias("lo"), F.max("distance_m").alias("hi")).join(
        verdicts.select("lap_id", "start_covered", "finish_covered", "lap_time_seconds"), "lap_id"
    )

    def side(x: str) -> DataFrame:
        return facts.select(*[F.col(c).alias(f"{c}_{x}") for c in facts.columns])

    joined = (
        pairs.select("pair_id", F.col("lap_a").alias("lap_id_a"), F.col("lap_b").alias("lap_id_b"))
        .join(ends, "pair_id", "left").join(side("a"), "lap_id_a", "left").join(side("b"), "lap_id_b", "left")
    )
    refused = F.when(F.col("lo_a").isNull() | F.col("lo_b").isNull(), "trace_rejected").when(
        F.col("points").isNull(), "no_common_distance"
    )
    covered = F.col("start_covered_a") & F.col("start_covered_b") & F.col("finish_covered_a") & F.col("finish_covered_b")
    same = (
        (F.col("lo_a") == F.col("lo_b")) & (F.col("start_m") == F.col("lo_a"))
        & (F.col("hi_a") == F.col("hi_b")) & (F.col("end_m") == F.col("hi_a"))
    )
    observed = F.col("lap_time_seconds_a") - F.col("lap_time_seconds_b")
    finish = covered & same
    return joined.select(
        "pair_id", "points", "start_m", "end_m", "end_delta_s", observed.alias("observed_delta_s"),
        finish.alias("finish_comparable"),
        F.when(finish, F.col("end_delta_s") - observed).alias("error_s"), "interpolation_gaps",
        refused.alias("refused"),
    )


def align_positions(
    points: DataFrame, positions: DataFrame, by: Sequence[str], max_gap_s: float = 2.0, chunk_rows: int | None = None
) -> DataFrame:
    """x, y, z at each (by, t_ns) of ``points``; wide gaps and ends give NULL."""
    near = bracket(
        points.withColumn("at", F.col("t_ns")), positions.withColumn("__x", F.col("t_ns")), by, "at", "__x",
        ["__x", "x", "y", "z"], chunk_rows,
    )
    ok = (F.col("after.__x") - F.col("before.__x")) / 1e9 <= max_gap_s
    return near.select(*points.columns, *[_at(c, False, ok).alias(c) for c in ("x", "y", "z")])


def corner_windows(corners: DataFrame, supports: DataFrame, key: str, half_width_m: float = 100.0) -> DataFrame:
    """Windows around corners, split at neighbour midpoints, clipped to support.

    ``corners``: key, number, letter, distance_m.  ``supports``: key, pair_id,
    start_m, end_m.  A track has at most a few dozen corners.
    """
    s = series((key,), ("distance_m", "number", "letter"))
    chain = scan(corners, s, __p=previous(F.col("distance_m")), __n=following(F.col("distance_m")))
    here = F.col("distance_m")
    rows = chain.join(supports.select(key, "pair_id", "start_m", "end_m"), key).where(
        here.between(F.col("start_m"), F.col("end_m"))
    )
    low = F.greatest(F.col("start_m"), here - half_width_m, (F.col("__p") + here) / 2)
    high = F.least(F.col("end_m"), here + half_width_m, (here + F.col("__n")) / 2)
    return rows.select(
        "pair_id", F.concat(F.col("number").cast("string"), F.coalesce("letter", F.lit(""))).alias("label"),
        low.alias("low_m"), high.alias("high_m"),
    ).where(F.col("high_m") > F.col("low_m"))


def equal_windows(supports: DataFrame, count: int = 10) -> DataFrame:
    """``count`` windows of equal length over each pair's support."""
    span = F.col("end_m") - F.col("start_m")
    i = F.col("window_index")
    edge = lambda k: F.col("start_m") + span * k / F.lit(count)
    return supports.select(
        "pair_id", "start_m", "end_m", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("window_index")
    ).select(
        "pair_id", (i + 1).alias("window_index"), edge(i).alias("low_m"),
        F.when(i == count - 1, F.col("end_m")).otherwise(edge(i + 1)).alias("high_m"),
    )


def both_laps(
    trace: DataFrame, supports: DataFrame, windows: DataFrame, columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """The traces and the windows of both laps of every pair, for one scan over them all.

    ``windows``: pair_id, window_index, low_m, high_m.  A lap is in several pairs, whose windows may overlap, so
    ``lap_id`` becomes the struct of pair, side and lap.
    """
    walk = F.struct("pair_id", "side", "lap").alias("lap_id")
    sides = supports.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("lap_a").alias("lap")),
                F.struct(F.lit("b").alias("side"), F.col("lap_b").alias("lap")),
            )
        ).alias("x"),
    ).select("pair_id", "x.side", "x.lap")
    bare = trace.select("lap_id", "distance_m", *columns)
    return (
        bare.join(sides, F.col("lap_id") == F.col("lap")).select(walk, "distance_m", *columns),
        windows.join(sides, "pair_id").select(walk, F.col("window_index").alias("window_id"), "low_m", "high_m"),
    )


def window_points(
    trace: DataFrame, windows: DataFrame, channels: Sequence[str],
    max_gap_m: float = 100.0, max_gap_s: float = 2.0, chunk_rows: int | None = None,
) -> DataFrame:
    """Ordered points of each window with the segment to the next point.

    ``windows``: lap_id, window_id, low_m, high_m, not overlapping per lap.
    ``ok`` tells whether the segment after the point is supported throughout.
    """
    spans = windows.select("lap_id", "window_id", "low_m", "high_m")
    pieces = cut(trace, spans, ["lap_id"], "distance_m", "low_m", "high_m", ["elapsed_s", *channels], chunk_rows)
    b, a = F.col("before"), F.col("after")
    near = ((a["__x"] - b["__x"]) <= max_gap_m) & ((a["elapsed_s"] - b["elapsed_s"]) <= max_gap_s)
    points = pieces.select(
        "lap_id", F.col("span.window_id").alias("window_id"), "side", F.col("at").alias("d"),
        (F.col("side") == "start").cast("int").alias("__first"),
        (b["__x"] == F.col("at")).alias("native"),
        _at("elapsed_s", False, near).alias("t"),
        *[_at(c, c in DISCRETE, near).alias(c) for c in channels],
    )
    s = series(("lap_id", "window_id"), ("d", "side_order"), chunk_rows)
    order = F.when(F.col("side") == "start", 0).when(F.col("side") == "inner", 1).otherwise(2)
    chain = scan(
        points.withColumn("side_order", order).drop("__first"), s,
        n=following(F.struct("d", "t", "native", *channels)),
    )
    both_native = F.coalesce(F.col("native"), F.lit(False)) & F.coalesce(F.col("n.native"), F.lit(False))
    spaced = ((F.col("n.d") - F.col("d")) <= max_gap_m) & ((F.col("n.t") - F.col("t")) <= max_gap_s)
    ok = F.col("t").isNotNull() & F.col("n.t").isNotNull() & (~both_native | spaced)
    return chain.withColumn("ok", F.when(F.col("n").isNotNull(), F.coalesce(ok, F.lit(False))))


def window_times(points: DataFrame) -> DataFrame:
    """Duration of each window; NULL unless every segment is supported."""
    ends = points.groupBy("lap_id", "window_id").agg(
        F.max(F.when(F.col("side") == "start", F.col("t"))).alias("__t0"),
        F.max(F.when(F.col("side") == "end", F.col("t"))).alias("__t1"),
        F.bool_and("ok").alias("__all"),
    )
    return ends.select(
        "lap_id", "window_id", F.when(F.col("__all"), F.col("__t1") - F.col("__t0")).alias("time_s")
    )


def window_metrics(points: DataFrame, persistence_s: float = 0.2, chunk_rows: int | None = None) -> DataFrame:
    """Entry, minimum and exit speed, gear at the minimum, brake and throttle marks.

    Reads ``points`` several times: hand in a stored table (``session.durable``).
    """
    key = ["lap_id", "window_id"]
    slow = F.struct("speed_kmh", "d", "side_order")
    basics = points.groupBy(*key).agg(
        F.max(F.when(F.col("side") == "start", F.col("speed_kmh"))).alias("entry_speed"),
        F.min("speed_kmh").alias("minimum_speed"),
        F.max(F.when(F.col("side") == "end", F.col("speed_kmh"))).alias("exit_speed"),
        F.min_by("gear", F.when(F.col("speed_kmh").isNotNull(), slow)).alias("gear_at_minimum"),
        F.coalesce(
            F.min_by("d", F.when(F.col("speed_kmh").isNotNull(), slow)), F.min("d")
        ).alias("minimum_at_m"),
    )
    brakes = brake_events(points, persistence_s, chunk_rows)
    from_minimum = points.join(basics.select(*key, "minimum_at_m"), key).where(F.col("d") >= F.col("minimum_at_m"))
    throttle = throttle_onsets(
        from_minimum, {"throttle_pickup_m": 20.0, "full_throttle_m": 98.0}, persistence_s, chunk_rows
    )
    return (
        basics.join(window_times(points), key, "left").join(brakes, key, "left").join(throttle, key, "left")
    )


def brake_events(points: DataFrame, persistence_s: float = 0.2, chunk_rows: int | None = None) -> DataFrame:
    """Onset of the first lasting brake run and the first lasting release after it.

    Runs are maximal stretches of equal brake state over touching supported
    segments; an unsupported stretch after the onset leaves the release unknown.
    """
    key = ("lap_id", "window_id")
    s = series(key, ("d", "side_order"), chunk_rows)
    segments = points.where(F.coalesce("ok", F.lit(False)) & F.col("brake").isNotNull())
    chain = scan(segments, s, __p=previous(F.struct("brake", F.col("n.t").alias("t1"))))
    fresh = F.col("__p").isNull() | (F.col("__p.brake") != F.col("brake")) | (F.col("__p.t1") != F.col("t"))
    gap = F.col("__p").isNotNull() & (F.col("__p.t1") != F.col("t"))
    numbered = scan(
        chain.withColumn("__new", fresh.cast("long")).withColumn("__gap", gap), s, run=running_sum(F.col("__new"))
    )
    runs = numbered.groupBy(*key, "run").agg(
        F.max("brake").alias("active"), F.min("d").alias("from_m"),
        (F.max("n.t") - F.min("t") + 1e-12 >= persistence_s).alias("lasting"),
        F.bool_or("__gap").alias("after_gap"),
    )
    onset = runs.where(F.col("active") & F.col("lasting")).groupBy(*key).agg(
        F.min("run").alias("__on"), F.min_by("from_m", "run").alias("brake_onset_m")
    )
    later = runs.join(onset, list(key)).where(F.col("run") > F.col("__on"))
    ends = later.groupBy(*key).agg(
        F.min(F.when(F.col("after_gap"), F.col("run"))).alias("__gap_run"),
        F.min(F.when(~F.col("active") & F.col("lasting"), F.col("run"))).alias("__off"),
        F.min_by("from_m", F.when(~F.col("active") & F.col("lasting"), F.col("run"))).alias("__off_m"),
    )
    seen = F.col("__gap_run").isNull() | (F.col("__off") < F.col("__gap_run"))
    return onset.join(ends, list(key), "left").select(
        *key, "brake_onset_m", F.when(seen, F.col("__off_m")).alias("brake_release_m")
    )


def throttle_onsets(
    points: DataFrame, thresholds: dict[str, float], persistence_s: float = 0.2, chunk_rows: int | None = None,
) -> DataFrame:
    """Per threshold, the distance where throttle first reaches it and stays there."""
    key = ("lap_id", "window_id")
    keyed = (*key, "mark")
    s = series(keyed, ("d", "side_order"), chunk_rows)
    marks = F.array(
        *[F.struct(F.lit(n).alias("mark"), F.lit(float(v)).alias("level")) for n, v in thresholds.items()]
    )
    rows = points.where(F.col("n").isNotNull()).select(
        *key, "d", "side_order", "t", "n", "ok", "throttle_percent", F.explode(marks).alias("m")
    ).select("*", "m.mark", "m.level")
    a, b, level = F.col("throttle_percent"), F.col("n.throttle_percent"), F.col("level")
    usable = F.coalesce(F.col("ok"), F.lit(False)) & a.isNotNull() & b.isNotNull()
    fraction = (level - a) / (b - a)
    rising = (a < level) & (b >= level)
    falling = (a >= level) & (b < level)
    span_t, span_d = F.col("n.t") - F.col("t"), F.col("n.d") - F.col("d")
    marked = rows.withColumn("__use", usable).select(
        *keyed, "d", "side_order",
        (F.col("__use") & ((a >= level) | (b >= level))).alias("__on"),
        F.when(F.col("__use"), b >= level).otherwise(False).alias("__holds"),
        F.when(F.col("__use"), rising).otherwise(False).alias("__rises"),
        F.when(rising, F.col("t") + fraction * span_t).otherwise(F.col("t")).alias("__t0"),
        F.when(rising, F.col("d") + fraction * span_d).otherwise(F.col("d")).alias("__d0"),
        F.when(falling, F.col("t") + fraction * span_t).otherwise(F.col("n.t")).alias("__t1"),
    )
    chain = scan(marked, s, __p=previous(F.col("__holds")))
    start = F.col("__rises") | ~F.coalesce(F.col("__p"), F.lit(False))
    numbered = scan(
        chain.where(F.col("__on")).withColumn("__new", start.cast("long")), s, run=running_sum(F.col("__new"))
    )
    runs = numbered.groupBy(*keyed, "run").agg(
        F.min("__t0").alias("t0"), F.min("__d0").alias("d0"), F.max("__t1").alias("t1")
    ).where(F.col("t1") - F.col("t0") + 1e-12 >= persistence_s)
    return runs.groupBy(*key).agg(
        *[F.min_by("d0", F.when(F.col("mark") == n, F.col("run"))).alias(n) for n in thresholds]
    )


def microsectors(
    trace: DataFrame, supports: DataFrame, count: int = 20, max_gap_m: float = 100.0, max_gap_s: float = 2.0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Times of both laps in ``count`` equal bins of each pair's support.

    ``supports``: pair_id, lap_a, lap_b, start_m, end_m.  Bins of one lap in
    different pairs may overlap, so the cut is keyed by pair and side.
    """
    if not 5 <= count <= 1000:
        raise ValueError("between 5 and 1000 micro-sectors are supported")
    paired, windows = both_laps(trace, supports, equal_windows(supports, count), ["elapsed_s"])
    times = window_times(window_points(paired, windows, [], max_gap_m, max_gap_s, chunk_rows))
    return times.groupBy(F.col("lap_id.pair_id").alias("pair_id"), F.col("window_id").alias("sector")).agg(
        F.max(F.when(F.col("lap_id.side") == "a", F.col("time_s"))).alias("time_a_s"),
        F.max(F.when(F.col("lap_id.side") == "b", F.col("time_s"))).alias("time_b_s"),
    ).withColumn("delta_s", F.col("time_a_s") - F.col("time_b_s"))


def microsector_summary(sectors: DataFrame) -> DataFrame:
    """Largest gains and fastest/slowest sectors, lowest index on ties."""
    def lowest(c: Column) -> Column:
        return F.min_by("sector", F.when(c.isNotNull(), F.struct(c, "sector")))

    d = F.col("delta_s")
    return sectors.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("sectors"),
        F.when(F.count("delta_s") == F.count(F.lit(1)), F.sum("delta_s")).alias("total_delta_s"),
        F.when(F.min(d) < 0, lowest(d)).alias("largest_gain_a"),
        F.when(F.max(d) > 0, lowest(-d)).alias("largest_gain_b"),
        lowest(F.col("time_a_s")).alias("fastest_a"), lowest(F.col("time_b_s")).alias("fastest_b"),
        lowest(-F.col("time_a_s")).alias("slowest_a"), lowest(-F.col("time_b_s")).alias("slowest_b"),
    )


def lap_catalog(laps: DataFrame, tables: DataFrame) -> DataFrame:
    """Laps with availability flags; repeated laps are marked ambiguous.

    ``tables`` lists (session_id, table_name) of stored telemetry tables.
    """
    stored = tables.groupBy("session_id").agg(F.collect_set("table_name").alias("__t"))
    copies = laps.groupBy("session_id", "driver_id", "lap_number").agg(F.count(F.lit(1)).alias("__n"))
    rows = laps.join(stored, "session_id", "left").join(copies, ["session_id", "driver_id", "lap_number"])
    no = F.lit(False)

    def has(prefix: str) -> Column:
        return F.coalesce(F.array_contains("__t", F.concat(F.lit(prefix), F.col("driver_id").cast("string"))), no)

    seconds = {f"sector_{i}_seconds": F.col(f"sector_{i}_ns") / 1e9 for i in (1, 2, 3) if f"sector_{i}_ns" in laps.columns}
    return rows.select(
        "session_id", "driver_id", "lap_number", (F.col("lap_time_ns") / 1e9).alias("lap_time_seconds"),
        *[c.alias(n) for n, c in seconds.items()],
        F.coalesce("is_accurate", no).alias("reliable"), F.coalesce("is_deleted", no).alias("deleted"),
        F.coalesce("is_generated", no).alias("provider_generated"),
        F.col("pit_in_ns").isNotNull().alias("pit_in"), F.col("pit_out_ns").isNotNull().alias("pit_out"),
        F.coalesce((F.col("start_ns") >= 0) & (F.col("lap_time_ns") > 0), no).alias("timing_available"),
        has("car-data-").alias("car_available"), has("pos-data-").alias("position_available"),
        (F.col("__n") > 1).alias("ambiguous"),
    )


def fastest_valid_lap(catalog: DataFrame) -> DataFrame:
    """Fastest usable lap per (session, driver)."""
    good = (
        F.col("reliable") & ~F.col("deleted") & ~F.col("provider_generated") & ~F.col("pit_in") & ~F.col("pit_out")
        & F.col("car_available") & F.col("timing_available") & (F.col("lap_time_seconds") > 0)
    )
    return catalog.where(good).groupBy("session_id", "driver_id").agg(
        F.min_by("lap_number", F.struct("lap_time_seconds", "lap_number")).alias("lap_number"),
        F.min("lap_time_seconds").alias("lap_time_seconds"),
    )


def session_clock(samples: DataFrame, laps: DataFrame) -> DataFrame:
    """Verified session time of each sample, with where it came from.

    Native ``session_time_ns`` wins; else instant minus the origin that at least
    two laps (start instant, start time) agree on; else no clock.
    """
    origins = laps.where(F.col("start_instant_ns").isNotNull() & F.col("start_ns").isNotNull()).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(F.col("start_instant_ns") - F.col("start_ns")).alias("__lo"),
        F.max(F.col("start_instant_ns") - F.col("start_ns")).alias("__hi"),
    ).where((F.col("__n") >= 2) & (F.col("__lo") == F.col("__hi"))).select("session_id", F.col("__lo").alias("origin_ns"))
    derived = F.col("instant_ns") - F.col("origin_ns")
    return samples.join(origins, "session_id", "left").withColumn(
        "clock_source",
        F.when(F.col("session_time_ns").isNotNull(), "native-session-time")
        .when(derived.isNotNull(), "date-minus-verified-lap-origin").otherwise("no-reliable-clock"),
    ).withColumn("clock_ns", F.coalesce("session_time_ns", derived))


def downsample(trace: DataFrame, key: str, x: str, value: str, budget: int, chunk_rows: int | None = None) -> DataFrame:
    """Rows that keep a trace's shape: ends, bucket ends, minima, maxima, NULL edges."""
    s = series((key,), (x,), chunk_rows)
    numbered = scan(trace, s, __n=position(), __p=previous(F.struct(F.col(value).alias("v"))))
    totals = trace.groupBy(key).agg(F.count(F.lit(1)).alias("__total"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("__total") / F.lit(budget / 4)))
    rows = numbered.join(totals, key).withColumn("__i", F.col("__n") - 1).withColumn(
        "__b", F.when(F.col("__total") > budget, F.floor(F.col("__i") / stride))
    )
    v = F.col(value)
    extremes = rows.where(F.col("__b").isNotNull()).groupBy(key, "__b").agg(
        F.min("__i").alias("__first"), F.max("__i").alias("__last"),
        F.min_by("__i", F.when(v.isNotNull(), F.struct(v, "__i"))).alias("__lo"),
        F.max_by("__i", F.when(v.isNotNull(), F.struct(v, -F.col("__i")))).alias("__hi"),
    )
    joined = rows.join(extremes, [key, "__b"], "left")
    i = F.col("__i")
    edge = v.isNull() | (F.col("__p").isNotNull() & F.col("__p.v").isNull())
    keep = (
        F.col("__b").isNull() | (i == F.col("__first")) | (i == F.col("__last"))
        | F.coalesce(i == F.col("__lo"), F.lit(False)) | F.coalesce(i == F.col("__hi"), F.lit(False)) | edge
    )
    return joined.where(keep).select(*trace.columns)


def downsample_changes(trace: DataFrame, key: str, x: str, value: str, budget: int, chunk_rows: int | None = None) -> DataFrame:
    """First, last and both sides of every change; short traces stay whole."""
    s = series((key,), (x,), chunk_rows)
    rows = scan(
        trace, s, __p=previous(F.struct(F.col(value).alias("v"))), __f=following(F.struct(F.col(value).alias("v"))),
    ).join(trace.groupBy(key).agg(F.count(F.lit(1)).alias("__total")), key)
    v = F.col(value)
    keep = (
        (F.col("__total") <= budget) | F.col("__p").isNull() | F.col("__f").isNull()
        | ~F.col("__p.v").eqNullSafe(v) | ~F.col("__f.v").eqNullSafe(v)
    )
    return rows.where(keep).select(*trace.columns)


def nearest_sample(
    targets: DataFrame, samples: DataFrame, by: Sequence[str], target: str, x: str, values: Sequence[str],
    chunk_rows: int | None = None,
) -> DataFrame:
    """Sample nearest to each target; equal distances take the upper one."""
    near = bracket(targets, samples.withColumn("__x", F.col(x)), by, target, "__x", ["__x", *values], chunk_rows)
    down, up = F.col(target) - F.col("before.__x"), F.col("after.__x") - F.col(target)
    lower = F.col("after").isNull() | (down < up) | (down == 0)
    chosen = F.when(F.col("before").isNotNull() & F.coalesce(lower, F.lit(True)), F.col("before")).otherwise(F.col("after"))
    return near.withColumn("__c", chosen).select(
        *targets.columns, F.col("__c.__x").alias(f"nearest_{x}"), *[F.col(f"__c.{v}").alias(v) for v in values]
    )
