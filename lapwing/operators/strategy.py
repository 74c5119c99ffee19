"""Outcome statistics over a table of strategy paths, and field selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapwing.functions.values import round_binary
from lapwing.functions.vocab import DRY_COMPOUNDS, TERMINAL_STATUSES
from lapwing.operators.percentiles import grouped_percentiles
from lapwing.operators.scan import position, remaining_min, remaining_sum, scan, series

THRESHOLD = 0.60


def outcome_distribution(paths: DataFrame, chunk_rows: int, by: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Expected and median position, top-three share, time percentiles."""
    positions = paths.groupBy(*by, "position").agg(F.count(F.lit(1)).alias("n"))
    places = positions.groupBy(*by).agg(
        F.sum("n").alias("paths"),
        round_binary(F.sum(F.col("position") * F.col("n")) / F.sum("n"), 3).alias("expected_position"),
        round_binary(F.percentile("position", F.lit(0.5), F.col("n")), 3).alias("median_position"),
        round_binary(F.sum(F.when(F.col("position") <= 3, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("probability_top_3"),
    )
    times = grouped_percentiles(paths, by, "final_time_ms", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, chunk_rows).drop("samples")
    horizon = paths.groupBy(*by).agg(
        round_binary(F.avg(F.col("local_horizon_exceeded").cast("double")), 4).alias("horizon_exceeded_probability")
    )
    rounded = times.select(*by, *[round_binary(F.col(c), 0).alias(c) for c in ("p10", "p50", "p90")])
    return places.join(rounded, list(by)).join(horizon, list(by))


def position_probabilities(paths: DataFrame, by: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Share of paths finishing in each position."""
    positions = paths.groupBy(*by, "position").agg(F.count(F.lit(1)).alias("n"))
    totals = positions.groupBy(*by).agg(F.sum("n").alias("total"))
    return positions.join(totals, list(by)).select(
        *by, "position", round_binary(F.col("n") / F.col("total"), 4).alias("probability")
    )


def paired_superiority(paths: DataFrame, a: str, b: str) -> DataFrame:
    """How often ``a`` beats ``b`` in the same iteration: position, then time."""
    def side(s: str) -> Column:
        return F.min(F.when(F.col("strategy_id") == s, F.struct("position", "final_time_ms")))

    pairs = (
        paths.where(F.col("strategy_id").isin(a, b)).groupBy("iteration")
        .agg(side(a).alias("x"), side(b).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    return pairs.agg(
        F.count(F.lit(1)).alias("iterations"), F.avg((F.col("x") < F.col("y")).cast("double")).alias("raw")
    ).withColumn("probability", round_binary(F.col("raw"), 4))


def sensitivity(paths: DataFrame, modes: Sequence[str] = ("lower-90", "point", "upper-90")) -> DataFrame:
    """Winner of each pit-loss mode and whether the winner changes."""
    scores = paths.where(F.col("pit_loss_mode").isin(*modes)).groupBy("pit_loss_mode", "strategy_id").agg(
        F.avg("position").alias("p"), F.avg("final_time_ms").alias("t")
    )
    winners = scores.groupBy("pit_loss_mode").agg(
        F.min_by("strategy_id", F.struct("p", "t", "strategy_id")).alias("winner")
    )
    # One row per mode: three at most.
    everyone = W.partitionBy()
    return winners.withColumn(
        "fragile", F.min("winner").over(everyone) != F.max("winner").over(everyone)
    )


def recommend(
    superiority: Column, fragile: Column, horizon_best: Column, horizon_second: Column, limited_field: Column,
    threshold: float = THRESHOLD,
) -> Column:
    """Guard reasons; an empty array means a clear preference."""
    return F.array_compact(
        F.array(
            F.when(superiority < threshold, "paired_superiority_below_product_threshold"),
            F.when(fragile, "pit_loss_sensitivity_winner_flip"),
            F.when((horizon_best > 0.5) | (horizon_second > 0.5), "local_tyre_horizon_exceeded"),
            F.when(limited_field, "incomplete_or_fallback_background_field"),
        )
    )


def limited_fields(field: DataFrame) -> DataFrame:
    """Whether the others of each driver's field are incomplete at a cursor: excluded, or without a model.

    ``field`` is what ``active_field`` gives.  A driver who is excluded has no row: there is nothing to recommend.
    """
    others = W.partitionBy("session_id", "cursor_ms")
    weak = (~F.col("model_supported")).cast("int")
    counted = field.withColumn("__weak", F.sum(weak).over(others) - weak)
    return counted.where(F.col("excluded_reason").isNull()).select(
        "session_id", "cursor_ms", "driver_id", (F.col("__weak") > 0).alias("limited_field")
    )


def recommendations(paths: DataFrame, limited: DataFrame, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    """Leading strategy, runner-up and guard reasons of every decision.

    ``keys`` name a decision in both inputs: ``paths`` hold its simulated strategies, two at least, ``limited`` its
    ``limited_field``.  A strategy is recommended where no guard fails.
    """
    keys = list(keys)
    table = outcome_distribution(paths, chunk_rows, (*keys, "strategy_id"))
    best = W.partitionBy(*keys).orderBy("expected_position", "p50", "strategy_id")
    ranked = table.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= 2)

    def nth(place: int, column: str) -> Column:
        return F.max(F.when(F.col("__r") == place, F.col(column)))

    top = ranked.groupBy(*keys).agg(
        nth(1, "strategy_id").alias("leading"), nth(2, "strategy_id").alias("runner_up"),
        nth(1, "horizon_exceeded_probability").alias("__h1"), nth(2, "horizon_exceeded_probability").alias("__h2"),
    ).where(F.col("runner_up").isNotNull())

    def side(name: str) -> Column:
        return F.min(F.when(F.col("strategy_id") == F.col(name), F.struct("position", "final_time_ms")))

    pairs = paths.join(top.select(*keys, "leading", "runner_up"), keys).groupBy(*keys, "iteration").agg(
        side("leading").alias("x"), side("runner_up").alias("y")
    )
    wins = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*keys).agg(
        F.avg((F.col("x") < F.col("y")).cast("double")).alias("__raw")
    )
    modes = paths.groupBy(*keys, "pit_loss_mode", "strategy_id").agg(
        F.avg("position").alias("p"), F.avg("final_time_ms").alias("t")
    ).groupBy(*keys, "pit_loss_mode").agg(F.min_by("strategy_id", F.struct("p", "t", "strategy_id")).alias("winner"))
    flips = modes.groupBy(*keys).agg((F.min("winner") != F.max("winner")).alias("fragile"))
    rows = top.join(wins, keys, "left").join(flips, keys).join(limited.select(*keys, "limited_field"), keys)
    raw = F.coalesce("__raw", F.lit(0.0))
    reasons = recommend(raw, F.col("fragile"), F.col("__h1"), F.col("__h2"), F.col("limited_field"))
    return rows.select(
        *keys, "leading", "runner_up", round_binary(raw, 4).alias("superiority"), "fragile", reasons.alias("guard_reasons"),
    ).withColumn("recommended", F.when(F.size("guard_reasons") == 0, F.col("leading")))


def classify(field: DataFrame, path: Sequence[str]) -> DataFrame:
    """Finishing order of each path (one race): laps, then time, then source position."""
    ordered = field.withColumn("__laps", -F.col("laps"))
    s = series(path, ("__laps", "completion_ms", "source_position", "driver_id"))
    return scan(ordered, s, position=position()).drop("__laps")


def candidates(states: DataFrame) -> DataFrame:
    """Candidate strategies of each driver state.

    ``states``: ids, laps_completed, scheduled_laps, compound.  Stay out, one
    stop at the midpoint onto each other dry compound, and two stops at the
    thirds when at least 18 laps remain to act in.
    """
    first = F.col("laps_completed") + 2
    left = F.col("scheduled_laps") - first + 1
    middle = (first + F.floor((left - 1) / 2)).cast("int")
    one, two = (first + F.floor(left / 3)).cast("int"), (first + F.floor(left * 2 / 3)).cast("int")

    def plan(name: Column, *stops: tuple[Column, Column]) -> Column:
        actions = (
            F.array(*[F.struct(lap.alias("lap"), compound.alias("compound")) for lap, compound in stops])
            if stops else F.array().cast("array<struct<lap:int,compound:string>>")
        )
        return F.struct(name.alias("strategy_id"), actions.alias("actions"))

    plans = [plan(F.lit("stay-out"))]
    for compound in sorted(DRY_COMPOUNDS):
        stop = plan(F.concat(F.lit("one-stop-l"), middle.cast("string"), F.lit(f"-{compound}")), (middle, F.lit(compound)))
        plans.append(F.when((left >= 2) & (F.col("compound") != compound), stop))
    double = plan(
        F.concat(F.lit("two-stop-l"), one.cast("string"), F.lit("-l"), two.cast("string")),
        (one, F.lit("medium")), (two, F.lit("soft")),
    )
    plans.append(F.when(left >= 18, double))
    return states.withColumn("__p", F.explode(F.array_compact(F.array(*plans)))).select(*states.columns, "__p.*")


def invalid_strategies(plans: DataFrame, require_two_compounds: bool = False) -> DataFrame:
    """Reason a plan cannot be used; NULL for valid plans."""
    first = F.col("laps_completed") + 2
    early = F.exists("actions", lambda a: a["lap"] < first)
    late = F.exists("actions", lambda a: a["lap"] > F.col("scheduled_laps"))
    used = F.size(F.array_distinct(F.concat(F.array("compound"), F.transform("actions", lambda a: a["compound"]))))
    reason = F.when(early, "action-before-next-lap").when(late, "action-after-race-distance")
    if require_two_compounds:
        reason = reason.when(used < 2, "too-few-compounds")
    return plans.withColumn("invalid_reason", reason)


def active_field(states: DataFrame, featured: DataFrame) -> DataFrame:
    """Drivers that can be simulated at a cursor, others with the reason.

    ``states`` are replay states; ``featured`` are features at the same cursors.
    """
    f = featured.select(
        "session_id", "driver_id", "cursor_ms", F.col("lap_number").alias("__lap"), F.col("feature_reason").alias("__why")
    )
    rows = states.join(f, ["session_id", "driver_id", "cursor_ms"], "left")
    status = F.col("status")
    reason = (
        F.when(status.isin(*TERMINAL_STATUSES), F.concat(F.lit("terminal_"), status))
        .when(~status.isin("active", "in-pit"), F.concat(F.lit("status_"), status))
        .when(F.col("in_pit"), "driver_in_pit")
        .when(
            ~F.coalesce(F.col("compound").isin(*DRY_COMPOUNDS), F.lit(False))
            | F.col("tyre_age_laps").isNull() | F.col("last_lap_time_ms").isNull(),
            "unsupported_or_missing_tyre_state",
        )
        .when(F.col("__lap").isNull(), "no_completed_lap")
    )
    return rows.withColumn("excluded_reason", reason).withColumn(
        "model_supported", F.col("excluded_reason").isNull() & F.col("__lap").isNotNull() & F.col("__why").isNull()
    ).drop("__lap", "__why")


def observed_overlay(rows: DataFrame, results: DataFrame, pits: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """What actually happened after each cursor: final result and later stops.

    A stop counts when its entry is known and after the cursor.  Stops and cursors are one ordered scan from the end,
    so no cursor meets a stop in a pair.
    """
    keys = ["session_id", "driver_id"]
    cursors = rows.select(*keys, F.col("cursor_ms").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("lap"))
    stops = pits.where(F.col("pit_in_time_ms").isNotNull()).select(
        *keys, F.col("pit_in_time_ms").alias("t"), F.lit(0).alias("side"), F.col("lap_number").cast("int").alias("lap")
    )
    # A stop at the cursor's own time comes before it.
    seen = scan(
        cursors.distinct().unionByName(stops), series(keys, ("t", "side"), chunk_rows),
        later_stops=remaining_sum(F.when(F.col("side") == 0, 1).otherwise(0)), next_stop_lap=remaining_min(F.col("lap")),
    ).where("side = 1").select(*keys, F.col("t").alias("cursor_ms"), "later_stops", "next_stop_lap")
    return rows.join(results, keys, "left").join(seen, [*keys, "cursor_ms"], "left").withColumn(
        "later_stops", F.coalesce("later_stops", F.lit(0))
    )
