"""Historical race analytics over one row per (session, driver)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapwing.functions.values import round_binary, slug
from lapwing.functions.vocab import outcome
from lapwing.operators.scan import position, scan, series

SCORED = ("finished", "classified")
LAST_PLACE = 10_000
ERAS = ((2000, 2010), (2011, 2017), (2018, 2026))


def quality_gate(events: DataFrame) -> DataFrame:
    """Completed events whose archive quality is verified or good."""
    return events.where(
        (F.col("status") == "completed") & F.col("quality_status").isin("verified", "good")
    )


def resolve_circuit(events: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """Add ``circuit_id``: the (season, round) identity or a slug of the name.

    ``identities`` has one row a (season, round), as ``circuit_identities`` gives.
    """
    fallback = slug(F.col("circuit_name"))
    if identities is None:
        return events.withColumn("circuit_id", fallback)
    known = identities.select("season", "round_number", F.col("reference").alias("__ref"))
    return (
        events.join(known, ["season", "round_number"], "left")
        .withColumn("circuit_id", F.coalesce("__ref", fallback))
        .drop("__ref")
    )


def circuit_identities(seasons: DataFrame, rounds: DataFrame, circuits: DataFrame) -> DataFrame:
    """season, round_number and the provider's circuit ``reference`` of each numbered round of a dump.

    ``seasons``: id, year; ``rounds``: id, season_id, number, circuit_id; ``circuits``: id, reference.  Rounds without a
    number or without a known circuit have none.  Of several rounds with one number the last (by id) counts.
    """
    years = seasons.select(F.col("id").alias("season_id"), F.col("year").alias("season"))
    known = circuits.where(F.col("reference").isNotNull()).select(F.col("id").alias("circuit_id"), "reference")
    rows = rounds.where(F.col("number").isNotNull()).join(years, "season_id").join(known, "circuit_id")
    return rows.groupBy("season", F.col("number").alias("round_number")).agg(
        F.max_by("reference", rounds["id"]).alias("reference")
    )


def finish_order(c: str = "finish_position") -> Column:
    """Sort key that puts missing and zero finishes last."""
    return F.when(F.coalesce(F.col(c), F.lit(0)) == 0, LAST_PLACE).otherwise(F.col(c))


def driver_race(
    results: DataFrame,
    laps: DataFrame,
    pits: DataFrame,
    events: DataFrame,
    identities: DataFrame | None = None,
) -> DataFrame:
    """One observation per result row of a gated event.

    Laps and stops are stacked, dealt by (session, driver) and aggregated there: medians and lists hold every value, so
    combining before the shuffle would sort each input file whole and send buffers larger than the rows.  Results,
    already one row per key, join the reduced side.
    """
    keys = ["session_id", "driver_id"]
    stacked = laps.select(
        *keys,
        F.lit(1).alias("lap"),
        F.col("lap_time_ms").alias("lap_ms"),
        F.coalesce(F.col("is_fastest_lap"), F.lit(False)).cast("int").alias("fast"),
    ).unionByName(
        pits.select(*keys, F.lit(1).alias("pit"), F.col("duration_ms").alias("pit_ms")), allowMissingColumns=True
    )
    stats = stacked.repartition(*keys).groupBy(*keys).agg(
        F.count("lap").alias("recorded_lap_count"),
        F.count("lap_ms").alias("timed_lap_count"),
        F.avg("lap_ms").alias("raw_mean_lap_ms"),
        F.percentile("lap_ms", F.lit(0.5)).alias("raw_median_lap_ms"),
        F.min("lap_ms").alias("best_recorded_lap_ms"),
        (F.coalesce(F.max("fast"), F.lit(0)) == 1).alias("fastest_lap_recorded"),
        F.count("pit").alias("__pits"),
        F.percentile("pit_ms", F.lit(0.5)).alias("median_pit_duration_ms"),
        F.array_sort(F.collect_list("pit_ms")).alias("pit_durations_ms"),
    )
    gated = resolve_circuit(quality_gate(events), identities).select(
        "session_id", "event_id", "season", "round_number", "event_name", "event_date",
        "circuit_id", "circuit_name", "quality_status",
        F.col("cap_pit_stops").alias("pit_data_available"),
        (F.col("cap_lap_times") | F.col("cap_lap_positions")).alias("lap_data_available"),
    )
    c = F.col
    joined = results.join(gated, "session_id").join(stats, keys, "left").withColumn(
        "outcome", outcome(c("status"), c("classified"), c("laps_completed"))
    )
    grid, finish = c("grid_position"), c("finish_position")
    gained = F.when((grid > 0) & (finish > 0) & c("outcome").isin(*SCORED), grid - finish)
    none = F.lit(0)
    return joined.select(
        "event_id", "session_id", "season", "round_number", "event_name", "event_date",
        "circuit_id", "circuit_name", "driver_id", "driver_name",
        c("team_id").alias("constructor_id"), c("team_name").alias("constructor_name"),
        "grid_position", "finish_position",
        F.coalesce("points", F.lit(0.0)).alias("points"),
        "laps_completed", "outcome",
        F.coalesce("classified", F.lit(False)).alias("classified"),
        gained.alias("positions_gained"),
        F.coalesce("recorded_lap_count", none).alias("recorded_lap_count"),
        F.coalesce("timed_lap_count", none).alias("timed_lap_count"),
        "raw_mean_lap_ms", "raw_median_lap_ms", "best_recorded_lap_ms",
        F.coalesce("fastest_lap_recorded", F.lit(False)).alias("fastest_lap_recorded"),
        F.when(c("pit_data_available"), F.coalesce("__pits", none)).alias("pit_stop_count"),
        "median_pit_duration_ms",
        F.coalesce("pit_durations_ms", F.array().cast("array<bigint>")).alias("pit_durations_ms"),
        "lap_data_available", "pit_data_available", "quality_status",
    )


def season_filter(
    obs: DataFrame,
    start: int = 2000,
    end: int = 2026,
    driver_id=None,
    constructor_id=None,
    circuit_id=None,
    floor: int = 2000,
) -> DataFrame:
    """Season span plus optional equality filters; bad spans are an error."""
    if start < floor:
        raise ValueError(f"seasons start at {floor}")
    if end < start:
        raise ValueError("end season precedes start season")
    out = obs.where(F.col("season").between(start, end))
    for name, wanted in (
        ("driver_id", driver_id), ("constructor_id", constructor_id), ("circuit_id", circuit_id)
    ):
        if wanted is not None:
            out = out.where(F.col(name) == F.lit(wanted))
    return out


def search(df: DataFrame, term: str | None, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring over any of the columns."""
    text = (term or "").strip().lower()
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text), F.lit(False))
    return df.where(hit)


_SUMS = (
    "starts", "finishes", "wins", "podiums", "points", "dnf", "dns", "dsq", "grid_sum",
    "average_grid_samples", "finish_sum", "average_finish_samples", "positions_gained",
    "positions_gained_samples", "laps_completed", "entries",
)


def _when(cond: Column, value: Column | int = 1) -> Column:
    return F.sum(F.when(cond, value).otherwise(0))


def _per_race(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    scored = F.col("outcome").isin(*SCORED)
    starts = F.col("outcome") != "dns"
    grid, finish, gained = F.col("grid_position"), F.col("finish_position"), F.col("positions_gained")
    has_grid = starts & grid.isNotNull() & (grid != 0)
    return obs.groupBy(*keys, "session_id").agg(
        _when(starts).alias("starts"),
        _when(scored).alias("finishes"),
        _when(scored & (finish == 1)).alias("wins"),
        _when(scored & (finish <= 3)).alias("podiums"),
        F.sum("points").alias("points"),
        _when(F.col("outcome") == "dnf").alias("dnf"),
        _when(F.col("outcome") == "dns").alias("dns"),
        _when(F.col("outcome") == "dsq").alias("dsq"),
        _when(has_grid, grid).alias("grid_sum"),
        _when(has_grid).alias("average_grid_samples"),
        _when(scored & finish.isNotNull(), finish).alias("finish_sum"),
        _when(scored & finish.isNotNull()).alias("average_finish_samples"),
        _when(scored & gained.isNotNull(), gained).alias("positions_gained"),
        _when(scored & gained.isNotNull()).alias("positions_gained_samples"),
        F.sum(F.coalesce("laps_completed", F.lit(0))).alias("laps_completed"),
        F.count(F.lit(1)).alias("entries"),
        F.sum("pit_stop_count").alias("pit_stops"),
        F.min(F.when(scored, finish)).alias("best_finish"),
    )


def summary(obs: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Entity summary at any grain.

    Aggregated per (entity, race) first and per entity second: race counts need
    no distinct, and a large entity reaches the second shuffle already reduced.
    """
    races = _per_race(obs, keys)
    totals = races.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.sum("pit_stops").alias("pit_stops"),
        F.count("pit_stops").alias("pit_coverage_races"),
        F.min("best_finish").alias("best_finish"),
        F.count(F.lit(1)).alias("race_count"),
    )
    return totals.select(
        *keys,
        "starts", "finishes", "wins", "podiums",
        round_binary(F.col("points"), 2).alias("points"),
        "dnf", "dns", "dsq",
        round_binary(F.col("grid_sum") / F.nullif(F.col("average_grid_samples"), F.lit(0)), 1).alias("average_grid"),
        "average_grid_samples",
        round_binary(F.col("finish_sum") / F.nullif(F.col("average_finish_samples"), F.lit(0)), 1).alias("average_finish"),
        "average_finish_samples", "positions_gained", "positions_gained_samples",
        "laps_completed", "pit_stops", "pit_coverage_races", "best_finish", "race_count", "entries",
    )


def constructor_summary(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary where ``starts`` counts races and entries are kept apart."""
    return (
        summary(obs, keys)
        .withColumnRenamed("starts", "driver_entries")
        .withColumn("starts", F.col("race_count"))
    )


def latest_name(obs: DataFrame, entity: str, name: str, out: str = "entity_name") -> DataFrame:
    """Name on the newest observation in (season, round, finish) order."""
    order = F.struct("season", "round_number", finish_order().alias("f"), "session_id", "driver_id")
    return obs.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.max_by(F.coalesce(F.col(name), F.col(entity).cast("string")), order).alias(out)
    )


def coverage(eligible: DataFrame, catalog: DataFrame, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One coverage row per metric: (condition of inclusion, samples per row).

    Rows are reduced per race first; race counts are then plain conditional
    counts.  Quality exclusions come from the catalog rows of the same span.
    """
    per_race = eligible.groupBy("session_id").agg(
        F.min("season").alias("season"),
        F.max("quality_status").alias("quality_status"),
        *[F.bool_or(cond).alias(f"in_{m}") for m, (cond, _) in metrics.items()],
        *[F.sum(F.when(cond, n).otherwise(0)).alias(f"n_{m}") for m, (cond, n) in metrics.items()],
    )
    stacked = per_race.select(
        "season", "quality_status",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(f"in_{m}").alias("inc"), F.col(f"n_{m}").alias("n"))
                    for m in metrics
                ]
            )
        ).alias("m"),
    )
    inc = F.coalesce(F.col("m.inc"), F.lit(False))
    table = stacked.groupBy(F.col("m.metric").alias("metric")).agg(
        F.coalesce(F.sum("m.n"), F.lit(0)).alias("sample_count"),
        F.count(F.when(inc, 1)).alias("race_count"),
        F.count(F.lit(1)).alias("eligible_race_count"),
        F.count(F.when(inc & (F.col("quality_status") == "verified"), 1)).alias("verified_count"),
        F.count(F.when(inc & (F.col("quality_status") == "good"), 1)).alias("good_count"),
        F.min("season").alias("first_season"),
        F.max("season").alias("last_season"),
    )
    # A row per metric and season of its span: a few hundred rows at most.
    excluded = (
        catalog.where(
            (F.col("status") == "completed") & ~F.col("quality_status").isin("verified", "good")
        )
        .groupBy("season")
        .agg(F.sum("result_rows").alias("rows"))
    )
    years = table.withColumn("season", F.explode(F.sequence("first_season", "last_season")))
    spans = years.join(excluded, "season", "left")
    keep = [c for c in table.columns if c not in ("first_season", "last_season")]
    return (
        spans.groupBy(*keep)
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("quality_exclusions"))
        .select(
            "metric", "sample_count", "race_count", "eligible_race_count",
            F.greatest(F.lit(0), F.col("eligible_race_count") - F.col("race_count")).alias("missing_count"),
            "verified_count", "good_count", "quality_exclusions",
            F.when(
                F.col("eligible_race_count") > 0, F.col("race_count") / F.col("eligible_race_count")
            ).alias("coverage_ratio"),
        )
    )


def coverage_metrics() -> dict[str, tuple[Column, Column]]:
    return {
        "result_metrics": (F.lit(True), F.lit(1)),
        "position_progression": (F.col("lap_data_available"), F.col("recorded_lap_count")),
        "raw_lap_time_metrics": (F.col("timed_lap_count") > 0, F.col("timed_lap_count")),
        "pit_stop_metrics": (
            F.col("pit_data_available"), F.coalesce(F.col("pit_stop_count"), F.lit(0))
        ),
    }


def season_report(obs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Headline counts, points leader and competitiveness, one row per season."""
    per_driver = summary(obs, ["season", "driver_id"]).join(
        latest_name_by(obs, ["season", "driver_id"], "driver_name"), ["season", "driver_id"]
    )
    leader = F.struct(
        (-F.col("points")).alias("p"), (-F.col("wins")).alias("w"), "driver_name", "driver_id"
    )
    drivers = per_driver.groupBy("season").agg(
        F.count(F.lit(1)).alias("driver_count"),
        F.sum("entries").alias("result_observations"),
        F.sum("laps_completed").alias("laps_completed"),
        F.count(F.when(F.col("wins") > 0, 1)).alias("different_winners"),
        F.count(F.when(F.col("podiums") > 0, 1)).alias("different_podium_finishers"),
        F.min_by("driver_id", leader).alias("points_leader_id"),
        F.min_by("driver_name", leader).alias("points_leader_name"),
        round_binary(F.max("points") - F.min("points"), 2).alias("driver_points_spread"),
    )
    constructors = concentration(
        constructor_summary(obs.where(F.col("constructor_id").isNotNull()), ["season", "constructor_id"]),
        "season", "points",
    )
    extra = obs.groupBy("season").agg(
        F.sum("recorded_lap_count").alias("recorded_laps"),
        F.sum("pit_stop_count").alias("pit_stops"),
    )
    schedule = catalog.groupBy("season").agg(
        F.count(F.lit(1)).alias("scheduled_races"),
        F.count(F.when(F.col("status") == "completed", 1)).alias("completed_races"),
    )
    return (
        schedule.join(drivers, "season", "left")
        .join(constructors, "season", "left")
        .join(extra, "season", "left")
    )


def latest_name_by(obs: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    order = F.struct("season", "round_number", finish_order().alias("f"), "session_id", "driver_id")
    return obs.groupBy(*keys).agg(F.max_by(name, order).alias(name))


def concentration(df: DataFrame, key: str, value: str) -> DataFrame:
    """Herfindahl index of ``value`` shares per key; NULL for totals <= 0.

    Uses sum(v^2) / sum(v)^2, so one aggregation suffices.
    """
    total = F.sum(value)
    squares = F.sum(F.col(value) * F.col(value))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("constructor_count"),
        F.when(total > 0, round_binary(squares / (total * total), 3)).alias("points_concentration"),
    )


def race_rows(obs: DataFrame) -> DataFrame:
    """Per race: winner, stops where supported, retirements."""
    won = (F.col("finish_position") == 1) & F.col("outcome").isin(*SCORED)
    return obs.groupBy("session_id").agg(
        F.max("event_id").alias("event_id"),
        F.max("season").alias("season"),
        F.max("round_number").alias("round_number"),
        F.max("event_name").alias("event_name"),
        F.max("circuit_id").alias("circuit_id"),
        F.min(F.when(won, F.col("driver_id"))).alias("winner_driver_id"),
        F.min_by("driver_name", F.when(won, F.col("driver_id"))).alias("winner_name"),
        F.when(
            F.bool_or("pit_data_available"), F.sum(F.coalesce("pit_stop_count", F.lit(0)))
        ).alias("pit_stop_count"),
        _when(F.col("outcome") == "dnf").alias("dnf_count"),
    )


def driver_directory(obs: DataFrame) -> DataFrame:
    """All drivers with span, constructors and summary."""
    spans = obs.groupBy("driver_id", "constructor_name").agg(
        F.min("season").alias("a"), F.max("season").alias("b")
    ).groupBy("driver_id").agg(
        F.min("a").alias("start_season"),
        F.max("b").alias("end_season"),
        F.array_sort(F.collect_set("constructor_name")).alias("constructors"),
    )
    return (
        summary(obs, ["driver_id"])
        .join(spans, "driver_id")
        .join(latest_name(obs, "driver_id", "driver_name"), "driver_id")
        .withColumnRenamed("driver_id", "entity_id")
    )


def constructor_directory(obs: DataFrame) -> DataFrame:
    known = obs.where(F.col("constructor_id").isNotNull())
    spans = known.groupBy("constructor_id", "driver_id").agg(
        F.min("season").alias("a"), F.max("season").alias("b")
    ).groupBy("constructor_id").agg(
        F.min("a").alias("start_season"),
        F.max("b").alias("end_season"),
        F.count(F.lit(1)).alias("driver_count"),
    )
    return (
        constructor_summary(known, ["constructor_id"])
        .join(spans, "constructor_id")
        .join(latest_name(known, "constructor_id", "constructor_name"), "constructor_id")
        .withColumnRenamed("constructor_id", "entity_id")
    )


def circuit_directory(obs: DataFrame) -> DataFrame:
    won = (F.col("finish_position") == 1) & F.col("outcome").isin(*SCORED)
    races = obs.groupBy("circuit_id", "session_id").agg(
        F.min("season").alias("season"), F.bool_or("pit_data_available").alias("pits")
    ).groupBy("circuit_id").agg(
        F.min("season").alias("start_season"),
        F.max("season").alias("end_season"),
        F.count(F.lit(1)).alias("race_count"),
        F.count(F.when(F.col("pits"), 1)).alias("pit_coverage_races"),
    )
    winners = obs.where(won).select("circuit_id", "driver_id").distinct().groupBy("circuit_id").agg(
        F.count(F.lit(1)).alias("different_winners")
    )
    return (
        races.join(winners, "circuit_id", "left")
        .na.fill(0, ["different_winners"])
        .join(latest_name(obs, "circuit_id", "circuit_name"), "circuit_id")
        .withColumnRenamed("circuit_id", "entity_id")
    )


def finish_distribution(obs: DataFrame, key: str) -> DataFrame:
    """Finishes per position 1..20."""
    return (
        obs.where(F.col("finish_position").between(1, 20))
        .groupBy(key, "finish_position")
        .agg(F.count(F.lit(1)).alias("finishes"))
    )


def one_two_finishes(obs: DataFrame) -> DataFrame:
    """Races in which a constructor took first and second."""
    return (
        obs.where(F.col("constructor_id").isNotNull() & F.col("outcome").isin(*SCORED))
        .groupBy("constructor_id", "session_id")
        .agg((F.bool_or(F.col("finish_position") == 1) & F.bool_or(F.col("finish_position") == 2)).alias("both"))
        .groupBy("constructor_id")
        .agg(F.count(F.when(F.col("both"), 1)).alias("one_two_finishes"))
    )


def circuit_profile(obs: DataFrame) -> DataFrame:
    """Circuit headline: here winners count every P1, whatever the outcome.

    Pit durations are counted by value before the median, so the busiest
    circuit never gathers its raw stops.
    """
    per_driver = obs.groupBy("circuit_id", "driver_id").agg(
        F.bool_or(F.coalesce(F.col("finish_position") == 1, F.lit(False))).alias("won"),
        F.count(F.when(F.col("outcome") == "dnf", 1)).alias("dnf"),
        F.count(F.when(F.col("outcome") != "dns", 1)).alias("starts"),
        F.min("season").alias("a"),
        F.max("season").alias("b"),
    ).groupBy("circuit_id").agg(
        F.count(F.lit(1)).alias("driver_count"),
        F.count(F.when(F.col("won"), 1)).alias("different_winners"),
        F.sum("dnf").alias("dnf"),
        F.sum("starts").alias("starts"),
        F.min("a").alias("first_season"),
        F.max("b").alias("latest_season"),
    )
    races = obs.select("circuit_id", "session_id").distinct().groupBy("circuit_id").agg(
        F.count(F.lit(1)).alias("race_count")
    )
    teams = obs.where(F.col("constructor_id").isNotNull()).select(
        "circuit_id", "constructor_id"
    ).distinct().groupBy("circuit_id").agg(F.count(F.lit(1)).alias("constructor_count"))
    medians = (
        obs.where("pit_data_available")
        .select("circuit_id", F.explode("pit_durations_ms").alias("ms"))
        .groupBy("circuit_id", "ms")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("circuit_id")
        .agg(F.percentile("ms", F.lit(0.5), F.col("n")).alias("median_pit_duration_ms"))
    )
    return (
        per_driver.join(races, "circuit_id")
        .join(teams, "circuit_id", "left")
        .join(medians, "circuit_id", "left")
        .select(
            "circuit_id", "first_season", "latest_season", "race_count", "different_winners",
            "driver_count", F.coalesce("constructor_count", F.lit(0)).alias("constructor_count"),
            round_binary(F.col("dnf") / F.nullif(F.col("starts"), F.lit(0)), 3).alias("dnf_rate"),
            "median_pit_duration_ms",
        )
    )


def pit_trend(obs: DataFrame) -> DataFrame:
    """Stops and supported races per circuit and season."""
    return (
        obs.where("pit_data_available")
        .groupBy("circuit_id", "season", "session_id")
        .agg(F.sum(F.coalesce("pit_stop_count", F.lit(0))).alias("pits"))
        .groupBy("circuit_id", "season")
        .agg(F.sum("pits").alias("pit_stops"), F.count(F.lit(1)).alias("race_count"))
    )


def paged_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], offset: int = 0, limit: int = 50
) -> DataFrame:
    """One page of every entity's rows, numbered from 1 (``item_rank``), with the ``total`` before paging.

    An entity's rows are its races or partners: some thousand at most.
    """
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit at least 1")
    each = W.partitionBy(*keys)
    ranked = df.withColumn("item_rank", F.row_number().over(each.orderBy(*order))).withColumn(
        "total", F.count(F.lit(1)).over(each)
    )
    return ranked.where((F.col("item_rank") > offset) & (F.col("item_rank") <= offset + limit))


def _newest_first() -> list[Column]:
    return [F.col("season").desc(), F.col("round_number").desc(), F.col("session_id")]


def constructor_circuits(obs: DataFrame) -> DataFrame:
    """A constructor's record at each circuit, most starts first."""
    keys = ["constructor_id", "circuit_id"]
    rows = constructor_summary(obs.where(F.col("constructor_id").isNotNull()), keys)
    order = W.partitionBy("constructor_id").orderBy(F.col("starts").desc(), "circuit_id")
    return rows.withColumn("circuit_rank", F.row_number().over(order))


def constructor_races(obs: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of each constructor's races, newest first, with the record of its cars in the race."""
    keys = ["constructor_id", "session_id"]
    held = obs.where(F.col("constructor_id").isNotNull())
    race = held.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("event_id", "season", "round_number", "event_name", "circuit_id", "circuit_name")]
    )
    return paged_by(race.join(summary(held, keys), keys), ["constructor_id"], _newest_first(), offset, limit)


def _top_of_circuit(rows: DataFrame, entity: str, order: Sequence[str], n: int) -> DataFrame:
    by = W.partitionBy("circuit_id").orderBy(*[F.col(c).desc() for c in order], entity)
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def circuit_drivers(obs: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` best drivers of each circuit: wins, podiums, points, starts; equal ones by id."""
    keys = ["circuit_id", "driver_id"]
    rows = summary(obs, keys).join(latest_name_by(obs, keys, "driver_name"), keys)
    return _top_of_circuit(rows, "driver_id", ("wins", "podiums", "points", "starts"), n)


def circuit_constructors(obs: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` best constructors of each circuit: wins, points; equal ones by id."""
    keys = ["circuit_id", "constructor_id"]
    held = obs.where(F.col("constructor_id").isNotNull())
    rows = constructor_summary(held, keys).join(latest_name_by(held, keys, "constructor_name"), keys)
    return _top_of_circuit(rows, "constructor_id", ("wins", "points"), n)


def circuit_races(obs: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of each circuit's races, newest season first: winner, stops where supported, retirements."""
    return paged_by(race_rows(obs), ["circuit_id"], _newest_first(), offset, limit)


def race_summary(obs: DataFrame) -> DataFrame:
    """Headline of each race: winner, size of the field and the podium, laps, stops where supported, who fell out."""
    scored = F.col("outcome").isin(*SCORED)
    more = obs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("driver_count"), _when((F.col("finish_position") <= 3) & scored).alias("podium_size"),
        F.sum("recorded_lap_count").alias("recorded_laps"), _when(F.col("outcome") == "dns").alias("dns_count"),
    )
    return race_rows(obs).join(more, "session_id")


def podium(obs: DataFrame) -> DataFrame:
    return obs.where(
        (F.col("finish_position") <= 3) & F.col("outcome").isin(*SCORED)
    ).select("session_id", "finish_position", "driver_id", "driver_name")


def top_movers(obs: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` biggest position gains of each race."""
    w = W.partitionBy("session_id").orderBy(
        F.col("positions_gained").desc(), finish_order(), F.col("driver_id")
    )
    return (
        obs.where(F.col("positions_gained").isNotNull())
        .withColumn("mover_rank", F.row_number().over(w))
        .where(F.col("mover_rank") <= n)
        .select("session_id", "mover_rank", "driver_id", "positions_gained")
    )


def position_progression(obs: DataFrame, laps: DataFrame, top: int = 5, drivers: DataFrame | None = None) -> DataFrame:
    """Lap-by-lap position in each race of the chosen ``drivers`` (session_id, driver_id), else of the first ``top``.

    A race without a chosen driver shows its first ones; chosen drivers who took no part show nothing.
    """
    w = W.partitionBy("session_id").orderBy(finish_order(), F.col("driver_id"))
    chosen = (
        obs.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top)
        .select("session_id", "driver_id")
    )
    if drivers is not None:
        wanted = drivers.select("session_id", "driver_id").distinct()
        chosen = chosen.join(wanted.select("session_id").distinct(), "session_id", "left_anti").unionByName(
            wanted.join(obs.select("session_id", "driver_id"), ["session_id", "driver_id"], "left_semi")
        )
    return (
        laps.where(F.col("position").isNotNull())
        .select("session_id", "driver_id", "lap_number", "position")
        .join(chosen, ["session_id", "driver_id"], "left_semi")
    )


def common_races(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` in races that ``b`` also took part in."""
    return a.join(b.select("session_id"), "session_id", "left_semi")


def driver_head_to_head(obs: DataFrame, a, b) -> DataFrame:
    """Ahead/behind counts of two drivers over their common races."""
    return _h2h_pair(obs.where(F.col("driver_id").isin(a, b)), a, b)


def _h2h_pair(rows: DataFrame, a, b) -> DataFrame:
    def side(x, c):
        return F.max(F.when(F.col("driver_id") == F.lit(x), F.col(c)))

    race = rows.groupBy("session_id").agg(
        F.count(F.when(F.col("driver_id") == F.lit(a), 1)).alias("na"),
        F.count(F.when(F.col("driver_id") == F.lit(b), 1)).alias("nb"),
        side(a, "constructor_id").alias("ca"), side(b, "constructor_id").alias("cb"),
        side(a, "outcome").alias("oa"), side(b, "outcome").alias("ob"),
        side(a, "finish_position").alias("fa"), side(b, "finish_position").alias("fb"),
    ).where((F.col("na") > 0) & (F.col("nb") > 0))
    ok = (
        F.col("oa").isin(*SCORED) & F.col("ob").isin(*SCORED)
        & F.col("fa").isNotNull() & F.col("fb").isNotNull()
    )
    counts = race.agg(
        F.count(F.lit(1)).alias("common_race_count"),
        F.count(F.when(ok & (F.col("fa") < F.col("fb")), 1)).alias("a_finished_ahead"),
        F.count(F.when(ok & (F.col("fb") < F.col("fa")), 1)).alias("b_finished_ahead"),
        F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("excluded_non_comparable"),
        F.count(F.when(F.col("ca") == F.col("cb"), 1)).alias("teammate_races"),
    )
    return counts.withColumn(
        "denominator", F.col("a_finished_ahead") + F.col("b_finished_ahead")
    )


def constructor_head_to_head(obs: DataFrame, a, b) -> DataFrame:
    """Race-by-race point sums of two constructors compared."""
    race = (
        obs.where(F.col("constructor_id").isin(a, b))
        .groupBy("session_id")
        .agg(
            F.sum(F.when(F.col("constructor_id") == F.lit(a), F.col("points"))).alias("pa"),
            F.sum(F.when(F.col("constructor_id") == F.lit(b), F.col("points"))).alias("pb"),
        )
        .where(F.col("pa").isNotNull() & F.col("pb").isNotNull())
    )
    counts = race.agg(
        F.count(F.lit(1)).alias("common_race_count"),
        F.count(F.when(F.col("pa") > F.col("pb"), 1)).alias("a_finished_ahead"),
        F.count(F.when(F.col("pb") > F.col("pa"), 1)).alias("b_finished_ahead"),
        F.count(F.when(F.col("pa") == F.col("pb"), 1)).alias("tied"),
    )
    return counts.withColumn(
        "denominator", F.col("a_finished_ahead") + F.col("b_finished_ahead") + F.col("tied")
    )


def compare(obs: DataFrame, entity: str, a, b, mode: str = "common_races") -> DataFrame:
    """Summaries of two entities over common or all selected races."""
    if entity not in ("driver_id", "constructor_id"):
        raise ValueError("only drivers and constructors can be compared")
    rows = obs.where(F.col(entity).isin(a, b))
    if mode == "common_races":
        shared = (
            rows.groupBy("session_id")
            .agg(
                F.bool_or(F.col(entity) == F.lit(a)).alias("__a"),
                F.bool_or(F.col(entity) == F.lit(b)).alias("__b"),
            )
            .where("__a AND __b")
        )
        rows = rows.join(shared, "session_id", "left_semi")
    build = summary if entity == "driver_id" else constructor_summary
    return build(rows, [entity])


def era_coverage(obs: DataFrame, eras: Sequence[tuple[int, int]] = ERAS) -> DataFrame:
    """Races with laps, timed laps and pits per fixed era."""
    start = F.lit(None).cast("int")
    for lo, hi in eras:
        start = F.when(F.col("season").between(lo, hi), F.lit(lo)).otherwise(start)
    per_race = (
        obs.withColumn("start_season", start)
        .where(F.col("start_season").isNotNull())
        .groupBy("start_season", "session_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_or("lap_data_available").alias("laps"),
            F.bool_or(F.col("timed_lap_count") > 0).alias("timed"),
            F.bool_or("pit_data_available").alias("pits"),
        )
    )
    return per_race.groupBy("start_season").agg(
        F.count(F.lit(1)).alias("race_count"),
        F.sum("n").alias("result_observations"),
        F.count(F.when(F.col("laps"), 1)).alias("lap_races"),
        F.count(F.when(F.col("timed"), 1)).alias("timed_lap_races"),
        F.count(F.when(F.col("pits"), 1)).alias("pit_races"),
    )


def top_entities(summaries: DataFrame, name: str, n: int = 5, within: Sequence[str] = ()) -> DataFrame:
    """First ``n`` by points, wins, name (per group when ``within`` is given)."""
    order = [F.col("points").desc(), F.col("wins").desc(), F.col(name), F.col("entity_id")]
    if not within:
        return summaries.orderBy(*order).limit(n)
    w = W.partitionBy(*within).orderBy(*order)
    return summaries.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def points_progression(obs: DataFrame, entity: str, name: str, n: int = 5) -> DataFrame:
    """Cumulative points per season and round of the top entities.

    Dense: an entity absent from a round carries its total forward.  Only the
    reduced (season, round, entity) sums enter the grid.
    """
    rows = obs.where(F.col(entity).isNotNull())
    totals = (
        summary(rows, ["season", entity])
        .join(latest_name_by(rows, ["season", entity], name), ["season", entity])
        .withColumnRenamed(entity, "entity_id")
    )
    best = top_entities(totals, name, n, ["season"]).select("season", "entity_id", F.col(name).alias("entity_name"))
    rounds = obs.select("season", "round_number").distinct()
    sums = rows.groupBy("season", "round_number", F.col(entity).alias("entity_id")).agg(
        F.sum("points").alias("__p")
    )
    grid = rounds.join(best, "season")
    w = W.partitionBy("season", "entity_id").orderBy("round_number").rowsBetween(W.unboundedPreceding, 0)
    return grid.join(sums, ["season", "round_number", "entity_id"], "left").select(
        "season", "round_number", "entity_id", "entity_name",
        round_binary(F.sum(F.coalesce("__p", F.lit(0.0))).over(w), 2).alias("value"),
    )


ASCENDING_METRICS = ("average_finish", "dnf_rate")


def ranking_rows(obs: DataFrame, entity: str, name: str, metric: str, minimum_starts: int = 5) -> DataFrame:
    """Unranked ranking rows: value, starts, races and the metric's samples."""
    if entity == "circuit_id":
        raise ValueError("circuits cannot be ranked")
    rows = obs.where(F.col(entity).isNotNull())
    driver = entity == "driver_id"
    table = summary(rows, [entity]) if driver else constructor_summary(rows, [entity])
    denominator = F.col("starts") if driver else F.col("driver_entries")
    if metric == "dnf_rate":
        value = round_binary(F.col("dnf") / F.nullif(denominator, F.lit(0)), 3)
        samples = denominator
    else:
        value = F.col(metric).cast("double")
        samples = {
            "average_finish": F.col("average_finish_samples"),
            "positions_gained": F.col("positions_gained_samples"),
            "pit_stops": F.col("pit_coverage_races"),
        }.get(metric, F.col("entries"))
    return (
        table.where(F.col("starts") >= minimum_starts)
        .withColumn("value", value)
        .where(F.col("value").isNotNull())
        .join(latest_name(rows, entity, name), entity)
        .select(
            F.col(entity).alias("entity_id"), "entity_name", "value", "starts", "race_count",
            samples.alias("sample_count"),
        )
    )


def rankings(
    obs: DataFrame, entity: str, name: str, metric: str,
    minimum_starts: int = 5, offset: int = 0, limit: int = 50,
) -> DataFrame:
    """One page of the ranking, best first, with its rank in the whole list."""
    rows = ranking_rows(obs, entity, name, metric, minimum_starts)
    value = F.col("value") if metric in ASCENDING_METRICS else -F.col("value")
    order = [value, F.col("starts").desc(), F.col("entity_name"), F.col("entity_id")]
    paged = rows.orderBy(*order).offset(offset).limit(limit)
    # At most ``limit`` rows reach this window.
    return paged.withColumn("rank", F.row_number().over(W.orderBy(*order)) + F.lit(offset))


def ranked(rows: DataFrame, metric: str, chunk_rows: int) -> DataFrame:
    """The whole ranking numbered without a single-task sort."""
    value = F.col("value") if metric in ASCENDING_METRICS else -F.col("value")
    keyed = rows.withColumn("__v", value).withColumn("__s", -F.col("starts"))
    s = series((), ("__v", "__s", "entity_name", "entity_id"), chunk_rows)
    return scan(keyed, s, rank=position()).drop("__v", "__s")


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(page rows, one-row total counted before paging)."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit), total
