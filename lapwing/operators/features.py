"""Causal lap features, eligibility and training examples.

Every lookup uses rows at or before the lap's end.  Weather, restarts, the
leading lap and wet intervals are read in one ordered scan per session;
positions and pit exits in one per driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.values import track_clear
from lapwing.functions.vocab import DRY_COMPOUNDS
from lapwing.operators.asof import asof_backward
from lapwing.operators.scan import following, latest, running_max, running_sum, scan, series, trailing

# Feature order with the declared domain of each.
FEATURES = {
    "lap_number": (1, 200),
    "tyre_age_laps": (0, 100),
    "stint_number": (1, 20),
    "pit_count": (0, 20),
    "race_position": (1, 30),
    "latest_lap_ms": (50_000, 300_000),
    "rolling_median_3_ms": (50_000, 300_000),
    "rolling_std_3_ms": (0, 125_000),
    "rolling_trend_3_ms": (-125_000, 125_000),
    "track_temperature_c": (-10, 80),
    "air_temperature_c": (-20, 60),
    "humidity_percent": (0, 100),
    "compound_soft": (0, 1),
    "compound_medium": (0, 1),
    "compound_hard": (0, 1),
}
NONLINEAR = ("tyre_age_squared", "tyre_age_x_lap", "tyre_age_x_track_temperature")
LAP = ["session_id", "driver_id", "lap_number"]


@dataclass(frozen=True)
class Rules:
    """Bounds with their usual values; data on another time scale brings its own."""

    min_lap_ms: int = 50_000
    max_lap_ms: int = 300_000
    min_pit_loss_ms: float = 1_000.0
    max_pit_loss_ms: float = 120_000.0
    domains: dict = field(default_factory=lambda: dict(FEATURES))


def restart_times(control: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Times at which a red-flagged session started again.

    A "started" message is a restart if a red flag came after the "started"
    before it; the message uses the red flag up.
    """
    started = F.lower(F.trim("message")) == "started"
    at = F.struct("session_time_ms", "event_id")
    rows = scan(
        control, series(("session_id",), ("session_time_ms", "event_id"), chunk_rows),
        __red=latest(F.when(F.col("track_status") == "red-flag", at)),
        __start=latest(F.when(started, at), inclusive=False),
    )
    pending = F.col("__red").isNotNull() & (F.col("__start").isNull() | (F.col("__red") > F.col("__start")))
    return rows.where(started & pending).select("session_id", F.col("session_time_ms").alias("restart_ms"))


def lap_context(
    laps: DataFrame, weather: DataFrame, control: DataFrame, chunk_rows: int | None = None
) -> DataFrame:
    """Session context of each lap: weather, dryness, restart, leading lap."""
    def edge(name: str, c: str) -> DataFrame:
        return laps.where(F.col(c).isNotNull()).select(
            *LAP, F.lit(name).alias("edge"), F.col(c).alias("t"), F.lit(1).alias("side"),
            (-F.col("lap_number")).cast("long").alias("tie"),
        )

    sky = weather.select(
        "session_id", F.col("session_time_ms").alias("t"), F.lit(0).alias("side"), F.col("event_id").cast("long").alias("tie"),
        F.struct(
            "track_temperature_c", "air_temperature_c", "humidity_percent", "rainfall"
        ).alias("w"),
    )
    again = restart_times(control, chunk_rows).select(
        "session_id", F.col("restart_ms").alias("t"), F.lit(2).alias("side"), F.lit(0).cast("long").alias("tie"),
        F.col("restart_ms").alias("again"),
    )
    rows = (
        edge("start", "lap_start_time_ms").unionByName(edge("end", "lap_end_time_ms"))
        .unionByName(sky, allowMissingColumns=True).unionByName(again, allowMissingColumns=True)
    )
    dry = F.coalesce(~F.col("w.rainfall"), F.lit(False))
    out = scan(
        rows, series(("session_id",), ("t", "side", "tie"), chunk_rows),
        sky_now=latest(F.col("w")),
        wet=running_sum(F.when(F.col("w").isNotNull() & ~dry, 1).otherwise(0).cast("long")),
        restart=latest(F.col("again")),
        lead_lap=running_max(F.when(F.col("edge") == "end", F.col("lap_number"))),
    )

    def pick(name: str, c: str) -> Column:
        return F.max(F.when(F.col("edge") == name, F.col(c)))

    facts = out.where(F.col("edge").isNotNull()).groupBy(*LAP).agg(
        pick("start", "sky_now").alias("__w0"), pick("start", "wet").alias("__wet0"), pick("end", "wet").alias("__wet1"),
        pick("end", "sky_now").alias("weather"), pick("end", "restart").alias("last_restart_ms"),
        pick("end", "lead_lap").alias("lead_lap"),
    )
    is_dry = F.coalesce(~F.col("__w0.rainfall"), F.lit(False)) & (F.col("__wet1") == F.col("__wet0"))
    return facts.select(
        *LAP, "weather", "last_restart_ms", "lead_lap", F.coalesce(is_dry, F.lit(False)).alias("is_dry"),
        F.coalesce(F.col("lead_lap") > F.col("lap_number"), F.lit(False)).alias("is_lapped"),
    )


def driver_context(laps: DataFrame, positions: DataFrame, pits: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Latest position and completed stops at each lap end."""
    keys = ["session_id", "driver_id"]
    ends = laps.where(F.col("lap_end_time_ms").isNotNull()).select(
        *LAP, F.col("lap_end_time_ms").alias("t"), F.lit(1).alias("side")
    )
    place = positions.select(*keys, F.col("session_time_ms").alias("t"), F.lit(0).alias("side"), F.col("position").alias("p"))
    out = pits.where(F.col("pit_out_time_ms").isNotNull()).select(
        *keys, F.col("pit_out_time_ms").alias("t"), F.lit(0).alias("side"), F.lit(1).cast("long").alias("stop")
    )
    rows = ends.unionByName(place, allowMissingColumns=True).unionByName(out, allowMissingColumns=True)
    found = scan(
        rows, series(keys, ("t", "side"), chunk_rows), race_position=latest(F.col("p")), stops=running_sum(F.col("stop"))
    )
    return found.where(F.col("side") == 1).select(*LAP, "race_position", F.coalesce("stops", F.lit(0)).alias("pit_count"))


def label_laps(
    laps: DataFrame, weather: DataFrame, control: DataFrame, pits: DataFrame, positions: DataFrame,
    rules: Rules = Rules(), chunk_rows: int | None = None,
) -> DataFrame:
    """Every lap with its context and the first failing eligibility reason."""
    keys = ["session_id", "driver_id"]
    timed = F.col("lap_end_time_ms").isNotNull() & F.col("lap_time_ms").isNotNull()
    chain = scan(
        laps, series(keys, ("lap_number",), None if chunk_rows is None else 64),
        __before=latest(F.when(timed, F.col("lap_end_time_ms")), inclusive=False),
    )
    cycle = (
        pits.where(F.col("lap_number").isNotNull())
        .select(*keys, F.explode(F.array(F.col("lap_number"), F.col("lap_number") + 1)).alias("lap_number"))
        .distinct().withColumn("in_pit_cycle", F.lit(True))
    )
    rows = (
        chain.join(lap_context(laps, weather, control, chunk_rows), LAP, "left")
        .join(driver_context(laps, positions, pits, chunk_rows), LAP, "left")
        .join(cycle, LAP, "left")
    )
    no = F.lit(False)
    restart = timed & F.coalesce(
        F.col("last_restart_ms") >= F.coalesce(F.col("__before"), F.lit(-1)), no
    )
    rows = rows.withColumn("is_restart", restart).withColumn("in_pit_cycle", F.coalesce("in_pit_cycle", no))
    invalid = (
        F.coalesce("is_deleted", no) | F.coalesce("is_generated", no) | ~F.coalesce("is_accurate", F.lit(True))
    )
    reason = (
        F.when(F.col("lap_end_time_ms").isNull(), "missing_timing")
        .when(F.col("is_restart"), "restart_lap")
        .when(F.col("lap_number") <= 1, "opening_lap")
        .when(F.col("lap_time_ms").isNull(), "missing_timing")
        .when(~F.col("lap_time_ms").between(rules.min_lap_ms, rules.max_lap_ms), "implausible_lap_time")
        .when(invalid, "invalid_lap")
        .when(~F.coalesce(F.col("compound").isin(*DRY_COMPOUNDS), no), "unsupported_compound")
        .when(F.col("in_pit_cycle"), "pit_cycle")
        .when(~F.coalesce("is_dry", no), "wet_or_unknown_weather")
        .when(~track_clear(F.col("raw_track_status")), "neutralized_or_unknown_track")
    )
    return rows.withColumn("reason", reason).drop("__before")


def clean_history(labelled: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Times of the last three eligible laps up to each eligible lap."""
    rows = labelled.where(F.col("reason").isNull()).select(*LAP, "lap_time_ms", "lap_end_time_ms")
    return trailing(
        rows, series(("session_id", "driver_id"), ("lap_number",), chunk_rows), 3, recent=F.col("lap_time_ms").cast("double")
    )


def _median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n == 1, F.element_at(s, 1)).when(n == 2, (F.element_at(s, 1) + F.element_at(s, 2)) / 2).otherwise(F.element_at(s, 2))


def _spread(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.size(a))


def features(labelled: DataFrame, rules: Rules = Rules(), chunk_rows: int | None = None) -> DataFrame:
    """Feature columns of each lap, or the reason it has none."""
    history = clean_history(labelled, chunk_rows).select(*LAP, "recent")
    rows = labelled.join(history, LAP, "left")
    n = F.size("recent")
    trend = F.when(n < 2, 0.0).otherwise((F.element_at("recent", -1) - F.element_at("recent", 1)) / (n - 1))
    values = {
        "tyre_age_laps": F.col("tyre_life_laps"),
        "latest_lap_ms": F.col("lap_time_ms").cast("double"),
        "rolling_median_3_ms": _median(F.col("recent")),
        "rolling_std_3_ms": _spread(F.col("recent")),
        "rolling_trend_3_ms": trend,
        "track_temperature_c": F.col("weather.track_temperature_c"),
        "air_temperature_c": F.col("weather.air_temperature_c"),
        "humidity_percent": F.col("weather.humidity_percent"),
        **{f"compound_{c}": (F.col("compound") == c).cast("double") for c in DRY_COMPOUNDS},
    }
    wide = rows.withColumns(values)
    w = F.col("weather")
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("tyre_life_laps").isNull(), "missing_tyre_age")
        .when(F.col("stint_number").isNull(), "missing_stint")
        .when(F.col("is_lapped"), "lapped_driver_unsupported")
        .when(F.coalesce(F.size("recent"), F.lit(0)) < 2, "insufficient_clean_history")
        .when(w.isNull(), "missing_weather")
        .when(
            w["track_temperature_c"].isNull() | w["air_temperature_c"].isNull() | w["humidity_percent"].isNull(),
            "missing_weather_fields",
        )
        .when(F.col("race_position").isNull(), "missing_race_position")
    )
    for name in FEATURES:
        low, high = rules.domains[name]
        c = F.col(name).cast("double")
        reason = reason.when((c < low) | (c > high), f"out_of_distribution:{name}")
    age, lap = F.col("tyre_age_laps"), F.col("lap_number")
    return wide.withColumn("feature_reason", reason).withColumns(
        {
            "tyre_age_squared": age * age,
            "tyre_age_x_lap": age * lap,
            "tyre_age_x_track_temperature": age * F.col("track_temperature_c"),
        }
    )


def features_at(featured: DataFrame, cutoffs: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Features at arbitrary times: those of the last lap completed by then.

    ``cutoffs``: session_id, driver_id, cursor_ms.
    """
    done = featured.where(F.col("lap_end_time_ms").isNotNull())
    row = F.struct(*[c for c in featured.columns if c not in ("session_id", "driver_id")])
    packed = done.select("session_id", "driver_id", F.col("lap_end_time_ms").alias("at"), F.col("lap_number").alias("n"), row.alias("f"))
    found = asof_backward(cutoffs, packed, ["session_id", "driver_id"], "cursor_ms", "at", ["n", "f"], chunk_rows)
    return found.select(
        *cutoffs.columns, "f.*"
    ).withColumn("feature_reason", F.when(F.col("lap_number").isNull(), "no_completed_lap").otherwise(F.col("feature_reason")))


def pace_examples(featured: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Features with the next lap as target, or the reason there is no example."""
    chain = scan(
        featured, series(("session_id", "driver_id"), ("lap_number",), chunk_rows),
        __n=following(F.struct("lap_number", "lap_time_ms", "lap_end_time_ms", "reason")),
    )
    n = F.col("__n")
    adjacent = n["lap_number"] == F.col("lap_number") + 1
    ready = F.coalesce(adjacent & n["lap_time_ms"].isNotNull() & n["lap_end_time_ms"].isNotNull(), F.lit(False))
    verdict = (
        F.when(F.col("feature_reason").isNotNull(), F.concat(F.lit("pace:"), F.col("feature_reason")))
        .when(~ready, "pace:missing_target")
        .when(n["reason"].isNotNull(), F.concat(F.lit("pace:target:"), n["reason"]))
    )
    return chain.select(
        *[c for c in featured.columns if c not in ("weather", "recent")],
        verdict.alias("rejection"), n["lap_number"].alias("target_lap"), n["lap_end_time_ms"].alias("target_time_ms"),
        n["lap_time_ms"].cast("double").alias("target_lap_time_ms"),
        (n["lap_time_ms"] - F.col("rolling_median_3_ms")).alias("target_pace_residual_ms"),
    )


def pit_loss_examples(labelled: DataFrame, pits: DataFrame, rules: Rules = Rules(), chunk_rows: int | None = None) -> DataFrame:
    """Effective loss of each stop: in-lap plus out-lap minus twice the clean pace."""
    keys = ["session_id", "driver_id"]
    fields = (
        "lap_number", "lap_time_ms", "lap_start_time_ms", "lap_end_time_ms", "is_deleted", "is_generated",
        "is_restart", "raw_track_status", "is_dry", "compound",
    )
    chain = scan(
        labelled, series(keys, ("lap_number",), chunk_rows), __n=following(F.struct(*fields))
    ).select(*keys, F.col("lap_number"), F.struct(*fields).alias("i"), F.col("__n").alias("o"))
    history = clean_history(labelled, chunk_rows).select(
        *keys, F.col("lap_number").alias("at_lap"), "recent", F.col("lap_end_time_ms").alias("clean_end")
    )
    rows = pits.join(chain, [*keys, "lap_number"], "left").withColumn("__lap", F.col("lap_number").cast("long"))
    rows = asof_backward(
        rows, history.withColumn("at_lap", F.col("at_lap").cast("long")), keys, "__lap", "at_lap",
        ["recent", "clean_end"], chunk_rows, strict=True,
    )
    i, o = F.col("i"), F.col("o")
    no = F.lit(False)
    has_out = F.coalesce(o["lap_number"] == i["lap_number"] + 1, no)

    def plausible(x: Column) -> Column:
        return x["lap_time_ms"].between(rules.min_lap_ms, rules.max_lap_ms)

    def flawed(x: Column) -> Column:
        return (
            x["lap_start_time_ms"].isNull() | x["lap_end_time_ms"].isNull() | ~plausible(x)
            | F.coalesce(x["is_deleted"], no) | F.coalesce(x["is_generated"], no)
        )

    def dry(x: Column) -> Column:
        return F.coalesce(x["compound"].isin(*DRY_COMPOUNDS), no)

    loss = (i["lap_time_ms"] + o["lap_time_ms"]) - 2.0 * _median(F.col("recent"))
    verdict = (
        F.when(
            F.col("lap_number").isNull() | F.col("pit_in_time_ms").isNull() | F.col("pit_out_time_ms").isNull()
            | F.col("pit_lane_duration_ms").isNull(), "incomplete_record",
        )
        .when(i.isNull() | ~has_out | i["lap_time_ms"].isNull() | o["lap_time_ms"].isNull(), "missing_cycle_timing")
        .when(flawed(i) | flawed(o), "invalid_cycle_timing")
        .when(i["is_restart"] | o["is_restart"], "red_flag_restart_cycle")
        .when(~(track_clear(i["raw_track_status"]) & track_clear(o["raw_track_status"])), "neutralized_or_unknown_track")
        .when(~(F.coalesce(i["is_dry"], no) & F.coalesce(o["is_dry"], no)), "wet_or_unknown_weather")
        .when(~dry(i) | ~dry(o), "unsupported_compound")
        .when(F.coalesce(F.size("recent"), F.lit(0)) < 2, "insufficient_clean_history")
        .when(~loss.between(rules.min_pit_loss_ms, rules.max_pit_loss_ms), "implausible_effective_loss")
        .when(F.col("clean_end").isNull() | (F.col("pit_in_time_ms") <= F.col("clean_end")), "noncausal_cutoff")
    )
    return rows.select(
        *pits.columns, F.when(verdict.isNotNull(), F.concat(F.lit("pit:"), verdict)).alias("rejection"),
        F.col("clean_end").alias("cutoff_time_ms"), F.col("pit_out_time_ms").alias("target_time_ms"),
        loss.alias("target_effective_loss_ms"),
    )


def assign_split(examples: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach the chronological split of each example's session."""
    return examples.join(corpus.select("session_id", "split"), "session_id")


def split_issues(corpus: DataFrame) -> DataFrame:
    """Repeated sessions, sessions in several splits, and absent splits."""
    per = corpus.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), (F.min("split") != F.max("split")).alias("mixed")
    ).where((F.col("n") > 1) | F.col("mixed"))
    names = ["train", "validation", "calibration", "test"]
    seen = corpus.select("split").distinct()
    wanted = corpus.sparkSession.createDataFrame([(n,) for n in names], "split string")
    return per.select(
        F.col("session_id").cast("string").alias("subject"),
        F.when(F.col("mixed"), "session-in-several-splits").otherwise("repeated-session").alias("issue"),
    ).unionByName(
        wanted.join(seen, "split", "left_anti").select(F.col("split").alias("subject"), F.lit("missing-split").alias("issue"))
    )
