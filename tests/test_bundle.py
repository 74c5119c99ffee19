"""Trained bundles: selection, storing, guards and intervals of predictions."""

import tempfile

import pytest
from pyspark.sql import functions as F

from lapwing.operators import learning as L

NAMES, MORE = ("tyre_age_laps", "track_temperature_c"), ("tyre_age_laps", "track_temperature_c", "tyre_age_squared")


@pytest.fixture(scope="module")
def laps(spark):
    """Lap time 80 s, 3 ms a square lap of tyre age and some repeating noise; stops of all circuits but one are trained on."""
    rows = spark.range(4000).select(
        F.col("id").alias("session_id"), (F.col("id") % 20).alias("driver_id"), (F.col("id") % 50 + 2).alias("lap_number"),
        F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("circuit_id"), (F.col("id") * 7 % 41).cast("double").alias("tyre_age_laps"),
        F.lit(30.0).alias("track_temperature_c"), F.lit(80_000.0).alias("rolling_median_3_ms"),
        (F.col("id") * 31 % 101 - 50).cast("double").alias("noise"),
        F.element_at(F.array(*map(F.lit, ("train", "train", "validation", "calibration", "test"))), (F.col("id") % 5 + 1).cast("int")).alias("split"),
    )
    age = F.col("tyre_age_laps")
    lost = 3.0 * age * age + F.col("noise")
    return rows.withColumns(
        {
            "tyre_age_squared": age * age, "target_lap_time_ms": 80_000 + lost, "target_pace_residual_ms": lost,
            "target_effective_loss_ms": 20_000.0 + 1000 * F.substring("circuit_id", 2, 1).cast("int"),
            "feature_reason": F.lit(None).cast("string"), "session_finished": F.lit(False),
        }
    )


@pytest.fixture(scope="module")
def bundle(laps):
    return L.train_bundle(laps, laps.where("circuit_id <> 'c6'"), 500, names=NAMES, more_names=MORE)


def test_the_curved_model_wins_and_its_widths_hold_the_noise(laps, bundle):
    for choice in (bundle.pace, bundle.tyre):
        assert choice.selected == "ridge-nonlinear" and len(choice.validation_mae) == 3
        assert min(choice.validation_mae.values()) == choice.validation_mae["ridge-nonlinear"]
        assert choice.widths["80"] < choice.widths["90"]
        row = L.bundle_metrics(laps, choice).head()
        assert row["mae_ms"] < 0.2 * row["baseline_mae_ms"]
        assert abs(row["coverage_80"] - 0.8) < 0.05 and abs(row["coverage_90"] - 0.9) < 0.05
    assert bundle.pit.selected == "circuit-median-with-global-fallback"


def test_a_baseline_that_is_right_is_kept(laps):
    flat = laps.withColumn("target_lap_time_ms", F.col("rolling_median_3_ms")).withColumn("target_pace_residual_ms", F.lit(0.0))
    trained = L.train_bundle(flat, flat, 500, names=NAMES, more_names=MORE)
    assert (trained.pace.selected, trained.tyre.selected) == ("rolling-median-baseline", "zero-residual-baseline")
    assert trained.pace.model is None and trained.tyre.widths == {"80": 0.0, "90": 0.0}
    row = L.predict(flat, trained).head()
    assert row["predicted_lap_ms"] == 80_000 and list(row["curve"]) == [0.0] * 5


def test_a_stored_bundle_predicts_the_same(spark, laps, bundle):
    path = tempfile.mkdtemp(prefix="bundle-") + "/b"
    bundle.write(path)
    again = L.read_bundle(spark, path)
    assert (again.pace, again.tyre, again.pit) == (bundle.pace, bundle.tyre, bundle.pit)
    assert L.predict(laps, bundle).exceptAll(L.predict(laps, again)).isEmpty()


def test_predictions_state_intervals_and_a_curve_that_never_falls(laps, bundle):
    rows = L.predict(laps, bundle).where("unavailable_reason IS NULL").limit(200).collect()
    for row in rows:
        assert row["lower_90"] <= row["lower_80"] <= row["predicted_lap_ms"] <= row["upper_80"] <= row["upper_90"]
        assert list(row["curve"]) == sorted(row["curve"]) and row["curve"][0] > 0
        assert 0 <= row["pit_lower_90"] <= row["pit_loss_ms"] <= row["pit_upper_90"]


@pytest.mark.parametrize(
    ("reason", "changes"),
    [
        ("session_finished", {"session_finished": True, "feature_reason": "opening_lap"}),
        ("opening_lap", {"feature_reason": "opening_lap", "circuit_id": "elsewhere"}),
        ("unsupported_circuit", {"circuit_id": "elsewhere", "tyre_age_laps": 99.0}),
        ("unsupported_circuit", {"circuit_id": None}),
        ("tyre_forecast_out_of_distribution", {"tyre_age_laps": 96.0}),
        ("implausible_pace_output", {"tyre_age_laps": 90.0, "tyre_age_squared": 10.0**6}),
        (None, {"session_finished": None}),
    ],
)
def test_guards_in_order(laps, bundle, reason, changes):
    kinds = dict(laps.dtypes)
    row = laps.limit(1).withColumns({name: F.lit(value).cast(kinds[name]) for name, value in changes.items()})
    out = L.predict(row, bundle).head()
    assert out["unavailable_reason"] == reason
    assert (out["predicted_lap_ms"] is None) == (reason is not None) == (out["pit_loss_ms"] is None)


def test_wild_residuals_and_wide_intervals_are_refused(laps, bundle):
    from dataclasses import replace

    row = laps.where("tyre_age_laps = 40").limit(1)
    assert L.predict(row, bundle, max_residual_ms=5_500).head()["unavailable_reason"] == "implausible_tyre_output"
    wide = replace(bundle, pace=replace(bundle.pace, widths={"80": 1.0, "90": 90_000.0}))
    assert L.predict(row, wide).head()["unavailable_reason"] == "implausible_prediction_interval"


def test_empty_splits_are_errors(laps):
    with pytest.raises(ValueError):
        L.train_bundle(laps.where("split <> 'calibration'"), laps, 500, names=NAMES, more_names=MORE)
    with pytest.raises(ValueError):
        L.train_bundle(laps, laps.where("split <> 'train'"), 500, names=NAMES, more_names=MORE)
