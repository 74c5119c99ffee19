"""Ridge regression, metrics, calibration and batch prediction."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators.features import FEATURES, NONLINEAR
from lapwing.operators.percentiles import conformal_rank, grouped_percentiles

LINEAR_NAMES = tuple(FEATURES)
NONLINEAR_NAMES = (*LINEAR_NAMES, *NONLINEAR)

# Strengths of the penalty, for the linear and the nonlinear ridge.
PACE_STRENGTHS = (25.0, 40.0)
TYRE_STRENGTHS = (40.0, 60.0)


@dataclass(frozen=True)
class Ridge:
    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    regularization: float

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Ridge:
        raw = json.loads(text)
        for name in ("names", "means", "scales", "coefficients"):
            raw[name] = tuple(raw[name])
        return Ridge(**raw)


def fit_ridge(df: DataFrame, names: Sequence[str], target: str, regularization: float) -> Ridge:
    """Closed-form ridge on z-scores with scale at least 1.

    Two distributed aggregations, moments and then the Gram matrix, each
    returning one row; only a matrix as wide as the features is solved here.
    """
    rows = df.select(*[F.col(n).cast("double").alias(n) for n in names], F.col(target).cast("double").alias("__y"))
    first = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("__y").alias("__y"),
        *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names],
    ).head()
    if not first["n"]:
        raise ValueError("training rows are empty")
    means = [first[f"m_{n}"] for n in names]
    scales = [max(1.0, first[f"s_{n}"]) for n in names]
    z = [(F.col(n) - F.lit(m)) / F.lit(s) for n, m, s in zip(names, means, scales)]
    y = F.col("__y") - F.lit(first["__y"])
    width = len(names)
    cells = {(i, j): F.sum(z[i] * z[j]).alias(f"g_{i}_{j}") for i in range(width) for j in range(i, width)}
    second = rows.agg(*cells.values(), *[F.sum(z[i] * y).alias(f"r_{i}") for i in range(width)]).head()
    gram = np.zeros((width, width))
    for i, j in cells:
        gram[i, j] = gram[j, i] = second[f"g_{i}_{j}"]
    gram += regularization * np.eye(width)
    solved = np.linalg.solve(gram, np.array([second[f"r_{i}"] for i in range(width)]))
    return Ridge(
        tuple(names), tuple(means), tuple(scales), tuple(float(c) for c in solved),
        float(first["__y"]), float(regularization),
    )


def score_ridge(model: Ridge, override: dict[str, Column] | None = None) -> Column:
    """Prediction as one linear column expression."""
    given = override or {}
    out = F.lit(model.intercept)
    for name, mean, scale, weight in zip(model.names, model.means, model.scales, model.coefficients):
        c = given.get(name, F.col(name)).cast("double")
        out = out + F.lit(weight) * ((c - F.lit(mean)) / F.lit(scale))
    return out


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str], chunk_rows: int) -> DataFrame:
    """MAE, RMSE and median absolute error per group."""
    rows = df.withColumn("__e", F.abs(F.col(actual) - F.col(predicted)))
    basics = rows.groupBy(*by).agg(
        F.avg("__e").alias("mae_ms"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse_ms"),
        F.count(F.lit(1)).alias("count"),
    )
    medians = grouped_percentiles(rows, by, "__e", {"median_ae_ms": 0.5}, chunk_rows).drop("samples")
    if not by:
        return basics.withColumn("median_ae_ms", medians.select("median_ae_ms").scalar())
    return basics.join(medians, list(by))


def conformal_widths(df: DataFrame, actual: str, predicted: str, by: Sequence[str], chunk_rows: int) -> DataFrame:
    """80 and 90 per cent half-widths from calibration residuals."""
    rows = df.withColumn("__r", F.col(actual) - F.col(predicted))
    return conformal_rank(rows, by, "__r", {"width_80": 0.8, "width_90": 0.9}, chunk_rows)


def interval_coverage(df: DataFrame, actual: str, predicted: str, widths: dict[str, float]) -> DataFrame:
    """Share of rows whose error lies within each half-width."""
    error = F.abs(F.col(actual) - F.col(predicted))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg((error <= F.lit(float(w))).cast("double")).alias(f"coverage_{n}") for n, w in widths.items()],
    )


def select_model(validation: DataFrame, target: str, candidates: dict[str, Column]) -> tuple[str, dict[str, float]]:
    """Candidate with the smallest validation MAE (first one on ties)."""
    row = validation.agg(
        *[F.avg(F.abs(F.col(target) - c)).alias(f"c{i}") for i, c in enumerate(candidates.values())]
    ).head()
    scores = {name: row[f"c{i}"] for i, name in enumerate(candidates)}
    return min(scores, key=scores.__getitem__), scores


def aged(age: Column) -> dict[str, Column]:
    """Feature columns that change with the tyre age while all else stays."""
    return {
        "tyre_age_laps": age, "tyre_age_squared": age * age, "tyre_age_x_lap": age * F.col("lap_number"),
        "tyre_age_x_track_temperature": age * F.col("track_temperature_c"),
    }


@dataclass(frozen=True)
class Choice:
    """The model chosen for one target: a ridge, or a baseline column (0 where it has none)."""

    target: str
    selected: str
    model: Ridge | None
    baseline: str | None
    validation_mae: dict[str, float]
    widths: dict[str, float]

    def prediction(self, override: dict[str, Column] | None = None) -> Column:
        if self.model is not None:
            return score_ridge(self.model, override)
        return F.lit(0.0) if self.baseline is None else F.col(self.baseline).cast("double")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Choice:
        raw = json.loads(text)
        if raw["model"] is not None:
            raw["model"] = Ridge.from_json(json.dumps(raw["model"]))
        return Choice(**raw)


def train_candidates(
    train: DataFrame, validation: DataFrame, calibration: DataFrame, target: str, baseline: str | None,
    linear: float, nonlinear: float, chunk_rows: int, names: Sequence[str] = LINEAR_NAMES,
    more_names: Sequence[str] = NONLINEAR_NAMES,
) -> Choice:
    """The best of a baseline and two ridges by validation MAE, with widths from the calibration rows.

    ``baseline`` is the column that the baseline predicts, None for zero.
    """
    models: dict[str, Ridge | None] = {
        "zero-residual-baseline" if baseline is None else "rolling-median-baseline": None,
        "ridge-linear": fit_ridge(train, names, target, linear),
        "ridge-nonlinear": fit_ridge(train, more_names, target, nonlinear),
    }
    candidates = {name: Choice(target, name, model, baseline, {}, {}) for name, model in models.items()}
    name, scores = select_model(validation, target, {n: c.prediction() for n, c in candidates.items()})
    chosen = candidates[name]
    rows = calibration.withColumn("__p", chosen.prediction())
    return replace(chosen, validation_mae=scores, widths=_widths(rows, target, "__p", chunk_rows))


def _widths(rows: DataFrame, actual: str, predicted: str, chunk_rows: int) -> dict[str, float]:
    row = conformal_widths(rows, actual, predicted, (), chunk_rows).head()
    if row is None or row["width_80"] is None:
        raise ValueError("calibration rows are empty")
    return {"80": float(row["width_80"]), "90": float(row["width_90"])}


@dataclass(frozen=True)
class PitChoice:
    """The chosen pit-loss estimator; the circuits of its training rows are a table beside it."""

    selected: str
    global_median: float
    validation_mae: dict[str, float]
    widths: dict[str, float]


@dataclass(frozen=True)
class Bundle:
    """Everything scoring needs.  ``circuits`` has a row per trained circuit with its median, null where the global one
    holds."""

    pace: Choice
    tyre: Choice
    pit: PitChoice
    circuits: DataFrame

    def write(self, path: str) -> None:
        """Store as two Parquet tables below ``path``."""
        spark = self.circuits.sparkSession
        row = (self.pace.to_json(), self.tyre.to_json(), json.dumps(asdict(self.pit)))
        spark.createDataFrame([row], "pace string, tyre string, pit string").write.parquet(f"{path}/models")
        self.circuits.write.parquet(f"{path}/circuits")


def read_bundle(spark: SparkSession, path: str) -> Bundle:
    row = spark.read.parquet(f"{path}/models").head()
    return Bundle(
        Choice.from_json(row["pace"]), Choice.from_json(row["tyre"]), PitChoice(**json.loads(row["pit"])),
        spark.read.parquet(f"{path}/circuits"),
    )


def train_pit(
    train: DataFrame, validation: DataFrame, calibration: DataFrame, loss: str, circuit: str, chunk_rows: int
) -> tuple[PitChoice, DataFrame]:
    """The pit-loss estimator by validation MAE and the circuits it knows (circuit, circuit_median)."""
    row = prefer_circuit_median(pit_estimates(validation, train, loss, circuit, chunk_rows), loss).head()
    overall = grouped_percentiles(train, (), loss, {"m": 0.5}, chunk_rows).head()
    if overall is None or row["global_mae"] is None:
        raise ValueError("training and validation stops are empty")
    by_circuit = row["selected"] != "global-median"
    known = train.select(circuit).distinct()
    medians = pit_medians(train, loss, circuit, chunk_rows)
    circuits = known.join(medians, circuit, "left") if by_circuit else known.withColumn(
        "circuit_median", F.lit(None).cast("double")
    )
    middle = float(overall["m"])
    estimated = calibration.join(circuits, circuit, "left").withColumn("__p", F.coalesce("circuit_median", F.lit(middle)))
    choice = PitChoice(
        row["selected"], middle,
        {"global-median": row["global_mae"], "circuit-median-with-global-fallback": row["circuit_mae"]},
        _widths(estimated, loss, "__p", chunk_rows),
    )
    return choice, circuits


def train_bundle(
    pace: DataFrame, stops: DataFrame, chunk_rows: int, circuit: str = "circuit_id",
    pace_target: str = "target_lap_time_ms", tyre_target: str = "target_pace_residual_ms",
    loss: str = "target_effective_loss_ms", names: Sequence[str] = LINEAR_NAMES, more_names: Sequence[str] = NONLINEAR_NAMES,
) -> Bundle:
    """Models of the next lap, of its distance from recent pace, and of the loss at a stop.

    ``pace`` and ``stops`` are examples with their ``split``; an empty split is an error.
    """
    part = {name: pace.where(F.col("split") == name) for name in ("train", "validation", "calibration")}
    choices = {
        target: train_candidates(*part.values(), target, baseline, *strengths, chunk_rows, names, more_names)
        for target, baseline, strengths in (
            (pace_target, "rolling_median_3_ms", PACE_STRENGTHS), (tyre_target, None, TYRE_STRENGTHS)
        )
    }
    halves = [stops.where(F.col("split") == name) for name in ("train", "validation", "calibration")]
    pit, circuits = train_pit(*halves, loss, circuit, chunk_rows)
    return Bundle(choices[pace_target], choices[tyre_target], pit, circuits)


def bundle_metrics(pace: DataFrame, choice: Choice) -> DataFrame:
    """Test error of a chosen model and of its baseline, and the coverage of its widths."""
    error = F.abs(F.col(choice.target) - choice.prediction())
    plain = F.abs(F.col(choice.target) - replace(choice, model=None).prediction())
    return pace.where(F.col("split") == "test").agg(
        F.lit(choice.target).alias("target"), F.lit(choice.selected).alias("selected"), F.count(F.lit(1)).alias("rows"),
        F.avg(error).alias("mae_ms"), F.sqrt(F.avg(error * error)).alias("rmse_ms"), F.avg(plain).alias("baseline_mae_ms"),
        *[F.avg((error <= F.lit(w)).cast("double")).alias(f"coverage_{n}") for n, w in choice.widths.items()],
    )


def pit_medians(train: DataFrame, loss: str, circuit: str, chunk_rows: int, minimum: int = 3) -> DataFrame:
    """Median loss of circuits with at least ``minimum`` samples."""
    return grouped_percentiles(train, [circuit], loss, {"circuit_median": 0.5}, chunk_rows).where(
        F.col("samples") >= minimum
    ).drop("samples")


def pit_estimates(rows: DataFrame, train: DataFrame, loss: str, circuit: str, chunk_rows: int) -> DataFrame:
    """Circuit median where supported, else the global median."""
    overall = grouped_percentiles(train, (), loss, {"global_median": 0.5}, chunk_rows).select("global_median")
    return rows.join(pit_medians(train, loss, circuit, chunk_rows), circuit, "left").withColumn(
        "global_median", overall.scalar()
    ).withColumn("estimate", F.coalesce("circuit_median", "global_median"))


def prefer_circuit_median(validation: DataFrame, loss: str, slack: float = 0.10) -> DataFrame:
    """Which pit estimator wins: the circuit one unless more than 10 % worse."""
    maes = validation.agg(
        F.avg(F.abs(F.col(loss) - F.col("global_median"))).alias("global_mae"),
        F.avg(F.abs(F.col(loss) - F.col("estimate"))).alias("circuit_mae"),
    )
    best = F.least("global_mae", "circuit_mae")
    return maes.withColumn(
        "selected",
        F.when(F.col("circuit_mae") <= best * (1 + slack), "circuit-median-with-global-fallback").otherwise("global-median"),
    )


def predict(
    featured: DataFrame, bundle: Bundle, circuit: str = "circuit_id", finished: str = "session_finished",
    min_lap_ms: float = 50_000, max_lap_ms: float = 300_000, max_residual_ms: float = 30_000, horizon: int = 5,
) -> DataFrame:
    """Lap predictions of a trained bundle: intervals, a monotone wear curve, the loss at a stop, or the guard that fails.

    ``featured`` holds the features with ``feature_reason``, the circuit and whether the session has finished.  The curve
    takes the running maximum of the added loss, so it never falls.
    """
    pace, tyre, pit = bundle.pace, bundle.tyre, bundle.pit
    known = bundle.circuits.select(
        F.col(circuit), F.lit(True).alias("__known"), F.col("circuit_median").cast("double").alias("__median")
    )
    age = F.col("tyre_age_laps").cast("double")
    base = featured.join(known, circuit, "left").withColumns(
        {
            "__pace": pace.prediction(), "__now": tyre.prediction(aged(age)),
            **{f"__f{h}": tyre.prediction(aged(age + h)) for h in range(1, horizon + 1)},
            "__loss": F.coalesce("__median", F.lit(pit.global_median)),
        }
    )
    ahead = [F.col(f"__f{h}") for h in range(1, horizon + 1)]
    wild = F.abs(F.col("__now")) > max_residual_ms
    for f in ahead:
        wild = wild | (F.abs(f) > max_residual_ms)
    reason = (
        F.when(F.coalesce(F.col(finished), F.lit(False)), "session_finished")
        .when(F.col("feature_reason").isNotNull(), F.col("feature_reason"))
        .when(F.col("__known").isNull(), "unsupported_circuit")
        .when(age + horizon > 100, "tyre_forecast_out_of_distribution")
        .when(~F.col("__pace").between(min_lap_ms, max_lap_ms), "implausible_pace_output")
        .when(F.col("__pace") - pace.widths["90"] <= 0, "implausible_prediction_interval")
        .when(wild, "implausible_tyre_output")
    )
    steps = [F.greatest(F.lit(0.0), f - F.col("__now")) for f in ahead]
    curve = [F.greatest(*steps[: i + 1]) if i else steps[0] for i in range(horizon)]
    ok = reason.isNull()

    def whole(value: Column, name: str) -> Column:
        return F.when(ok, F.bround(value, 0)).alias(name)

    return base.select(
        "session_id", "driver_id", "lap_number", reason.alias("unavailable_reason"),
        whole(F.col("__pace"), "predicted_lap_ms"),
        *[whole(F.col("__pace") - w, f"lower_{n}") for n, w in pace.widths.items()],
        *[whole(F.col("__pace") + w, f"upper_{n}") for n, w in pace.widths.items()],
        whole(F.col("__now"), "residual_ms"),
        *[whole(F.lit(w), f"residual_width_{n}") for n, w in tyre.widths.items()],
        F.when(ok, F.array(*[F.bround(c, 0) for c in curve])).alias("curve"),
        whole(F.col("__loss"), "pit_loss_ms"),
        *[whole(F.greatest(F.lit(0.0), F.col("__loss") - w), f"pit_lower_{n}") for n, w in pit.widths.items()],
        *[whole(F.col("__loss") + w, f"pit_upper_{n}") for n, w in pit.widths.items()],
    )


def project_lap(
    rows: DataFrame, residual, width_80: float, width_90: float, reach: float = 5.0,
    low_ms: float = 45_000, high_ms: float = 330_000,
) -> DataFrame:
    """Projected lap time at a tyre age; widths grow beyond the known horizon.

    ``rows``: anchor_ms, tyre_age, anchor_age and feature columns.  Ages past
    the anchor age plus ``reach`` are capped and flagged.
    """
    capped = F.least(F.col("tyre_age"), F.col("anchor_age") + reach)
    extra = F.greatest(F.lit(0.0), F.col("tyre_age") - capped)
    widening = F.sqrt(1.0 + extra / reach)
    mean = F.col("anchor_ms") + residual(capped)
    inside = mean.between(low_ms, high_ms)
    return rows.withColumn("mean_lap_ms", F.when(inside, mean)).withColumn(
        "width_80_ms", F.when(inside, F.lit(width_80) * widening)
    ).withColumn("width_90_ms", F.when(inside, F.lit(width_90) * widening)).withColumn(
        "horizon_exceeded", F.col("tyre_age") > capped
    ).withColumn("rejected", F.when(~inside, "outside_supported_domain"))
