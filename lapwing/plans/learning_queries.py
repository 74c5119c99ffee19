"""As-of lookups, causal features, training and scoring queries."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from lapwing.operators import asof as J
from lapwing.operators import features as M
from lapwing.operators import learning as L
from lapwing.operators.digest import rejections
from lapwing.operators.scan import following, scan, series, trailing
from lapwing.plans.registry import query
from lapwing.plans.replay_queries import PITS_SQL, W_TIMING, canonical
from lapwing.plans.standin import ROWS, TIMING_SQL, stored, table, timing
from lapwing.session import shared_path

W_FEED = "WITH " + TIMING_SQL
CAR = ["session_id", "driver_id"]
RULES = M.Rules(
    min_lap_ms=1_000_000, max_lap_ms=80_000_000, min_pit_loss_ms=1_000.0, max_pit_loss_ms=60_000_000.0,
    domains={
        **M.FEATURES, "latest_lap_ms": (0, 10**9), "rolling_median_3_ms": (0, 10**9), "rolling_std_3_ms": (0, 10**9),
        "rolling_trend_3_ms": (-(10**9), 10**9),
    },
)


def quiet(spark, folder):
    """Timing tables with all stops and less rain, so that clean laps exist."""
    v = canonical(spark, folder)
    sky = v.feed.where(F.col("event_type") == "view").select(
        "session_id", F.col("t_ms").alias("session_time_ms"), F.col("value").alias("air_temperature_c"),
        F.when(F.col("k") % 37 != 0, F.col("value") + 10).alias("track_temperature_c"),
        F.col("k").cast("double").alias("humidity_percent"),
        F.when(F.col("k") != 41, F.col("k") == 29).alias("rainfall"), "event_id",
    )
    return SimpleNamespace(feed=v.feed, laps=v.laps, weather=sky, control=v.control, pits=v.pits, positions=v.positions)


def labelled(spark, folder):
    v = quiet(spark, folder)
    return stored(
        spark, folder, "labelled",
        lambda: M.label_laps(v.laps, v.weather, v.control, v.pits, v.positions, RULES, ROWS),
    )


def featured(spark, folder):
    return stored(spark, folder, "featured", lambda: M.features(labelled(spark, folder), RULES, ROWS))


LABEL_SQL = PITS_SQL + """,
qw AS (SELECT session_id, t_ms AS session_time_ms, value AS air, CASE WHEN k % 37 <> 0 THEN value + 10 END AS track, CAST(k AS DOUBLE) AS hum, CASE WHEN k <> 41 THEN k = 29 END AS rain, event_id FROM feed WHERE event_type = 'view'),
rc AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY session_time_ms, event_id) AS rn, lower(trim(message)) = 'started' AS go FROM tc),
rd AS (SELECT *, max(CASE WHEN track_status = 'red-flag' THEN rn END) OVER (PARTITION BY session_id ORDER BY rn) AS red, max(CASE WHEN go THEN rn END) OVER (PARTITION BY session_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pgo FROM rc),
rst AS (SELECT session_id, session_time_ms AS restart_ms FROM rd WHERE go AND red > coalesce(pgo, 0)),
rl AS (SELECT DISTINCT tl.session_id, tl.driver_id, min(lap_number) AS lap_number FROM rst JOIN tl ON tl.session_id = rst.session_id AND lap_end_time_ms > restart_ms AND lap_time_ms IS NOT NULL GROUP BY tl.session_id, tl.driver_id, rst.restart_ms),
lx AS (SELECT tl.*, EXISTS (SELECT 1 FROM rl WHERE rl.session_id = tl.session_id AND rl.driver_id = tl.driver_id AND rl.lap_number = tl.lap_number) AS is_restart,
  EXISTS (SELECT 1 FROM tpit p WHERE p.session_id = tl.session_id AND p.driver_id = tl.driver_id AND p.lap_number IN (tl.lap_number, tl.lap_number - 1)) AS in_pit_cycle,
  coalesce((SELECT arg_max(rain IS NOT NULL AND NOT rain, (session_time_ms, event_id)) FROM qw WHERE qw.session_id = tl.session_id AND session_time_ms <= lap_start_time_ms), false)
   AND NOT EXISTS (SELECT 1 FROM qw WHERE qw.session_id = tl.session_id AND session_time_ms > lap_start_time_ms AND session_time_ms <= lap_end_time_ms AND coalesce(rain, true)) AS is_dry,
  (SELECT max(o.lap_number) FROM tl o WHERE o.session_id = tl.session_id AND o.lap_end_time_ms <= tl.lap_end_time_ms) > tl.lap_number AS is_lapped,
  (SELECT arg_max(qw, (session_time_ms, event_id)) FROM qw WHERE qw.session_id = tl.session_id AND session_time_ms <= lap_end_time_ms) AS w,
  (SELECT arg_max(position, session_time_ms) FROM tp WHERE tp.session_id = tl.session_id AND tp.driver_id = tl.driver_id AND session_time_ms <= lap_end_time_ms) AS race_position,
  (SELECT count(*) FROM tpit p WHERE p.session_id = tl.session_id AND p.driver_id = tl.driver_id AND pit_out_time_ms <= lap_end_time_ms) AS pit_count FROM tl),
lab AS (SELECT *, CASE WHEN is_restart THEN 'restart_lap' WHEN lap_number <= 1 THEN 'opening_lap' WHEN lap_time_ms IS NULL THEN 'missing_timing' WHEN lap_time_ms NOT BETWEEN 1000000 AND 80000000 THEN 'implausible_lap_time'
  WHEN is_deleted OR coalesce(is_generated, false) OR NOT is_accurate THEN 'invalid_lap' WHEN compound NOT IN ('soft','medium','hard') THEN 'unsupported_compound' WHEN in_pit_cycle THEN 'pit_cycle'
  WHEN NOT is_dry THEN 'wet_or_unknown_weather' WHEN coalesce(raw_track_status, '') <> '1' THEN 'neutralized_or_unknown_track' END AS reason FROM lx)"""

FEATURE_SQL = LABEL_SQL + """,
his AS (SELECT session_id, driver_id, lap_number, lap_end_time_ms AS clean_end, count(*) OVER w AS hn, median(lap_time_ms) OVER w AS med, stddev_pop(lap_time_ms) OVER w AS sd, first_value(lap_time_ms) OVER w AS fst, last_value(lap_time_ms) OVER w AS lst
  FROM lab WHERE reason IS NULL WINDOW w AS (PARTITION BY session_id, driver_id ORDER BY lap_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
fea AS (SELECT lab.*, hn, CAST(med AS DOUBLE) AS rolling_median_3_ms, sd AS rolling_std_3_ms, (lst - fst) / (hn - 1) AS rolling_trend_3_ms,
  CASE WHEN reason IS NOT NULL THEN reason WHEN tyre_life_laps IS NULL THEN 'missing_tyre_age' WHEN is_lapped THEN 'lapped_driver_unsupported' WHEN coalesce(hn, 0) < 2 THEN 'insufficient_clean_history'
   WHEN w IS NULL THEN 'missing_weather' WHEN w.track IS NULL THEN 'missing_weather_fields' WHEN race_position IS NULL THEN 'missing_race_position' WHEN lap_number > 200 THEN 'out_of_distribution:lap_number'
   WHEN stint_number > 20 THEN 'out_of_distribution:stint_number' WHEN pit_count > 20 THEN 'out_of_distribution:pit_count' WHEN w.track > 80 THEN 'out_of_distribution:track_temperature_c'
   WHEN w.air > 60 THEN 'out_of_distribution:air_temperature_c' END AS feature_reason FROM lab LEFT JOIN his USING (session_id, driver_id, lap_number))"""


@query("weather_asof", W_FEED + """
SELECT l.session_id, l.driver_id, l.lap_number, w.session_time_ms AS seen_ms, w.air_temperature_c FROM tl l ASOF LEFT JOIN tw w ON l.session_id = w.session_id AND l.lap_end_time_ms >= w.session_time_ms""")
def weather_asof(spark, folder):
    v = timing(spark, folder)
    sky = v.weather.select("session_id", F.col("session_time_ms").alias("seen_ms"), "air_temperature_c")
    rows = v.laps.select(*CAR, "lap_number", "lap_end_time_ms")
    return J.asof_backward(
        rows, sky, ["session_id"], "lap_end_time_ms", "seen_ms", ["seen_ms", "air_temperature_c"], ROWS
    ).drop("lap_end_time_ms")


@query("bracketing_samples", W_FEED + """
SELECT a.session_id, a.driver_id, a.event_id, b.t_ms AS before_ms, c.t_ms AS after_ms FROM (SELECT * FROM feed WHERE event_type = 'view') a
ASOF LEFT JOIN (SELECT * FROM feed WHERE event_type = 'click') b ON b.session_id = a.session_id AND b.driver_id = a.driver_id AND a.t_ms >= b.t_ms
ASOF LEFT JOIN (SELECT * FROM feed WHERE event_type = 'click') c ON c.session_id = a.session_id AND c.driver_id = a.driver_id AND a.t_ms < c.t_ms""")
def bracketing_samples(spark, folder):
    f = timing(spark, folder).feed
    points = f.where(F.col("event_type") == "view").select(*CAR, "event_id", "t_ms")
    clicks = f.where(F.col("event_type") == "click").select(*CAR, F.col("t_ms").alias("at"))
    out = J.bracket(points, clicks, CAR, "t_ms", "at", ["at"], ROWS)
    return out.select(*CAR, "event_id", F.col("before.at").alias("before_ms"), F.col("after.at").alias("after_ms"))


@query("forward_lookups", W_FEED + """
SELECT a.session_id, a.event_id, c.t_ms AS next_ms, c.value AS next_value FROM (SELECT * FROM feed WHERE event_type = 'error') a
ASOF LEFT JOIN (SELECT * FROM feed WHERE event_type = 'purchase') c ON c.session_id = a.session_id AND a.t_ms < c.t_ms""")
def forward_lookups(spark, folder):
    f = timing(spark, folder).feed
    points = f.where(F.col("event_type") == "error").select("session_id", "event_id", "t_ms")
    later = f.where(F.col("event_type") == "purchase").select(
        "session_id", F.col("t_ms").alias("next_ms"), F.col("value").alias("next_value")
    )
    return J.asof_forward(points, later, ["session_id"], "t_ms", "next_ms", ["next_ms", "next_value"], ROWS).drop("t_ms")


@query("wet_rows_within_laps", W_FEED + """
SELECT session_id, driver_id, lap_number, (SELECT count(*) FROM tw WHERE tw.session_id = tl.session_id AND session_time_ms > lap_start_time_ms AND session_time_ms <= lap_end_time_ms) AS observed,
  (SELECT count(*) FROM tw WHERE tw.session_id = tl.session_id AND session_time_ms > lap_start_time_ms AND session_time_ms <= lap_end_time_ms AND coalesce(rainfall, true)) AS wet FROM tl""")
def wet_rows_within_laps(spark, folder):
    v = timing(spark, folder)
    out = J.count_within(
        v.laps.select(*CAR, "lap_number", "lap_start_time_ms", "lap_end_time_ms"), v.weather, ["session_id"],
        [*CAR, "lap_number"], "lap_start_time_ms", "lap_end_time_ms", "session_time_ms",
        {"observed": F.lit(True), "wet": F.coalesce(F.col("rainfall"), F.lit(True))}, ROWS,
    )
    return out.select(*CAR, "lap_number", "observed", "wet")


@query("rolling_pace", W_FEED + """
SELECT session_id, driver_id, lap_number, count(*) OVER w AS laps, CAST(median(lap_time_ms) OVER w AS DOUBLE) AS median_ms, round(stddev_pop(lap_time_ms) OVER w, 2) AS std_ms FROM tl WHERE lap_time_ms IS NOT NULL
WINDOW w AS (PARTITION BY session_id, driver_id ORDER BY lap_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_pace(spark, folder):
    laps = timing(spark, folder).laps.where(F.col("lap_time_ms").isNotNull())
    rows = trailing(laps.select(*CAR, "lap_number", "lap_time_ms"), series(CAR, ("lap_number",), 16), 3, recent=F.col("lap_time_ms").cast("double"))
    return rows.select(
        *CAR, "lap_number", F.size("recent").cast("long").alias("laps"), M._median(F.col("recent")).alias("median_ms"),
        F.round(M._spread(F.col("recent")), 2).alias("std_ms"),
    )


@query("restart_times", W_TIMING + LABEL_SQL + " SELECT * FROM rst")
def restart_times(spark, folder):
    return M.restart_times(timing(spark, folder).control, ROWS)


@query("next_laps", W_FEED + """
SELECT session_id, driver_id, lap_number, CASE WHEN lead(lap_number) OVER w = lap_number + 1 THEN lead(lap_time_ms) OVER w END AS next_lap_ms FROM tl WINDOW w AS (PARTITION BY session_id, driver_id ORDER BY lap_number)""")
def next_laps(spark, folder):
    laps = timing(spark, folder).laps.select(*CAR, "lap_number", "lap_time_ms")
    rows = scan(laps, series(CAR, ("lap_number",), 64), n=following(F.struct("lap_number", "lap_time_ms")))
    return rows.select(
        *CAR, "lap_number", F.when(F.col("n.lap_number") == F.col("lap_number") + 1, F.col("n.lap_time_ms")).alias("next_lap_ms")
    )


@query("lap_eligibility", W_TIMING + LABEL_SQL + " SELECT session_id, driver_id, lap_number, is_restart, in_pit_cycle, is_dry, is_lapped, race_position, pit_count, reason FROM lab")
def lap_eligibility(spark, folder):
    return labelled(spark, folder).select(
        *CAR, "lap_number", "is_restart", "in_pit_cycle", "is_dry", "is_lapped", "race_position", "pit_count", "reason"
    )


FEATURE_COLUMNS = (*M.FEATURES, *M.NONLINEAR)
FEATURE_OUT = """feature_reason, tyre_life_laps AS tyre_age_laps, CAST(stint_number AS INT) AS stint_number, pit_count, race_position, CAST(lap_time_ms AS DOUBLE) AS latest_lap_ms, CASE WHEN reason IS NULL AND hn >= 2 THEN rolling_median_3_ms END AS rolling_median_3_ms,
  CASE WHEN reason IS NULL AND hn >= 2 THEN round(rolling_std_3_ms, 2) END AS rolling_std_3_ms, CASE WHEN reason IS NULL AND hn >= 2 THEN rolling_trend_3_ms END AS rolling_trend_3_ms, w.track AS track_temperature_c, w.air AS air_temperature_c, w.hum AS humidity_percent,
  CAST(compound = 'soft' AS DOUBLE) AS compound_soft, CAST(compound = 'medium' AS DOUBLE) AS compound_medium, CAST(compound = 'hard' AS DOUBLE) AS compound_hard,
  tyre_life_laps * tyre_life_laps AS tyre_age_squared, tyre_life_laps * lap_number AS tyre_age_x_lap, tyre_life_laps * w.track AS tyre_age_x_track_temperature"""


def all_features(rows):
    """The 18 feature columns; recent pace only where the feature set has it."""
    full = F.col("reason").isNull() & (F.size("recent") >= 2)
    recent = {n: F.when(full, F.round(n, 2) if "std" in n else F.col(n)) for n in FEATURE_COLUMNS if n.startswith("rolling")}
    return rows.withColumns({**recent, "stint_number": F.col("stint_number").cast("int")})


@query("lap_features", W_TIMING + FEATURE_SQL + " SELECT session_id, driver_id, lap_number, " + FEATURE_OUT + " FROM fea")
def lap_features(spark, folder):
    return all_features(featured(spark, folder)).select(*CAR, "feature_reason", *FEATURE_COLUMNS)


@query("feature_rejections", W_TIMING + FEATURE_SQL + " SELECT feature_reason, count(*) AS rows FROM fea WHERE feature_reason IS NOT NULL GROUP BY 1".replace("AS rows", 'AS "rows"'))
def feature_rejections(spark, folder):
    return rejections(featured(spark, folder), "feature_reason")


CUTOFF_SQL = """, cut AS (SELECT session_id, driver_id, c::BIGINT AS cursor_ms FROM (SELECT DISTINCT session_id, driver_id FROM feed), (VALUES (50000000), (300000000), (600000000)) v(c))"""


@query("features_at_cutoffs", W_TIMING + FEATURE_SQL + CUTOFF_SQL + ", ftf AS (SELECT session_id, driver_id, lap_number, lap_end_time_ms, " + FEATURE_OUT + """ FROM fea)
SELECT c.cursor_ms, c.session_id, c.driver_id, f.* EXCLUDE (session_id, driver_id, lap_end_time_ms, feature_reason), CASE WHEN f.lap_number IS NULL THEN 'no_completed_lap' ELSE feature_reason END AS feature_reason
FROM cut c ASOF LEFT JOIN ftf f ON f.session_id = c.session_id AND f.driver_id = c.driver_id AND c.cursor_ms >= f.lap_end_time_ms""")
def features_at_cutoffs(spark, folder):
    cars = timing(spark, folder).feed.select(*CAR).distinct()
    cutoffs = cars.withColumn("cursor_ms", F.explode(F.array(*[F.lit(c).cast("long") for c in (50_000_000, 300_000_000, 600_000_000)])))
    rows = all_features(featured(spark, folder)).select(*CAR, "lap_end_time_ms", "feature_reason", *FEATURE_COLUMNS)
    return M.features_at(rows, cutoffs, ROWS).select(*CAR, "cursor_ms", "feature_reason", *FEATURE_COLUMNS)


PACE_SQL = FEATURE_SQL + """,
nx AS (SELECT *, lead(lap_number) OVER w AS nl, lead(lap_time_ms) OVER w AS nt, lead(lap_end_time_ms) OVER w AS ne, lead(reason) OVER w AS nr FROM fea WINDOW w AS (PARTITION BY session_id, driver_id ORDER BY lap_number)),
pce AS (SELECT *, CASE WHEN feature_reason IS NOT NULL THEN 'pace:' || feature_reason WHEN nl IS NULL OR nl <> lap_number + 1 OR nt IS NULL THEN 'pace:missing_target' WHEN nr IS NOT NULL THEN 'pace:target:' || nr END AS rejection FROM nx)"""


@query("pace_examples", W_TIMING + PACE_SQL + """
SELECT session_id, driver_id, lap_number, rejection, CASE WHEN rejection IS NULL THEN CAST(nt AS DOUBLE) END AS target_lap_time_ms, CASE WHEN rejection IS NULL THEN nt - rolling_median_3_ms END AS target_pace_residual_ms FROM pce""")
def pace_examples(spark, folder):
    ok = F.col("rejection").isNull()
    return M.pace_examples(featured(spark, folder), 64).select(
        *CAR, "lap_number", "rejection", F.when(ok, F.col("target_lap_time_ms")).alias("target_lap_time_ms"),
        F.when(ok, F.col("target_pace_residual_ms")).alias("target_pace_residual_ms"),
    )


PITLOSS_SQL = FEATURE_SQL + """,
cyc AS (SELECT p.*, i.lap_time_ms AS it, i.lap_start_time_ms AS is_, i.is_deleted AS idl, i.is_generated AS igen, i.is_restart AS ir, i.raw_track_status AS its, i.is_dry AS idry, i.compound AS ic, i.lap_number AS inum,
  o.lap_time_ms AS ot, o.is_deleted AS odl, o.is_generated AS ogen, o.is_restart AS orr, o.raw_track_status AS ots, o.is_dry AS odry, o.compound AS oc, o.lap_number AS onum
  FROM tpit p LEFT JOIN lab i ON i.session_id = p.session_id AND i.driver_id = p.driver_id AND i.lap_number = p.lap_number LEFT JOIN lab o ON o.session_id = p.session_id AND o.driver_id = p.driver_id AND o.lap_number = p.lap_number + 1),
cyh AS (SELECT c.*, h.hn, h.med, h.clean_end FROM cyc c ASOF LEFT JOIN his h ON h.session_id = c.session_id AND h.driver_id = c.driver_id AND c.lap_number > h.lap_number),
pl AS (SELECT *, it + ot - 2.0::DOUBLE * med AS loss, CASE WHEN pit_in_time_ms IS NULL OR pit_out_time_ms IS NULL THEN 'pit:incomplete_record' WHEN it IS NULL OR ot IS NULL THEN 'pit:missing_cycle_timing'
  WHEN it NOT BETWEEN 1000000 AND 80000000 OR ot NOT BETWEEN 1000000 AND 80000000 OR idl OR odl OR coalesce(igen, false) OR coalesce(ogen, false) THEN 'pit:invalid_cycle_timing' WHEN ir OR orr THEN 'pit:red_flag_restart_cycle'
  WHEN coalesce(its, '') <> '1' OR coalesce(ots, '') <> '1' THEN 'pit:neutralized_or_unknown_track' WHEN NOT (idry AND odry) THEN 'pit:wet_or_unknown_weather' WHEN ic NOT IN ('soft','medium','hard') OR oc NOT IN ('soft','medium','hard') THEN 'pit:unsupported_compound'
  WHEN coalesce(hn, 0) < 2 THEN 'pit:insufficient_clean_history' WHEN it + ot - 2.0::DOUBLE * med NOT BETWEEN 1000 AND 60000000 THEN 'pit:implausible_effective_loss' WHEN pit_in_time_ms <= clean_end THEN 'pit:noncausal_cutoff' END AS rejection FROM cyh)"""


@query("pit_loss_examples", W_TIMING + PITLOSS_SQL + " SELECT session_id, driver_id, stop_number, lap_number, rejection, CASE WHEN rejection IS NULL THEN loss END AS target_effective_loss_ms FROM pl")
def pit_loss_examples(spark, folder):
    rows = M.pit_loss_examples(labelled(spark, folder), quiet(spark, folder).pits, RULES, 64)
    return rows.select(
        *CAR, "stop_number", "lap_number", "rejection",
        F.when(F.col("rejection").isNull(), F.col("target_effective_loss_ms")).alias("target_effective_loss_ms"),
    )


# ---- training data: line items as examples, orders as sessions -------------

SPLITS = ("train", "validation", "calibration", "test")


def corpus(spark, folder):
    """Chronological split of the orders, by year."""
    year = F.year("o_orderdate")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.when(year <= 1997, "train").when(year == 1998, "validation").when(year == 1999, "calibration").otherwise("test").alias("split"),
    )


def build_items(spark, folder):
    """Line items with the split of their order."""
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("circuit_id"),
        F.col("l_quantity").alias("qty"), "l_discount", F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("compound"),
    )
    return M.assign_split(items, corpus(spark, folder))


def examples(spark, folder):
    """The examples with their split, joined once: training, calibration and scoring read them several times."""
    return stored(spark, folder, "examples", lambda: build_items(spark, folder)).select(
        "session_id", "part", "circuit_id", "qty", (F.col("l_discount") * 100).alias("disc"), "line", "price", "compound",
        F.round(F.col("price") * 100).cast("long").alias("cents"), "split",
    )


EX_SQL = """
WITH co AS (SELECT o_orderkey AS session_id, CASE WHEN year(o_orderdate) <= 1997 THEN 'train' WHEN year(o_orderdate) = 1998 THEN 'validation' WHEN year(o_orderdate) = 1999 THEN 'calibration' ELSE 'test' END AS split FROM orders),
ex AS (SELECT l_orderkey AS session_id, l_partkey AS part, l_suppkey AS circuit_id, l_quantity AS qty, l_discount * 100 AS disc, l_linenumber AS line, l_extendedprice AS price, l_returnflag AS compound, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, split
  FROM lineitem JOIN co ON co.session_id = l_orderkey),
mo AS (SELECT avg(qty) AS mq, greatest(1, stddev_pop(qty)) AS sq, avg(disc) AS md, greatest(1, stddev_pop(disc)) AS sd, avg(price) AS my FROM ex WHERE split = 'train'),
zz AS (SELECT (qty - mq) / sq AS a, (disc - md) / sd AS b, price - my AS y FROM ex, mo WHERE split = 'train'),
gm AS (SELECT sum(a * a) + 25 AS aa, sum(a * b) AS ab, sum(b * b) + 25 AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM zz),
cf AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM gm),
pr AS (SELECT ex.*, my + wa * ((qty - mq) / sq) + wb * ((disc - md) / sd) AS predicted FROM ex, mo, cf)"""


def model(spark, folder):
    return L.fit_ridge(examples(spark, folder).where(F.col("split") == "train"), ["qty", "disc"], "price", 25.0)


def predicted(spark, folder):
    return examples(spark, folder).withColumn("predicted", L.score_ridge(model(spark, folder)))


@query("split_sizes", EX_SQL + " SELECT split, count(*) AS examples, count(DISTINCT session_id) AS sessions FROM ex GROUP BY 1")
def split_sizes(spark, folder):
    return examples(spark, folder).groupBy("split", "session_id").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(
        F.sum("n").alias("examples"), F.count(F.lit(1)).alias("sessions")
    )


@query("split_issues", """
SELECT CAST(user_id AS VARCHAR) AS subject, CASE WHEN count(DISTINCT event_type) > 1 THEN 'session-in-several-splits' ELSE 'repeated-session' END AS issue FROM events GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT s, 'missing-split' FROM (VALUES ('train'), ('validation'), ('calibration'), ('test')) v(s)""")
def split_issues(spark, folder):
    return M.split_issues(table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("split")))


@query("ridge_predictions", EX_SQL + " SELECT split, compound, count(*) AS n, round(avg(predicted), 2) AS mean_prediction, round(avg(price), 2) AS mean_price FROM pr GROUP BY 1, 2")
def ridge_predictions(spark, folder):
    return predicted(spark, folder).groupBy("split", "compound").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("predicted"), 2).alias("mean_prediction"), F.round(F.avg("price"), 2).alias("mean_price")
    )


@query("regression_metrics", EX_SQL + """
SELECT compound, round(avg(abs(price - predicted)), 2) AS mae_ms, round(sqrt(avg((price - predicted) * (price - predicted))), 2) AS rmse_ms, round(quantile_cont(abs(price - predicted), 0.5), 2) AS median_ae_ms, count(*) AS count FROM pr WHERE split = 'test' GROUP BY 1""")
def regression_metrics(spark, folder):
    rows = predicted(spark, folder).where(F.col("split") == "test")
    out = L.regression_metrics(rows, "price", "predicted", ["compound"], ROWS)
    return out.withColumns({c: F.round(c, 2) for c in ("mae_ms", "rmse_ms", "median_ae_ms")})


CONFORMAL_SQL = EX_SQL + """,
cal AS (SELECT abs(price - predicted) AS r, row_number() OVER (ORDER BY abs(price - predicted)) AS n, count(*) OVER () AS t FROM pr WHERE split = 'calibration'),
wd AS (SELECT max(t) AS samples, max(r) FILTER (n = least(t, ceil((t + 1) * 0.8::DOUBLE))) AS width_80, max(r) FILTER (n = least(t, ceil((t + 1) * 0.9::DOUBLE))) AS width_90 FROM cal)"""


@query("conformal_widths", CONFORMAL_SQL + " SELECT samples, round(width_80, 2) AS width_80, round(width_90, 2) AS width_90 FROM wd")
def conformal_widths(spark, folder):
    rows = predicted(spark, folder).where(F.col("split") == "calibration")
    out = L.conformal_widths(rows, "price", "predicted", (), ROWS)
    return out.withColumns({c: F.round(c, 2) for c in ("width_80", "width_90")})


@query("interval_coverage", CONFORMAL_SQL + """
SELECT count(*) AS "rows", round(avg(CAST(abs(price - predicted) <= width_80 AS DOUBLE)), 6) AS coverage_80, round(avg(CAST(abs(price - predicted) <= width_90 AS DOUBLE)), 6) AS coverage_90 FROM pr, wd WHERE split = 'test'""")
def interval_coverage(spark, folder):
    """Coverage on the test split of the widths that the calibration split gives."""
    rows = predicted(spark, folder)
    calibrated = L.conformal_widths(rows.where(F.col("split") == "calibration"), "price", "predicted", (), ROWS).head()
    widths = {"80": calibrated["width_80"], "90": calibrated["width_90"]}
    out = L.interval_coverage(rows.where(F.col("split") == "test"), "price", "predicted", widths)
    return out.withColumns({c: F.round(c, 6) for c in ("coverage_80", "coverage_90")})


# ---- a trained bundle: line items as laps, parts as circuits, the last lines of an order as stops -------------

BUNDLE_NAMES, BUNDLE_MORE = ("tyre_age_laps", "disc"), ("tyre_age_laps", "disc", "tyre_age_squared")


def build_bundle_items(spark, folder):
    """Line items with their split and whether their order has ended."""
    laps = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("driver_id"), F.col("l_linenumber").alias("lap_number"),
        F.col("l_partkey").alias("circuit_id"), "l_quantity", "l_discount", "l_extendedprice",
        (F.col("l_tax") == 0).alias("opening"),
    )
    ended = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("session_id"), (F.col("o_orderstatus") == "F").alias("session_finished")
    )
    return M.assign_split(laps, corpus(spark, folder)).join(ended, "session_id")


def bundle_laps(spark, folder):
    """Laps of the bundle.  What training and scoring read many times is joined and stored once, without derived columns."""
    age = (F.col("l_quantity") * 2).cast("double")
    usual, lap_ms = 45_000 + age * 250, 40_000 + age * age * 3 + F.col("l_extendedprice").cast("double") / 10
    items = stored(spark, folder, "bundle_items", lambda: build_bundle_items(spark, folder))
    return items.select(
        "session_id", "driver_id", "lap_number", "circuit_id", age.alias("tyre_age_laps"), (age * age).alias("tyre_age_squared"),
        (F.col("l_discount") * 100).cast("double").alias("disc"), usual.alias("rolling_median_3_ms"),
        lap_ms.alias("target_lap_time_ms"), (lap_ms - usual).alias("target_pace_residual_ms"),
        F.round(F.col("l_extendedprice") * 100).cast("double").alias("target_effective_loss_ms"),
        F.when(F.col("opening"), "opening_lap").alias("feature_reason"), F.lit(20.0).alias("track_temperature_c"),
        "split", "session_finished",
    )


def bundle(spark, folder):
    """The bundle trained on the whole table, stored and read back as scoring would."""
    laps = bundle_laps(spark, folder)
    stops = laps.where(F.col("lap_number") >= 6)
    path = shared_path(spark, "bundle")
    L.train_bundle(laps, stops, ROWS, names=BUNDLE_NAMES, more_names=BUNDLE_MORE).write(path)
    return L.read_bundle(spark, path)


def _solved(target: str, kind: str, strength: int) -> str:
    """SQL of one ridge: two or three unknowns by Cramer's rule."""
    aa, bb, cc = (f"({n} + {strength})" for n in ("aa", "bb", "cc"))
    a, b, c = (f"{n}{target}" for n in "abc")
    if kind == "ridge-linear":
        det = f"({aa} * {bb} - ab * ab)"
        wa, wb, wc = f"({a} * {bb} - {b} * ab) / {det}", f"({b} * {aa} - {a} * ab) / {det}", "0"
    else:
        det = f"({aa} * ({bb} * {cc} - bc * bc) - ab * (ab * {cc} - bc * ac) + ac * (ab * bc - {bb} * ac))"
        wa = f"({a} * ({bb} * {cc} - bc * bc) - ab * ({b} * {cc} - bc * {c}) + ac * ({b} * bc - {bb} * {c})) / {det}"
        wb = f"({aa} * ({b} * {cc} - bc * {c}) - {a} * (ab * {cc} - bc * ac) + ac * (ab * {c} - {b} * ac)) / {det}"
        wc = f"({aa} * ({bb} * {c} - {b} * bc) - ab * (ab * {c} - {b} * ac) + {a} * (ab * bc - {bb} * ac)) / {det}"
    return f"SELECT {target} AS target, '{kind}' AS candidate, m{target} AS mean, {wa} AS wa, {wb} AS wb, {wc} AS wc FROM gm, mo"


BUNDLE_SQL = """
WITH lp AS (SELECT l_orderkey AS session_id, l_suppkey AS driver_id, l_linenumber AS lap_number, l_partkey AS circuit_id, l_quantity * 2.0::DOUBLE AS age, CAST(l_discount * 100 AS DOUBLE) AS disc, 40000 + l_quantity * l_quantity * 12.0::DOUBLE + CAST(l_extendedprice AS DOUBLE) / 10 AS y1,
  40000 + l_quantity * l_quantity * 12.0::DOUBLE + CAST(l_extendedprice AS DOUBLE) / 10 - (45000 + l_quantity * 500.0::DOUBLE) AS y2, 45000 + l_quantity * 500.0::DOUBLE AS rolling, CAST(round(l_extendedprice * 100) AS DOUBLE) AS loss, CASE WHEN l_tax = 0 THEN 'opening_lap' END AS fr, o_orderstatus = 'F' AS ended,
  CASE WHEN year(o_orderdate) <= 1997 THEN 'train' WHEN year(o_orderdate) = 1998 THEN 'validation' WHEN year(o_orderdate) = 1999 THEN 'calibration' ELSE 'test' END AS split FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
mo AS (SELECT avg(age) AS ma, greatest(1, stddev_pop(age)) AS sa, avg(disc) AS mb, greatest(1, stddev_pop(disc)) AS sb, avg(age * age) AS mc, greatest(1, stddev_pop(age * age)) AS sc, avg(y1) AS m1, avg(y2) AS m2 FROM lp WHERE split = 'train'),
z AS (SELECT lp.*, (age - ma) / sa AS a, (disc - mb) / sb AS b, (age * age - mc) / sc AS c FROM lp, mo),
gm AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * (y1 - m1)) AS a1, sum(b * (y1 - m1)) AS b1, sum(c * (y1 - m1)) AS c1,
  sum(a * (y2 - m2)) AS a2, sum(b * (y2 - m2)) AS b2, sum(c * (y2 - m2)) AS c2 FROM z, mo WHERE split = 'train'),
cf AS (""" + " UNION ALL ".join(
    _solved(target, kind, strength)
    for target, strengths in (("1", (25, 40)), ("2", (40, 60)))
    for kind, strength in zip(("ridge-linear", "ridge-nonlinear"), strengths)
) + """),
pd AS (SELECT z.split, target, candidate, CASE target WHEN 1 THEN y1 ELSE y2 END AS y, mean + wa * a + wb * b + wc * c AS p FROM z, cf UNION ALL SELECT split, 1, 'rolling-median-baseline', y1, rolling FROM z UNION ALL SELECT split, 2, 'zero-residual-baseline', y2, 0 FROM z),
sco AS (SELECT target, candidate, avg(abs(y - p)) AS mae FROM pd WHERE split = 'validation' GROUP BY 1, 2),
cho AS (SELECT target, arg_min(candidate, mae) AS selected FROM sco GROUP BY 1),
cal AS (SELECT pd.target, abs(y - p) AS r, row_number() OVER (PARTITION BY pd.target ORDER BY abs(y - p)) AS n, count(*) OVER (PARTITION BY pd.target) AS t FROM pd JOIN cho ON cho.target = pd.target AND selected = candidate WHERE split = 'calibration'),
wd AS (SELECT target, max(r) FILTER (n = least(t, ceil((t + 1) * 0.8::DOUBLE))) AS w80, max(r) FILTER (n = least(t, ceil((t + 1) * 0.9::DOUBLE))) AS w90 FROM cal GROUP BY 1)"""


@query("model_selection", BUNDLE_SQL + """
SELECT CASE target WHEN 1 THEN 'target_lap_time_ms' ELSE 'target_pace_residual_ms' END AS target, candidate, round(mae, 3) AS mae_ms, candidate = selected AS selected FROM sco JOIN cho USING (target)""")
def model_selection(spark, folder):
    """Three candidates for each of two targets."""
    trained = bundle(spark, folder)
    rows = [
        (choice.target, name, round(float(mae), 3), name == choice.selected)
        for choice in (trained.pace, trained.tyre) for name, mae in choice.validation_mae.items()
    ]
    # Six rows describe the choice, whatever the tables hold.
    return spark.createDataFrame(rows, "target string, candidate string, mae_ms double, selected boolean")


@query("bundle_metrics", BUNDLE_SQL + """
SELECT CASE pd.target WHEN 1 THEN 'target_lap_time_ms' ELSE 'target_pace_residual_ms' END AS target, selected, count(*) AS "rows", round(avg(abs(y - p)), 3) AS mae_ms, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse_ms,
  round(avg(abs(y - base)), 3) AS baseline_mae_ms, round(avg(CAST(abs(y - p) <= w80 AS DOUBLE)), 6) AS coverage_80, round(avg(CAST(abs(y - p) <= w90 AS DOUBLE)), 6) AS coverage_90
FROM (SELECT z.split, cho.target, selected, CASE cho.target WHEN 1 THEN y1 ELSE y2 END AS y, CASE cho.target WHEN 1 THEN rolling ELSE 0 END AS base,
  coalesce(mean + wa * a + wb * b + wc * c, CASE cho.target WHEN 1 THEN rolling ELSE 0 END) AS p FROM z CROSS JOIN cho LEFT JOIN cf ON cf.target = cho.target AND candidate = selected) pd JOIN wd ON wd.target = pd.target WHERE split = 'test' GROUP BY 1, 2""")
def bundle_metrics(spark, folder):
    """Test error and coverage of both chosen models."""
    trained, laps = bundle(spark, folder), bundle_laps(spark, folder)
    out = L.bundle_metrics(laps, trained.pace).unionByName(L.bundle_metrics(laps, trained.tyre))
    digits = {"mae_ms": 3, "rmse_ms": 3, "baseline_mae_ms": 3, "coverage_80": 6, "coverage_90": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


PITMED_SQL = EX_SQL + """,
med AS (SELECT circuit_id, quantile_cont(cents, 0.5) AS cm FROM ex WHERE split = 'train' GROUP BY 1 HAVING count(*) >= 3),
est AS (SELECT circuit_id, cents, (SELECT quantile_cont(cents, 0.5) FROM ex WHERE split = 'train') AS gm, cm FROM ex LEFT JOIN med USING (circuit_id) WHERE split = 'validation')"""


def pit_rows(spark, folder):
    rows = examples(spark, folder)
    train = rows.where(F.col("split") == "train")
    valid = rows.where(F.col("split") == "validation")
    return L.pit_estimates(valid, train, "cents", "circuit_id", ROWS)


@query("pit_estimates", PITMED_SQL + " SELECT circuit_id, count(*) AS n, max(coalesce(cm, gm)) AS estimate FROM est GROUP BY 1")
def pit_estimates(spark, folder):
    return pit_rows(spark, folder).groupBy("circuit_id").agg(F.count(F.lit(1)).alias("n"), F.max("estimate").alias("estimate"))


@query("pit_estimator_choice", PITMED_SQL + """,
m AS (SELECT avg(abs(cents - gm)) AS g, avg(abs(cents - coalesce(cm, gm))) AS c FROM est)
SELECT round(g, 3) AS global_mae, round(c, 3) AS circuit_mae, CASE WHEN c <= least(g, c) * 1.1 THEN 'circuit-median-with-global-fallback' ELSE 'global-median' END AS selected FROM m""")
def pit_estimator_choice(spark, folder):
    out = L.prefer_circuit_median(pit_rows(spark, folder), "cents")
    return out.withColumns({c: F.round(c, 3) for c in ("global_mae", "circuit_mae")})


def wear(age):
    """Residual used where no trained model is needed: quadratic in tyre age."""
    return age * age * 0.5 - age * 3.0


@query("lap_predictions", BUNDLE_SQL + """,
med AS (SELECT circuit_id, quantile_cont(loss, 0.5) AS cm, count(*) AS n FROM lp WHERE split = 'train' AND lap_number >= 6 GROUP BY 1),
gmd AS (SELECT quantile_cont(loss, 0.5) AS g FROM lp WHERE split = 'train' AND lap_number >= 6),
pv AS (SELECT avg(abs(loss - g)) AS gmae, avg(abs(loss - coalesce(CASE WHEN n >= 3 THEN cm END, g))) AS cmae FROM lp CROSS JOIN gmd LEFT JOIN med USING (circuit_id) WHERE split = 'validation' AND lap_number >= 6),
cir AS (SELECT circuit_id, CASE WHEN cmae <= least(gmae, cmae) * 1.1 AND n >= 3 THEN cm END AS cm FROM med, pv),
pc AS (SELECT abs(loss - coalesce(cm, g)) AS r FROM lp CROSS JOIN gmd LEFT JOIN cir USING (circuit_id) WHERE split = 'calibration' AND lap_number >= 6),
pn AS (SELECT r, row_number() OVER (ORDER BY r) AS n, count(*) OVER () AS t FROM pc),
pw AS (SELECT max(r) FILTER (n = least(t, ceil((t + 1) * 0.8::DOUBLE))) AS p80, max(r) FILTER (n = least(t, ceil((t + 1) * 0.9::DOUBLE))) AS p90 FROM pn),
m1 AS (SELECT selected, mean, wa, wb, wc, w80, w90 FROM cho JOIN wd USING (target) LEFT JOIN cf ON cf.target = cho.target AND candidate = selected WHERE cho.target = 1),
m2 AS (SELECT selected, mean, wa, wb, wc, w80, w90 FROM cho JOIN wd USING (target) LEFT JOIN cf ON cf.target = cho.target AND candidate = selected WHERE cho.target = 2),
sc AS (SELECT z.*, cir.circuit_id AS known, coalesce(cm, g) AS pit, p80, p90, m1.w80, m1.w90, coalesce(m1.mean + m1.wa * a + m1.wb * b + m1.wc * c, rolling) AS pace, m2.w80 AS t80, m2.w90 AS t90,
  [coalesce(m2.mean + m2.wa * (age + h - ma) / sa + m2.wb * b + m2.wc * ((age + h) * (age + h) - mc) / mo.sc, 0) for h in [0, 1, 2, 3, 4, 5]] AS f
  FROM z CROSS JOIN mo CROSS JOIN m1 CROSS JOIN m2 CROSS JOIN gmd CROSS JOIN pw LEFT JOIN cir ON cir.circuit_id = z.circuit_id),
g AS (SELECT *, CASE WHEN ended THEN 'session_finished' WHEN fr IS NOT NULL THEN fr WHEN known IS NULL THEN 'unsupported_circuit' WHEN age + 5 > 100 THEN 'tyre_forecast_out_of_distribution' WHEN pace NOT BETWEEN 46000 AND 70000 THEN 'implausible_pace_output'
  WHEN pace - w90 <= 0 THEN 'implausible_prediction_interval' WHEN len(list_filter(f, lambda x: abs(x) > 4000)) > 0 THEN 'implausible_tyre_output' END AS reason FROM sc)
SELECT reason, count(*) AS n, CAST(sum(CASE WHEN reason IS NULL THEN round_even(pace, 0) END) AS BIGINT) AS pace_total, CAST(sum(CASE WHEN reason IS NULL THEN round_even(pace - w80, 0) + round_even(pace + w90, 0) END) AS BIGINT) AS bounds_total,
  CAST(sum(CASE WHEN reason IS NULL THEN round_even(f[1], 0) + round_even(t80, 0) + round_even(t90, 0) END) AS BIGINT) AS residual_total, CAST(sum(CASE WHEN reason IS NULL THEN round_even(greatest(0, f[2] - f[1], f[3] - f[1], f[4] - f[1], f[5] - f[1], f[6] - f[1]), 0) END) AS BIGINT) AS wear_total,
  CAST(sum(CASE WHEN reason IS NULL THEN round_even(pit, 0) END) AS BIGINT) AS pit_total, CAST(sum(CASE WHEN reason IS NULL THEN round_even(greatest(0, pit - p80), 0) + round_even(greatest(0, pit - p90), 0) + round_even(pit + p80, 0) + round_even(pit + p90, 0) END) AS BIGINT) AS pit_bounds_total FROM g GROUP BY 1""")
def lap_predictions(spark, folder):
    """Every lap scored by the trained bundle, behind all guards."""
    out = L.predict(
        bundle_laps(spark, folder), bundle(spark, folder), min_lap_ms=46_000, max_lap_ms=70_000, max_residual_ms=4_000
    )

    def total(name, *columns):
        return F.sum(sum(F.col(c) for c in columns)).cast("long").alias(name)

    return out.groupBy(F.col("unavailable_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), total("pace_total", "predicted_lap_ms"), total("bounds_total", "lower_80", "upper_90"),
        total("residual_total", "residual_ms", "residual_width_80", "residual_width_90"),
        F.sum(F.element_at("curve", -1)).cast("long").alias("wear_total"), total("pit_total", "pit_loss_ms"),
        total("pit_bounds_total", "pit_lower_80", "pit_lower_90", "pit_upper_80", "pit_upper_90"),
    )


@query("lap_projections", BUNDLE_SQL + """,
m2 AS (SELECT mean, wa, wb, wc, w80 FROM cho JOIN wd USING (target) LEFT JOIN cf ON cf.target = cho.target AND candidate = selected WHERE cho.target = 2),
k AS (SELECT z.*, least(age, circuit_id % 40 + 5.0) AS cap FROM z),
v AS (SELECT lap_number, age > cap AS over, w80 * sqrt(1.0 + greatest(0, age - cap) / 5.0) AS wid, y1 + coalesce(mean + wa * (cap - ma) / sa + wb * b + wc * (cap * cap - mc) / sc, 0) AS proj FROM k, mo, m2)
SELECT lap_number, count(*) AS n, count(*) FILTER (proj NOT BETWEEN 45000 AND 330000) AS rejected, count(*) FILTER (over) AS exceeded, round(avg(CASE WHEN proj BETWEEN 45000 AND 330000 THEN proj END), 2) AS mean_ms,
  round(avg(CASE WHEN proj BETWEEN 45000 AND 330000 THEN wid END), 4) AS width_ms FROM v GROUP BY 1""")
def lap_projections(spark, folder):
    """Lap times at the tyre ages of the table, by the trained residual."""
    tyre = bundle(spark, folder).tyre
    rows = bundle_laps(spark, folder).withColumns(
        {
            "anchor_ms": F.col("target_lap_time_ms"), "tyre_age": F.col("tyre_age_laps"),
            "anchor_age": (F.col("circuit_id") % 40).cast("double"),
        }
    )
    out = L.project_lap(rows, lambda age: tyre.prediction(L.aged(age)), tyre.widths["80"], tyre.widths["90"])
    return out.groupBy("lap_number").agg(
        F.count(F.lit(1)).alias("n"), F.count("rejected").alias("rejected"), F.count(F.when(F.col("horizon_exceeded"), 1)).alias("exceeded"),
        F.round(F.avg("mean_lap_ms"), 2).alias("mean_ms"), F.round(F.avg("width_80_ms"), 4).alias("width_ms"),
    )
