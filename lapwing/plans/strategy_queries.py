"""Strategy outcome queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lapwing.operators import features as M
from lapwing.operators import replay as R
from lapwing.operators import strategy as S
from lapwing.plans.learning_queries import FEATURE_SQL, featured
from lapwing.plans.registry import query, sql_round
from lapwing.plans.replay_queries import CURSOR_SQL, PITS_SQL, STATE_OUT, STATE_SQL, W_TIMING, canonical, cursors, full_log
from lapwing.plans.standin import ROWS, stored, table

MODES = ("lower-90", "point", "upper-90")


def paths(spark, folder):
    """One simulated path per (order, return flag)."""
    items = table(spark, folder, "lineitem")
    first = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
    # Dealt first: the smallest struct is found by sorting, here shuffled parts and not whole files.
    dealt = items.select(
        F.col("l_orderkey").alias("iteration"), F.col("l_returnflag").alias("strategy_id"), first.alias("i")
    ).repartition("iteration", "strategy_id")
    one = dealt.groupBy("iteration", "strategy_id").agg(F.min("i").alias("i"))
    return one.select(
        "strategy_id", "iteration", (F.col("i.l_partkey") % 20 + 1).cast("int").alias("position"),
        F.round(F.col("i.l_extendedprice") * 100).cast("long").alias("final_time_ms"),
        (F.col("i.l_discount") >= 0.09).alias("local_horizon_exceeded"),
        F.element_at(F.array(*[F.lit(m) for m in MODES]), (F.col("iteration") % 3 + 1).cast("int")).alias("pit_loss_mode"),
    )


PATHS_SQL = """
WITH pth AS (SELECT strategy_id, iteration, CAST(i.l_partkey % 20 + 1 AS INT) AS position, CAST(round(i.l_extendedprice * 100) AS BIGINT) AS final_time_ms, i.l_discount >= 0.09::DOUBLE AS local_horizon_exceeded,
  (['lower-90','point','upper-90'])[iteration % 3 + 1] AS pit_loss_mode FROM (SELECT l_orderkey AS iteration, l_returnflag AS strategy_id, arg_min(lineitem, (l_linenumber, l_partkey, l_extendedprice, l_discount)) AS i FROM lineitem GROUP BY 1, 2)),
od AS (SELECT strategy_id, count(*) AS paths, avg(position) AS ap, quantile_cont(position, 0.5) AS mp, avg(CAST(position <= 3 AS DOUBLE)) AS t3, quantile_cont(final_time_ms, 0.1) AS q1, quantile_cont(final_time_ms, 0.5) AS q5, quantile_cont(final_time_ms, 0.9) AS q9,
  avg(CAST(local_horizon_exceeded AS DOUBLE)) AS hz FROM pth GROUP BY 1)"""


@query("outcome_distribution", PATHS_SQL + f"""
SELECT strategy_id, paths, {sql_round('ap', 3)} AS expected_position, {sql_round('mp', 3)} AS median_position, {sql_round('t3', 4)} AS probability_top_3, {sql_round('q1', 0)} AS p10, {sql_round('q5', 0)} AS p50, {sql_round('q9', 0)} AS p90,
  {sql_round('hz', 4)} AS horizon_exceeded_probability FROM od""")
def outcome_distribution(spark, folder):
    return S.outcome_distribution(paths(spark, folder), ROWS)


@query("position_probabilities", PATHS_SQL + f"""
SELECT strategy_id, position, {sql_round('n / t', 4)} AS probability FROM (SELECT strategy_id, position, count(*) AS n, sum(count(*)) OVER (PARTITION BY strategy_id) AS t FROM pth GROUP BY 1, 2)""")
def position_probabilities(spark, folder):
    return S.position_probabilities(paths(spark, folder))


@query("paired_superiority", PATHS_SQL + f"""
SELECT n AS iterations, {sql_round('w', 4)} AS probability FROM (SELECT count(*) AS n, avg(CAST(a.position < b.position OR (a.position = b.position AND a.final_time_ms < b.final_time_ms) AS DOUBLE)) AS w
  FROM pth a JOIN pth b ON a.iteration = b.iteration AND a.strategy_id = 'A' AND b.strategy_id = 'R')""")
def paired_superiority(spark, folder):
    return S.paired_superiority(paths(spark, folder), "A", "R").drop("raw")


SENS_SQL = """,
sc AS (SELECT pit_loss_mode, strategy_id, avg(position) AS p, avg(final_time_ms) AS t FROM pth GROUP BY 1, 2),
wi AS (SELECT pit_loss_mode, arg_min(strategy_id, (p, t, strategy_id)) AS winner FROM sc GROUP BY 1)"""


@query("pit_loss_sensitivity", PATHS_SQL + SENS_SQL + " SELECT pit_loss_mode, winner, (SELECT count(DISTINCT winner) > 1 FROM wi) AS fragile FROM wi")
def pit_loss_sensitivity(spark, folder):
    return S.sensitivity(paths(spark, folder))


def decisions(spark, folder):
    """A customer's orders as the iterations of one decision, taken by the car of line 1 in a field of seven."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("iteration"), F.col("o_custkey").alias("session_id"))
    # Read several times each: every decision's paths, then its cars.
    simulated = stored(
        spark, folder, "decision_paths",
        lambda: paths(spark, folder).join(orders, "iteration").withColumns(
            {"driver_id": F.lit(1), "cursor_ms": F.lit(0).cast("long")}
        ),
    )
    lines = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("iteration"))
    cars = stored(
        spark, folder, "decision_cars",
        lambda: lines.groupBy("session_id", F.col("l_linenumber").cast("int").alias("driver_id")).agg(
            F.max("l_quantity").alias("age"), F.max("l_discount").alias("disc"), F.min("l_tax").alias("tax")
        ).withColumn("cursor_ms", F.lit(0).cast("long")),
    )
    states = cars.select(
        "session_id", "driver_id", "cursor_ms", F.when(F.col("age") < 6, "retired").otherwise("active").alias("status"),
        F.lit(False).alias("in_pit"), F.lit("soft").alias("compound"), F.col("age").alias("tyre_age_laps"),
        F.lit(90_000).alias("last_lap_time_ms"),
    )
    feats = cars.select(
        "session_id", "driver_id", "cursor_ms", F.lit(5).alias("lap_number"),
        F.when((F.col("disc") >= 0.1) & (F.col("tax") == 0), "insufficient_clean_history").alias("feature_reason"),
    )
    return simulated, S.limited_fields(S.active_field(states, feats))


@query("recommendation", """
WITH od AS (SELECT o_orderkey AS iteration, o_custkey AS session_id FROM orders),
pth AS (SELECT session_id, strategy_id, iteration, CAST(i.l_partkey % 20 + 1 AS INT) AS position, CAST(round(i.l_extendedprice * 100) AS BIGINT) AS final_time_ms, i.l_discount >= 0.09::DOUBLE AS hz,
  (['lower-90','point','upper-90'])[iteration % 3 + 1] AS pit_loss_mode FROM (SELECT l_orderkey AS iteration, l_returnflag AS strategy_id, arg_min(lineitem, (l_linenumber, l_partkey, l_extendedprice, l_discount)) AS i FROM lineitem GROUP BY 1, 2) JOIN od USING (iteration)),
oc AS (SELECT session_id, strategy_id, avg(position) AS ap, quantile_cont(final_time_ms, 0.5) AS q5, avg(CAST(hz AS DOUBLE)) AS hz FROM pth GROUP BY 1, 2),
rk AS (SELECT session_id, strategy_id, hz, row_number() OVER (PARTITION BY session_id ORDER BY """ + f"{sql_round('ap', 3)}, {sql_round('q5', 0)}" + """, strategy_id) AS r FROM oc),
tp AS (SELECT session_id, max(strategy_id) FILTER (r = 1) AS ld, max(strategy_id) FILTER (r = 2) AS ru, max(hz) FILTER (r <= 2) AS h FROM rk GROUP BY 1 HAVING max(r) >= 2),
su AS (SELECT tp.session_id, avg(CAST((a.position, a.final_time_ms) < (b.position, b.final_time_ms) AS DOUBLE)) AS s FROM tp JOIN pth a ON a.session_id = tp.session_id AND a.strategy_id = ld JOIN pth b ON b.session_id = tp.session_id AND b.strategy_id = ru AND b.iteration = a.iteration GROUP BY 1),
wi AS (SELECT session_id, arg_min(strategy_id, (p, t, strategy_id)) AS winner FROM (SELECT session_id, pit_loss_mode, strategy_id, avg(position) AS p, avg(final_time_ms) AS t FROM pth GROUP BY 1, 2, 3) GROUP BY session_id, pit_loss_mode),
fr AS (SELECT session_id, count(DISTINCT winner) > 1 AS fragile FROM wi GROUP BY 1),
cr AS (SELECT o_custkey AS session_id, l_linenumber AS driver_id, max(l_quantity) < 6 AS gone, max(l_discount) >= 0.1::DOUBLE AND min(l_tax) = 0 AS bare FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
lm AS (SELECT session_id, bool_or(gone OR bare) FILTER (driver_id <> 1) AS lim, bool_or(gone) FILTER (driver_id = 1) AS own FROM cr GROUP BY 1),
gd AS (SELECT tp.session_id, ld, ru, coalesce(s, 0) AS s, fragile, h, coalesce(lim, false) AS lim FROM tp LEFT JOIN su USING (session_id) JOIN fr USING (session_id) JOIN lm USING (session_id) WHERE NOT own)
SELECT session_id, ld AS leading, ru AS runner_up, """ + sql_round("s", 4) + """ AS superiority, fragile,
  concat_ws(',', CASE WHEN s < 0.6 THEN 'paired_superiority_below_product_threshold' END, CASE WHEN fragile THEN 'pit_loss_sensitivity_winner_flip' END, CASE WHEN h > 0.5 THEN 'local_tyre_horizon_exceeded' END, CASE WHEN lim THEN 'incomplete_or_fallback_background_field' END) AS guard_reasons,
  CASE WHEN s >= 0.6 AND NOT fragile AND h <= 0.5 AND NOT lim THEN ld END AS recommended FROM gd""")
def recommendation(spark, folder):
    simulated, limited = decisions(spark, folder)
    out = S.recommendations(simulated, limited, ["session_id", "driver_id", "cursor_ms"], ROWS)
    return out.withColumn("guard_reasons", F.array_join("guard_reasons", ",")).drop("driver_id", "cursor_ms")


@query("path_classification", """
SELECT l_orderkey, l_suppkey AS driver_id, l_linenumber AS laps, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice, l_partkey, l_suppkey) AS position FROM lineitem""")
def path_classification(spark, folder):
    field = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("driver_id"), F.col("l_linenumber").alias("laps"),
        F.col("l_extendedprice").alias("completion_ms"), F.col("l_partkey").alias("source_position"),
    )
    return S.classify(field, ["l_orderkey"]).select("l_orderkey", "driver_id", "laps", "position")


def planned(spark, folder):
    states = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("laps_completed"),
        F.col("l_quantity").cast("int").alias("scheduled_laps"),
        F.element_at(F.array(F.lit("soft"), F.lit("medium"), F.lit("hard"), F.lit("wet")), (F.col("l_partkey") % 4 + 1).cast("int")).alias("compound"),
    )
    return S.candidates(states)


CAND_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber AS done, CAST(l_quantity AS INT) AS total, (['soft','medium','hard','wet'])[l_partkey % 4 + 1] AS compound FROM lineitem),
c AS (SELECT *, done + 2 AS f, total - done - 1 AS lft FROM s),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, done, total, compound, 'stay-out' AS strategy_id, NULL::INT AS l1, NULL::INT AS l2, 0 AS stops, NULL AS c1 FROM c
 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, done, total, compound, 'one-stop-l' || (f + (lft - 1) // 2) || '-' || x, f + (lft - 1) // 2, NULL, 1, x FROM c, (VALUES ('hard'), ('medium'), ('soft')) v(x) WHERE lft >= 2 AND compound <> x
 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, done, total, compound, 'two-stop-l' || (f + lft // 3) || '-l' || (f + 2 * lft // 3), f + lft // 3, f + 2 * lft // 3, 2, NULL FROM c WHERE lft >= 18)"""


@query("strategy_candidates", CAND_SQL + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strategy_id, CAST(stops AS INT) AS stops FROM p")
def strategy_candidates(spark, folder):
    return planned(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "strategy_id", F.size("actions").alias("stops"))


@query("strategy_validation", CAND_SQL + """
SELECT CASE WHEN l1 < done + 2 OR l2 < done + 2 THEN 'action-before-next-lap' WHEN l1 > total OR l2 > total THEN 'action-after-race-distance'
  WHEN stops = 0 OR (stops = 1 AND c1 = compound) THEN 'too-few-compounds' END AS invalid_reason, count(*) AS plans FROM p GROUP BY 1""")
def strategy_validation(spark, folder):
    rows = S.invalid_strategies(planned(spark, folder), require_two_compounds=True)
    return rows.groupBy("invalid_reason").agg(F.count(F.lit(1)).alias("plans"))


# The quiet stops of the feature SQL next to the full stops of the state SQL.
QUIET_SQL = re.sub(r"\b(mk|stk|fin|st0|tpit|tst)\b", r"q_\1", FEATURE_SQL)


@query("active_field", W_TIMING + STATE_SQL + QUIET_SQL + CURSOR_SQL + ", sta AS (" + STATE_OUT + """),
fat AS (SELECT c.session_id, c.driver_id, c.cursor_ms, f.lap_number, f.feature_reason FROM (SELECT session_id, driver_id, cursor_ms FROM sta) c ASOF LEFT JOIN fea f ON f.session_id = c.session_id AND f.driver_id = c.driver_id AND c.cursor_ms >= f.lap_end_time_ms),
exr AS (SELECT sta.session_id, sta.driver_id, sta.cursor_ms, status, fat.lap_number, feature_reason, CASE WHEN status = 'retired' THEN 'terminal_retired' WHEN status NOT IN ('active','in-pit') THEN 'status_' || status WHEN in_pit THEN 'driver_in_pit'
  WHEN coalesce(compound, '') NOT IN ('soft','medium','hard') OR tyre_age_laps IS NULL OR last_lap_time_ms IS NULL THEN 'unsupported_or_missing_tyre_state' WHEN fat.lap_number IS NULL THEN 'no_completed_lap' END AS excluded_reason
  FROM sta JOIN fat USING (session_id, driver_id, cursor_ms))
SELECT session_id, driver_id, cursor_ms, status, excluded_reason, excluded_reason IS NULL AND lap_number IS NOT NULL AND feature_reason IS NULL AS model_supported FROM exr""")
def active_field(spark, folder):
    v = full_log(spark, folder)
    at = cursors(v)
    states = R.driver_states(v.events, v.roster, at, ROWS)
    slim = featured(spark, folder).select("session_id", "driver_id", "lap_number", "lap_end_time_ms", "feature_reason")
    feats = M.features_at(slim, v.roster.join(at, "session_id"), ROWS)
    return S.active_field(states, feats).select(
        "session_id", "driver_id", "cursor_ms", "status", "excluded_reason", "model_supported"
    )


@query("observed_overlay", W_TIMING + PITS_SQL + CURSOR_SQL + """
SELECT c.session_id, d.driver_id, c.cursor_ms, r.best, (SELECT count(*) FROM tpit p WHERE p.session_id = c.session_id AND p.driver_id = d.driver_id AND pit_in_time_ms > cursor_ms) AS later_stops,
  (SELECT min(lap_number) FROM tpit p WHERE p.session_id = c.session_id AND p.driver_id = d.driver_id AND pit_in_time_ms > cursor_ms) AS next_stop_lap
FROM crs c JOIN (SELECT DISTINCT session_id, driver_id FROM feed) d USING (session_id) LEFT JOIN (SELECT session_id, driver_id, min(position) AS best FROM tp GROUP BY 1, 2) r USING (session_id, driver_id)""")
def observed_overlay(spark, folder):
    v = canonical(spark, folder)
    rows = v.feed.select("session_id", "driver_id").distinct().join(cursors(v), "session_id")
    results = v.positions.groupBy("session_id", "driver_id").agg(F.min("position").alias("best"))
    return S.observed_overlay(rows, results, v.pits, ROWS)
