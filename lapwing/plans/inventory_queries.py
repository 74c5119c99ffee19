"""Catalog, archive quality, inventory and projection queries."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from lapwing.functions.vocab import session_type, stratum
from lapwing.operators import analytics as A
from lapwing.operators import archive_quality as Q
from lapwing.operators import catalog as C
from lapwing.operators import channels as K
from lapwing.operators import digest as D
from lapwing.operators import inventory as I
from lapwing.operators import projection as P
from lapwing.plans.registry import query
from lapwing.plans.standin import ARCHIVE_SQL, ROWS, archive, table

LIMITS = {
    "grid_position": (0, 18), "finish_position": (1, 6), "laps_completed": (0, 69),
    "position": (1, 19), "lap_number": (1, 200), "pit_lap_number": (1, 6),
}


def filed(spark, folder):
    """Archive tables filed under ``race_id`` with some foreign session ids."""
    v = archive(spark, folder)
    results = v.results.withColumn(
        "driver_id", F.when(F.col("driver_id") % 17 == 0, F.col("driver_id") + 1_000_000).otherwise(F.col("driver_id"))
    ).withColumn("race_id", F.col("session_id")).withColumn(
        "session_id", F.col("race_id") + F.when(F.col("laps_completed") == 70, 1).otherwise(0)
    )
    items = table(spark, folder, "lineitem")
    laps = items.select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_orderkey").alias("session_id"),
        F.col("l_suppkey").alias("driver_id"),
        F.col("l_linenumber").alias("lap_number"),
        F.col("l_partkey").alias("row_index"),
        F.when(F.col("l_discount") != 0, (F.col("l_partkey") % 20 + 1).cast("int")).alias("position"),
        F.when(F.col("l_tax") != 0, F.round(F.col("l_extendedprice") * 100).cast("long") - 100000).alias("lap_time_ms"),
    )
    pits = v.pits.withColumn("race_id", F.col("session_id"))
    seasons = v.events.select(F.col("session_id").alias("race_id"), (F.col("season") + 14).alias("season"))
    return results, laps, pits, seasons


FILED_SQL = "WITH " + ARCHIVE_SQL + """,
fr AS (SELECT * REPLACE (session_id + CASE WHEN laps_completed = 70 THEN 1 ELSE 0 END AS session_id,
   driver_id + CASE WHEN driver_id % 17 = 0 THEN 1000000 ELSE 0 END AS driver_id), session_id AS race_id FROM results),
fl AS (SELECT l_orderkey AS race_id, l_orderkey AS session_id, l_suppkey AS driver_id, l_linenumber AS lap_number,
   l_partkey AS row_index, CASE WHEN l_discount <> 0 THEN CAST(l_partkey % 20 + 1 AS INT) END AS position,
   CASE WHEN l_tax <> 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) - 100000 END AS lap_time_ms FROM lineitem),
fp AS (SELECT *, session_id AS race_id FROM pits),
fs AS (SELECT session_id AS race_id, season + 14 AS season FROM ev)"""


@query("archive_quality", FILED_SQL + """,
flo AS (SELECT *, lag(lap_number) OVER (PARTITION BY race_id, driver_id ORDER BY row_index, lap_number) AS prev FROM fl),
r AS (SELECT race_id, count(*) AS result_rows, count(*) - count(DISTINCT driver_id) AS duplicate_result_drivers,
  count(*) FILTER (grid_position NOT BETWEEN 0 AND 18) AS invalid_grid_positions,
  count(*) FILTER (finish_position NOT BETWEEN 1 AND 6) AS invalid_finish_positions,
  count(*) FILTER (laps_completed NOT BETWEEN 0 AND 69) AS invalid_result_lap_counts,
  count(grid_position) AS grids, count(*) FILTER (session_id <> race_id) AS off FROM fr GROUP BY 1),
l AS (SELECT race_id, count(*) AS lap_rows, count(*) - count(DISTINCT (driver_id, lap_number)) AS duplicate_driver_laps,
  count(*) FILTER ((race_id, driver_id) NOT IN (SELECT (race_id, driver_id) FROM fr)) AS orphan_lap_drivers,
  count(*) FILTER (lap_number NOT BETWEEN 1 AND 200) AS invalid_lap_numbers,
  count(*) FILTER (position NOT BETWEEN 1 AND 19) AS invalid_lap_positions,
  count(*) FILTER (lap_number <= prev) AS non_monotonic_driver_laps, count(*) FILTER (lap_time_ms <= 0) AS invalid_lap_times,
  count(lap_time_ms) AS timed, count(position) AS placed FROM flo GROUP BY 1),
p AS (SELECT race_id, count(*) AS pit_stop_rows, count(*) - count(DISTINCT (driver_id, stop_number)) AS duplicate_driver_pit_stops,
  count(*) FILTER ((race_id, driver_id) NOT IN (SELECT (race_id, driver_id) FROM fr)) AS orphan_pit_drivers,
  count(*) FILTER (stop_number < 1) AS invalid_pit_stop_numbers,
  count(*) FILTER (lap_number NOT BETWEEN 1 AND 6) AS invalid_pit_lap_numbers,
  count(*) FILTER (duration_ms <= 0) AS invalid_pit_durations FROM fp GROUP BY 1),
g AS (SELECT race_id, count(*) FILTER (lo <> 1 OR hi <> n) AS pit_stop_sequence_gaps FROM (
  SELECT race_id, driver_id, min(stop_number) lo, max(stop_number) hi, count(DISTINCT stop_number) n FROM fp GROUP BY 1, 2) GROUP BY 1),
ids AS (SELECT race_id, count(DISTINCT session_id) - 1 AS mismatched_session_ids FROM (
  SELECT race_id, session_id FROM fr UNION ALL SELECT race_id, session_id FROM fl UNION ALL SELECT race_id, session_id FROM fp) GROUP BY 1),
j AS (SELECT fs.race_id, season, coalesce(result_rows,0) AS result_rows, coalesce(lap_rows,0) AS lap_rows,
  coalesce(pit_stop_rows,0) AS pit_stop_rows, coalesce(duplicate_result_drivers,0) AS duplicate_result_drivers,
  coalesce(invalid_grid_positions,0) AS invalid_grid_positions, coalesce(invalid_finish_positions,0) AS invalid_finish_positions,
  coalesce(invalid_result_lap_counts,0) AS invalid_result_lap_counts, coalesce(mismatched_session_ids,0) AS mismatched_session_ids,
  coalesce(off,0) AS unexpected_session_id_rows, coalesce(duplicate_driver_laps,0) AS duplicate_driver_laps,
  coalesce(orphan_lap_drivers,0) AS orphan_lap_drivers, coalesce(invalid_lap_numbers,0) AS invalid_lap_numbers,
  coalesce(invalid_lap_positions,0) AS invalid_lap_positions, coalesce(non_monotonic_driver_laps,0) AS non_monotonic_driver_laps,
  coalesce(invalid_lap_times,0) AS invalid_lap_times, coalesce(duplicate_driver_pit_stops,0) AS duplicate_driver_pit_stops,
  coalesce(orphan_pit_drivers,0) AS orphan_pit_drivers, coalesce(invalid_pit_stop_numbers,0) AS invalid_pit_stop_numbers,
  coalesce(invalid_pit_lap_numbers,0) AS invalid_pit_lap_numbers, coalesce(invalid_pit_durations,0) AS invalid_pit_durations,
  coalesce(pit_stop_sequence_gaps,0) AS pit_stop_sequence_gaps,
  coalesce(result_rows,0) > 0 AS cap_results, coalesce(grids,0) > 0 AS cap_grid, coalesce(timed,0) > 0 AS cap_lap_times,
  coalesce(placed,0) > 0 AS cap_lap_positions, coalesce(pit_stop_rows,0) > 0 AS cap_pit_stops
  FROM fs LEFT JOIN r USING (race_id) LEFT JOIN l USING (race_id) LEFT JOIN p USING (race_id) LEFT JOIN g USING (race_id)
  LEFT JOIN ids USING (race_id)),
v AS (SELECT *, CASE WHEN result_rows = 0 THEN 'unusable'
  WHEN duplicate_result_drivers + invalid_grid_positions + invalid_finish_positions + invalid_result_lap_counts
   + mismatched_session_ids + unexpected_session_id_rows + duplicate_driver_laps + orphan_lap_drivers + invalid_lap_numbers
   + invalid_lap_positions + non_monotonic_driver_laps + invalid_lap_times + duplicate_driver_pit_stops + orphan_pit_drivers
   + invalid_pit_stop_numbers + invalid_pit_lap_numbers + invalid_pit_durations > 0 THEN 'degraded'
  WHEN lap_rows = 0 THEN 'partial'
  WHEN NOT cap_lap_times OR pit_stop_sequence_gaps > 0 OR (season >= 2011 AND pit_stop_rows = 0) THEN 'good'
  ELSE 'verified' END AS status FROM j)
SELECT *, concat_ws(',',
  CASE WHEN duplicate_result_drivers > 0 THEN 'duplicate_result_driver' END, CASE WHEN result_rows = 0 THEN 'missing_results' END,
  CASE WHEN invalid_grid_positions > 0 THEN 'invalid_grid_position' END, CASE WHEN invalid_finish_positions > 0 THEN 'invalid_finish_position' END,
  CASE WHEN invalid_result_lap_counts > 0 THEN 'invalid_result_lap_count' END, CASE WHEN mismatched_session_ids > 0 THEN 'mixed_session_identity' END,
  CASE WHEN unexpected_session_id_rows > 0 THEN 'unexpected_session_identity' END, CASE WHEN invalid_lap_times > 0 THEN 'non_positive_lap_time' END,
  CASE WHEN lap_rows > 0 AND NOT cap_lap_times THEN 'lap_times_not_present' END,
  CASE WHEN lap_rows = 0 AND result_rows > 0 THEN 'missing_lap_data' END,
  CASE WHEN duplicate_driver_laps > 0 THEN 'duplicate_driver_lap' END, CASE WHEN orphan_lap_drivers > 0 THEN 'lap_driver_missing_result' END,
  CASE WHEN invalid_lap_numbers > 0 THEN 'invalid_lap_number' END, CASE WHEN invalid_lap_positions > 0 THEN 'invalid_lap_position' END,
  CASE WHEN non_monotonic_driver_laps > 0 THEN 'non_monotonic_driver_laps' END, CASE WHEN invalid_pit_durations > 0 THEN 'non_positive_pit_duration' END,
  CASE WHEN duplicate_driver_pit_stops > 0 THEN 'duplicate_driver_pit_stop' END, CASE WHEN orphan_pit_drivers > 0 THEN 'pit_driver_missing_result' END,
  CASE WHEN invalid_pit_stop_numbers > 0 THEN 'invalid_pit_stop_number' END, CASE WHEN invalid_pit_lap_numbers > 0 THEN 'invalid_pit_lap_number' END,
  CASE WHEN pit_stop_sequence_gaps > 0 THEN 'pit_stop_sequence_gap' END,
  CASE WHEN status = 'good' AND season >= 2011 AND pit_stop_rows = 0 THEN 'pit_stop_rows_not_present' END) AS reasons FROM v""")
def archive_quality(spark, folder):
    results, laps, pits, seasons = filed(spark, folder)
    out = Q.evaluate(results, laps, pits, seasons, limits=LIMITS)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("invalid_domain_counts", FILED_SQL + """
SELECT team_id, CAST(count(*) FILTER (grid_position NOT BETWEEN 0 AND 18) AS BIGINT) AS invalid_grid_position,
  count(*) FILTER (finish_position NOT BETWEEN 1 AND 6) AS invalid_finish_position FROM fr GROUP BY 1""")
def invalid_domain_counts(spark, folder):
    results, *_ = filed(spark, folder)
    return Q.invalid_counts(results, ["team_id"], {"grid_position": (0, 18), "finish_position": (1, 6)})


@query("duplicate_lap_counts", FILED_SQL + """
SELECT race_id, count(*) AS "rows", count(*) - count(DISTINCT lap_number) AS duplicates FROM fl GROUP BY 1""")
def duplicate_lap_counts(spark, folder):
    _, laps, *_ = filed(spark, folder)
    return Q.duplicate_count(laps, ["race_id"], ["lap_number"])


@query("pit_sequence_gaps", FILED_SQL + """
SELECT race_id, driver_id, count(DISTINCT stop_number) AS stops, max(stop_number) AS last_stop,
  min(stop_number) <> 1 OR max(stop_number) <> count(DISTINCT stop_number) AS has_gap FROM fp GROUP BY 1, 2""")
def pit_sequence_gaps(spark, folder):
    _, _, pits, _ = filed(spark, folder)
    return Q.sequence_gaps(pits, ["race_id", "driver_id"], "stop_number")


@query("orphan_laps", FILED_SQL + """
SELECT race_id, driver_id, lap_number, row_index FROM fl
WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.race_id = fl.race_id AND fr.driver_id = fl.driver_id)""")
def orphan_laps(spark, folder):
    results, laps, *_ = filed(spark, folder)
    rows = laps.select("race_id", "driver_id", "lap_number", "row_index")
    return Q.orphans(rows, results, ["race_id", "driver_id"])


def catalog(spark, folder):
    """Event catalog with names, capabilities and tier."""
    v = archive(spark, folder)
    names = v.results.groupBy("session_id").agg(
        F.collect_set("driver_name").alias("drivers"), F.collect_set("team_name").alias("teams")
    )
    flags = {
        "lap_times": F.col("cap_lap_times"), "lap_positions": F.col("cap_lap_positions"),
        "pit_stops": F.col("cap_pit_stops"), "weather": F.col("event_id") % 5 == 0,
        "telemetry": F.col("event_id") % 7 == 0, "track_positions": F.col("event_id") % 14 == 0,
        "race_control": F.col("event_id") % 10 == 0, "stints": F.col("event_id") % 6 == 0,
        "compounds": F.col("event_id") % 12 == 0, "ml_intelligence": F.col("event_id") % 4 == 1,
        "strategy_simulation": F.col("event_id") % 4 == 1,
    }
    flags["telemetry"] = flags["telemetry"] | (F.col("event_id") % 60 == 1)
    for c in ("track_positions", "weather", "race_control", "compounds"):
        flags[c] = flags[c] | (F.col("event_id") % 60 == 1)
    return (
        v.events.join(names, "session_id", "left")
        .withColumn("official_name", F.upper("event_name"))
        .withColumn("country", F.when(F.col("event_id") % 2 == 0, F.col("circuit_name")))
        .withColumn("tier", C.tier(lambda name: flags[name]))
        .withColumn(
            "capabilities",
            F.create_map(*[x for n, c in flags.items() for x in (F.lit(n), c)]),
        )
    )


CATALOG_SQL = "WITH " + ARCHIVE_SQL + """,
cat AS (SELECT e.*, upper(event_name) AS official_name, CASE WHEN event_id % 2 = 0 THEN circuit_name END AS country, drivers, teams,
  CASE WHEN full_set THEN 'full' WHEN tel OR trk THEN 'telemetry' WHEN wea OR rc OR sti OR com THEN 'detailed-timing'
    WHEN (cap_lap_times OR cap_lap_positions) AND cap_pit_stops THEN 'lap-and-pit'
    WHEN cap_lap_times OR cap_lap_positions THEN 'lap-data' ELSE 'archive' END AS tier, rc
  FROM (SELECT *, event_id % 60 = 1 AS full_set, event_id % 7 = 0 OR event_id % 60 = 1 AS tel, event_id % 14 = 0 OR event_id % 60 = 1 AS trk,
    event_id % 5 = 0 OR event_id % 60 = 1 AS wea, event_id % 10 = 0 OR event_id % 60 = 1 AS rc, event_id % 6 = 0 AS sti,
    event_id % 12 = 0 OR event_id % 60 = 1 AS com FROM ev) e
  LEFT JOIN (SELECT session_id, list(DISTINCT driver_name) AS drivers, list(DISTINCT team_name) AS teams FROM results GROUP BY 1) USING (session_id))"""


@query("catalog_search", CATALOG_SQL + """
SELECT event_id, season, round_number, circuit_name, tier, status, count(*) OVER () AS total FROM cat
WHERE status = 'completed' AND rc AND len(list_filter(drivers, lambda x: contains(lower(x), '#00000000'))) > 0
  AND contains(lower(concat_ws(' ', event_name, official_name, circuit_name, coalesce(country, ''), array_to_string(drivers, ' '), array_to_string(teams, ' '))), 'nation_1')
ORDER BY season DESC, round_number DESC, event_id DESC LIMIT 50""")
def catalog_search(spark, folder):
    found = C.catalog_query(
        catalog(spark, folder), status="completed", capability="race_control", driver="#00000000", text="Nation_1"
    )
    rows = found.select("event_id", "season", "round_number", "circuit_name", "tier", "status")
    shown, total = A.page(rows, C.newest_first())
    return shown.withColumn("total", total.scalar())


@query("season_index", "WITH " + ARCHIVE_SQL + """
SELECT season AS year, count(*) AS event_count, count(*) FILTER (status = 'completed') AS completed_event_count,
  max(event_date) AS latest_event_date FROM ev GROUP BY 1""")
def season_index(spark, folder):
    return C.season_index(archive(spark, folder).events)


@query("catalog_counts", CATALOG_SQL + """
SELECT 'status' AS dimension, status AS value, count(*) AS events FROM cat GROUP BY 2
UNION ALL SELECT 'quality', quality_status, count(*) FROM cat GROUP BY 2
UNION ALL SELECT 'tier', tier, count(*) FROM cat GROUP BY 2""")
def catalog_counts(spark, folder):
    return C.catalog_counts(catalog(spark, folder))


@query("catalog_merge", "WITH " + ARCHIVE_SQL + """,
new AS (SELECT event_id, season + 1 AS season, 'revised' AS status FROM ev WHERE status = 'scheduled')
SELECT season, status, count(*) AS events FROM (SELECT event_id, season, status FROM ev WHERE event_id NOT IN (SELECT event_id FROM new)
UNION ALL SELECT * FROM new) GROUP BY ALL""")
def catalog_merge(spark, folder):
    old = archive(spark, folder).events.select("event_id", "season", "status")
    new = old.where(F.col("status") == "scheduled").select(
        "event_id", (F.col("season") + 1).alias("season"), F.lit("revised").alias("status")
    )
    return C.merge_catalog(old, new).groupBy("season", "status").agg(F.count(F.lit(1)).alias("events"))


@query("session_capabilities", """
WITH counts AS (SELECT l_orderkey AS session_id, CASE l_linenumber % 8 WHEN 0 THEN 'driver_classifications' WHEN 1 THEN 'laps' WHEN 2 THEN 'race_positions'
   WHEN 3 THEN 'pit_stops' WHEN 4 THEN 'stints' WHEN 5 THEN 'weather' WHEN 6 THEN 'telemetry_index' ELSE 'track_positions' END AS table_name,
   CAST(l_quantity AS BIGINT) - 10 AS n, CASE l_partkey % 7 WHEN 0 THEN 'Speed' WHEN 1 THEN 'nGear' WHEN 2 THEN 'RPM' WHEN 3 THEN 'DRS'
   WHEN 4 THEN 'Brake' WHEN 5 THEN 'Throttle' ELSE 'X' END AS channel, l_returnflag FROM lineitem),
f AS (SELECT session_id, bool_or(table_name = 'driver_classifications') AND coalesce(sum(n) FILTER (table_name = 'driver_classifications'), 0) > 0 AS results,
  coalesce(sum(n) FILTER (table_name = 'laps'), 0) > 0 AS lap_times, coalesce(sum(n) FILTER (table_name = 'race_positions'), 0) > 0 AS lap_positions,
  coalesce(sum(n) FILTER (table_name = 'pit_stops'), 0) > 0 AS pit_stops, coalesce(sum(n) FILTER (table_name = 'stints'), 0) > 0 AS stints,
  coalesce(sum(n) FILTER (table_name = 'weather'), 0) > 0 AS weather, coalesce(sum(n) FILTER (table_name = 'telemetry_index'), 0) > 0 AS telemetry,
  coalesce(sum(n) FILTER (table_name = 'track_positions'), 0) > 0 AS track_positions,
  bool_or(channel = 'Speed') AS speed, bool_or(channel = 'nGear') AS gear, bool_or(channel = 'RPM') AS rpm, bool_or(channel = 'DRS') AS drs,
  bool_or(channel = 'Brake') AS brake, bool_or(channel = 'Throttle') AS throttle, bool_or(l_returnflag = 'A') AS ml FROM counts GROUP BY 1)
SELECT session_id, results, lap_times, lap_positions, pit_stops, stints, weather, telemetry, track_positions, speed, gear, rpm, drs, brake, throttle,
  ml AS ml_intelligence, CASE WHEN telemetry OR track_positions THEN 'telemetry' WHEN weather OR stints THEN 'detailed-timing'
  WHEN (lap_times OR lap_positions) AND pit_stops THEN 'lap-and-pit' WHEN lap_times OR lap_positions THEN 'lap-data' ELSE 'archive' END AS tier FROM f""")
def session_capabilities(spark, folder):
    items = table(spark, folder, "lineitem")
    names = [
        "driver_classifications", "laps", "race_positions", "pit_stops", "stints", "weather",
        "telemetry_index", "track_positions",
    ]
    channel = ["Speed", "nGear", "RPM", "DRS", "Brake", "Throttle", "X"]
    rows = items.select(
        F.col("l_orderkey").alias("session_id"),
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber") % 8 + 1).alias("table_name"),
        (F.col("l_quantity").cast("long") - 10).alias("rows"),
        F.element_at(F.array(*[F.lit(n) for n in channel]), (F.col("l_partkey") % 7 + 1).cast("int")).alias("channel"),
        "l_returnflag",
    )
    # SQL twin numbers Brake/Throttle at 4 and 5.
    out = C.capabilities(rows, rows, rows.where(F.col("l_returnflag") == "A"))
    return out.drop("compounds", "race_control", "grid", "strategy_simulation")


@query("channel_quality", """
WITH car AS (SELECT l_returnflag, l_extendedprice / 200 AS speed, CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 4 END AS rpm, l_quantity / 5 AS gear,
   l_discount * 1100 AS throttle, CASE WHEN l_tax < 0.07::DOUBLE THEN CAST(l_tax > 0.03::DOUBLE AS INT) END AS brake, CAST(l_linenumber AS VARCHAR) || CASE WHEN l_linenumber = 5 THEN 'x' ELSE '' END AS drs FROM lineitem),
u AS (SELECT l_returnflag, unnest([{'c': 'speed', 'v': CAST(speed AS VARCHAR)}, {'c': 'rpm', 'v': CAST(rpm AS VARCHAR)}, {'c': 'gear', 'v': CAST(gear AS VARCHAR)},
   {'c': 'throttle', 'v': CAST(throttle AS VARCHAR)}, {'c': 'brake', 'v': CAST(brake AS VARCHAR)}, {'c': 'drs', 'v': drs}]) AS x FROM car),
n AS (SELECT l_returnflag, x.c AS channel, x.v AS raw, try_cast(x.v AS DOUBLE) AS v FROM u),
k AS (SELECT l_returnflag, channel, count(*) AS samples, count(v) AS present, count(*) FILTER (raw IS NULL) AS missing,
  count(*) FILTER (raw IS NOT NULL AND v IS NULL) + count(*) FILTER (CASE channel WHEN 'speed' THEN v NOT BETWEEN 0 AND 450 WHEN 'rpm' THEN v NOT BETWEEN 0 AND 25000
    WHEN 'gear' THEN v <> floor(v) OR v NOT BETWEEN 0 AND 8 WHEN 'throttle' THEN v NOT BETWEEN 0 AND 100 WHEN 'brake' THEN v NOT IN (0, 1)
    ELSE v NOT IN (0, 1, 2, 3, 8, 10, 12, 14) END) AS invalid FROM n GROUP BY 1, 2)
SELECT *, CASE WHEN invalid > 0 THEN 'degraded' WHEN present = 0 THEN 'unavailable' WHEN missing > 0 THEN 'partial' ELSE 'verified' END AS status FROM k""")
def channel_quality(spark, folder):
    car = table(spark, folder, "lineitem").select(
        "l_returnflag",
        (F.col("l_extendedprice") / 200).alias("speed"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 4).alias("rpm"),
        (F.col("l_quantity") / 5).alias("gear"),
        (F.col("l_discount") * 1100).alias("throttle"),
        F.when(F.col("l_tax") < 0.07, (F.col("l_tax") > 0.03).cast("int")).alias("brake"),
        F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 5, "x").otherwise("")).alias("drs"),
    )
    return K.channel_quality(car, ["l_returnflag"], ["speed", "rpm", "gear", "throttle", "brake", "drs"])


def car_feed(spark, folder):
    e = table(spark, folder, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    base = e.select(day.alias("session_id"), F.col("user_id").alias("driver_id"), "value", "event_type", "event_id")
    car = base.select(
        "session_id", "driver_id",
        F.when(F.col("value") > 40, F.col("value")).otherwise(0.0).alias("speed"),
        F.when(F.col("value") > 50, F.col("value")).otherwise(0.0).alias("rpm"),
        F.when(F.col("value") > 60, F.col("value")).otherwise(0.0).alias("throttle"),
        F.when(F.col("value") > 70, 1).otherwise(0).alias("gear"),
    )
    laps = base.select(
        "session_id", "driver_id",
        (F.col("event_type") == "click").alias("is_accurate"),
        F.col("value").alias("lap_time"),
        F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("pit_in_time"),
        F.lit(None).cast("double").alias("pit_out_time"),
    )
    return car, laps


CAR_SQL = """
WITH b AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS session_id, user_id AS driver_id, value, event_type, event_id FROM events),
d AS (SELECT session_id, driver_id, count(*) AS native_rows, bool_and(value <= 40) AS all_zero,
  count(*) FILTER (event_type = 'click' AND value > 0 AND event_id % 5 <> 0) AS clean_timed_laps FROM b GROUP BY 1, 2),
dead AS (SELECT *, CASE WHEN all_zero AND clean_timed_laps > 0 THEN 'degraded' ELSE 'available' END AS state FROM d)"""


@query("dead_sensors", CAR_SQL + " SELECT * FROM dead")
def dead_sensors(spark, folder):
    return K.dead_sensors(*car_feed(spark, folder))


@query("channel_availability", CAR_SQL + """
SELECT session_id, count(*) AS partitions, count(*) FILTER (state = 'degraded') AS degraded,
  CASE WHEN count(*) FILTER (state = 'degraded') = 0 THEN 'available' WHEN count(*) FILTER (state = 'degraded') = count(*) THEN 'telemetry-unsupported'
   ELSE 'partially-available' END AS car_data_state,
  CASE WHEN count(*) FILTER (state = 'degraded') = 0 THEN 'complete' ELSE 'partial' END AS quality FROM dead GROUP BY 1""")
def channel_availability(spark, folder):
    return K.availability_rollup(K.dead_sensors(*car_feed(spark, folder)))


@query("degraded_drivers", CAR_SQL + " SELECT DISTINCT session_id, driver_id FROM dead WHERE state = 'degraded'")
def degraded_drivers(spark, folder):
    return K.degraded_drivers(K.dead_sensors(*car_feed(spark, folder)))


def sessions(spark, folder):
    """Inventory of sessions and their status feed."""
    orders = table(spark, folder, "orders")
    labels = ["Practice 1", "Sprint_Qualifying", "Q", "race", "Day 1"]
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.substring("o_orderpriority", 1, 1).cast("int"))
    k = F.col("o_orderkey")
    rows = orders.select(
        k.alias("session_id"),
        (F.year("o_orderdate") + 22).alias("season"),
        F.month("o_orderdate").alias("round_number"),
        session_type(F.year("o_orderdate") + 22, label).alias("session_type"),
        F.when(k % 23 == 0, "future").when(k % 29 == 0, "cancelled").otherwise("past-unverified").alias("scheduled_state"),
        (k % 31 == 0).alias("cancelled"),
        (k % 2 == 0).alias("archive_complete"),
        F.when(k % 3 != 0, k % 7 != 0).alias("supported"),
        (k % 37 == 0).alias("source_missing"),
        F.when(k % 41 == 0, "ambiguous").otherwise("valid").alias("integrity"),
    )
    items = table(spark, folder, "lineitem")
    log = items.select(
        F.col("l_orderkey").alias("session_id"),
        (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        (F.col("l_quantity").cast("long") * 10 - F.when(F.col("l_tax") == 0.08, 400).otherwise(0)).alias("time_ns"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "Started")
        .when(F.col("l_returnflag") == "A", "Finalised")
        .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "Ends")
        .when(F.col("l_returnflag") == "R", "Aborted")
        .when(F.col("l_linestatus") == "F", "Started")
        .when(F.col("l_discount") > 0.08, "Strange")
        .otherwise("Inactive").alias("status"),
    )
    return rows, log


SESSIONS_SQL = """
WITH s AS (SELECT o_orderkey AS session_id, year(o_orderdate) + 22 AS season, month(o_orderdate) AS round_number,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'practice-1' WHEN '2' THEN CASE year(o_orderdate) + 22 WHEN 2021 THEN 'sprint' WHEN 2023 THEN 'sprint-shootout'
    ELSE 'sprint-qualifying' END WHEN '3' THEN 'qualifying' WHEN '4' THEN 'race' ELSE 'unknown' END AS session_type,
  CASE WHEN o_orderkey % 23 = 0 THEN 'future' WHEN o_orderkey % 29 = 0 THEN 'cancelled' ELSE 'past-unverified' END AS scheduled_state,
  o_orderkey % 31 = 0 AS cancelled, o_orderkey % 2 = 0 AS archive_complete, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 <> 0 END AS supported,
  o_orderkey % 37 = 0 AS source_missing, CASE WHEN o_orderkey % 41 = 0 THEN 'ambiguous' ELSE 'valid' END AS integrity FROM orders),
log AS (SELECT l_orderkey AS session_id, l_linenumber * 100000000::BIGINT + l_partkey * 1000 + l_suppkey AS seq,
  CAST(l_quantity AS BIGINT) * 10 - CASE WHEN l_tax = 0.08::DOUBLE THEN 400 ELSE 0 END AS time_ns,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Started' WHEN l_returnflag = 'A' THEN 'Finalised' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Ends'
   WHEN l_returnflag = 'R' THEN 'Aborted' WHEN l_linestatus = 'F' THEN 'Started' WHEN l_discount > 0.08::DOUBLE THEN 'Strange' ELSE 'Inactive' END AS status FROM lineitem),
e AS (SELECT session_id, arg_max(status, (seq, status)) AS last_status, bool_or(status = 'Started') AS started FROM log GROUP BY 1),
c AS (SELECT s.*, last_status, started, CASE WHEN scheduled_state = 'future' THEN 'future' WHEN cancelled OR scheduled_state = 'cancelled' THEN 'cancelled'
  WHEN last_status IN ('Finalised','Ends') THEN CASE WHEN started THEN 'completed' ELSE 'abandoned-no-data' END
  WHEN last_status = 'Aborted' THEN 'abandoned-no-data' WHEN archive_complete AND coalesce(started, false) THEN 'completed'
  WHEN supported = false THEN 'unsupported' ELSE 'unverified' END AS st0 FROM s LEFT JOIN e USING (session_id)),
done AS (SELECT * EXCLUDE (st0), CASE WHEN integrity <> 'valid' AND CASE WHEN source_missing AND st0 <> 'future' THEN 'abandoned-no-data' ELSE st0 END NOT IN ('future','cancelled')
   THEN 'unverified' WHEN source_missing AND st0 <> 'future' THEN 'abandoned-no-data' ELSE st0 END AS state FROM c)"""


@query("session_completion", SESSIONS_SQL + " SELECT * FROM done")
def session_completion(spark, folder):
    return I.classify_completion(*sessions(spark, folder))


@query("inventory_summary", SESSIONS_SQL + " SELECT season, session_type, state, count(*) AS sessions FROM done GROUP BY ALL")
def inventory_summary(spark, folder):
    return I.inventory_summary(I.classify_completion(*sessions(spark, folder)))


@query("selected_sessions", SESSIONS_SQL + """
SELECT session_id, season, session_type FROM done WHERE state = 'completed' AND season >= 2019 AND session_type IN ('race', 'sprint')""")
def selected_sessions(spark, folder):
    done = I.classify_completion(*sessions(spark, folder))
    return C.select_sessions(done, from_season=2019, session_types=["race", "sprint"]).select(
        "session_id", "season", "session_type"
    )


@query("status_chronology", SESSIONS_SQL + """,
o AS (SELECT *, lag(time_ns) OVER w AS pt, lag(status) OVER w AS ps FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, seq, time_ns, status, CASE WHEN status = 'Strange' THEN 'unknown-status' WHEN time_ns < 0 THEN 'invalid-timestamp'
  WHEN time_ns < pt THEN 'decreasing-timestamp' WHEN time_ns = pt AND status <> ps AND NOT (ps = 'Finalised' AND status = 'Ends') THEN 'ambiguous-timestamp' END AS issue FROM o""")
def status_chronology(spark, folder):
    _, log = sessions(spark, folder)
    return I.status_chronology(log, chunk_rows=ROWS)


@query("schedule_inventory", SESSIONS_SQL + """
SELECT CASE WHEN season = 2022 THEN NULL ELSE session_type END AS session_type, season, CASE WHEN season = 2022 THEN 'source-unavailable' END AS failure,
  count(*) FILTER (season <> 2022) AS sessions FROM s GROUP BY ALL""")
def schedule_inventory(spark, folder):
    rows, _ = sessions(spark, folder)
    failed = F.col("season") == 2022
    schedule = rows.select(
        "season", F.when(~failed, F.col("session_type")).alias("session_type"),
        F.when(~failed, F.col("session_id")).alias("session_id"),
        F.when(failed, "source-unavailable").alias("failure"),
    )
    return I.schedule_inventory(schedule)


def providers(spark, folder):
    e = table(spark, folder, "events")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    kind = F.get_json_object("props", "$.k").cast("int") % 5
    base = e.select(
        "event_id", "event_type", second.alias("s"), F.concat(F.lit("type-"), kind.cast("string")).alias("session_type"),
        F.lit(2024).alias("season"), "user_id",
    )
    canonical = base.where(F.col("event_type").isin("view", "signup")).select(
        F.col("event_id").alias("session_id"), "season", "session_type",
        F.when(F.col("user_id") % 11 != 0, F.col("s")).alias("scheduled_s"),
        F.when(F.col("user_id") % 7 == 0, F.col("event_id") % 3000).alias("timing_key"),
        F.when(F.col("user_id") % 2 == 0, "completed").otherwise("unverified").alias("state"),
    )
    provider = base.where(F.col("event_type").isin("purchase", "error")).select(
        F.col("event_id").alias("session_key"), "season", "session_type", F.col("s").alias("start_s"),
        F.when(F.col("user_id") % 13 == 0, "Day 2").otherwise("Race").alias("label"),
        (F.col("user_id") % 17 == 0).alias("is_cancelled"),
    )
    return canonical, provider


PROVIDER_SQL = """
WITH b AS (SELECT event_id, event_type, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, 'type-' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) AS session_type FROM events),
cn AS (SELECT event_id AS session_id, 2024 AS season, session_type, CASE WHEN user_id % 11 <> 0 THEN s END AS scheduled_s,
  CASE WHEN user_id % 7 = 0 THEN event_id % 3000 END AS timing_key, CASE WHEN user_id % 2 = 0 THEN 'completed' ELSE 'unverified' END AS state
  FROM b WHERE event_type IN ('view','signup')),
pr AS (SELECT event_id AS session_key, 2024 AS season, session_type, s AS start_s, CASE WHEN user_id % 13 = 0 THEN 'Day 2' ELSE 'Race' END AS label,
  user_id % 17 = 0 AS is_cancelled FROM b WHERE event_type IN ('purchase','error')),
near AS (SELECT c.session_id, count(p.session_key) AS n, max(p.session_key) AS k FROM cn c LEFT JOIN pr p ON c.session_type = p.session_type
  AND abs(c.scheduled_s - p.start_s) <= 900 GROUP BY 1),
ex AS (SELECT c.session_id, count(p.session_key) AS n FROM cn c LEFT JOIN pr p ON c.session_type = p.session_type AND c.timing_key = p.session_key GROUP BY 1),
m AS (SELECT c.*, CASE WHEN ex.n = 1 THEN c.timing_key WHEN ex.n > 1 THEN NULL WHEN near.n = 1 THEN near.k END AS provider_key
  FROM cn c JOIN near USING (session_id) JOIN ex USING (session_id))"""


@query("provider_matches", PROVIDER_SQL + " SELECT session_id, session_type, scheduled_s, timing_key, provider_key FROM m")
def provider_matches(spark, folder):
    canonical, provider = providers(spark, folder)
    return I.match_provider(canonical, provider, 900, chunk_rows=ROWS).select(
        "session_id", "session_type", "scheduled_s", "timing_key", "provider_key"
    )


@query("provider_reconciliation", PROVIDER_SQL + """,
g AS (SELECT provider_key AS session_key, min(session_id) AS canonical_session_id, arg_min(state, session_id) AS st, count(*) AS n
  FROM m WHERE provider_key IS NOT NULL GROUP BY 1)
SELECT p.*, canonical_session_id, coalesce(n, 0) AS claims, CASE WHEN st IS NOT NULL AND is_cancelled AND st <> 'future' THEN 'cancelled' WHEN st IS NOT NULL THEN st
  WHEN lower(label) LIKE 'day %' THEN 'testing' WHEN is_cancelled THEN 'cancelled' WHEN start_s >= 1706000000 THEN 'future' ELSE 'unmatched-unverified' END AS reconciliation_state
FROM pr p LEFT JOIN g USING (session_key)""")
def provider_reconciliation(spark, folder):
    canonical, provider = providers(spark, folder)
    return I.reconcile(canonical, provider, 1706000000, 900, chunk_rows=ROWS)


@query("inventory_dedupe", """
WITH p AS (SELECT l_partkey % 500 AS k, l_linenumber, l_returnflag FROM lineitem)
SELECT k, min((l_linenumber, l_returnflag))[1] AS l_linenumber, min((l_linenumber, l_returnflag))[2] AS l_returnflag,
  count(*) - count(DISTINCT (l_linenumber, l_returnflag)) AS duplicates, count(DISTINCT (l_linenumber, l_returnflag)) > 1 AS conflicting FROM p GROUP BY 1""")
def inventory_dedupe(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_partkey") % 500).alias("k"), "l_linenumber", "l_returnflag")
    return I.dedupe_inventory(rows, "k", ["l_linenumber", "l_returnflag"])


@query("inventory_assessment", """
WITH ex AS (SELECT o_orderkey AS session_id FROM orders WHERE o_orderstatus <> 'P'),
jb AS (SELECT l_orderkey AS session_id, max(CASE l_returnflag WHEN 'A' THEN 'COMPLETE' WHEN 'N' THEN 'FAILED' ELSE 'RUNNING' END) AS js FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
pb AS (SELECT DISTINCT l_orderkey AS session_id FROM lineitem WHERE l_tax = 0),
f AS (SELECT ex.session_id IS NOT NULL AS expected, pb.session_id IS NOT NULL AS published, CASE WHEN js IS NULL THEN 'missing' WHEN js = 'COMPLETE' THEN 'complete'
  WHEN js = 'FAILED' THEN 'failed' ELSE 'incomplete' END AS progress
  FROM ex FULL JOIN jb ON ex.session_id = jb.session_id FULL JOIN pb ON coalesce(ex.session_id, jb.session_id) = pb.session_id)
SELECT expected, published, progress, count(*) AS sessions FROM f GROUP BY ALL""")
def inventory_assessment(spark, folder):
    items = table(spark, folder, "lineitem")
    expected = table(spark, folder, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("session_id"))
    jobs = items.where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("session_id"),
        F.when(F.col("l_returnflag") == "A", "COMPLETE").when(F.col("l_returnflag") == "N", "FAILED").otherwise("RUNNING").alias("job_state"),
    )
    published = items.where(F.col("l_tax") == 0).select(F.col("l_orderkey").alias("session_id"))
    return I.inventory_counts(I.assess_inventory(expected, jobs, published))


@query("context_links", "WITH " + ARCHIVE_SQL + """,
t AS (SELECT session_id, season, session_id // 8 AS round_number FROM ev),
rep AS (SELECT season, round_number, count(*) AS n, max(session_id) AS sid FROM t GROUP BY 1, 2),
rc AS (SELECT season, session_id // 8 AS round_number, count(*) AS n, max(session_id) FILTER (status = 'completed' AND quality_status IN ('verified','good')) AS sid FROM ev GROUP BY 1, 2)
SELECT t.*, CASE WHEN rep.n = 1 THEN rep.sid END AS replay_session_id, CASE WHEN rc.n = 1 THEN rc.sid END AS race_session_id
FROM t LEFT JOIN rep USING (season, round_number) LEFT JOIN rc USING (season, round_number)""")
def context_links(spark, folder):
    # Eight neighbouring orders share a round, seldom with another of their season.
    ev = archive(spark, folder).events.withColumn("round_number", F.floor(F.col("session_id") / 8).cast("long"))
    return C.link_context(ev.select("session_id", "season", "round_number"), ev, ev)


@query("telemetry_sessions", CATALOG_SQL + """
SELECT session_id, season, circuit_name FROM cat WHERE season = 1997 AND tier = 'telemetry' AND contains(lower(circuit_name), '1') AND list_contains(drivers, 'Supplier#000000007')""")
def telemetry_sessions(spark, folder):
    rows = catalog(spark, folder).withColumn("session_type", F.col("tier"))
    found = C.telemetry_sessions(rows, season=1997, session_type="telemetry", circuit="1", driver="Supplier#000000007")
    return found.select("session_id", "season", "circuit_name")


@query("timing_board", "WITH " + ARCHIVE_SQL + """
SELECT l.session_id, l.driver_id, l.position, l.lap_time_ms, r.driver_name, r.finish_position FROM laps l
LEFT JOIN results r ON r.session_id = l.session_id AND r.driver_id = l.driver_id WHERE l.lap_number = 3""")
def timing_board(spark, folder):
    v = archive(spark, folder)
    board = C.board_at_lap(v.laps, v.results.select("session_id", "driver_id", "driver_name", "finish_position"), 3)
    return board.select("session_id", "driver_id", "position", "lap_time_ms", "driver_name", "finish_position")


@query("session_lap_slice", "WITH " + ARCHIVE_SQL + """
SELECT session_id, driver_id, lap_number, lap_time_ms FROM laps WHERE driver_id = 7 AND lap_number BETWEEN 2 AND 4""")
def session_lap_slice(spark, folder):
    rows = archive(spark, folder).laps.select("session_id", "driver_id", "lap_number", "lap_time_ms")
    return C.session_slice(rows, driver_id=7, lap_range=(2, 4))


def sized(spark, folder):
    """Completed counts and measured sizes per stratum."""
    docs = table(spark, folder, "documents")
    season = (2018 + F.col("doc_id") % 9).cast("int")
    kinds = ["practice-1", "race", "sprint-shootout"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = docs.select("doc_id", season.alias("season"), kind.alias("kind"), F.col("n_chars").alias("bytes"), "lang")
    rows = rows.withColumn("stratum", stratum(F.col("season"), F.col("kind")))
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("completed_count"))
    samples = rows.where(F.col("lang") != "en").where(~((F.col("season") > 2023) & (F.col("kind") == "race")))
    return SimpleNamespace(rows=rows, counts=counts, samples=samples)


SIZED_SQL = """
WITH d0 AS (SELECT doc_id, CAST(2018 + doc_id % 9 AS INT) AS season, CASE doc_id % 3 WHEN 0 THEN 'practice-1' WHEN 1 THEN 'race' ELSE 'sprint-shootout' END AS kind, n_chars AS bytes, lang FROM documents),
d AS (SELECT *, CASE WHEN season <= 2020 THEN '2018-2020' WHEN season <= 2023 THEN '2021-2023' ELSE '2024-current' END || '/' ||
  CASE WHEN kind LIKE 'sprint-%' THEN 'sprint-qualifying-shootout' ELSE kind END AS stratum FROM d0),
counts AS (SELECT stratum, count(*) AS completed_count FROM d GROUP BY 1),
smp AS (SELECT * FROM d WHERE lang <> 'en' AND NOT (season > 2023 AND kind = 'race')),
dist AS (SELECT stratum, count(*) AS samples, quantile_cont(bytes, 0.5) AS median, quantile_cont(bytes, 0.75) AS p75, quantile_cont(bytes, 0.9) AS p90,
  CASE WHEN count(*) >= 20 THEN quantile_cont(bytes, 0.95) END AS p95, min(bytes) AS min_bytes, max(bytes) AS max_bytes, avg(bytes) AS mean_bytes FROM smp GROUP BY 1),
sd AS (SELECT c.stratum, completed_count, coalesce(samples, 0) AS samples, median, p75, p90, p95, min_bytes, max_bytes, mean_bytes,
  CASE WHEN samples < 10 THEN CAST(max_bytes AS DOUBLE) ELSE p90 END AS upper_bytes,
  CASE WHEN coalesce(samples, 0) = 0 THEN 'missing' WHEN samples < 10 THEN 'weak' ELSE 'empirical' END AS strength FROM counts c LEFT JOIN dist USING (stratum))"""


@query("stratified_distribution", SIZED_SQL + " SELECT * FROM sd")
def stratified_distribution(spark, folder):
    v = sized(spark, folder)
    return P.stratified_distribution(v.counts, v.samples, ROWS)


@query("stratified_projection", SIZED_SQL + """
SELECT CAST(sum(completed_count) AS BIGINT) AS completed, CAST(ceil(sum(completed_count * mean_bytes)) AS BIGINT) AS expected_bytes,
  CAST(ceil(sum(completed_count * upper_bytes)) AS BIGINT) AS conservative_bytes, CAST(sum(completed_count * max_bytes) AS BIGINT) AS stress_bytes,
  CAST(ceil(CAST(sum(completed_count * max_bytes) AS BIGINT) * 1.25::DOUBLE) AS BIGINT) AS stress_with_margin_bytes,
  count(*) FILTER (strength = 'missing') AS missing_strata, count(*) FILTER (strength <> 'empirical') AS weak_strata FROM sd""")
def stratified_projection(spark, folder):
    v = sized(spark, folder)
    return P.projection_totals(P.stratified_distribution(v.counts, v.samples, ROWS))


@query("bootstrap_interval", SIZED_SQL + """,
num AS (SELECT stratum, bytes, row_number() OVER (PARTITION BY stratum ORDER BY bytes, doc_id) AS pos, count(*) OVER (PARTITION BY stratum) AS n FROM smp),
dr AS (SELECT stratum, rep, CAST('0x' || substr(sha256('2216|' || stratum || '|' || rep || '|' || (pos - 1)), 1, 12) AS BIGINT) % n // 64 AS block FROM num, range(0, 1000) r(rep)),
hit AS (SELECT stratum, rep, block, count(*) AS k FROM dr GROUP BY 1, 2, 3),
blk AS (SELECT stratum, (pos - 1) // 64 AS block, count(*) AS size FROM num GROUP BY 1, 2),
pk AS (SELECT stratum, rep, block * 64 + 1 + CAST('0x' || substr(sha256('2216|' || stratum || '|' || rep || '|' || block || '|' || j), 1, 12) AS BIGINT) % size AS pick
  FROM (SELECT stratum, rep, block, size, unnest(range(k)) AS j FROM hit JOIN blk USING (stratum, block))),
mn AS (SELECT rep, pk.stratum, avg(bytes) AS mean FROM pk JOIN num ON num.stratum = pk.stratum AND num.pos = pk.pick GROUP BY 1, 2),
tot AS (SELECT rep, sum(completed_count * mean) AS total FROM mn JOIN counts USING (stratum) GROUP BY 1)
SELECT count(*) AS repetitions, round(quantile_cont(total, 0.025), 3) AS low_bytes, round(quantile_cont(total, 0.975), 3) AS high_bytes FROM tot""")
def bootstrap_interval(spark, folder):
    v = sized(spark, folder)
    totals = P.bootstrap_totals(v.counts, v.samples, "doc_id", chunk_rows=ROWS, block=64)
    return P.bootstrap_interval(totals).withColumns(
        {c: F.round(c, 3) for c in ("low_bytes", "high_bytes")}
    )


@query("envelope_projection", SIZED_SQL + """
SELECT CAST(ceil((SELECT max(bytes) FROM smp) * 300 * 1.25::DOUBLE) AS BIGINT) AS projected_bytes, (SELECT count(*) FROM smp) AS samples,
  lang AS largest_channel, CAST(b AS BIGINT) AS largest_channel_bytes FROM (SELECT lang, sum(bytes) AS b FROM d GROUP BY 1) ORDER BY b DESC, lang DESC LIMIT 1""")
def envelope_projection(spark, folder):
    v = sized(spark, folder)
    return P.envelope_projection(
        v.samples.withColumn("total_bytes", F.col("bytes")), v.rows.withColumn("channel", F.col("lang")), 300
    )


@query("missing_sample_years", SIZED_SQL + " SELECT DISTINCT season FROM d WHERE season NOT IN (SELECT season FROM smp WHERE kind = 'race')")
def missing_sample_years(spark, folder):
    v = sized(spark, folder)
    return P.missing_years(v.samples.where(F.col("kind") == "race"), v.rows.select("season").distinct())


@query("stratified_sample", SIZED_SQL + """,
pin AS (SELECT stratum, count(*) AS pins FROM d WHERE doc_id % 211 = 0 GROUP BY 1),
pool AS (SELECT d.*, row_number() OVER (PARTITION BY stratum ORDER BY sha256('2216|' || doc_id), doc_id) AS r FROM d WHERE doc_id % 211 <> 0)
SELECT stratum, doc_id, true AS pinned FROM d WHERE doc_id % 211 = 0
UNION ALL SELECT pool.stratum, doc_id, false FROM pool LEFT JOIN pin USING (stratum)
WHERE r <= CASE WHEN split_part(pool.stratum, '/', 2) LIKE 'practice-%' THEN 1 ELSE 3 END - coalesce(pins, 0)""")
def stratified_sample(spark, folder):
    rows = sized(spark, folder).rows
    target = F.when(F.col("kind").startswith("practice-"), 1).otherwise(3)
    out = P.stratified_sample(
        rows.drop("stratum"), stratum(F.col("season"), F.col("kind")), target, F.col("doc_id") % 211 == 0, "doc_id"
    )
    return out.select("stratum", "doc_id", "pinned")


@query("table_time_range", "SELECT min(least(epoch_us(l_shipdate), l_partkey)) AS min_time, max(greatest(epoch_us(l_shipdate), l_partkey)) AS max_time FROM lineitem")
def table_time_range(spark, folder):
    items = table(spark, folder, "lineitem").select(
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("a"), F.col("l_partkey").alias("b")
    )
    return P.time_range(items, ["a", "b"])


@query("table_digest", """
WITH h AS (SELECT CAST('0x' || substr(sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 15) AS BIGINT) AS h FROM events)
SELECT count(*) AS "rows", bit_xor(h) AS xor_digest, CAST(sum(h % 1000003) AS BIGINT) AS sum_digest FROM h""")
def table_digest(spark, folder):
    return D.table_digest(table(spark, folder, "events"), ["user_id", "event_type", "event_id"])


@query("keyed_dedupe", """
WITH b AS (SELECT user_id, event_type, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
j AS (SELECT *, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","k":' || k || ',"user_id":' || user_id || '}' AS j FROM b)
SELECT user_id, event_type, arg_min(event_id, j) AS event_id, arg_min(k, j) AS k, count(*) AS copies, count(DISTINCT j) > 1 AS conflicting FROM j GROUP BY 1, 2""")
def keyed_dedupe(spark, folder):
    rows = table(spark, folder, "events").select(
        "user_id", "event_type", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    return D.dedupe(rows, ["user_id", "event_type"])
