"""Race-shaped views over the generic test tables.

The test tables hold no race data, so orders stand in for races, suppliers for
drivers, line items for laps and stops, and the event log for timing feeds.
Every view keeps all rows of its source; ``*_SQL`` holds the SQL twins.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators.scan import latest, running_sum, scan, series
from lapwing.session import durable


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def archive(spark: SparkSession, folder: str) -> SimpleNamespace:
    """results, laps, pits and events derived from orders and line items."""
    items = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    home = nation.select(F.col("n_nationkey"), F.col("n_name"))
    events = (
        orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(home, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("event_id"),
            F.col("o_orderkey").alias("session_id"),
            F.year("o_orderdate").alias("season"),
            F.month("o_orderdate").alias("round_number"),
            F.concat(F.lit("Event "), F.col("o_orderkey")).alias("event_name"),
            F.col("o_orderdate").cast("date").cast("string").alias("event_date"),
            F.col("n_name").alias("circuit_name"),
            F.when(F.col("o_orderstatus") == "P", "scheduled").otherwise("completed").alias("status"),
            F.element_at(
                F.create_map(
                    *[F.lit(x) for x in (
                        "1-URGENT", "verified", "2-HIGH", "good", "3-MEDIUM", "verified",
                        "4-NOT SPECIFIED", "partial", "5-LOW", "degraded",
                    )]
                ),
                F.col("o_orderpriority"),
            ).alias("quality_status"),
            (F.col("o_orderkey") % 4 != 0).alias("cap_lap_times"),
            (F.col("o_orderkey") % 8 != 0).alias("cap_lap_positions"),
            (F.col("o_orderkey") % 3 != 0).alias("cap_pit_stops"),
            (1 + F.col("o_orderkey") % 13).alias("result_rows"),
        )
    )
    first = F.struct(
        "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    )
    # Dealt by order first: the smallest struct is found by sorting, here shuffled parts and not whole files, and the join
    # with the order's event needs no shuffle of its own.
    picked = (
        items.select("l_orderkey", "l_suppkey", first.alias("i")).repartition("l_orderkey")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.min("i").alias("i"))
        .join(supplier.select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(home, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    flag, line = F.col("i.l_returnflag"), F.col("i.l_linestatus")
    results = picked.select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_suppkey").alias("driver_id"),
        F.col("s_name").alias("driver_name"),
        F.col("s_nationkey").alias("team_id"),
        F.col("n_name").alias("team_name"),
        F.when(F.col("i.l_quantity") >= 5, (F.col("i.l_partkey") % 20).cast("int")).alias("grid_position"),
        F.when(F.col("i.l_tax") != 0.08, F.col("i.l_linenumber")).alias("finish_position"),
        (F.col("i.l_quantity") / 4).alias("points"),
        (F.col("i.l_partkey") % 71).cast("int").alias("laps_completed"),
        F.when((flag == "R") & (line == "F") & (F.col("i.l_discount") >= 0.09), "Disqualified")
        .when((flag == "R") & (line == "F"), "Engine")
        .when(flag == "R", "+1 Lap")
        .when((flag == "A") & (line == "O"), "Withdrew")
        .when((flag == "A") | (line == "F"), "Finished")
        .when(F.col("i.l_discount") != 0, " did not Start ")
        .alias("status"),
        ((flag == "A") & (F.col("i.l_tax") < 0.04)).alias("classified"),
        F.round(F.col("i.l_extendedprice") * 100).cast("long").alias("total_time_ms"),
    )
    laps = items.select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_suppkey").alias("driver_id"),
        F.col("l_linenumber").alias("lap_number"),
        F.when(F.col("l_discount") != 0, (F.col("l_partkey") % 20 + 1).cast("int")).alias("position"),
        F.when(F.col("l_tax") != 0, F.round(F.col("l_extendedprice") * 100).cast("long")).alias("lap_time_ms"),
        (F.col("l_quantity") * 5).alias("average_speed_kph"),
        (F.col("l_quantity") >= 49).alias("is_fastest_lap"),
    )
    pits = items.where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_suppkey").alias("driver_id"),
        F.col("l_linenumber").alias("stop_number"),
        F.col("l_linenumber").alias("lap_number"),
        F.when(
            F.col("l_tax") != 0.01,
            F.col("l_quantity").cast("long") * 1000 + F.col("l_partkey") % 1000,
        ).alias("duration_ms"),
        F.col("l_shipdate").cast("date").cast("string").alias("local_time"),
    )
    return SimpleNamespace(results=results, laps=laps, pits=pits, events=events)


ARCHIVE_SQL = """
ev AS (
  SELECT o_orderkey AS event_id, o_orderkey AS session_id, year(o_orderdate) AS season,
    month(o_orderdate) AS round_number, 'Event ' || o_orderkey AS event_name,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date, n_name AS circuit_name,
    CASE WHEN o_orderstatus = 'P' THEN 'scheduled' ELSE 'completed' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'verified' WHEN '2-HIGH' THEN 'good'
      WHEN '3-MEDIUM' THEN 'verified' WHEN '4-NOT SPECIFIED' THEN 'partial' ELSE 'degraded' END AS quality_status,
    o_orderkey % 4 <> 0 AS cap_lap_times, o_orderkey % 8 <> 0 AS cap_lap_positions,
    o_orderkey % 3 <> 0 AS cap_pit_stops, 1 + o_orderkey % 13 AS result_rows
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
picked AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey
    ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) = 1),
results AS (
  SELECT l_orderkey AS session_id, l_suppkey AS driver_id, s_name AS driver_name, s_nationkey AS team_id,
    n_name AS team_name,
    CASE WHEN l_quantity >= 5 THEN CAST(l_partkey % 20 AS INT) END AS grid_position,
    CASE WHEN l_tax <> 0.08::DOUBLE THEN l_linenumber END AS finish_position, l_quantity / 4 AS points,
    CAST(l_partkey % 71 AS INT) AS laps_completed,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount >= 0.09::DOUBLE THEN 'Disqualified'
      WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Engine' WHEN l_returnflag = 'R' THEN '+1 Lap'
      WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'Withdrew'
      WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'Finished'
      WHEN l_discount <> 0 THEN ' did not Start ' END AS status,
    l_returnflag = 'A' AND l_tax < 0.04::DOUBLE AS classified,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS total_time_ms
  FROM picked JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
laps AS (
  SELECT l_orderkey AS session_id, l_suppkey AS driver_id, l_linenumber AS lap_number,
    CASE WHEN l_discount <> 0 THEN CAST(l_partkey % 20 + 1 AS INT) END AS position,
    CASE WHEN l_tax <> 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS lap_time_ms,
    l_quantity * 5 AS average_speed_kph, l_quantity >= 49 AS is_fastest_lap
  FROM lineitem),
pits AS (
  SELECT l_orderkey AS session_id, l_suppkey AS driver_id, l_linenumber AS stop_number, l_linenumber AS lap_number,
    CASE WHEN l_tax <> 0.01::DOUBLE THEN CAST(l_quantity AS BIGINT) * 1000 + l_partkey % 1000 END AS duration_ms,
    CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS local_time
  FROM lineitem WHERE l_returnflag = 'R')"""

OBS_SQL = ARCHIVE_SQL + """,
lap_agg AS (
  SELECT session_id, driver_id, count(*) AS recorded_lap_count, count(lap_time_ms) AS timed_lap_count,
    avg(lap_time_ms) AS raw_mean_lap_ms, quantile_cont(lap_time_ms, 0.5) AS raw_median_lap_ms,
    min(lap_time_ms) AS best_recorded_lap_ms, bool_or(is_fastest_lap) AS fastest_lap_recorded
  FROM laps GROUP BY ALL),
pit_agg AS (
  SELECT session_id, driver_id, count(*) AS n_pits, quantile_cont(duration_ms, 0.5) AS median_pit_duration_ms,
    list(duration_ms ORDER BY duration_ms) FILTER (duration_ms IS NOT NULL) AS pit_durations_ms
  FROM pits GROUP BY ALL),
classed AS (
  SELECT r.*, CASE
    WHEN contains(st, 'disqual') OR contains(st, 'excluded') THEN 'dsq'
    WHEN st = 'finished' THEN 'finished'
    WHEN classified OR (st LIKE '+%' AND contains(st, 'lap')) THEN 'classified'
    WHEN contains(st, 'did not start') OR contains(st, 'did not qualify') OR contains(st, 'did not prequalify')
      OR contains(st, 'not started')
      OR (coalesce(laps_completed, 0) = 0 AND (st IN ('withdrew','injury','injured','illness','safety','safety concerns')
          OR st LIKE 'withdraw%')) THEN 'dns'
    WHEN st <> '' THEN 'dnf' ELSE 'other' END AS outcome
  FROM (SELECT *, lower(trim(coalesce(status, ''))) AS st FROM results) r),
obs AS (
  SELECT e.event_id, c.session_id, e.season, e.round_number, e.event_name, e.event_date,
    lower(trim(regexp_replace(lower(e.circuit_name), '[^a-z0-9]+', '-', 'g'), '-')) AS circuit_id, e.circuit_name,
    c.driver_id, c.driver_name, c.team_id AS constructor_id, c.team_name AS constructor_name,
    c.grid_position, c.finish_position, coalesce(c.points, 0.0) AS points, c.laps_completed, c.outcome, c.classified,
    CASE WHEN c.grid_position > 0 AND c.finish_position > 0 AND c.outcome IN ('finished','classified')
      THEN c.grid_position - c.finish_position END AS positions_gained,
    coalesce(l.recorded_lap_count, 0) AS recorded_lap_count, coalesce(l.timed_lap_count, 0) AS timed_lap_count,
    l.raw_mean_lap_ms, l.raw_median_lap_ms, l.best_recorded_lap_ms,
    coalesce(l.fastest_lap_recorded, false) AS fastest_lap_recorded,
    CASE WHEN e.cap_pit_stops THEN coalesce(p.n_pits, 0) END AS pit_stop_count, p.median_pit_duration_ms,
    coalesce(p.pit_durations_ms, []) AS pit_durations_ms,
    e.cap_lap_times OR e.cap_lap_positions AS lap_data_available, e.cap_pit_stops AS pit_data_available,
    e.quality_status
  FROM classed c JOIN ev e USING (session_id)
  LEFT JOIN lap_agg l ON l.session_id = c.session_id AND l.driver_id = c.driver_id
  LEFT JOIN pit_agg p ON p.session_id = c.session_id AND p.driver_id = c.driver_id
  WHERE e.status = 'completed' AND e.quality_status IN ('verified', 'good'))"""


WEEK_US = 604_800_000_000
DAY_MS = 86_400_000

#: Rows of a chunk of an ordered scan.
ROWS = 200_000


_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """A canonical table, written once per session and folder, then reused.

    Ingest writes these tables before anything queries them; here the first
    query that needs one does.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        _STORED[key] = durable(build())
    return _STORED[key]


def feed(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "feed", lambda: build_feed(spark, folder))


def build_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as a timing feed: a week is a session, a user group a driver.

    ``lap_no`` is the lap under way, ``last_end`` the end of the lap before.
    """
    e = table(spark, folder, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)
    base = e.select(
        F.floor(us / F.lit(WEEK_US)).cast("int").alias("session_id"),
        (F.col("user_id") % 20).cast("int").alias("driver_id"),
        F.floor((F.pmod(us, F.lit(WEEK_US)) + 500) / F.lit(1000)).cast("long").alias("t_ms"),
        "event_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    click = F.col("event_type") == "click"
    s = series(("session_id", "driver_id"), ("t_ms", "event_id"), ROWS)
    scanned = scan(
        base, s,
        __n=running_sum(F.when(click, 1).otherwise(0).cast("long"), inclusive=False),
        last_end=latest(F.when(click, F.col("t_ms")), inclusive=False),
    )
    return scanned.withColumn("lap_no", (F.coalesce("__n", F.lit(0)) + 1).cast("int")).drop("__n")


def timing(spark: SparkSession, folder: str) -> SimpleNamespace:
    """Canonical timing tables derived from the feed."""
    f = feed(spark, folder)
    k = F.col("k")
    keys = ["session_id", "driver_id"]
    stint = (1 + F.floor((F.col("lap_no") - 1) / 8)).cast("int")
    compounds = F.array(*[F.lit(c) for c in ("soft", "medium", "hard", "soft", "intermediate")])
    laps = f.where(F.col("event_type") == "click").select(
        *keys,
        F.col("lap_no").alias("lap_number"),
        F.coalesce("last_end", F.lit(0)).alias("lap_start_time_ms"),
        F.col("t_ms").alias("lap_end_time_ms"),
        F.when(k % 43 != 0, F.col("t_ms") - F.coalesce("last_end", F.lit(0))).alias("lap_time_ms"),
        stint.alias("stint_number"),
        F.element_at(compounds, ((stint + F.col("driver_id")) % 5 + 1).cast("int")).alias("compound"),
        F.when(k % 25 != 0, (F.col("lap_no") - 1) % 8 + 1).cast("double").alias("tyre_life_laps"),
        (k % 19 == 0).alias("is_deleted"),
        F.when(k % 10 != 0, F.lit(False)).alias("is_generated"),
        (k % 17 != 0).alias("is_accurate"),
        F.when(k % 31 != 0, F.when(k % 12 == 0, "12").otherwise("1")).alias("raw_track_status"),
        (k % 4 + 1).alias("position"),
        "event_id",
    )
    weather = f.where(F.col("event_type") == "view").select(
        "session_id", F.col("t_ms").alias("session_time_ms"),
        F.col("value").alias("air_temperature_c"),
        F.when(k % 37 != 0, F.col("value") + 10).alias("track_temperature_c"),
        k.cast("double").alias("humidity_percent"),
        F.when(k % 41 != 0, k % 29 == 0).alias("rainfall"),
        "event_id",
    )
    kinds = F.array(F.lit("track_status"), F.lit("race_control_message"), F.lit("session_status"))
    states = F.create_map(
        *[F.lit(x) for x in (1, "clear", 2, "yellow", 4, "safety-car", 5, "red-flag", 6, "virtual-safety-car", 7, "vsc-ending")]
    )
    control = f.where(F.col("event_type") == "error").select(
        "session_id", F.col("t_ms").alias("session_time_ms"),
        F.element_at(kinds, (k % 3 + 1).cast("int")).alias("source_kind"),
        F.when(k % 20 == 0, " Started ").when(k == 77, "CHEQUERED flag").otherwise(F.concat(F.lit("note "), k.cast("string"))).alias("message"),
        F.coalesce(F.element_at(states, k % 8), F.lit("unknown")).alias("track_status"),
        F.when(k == 44, "Finalised").alias("raw_status"),
        F.when(k % 2 == 0, F.col("driver_id")).alias("driver_id"),
        "event_id",
    )
    statuses = f.where((F.col("event_type") == "error") & ((k % 33 == 0) | (k % 27 == 0) | (k % 25 == 0))).select(
        *keys, F.col("t_ms").alias("session_time_ms"),
        F.when(k % 33 == 0, "retired").when(k % 27 == 0, "in-pit").otherwise("active").alias("status"),
        "event_id",
    )
    marks = f.where(F.col("event_type").isin("purchase", "signup")).select(
        *keys, F.col("lap_no").alias("lap_number"), F.col("t_ms").alias("session_time_ms"),
        F.when(F.col("event_type") == "purchase", "in").otherwise("out").alias("kind"),
        "event_id",
    )
    positions = laps.select(
        *keys, F.col("lap_end_time_ms").alias("session_time_ms"), "position", "lap_number", "event_id"
    )
    return SimpleNamespace(
        feed=f, laps=laps, weather=weather, control=control, statuses=statuses, marks=marks, positions=positions
    )


TIMING_SQL = """
fb AS (SELECT CAST(us // 604800000000 AS INT) AS session_id, CAST(user_id % 20 AS INT) AS driver_id,
   (us % 604800000000 + 500) // 1000 AS t_ms, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM (SELECT *, epoch_us(ts) - 1704067200000000 AS us FROM events)),
feed AS (SELECT *, CAST(1 + coalesce(count(*) FILTER (event_type = 'click') OVER w, 0) AS INT) AS lap_no,
   max(CASE WHEN event_type = 'click' THEN t_ms END) OVER w AS last_end FROM fb
  WINDOW w AS (PARTITION BY session_id, driver_id ORDER BY t_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tl AS (SELECT session_id, driver_id, lap_no AS lap_number, coalesce(last_end, 0) AS lap_start_time_ms, t_ms AS lap_end_time_ms,
   CASE WHEN k % 43 <> 0 THEN t_ms - coalesce(last_end, 0) END AS lap_time_ms, CAST(1 + (lap_no - 1) // 8 AS INT) AS stint_number,
   (['soft','medium','hard','soft','intermediate'])[CAST((1 + (lap_no - 1) // 8 + driver_id) % 5 + 1 AS INT)] AS compound,
   CASE WHEN k % 25 <> 0 THEN CAST((lap_no - 1) % 8 + 1 AS DOUBLE) END AS tyre_life_laps, k % 19 = 0 AS is_deleted,
   CASE WHEN k % 10 <> 0 THEN false END AS is_generated, k % 17 <> 0 AS is_accurate,
   CASE WHEN k % 31 <> 0 THEN CASE WHEN k % 12 = 0 THEN '12' ELSE '1' END END AS raw_track_status, k % 4 + 1 AS position, event_id
  FROM feed WHERE event_type = 'click'),
tw AS (SELECT session_id, t_ms AS session_time_ms, value AS air_temperature_c, CASE WHEN k % 37 <> 0 THEN value + 10 END AS track_temperature_c,
   CAST(k AS DOUBLE) AS humidity_percent, CASE WHEN k % 41 <> 0 THEN k % 29 = 0 END AS rainfall, event_id FROM feed WHERE event_type = 'view'),
tc AS (SELECT session_id, t_ms AS session_time_ms, (['track_status','race_control_message','session_status'])[k % 3 + 1] AS source_kind,
   CASE WHEN k % 20 = 0 THEN ' Started ' WHEN k = 77 THEN 'CHEQUERED flag' ELSE 'note ' || k END AS message,
   CASE k % 8 WHEN 1 THEN 'clear' WHEN 2 THEN 'yellow' WHEN 4 THEN 'safety-car' WHEN 5 THEN 'red-flag' WHEN 6 THEN 'virtual-safety-car'
     WHEN 7 THEN 'vsc-ending' ELSE 'unknown' END AS track_status, CASE WHEN k = 44 THEN 'Finalised' END AS raw_status,
   CASE WHEN k % 2 = 0 THEN driver_id END AS driver_id, event_id FROM feed WHERE event_type = 'error'),
ts_ AS (SELECT session_id, driver_id, t_ms AS session_time_ms, CASE WHEN k % 33 = 0 THEN 'retired' WHEN k % 27 = 0 THEN 'in-pit' ELSE 'active' END AS status, event_id
  FROM feed WHERE event_type = 'error' AND (k % 33 = 0 OR k % 27 = 0 OR k % 25 = 0)),
tm AS (SELECT session_id, driver_id, lap_no AS lap_number, t_ms AS session_time_ms, CASE WHEN event_type = 'purchase' THEN 'in' ELSE 'out' END AS kind, event_id
  FROM feed WHERE event_type IN ('purchase','signup')),
tp AS (SELECT session_id, driver_id, lap_end_time_ms AS session_time_ms, position, lap_number, event_id FROM tl)"""
