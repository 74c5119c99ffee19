"""Timeline, pit, stint and replay queries over the event feed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapwing.operators import pits as PT
from lapwing.operators import replay as R
from lapwing.operators import timeline as T
from lapwing.plans.registry import query
from lapwing.plans.standin import DAY_MS, ROWS, TIMING_SQL, stored, timing
from lapwing.session import shared_path
from lapwing.streaming.replay_stream import late_rows, replay_stream

W_TIMING = "WITH RECURSIVE " + TIMING_SQL

PITS_SQL = """,
mk AS (SELECT *, CASE WHEN kind = 'in' THEN 0 ELSE 1 END AS kd, session_time_ms AS t,
   row_number() OVER (PARTITION BY session_id, driver_id ORDER BY session_time_ms, CASE WHEN kind = 'in' THEN 0 ELSE 1 END, lap_number, event_id) AS n FROM tm),
stk AS (SELECT DISTINCT session_id, driver_id, 0::BIGINT AS n, CAST([] AS STRUCT(t BIGINT, lap INT, id BIGINT)[]) AS stack,
   NULL::BIGINT AS pin, NULL::BIGINT AS pout, NULL::INT AS lap, NULL::BIGINT AS id FROM mk
 UNION ALL
 SELECT m.session_id, m.driver_id, m.n,
   CASE WHEN m.kd = 0 THEN list_append(s.stack, {'t': m.t, 'lap': m.lap_number, 'id': m.event_id})
     WHEN len(s.stack) > 0 AND m.lap_number - s.stack[-1].lap IN (0, 1) THEN s.stack[:len(s.stack) - 1] ELSE s.stack END,
   CASE WHEN m.kd = 1 AND len(s.stack) > 0 AND m.lap_number - s.stack[-1].lap IN (0, 1) THEN s.stack[-1].t END,
   CASE WHEN m.kd = 1 THEN m.t END,
   CASE WHEN m.kd = 1 AND len(s.stack) > 0 AND m.lap_number - s.stack[-1].lap IN (0, 1) THEN s.stack[-1].lap ELSE m.lap_number END,
   CASE WHEN m.kd = 1 AND len(s.stack) > 0 AND m.lap_number - s.stack[-1].lap IN (0, 1) THEN s.stack[-1].id ELSE m.event_id END
 FROM stk s JOIN mk m ON m.session_id = s.session_id AND m.driver_id = s.driver_id AND m.n = s.n + 1),
fin AS (SELECT session_id, driver_id, unnest(stack) AS e FROM stk QUALIFY n = max(n) OVER (PARTITION BY session_id, driver_id)),
st0 AS (SELECT session_id, driver_id, lap, pin, pout, id FROM stk WHERE pout IS NOT NULL
  UNION ALL SELECT session_id, driver_id, e.lap, e.t, NULL, e.id FROM fin),
tpit AS (SELECT session_id, driver_id, CAST(row_number() OVER (PARTITION BY session_id, driver_id ORDER BY coalesce(pin, pout), lap, id) AS INT) AS stop_number,
  lap AS lap_number, pin AS pit_in_time_ms, pout AS pit_out_time_ms, pout - pin AS pit_lane_duration_ms FROM st0),
tst AS (SELECT session_id, driver_id, stint_number, min(lap_number) AS start_lap, max(lap_number) AS end_lap,
  first(lap_start_time_ms ORDER BY lap_number) AS start_time_ms, last(lap_end_time_ms ORDER BY lap_number) AS end_time_ms,
  min(compound) AS compound, count(DISTINCT compound) > 1 AS conflicting_compound,
  first(tyre_life_laps ORDER BY lap_number) AS tyre_life_start_laps, last(tyre_life_laps ORDER BY lap_number) AS tyre_life_end_laps
  FROM tl GROUP BY 1, 2, 3)"""

EVENTS_SQL = PITS_SQL + """,
chg AS (SELECT * FROM (SELECT *, lag(track_status) OVER (PARTITION BY session_id ORDER BY session_time_ms, event_id) AS p FROM tc WHERE track_status <> 'unknown')
  WHERE p IS NULL OR p <> track_status),
cand AS (
  SELECT DISTINCT session_id, 0::BIGINT AS session_time_ms, 0 AS priority, 'session-marker' AS event_type, NULL::INT AS driver_id, 'session-origin' AS source_key FROM fb WHERE event_type IN ('click','view','error')
  UNION ALL SELECT session_id, session_time_ms, 20, 'weather-observed', NULL, 'weather-' || session_time_ms || '-' || event_id FROM tw
  UNION ALL SELECT session_id, session_time_ms, 30, 'race-control-event', driver_id, 'control-' || session_time_ms || '-' || event_id FROM tc
  UNION ALL SELECT session_id, session_time_ms, 10, 'track-status-changed', NULL, 'control-' || session_time_ms || '-' || event_id || '-track-status' FROM chg
  UNION ALL SELECT session_id, start_time_ms, 40, 'driver-stint-changed', driver_id, 'stint-' || driver_id || '-' || stint_number FROM tst WHERE start_time_ms IS NOT NULL
  UNION ALL SELECT session_id, pit_in_time_ms, 50, 'driver-pit-entered', driver_id, 'pit-' || driver_id || '-' || stop_number || '-in' FROM tpit WHERE pit_in_time_ms IS NOT NULL
  UNION ALL SELECT session_id, pit_out_time_ms, 80, 'driver-pit-exited', driver_id, 'pit-' || driver_id || '-' || stop_number || '-out' FROM tpit WHERE pit_out_time_ms IS NOT NULL
  UNION ALL SELECT session_id, session_time_ms, 60, 'driver-position-changed', driver_id, 'position-' || driver_id || '-' || session_time_ms FROM tp
  UNION ALL SELECT session_id, lap_end_time_ms, 70, 'driver-lap-completed', driver_id, 'lap-' || driver_id || '-' || lap_number FROM tl WHERE NOT is_deleted),
evt AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY session_time_ms, priority, event_type, coalesce(CAST(driver_id AS VARCHAR), ''), source_key) - 1 AS sequence FROM cand),
lead_ AS (SELECT session_id, lap_number, min((session_time_ms, CAST(driver_id AS VARCHAR), driver_id)) AS x FROM tp WHERE position = 1 GROUP BY 1, 2),
cur AS (SELECT l.session_id, l.lap_number, l.x[3] AS driver_id, l.x[1] AS end_time_ms, tl.lap_start_time_ms AS start_time_ms
  FROM lead_ l JOIN tl ON tl.session_id = l.session_id AND tl.lap_number = l.lap_number AND tl.driver_id = l.x[3]
  WHERE tl.lap_start_time_ms IS NOT NULL AND l.x[1] >= tl.lap_start_time_ms)"""

# Cursor instants: the whole feed's end and four instants per session.
CURSOR_SQL = """,
crs AS (SELECT session_id, unnest([1, 100000000, 250000000, 400000000, 604800000])::BIGINT AS cursor_ms FROM (SELECT DISTINCT session_id FROM fb))"""
CURSORS = (1, 100_000_000, 250_000_000, 400_000_000, 604_800_000)


def log(spark, folder):
    """Timing tables, stops, stints, and the numbered timeline."""
    v = canonical(spark, folder)
    v.events = stored(spark, folder, "events", lambda: T.build_timeline(all_candidates(v), ROWS))
    return v


def canonical(spark, folder):
    v = timing(spark, folder)
    v.pits = stored(spark, folder, "pits", lambda: PT.pair_pits(v.marks, rows=ROWS))
    v.stints = PT.derive_stints(v.laps)
    return v


def all_candidates(v):
    return T.candidates(v.laps, v.stints, v.pits, v.positions, v.weather, v.control, ROWS)


def cursors(v):
    return v.feed.select("session_id").distinct().withColumn(
        "cursor_ms", F.explode(F.array(*[F.lit(c).cast("long") for c in CURSORS]))
    )


@query("pit_stops", W_TIMING + PITS_SQL + " SELECT * FROM tpit")
def pit_stops(spark, folder):
    return PT.pair_pits(timing(spark, folder).marks, rows=ROWS)


@query("stints", W_TIMING + PITS_SQL + " SELECT * FROM tst")
def stints(spark, folder):
    return PT.derive_stints(timing(spark, folder).laps)


@query("track_status_changes", W_TIMING + EVENTS_SQL + " SELECT session_id, session_time_ms, event_id, track_status FROM chg")
def track_status_changes(spark, folder):
    return T.status_changes(timing(spark, folder).control, ROWS).select(
        "session_id", "session_time_ms", "event_id", "track_status"
    )


@query("timeline", W_TIMING + EVENTS_SQL + " SELECT * FROM evt")
def timeline(spark, folder):
    return T.build_timeline(all_candidates(canonical(spark, folder)), ROWS).select(
        "session_id", "session_time_ms", "priority", "event_type", "driver_id", "source_key", "sequence"
    )


@query("timeline_window", W_TIMING + EVENTS_SQL + """
SELECT session_id, session_time_ms, event_type, source_key FROM cand
WHERE session_time_ms BETWEEN 100000000 AND 300000000 AND event_type IN ('driver-pit-entered', 'driver-stint-changed')""")
def timeline_window(spark, folder):
    events = all_candidates(canonical(spark, folder))
    out = T.timeline_slice(events, 100_000_000, 300_000_000, ["driver-pit-entered", "driver-stint-changed"])
    return out.select("session_id", "session_time_ms", "event_type", "source_key")


@query("significant_events", W_TIMING + EVENTS_SQL + """
SELECT c.session_id, c.event_type, count(*) AS events FROM cand c LEFT JOIN tw w ON c.event_type = 'weather-observed' AND w.session_id = c.session_id
  AND c.source_key = 'weather-' || w.session_time_ms || '-' || w.event_id
WHERE c.event_type NOT IN ('driver-position-changed','driver-lap-completed','session-marker') AND (c.event_type <> 'weather-observed' OR w.rainfall)
GROUP BY ALL""")
def significant_events(spark, folder):
    events = all_candidates(canonical(spark, folder))
    return T.significant(events).groupBy("session_id", "event_type").agg(F.count(F.lit(1)).alias("events"))


@query("leader_laps", W_TIMING + " SELECT session_id, lap_number, min(session_time_ms) AS session_time_ms FROM tp WHERE position = 1 GROUP BY 1, 2")
def leader_laps(spark, folder):
    return T.leader_laps(timing(spark, folder).positions)


@query("lap_cursors", W_TIMING + EVENTS_SQL + " SELECT * FROM cur")
def lap_cursors(spark, folder):
    v = timing(spark, folder)
    return T.lap_cursors(v.positions, v.laps)


STATE_SQL = EVENTS_SQL + """,
allev AS (
  SELECT c.session_id, c.session_time_ms, c.priority, c.event_type, c.driver_id, c.source_key,
    l.lap_number, l.lap_time_ms, coalesce(l.stint_number, s.stint_number) AS stint_number, coalesce(l.compound, s.compound) AS compound,
    CASE WHEN c.event_type = 'driver-stint-changed' THEN s.tyre_life_start_laps ELSE l.tyre_life_laps END AS tyre_age_laps,
    p.position, pi.lap_number AS pit_lap, NULL::VARCHAR AS status
  FROM cand c
  LEFT JOIN tl l ON c.event_type = 'driver-lap-completed' AND l.session_id = c.session_id AND l.driver_id = c.driver_id AND c.source_key = 'lap-' || l.driver_id || '-' || l.lap_number
  LEFT JOIN tst s ON c.event_type = 'driver-stint-changed' AND s.session_id = c.session_id AND s.driver_id = c.driver_id AND c.source_key = 'stint-' || s.driver_id || '-' || s.stint_number
  LEFT JOIN tp p ON c.event_type = 'driver-position-changed' AND p.session_id = c.session_id AND p.driver_id = c.driver_id AND p.session_time_ms = c.session_time_ms
  LEFT JOIN tpit pi ON c.event_type = 'driver-pit-entered' AND pi.session_id = c.session_id AND pi.driver_id = c.driver_id AND c.source_key = 'pit-' || pi.driver_id || '-' || pi.stop_number || '-in'
  WHERE c.driver_id IS NOT NULL
  UNION ALL SELECT session_id, session_time_ms, 90, 'driver-status-changed', driver_id, 'status-' || driver_id || '-' || session_time_ms || '-' || event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, status FROM ts_),
ord AS (SELECT *, row_number() OVER (PARTITION BY session_id, driver_id ORDER BY session_time_ms, priority, event_type, source_key) AS n FROM allev),
st AS (SELECT DISTINCT session_id, driver_id, 0::BIGINT AS n, -1::BIGINT AS t, NULL::INT AS position, 0 AS laps, NULL::BIGINT AS last_lap, NULL::INT AS stint, NULL::VARCHAR AS compound,
   NULL::DOUBLE AS age, false AS in_pit, 0::BIGINT AS stops, NULL::INT AS pit_lap, 'not-started' AS status FROM fb
 UNION ALL
 SELECT s.session_id, s.driver_id, o.n, o.session_time_ms, CASE WHEN o.event_type = 'driver-position-changed' THEN o.position ELSE s.position END,
   CASE WHEN o.event_type = 'driver-lap-completed' THEN greatest(s.laps, o.lap_number) ELSE s.laps END,
   CASE WHEN o.event_type = 'driver-lap-completed' THEN o.lap_time_ms ELSE s.last_lap END,
   coalesce(CASE WHEN o.event_type IN ('driver-lap-completed','driver-stint-changed') THEN o.stint_number END, s.stint),
   coalesce(CASE WHEN o.event_type IN ('driver-lap-completed','driver-stint-changed') THEN o.compound END, s.compound),
   CASE WHEN o.event_type = 'driver-stint-changed' THEN o.tyre_age_laps WHEN o.event_type = 'driver-lap-completed' THEN coalesce(o.tyre_age_laps, s.age) ELSE s.age END,
   CASE WHEN o.event_type = 'driver-pit-entered' AND s.status <> 'retired' THEN true WHEN o.event_type = 'driver-pit-exited' THEN false
     WHEN o.event_type = 'driver-status-changed' AND s.status <> 'retired' THEN o.status = 'in-pit' ELSE s.in_pit END,
   CASE WHEN o.event_type = 'driver-pit-entered' AND s.status <> 'retired' AND NOT s.in_pit THEN s.stops + 1 ELSE s.stops END,
   CASE WHEN o.event_type = 'driver-pit-entered' AND s.status <> 'retired' THEN o.pit_lap ELSE s.pit_lap END,
   CASE WHEN s.status = 'retired' THEN s.status WHEN o.event_type = 'driver-pit-entered' THEN 'in-pit' WHEN o.event_type = 'driver-status-changed' THEN o.status
     WHEN o.event_type = 'driver-pit-exited' THEN 'active' WHEN o.event_type IN ('driver-position-changed','driver-lap-completed','driver-stint-changed') AND NOT s.in_pit THEN 'active' ELSE s.status END
 FROM st s JOIN ord o ON o.session_id = s.session_id AND o.driver_id = s.driver_id AND o.n = s.n + 1)"""

STATE_OUT = """ SELECT c.session_id, st.driver_id, c.cursor_ms, position, laps AS laps_completed, last_lap AS last_lap_time_ms, stint AS current_stint, compound,
  age AS tyre_age_laps, in_pit, stops AS pit_stop_count, pit_lap AS last_pit_lap, status
  FROM crs c JOIN st ON st.session_id = c.session_id AND st.t <= c.cursor_ms
  QUALIFY row_number() OVER (PARTITION BY c.session_id, st.driver_id, c.cursor_ms ORDER BY st.n DESC) = 1"""


def full_log(spark, folder):
    """Timeline including the supplied driver status events."""
    v = canonical(spark, folder)
    v.events = stored(
        spark, folder, "full_events",
        lambda: T.build_timeline(
            all_candidates(v).unionByName(T.status_events(v.statuses), allowMissingColumns=True), ROWS
        ),
    )
    v.roster = v.feed.select("session_id", "driver_id").distinct()
    return v


@query("driver_states", W_TIMING + STATE_SQL + CURSOR_SQL + STATE_OUT)
def driver_states(spark, folder):
    v = full_log(spark, folder)
    return R.driver_states(v.events, v.roster, cursors(v), ROWS)


STREAM_EVENT = (
    "session_time_ms long, priority int, sequence long, event_type string, position int, lap_number int, lap_time_ms long, "
    "stint_number int, compound string, tyre_age_laps double, status string"
)


@query("streamed_states", W_TIMING + STATE_SQL + """ SELECT session_id, driver_id, t AS applied_to_ms, position, laps AS laps_completed, last_lap AS last_lap_time_ms, stint AS current_stint,
  compound, age AS tyre_age_laps, in_pit, stops AS pit_stop_count, pit_lap AS last_pit_lap, status, 0 AS late_rows FROM st WHERE n > 0
  QUALIFY row_number() OVER (PARTITION BY session_id, driver_id ORDER BY n DESC) = 1""")
def streamed_states(spark, folder):
    """The log as a stream of files in no order; a marker after the allowed delay passes the watermark over all events."""
    schema = StructType.fromDDL(f"session_id int, driver_id int, {STREAM_EVENT}")
    kinds = {f.name: f.dataType for f in schema.fields}
    log_rows = full_log(spark, folder).events.where(F.col("driver_id").isNotNull())
    rows = log_rows.select(*[F.col(n).cast(t).alias(n) for n, t in kinds.items()])
    end = rows.agg((F.max("session_time_ms") + 10 * DAY_MS).alias("session_time_ms"))
    given = {"session_id": -1, "driver_id": -1, "priority": 0, "sequence": 0}
    marker = end.select(
        *[F.col(n) if n == "session_time_ms" else F.lit(given.get(n)).cast(t).alias(n) for n, t in kinds.items()]
    )
    root = shared_path(spark, "stream")
    # Files hold events of all times: what one brings lies before most of what the others brought.
    rows.repartition(6, F.hash("sequence", "session_time_ms")).write.parquet(f"{root}/log")
    marker.coalesce(1).write.mode("append").parquet(f"{root}/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/log")
    run = (
        replay_stream(stream, "9 days").writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/states").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    states = spark.read.parquet(f"{root}/states").where("session_id >= 0")
    newest = states.groupBy("session_id", "driver_id").agg(F.max_by(F.struct(*states.columns[2:]), "applied_to_ms").alias("s"))
    return newest.select("session_id", "driver_id", "s.*", F.lit(late_rows(run)).cast("int").alias("late_rows"))


@query("driver_states_at_laps", W_TIMING + STATE_SQL + """, crs AS (SELECT session_id, start_time_ms AS cursor_ms FROM cur WHERE start_time_ms IS NOT NULL UNION SELECT session_id, end_time_ms FROM cur WHERE end_time_ms IS NOT NULL)""" + STATE_OUT)
def driver_states_at_laps(spark, folder):
    v = full_log(spark, folder)
    laps = T.lap_cursors(v.positions, v.laps)
    points = R.lap_cursor_points(laps, "start").unionByName(R.lap_cursor_points(laps, "end"))
    both = points.where(F.col("cursor_ms").isNotNull()).select("session_id", "cursor_ms").distinct()
    return R.driver_states(v.events, v.roster, both, ROWS)


@query("session_states", W_TIMING + EVENTS_SQL + CURSOR_SQL + """
SELECT c.session_id, c.cursor_ms, coalesce((SELECT arg_max(track_status, (session_time_ms, event_id)) FROM chg WHERE chg.session_id = c.session_id AND chg.session_time_ms <= c.cursor_ms), 'unknown') AS track_status,
  w.w.session_time_ms AS observed_at_ms, w.w.air_temperature_c, w.w.track_temperature_c, w.w.humidity_percent, w.w.rainfall,
  (SELECT max(lap_number) FROM cur WHERE cur.session_id = c.session_id AND cur.end_time_ms <= c.cursor_ms) AS reference_lap
FROM crs c LEFT JOIN (SELECT crs.session_id, crs.cursor_ms, arg_max(tw, (tw.session_time_ms, 'weather-' || tw.session_time_ms || '-' || tw.event_id)) AS w FROM crs JOIN tw ON tw.session_id = crs.session_id AND tw.session_time_ms <= crs.cursor_ms GROUP BY 1, 2) w
  USING (session_id, cursor_ms)""")
def session_states(spark, folder):
    v = log(spark, folder)
    return R.session_states(v.events, cursors(v), T.lap_cursors(v.positions, v.laps), ROWS)


@query("recent_messages", W_TIMING + EVENTS_SQL + CURSOR_SQL + """
SELECT c.session_id, c.cursor_ms, CAST(row_number() OVER (PARTITION BY c.session_id, c.cursor_ms ORDER BY e.sequence DESC) AS INT) AS recency, e.session_time_ms AS observed_at_ms, tc.message
FROM crs c JOIN evt e ON e.session_id = c.session_id AND e.event_type = 'race-control-event' AND e.session_time_ms <= c.cursor_ms
JOIN tc ON tc.session_id = e.session_id AND e.source_key = 'control-' || tc.session_time_ms || '-' || tc.event_id QUALIFY recency <= 20""")
def recent_messages(spark, folder):
    v = log(spark, folder)
    return R.recent_messages(v.events, cursors(v), 20, ROWS)


@query("finished_sessions", W_TIMING + CURSOR_SQL + """
SELECT c.session_id, c.cursor_ms, f.t AS finished_at_ms, coalesce(f.t <= c.cursor_ms, false) AS finished FROM crs c LEFT JOIN (
  SELECT session_id, min(session_time_ms) AS t FROM tc WHERE contains(lower(message), 'chequered') OR (source_kind = 'session_status' AND lower(raw_status) IN ('finished','finalised','finalized','ends','ended')) GROUP BY 1) f USING (session_id)""")
def finished_sessions(spark, folder):
    v = timing(spark, folder)
    return R.finished_at(v.control, cursors(v))


def track(v):
    """Positions drawn from the feed: two coordinates per event."""
    return v.feed.select(
        "session_id", "driver_id", F.col("t_ms").alias("session_time_ms"),
        F.when(F.col("k") % 21 != 0, F.col("value") * 1000).alias("x_m"), (F.col("k") * 100.0).alias("y_m"), "event_id",
    )


@query("latest_positions", W_TIMING + CURSOR_SQL + """,
tk AS (SELECT session_id, driver_id, t_ms, value * 1000 AS x, k * 100.0::DOUBLE AS y FROM feed WHERE k % 21 <> 0),
nr AS (SELECT c.session_id, c.cursor_ms, driver_id, t_ms, x, y, row_number() OVER (PARTITION BY c.session_id, c.cursor_ms, driver_id ORDER BY t_ms, x, y) AS n
  FROM crs c JOIN tk ON tk.session_id = c.session_id AND t_ms <= cursor_ms AND cursor_ms - t_ms <= 100000000),
ft AS (SELECT * FROM nr WHERE n = 1 UNION ALL
  SELECT r.session_id, r.cursor_ms, r.driver_id, CASE WHEN jump THEN f.t_ms ELSE r.t_ms END, CASE WHEN jump THEN f.x ELSE r.x END, CASE WHEN jump THEN f.y ELSE r.y END, r.n
  FROM (SELECT f AS f, r AS r, r.t_ms > f.t_ms AND sqrt(pow(r.x - f.x, 2) + pow(r.y - f.y, 2)) / ((r.t_ms - f.t_ms) / 1000.0::DOUBLE) > 2 AS jump
    FROM ft f JOIN nr r ON r.session_id = f.session_id AND r.cursor_ms = f.cursor_ms AND r.driver_id = f.driver_id AND r.n = f.n + 1))
SELECT session_id, cursor_ms, driver_id, t_ms AS session_time_ms, x AS x_m, y AS y_m FROM ft
QUALIFY row_number() OVER (PARTITION BY session_id, cursor_ms, driver_id ORDER BY n DESC) = 1""")
def latest_positions(spark, folder):
    v = timing(spark, folder)
    return R.latest_positions(track(v), cursors(v), stale_ms=100_000_000, max_speed=2.0)


@query("longest_traces", W_TIMING + """
SELECT session_id, driver_id, samples FROM (SELECT session_id, driver_id, count(*) AS samples FROM feed WHERE k % 21 <> 0 GROUP BY 1, 2)
WHERE samples >= 2 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY samples DESC, CAST(driver_id AS VARCHAR)) = 1""")
def longest_traces(spark, folder):
    return R.longest_trace(track(timing(spark, folder)))


@query("viewport_positions", W_TIMING + """,
tk AS (SELECT session_id, event_id, value * 1000 AS x, k * 100.0::DOUBLE AS y FROM feed WHERE k % 21 <> 0),
b AS (SELECT session_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM tk GROUP BY 1),
s AS (SELECT *, least((720 - 84) / (x1 - x0), (460 - 84) / (y1 - y0)) AS sc FROM b WHERE x1 > x0 AND y1 > y0)
SELECT session_id, event_id, round((720 - (x1 - x0) * sc) / 2 + (x - x0) * sc, 6) AS px, round(460 - ((460 - (y1 - y0) * sc) / 2 + (y - y0) * sc), 6) AS py FROM tk JOIN s USING (session_id)""")
def viewport_positions(spark, folder):
    points = track(timing(spark, folder)).where(F.col("x_m").isNotNull())
    return R.viewport(points).select("session_id", "event_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query("event_log_issues", W_TIMING + """,
lg AS (SELECT session_id, t_ms AS session_time_ms, event_id, row_number() OVER (PARTITION BY session_id ORDER BY t_ms, event_id) - 1 + CASE WHEN k = 13 THEN 1 ELSE 0 END AS sequence FROM feed)
SELECT session_id, event_id, sequence, issue FROM (SELECT *, CASE WHEN sequence <> row_number() OVER w - 1 THEN 'noncontiguous-sequence'
  WHEN session_time_ms < lag(session_time_ms) OVER w THEN 'time-moved-backward' END AS issue FROM lg WINDOW w AS (PARTITION BY session_id ORDER BY sequence, session_time_ms)) WHERE issue IS NOT NULL""")
def event_log_issues(spark, folder):
    from lapwing.operators.scan import position, scan, series

    f = timing(spark, folder).feed
    stored = scan(f, series(("session_id",), ("t_ms", "event_id"), ROWS), n=position()).select(
        "session_id", F.col("t_ms").alias("session_time_ms"), "event_id",
        (F.col("n") - 1 + F.when(F.col("k") == 13, 1).otherwise(0)).alias("sequence"),
    )
    return T.sequence_issues(stored, ROWS).select("session_id", "event_id", "sequence", "issue")
