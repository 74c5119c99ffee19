"""Source parsing and scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions import channels as CH
from lapwing.functions import values as V
from lapwing.functions import vocab as VB
from lapwing.operators import normalize as N
from lapwing.operators import timeline as T
from lapwing.plans.registry import ORACLES, query, sql_round
from lapwing.plans.standin import ROWS, TIMING_SQL, feed, table
from lapwing.session import shared_path
from lapwing.sources import dump, feeds, lossless, tables

W_FEED = "WITH " + TIMING_SQL


def dump_tables(spark, folder):
    """The star tables expressed as a relational dump of text columns."""
    t = {n: table(spark, folder, n) for n in ("orders", "customer", "supplier", "nation", "lineitem")}
    c = F.col
    text = lambda x: x.cast("string")
    items = t["lineitem"].withColumn(
        "pk", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )
    first = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    # Dealt first: the smallest struct is found by sorting, here shuffled parts and not whole files.
    entry = (
        items.select("l_orderkey", "l_suppkey", first.alias("i")).repartition("l_orderkey", "l_suppkey")
        .groupBy("l_orderkey", "l_suppkey").agg(F.min("i").alias("i"))
        .withColumn("pk", F.concat_ws("-", "l_orderkey", "l_suppkey"))
    )
    years = t["orders"].select(F.year("o_orderdate").alias("y")).distinct()
    return {
        "season": years.select(text(c("y") + 7000).alias("id"), text(c("y")).alias("year")),
        "round": t["orders"].join(t["customer"], c("o_custkey") == c("c_custkey")).select(
            text(c("o_orderkey")).alias("id"), text(F.year("o_orderdate") + 7000).alias("season_id"),
            F.when(c("c_nationkey") != 3, text(c("c_nationkey"))).alias("circuit_id"),
            F.when(c("o_orderkey") % 50 != 0, F.concat(text(F.month("o_orderdate")), F.lit(".0"))).alias("number"),
            F.lit("Race").alias("name"), c("o_orderdate").cast("date").alias("date"),
        ),
        "circuit": t["nation"].select(text(c("n_nationkey")).alias("id"), c("n_name").alias("name"), F.lower("n_name").alias("reference")),
        "session": t["orders"].select(
            text(c("o_orderkey")).alias("id"), text(c("o_orderkey")).alias("round_id"),
            F.when(c("o_orderstatus") == "O", "Q").otherwise("R").alias("type"),
        ),
        "driver": t["supplier"].select(
            text(c("s_suppkey")).alias("id"), c("s_name").alias("reference"), F.lit(None).cast("string").alias("abbreviation"),
            F.lit(" Supplier ").alias("forename"), text(c("s_suppkey")).alias("surname"),
        ),
        "team": t["nation"].select(text(c("n_nationkey")).alias("id"), F.lower("n_name").alias("reference"), c("n_name").alias("name")),
        "team_driver": t["supplier"].select(
            text(c("s_suppkey")).alias("id"), text(c("s_suppkey")).alias("driver_id"), text(c("s_nationkey")).alias("team_id")
        ),
        "round_entry": entry.select(c("pk").alias("id"), text(c("l_suppkey")).alias("team_driver_id"), text(c("l_suppkey") % 99).alias("car_number")),
        "session_entry": entry.select(
            c("pk").alias("id"), text(c("l_orderkey")).alias("session_id"), c("pk").alias("round_entry_id"),
            F.concat(text(c("i.l_partkey") % 20), F.lit(".0")).alias("grid"), text(c("i.l_linenumber")).alias("position"),
            text(c("i.l_quantity")).alias("points"), text(c("i.l_quantity").cast("int")).alias("laps_completed"),
            F.when(c("i.l_discount") > 0.05, "Engine").alias("detail"), F.lit("Finished").alias("status"),
            F.when(c("i.l_returnflag") == "A", "t").when(c("i.l_returnflag") == "N", "false").alias("is_classified"),
            F.concat(F.lit("1:02:"), F.lpad(text(c("i.l_quantity").cast("int")), 2, "0"), F.lit(".250")).alias("time"),
        ),
        "lap": items.select(
            c("pk").alias("id"), F.concat_ws("-", "l_orderkey", "l_suppkey").alias("session_entry_id"), text(c("l_linenumber")).alias("number"),
            text(c("l_partkey") % 20 + 1).alias("position"), F.concat(F.lit("1:"), F.lpad(text(c("l_quantity").cast("int")), 2, "0"), F.lit(".5")).alias("time"),
            text(c("l_discount")).alias("average_speed"), F.when(c("l_tax") == 0, "True").alias("is_entry_fastest_lap"),
        ),
        "pit_stop": items.where(c("l_returnflag") == "R").select(
            F.concat_ws("-", "l_orderkey", "l_suppkey").alias("session_entry_id"), text(c("l_linenumber")).alias("number"), c("pk").alias("lap_id"),
            F.when(c("l_tax") != 0, text(c("l_quantity"))).alias("duration"), F.lit(" 12:00:00 ").alias("local_timestamp"),
        ),
    }


DUMP_SQL = """
WITH evd AS (SELECT o_orderkey, 'archive-' || year(o_orderdate) || '-round-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-race' AS session_id, year(o_orderdate) AS season, n_name AS circuit_name
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND c_nationkey <> 3 WHERE o_orderstatus <> 'O' AND o_orderkey % 50 <> 0 AND year(o_orderdate) BETWEEN 1996 AND 1999),
ent AS (SELECT l_orderkey, l_suppkey, arg_min(lineitem, (l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_returnflag)) AS i FROM lineitem GROUP BY 1, 2)"""


@query("dump_results", DUMP_SQL + """
SELECT session_id, s_name AS driver_id, 'Supplier ' || l_suppkey AS driver_name, n_name AS team_name, CAST(l_suppkey % 99 AS INT) AS car_number, CAST(i.l_partkey % 20 AS INT) AS grid_position, i.l_linenumber AS finish_position, i.l_quantity AS points,
  CASE WHEN i.l_discount > 0.05::DOUBLE THEN 'Engine' ELSE 'Finished' END AS status, CASE i.l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS classified, 3720250 + CAST(i.l_quantity AS BIGINT) * 1000 AS total_time_ms
FROM evd JOIN ent ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def dump_results(spark, folder):
    _, results, _, _ = dump.archive_tables(dump_tables(spark, folder), 1996, 1999)
    return results.select(
        "session_id", "driver_id", "driver_name", "team_name", "car_number", "grid_position", "finish_position", "points",
        "status", "classified", "total_time_ms",
    )


@query("dump_laps", DUMP_SQL + """
SELECT session_id, s_name AS driver_id, l_linenumber AS lap_number, CAST(l_partkey % 20 + 1 AS INT) AS position, 60500 + CAST(l_quantity AS BIGINT) * 1000 AS lap_time_ms, l_discount AS average_speed_kph, CASE WHEN l_tax = 0 THEN true END AS is_fastest_lap
FROM evd JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey""")
def dump_laps(spark, folder):
    return dump.archive_tables(dump_tables(spark, folder), 1996, 1999)[2]


@query("csv_dump_laps", ORACLES["dump_laps"])
def csv_dump_laps(spark, folder):
    """The laps again, from CSV files; as text they are several times the tables, so they are compressed."""
    root = shared_path(spark, "dump")
    for name, rows in dump_tables(spark, folder).items():
        rows.write.option("header", True).option("compression", "gzip").csv(f"{root}/{dump.FILES[name]}")
    return dump.load_dump(spark, root, 1996, 1999)[2]


@query("dump_pit_stops", DUMP_SQL + """
SELECT session_id, s_name AS driver_id, l_linenumber AS stop_number, l_linenumber AS lap_number, CASE WHEN l_tax <> 0 THEN CAST(l_quantity AS BIGINT) * 1000 END AS duration_ms, '12:00:00' AS local_time
FROM evd JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' JOIN supplier ON s_suppkey = l_suppkey""")
def dump_pit_stops(spark, folder):
    return dump.archive_tables(dump_tables(spark, folder), 1996, 1999)[3]


@query("dump_events", DUMP_SQL + " SELECT session_id, season, circuit_name FROM evd")
def dump_events(spark, folder):
    return dump.archive_tables(dump_tables(spark, folder), 1996, 1999)[0].select("session_id", "season", "circuit_name")


@query("flattened_results", """
SELECT l_orderkey AS session_id, 'd' || l_suppkey AS driver_id, 'G F' || l_suppkey AS driver_name, CASE WHEN l_tax <> 0 THEN 't' || l_linenumber END AS team_id, CAST(l_partkey % 20 AS INT) AS grid_position, l_linenumber AS finish_position,
  l_quantity AS points, l_returnflag = 'A' AS classified, CASE WHEN l_discount <> 0 THEN l_partkey END AS total_time_ms FROM lineitem""")
def flattened_results(spark, folder):
    c = F.col
    text = lambda x: x.cast("string")
    row = F.struct(
        F.struct(F.concat(F.lit("d"), text(c("l_suppkey"))).alias("driverId"), F.lit("G").alias("givenName"), F.concat(F.lit("F"), text(c("l_suppkey"))).alias("familyName")).alias("Driver"),
        F.struct(F.when(c("l_tax") != 0, F.concat(F.lit("t"), text(c("l_linenumber")))).alias("constructorId"), F.lit(" ").alias("name")).alias("Constructor"),
        text(c("l_partkey") % 20).alias("grid"), text(c("l_linenumber")).alias("position"),
        F.when(c("l_returnflag") == "A", text(c("l_linenumber"))).otherwise("R").alias("positionText"),
        text(c("l_quantity")).alias("points"),
        F.when(c("l_discount") != 0, F.struct(text(c("l_partkey")).alias("millis"))).alias("Time"),
    )
    pages = table(spark, folder, "lineitem").select(
        c("l_orderkey").alias("session_id"), F.to_json(F.struct(F.array(row).alias("Results"))).alias("payload")
    )
    return feeds.flatten_results(pages).select(
        "session_id", "driver_id", "driver_name", "team_id", "grid_position", "finish_position", "points", "classified", "total_time_ms"
    )


@query("flattened_laps", W_FEED + """
SELECT session_id, 'd' || driver_id AS driver_id, k % 12 AS lap_number, CAST(arg_max(k % 20, event_id) AS INT) AS position, arg_max(60000 + (k % 60) * 1000 + 125, event_id)::BIGINT AS lap_time_ms FROM feed WHERE event_type = 'click' GROUP BY ALL""")
def flattened_laps(spark, folder):
    k = F.col("k")
    timing = F.struct(
        F.concat(F.lit("d"), F.col("driver_id").cast("string")).alias("driverId"), (k % 20).cast("string").alias("position"),
        F.concat(F.lit("1:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(".125")).alias("time"),
    )
    pages = feed(spark, folder).where(F.col("event_type") == "click").select(
        "session_id", F.col("event_id").alias("page"),
        F.to_json(F.struct(F.array(F.struct((k % 12).cast("string").alias("number"), F.array(timing).alias("Timings"))).alias("Laps"))).alias("payload"),
    )
    return feeds.flatten_laps(pages)


@query("flattened_pit_stops", W_FEED + """
SELECT session_id, 'd' || driver_id AS driver_id, k % 5 AS stop_number, CAST(arg_max(k, event_id) AS INT) AS lap_number, arg_max(CASE WHEN k % 7 <> 0 THEN 20000 + (k % 10) * 100 END, event_id) IS NULL AS untimed FROM feed WHERE event_type = 'signup' GROUP BY ALL""".replace(
    "arg_max(CASE WHEN k % 7 <> 0 THEN 20000 + (k % 10) * 100 END, event_id) IS NULL", "arg_max(k % 7 = 0, event_id)"))
def flattened_pit_stops(spark, folder):
    k = F.col("k")
    stop = F.struct(
        F.concat(F.lit("d"), F.col("driver_id").cast("string")).alias("driverId"), (k % 5).cast("string").alias("stop"), k.cast("string").alias("lap"),
        F.when(k % 7 != 0, F.concat(F.lit("20."), (k % 10).cast("string"))).otherwise("garbled").alias("duration"),
    )
    pages = feed(spark, folder).where(F.col("event_type") == "signup").select(
        "session_id", F.col("event_id").alias("page"), F.to_json(F.struct(F.array(stop).alias("PitStops"))).alias("payload")
    )
    return feeds.flatten_pits(pages).select("session_id", "driver_id", "stop_number", "lap_number", F.col("duration_ms").isNull().alias("untimed"))


def schedule_rows(spark, folder):
    c = F.col
    text = lambda x: x.cast("string")
    k = c("o_orderkey")
    fields = {
        "round_number": text(k % 25), "country": F.lit("X"), "location": F.concat(F.lit("L"), text(k % 7)), "event_name": F.concat(F.lit("E"), text(k)),
        "gmt_offset": F.when(k % 3 == 0, "-05:30").when(k % 3 == 1, "+02:00"),
        "session1": F.lit("Practice 1"), "session2": F.when(k % 2 == 0, "Sprint_Qualifying").otherwise("Qualifying"), "session3": F.lit("  "),
        "session4": F.lit("Warmup"), "session5": F.lit("Race"),
    }
    for n in (1, 2, 3, 4, 5):
        fields[f"session{n}_date"] = F.when(k % 6 != n, F.concat(text(c("o_orderdate").cast("date")), F.lit(f"T0{n}:00:00")))
    years = table(spark, folder, "orders").select(
        (F.year("o_orderdate") + 24).alias("season"), k.alias("source_id"),
        F.to_json(F.struct(*[F.create_map(F.lit("0"), v).alias(n) for n, v in fields.items()])).alias("payload"),
    )
    rows = feeds.flatten_schedule(years.select(F.struct("season", "source_id").alias("id"), "payload"), "id")
    return rows.select("id.season", "id.source_id", *[x for x in rows.columns if x != "id"])


SCHEDULE_SQL = """
WITH s AS (SELECT year(o_orderdate) + 24 AS season, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 3 WHEN 0 THEN -19800 WHEN 1 THEN 7200 ELSE 0 END AS off FROM orders),
u AS (SELECT season, k, CAST(k % 25 AS INT) AS round_number, n AS slot, (['Practice 1', CASE WHEN k % 2 = 0 THEN 'Sprint_Qualifying' ELSE 'Qualifying' END, '', 'Warmup', 'Race'])[n] AS label,
  CASE WHEN k % 6 <> n THEN CAST(epoch(d) AS BIGINT) + n * 3600 - off END AS at FROM s, (VALUES (1), (2), (3), (4), (5)) v(n))"""


@query("flattened_schedule", SCHEDULE_SQL.replace(" AS at FROM", " AS sat FROM") + """
SELECT season, k AS source_id, round_number, max(sat) FILTER (slot = 1) AS first_s, max(sat) FILTER (slot = 5) AS race_s FROM u GROUP BY ALL""")
def flattened_schedule(spark, folder):
    return schedule_rows(spark, folder).select(
        "season", "source_id", "round_number", F.unix_timestamp("session1_utc").alias("first_s"), F.unix_timestamp("session5_utc").alias("race_s")
    )


@query("session_slots", SCHEDULE_SQL.replace(" AS at FROM", " AS sat FROM") + """,
t AS (SELECT *, CASE label WHEN 'Practice 1' THEN 'practice-1' WHEN 'Qualifying' THEN 'qualifying' WHEN 'Race' THEN 'race' WHEN 'Sprint_Qualifying' THEN CASE season WHEN 2021 THEN 'sprint' WHEN 2023 THEN 'sprint-shootout' ELSE 'sprint-qualifying' END ELSE 'unknown' END AS session_type
  FROM u WHERE label <> '' AND round_number <> 0)
SELECT k AS source_id, slot, session_type, season || '-' || lpad(CAST(round_number AS VARCHAR), 2, '0') || '-' || CASE WHEN session_type <> 'unknown' THEN session_type ELSE 'slot-' || slot END AS session_id,
  CASE WHEN sat IS NULL THEN 'unknown' WHEN sat >= 900000000 THEN 'future' ELSE 'past-unverified' END AS completion FROM t""")
def session_slots(spark, folder):
    rows = feeds.unpivot_sessions(schedule_rows(spark, folder), F.timestamp_seconds(F.lit(900000000)))
    return rows.select("source_id", "slot", "session_type", "session_id", "completion")


def status_lines(spark, folder):
    k = F.col("k")
    clock = F.format_string("%02d:%02d:%02d.%03d", k % 26, k % 61, (F.col("event_id") % 40).cast("int"), k % 2)
    names = F.array(*[F.lit(s) for s in ("Inactive", "Started", "Aborted", "Finalised", "Ends", "Odd")])
    good = F.concat(F.lit('{"Status": "'), F.element_at(names, (k % 6 + 1).cast("int")), F.lit('"}'))
    body = F.when(k % 17 == 0, F.lit('{"Status":')).when(k % 19 == 0, F.lit('{"Status": 5}')).otherwise(good)
    return feed(spark, folder).select(F.col("driver_id").alias("session_id"), F.col("event_id").alias("number"), F.concat(clock, body).alias("line"))


@query("status_lines", W_FEED + """,
r AS (SELECT driver_id AS session_id, event_id AS number, CASE WHEN k % 26 < 24 AND k % 61 < 60 THEN ((k % 26 * 60 + k % 61) * 60 + event_id % 40) * 1000 + k % 2 END::BIGINT AS millis,
  CASE WHEN k % 17 <> 0 AND k % 19 <> 0 THEN (['Inactive','Started','Aborted','Finalised','Ends','Odd'])[k % 6 + 1] END AS status FROM feed),
m AS (SELECT *, last_value(millis IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm,
  lag(coalesce(status, '?')) OVER (PARTITION BY session_id, millis ORDER BY number) AS ps FROM r)
SELECT session_id, number, millis, status, concat_ws(',', CASE WHEN millis IS NULL THEN 'invalid-timestamp' END, CASE WHEN status = 'Odd' THEN 'unknown-status' END, CASE WHEN status IS NULL THEN 'malformed-record' END,
  CASE WHEN millis < pm THEN 'nonmonotonic' END, CASE WHEN millis IS NOT NULL AND ps IS NOT NULL AND ps <> coalesce(status, '?') AND NOT (ps = 'Finalised' AND coalesce(status, '?') = 'Ends') THEN 'timestamp-conflict' END) AS issues,
  CASE WHEN millis IS NOT NULL AND ps = 'Finalised' AND status = 'Ends' THEN 'coincident-terminal-progression' END AS note FROM m""")
def status_line_issues(spark, folder):
    out = feeds.parse_status_lines(status_lines(spark, folder), ROWS)
    return out.drop("line").withColumn("issues", F.array_join("issues", ","))


@query("document_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM documents WHERE text <> '')
SELECT doc_id, count(*) AS lines, CAST(sum(length(regexp_replace(line, '\r$', ''))) AS BIGINT) AS chars FROM l GROUP BY 1""".replace("'\n$'", "chr(10) || '$'").replace("'\r$'", "chr(13) || '$'"))
def document_lines(spark, folder):
    lines = feeds.split_lines(table(spark, folder, "documents").select("doc_id", F.col("text").alias("body")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


def cells(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"z":null,"a":[1,2.5],"k":"'), F.col("user_id"), F.lit('"}'))).otherwise(F.col("props")).alias("json"),
    )
    return lossless.lossless_cells(rows)


@query("lossless_cells", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '"' || user_id || '"' ELSE json_extract_string(props, '$.k') END AS k, event_id % 3 = 0 AS z_present, CASE WHEN event_id % 3 = 0 THEN 'null' END AS z, CASE WHEN event_id % 3 = 0 THEN '[1,2.5]' END AS a FROM events""")
def lossless_cells(spark, folder):
    return lossless.cell_columns(cells(spark, folder), ["k", "z", "a"]).select("event_id", "k", "z_present", "z", "a")


@query("restored_cells", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"a":[1,2.5],"k":"' || user_id || '","z":null}' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS json FROM events""")
def restored_cells(spark, folder):
    return lossless.restore_cells(cells(spark, folder)).select("event_id", "json")


@query("driver_frames", "SELECT l_returnflag AS driver_number, count(*) AS samples, count(l_tax) FILTER (l_returnflag = 'A') AS taxed FROM lineitem GROUP BY 1")
def driver_frames(spark, folder):
    items = table(spark, folder, "lineitem")
    frames = {f: items.where(F.col("l_returnflag") == f).select("l_quantity", *(["l_tax"] if f == "A" else [])) for f in ("A", "N", "R")}
    return tables.union_drivers(frames).groupBy("driver_number").agg(F.count(F.lit(1)).alias("samples"), F.count("l_tax").alias("taxed"))


@query("control_feeds", W_FEED + " SELECT CASE event_type WHEN 'click' THEN 'track_status' WHEN 'view' THEN 'race_control_message' ELSE 'session_status' END AS source_kind, count(*) AS n, count(value) FILTER (event_type = 'view') AS valued FROM feed WHERE event_type IN ('click','view','error') GROUP BY 1")
def control_feeds(spark, folder):
    f = feed(spark, folder)
    part = lambda t, *c: f.where(F.col("event_type") == t).select("session_id", "t_ms", *c)
    out = tables.union_control(part("click"), part("view", "value"), part("error"))
    return out.groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("valued"))


@query("telemetry_ranges", W_FEED + """
SELECT session_id, driver_id AS driver_number, min(coalesce(a, b)) AS start_time, max(coalesce(a, b)) AS end_time, count(coalesce(a, b)) AS sample_count, count(*) - count(coalesce(a, b)) AS discarded, 'Speed,Brake' AS channel_names
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN t_ms END AS a, CASE WHEN k % 4 = 0 THEN t_ms + 1 END AS b FROM feed) GROUP BY 1, 2 HAVING count(coalesce(a, b)) > 0""")
def telemetry_ranges(spark, folder):
    k = F.col("k")
    car = feed(spark, folder).select(
        "session_id", F.col("driver_id").alias("driver_number"), F.when(k % 3 == 0, F.col("t_ms")).alias("SessionTime"),
        F.when(k % 4 == 0, F.col("t_ms") + 1).alias("Time"), F.col("value").alias("Speed"), (k % 2 == 0).alias("Brake"),
    )
    return tables.telemetry_index(car).withColumn("channel_names", F.array_join("channel_names", ","))


@query("stored_time_slice", W_FEED + " SELECT session_id, driver_id, t_ms, value AS speed FROM feed WHERE t_ms BETWEEN 100000000 AND 120000000")
def stored_time_slice(spark, folder):
    """A span of a canonical table: written with partitions, read with its schema; an absent table adds nothing."""
    rows = feed(spark, folder).select("session_id", "driver_id", "t_ms", F.col("value").alias("speed"))
    root = shared_path(spark, "canonical")
    tables.write_table(rows, f"{root}/samples", ["session_id"])
    samples = tables.read_table(spark, root, "samples", rows.schema)
    both = samples.unionByName(tables.read_table(spark, root, "absent", rows.schema))
    return tables.read_range(both, 100_000_000, 120_000_000, ["session_id", "driver_id", "t_ms", "speed"], "t_ms")


@query("telemetry_time_slice", W_FEED + " SELECT session_id, driver_id, t_ms, value AS speed FROM feed WHERE t_ms BETWEEN 100000000 AND 120000000")
def telemetry_time_slice(spark, folder):
    car = feed(spark, folder).select("session_id", "driver_id", F.col("value").alias("Speed"), "t_ms", "k")
    return tables.read_range(tables.rename_native(car), 100_000_000, 120_000_000, ["session_id", "driver_id", "t_ms", "speed"], "t_ms")


@query("event_payloads", W_FEED + """
SELECT session_id, event_id, '{"lap_number":' || lap_number || ',"position":' || position || '}' AS payload_json, position AS decoded_position FROM tp""")
def event_payloads(spark, folder):
    from lapwing.plans.standin import timing

    p = timing(spark, folder).positions.withColumn("event_type", F.lit("driver-position-changed"))
    encoded = p.withColumn("payload_json", T.payload_json(p))
    out = T.decode_payload(encoded, "lap_number int, position int")
    return out.select("session_id", "event_id", "payload_json", F.col("payload.position").alias("decoded_position"))


@query("quality_flags", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 200 AS speed, CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 4 END AS rpm, l_quantity / 5 AS gear, l_discount * 1100 AS throttle, CASE WHEN l_tax <> 0 THEN l_tax > 0.03::DOUBLE END AS brake, l_linenumber * 2 AS drs, l_partkey - 100 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN speed NOT BETWEEN 0 AND 450 THEN 1 ELSE 0 END + CASE WHEN rpm IS NULL OR rpm > 22000 THEN 2 ELSE 0 END + CASE WHEN gear > 8 OR gear <> floor(gear) THEN 4 ELSE 0 END + CASE WHEN throttle > 100 THEN 8 ELSE 0 END
  + CASE WHEN brake IS NULL THEN 16 ELSE 0 END + CASE WHEN drs NOT IN (0, 1, 2, 3, 8, 10, 12, 14) THEN 32 ELSE 0 END + CASE WHEN t < 0 THEN 128 ELSE 0 END AS INT) AS quality_flags, CASE WHEN speed BETWEEN 0 AND 450 THEN speed END AS masked_speed FROM s""")
def quality_flags(spark, folder):
    s = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 200).alias("speed"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 4).alias("rpm"), (F.col("l_quantity") / 5).alias("gear"),
        (F.col("l_discount") * 1100).alias("throttle"), F.when(F.col("l_tax") != 0, F.col("l_tax") > 0.03).alias("brake"),
        (F.col("l_linenumber") * 2).alias("drs"), (F.col("l_partkey") - 100).alias("session_time_ms"),
    )
    flagged = s.withColumn("quality_flags", CH.flag_columns(s))
    out = CH.masked(flagged, {"speed": "speed"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quality_flags", F.col("speed").alias("masked_speed"))


@query("cleaned_values", """
SELECT doc_id, nullif(trim(regexp_replace(lang, '^x', '')), '') AS text_value, CASE WHEN n_chars % 3 = 0 THEN n_chars END AS int_value, n_chars % 3 <> 0 AS bad_int, CASE WHEN n_chars % 4 <> 0 THEN CAST(n_chars AS DOUBLE) / 8 END AS float_value,
  CASE n_chars % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS bool_value, (n_chars * 1001 + 500) // 1000 AS ms_value, (n_chars % 50 * 60 + n_chars % 60) * 1000 + 500 AS duration_ms,
  CASE n_chars % 4 WHEN 0 THEN 'laps-down' WHEN 1 THEN 'seconds' WHEN 2 THEN 'unknown' ELSE 'unavailable' END AS gap_kind, CASE WHEN n_chars % 4 = 1 THEN n_chars / 10.0::DOUBLE END AS gap_seconds, CASE WHEN n_chars % 4 = 0 THEN n_chars END AS gap_laps,
  lower(source) AS slug_value, n_chars % 2 = 0 AS track_is_clear FROM documents""")
def cleaned_values(spark, folder):
    n = F.col("n_chars")
    text = n.cast("string")
    gap = V.parse_interval(
        F.when(n % 4 == 0, F.concat(F.lit("+"), text, F.lit(" LAPS"))).when(n % 4 == 1, (n / 10).cast("string")).when(n % 4 == 2, F.lit("-3"))
    )
    clock = F.concat((n % 50).cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(".5"))
    docs = table(spark, folder, "documents").withColumn("g", gap)
    return docs.select(
        "doc_id", V.as_text(F.concat(F.lit("  "), F.col("lang"), F.lit(" \t"))).alias("text_value"),
        V.as_int(F.concat(text, F.when(n % 3 == 0, ".0").otherwise(".5"))).alias("int_value"),
        V.is_bad_int(F.concat(text, F.when(n % 3 == 0, ".0").otherwise(".5"))).alias("bad_int"),
        V.as_float(F.when(n % 4 == 0, F.lit("Infinity")).otherwise((n / 8).cast("string"))).alias("float_value"),
        V.as_bool_text(F.when(n % 4 == 0, "T").when(n % 4 == 1, " yes ").when(n % 4 == 2, "0").otherwise("  ")).alias("bool_value"),
        V.micros_to_session_ms(n * 1001).alias("ms_value"), V.parse_duration_ms(clock).alias("duration_ms"),
        F.col("g.kind").alias("gap_kind"), F.col("g.seconds").alias("gap_seconds"), F.col("g.laps_down").alias("gap_laps"),
        F.regexp_replace(V.slug(F.concat(F.lit("--"), F.col("source"), F.lit(" !"))), "-", "_").alias("slug_value"),
        V.track_clear(F.when(n % 2 == 0, " 1 1").otherwise("12")).alias("track_is_clear"),
    )


@query("parsed_labels", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 6 AS a FROM lineitem)
SELECT a, l_linenumber, (['retired','disqualified','finished','finished','did-not-start','unknown'])[a + 1] AS driver_status, (['clear','safety-car','red-flag','vsc-ending','unknown','yellow'])[a + 1] AS track_status, (['soft','medium','unknown','wet','hard','unknown'])[a + 1] AS compound,
  CASE WHEN a % 2 = 0 THEN 'OFF' ELSE 'UNKNOWN' END AS drs, count(*) AS n FROM l GROUP BY ALL""")
def parsed_labels(spark, folder):
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (F.col("a") + 1).cast("int"))
    rows = table(spark, folder, "lineitem").withColumn("a", F.col("l_partkey") % 6)
    return rows.select(
        "a", "l_linenumber",
        VB.driver_status(pick("r", "E", None, "5", " w ", None), pick("Engine", None, "Classified", "+ 2 laps", "x", "Gearbox")).alias("driver_status"),
        VB.parse_enum(pick("All-Clear", "4", "RED_flag", " vsc  ending", "9", "Yellow"), VB.TRACK_STATUSES).alias("track_status"),
        VB.parse_enum(pick("SOFT", " medium", "C5", "Wet", "hard", None), VB.TYRE_COMPOUNDS).alias("compound"),
        VB.decode((F.col("a") % 2).cast("int"), {0: "OFF"}).alias("drs"),
    ).groupBy("a", "l_linenumber", "driver_status", "track_status", "compound", "drs").agg(F.count(F.lit(1)).alias("n"))


@query("binary_rounding", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_round('l_extendedprice / l_linenumber', 1)} AS one_digit, {sql_round('l_quantity / 8', 2)} AS two_digits FROM lineitem""")
def binary_rounding(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.round_binary(F.col("l_extendedprice") / F.col("l_linenumber"), 1).alias("one_digit"),
        V.round_binary(F.col("l_quantity") / 8, 2).alias("two_digits"),
    )


@query("record_ids", """
SELECT event_id, 'record-' || sha256('feed' || chr(0) || '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS source_record_id FROM events""")
def record_ids(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type")
    return N.with_record_id(rows, "feed", ["event_type", "event_id"]).select("event_id", "source_record_id")


@query("keyed_errors", """
WITH h AS (SELECT event_id, sha256('2216|' || event_id || '|' || event_type) AS d FROM events),
u AS (SELECT event_id, (CAST('0x' || substr(d, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS b, (CAST('0x' || substr(d, 13, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS w, (CAST('0x' || substr(d, 25, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS s FROM h)
SELECT event_id, round(CASE WHEN s < 0.5 THEN -1 ELSE 1 END * CASE WHEN b < 0.8 THEN w * 100 WHEN b < 0.9 THEN 100 + w * 50 ELSE 150 + w * 150 END, 6) AS error_ms FROM u""")
def keyed_errors(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.round(V.keyed_error(F.lit(100.0), F.lit(150.0), 2216, F.col("event_id"), F.col("event_type")), 6).alias("error_ms")
    )


@query("rotated_positions", W_FEED + """
SELECT event_id, round((value * cos(radians(30)) - k * sin(radians(30))) * 2 + 5, 6) AS rx, round((value * sin(radians(30)) + k * cos(radians(30))) * 2 - 5, 6) AS ry FROM feed""")
def rotated_positions(spark, folder):
    x, y = V.rotate(F.col("value"), F.col("k"), 30.0, 2.0, 5.0, -5.0)
    return feed(spark, folder).select("event_id", F.round(x, 6).alias("rx"), F.round(y, 6).alias("ry"))
