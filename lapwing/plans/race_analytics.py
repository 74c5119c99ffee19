"""Historical analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import analytics as A
from lapwing.plans.registry import query, sql_round
from lapwing.plans.standin import ARCHIVE_SQL, OBS_SQL, ROWS, archive, stored, table

FLOOR = 1995  # the test orders start in 1995
W_ARCHIVE = "WITH " + ARCHIVE_SQL
W_OBS = "WITH " + OBS_SQL


def build_observations(spark, folder):
    v = archive(spark, folder)
    return A.driver_race(v.results, v.laps, v.pits, v.events)


def observations(spark, folder):
    """The stored fact table every analytics surface reads."""
    return stored(spark, folder, "driver_race", lambda: build_observations(spark, folder))


def sql_summary(keys: str, source: str = "obs", tail: str = "") -> str:
    """Entity summary written the direct way, with distinct counts."""
    scored = "outcome IN ('finished','classified')"
    grid = "outcome <> 'dns' AND grid_position IS NOT NULL AND grid_position <> 0"
    fin = f"{scored} AND finish_position IS NOT NULL"
    return f"""
  SELECT {keys}, CAST(starts AS BIGINT) AS starts, finishes, wins, podiums,
    {sql_round('points_raw', 2)} AS points, dnf, dns, dsq,
    {sql_round('grid_avg', 1)} AS average_grid, average_grid_samples,
    {sql_round('finish_avg', 1)} AS average_finish, average_finish_samples,
    positions_gained, positions_gained_samples, laps_completed, pit_stops, pit_coverage_races, best_finish,
    race_count, entries
  FROM (SELECT {keys},
    count(*) FILTER (outcome <> 'dns') AS starts, count(*) FILTER ({scored}) AS finishes,
    count(*) FILTER ({scored} AND finish_position = 1) AS wins,
    count(*) FILTER ({scored} AND finish_position <= 3) AS podiums,
    sum(points) AS points_raw,
    count(*) FILTER (outcome = 'dnf') AS dnf, count(*) FILTER (outcome = 'dns') AS dns,
    count(*) FILTER (outcome = 'dsq') AS dsq,
    avg(grid_position) FILTER ({grid}) AS grid_avg, count(*) FILTER ({grid}) AS average_grid_samples,
    avg(finish_position) FILTER ({fin}) AS finish_avg, count(*) FILTER ({fin}) AS average_finish_samples,
    CAST(coalesce(sum(positions_gained) FILTER ({scored}), 0) AS BIGINT) AS positions_gained,
    count(positions_gained) FILTER ({scored}) AS positions_gained_samples,
    CAST(sum(coalesce(laps_completed, 0)) AS BIGINT) AS laps_completed,
    CAST(sum(pit_stop_count) AS BIGINT) AS pit_stops,
    count(DISTINCT session_id) FILTER (pit_stop_count IS NOT NULL) AS pit_coverage_races,
    min(finish_position) FILTER ({fin}) AS best_finish,
    count(DISTINCT session_id) AS race_count, count(*) AS entries
    FROM {source} GROUP BY {keys}) {tail}"""


def sql_constructor(keys: str, source: str = "obs") -> str:
    return f"SELECT * REPLACE (race_count AS starts), starts AS driver_entries FROM ({sql_summary(keys, source)})"


FINISH = "CASE WHEN coalesce(finish_position, 0) = 0 THEN 10000 ELSE finish_position END"


def sql_latest(key: str, name: str, out: str = "entity_name", source: str = "obs") -> str:
    return (
        f"SELECT {key}, arg_max({name}, (season, round_number, {FINISH}, session_id, driver_id)) AS {out} "
        f"FROM {source} GROUP BY {key}"
    )


@query(
    "driver_race",
    W_OBS + " SELECT * REPLACE (array_to_string(pit_durations_ms, ',') AS pit_durations_ms) FROM obs",
)
def driver_race(spark, folder):
    obs = build_observations(spark, folder)
    return obs.withColumn("pit_durations_ms", F.array_join(F.col("pit_durations_ms").cast("array<string>"), ","))


@query(
    "outcome_counts",
    W_OBS + " SELECT outcome, status, count(*) AS drivers FROM classed GROUP BY ALL",
)
def outcome_counts(spark, folder):
    v = archive(spark, folder)
    from lapwing.functions.vocab import outcome

    return (
        v.results.withColumn(
            "outcome", outcome(F.col("status"), F.col("classified"), F.col("laps_completed"))
        )
        .groupBy("outcome", "status")
        .agg(F.count(F.lit(1)).alias("drivers"))
    )


@query("driver_summary", W_OBS + sql_summary("driver_id"))
def driver_summary(spark, folder):
    return A.summary(observations(spark, folder), ["driver_id"])


@query("constructor_summary", W_OBS + sql_constructor("constructor_id"))
def constructor_summary(spark, folder):
    return A.constructor_summary(observations(spark, folder), ["constructor_id"])


@query("season_span_summary", W_OBS + sql_summary(
    "season, circuit_id", "(SELECT * FROM obs WHERE season BETWEEN 1997 AND 1999)"))
def season_span_summary(spark, folder):
    rows = A.season_filter(observations(spark, folder), 1997, 1999, floor=FLOOR)
    return A.summary(rows, ["season", "circuit_id"])


@query("latest_names", W_OBS + sql_latest("driver_id", "driver_name") + " ")
def latest_names(spark, folder):
    return A.latest_name(observations(spark, folder), "driver_id", "driver_name")


def _sql_coverage() -> str:
    parts = []
    for metric, cond, n in (
        ("result_metrics", "true", "1"),
        ("position_progression", "lap_data_available", "recorded_lap_count"),
        ("raw_lap_time_metrics", "timed_lap_count > 0", "timed_lap_count"),
        ("pit_stop_metrics", "pit_data_available", "coalesce(pit_stop_count, 0)"),
    ):
        parts.append(f"""
  SELECT '{metric}' AS metric, CAST(coalesce(sum({n}) FILTER ({cond}), 0) AS BIGINT) AS sample_count,
    count(DISTINCT session_id) FILTER ({cond}) AS race_count, count(DISTINCT session_id) AS eligible_race_count,
    greatest(0, count(DISTINCT session_id) - count(DISTINCT session_id) FILTER ({cond})) AS missing_count,
    count(DISTINCT session_id) FILTER ({cond} AND quality_status = 'verified') AS verified_count,
    count(DISTINCT session_id) FILTER ({cond} AND quality_status = 'good') AS good_count,
    (SELECT CAST(coalesce(sum(result_rows), 0) AS BIGINT) FROM ev WHERE status = 'completed'
       AND quality_status NOT IN ('verified','good')
       AND season BETWEEN (SELECT min(season) FROM obs) AND (SELECT max(season) FROM obs)) AS quality_exclusions,
    count(DISTINCT session_id) FILTER ({cond}) / nullif(count(DISTINCT session_id), 0)::DOUBLE AS coverage_ratio
  FROM obs""")
    return W_OBS + " UNION ALL ".join(parts)


@query("coverage_report", _sql_coverage())
def coverage_report(spark, folder):
    events = archive(spark, folder).events
    return A.coverage(observations(spark, folder), events, A.coverage_metrics())


@query("season_report", W_OBS + f""",
d AS ({sql_summary('season, driver_id')}),
dn AS (SELECT d.*, n.driver_name FROM d JOIN (SELECT season, driver_id,
   arg_max(driver_name, (season, round_number, {FINISH}, session_id, driver_id)) AS driver_name FROM obs GROUP BY 1, 2) n
   USING (season, driver_id)),
lead AS (SELECT season, driver_id AS points_leader_id, driver_name AS points_leader_name FROM dn
   QUALIFY row_number() OVER (PARTITION BY season ORDER BY points DESC, wins DESC, driver_name, driver_id) = 1),
c AS ({sql_summary('season, constructor_id')}),
conc AS (SELECT season, count(*) AS constructor_count,
   {sql_round('sum(points*points) / (sum(points)*sum(points))', 3)} AS points_concentration FROM c GROUP BY season),
sched AS (SELECT season, count(*) AS scheduled_races, count(*) FILTER (status = 'completed') AS completed_races
   FROM ev GROUP BY season),
o AS (SELECT season, count(DISTINCT driver_id) AS driver_count, count(*) AS result_observations,
   CAST(sum(coalesce(laps_completed,0)) AS BIGINT) AS laps_completed,
   CAST(sum(recorded_lap_count) AS BIGINT) AS recorded_laps, CAST(sum(pit_stop_count) AS BIGINT) AS pit_stops,
   count(DISTINCT driver_id) FILTER (finish_position = 1 AND outcome IN ('finished','classified')) AS different_winners,
   count(DISTINCT driver_id) FILTER (finish_position <= 3 AND outcome IN ('finished','classified')) AS different_podium_finishers
   FROM obs GROUP BY season),
spread AS (SELECT season, {sql_round('max(points) - min(points)', 2)} AS driver_points_spread FROM d GROUP BY season)
SELECT * FROM sched LEFT JOIN o USING (season) LEFT JOIN lead USING (season) LEFT JOIN conc USING (season)
  LEFT JOIN spread USING (season)""")
def season_report(spark, folder):
    return A.season_report(observations(spark, folder), archive(spark, folder).events)


SQL_RACES = """
SELECT session_id, max(event_id) AS event_id, max(season) AS season, max(round_number) AS round_number,
  max(event_name) AS event_name, max(circuit_id) AS circuit_id,
  min(driver_id) FILTER (won) AS winner_driver_id, arg_min(driver_name, driver_id) FILTER (won) AS winner_name,
  CASE WHEN bool_or(pit_data_available) THEN CAST(sum(coalesce(pit_stop_count, 0)) AS BIGINT) END AS pit_stop_count,
  count(*) FILTER (outcome = 'dnf') AS dnf_count
FROM (SELECT *, coalesce(finish_position = 1 AND outcome IN ('finished','classified'), false) AS won FROM obs)
GROUP BY session_id"""


@query("race_rows", W_OBS + SQL_RACES)
def race_rows(spark, folder):
    return A.race_rows(observations(spark, folder))


@query("driver_directory", W_OBS + f"""
SELECT s.* EXCLUDE (driver_id), driver_id AS entity_id, start_season, end_season, constructors, entity_name
FROM ({sql_summary('driver_id')}) s JOIN (
  SELECT driver_id, min(season) AS start_season, max(season) AS end_season,
    string_agg(DISTINCT constructor_name, ',' ORDER BY constructor_name) AS constructors FROM obs GROUP BY driver_id) USING (driver_id)
JOIN ({sql_latest('driver_id', 'driver_name')}) USING (driver_id)
WHERE contains(lower(entity_name), '07') OR contains(CAST(driver_id AS VARCHAR), '07')""")
def driver_directory(spark, folder):
    rows = A.driver_directory(observations(spark, folder))
    found = A.search(rows, " 07 ", ["entity_name", "entity_id"])
    return found.withColumn("constructors", F.array_join("constructors", ","))


@query("constructor_directory", W_OBS + f"""
SELECT s.* EXCLUDE (constructor_id), constructor_id AS entity_id, start_season, end_season, driver_count, entity_name
FROM ({sql_constructor('constructor_id')}) s JOIN (
  SELECT constructor_id, min(season) AS start_season, max(season) AS end_season,
    count(DISTINCT driver_id) AS driver_count FROM obs GROUP BY constructor_id) USING (constructor_id)
JOIN ({sql_latest('constructor_id', 'constructor_name')}) USING (constructor_id)""")
def constructor_directory(spark, folder):
    return A.constructor_directory(observations(spark, folder))


@query("circuit_directory", W_OBS + f"""
SELECT circuit_id AS entity_id, entity_name, start_season, end_season, race_count, pit_coverage_races, different_winners
FROM (SELECT circuit_id, min(season) AS start_season, max(season) AS end_season, count(DISTINCT session_id) AS race_count,
  count(DISTINCT session_id) FILTER (pit_data_available) AS pit_coverage_races,
  count(DISTINCT driver_id) FILTER (finish_position = 1 AND outcome IN ('finished','classified')) AS different_winners
  FROM obs GROUP BY circuit_id) JOIN ({sql_latest('circuit_id', 'circuit_name')}) USING (circuit_id)""")
def circuit_directory(spark, folder):
    return A.circuit_directory(observations(spark, folder))


@query("driver_profile_seasons", W_OBS + sql_summary("driver_id, season"))
def driver_profile_seasons(spark, folder):
    return A.summary(observations(spark, folder), ["driver_id", "season"])


@query("driver_profile_circuits", W_OBS + sql_summary("driver_id, circuit_id"))
def driver_profile_circuits(spark, folder):
    return A.summary(observations(spark, folder), ["driver_id", "circuit_id"])


@query("driver_races_page", W_OBS + """
SELECT driver_id, session_id, season, round_number, finish_position, points, (SELECT count(*) FROM obs WHERE driver_id = 7) AS total
FROM obs WHERE driver_id = 7 ORDER BY season DESC, round_number DESC, session_id DESC LIMIT 25 OFFSET 10""")
def driver_races_page(spark, folder):
    rows = A.season_filter(observations(spark, folder), 1995, 2026, driver_id=7, floor=FLOOR).select(
        "driver_id", "session_id", "season", "round_number", "finish_position", "points"
    )
    order = [F.col("season").desc(), F.col("round_number").desc(), F.col("session_id").desc()]
    paged, total = A.page(rows, order, 10, 25)
    return paged.withColumn("total", total.scalar())


@query("finish_distribution", W_OBS + """
SELECT driver_id, finish_position, count(*) AS finishes FROM obs WHERE finish_position BETWEEN 1 AND 20 GROUP BY ALL""")
def finish_distribution(spark, folder):
    return A.finish_distribution(observations(spark, folder), "driver_id")


@query("constructor_profile_seasons", W_OBS + sql_constructor("constructor_id, season"))
def constructor_profile_seasons(spark, folder):
    return A.constructor_summary(observations(spark, folder), ["constructor_id", "season"])


@query("constructor_profile_drivers", W_OBS + sql_summary("constructor_id, driver_id"))
def constructor_profile_drivers(spark, folder):
    return A.summary(observations(spark, folder), ["constructor_id", "driver_id"])


@query("one_two_finishes", W_OBS + """
SELECT constructor_id, count(*) FILTER (both_in) AS one_two_finishes FROM (
  SELECT constructor_id, session_id, count(DISTINCT finish_position) FILTER (finish_position IN (1, 2)) = 2 AS both_in
  FROM obs WHERE outcome IN ('finished','classified') GROUP BY ALL) GROUP BY ALL""")
def one_two_finishes(spark, folder):
    return A.one_two_finishes(observations(spark, folder))


@query("circuit_profile", W_OBS + f"""
SELECT circuit_id, min(season) AS first_season, max(season) AS latest_season, count(DISTINCT session_id) AS race_count,
  count(DISTINCT driver_id) FILTER (finish_position = 1) AS different_winners, count(DISTINCT driver_id) AS driver_count,
  count(DISTINCT constructor_id) AS constructor_count,
  {sql_round("count(*) FILTER (outcome = 'dnf') / nullif(count(*) FILTER (outcome <> 'dns'), 0)::DOUBLE", 3)} AS dnf_rate,
  any_value(m.med) AS median_pit_duration_ms
FROM obs LEFT JOIN (SELECT o.circuit_id, quantile_cont(duration_ms, 0.5) AS med FROM obs o
   JOIN pits p ON p.session_id = o.session_id AND p.driver_id = o.driver_id WHERE o.pit_data_available GROUP BY 1) m USING (circuit_id)
GROUP BY circuit_id""")
def circuit_profile(spark, folder):
    return A.circuit_profile(observations(spark, folder))


@query("circuit_pit_trend", W_OBS + """
SELECT circuit_id, season, CAST(sum(coalesce(pit_stop_count, 0)) AS BIGINT) AS pit_stops, count(DISTINCT session_id) AS race_count
FROM obs WHERE pit_data_available GROUP BY ALL""")
def circuit_pit_trend(spark, folder):
    return A.pit_trend(observations(spark, folder))


PAGE = 20

RACES_SQL = f""", win AS (SELECT session_id, min(driver_id) AS winner_driver_id, arg_min(driver_name, driver_id) AS winner_name FROM obs WHERE finish_position = 1 AND outcome IN ('finished','classified') GROUP BY 1),
races AS (SELECT o.session_id, any_value(event_id) AS event_id, any_value(season) AS season, any_value(round_number) AS round_number, any_value(event_name) AS event_name, any_value(circuit_id) AS circuit_id,
  any_value(winner_driver_id) AS winner_driver_id, any_value(winner_name) AS winner_name, CAST(CASE WHEN bool_or(pit_data_available) THEN sum(coalesce(pit_stop_count, 0)) END AS BIGINT) AS pit_stop_count,
  count(*) FILTER (outcome = 'dnf') AS dnf_count FROM obs o LEFT JOIN win USING (session_id) GROUP BY 1)"""


@query("constructor_circuits", W_OBS + f"""
SELECT *, row_number() OVER (PARTITION BY constructor_id ORDER BY starts DESC, circuit_id) AS circuit_rank FROM ({sql_constructor("constructor_id, circuit_id")}) WHERE constructor_id IS NOT NULL""")
def constructor_circuits(spark, folder):
    return A.constructor_circuits(observations(spark, folder))


@query("constructor_races", W_OBS + f"""
SELECT s.*, m.* EXCLUDE (constructor_id, session_id), row_number() OVER (PARTITION BY s.constructor_id ORDER BY season DESC, round_number DESC, s.session_id) AS item_rank, count(*) OVER (PARTITION BY s.constructor_id) AS total
FROM ({sql_summary("constructor_id, session_id")}) s JOIN (SELECT constructor_id, session_id, any_value(event_id) AS event_id, any_value(season) AS season, any_value(round_number) AS round_number, any_value(event_name) AS event_name,
  any_value(circuit_id) AS circuit_id, any_value(circuit_name) AS circuit_name FROM obs GROUP BY 1, 2) m ON m.constructor_id = s.constructor_id AND m.session_id = s.session_id QUALIFY item_rank > {PAGE} AND item_rank <= {2 * PAGE}""")
def constructor_races(spark, folder):
    """The second page of every constructor's races."""
    return A.constructor_races(observations(spark, folder), offset=PAGE, limit=PAGE)


@query("circuit_drivers", W_OBS + f"""
SELECT s.*, driver_name, row_number() OVER (PARTITION BY s.circuit_id ORDER BY wins DESC, podiums DESC, points DESC, starts DESC, s.driver_id) AS place
FROM ({sql_summary("circuit_id, driver_id")}) s JOIN (SELECT circuit_id, driver_id, arg_max(driver_name, (season, round_number, {FINISH}, session_id, driver_id)) AS driver_name FROM obs GROUP BY 1, 2) n
  ON n.circuit_id = s.circuit_id AND n.driver_id = s.driver_id QUALIFY place <= 50""")
def circuit_drivers(spark, folder):
    return A.circuit_drivers(observations(spark, folder))


@query("circuit_constructors", W_OBS + f"""
SELECT s.*, constructor_name, row_number() OVER (PARTITION BY s.circuit_id ORDER BY wins DESC, points DESC, s.constructor_id) AS place
FROM ({sql_constructor("circuit_id, constructor_id")}) s JOIN (SELECT circuit_id, constructor_id, arg_max(constructor_name, (season, round_number, {FINISH}, session_id, driver_id)) AS constructor_name FROM obs GROUP BY 1, 2) n
  ON n.circuit_id = s.circuit_id AND n.constructor_id = s.constructor_id QUALIFY place <= 50""")
def circuit_constructors(spark, folder):
    return A.circuit_constructors(observations(spark, folder))


@query("circuit_races", W_OBS + RACES_SQL + """
SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY season DESC, round_number DESC, session_id) AS item_rank, count(*) OVER (PARTITION BY circuit_id) AS total FROM races QUALIFY item_rank <= 50""")
def circuit_races(spark, folder):
    return A.circuit_races(observations(spark, folder))


@query("race_summaries", W_OBS + RACES_SQL + """
SELECT races.*, driver_count, podium_size, recorded_laps, dns_count FROM races JOIN (SELECT session_id, count(*) AS driver_count, count(*) FILTER (finish_position <= 3 AND outcome IN ('finished','classified')) AS podium_size,
  CAST(sum(recorded_lap_count) AS BIGINT) AS recorded_laps, count(*) FILTER (outcome = 'dns') AS dns_count FROM obs GROUP BY 1) USING (session_id)""")
def race_summaries(spark, folder):
    return A.race_summary(observations(spark, folder))


@query("chosen_progression", W_OBS + f"""
SELECT session_id, driver_id, lap_number, position FROM laps
WHERE position IS NOT NULL AND ((session_id, driver_id) IN (SELECT (session_id, driver_id) FROM obs WHERE driver_id IN (3, 5, 8))
  OR session_id NOT IN (SELECT session_id FROM obs WHERE driver_id IN (3, 5, 8)) AND (session_id, driver_id) IN (SELECT (session_id, driver_id) FROM obs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY {FINISH}, driver_id) <= 5))""")
def chosen_progression(spark, folder):
    """Three drivers where they took part, the first five elsewhere."""
    obs = observations(spark, folder)
    chosen = obs.where(F.col("driver_id").isin(3, 5, 8)).select("session_id", "driver_id")
    return A.position_progression(obs, archive(spark, folder).laps, drivers=chosen)


@query("circuit_identities", W_OBS + """,
rnd AS (SELECT c_custkey AS id, 1992 + c_custkey % 10 AS season, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 24 + 1 END AS number, CASE WHEN c_custkey % 11 <> 0 THEN n_name END AS reference FROM customer JOIN nation ON n_nationkey = c_nationkey),
idn AS (SELECT season, number, arg_max(reference, id) AS reference FROM rnd WHERE number IS NOT NULL AND reference IS NOT NULL GROUP BY 1, 2),
evs AS (SELECT DISTINCT session_id, season, round_number, circuit_id AS slug FROM obs)
SELECT session_id, evs.season, round_number, coalesce(reference, slug) AS circuit_id FROM evs LEFT JOIN idn ON idn.season = evs.season AND number = round_number""")
def circuit_identities(spark, folder):
    """Circuits of the races by the identities of rounds: several rounds of one number, some without number or circuit."""
    nations, customers = table(spark, folder, "nation"), table(spark, folder, "customer")
    key = F.col("c_custkey")
    rounds = customers.select(
        key.alias("id"), (key % 10).alias("season_id"), F.when(key % 7 != 0, key % 24 + 1).alias("number"),
        F.when(key % 11 != 0, F.col("c_nationkey")).alias("circuit_id"),
    )
    seasons = customers.select((key % 10).alias("id"), (key % 10 + 1992).alias("year")).distinct()
    circuits = nations.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("reference"))
    events = A.quality_gate(archive(spark, folder).events)
    resolved = A.resolve_circuit(events, A.circuit_identities(seasons, rounds, circuits))
    return resolved.join(observations(spark, folder).select("session_id").distinct(), "session_id", "left_semi").select(
        "session_id", "season", "round_number", "circuit_id"
    )


@query("race_podium", W_OBS + """
SELECT session_id, finish_position, driver_id, driver_name FROM obs
WHERE finish_position <= 3 AND outcome IN ('finished','classified')""")
def race_podium(spark, folder):
    return A.podium(observations(spark, folder))


@query("biggest_movers", W_OBS + f"""
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY positions_gained DESC, {FINISH}, driver_id) AS mover_rank,
  driver_id, positions_gained FROM obs WHERE positions_gained IS NOT NULL QUALIFY mover_rank <= 8""")
def biggest_movers(spark, folder):
    return A.top_movers(observations(spark, folder))


@query("position_progression", W_OBS + f"""
SELECT session_id, driver_id, lap_number, position FROM laps
WHERE position IS NOT NULL AND (session_id, driver_id) IN (
  SELECT (session_id, driver_id) FROM obs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY {FINISH}, driver_id) <= 5)""")
def position_progression(spark, folder):
    return A.position_progression(observations(spark, folder), archive(spark, folder).laps)


@query("compare_drivers_common", W_OBS + """, c AS (
  SELECT * FROM obs WHERE driver_id IN (3, 5) AND session_id IN (SELECT session_id FROM obs WHERE driver_id = 3
    INTERSECT SELECT session_id FROM obs WHERE driver_id = 5))""" + sql_summary("driver_id", "c"))
def compare_drivers_common(spark, folder):
    return A.compare(observations(spark, folder), "driver_id", 3, 5)


@query("compare_constructors_all", W_OBS + sql_constructor(
    "constructor_id", "(SELECT * FROM obs WHERE constructor_id IN (3, 20))"))
def compare_constructors_all(spark, folder):
    return A.compare(observations(spark, folder), "constructor_id", 3, 20, mode="all_selected_races")


@query("driver_head_to_head", W_OBS + """
SELECT count(*) AS common_race_count, count(*) FILTER (ok AND a.finish_position < b.finish_position) AS a_finished_ahead,
  count(*) FILTER (ok AND b.finish_position < a.finish_position) AS b_finished_ahead,
  count(*) FILTER (NOT ok) AS excluded_non_comparable,
  count(*) FILTER (a.constructor_id = b.constructor_id) AS teammate_races,
  count(*) FILTER (ok AND a.finish_position <> b.finish_position) AS denominator
FROM (SELECT a, b, a.outcome IN ('finished','classified') AND b.outcome IN ('finished','classified')
  AND a.finish_position IS NOT NULL AND b.finish_position IS NOT NULL AS ok
  FROM obs a JOIN obs b ON a.session_id = b.session_id AND a.driver_id = 3 AND b.driver_id = 5)""")
def driver_head_to_head(spark, folder):
    return A.driver_head_to_head(observations(spark, folder), 3, 5)


@query("constructor_head_to_head", W_OBS + """, p AS (
  SELECT session_id, constructor_id, sum(points) AS pts FROM obs GROUP BY ALL)
SELECT count(*) AS common_race_count, count(*) FILTER (a.pts > b.pts) AS a_finished_ahead,
  count(*) FILTER (b.pts > a.pts) AS b_finished_ahead, count(*) FILTER (a.pts = b.pts) AS tied, count(*) AS denominator
FROM p a JOIN p b ON a.session_id = b.session_id AND a.constructor_id = 3 AND b.constructor_id = 20""")
def constructor_head_to_head(spark, folder):
    return A.constructor_head_to_head(observations(spark, folder), 3, 20)


@query("era_coverage", W_OBS + """
SELECT CAST(s AS INT) AS start_season, count(DISTINCT session_id) AS race_count, count(*) AS result_observations,
  count(DISTINCT session_id) FILTER (lap_data_available) AS lap_races,
  count(DISTINCT session_id) FILTER (timed_lap_count > 0) AS timed_lap_races,
  count(DISTINCT session_id) FILTER (pit_data_available) AS pit_races
FROM obs JOIN (VALUES (1995, 1996), (1997, 1999), (2000, 2026)) e(s, t) ON season BETWEEN s AND t GROUP BY s""")
def era_coverage(spark, folder):
    return A.era_coverage(observations(spark, folder), ((1995, 1996), (1997, 1999), (2000, 2026)))


def _sql_progression(key: str, name: str) -> str:
    return W_OBS + f""", t AS ({sql_summary('season, ' + key)}),
best AS (SELECT season, {key} AS entity_id, nm AS entity_name FROM t JOIN (SELECT season, {key},
   arg_max({name}, (season, round_number, {FINISH}, session_id, driver_id)) AS nm FROM obs GROUP BY 1, 2) USING (season, {key})
   QUALIFY row_number() OVER (PARTITION BY season ORDER BY points DESC, wins DESC, nm, {key}) <= 5),
rounds AS (SELECT DISTINCT season, round_number FROM obs)
SELECT r.season, r.round_number, b.entity_id, b.entity_name, {sql_round('''(SELECT coalesce(sum(points), 0) FROM obs o
   WHERE o.season = r.season AND o.''' + key + ''' = b.entity_id AND o.round_number <= r.round_number)''', 2)} AS value
FROM rounds r JOIN best b USING (season)"""


@query("driver_points_progression", _sql_progression("driver_id", "driver_name"))
def driver_points_progression(spark, folder):
    return A.points_progression(observations(spark, folder), "driver_id", "driver_name")


@query("constructor_points_progression", _sql_progression("constructor_id", "constructor_name"))
def constructor_points_progression(spark, folder):
    return A.points_progression(observations(spark, folder), "constructor_id", "constructor_name")


def _sql_ranking(key, name, value, samples, ascending, constructor=False, starts=5, page=""):
    table = sql_constructor(key) if constructor else sql_summary(key)
    direction = "ASC" if ascending else "DESC"
    return W_OBS + f""", t AS ({table}), n AS ({sql_latest(key, name)}),
v AS (SELECT t.*, entity_name, {value} AS value, {samples} AS sample_count FROM t JOIN n USING ({key}) WHERE starts >= {starts})
SELECT {key} AS entity_id, entity_name, CAST(value AS DOUBLE) AS value, starts, race_count, sample_count,
  row_number() OVER (ORDER BY value {direction}, starts DESC, entity_name, {key}) AS rank
FROM v WHERE value IS NOT NULL {page}"""


@query("driver_rankings_average_finish", _sql_ranking(
    "driver_id", "driver_name", "average_finish", "average_finish_samples", True,
    page="ORDER BY rank LIMIT 50"))
def rank_average_finish(spark, folder):
    return A.rankings(observations(spark, folder), "driver_id", "driver_name", "average_finish")


@query("driver_rankings_dnf_rate", _sql_ranking(
    "driver_id", "driver_name", sql_round("dnf / nullif(starts, 0)::DOUBLE", 3), "starts", True))
def rank_dnf_rate(spark, folder):
    obs = observations(spark, folder)
    return A.ranked(A.ranking_rows(obs, "driver_id", "driver_name", "dnf_rate"), "dnf_rate", ROWS)


@query("constructor_rankings_points", _sql_ranking(
    "constructor_id", "constructor_name", "points", "entries", False, constructor=True,
    page="ORDER BY rank LIMIT 10 OFFSET 3"))
def rank_points(spark, folder):
    return A.rankings(
        observations(spark, folder), "constructor_id", "constructor_name", "points", offset=3, limit=10
    )


@query("constructor_rankings_pit_stops", _sql_ranking(
    "constructor_id", "constructor_name", "pit_stops", "pit_coverage_races", False, constructor=True))
def rank_pit_stops(spark, folder):
    obs = observations(spark, folder)
    return A.ranked(A.ranking_rows(obs, "constructor_id", "constructor_name", "pit_stops"), "pit_stops", ROWS)


@query("top_drivers", W_OBS + f"""
SELECT s.*, entity_name FROM ({sql_summary('driver_id')}) s JOIN ({sql_latest('driver_id', 'driver_name')}) USING (driver_id)
ORDER BY points DESC, wins DESC, entity_name, driver_id LIMIT 5""")
def top_drivers(spark, folder):
    obs = observations(spark, folder)
    rows = A.summary(obs, ["driver_id"]).join(A.latest_name(obs, "driver_id", "driver_name"), "driver_id")
    best = A.top_entities(rows.withColumn("entity_id", F.col("driver_id")), "entity_name")
    return best.drop("entity_id")
