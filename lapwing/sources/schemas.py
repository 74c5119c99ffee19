"""Fixed schemas of the stored tables, as Spark DDL."""

PROVENANCE = (
    "provenance struct<provider:string,version:string,source:string,retrieved_at:timestamp,"
    "source_record_id:string,published_at:timestamp>"
)

ARCHIVE = {
    "results": (
        "session_id string, driver_id string, driver_code string, driver_name string, team_id string, "
        "team_name string, car_number int, grid_position int, finish_position int, points double, "
        "laps_completed int, status string, classified boolean, total_time_ms bigint"
    ),
    "laps": (
        "session_id string, driver_id string, lap_number int, position int, lap_time_ms bigint, "
        "average_speed_kph double, is_fastest_lap boolean"
    ),
    "pit_stops": (
        "session_id string, driver_id string, stop_number int, lap_number int, duration_ms bigint, local_time string"
    ),
}

CANONICAL = {
    "drivers": (
        "session_id string, driver_id string, racing_number int, abbreviation string, full_name string, "
        f"team_name string, country_code string, {PROVENANCE}"
    ),
    "driver_classifications": (
        "session_id string, driver_id string, classified_position int, status string, points double, "
        f"raw_status string, {PROVENANCE}"
    ),
    "laps": (
        "session_id string, driver_id string, lap_number int, lap_start_time_ms bigint, lap_end_time_ms bigint, "
        "lap_time_ms bigint, sector_1_time_ms bigint, sector_2_time_ms bigint, sector_3_time_ms bigint, "
        "stint_number int, compound string, raw_compound string, tyre_life_laps double, is_personal_best boolean, "
        "is_accurate boolean, is_generated boolean, is_deleted boolean, deleted_reason string, "
        f"raw_track_status string, {PROVENANCE}"
    ),
    "stints": (
        "session_id string, driver_id string, stint_number int, start_lap int, end_lap int, start_time_ms bigint, "
        "end_time_ms bigint, compound string, raw_compound string, tyre_life_start_laps double, "
        f"tyre_life_end_laps double, {PROVENANCE}"
    ),
    "pit_stops": (
        "session_id string, driver_id string, stop_number int, lap_number int, pit_in_time_ms bigint, "
        f"pit_out_time_ms bigint, pit_lane_duration_ms bigint, stationary_duration_ms bigint, {PROVENANCE}"
    ),
    "weather": (
        "session_id string, session_time_ms bigint, air_temperature_c double, track_temperature_c double, "
        "humidity_percent double, pressure_hpa double, rainfall boolean, wind_speed_mps double, "
        f"wind_direction_deg double, {PROVENANCE}"
    ),
    "race_control": (
        "session_id string, session_time_ms bigint, message string, track_status string, raw_status string, "
        f"category string, scope string, source_kind string, lap_number int, driver_id string, {PROVENANCE}"
    ),
    "race_positions": (
        f"session_id string, driver_id string, session_time_ms bigint, position int, lap_number int, {PROVENANCE}"
    ),
    "track_positions": (
        "session_id string, driver_id string, session_time_ms bigint, x_m double, y_m double, z_m double, "
        "raw_status string"
    ),
    "telemetry_index": (
        "session_id string, driver_id string, start_time_ms bigint, end_time_ms bigint, data_key string, "
        f"channel_names array<string>, sample_count bigint, lap_number int, {PROVENANCE}"
    ),
    "events": (
        "session_id string, sequence bigint, session_time_ms bigint, priority int, event_type string, "
        "driver_id string, source string, source_key string, payload_json string"
    ),
}
