"""Independent SQL statements (DuckDB dialect) for every catalog query.

They restate the reference's semantics directly over the generated tables:
rides adapter -> semi join on start ids (null-safe) -> first name per id by
(started_at, ride_id) -> null-safe left-join fills -> completeness filter ->
features -> length filters. None of the Spark-side shortcuts (route folding,
materialised stages) are used here, so agreement checks them.
"""

from __future__ import annotations

_RIDES = """
rides AS (
  SELECT
    'R' || CAST(CASE WHEN event_id % 100 = 99 THEN event_id % 1000 ELSE event_id END AS VARCHAR) AS ride_id,
    CASE WHEN event_id % 100 >= 65 AND event_id % 23 = 0 THEN 'docked_bike'
         WHEN event_type IN ('view', 'click', 'signup') THEN 'classic_bike'
         ELSE 'electric_bike' END AS rideable_type,
    ts + (event_id % 12) * INTERVAL '30' DAY AS started_at,
    ts + (event_id % 12) * INTERVAL '30' DAY + CAST(floor(value * 30) - 5 AS INTEGER) * INTERVAL '1' SECOND AS ended_at,
    CASE WHEN event_id % 17 = 0 THEN NULL
         WHEN event_id % 41 = 0 THEN 'Station ' || CAST(user_id AS VARCHAR) || ' (Temp)'
         ELSE 'Station ' || CAST(user_id AS VARCHAR) END AS start_station_name,
    CASE WHEN event_id % 51 = 0 THEN NULL ELSE 'S' || CAST(user_id AS VARCHAR) END AS start_station_id,
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'Station ' || CAST((user_id * 7 + event_id) % 160 AS VARCHAR) END AS end_station_name,
    CASE WHEN event_id % 57 = 0 THEN NULL ELSE 'S' || CAST((user_id * 7 + event_id) % 160 AS VARCHAR) END AS end_station_id,
    CAST(41.65 AS DOUBLE) + (user_id % 40) * CAST(0.01 AS DOUBLE) AS start_lat,
    CAST(-87.80 AS DOUBLE) + (user_id % 25) * CAST(0.01 AS DOUBLE) AS start_lng,
    CASE WHEN event_id % 211 = 0 THEN NULL
         ELSE CAST(41.65 AS DOUBLE) + ((user_id * 7 + event_id) % 40) * CAST(0.01 AS DOUBLE) END AS end_lat,
    CASE WHEN event_id % 211 = 0 THEN NULL
         ELSE CAST(-87.80 AS DOUBLE) + ((user_id * 7 + event_id) % 25) * CAST(0.01 AS DOUBLE) END AS end_lng,
    CASE WHEN event_id % 100 < 65 THEN 'member' ELSE 'casual' END AS member_casual
  FROM events
),
start_ids AS (SELECT DISTINCT start_station_id AS sid FROM rides),
matched AS (
  SELECT r.* FROM rides r
  WHERE EXISTS (SELECT 1 FROM start_ids s WHERE r.end_station_id IS NOT DISTINCT FROM s.sid)
),
matching_station_ids AS (
  SELECT DISTINCT end_station_id, start_station_id, end_station_name, start_station_name FROM matched
),
end_lookup AS (SELECT DISTINCT end_station_id, end_station_name FROM matching_station_ids),
start_lookup AS (SELECT DISTINCT start_station_id, start_station_name FROM matching_station_ids),
end_lookup_clean AS (
  SELECT end_station_id, arg_min_null(end_station_name, (started_at IS NULL, started_at, ride_id)) AS end_station_name
  FROM matched GROUP BY end_station_id
),
start_lookup_clean AS (
  SELECT start_station_id, arg_min_null(start_station_name, (started_at IS NULL, started_at, ride_id)) AS start_station_name
  FROM matched GROUP BY start_station_id
),
filled_end AS (
  SELECT r.ride_id, r.rideable_type, r.started_at, r.ended_at, r.start_station_name, r.start_station_id,
         coalesce(r.end_station_name, l.end_station_name) AS end_station_name, r.end_station_id,
         r.start_lat, r.start_lng, r.end_lat, r.end_lng, r.member_casual
  FROM rides r LEFT JOIN end_lookup_clean l ON r.end_station_id IS NOT DISTINCT FROM l.end_station_id
),
filled AS (
  SELECT r.ride_id, r.rideable_type, r.started_at, r.ended_at,
         coalesce(r.start_station_name, l.start_station_name) AS start_station_name, r.start_station_id,
         r.end_station_name, r.end_station_id, r.start_lat, r.start_lng, r.end_lat, r.end_lng, r.member_casual
  FROM filled_end r LEFT JOIN start_lookup_clean l ON r.start_station_id IS NOT DISTINCT FROM l.start_station_id
),
complete_raw AS (
  SELECT * FROM filled
  WHERE end_station_name IS NOT NULL AND end_station_id IS NOT NULL AND end_lat IS NOT NULL
    AND end_lng IS NOT NULL AND start_station_id IS NOT NULL AND start_lat IS NOT NULL AND start_lng IS NOT NULL
),
complete AS (
  SELECT *,
    (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS ride_length,
    ((epoch_us(ended_at) - epoch_us(started_at)) / 1e6) / 60.0 AS ride_length_min,
    CAST(dayofweek(started_at) + 1 AS INTEGER) AS day_of_week_num,
    dayname(started_at) AS day_of_week,
    CAST(hour(started_at) AS INTEGER) AS hour_of_day,
    CASE WHEN dayname(started_at) IN ('Saturday', 'Sunday') THEN 'Weekend' ELSE 'Weekday' END AS is_weekend,
    CAST(month(started_at) AS INTEGER) AS month_num,
    strftime(started_at, '%b') AS month_label,
    date_trunc('month', started_at) AS month_start,
    monthname(started_at) AS month_name,
    sqrt((end_lat - start_lat) * (end_lat - start_lat) + (end_lng - start_lng) * (end_lng - start_lng)) AS trip_distance
  FROM complete_raw
),
cleaned AS (SELECT * FROM complete WHERE ride_length > 0 AND ride_length > 10)
"""

_RIDE_COLS = (
    "ride_id, rideable_type, started_at, ended_at, start_station_name, start_station_id, end_station_name, "
    "end_station_id, start_lat, start_lng, end_lat, end_lng, member_casual"
)
_FEATURE_COLS = (
    "ride_length, ride_length_min, day_of_week_num, day_of_week, hour_of_day, is_weekend, month_num, "
    "month_label, month_start, month_name, trip_distance"
)


def _q(body: str, extra: str = "") -> str:
    ctes = _RIDES + ("," + extra if extra else "")
    return "WITH " + ctes.strip() + "\n" + body.strip()


def _count_by(keys: str, name: str, src: str = "cleaned") -> str:
    return _q(f"SELECT {keys}, count(*) AS {name} FROM {src} GROUP BY {keys}")


def _mean_by(keys: str, name: str = "average_ride_length") -> str:
    return _q(f"SELECT {keys}, avg(ride_length) AS {name} FROM cleaned GROUP BY {keys}")


_STATION_COUNTS = """
sc_start AS (SELECT start_station_name, count(*) AS ride_count FROM cleaned GROUP BY start_station_name),
sc_end AS (SELECT end_station_name, count(*) AS ride_count FROM cleaned GROUP BY end_station_name),
scm_start AS (SELECT member_casual, start_station_name, count(*) AS ride_count FROM cleaned GROUP BY member_casual, start_station_name),
scm_end AS (SELECT member_casual, end_station_name, count(*) AS ride_count FROM cleaned GROUP BY member_casual, end_station_name),
top_by_member_start AS (
  SELECT member_casual, start_station_name, ride_count FROM (
    SELECT *, rank() OVER (PARTITION BY member_casual ORDER BY ride_count DESC) AS rk FROM scm_start) WHERE rk <= 10
)
"""

_BOX = """
box_q AS (
  SELECT member_casual, quantile_cont(ride_length, 0.25) AS q1, quantile_cont(ride_length, 0.5) AS med,
         quantile_cont(ride_length, 0.75) AS q3
  FROM cleaned GROUP BY member_casual
)
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # ---- sources / sinks
    q["read_rides_csv"] = _q(f"SELECT {_RIDE_COLS} FROM rides")
    q["combine_ride_files"] = _q(f"SELECT {_RIDE_COLS} FROM rides")
    q["ingest_ride_files"] = _q(f"SELECT {_RIDE_COLS} FROM rides")
    q["write_summary_csv"] = _q(
        """
        SELECT 'average_ride_length_by_member' AS export, NULL::VARCHAR AS day_of_week, member_casual,
               avg(ride_length) AS value FROM cleaned GROUP BY member_casual
        UNION ALL
        SELECT 'average_ride_length_by_day', day_of_week, member_casual, avg(ride_length) FROM cleaned
        GROUP BY day_of_week, member_casual
        UNION ALL
        SELECT 'rides_by_day', day_of_week, member_casual, CAST(count(*) AS DOUBLE) FROM cleaned
        GROUP BY day_of_week, member_casual
        """
    )
    q["preview"] = _q(
        f"SELECT {_RIDE_COLS}, {_FEATURE_COLS} FROM complete WHERE ride_length <= 0 ORDER BY started_at, ride_id LIMIT 6"
    )
    q["report_line"] = _q(
        "SELECT 'Number of rows remaining after cleaning: ' || CAST(count(*) AS VARCHAR) AS line FROM complete"
    )
    q["report_lines"] = _q(
        """
        SELECT 1 AS line_no, 'Number of rows remaining after cleaning: ' || CAST(count(*) AS VARCHAR) AS line FROM complete
        UNION ALL SELECT 2, 'Number of NA values in start_station_name: '
            || CAST(count(*) FILTER (WHERE start_station_name IS NULL) AS VARCHAR) FROM complete
        UNION ALL SELECT 3, 'Number of rows remaining after filtering: ' || CAST(count(*) AS VARCHAR) FROM cleaned
        UNION ALL SELECT 4, 'Mean ride length: ' || printf('%.6f', avg(ride_length)) FROM cleaned
        UNION ALL SELECT 5, 'Max ride length: ' || printf('%.6f', max(ride_length)) FROM cleaned
        UNION ALL SELECT 6, 'Mode day of the week: ' || (SELECT day_of_week FROM (
            SELECT day_of_week_num, day_of_week, count(*) AS n FROM cleaned GROUP BY day_of_week_num, day_of_week)
            ORDER BY n DESC, day_of_week_num LIMIT 1)
        """
    )
    q["analysis_summary"] = _q(
        """
        SELECT 'Mean ride length' AS section, '' AS key, printf('%.6f', avg(ride_length)) AS value FROM cleaned
        UNION ALL SELECT 'Max ride length', '', printf('%.6f', max(ride_length)) FROM cleaned
        UNION ALL SELECT 'Mode day of the week', '', (SELECT day_of_week FROM (
            SELECT day_of_week_num, day_of_week, count(*) AS n FROM cleaned GROUP BY day_of_week_num, day_of_week)
            ORDER BY n DESC, day_of_week_num LIMIT 1)
        UNION ALL SELECT 'Proportional Share of Rides by Member Type', member_casual,
            CAST(count(*) AS VARCHAR) || ' rides, ' || printf('%.6f', count(*) / (SELECT count(*) FROM cleaned))
            FROM cleaned GROUP BY member_casual
        UNION ALL SELECT 'Number of Short Rides by Member Type', member_casual, CAST(count(*) AS VARCHAR)
            FROM cleaned WHERE ride_length < 60 GROUP BY member_casual
        UNION ALL SELECT 'Number of Rides by Rideable Type and Member Type', member_casual || ' / ' || rideable_type,
            CAST(count(*) AS VARCHAR) FROM cleaned GROUP BY member_casual, rideable_type
        """
    )
    # ---- projections, filters, predicates
    q["select_columns"] = _q("SELECT end_station_id, start_station_id, end_station_name, start_station_name FROM matched")
    q["drop_column"] = _q(f"SELECT {_RIDE_COLS}, {_FEATURE_COLS.replace('ride_length_min, ', '')} FROM complete")
    q["with_column"] = _q(f"SELECT {_RIDE_COLS}, {_FEATURE_COLS} FROM cleaned")
    q["drop_incomplete_rides"] = _q(f"SELECT {_RIDE_COLS} FROM complete_raw")
    q["cleaned_rides_recorded_session"] = _q(
        f"""
        SELECT {_RIDE_COLS}, ride_length FROM (
          SELECT *, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS ride_length FROM filled_end
          WHERE end_station_name IS NOT NULL AND end_station_id IS NOT NULL AND end_lat IS NOT NULL
            AND end_lng IS NOT NULL AND start_station_id IS NOT NULL AND start_lat IS NOT NULL AND start_lng IS NOT NULL)
        WHERE ride_length > 0 AND ride_length > 10
        """
    )
    q["zero_or_negative_rides"] = _q(f"SELECT {_RIDE_COLS}, {_FEATURE_COLS} FROM complete WHERE ride_length <= 0")
    q["drop_nonpositive_rides"] = _q(f"SELECT {_RIDE_COLS}, {_FEATURE_COLS} FROM complete WHERE ride_length > 0")
    q["drop_too_short_rides"] = _q(f"SELECT {_RIDE_COLS}, {_FEATURE_COLS} FROM cleaned")
    q["short_rides"] = _q(f"SELECT {_RIDE_COLS}, {_FEATURE_COLS} FROM cleaned WHERE ride_length < 60")
    q["casual_rides"] = _q(f"SELECT {_RIDE_COLS}, {_FEATURE_COLS} FROM cleaned WHERE member_casual = 'casual'")
    q["having"] = _q("SELECT ride_id, count(*) AS number_of_rides FROM cleaned GROUP BY ride_id HAVING count(*) > 1")
    q["grouped_filter"] = _q(
        """
        SELECT end_station_id, start_station_id, end_station_name, start_station_name FROM (
          SELECT *, count(*) OVER (PARTITION BY end_station_id) AS n FROM matching_station_ids) WHERE n > 1
        """
    )
    q["is_in_column"] = _q(f"SELECT {_RIDE_COLS} FROM matched")
    q["is_in_list"] = _q(
        "SELECT ride_id, started_at, day_of_week, is_weekend FROM cleaned WHERE day_of_week IN ('Saturday', 'Sunday')"
    )
    # ---- derived columns
    base = "SELECT ride_id, started_at, ended_at"
    q["add_ride_length"] = _q(f"{base}, ride_length FROM complete")
    q["add_ride_length_minutes"] = _q(f"{base}, ride_length_min FROM complete")
    q["add_day_of_week"] = _q(f"{base}, day_of_week_num, day_of_week FROM complete")
    q["add_hour_of_day"] = _q(f"{base}, hour_of_day FROM complete")
    q["add_is_weekend"] = _q(f"{base}, is_weekend FROM complete")
    q["add_month_label"] = _q(f"{base}, month_num, month_label FROM complete")
    q["add_month_start"] = _q(f"{base}, month_start FROM complete")
    q["add_month_name"] = _q(f"{base}, month_name FROM complete")
    q["add_trip_distance"] = _q(
        "SELECT ride_id, start_lat, start_lng, end_lat, end_lng, trip_distance FROM complete"
    )
    # ---- joins and lookups
    q["matching_station_ids"] = _q("SELECT * FROM matching_station_ids")
    q["fill_end_station_name"] = _q(f"SELECT {_RIDE_COLS} FROM filled_end")
    q["fill_start_station_name"] = _q(f"SELECT {_RIDE_COLS} FROM filled")
    q["end_station_lookup"] = _q("SELECT * FROM end_lookup")
    q["start_station_lookup"] = _q("SELECT * FROM start_lookup")
    q["end_station_lookup_conflicts"] = _q(
        "SELECT end_station_id, end_station_name FROM (SELECT *, count(*) OVER (PARTITION BY end_station_id) AS n "
        "FROM end_lookup) WHERE n > 1"
    )
    q["start_station_lookup_conflicts"] = _q(
        "SELECT start_station_id, start_station_name FROM (SELECT *, count(*) OVER (PARTITION BY start_station_id) AS n "
        "FROM start_lookup) WHERE n > 1"
    )
    q["end_station_lookup_clean"] = _q("SELECT * FROM end_lookup_clean")
    q["start_station_lookup_clean"] = _q("SELECT * FROM start_lookup_clean")
    q["distinct_rows"] = _q("SELECT DISTINCT start_station_id, start_station_name FROM rides")
    # ---- scalars and quality
    q["cleaned_row_count"] = _q("SELECT count(*) AS cleaned_row_count FROM complete")
    q["filtered_row_count"] = _q("SELECT count(*) AS filtered_row_count FROM cleaned")
    q["na_start_station_name_count"] = _q(
        "SELECT count(*) FILTER (WHERE start_station_name IS NULL) AS na_start_station_name_count FROM complete"
    )
    q["na_summary"] = _q(
        "SELECT "
        + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _RIDE_COLS.split(", "))
        + " FROM complete"
    )
    q["mean_ride_length"] = _q("SELECT avg(ride_length) AS mean_ride_length FROM cleaned")
    q["max_ride_length"] = _q("SELECT max(ride_length) AS max_ride_length FROM cleaned")
    mode = (
        "SELECT day_of_week_num, day_of_week FROM (SELECT day_of_week_num, day_of_week, count(*) AS n FROM cleaned "
        "GROUP BY day_of_week_num, day_of_week) ORDER BY n DESC, day_of_week_num LIMIT 1"
    )
    q["mode_day_of_week"] = _q(f"SELECT day_of_week AS mode_day_of_week FROM ({mode})")
    q["day_label_from_index"] = _q(
        f"SELECT day_of_week_num AS mode_day_of_week_index, day_of_week AS mode_day_of_week FROM ({mode})"
    )
    q["summary_statistics"] = _q(
        f"""
        SELECT 'Mean Ride Length' AS metric, CAST(CAST(round_even(avg(ride_length) / s, 0) AS BIGINT) AS VARCHAR) || ' ' || u AS value
        FROM cleaned, unit GROUP BY s, u
        UNION ALL SELECT 'Max Ride Length', CAST(CAST(round_even(max(ride_length) / s, 0) AS BIGINT) AS VARCHAR) || ' ' || u
        FROM cleaned, unit GROUP BY s, u
        UNION ALL SELECT 'Mode Day of the Week', (SELECT day_of_week FROM ({mode}))
        """,
        # the smallest length of the complete rides decides the unit of the column
        """
        unit AS (SELECT CASE WHEN least >= 86400 THEN 86400 WHEN least >= 3600 THEN 3600 WHEN least >= 60 THEN 60 ELSE 1 END AS s,
                        CASE WHEN least >= 86400 THEN 'days' WHEN least >= 3600 THEN 'hours' WHEN least >= 60 THEN 'mins' ELSE 'secs' END AS u
                 FROM (SELECT min(abs(ride_length)) AS least FROM complete))
        """,
    )
    # ---- grouped summaries
    q["ride_share_by_member_type"] = _q(
        "SELECT member_casual, count(*) AS total_rides, count(*) / sum(count(*)) OVER () AS proportion "
        "FROM cleaned GROUP BY member_casual"
    )
    q["short_rides_summary"] = _q("SELECT member_casual, count(*) AS count FROM cleaned WHERE ride_length < 60 GROUP BY member_casual")
    q["rides_by_rideable_type_and_member_type"] = _count_by("member_casual, rideable_type", "ride_count")
    q["bike_usage_by_type"] = _count_by("rideable_type, member_casual", "ride_count")
    q["rideable_type_distribution"] = _count_by("rideable_type, member_casual", "number_of_rides")
    q["rides_by_type_and_day"] = _count_by("member_casual, rideable_type, day_of_week", "ride_count")
    q["rides_by_type_and_hour"] = _count_by("member_casual, rideable_type, hour_of_day", "ride_count")
    q["rides_by_weekend_weekday"] = _count_by("member_casual, rideable_type, is_weekend", "ride_count")
    q["average_ride_length_by_member"] = _mean_by("member_casual")
    q["average_ride_length_by_day"] = _mean_by("day_of_week, member_casual")
    q["rides_by_day"] = _count_by("day_of_week, member_casual", "number_of_rides")
    q["ride_length_stats"] = _q(
        "SELECT member_casual, avg(ride_length) AS average_ride_length, median(ride_length) AS median_ride_length, "
        "max(ride_length) AS max_ride_length FROM cleaned GROUP BY member_casual"
    )
    q["ride_length_stats_minutes"] = _q(
        "SELECT member_casual, avg(ride_length) / 60.0 AS average_ride_length, median(ride_length) / 60.0 AS median_ride_length, "
        "max(ride_length) / 60.0 AS max_ride_length FROM cleaned GROUP BY member_casual"
    )
    q["hourly_rides"] = _count_by("hour_of_day, member_casual", "ride_count")
    q["ride_frequency_by_day"] = _count_by("day_of_week", "ride_count")
    q["member_vs_casual_usage"] = _mean_by("member_casual, rideable_type")
    q["avg_ride_duration_by_type"] = _mean_by("rideable_type, member_casual")
    q["avg_ride_duration"] = _mean_by("day_of_week, hour_of_day")
    q["monthly_rides"] = _q(
        "SELECT month_label AS month, member_casual, count(*) AS ride_count FROM cleaned GROUP BY month_label, member_casual"
    )
    q["rides_by_month"] = _q(
        "SELECT month_start AS month, member_casual, count(*) AS number_of_rides FROM cleaned GROUP BY month_start, member_casual"
    )
    q["monthly_ride_count"] = _q("SELECT month_name AS month, count(*) AS total_rides FROM cleaned GROUP BY month_name")
    q["bike_usage_by_month_type"] = _q(
        "SELECT rideable_type, month_label AS month, member_casual, count(*) AS ride_count FROM cleaned "
        "GROUP BY rideable_type, month_label, member_casual"
    )
    q["ride_count_by_location"] = _count_by("start_lat, start_lng, end_lat, end_lng, member_casual", "number_of_rides")
    q["frequent_casual_riders"] = _q(
        "SELECT ride_id, count(*) AS number_of_rides FROM cleaned WHERE member_casual = 'casual' GROUP BY ride_id HAVING count(*) > 5"
    )
    q["average_trip_distance"] = _q(
        "SELECT member_casual, CAST(CAST(sum(CAST(floor(trip_distance * steps + 0.5) AS BIGINT)) AS BIGINT) AS DOUBLE) / (count(trip_distance) * steps) "
        "AS average_trip_distance FROM cleaned, (SELECT CAST(1099511627776 AS DOUBLE) AS steps) GROUP BY member_casual, steps"
    )
    q["ride_repetition"] = _q(
        "SELECT ride_id, member_casual, count(*) AS number_of_rides FROM cleaned GROUP BY ride_id, member_casual HAVING count(*) > 1"
    )
    q["station_utilization"] = _q(
        "SELECT start_station_name, count(*) AS station_rides, "
        "count(DISTINCT ride_id) + CAST(max(CASE WHEN ride_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unique_bikes "
        "FROM cleaned GROUP BY start_station_name"
    )
    # ---- rankings
    q["popular_start_stations"] = _q("SELECT * FROM sc_start", _STATION_COUNTS)
    q["popular_end_stations"] = _q("SELECT * FROM sc_end", _STATION_COUNTS)
    q["top_start_stations"] = _q(
        "SELECT start_station_name, ride_count FROM (SELECT *, rank() OVER (ORDER BY ride_count DESC) AS rk FROM sc_start) WHERE rk <= 10",
        _STATION_COUNTS,
    )
    q["top_end_stations"] = _q(
        "SELECT end_station_name, ride_count FROM (SELECT *, rank() OVER (ORDER BY ride_count DESC) AS rk FROM sc_end) WHERE rk <= 10",
        _STATION_COUNTS,
    )
    q["popular_start_stations_by_member"] = _q("SELECT * FROM scm_start", _STATION_COUNTS)
    q["popular_end_stations_by_member"] = _q("SELECT * FROM scm_end", _STATION_COUNTS)
    q["top_start_stations_by_member"] = _q("SELECT * FROM top_by_member_start", _STATION_COUNTS)
    q["top_end_stations_by_member"] = _q(
        "SELECT member_casual, end_station_name, ride_count FROM (SELECT *, rank() OVER (PARTITION BY member_casual "
        "ORDER BY ride_count DESC) AS rk FROM scm_end) WHERE rk <= 10",
        _STATION_COUNTS,
    )
    q["station_starts_by_member"] = _q(
        "SELECT start_station_name, member_casual, number_of_starts FROM (SELECT *, row_number() OVER (PARTITION BY "
        "start_station_name ORDER BY number_of_starts DESC, member_casual) AS rn FROM (SELECT start_station_name, "
        "member_casual, count(*) AS number_of_starts FROM cleaned GROUP BY start_station_name, member_casual)) WHERE rn <= 10"
    )
    q["station_ends_by_member"] = _q(
        "SELECT end_station_name, member_casual, number_of_ends FROM (SELECT *, row_number() OVER (PARTITION BY "
        "end_station_name ORDER BY number_of_ends DESC, member_casual) AS rn FROM (SELECT end_station_name, "
        "member_casual, count(*) AS number_of_ends FROM cleaned GROUP BY end_station_name, member_casual)) WHERE rn <= 10"
    )
    q["top_utilized_stations"] = _q(
        "SELECT start_station_name, count(*) AS station_rides, "
        "count(DISTINCT ride_id) + CAST(max(CASE WHEN ride_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unique_bikes "
        "FROM cleaned GROUP BY start_station_name ORDER BY station_rides DESC, start_station_name ASC NULLS LAST LIMIT 10"
    )
    q["sort_by"] = _q("SELECT * FROM scm_start", _STATION_COUNTS)
    q["first_row"] = _q(
        "SELECT start_station_name FROM sc_start ORDER BY ride_count DESC, start_station_name ASC NULLS LAST LIMIT 1",
        _STATION_COUNTS,
    )
    q["display_order"] = _q(
        "SELECT start_station_name, order_value, CAST(row_number() OVER (ORDER BY order_value, start_station_name) AS INTEGER) AS position "
        "FROM (SELECT start_station_name, avg(ride_count) AS order_value FROM top_by_member_start "
        "WHERE start_station_name IS NOT NULL GROUP BY start_station_name)",
        _STATION_COUNTS,
    )
    # ---- chart statistics
    q["ride_length_histogram"] = _q(
        "SELECT CAST(ceil((ride_length_min - 2.5) / 5.0) * 5.0 + 0.0 AS DOUBLE) AS bin_center, member_casual, "
        "count(*) AS count FROM cleaned GROUP BY ALL"
    )
    q["rides_by_day_counts"] = _count_by("day_of_week, member_casual", "count")
    q["ride_length_boxplot"] = _q(
        """
        SELECT c.member_casual,
               min(CASE WHEN ride_length >= q1 - 1.5 * (q3 - q1) THEN ride_length END) / 60.0 AS lower_whisker,
               q1 / 60.0 AS q1, med / 60.0 AS median, q3 / 60.0 AS q3,
               max(CASE WHEN ride_length <= q3 + 1.5 * (q3 - q1) THEN ride_length END) / 60.0 AS upper_whisker,
               count(*) FILTER (WHERE ride_length < q1 - 1.5 * (q3 - q1) OR ride_length > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM cleaned c JOIN box_q b ON c.member_casual = b.member_casual
        WHERE ride_length IS NOT NULL
        GROUP BY c.member_casual, q1, med, q3
        """,
        _BOX,
    )
    q["ride_length_outliers"] = _q(
        """
        SELECT ride_id, c.member_casual, ride_length, ride_length_min
        FROM cleaned c JOIN box_q b ON c.member_casual = b.member_casual
        WHERE ride_length < q1 - 1.5 * (q3 - q1) OR ride_length > q3 + 1.5 * (q3 - q1)
        """,
        _BOX,
    )
    q["stack_positions"] = _q(
        """
        SELECT month, member_casual, number_of_rides, CAST(ymax AS BIGINT) AS ymax, CAST(ymax - number_of_rides AS BIGINT) AS ymin,
               ymax - number_of_rides / 2.0 AS ymid
        FROM (SELECT *, sum(number_of_rides) OVER (PARTITION BY month ORDER BY member_casual DESC NULLS FIRST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ymax
              FROM (SELECT month_start AS month, member_casual, count(*) AS number_of_rides FROM cleaned GROUP BY ALL))
        """
    )
    q["percent_label"] = _q(
        """
        SELECT member_casual, total_rides, CAST(ymax AS BIGINT) AS ymax, ymid, ymax / total AS ymax_share, ymid / total AS ymid_share,
               printf('%.' || CAST(CASE WHEN k IS NULL THEN 0 WHEN zeros THEN greatest(k - 1, 0) ELSE greatest(k, 0) END AS INTEGER) || 'f',
                      total_rides / total * 100.0::DOUBLE) || '%' AS label
        FROM stacked, decimals
        """,
        """
        stacked AS (
          SELECT *, ymax - total_rides / 2.0 AS ymid FROM (
              SELECT *, sum(total_rides) OVER (ORDER BY member_casual DESC NULLS FIRST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ymax,
                     sum(total_rides) OVER () AS total
              FROM (SELECT member_casual, count(*) AS total_rides FROM cleaned GROUP BY member_casual))
        ),
        percents AS (SELECT DISTINCT total_rides / total * 100.0::DOUBLE AS x FROM stacked),
        gaps AS (SELECT min(x - before) AS gap FROM (SELECT x, lag(x) OVER (ORDER BY x) AS before FROM percents)),
        exponent AS (SELECT CASE WHEN gap >= 1.5e-8 THEN 1 - floor(log10(gap)) END AS k FROM gaps),
        decimals AS (SELECT k, bool_and(round_even(x * pow(10, k), 0) % 10 = 0) AS zeros FROM percents, exponent GROUP BY k)
        """,
    )
    q["distance_vs_length"] = _q("SELECT trip_distance, ride_length_min, member_casual FROM cleaned")
    q["distance_length_bins"] = _q(
        "SELECT CAST(floor(trip_distance / 0.05) * 0.05 AS DOUBLE) AS distance_bin, "
        "CAST(floor(ride_length_min / 5.0) * 5.0 AS DOUBLE) AS minutes_bin, member_casual, count(*) AS count "
        "FROM cleaned GROUP BY ALL"
    )
    q["rides_by_start_location"] = _count_by("start_lng, start_lat, member_casual", "number_of_rides")
    return q
