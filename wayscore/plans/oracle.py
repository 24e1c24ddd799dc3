"""The registered queries as DuckDB SQL over the given tables."""

from wayscore import fixed

GPS = """
gps AS (
  SELECT event_id, 'user_' || user_id AS user_id, t AS "timestamp",
    CASE WHEN event_id % 40 = 25 THEN 0.0e0 ELSE
      round(CASE WHEN user_id % 2 = 0 THEN 25.033e0 ELSE 24.8138e0 END
            + ((slot * 37 + user_id * 11) % 201 - 100) * 0.0001e0, 6) END AS latitude,
    CASE WHEN event_id % 40 = 25 THEN 0.0e0 ELSE
      round(CASE WHEN user_id % 2 = 0 THEN 121.5654e0 ELSE 120.9675e0 END
            + ((slot * 53 + user_id * 7) % 201 - 100) * 0.0001e0, 6) END AS longitude,
    CASE WHEN user_id % 2 = 0 THEN 'Taipei' ELSE 'Hsinchu' END AS city
  FROM (SELECT *, t // 21600 AS slot
        FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) e1) e2
)"""


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )


def _with_steps(points: str = "gps") -> str:
    """Previous point, distance and stuck flag of ``points``."""
    return f"""
lagged AS (
  SELECT *, lag(latitude) OVER w AS prev_lat, lag(longitude) OVER w AS prev_lon,
    row_number() OVER w AS point_no
  FROM {points} WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id)
),
arcs AS (
  SELECT *, CASE WHEN a IS NULL OR isnan(a) THEN 0.0e0
                 WHEN a > 1 THEN 1.0e0 WHEN a < 0 THEN 0.0e0 ELSE a END AS h
  FROM (SELECT *, {_haversine("prev_lat", "prev_lon", "latitude", "longitude")} AS a
        FROM lagged) l
),
steps AS (
  SELECT *, CASE WHEN step_distance_km = 0 THEN 1 ELSE 0 END AS is_stuck
  FROM (SELECT *, 2 * 6371.0e0 * atan2(sqrt(h), sqrt(1 - h)) AS step_distance_km FROM arcs) d
)"""


STEPS = GPS + "," + _with_steps()

MATRIX = (
    STEPS
    + """,
matrix AS (
  SELECT city, user_id, round(km, 4) AS total_km, total_records, stuck_count,
    round(km * 100 - stuck_count * 20, 2) AS final_score
  FROM (SELECT city, user_id, sum(step_distance_km) AS km, count("timestamp") AS total_records,
          CAST(sum(is_stuck) AS BIGINT) AS stuck_count
        FROM steps GROUP BY city, user_id) g
)"""
)

DRIVERS = """
drivers AS (
  SELECT 'D_' || c_custkey AS driver_id,
    5.0e0 + (c_custkey * 37 % 4500) / 100.0e0 AS total_km,
    10.0e0 + (c_custkey * 53 % 700) / 10.0e0 AS average_speed,
    CAST(c_custkey * 7 % 10 AS INTEGER) AS stuck_count,
    CASE WHEN 10.0e0 + (c_custkey * 53 % 700) / 10.0e0 < 30 THEN 'Risk: Congested'
         WHEN 10.0e0 + (c_custkey * 53 % 700) / 10.0e0 > 60 THEN 'Good: Efficient'
         ELSE 'Normal: Average' END AS label
  FROM customer
)"""


def _with_scores(table: str, speed: str) -> str:
    return f"""
scored AS (
  SELECT *, CASE WHEN {speed} IS NULL THEN NULL
                 WHEN 2 * stuck_count >= {speed} THEN 'NEGATIVE' ELSE 'POSITIVE' END AS sentiment,
    CASE WHEN {speed} IS NOT NULL THEN round(greatest(p, 1 - p), 4) END AS score,
    CASE WHEN {speed} IS NULL THEN 'missing input' END AS error
  FROM (SELECT *, 1 / (1 + exp(-(stuck_count * 0.2e0 - {speed} * 0.1e0))) AS p FROM {table}) s
)"""


SCORED_DRIVERS = DRIVERS + "," + _with_scores("drivers", "average_speed")

REQUESTS = """
requests AS (
  SELECT event_id AS request_id, 'user_' || user_id AS driver_id,
    CASE WHEN event_type <> 'error' THEN 10.0e0 + event_id * 53 % 70 END AS speed,
    CAST(event_id * 7 % 26 AS INTEGER) AS stuck_count,
    CAST(floor(epoch(ts)) AS BIGINT) AS requested_at
  FROM events
)"""

RESULTS = (
    REQUESTS
    + ","
    + _with_scores("requests", "speed")
    + """,
results AS (
  SELECT request_id, driver_id,
    CASE WHEN error IS NULL THEN
      CASE WHEN sentiment = 'NEGATIVE' THEN 'High Risk' ELSE 'Safe' END END AS risk_level,
    score AS ai_confidence, error,
    CASE WHEN error IS NULL THEN 'Success' ELSE 'Failed' END AS status, requested_at
  FROM scored
)"""
)

PROVIDERS = (
    GPS
    + """,
a AS (
  SELECT event_id, CASE WHEN event_id % 40 <> 25 THEN latitude END AS latitude,
    CASE WHEN event_id % 40 <> 25 THEN longitude END AS longitude,
    CASE user_no % 3 WHEN 0 THEN 'Taipei' WHEN 1 THEN 'Hsinchu' ELSE 'Kaohsiung' END AS city
  FROM (SELECT *, CAST(substr(user_id, 6) AS BIGINT) AS user_no FROM gps) g
),
b AS (
  SELECT event_id, longitude AS b_lon,
    round(latitude + (event_id % 100) * CASE city WHEN 'Taipei' THEN 0.000001e0
            WHEN 'Hsinchu' THEN 0.00001e0 ELSE 0.000006e0 END, 7) AS b_lat
  FROM a
),
errors AS (
  SELECT event_id, city,
    CASE WHEN known THEN 2000 * 6371.0e0 * atan2(sqrt(h), sqrt(1 - h)) END AS error_meters
  FROM (SELECT a.event_id, city, latitude IS NOT NULL AND b_lat IS NOT NULL AS known, """
    + _haversine("latitude", "longitude", "b_lat", "b_lon")
    + """ AS h FROM a JOIN b USING (event_id)) j
),
summary AS (
  SELECT city, round(mean_error, 2) AS avg_error_meters, round(rate, 4) AS risk_rate, failed_records,
    CASE WHEN mean_error > 50 OR rate > 0.2 THEN 'RISKY'
         WHEN mean_error < 20 AND rate < 0.05 THEN 'SAFE' ELSE 'MONITOR' END AS verdict
  FROM (SELECT city, avg(error_meters) AS mean_error,
          avg(CASE WHEN error_meters > 50 THEN 1.0e0 WHEN error_meters <= 50 THEN 0.0e0 END) AS rate,
          count(*) FILTER (error_meters IS NULL) AS failed_records
        FROM errors GROUP BY city) g
),
lines AS (
  SELECT city, '{"city":"' || city || '","avg_error_meters":' || avg_error_meters
    || ',"risk_rate":' || risk_rate || ',"failed_records":' || failed_records
    || ',"verdict":"' || verdict || '"}' AS line
  FROM summary
)"""
)

ADVICE = f"""CASE WHEN sentiment = 'NEGATIVE' THEN '{fixed.INTERVIEW_ADVICE}'
       ELSE '{fixed.OBSERVE_ADVICE}' END"""
ACTION = f"""CASE WHEN sentiment = 'NEGATIVE' THEN '{fixed.INTERVIEW_ACTION}'
       ELSE '{fixed.OBSERVE_ACTION}' END"""
LEVEL = "CASE WHEN sentiment = 'NEGATIVE' THEN 'High Risk' ELSE 'Safe' END"
COLOUR = (
    "CASE label"
    + "".join(f" WHEN '{label}' THEN '{c}'" for label, c in fixed.LABEL_COLOURS.items())
    + f" ELSE '{fixed.UNKNOWN_COLOUR}' END"
)



def _lloyd(table: str, key: str, columns: list[str], scale: bool = True) -> str:
    """``placed(key, cluster)``: three centres from one deviation below the mean to one above, until they rest."""
    n = range(1, len(columns) + 1)
    value = "CASE WHEN s{0} > 0 THEN ({1} - m{0}) / s{0} ELSE 0.0e0 END" if scale else "CAST({1} AS DOUBLE)"
    start = "{1}.0e0" if scale else "m{0} + {1} * s{0}"
    far = [" + ".join(f"(v[{j}] - centres[{i}][{j}]) * (v[{j}] - centres[{i}][{j}])" for j in n) for i in (1, 2, 3)]
    near = f"CASE WHEN {far[0]} <= {far[1]} AND {far[0]} <= {far[2]} THEN 1 WHEN {far[1]} <= {far[2]} THEN 2 ELSE 3 END"
    gap = "greatest(" + ", ".join(f"abs(mean[{j}] - old[{j}])" for j in n) + ")"
    return f"""
moments AS (SELECT {", ".join(f"avg({c}) AS m{j}, stddev_pop({c}) AS s{j}" for j, c in zip(n, columns))} FROM {table}),
z AS (SELECT {key}, [{", ".join(value.format(j, c) for j, c in zip(n, columns))}] AS v FROM {table}, moments),
fit(round, centres, moved) AS (
  SELECT 0, [{", ".join("[" + ", ".join(start.format(j, i) for j in n) + "]" for i in (-1, 0, 1))}], 1.0e0 FROM moments
  UNION ALL
  SELECT round + 1, list(mean ORDER BY i), max({gap})
  FROM (
    SELECT round, k.i, centres[k.i] AS old,
      CASE WHEN count(v) > 0 THEN [{", ".join(f"avg(v[{j}])" for j in n)}] ELSE centres[k.i] END AS mean
    FROM (SELECT * FROM fit WHERE moved > 1e-9 AND round < 100) f CROSS JOIN range(1, 4) k(i)
    LEFT JOIN z ON {near} = k.i
    GROUP BY round, centres, k.i
  ) GROUP BY round
),
placed AS (
  SELECT {key}, CAST({near} - 1 AS INTEGER) AS cluster
  FROM z, (SELECT centres FROM fit ORDER BY round DESC LIMIT 1) f
)"""


def _labelled(table: str) -> str:
    """``labelled``: ``table`` with its ``placed`` clusters and their labels."""
    return f"""
joined AS (SELECT t.* EXCLUDE (cluster), p.cluster FROM (SELECT *, 0 AS cluster FROM {table}) t JOIN placed p USING (driver_id)),
means AS (SELECT cluster, avg(average_speed) AS mean FROM joined GROUP BY cluster),
labelled AS (
  SELECT *, CASE
    WHEN cluster = (SELECT cluster FROM means ORDER BY mean DESC, cluster LIMIT 1) THEN 'Good: Efficient'
    WHEN cluster = (SELECT cluster FROM means ORDER BY mean, cluster LIMIT 1) THEN 'Risk: Congested'
    ELSE 'Normal: Average' END AS label
  FROM joined
)"""


FEATURES = (
    STEPS
    + """,
features AS (
  SELECT user_id AS driver_id, km AS total_km, CASE WHEN hours > 0 THEN km / hours ELSE 0 END AS average_speed, stuck_count
  FROM (SELECT user_id, sum(step_distance_km) AS km, CAST(sum(is_stuck) AS BIGINT) AS stuck_count,
          (max("timestamp") - min("timestamp")) / 3600.0e0 AS hours
        FROM steps GROUP BY user_id) g
)"""
)
PLAIN_DRIVERS = DRIVERS + ",\nplain AS (SELECT * EXCLUDE (label) FROM drivers)"
RESTING = f"{FEATURES},{_lloyd('features', 'driver_id', fixed.DRIVER_FEATURES)},{_labelled('features')}"
LAST = """
last AS (
  SELECT user_id, "timestamp", latitude, longitude
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, event_id DESC) AS n
        FROM gps WHERE NOT (latitude = 0 AND longitude = 0)) g WHERE n = 1
)"""

POINT_COLUMNS = 'event_id, user_id, "timestamp", latitude, longitude, city'
STEP_QUERY = f"""WITH {STEPS}
SELECT event_id, user_id, city, round(step_distance_km, 6) AS step_distance_km, is_stuck FROM steps"""
MATRIX_QUERY = f"WITH {MATRIX} SELECT * FROM matrix"
SCORE_QUERY = f"""WITH {SCORED_DRIVERS}
SELECT driver_id, {LEVEL} AS risk_level, score AS ai_confidence FROM scored"""

ORACLE_SQL: dict[str, str] = {
    "decision_matrix": MATRIX_QUERY,
    "decision_matrix_ranked": f"""WITH {MATRIX}
SELECT *, row_number() OVER (ORDER BY final_score DESC, user_id, city) AS rank FROM matrix""",
    "top_drivers": f"""WITH {MATRIX}
SELECT * FROM matrix ORDER BY final_score DESC, user_id, city LIMIT 5""",
    "lag_points": f"""WITH {STEPS}
SELECT {POINT_COLUMNS}, prev_lat, prev_lon FROM lagged""",
    "step_distance": STEP_QUERY,
    "step_distance_split_tracks": STEP_QUERY,
    "haversine_asin": f"""WITH {STEPS}
SELECT event_id, round(2 * 6371.0e0 * asin(sqrt(h)), 6) AS asin_km,
  abs(2 * 6371.0e0 * asin(sqrt(h)) - step_distance_km) < 1e-9 AS agrees FROM steps""",
    "user_track": f"""WITH {STEPS}
SELECT event_id, "timestamp", latitude, longitude, round(step_distance_km, 6) AS km
FROM steps WHERE user_id = 'user_1'""",
    "city_points": f"""WITH {GPS}
SELECT {POINT_COLUMNS} FROM gps WHERE NOT (latitude = 0 AND longitude = 0) AND city = 'Taipei'""",
    "track_preview": f"""WITH {STEPS}
SELECT user_id, "timestamp", latitude, round(step_distance_km, 6) AS distance_km
FROM steps WHERE user_id = 'user_1' ORDER BY "timestamp", event_id LIMIT 15""",
    "track_markers": f"""WITH {STEPS}
SELECT user_id, CAST(point_no AS INTEGER) AS point_no, event_id, latitude, longitude
FROM lagged WHERE point_no IN (1, 16)""",
    "trajectory": f"""WITH {STEPS}
SELECT user_id, (point_no - 1) // 20 AS segment, count(*) AS n_points,
  string_agg(latitude || ' ' || longitude, ';' ORDER BY point_no) AS path
FROM lagged GROUP BY user_id, (point_no - 1) // 20""",
    "anomaly_split": f"""WITH {GPS}
SELECT event_id, user_id, city, latitude = 0 AND longitude = 0 AS is_anomaly FROM gps""",
    "geo_counts": f"""WITH {GPS}
SELECT city, count(*) FILTER (NOT (latitude = 0 AND longitude = 0)) AS normal_points,
  count(*) FILTER (latitude = 0 AND longitude = 0) AS anomaly_points FROM gps GROUP BY city""",
    "nan_robustness": f"""WITH {GPS},
damaged AS (
  SELECT event_id, user_id, "timestamp", longitude, city,
    CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 89 = 0 THEN NULL
         ELSE latitude END AS latitude
  FROM gps
),{_with_steps("damaged")}
SELECT count(*) AS total_rows,
  count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS null_inputs,
  count(*) FILTER (isnan(latitude) OR isnan(longitude)) AS nan_inputs,
  count(*) FILTER (isnan(step_distance_km)) AS nan_distances,
  count(*) FILTER (is_stuck = 1) AS stuck_rows
FROM steps""",
    "drift_points": f"""WITH {GPS},
homes AS (SELECT * FROM (VALUES ('Taipei', 25.033e0, 121.5654e0),
  ('Hsinchu', 24.8138e0, 120.9675e0)) v(city, home_lat, home_lon)),
apart AS (
  SELECT event_id, gps.city, {_haversine("home_lat", "home_lon", "latitude", "longitude")} AS h
  FROM gps LEFT JOIN homes ON gps.city = homes.city
),
away AS (SELECT *, 2 * 6371.0e0 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM apart)
SELECT event_id, city, round(km, 6) AS home_km, km > 100 AS is_drift FROM away""",
    "systematic_sample": f"""WITH {GPS},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY "timestamp", event_id) AS n
  FROM gps WHERE NOT (latitude = 0 AND longitude = 0)
)
SELECT city, (n - 1) // 10 + 1 AS sample_no, event_id, latitude, longitude
FROM numbered WHERE (n - 1) % 10 = 0 AND (n - 1) // 10 < 500""",
    "systematic_sample_all": f"""WITH {GPS},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY "timestamp", event_id) AS n
  FROM gps WHERE NOT (latitude = 0 AND longitude = 0)
)
SELECT city, (n - 1) // 10 + 1 AS sample_no, event_id, latitude, longitude
FROM numbered WHERE (n - 1) % 10 = 0""",
    "grid_density": f"""WITH {STEPS}
SELECT CAST(floor(latitude / 0.005e0) AS BIGINT) AS lat_cell,
  CAST(floor(longitude / 0.005e0) AS BIGINT) AS lon_cell, count(*) AS n_points,
  CAST(sum(is_stuck) AS BIGINT) AS stuck_count, round(avg(step_distance_km), 6) AS mean_step_km
FROM steps GROUP BY 1, 2""",
    "coverage_report": f"""WITH {GPS},
boxes AS (
  SELECT city, min(latitude) AS s, max(latitude) AS n, min(longitude) AS w, max(longitude) AS e
  FROM gps WHERE NOT (latitude = 0 AND longitude = 0) GROUP BY city
),
zoned AS (
  SELECT event_id, CASE WHEN latitude = 0 AND longitude = 0 THEN 'anomaly'
    WHEN (latitude - s) / (n - s) BETWEEN 0.15e0 AND 0.85e0
     AND (longitude - w) / (e - w) BETWEEN 0.15e0 AND 0.85e0 THEN 'core' ELSE 'edge' END AS zone
  FROM gps JOIN boxes USING (city)
)
SELECT zone, count(*) AS full_points, count(*) FILTER (event_id % 10 = 0) AS sampled_points,
  round(count(*) FILTER (event_id % 10 = 0) / count(*), 6) AS recall
FROM zoned GROUP BY zone""",
    "csv_roundtrip": f"WITH {GPS} SELECT {POINT_COLUMNS} FROM gps",
    "parquet_roundtrip": STEP_QUERY,
    "json_report_roundtrip": MATRIX_QUERY,
    "json_array_roundtrip": MATRIX_QUERY,
    "source_fallback": MATRIX_QUERY,
    "decision_matrix_split": MATRIX_QUERY,
    "partitioned_map": f"""WITH {REQUESTS},{_with_scores("requests", "speed")}
SELECT request_id, driver_id, sentiment, score, error FROM scored""",
    "provider_error": f"""WITH {PROVIDERS}
SELECT event_id, city, round(error_meters, 4) AS error_meters FROM errors""",
    "city_risk_summary": f"WITH {PROVIDERS} SELECT * FROM summary",
    "city_decision": f"""WITH {PROVIDERS}
SELECT *, CASE verdict WHEN 'SAFE' THEN 'Go' WHEN 'RISKY' THEN 'No-Go' ELSE 'Review' END
  AS decision FROM summary""",
    "risk_context": f"""WITH {PROVIDERS}
SELECT city, 'Switch in ' || city || '?' AS question,
  'Two map providers were compared on the same delivery records.' || chr(10)
  || 'Low risk: average error under 20 m and risk rate under 5 %. '
  || 'High risk: average error over 50 m or risk rate over 20 %. '
  || 'Anything between needs a manual review.' || chr(10)
  || 'Summary per city: [' || (SELECT string_agg(line, ',' ORDER BY city) FROM lines) || ']'
  || chr(10) || 'Question: Switch in ' || city || '?' || chr(10)
  || 'Give a Go or No-Go recommendation based on the summary.' AS prompt
FROM (SELECT DISTINCT city FROM a) c""",
    "city_contexts": f"WITH {PROVIDERS} SELECT city, line AS risk_context FROM lines",
    "driver_features": f"""WITH {STEPS}
SELECT user_id AS driver_id, round(km, 4) AS total_km,
  round(CASE WHEN hours > 0 THEN km / hours ELSE 0 END, 4) AS average_speed, stuck_count
FROM (SELECT user_id, sum(step_distance_km) AS km, CAST(sum(is_stuck) AS BIGINT) AS stuck_count,
        (max("timestamp") - min("timestamp")) / 3600.0e0 AS hours
      FROM steps GROUP BY user_id) g""",
    "standardised_features": f"""WITH {DRIVERS},
stats AS (
  SELECT avg(total_km) AS m1, stddev_pop(total_km) AS s1, avg(average_speed) AS m2,
    stddev_pop(average_speed) AS s2, avg(stuck_count) AS m3, stddev_pop(stuck_count) AS s3
  FROM drivers
)
SELECT driver_id, round((total_km - m1) / s1, 6) AS total_km_std,
  round((average_speed - m2) / s2, 6) AS average_speed_std,
  round((stuck_count - m3) / s3, 6) AS stuck_count_std
FROM drivers, stats""",
    "group_argminmax": """WITH means AS (
  SELECT event_type, avg(value) AS mean_value FROM events GROUP BY event_type)
SELECT (SELECT event_type FROM means ORDER BY mean_value, event_type LIMIT 1) AS lowest,
  (SELECT event_type FROM means ORDER BY mean_value DESC, event_type LIMIT 1) AS highest""",
    "speed_scatter": f"WITH {DRIVERS} SELECT average_speed, stuck_count, label FROM drivers",
    "driver_status_text": f"""WITH {DRIVERS}
SELECT driver_id,
  printf('Driver %s is traveling at %.1f km/h with %d stops.',
    driver_id, average_speed, stuck_count) AS stops_text,
  printf('Driver %s is driving at %.1f km/h with %d congestion events.',
    driver_id, average_speed, stuck_count) AS congestion_text,
  printf('%.2f km/h', average_speed) AS speed
FROM drivers""",
    "driver_risk_scores": SCORE_QUERY,
    "driver_risk_scores_batch": SCORE_QUERY,
    "risk_advice": f"""WITH {SCORED_DRIVERS}
SELECT driver_id, sentiment AS ai_sentiment, {LEVEL} AS risk_level,
  {ADVICE} AS management_advice FROM scored""",
    "matched_labels": f"""WITH {DRIVERS}
SELECT * FROM drivers WHERE regexp_matches(label, 'Risk|紅色', 'i')""",
    "risky_drivers": f"""WITH {DRIVERS}
SELECT * FROM drivers WHERE label LIKE 'Risk%' ORDER BY average_speed, driver_id LIMIT 5""",
    "risky_drivers_fallback": f"""WITH {DRIVERS}
SELECT * FROM drivers ORDER BY average_speed, driver_id LIMIT 3""",
    "risky_drivers_all": f"""WITH {DRIVERS}
SELECT * FROM drivers WHERE label LIKE 'Risk%'""",
    "labelled_groups": f"""WITH {DRIVERS},
grouped AS (SELECT *, stuck_count % 5 AS cluster FROM drivers),
means AS (SELECT cluster, avg(average_speed) AS mean FROM grouped GROUP BY cluster)
SELECT driver_id, cluster, CASE
  WHEN cluster = (SELECT cluster FROM means ORDER BY mean DESC, cluster LIMIT 1) THEN 'Good: Efficient'
  WHEN cluster = (SELECT cluster FROM means ORDER BY mean, cluster LIMIT 1) THEN 'Risk: Congested'
  ELSE 'Normal: Average' END AS label FROM grouped""",
    "slowest_drivers": f"""WITH {DRIVERS}
SELECT * FROM drivers ORDER BY average_speed, driver_id LIMIT 3""",
    "risk_insights": f"""WITH {SCORED_DRIVERS}
SELECT driver_id, label, printf('%.2f km/h', average_speed) AS speed,
  sentiment AS ai_sentiment, {ADVICE} AS management_advice
FROM scored WHERE label LIKE 'Risk%' ORDER BY average_speed, driver_id LIMIT 5""",
    "alert_actions": f"""WITH {SCORED_DRIVERS}
SELECT driver_id, label AS status, sentiment AS ai_sentiment,
  {ACTION} AS management_action
FROM scored WHERE label LIKE '%Risk%' ORDER BY average_speed, driver_id LIMIT 5""",
    "label_distribution": f"""WITH {DRIVERS}
SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM drivers), 6) AS share
FROM drivers GROUP BY label""",
    "fleet_kpis": f"""WITH {DRIVERS}
SELECT count(*) AS total_drivers, count(*) FILTER (label LIKE '%Risk%') AS high_risk_drivers,
  round(avg(average_speed), 4) AS average_speed FROM drivers""",
    "label_colours": f"WITH {DRIVERS} SELECT driver_id, label, {COLOUR} AS colour FROM drivers",
    "map_drivers": f"""WITH {DRIVERS}
SELECT driver_id, label, {COLOUR} AS colour FROM drivers
""",
    "stream_risk_scores": f"""WITH {RESULTS}
SELECT request_id, driver_id, risk_level, ai_confidence, error, status FROM results""",
    "request_status": f"""WITH {RESULTS}
SELECT requests.request_id, requests.driver_id,
  CASE status WHEN 'Success' THEN 'Success' WHEN 'Failed' THEN 'Failure' ELSE 'Pending' END
    AS status,
  risk_level, ai_confidence, error
FROM requests LEFT JOIN (
  SELECT * FROM results WHERE requested_at < (SELECT max(requested_at) - 86400 FROM requests)
) r ON requests.request_id = r.request_id""",
    "survivorship_report": f"""WITH {STEPS},
by_track AS (
  SELECT city, user_id, count(*) AS points, sum(is_stuck) AS stalls, sum(step_distance_km) AS km,
    count(*) FILTER (latitude = 0 AND longitude = 0) AS lost, count(*) <= 70 AS seen
  FROM steps GROUP BY city, user_id
)
SELECT city, count(*) AS tracks, count(*) FILTER (seen) AS seen_tracks,
  round(count(*) FILTER (seen) / count(*), 6) AS visible_rate, CAST(sum(points) AS BIGINT) AS points,
  CAST(coalesce(sum(points) FILTER (seen), 0) AS BIGINT) AS seen_points,
  round(sum(stalls) / sum(points), 6) AS stall_share,
  round(sum(stalls) FILTER (seen) / sum(points) FILTER (seen), 6) AS seen_stall_share,
  round(sum(km) / sum(points), 6) AS mean_step_km,
  round(sum(km) FILTER (seen) / sum(points) FILTER (seen), 6) AS seen_mean_step_km,
  round(sum(lost) / sum(points), 6) AS lost_share,
  round(sum(lost) FILTER (seen) / sum(points) FILTER (seen), 6) AS seen_lost_share
FROM by_track GROUP BY city""",
    "last_positions": f"WITH {GPS},{LAST} SELECT * FROM last",
    "question_decisions": f"""WITH {PROVIDERS},
questions AS (
  SELECT question_id, CASE question_id % 4
    WHEN 0 THEN 'Can we switch in taipei for user_' || question_id || '?'
    WHEN 1 THEN 'Hsinchu or KAOHSIUNG: which one first?'
    WHEN 2 THEN '我們在Taipei該換誰家 ' || question_id
    ELSE 'Is it safe to switch?' END AS question
  FROM (SELECT DISTINCT user_id AS question_id FROM events) e
)
SELECT question_id, question, city, avg_error_meters, risk_rate, verdict,
  CASE verdict WHEN 'SAFE' THEN 'Go' WHEN 'RISKY' THEN 'No-Go' ELSE 'Review' END AS decision
FROM questions LEFT JOIN summary ON contains(lower(question), lower(city))""",
    "resting_clusters": f"""WITH RECURSIVE {PLAIN_DRIVERS},{_lloyd("plain", "driver_id", fixed.DRIVER_FEATURES)},{_labelled("plain")}
SELECT driver_id, cluster, label FROM labelled""",
    "resting_clusters_unscaled": f"""WITH RECURSIVE {DRIVERS},{_lloyd("drivers", "driver_id", fixed.DRIVER_FEATURES, False)}
SELECT driver_id, cluster FROM placed""",
    "resting_step_clusters": f"""WITH RECURSIVE {STEPS},{_lloyd("steps", "event_id", fixed.STEP_FEATURES)}
SELECT event_id, cluster FROM placed""",
    "resting_driver_labels": f"WITH RECURSIVE {RESTING} SELECT driver_id, cluster, label FROM labelled",
    "cluster_report": f"""WITH RECURSIVE {DRIVERS},{_lloyd("drivers", "driver_id", fixed.DRIVER_FEATURES)}
SELECT cluster, count(*) AS n, round(avg(total_km), 4) AS mean_total_km, round(avg(average_speed), 4) AS mean_average_speed,
  round(avg(stuck_count), 4) AS mean_stuck_count,
  round((var_pop(total_km) + var_pop(average_speed) + var_pop(stuck_count)) * count(*), 4) AS squares
FROM drivers JOIN placed USING (driver_id) GROUP BY cluster""",
    "map_markers": f"""WITH RECURSIVE {RESTING},{LAST},{_with_scores("labelled", "average_speed")},
at_risk AS (SELECT * FROM scored WHERE label LIKE 'Risk%' ORDER BY average_speed, driver_id LIMIT 5),
slowest AS (SELECT * FROM scored ORDER BY average_speed, driver_id LIMIT 3),
advised AS (
  SELECT driver_id, {ADVICE} AS advice
  FROM (SELECT * FROM at_risk UNION ALL SELECT * FROM slowest WHERE NOT EXISTS (SELECT 1 FROM at_risk)) r
)
SELECT driver_id, latitude, longitude, label, {COLOUR} AS colour, printf('%.1f km/h', average_speed) AS speed,
  printf('%d times', stuck_count) AS stops, coalesce(advice, 'Analysis pending...') AS advice
FROM labelled LEFT JOIN last ON last.user_id = driver_id LEFT JOIN advised USING (driver_id)""",
}
