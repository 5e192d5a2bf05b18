"""The same queries as plain SQL for DuckDB, written independently of the operators."""

from __future__ import annotations

T = r"""
WITH src AS (
  SELECT event_id AS n, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         epoch_us(ts) - 1704067200000000 AS off
  FROM events),
b AS (
  SELECT *, (n * 7919 + 13) % 101 AS h, off // 259200000000 AS day,
         (off % 259200000000) // 432 AS w, user_id // 15 AS g
  FROM src),
b2 AS (
  SELECT *, CASE WHEN day >= 7 AND h IN (5, 6) THEN (user_id + 11) % 25 ELSE user_id % 25 END AS nk FROM b),
t AS (
  SELECT n AS seq, user_id, day, 'EVENT_' || lpad(CAST(n AS VARCHAR), 10, '0') AS event_id,
    'USER_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS entity_id,
    CASE user_id % 10 WHEN 0 THEN 'service_account' WHEN 1 THEN 'edge_device' ELSE 'user' END AS entity_type,
    1704067200000000 + day * 86400000000 + (9 + g % 5 + CASE WHEN h = 0 THEN 11 ELSE 0 END) * 3600000000 + w AS ts_us,
    '10.' || (g // 250) || '.' || (g % 250) || '.' || (k % 25 + 1) AS source_ip,
    upper(substr(n_name, 1, 2)) AS country_code, n_name AS city,
    CAST((nk * 7) % 120 - 60 AS DOUBLE) AS latitude, CAST((nk * 29) % 360 - 180 AS DOUBLE) AS longitude,
    CASE WHEN day >= 7 AND h BETWEEN 90 AND 97 THEN 'vault-' || (k % 4)
         ELSE 'res-' || ((n * 31 + k) % CASE WHEN user_id % 4 = 0 THEN 12 ELSE 4 END) END AS resource_accessed,
    CASE n % 6 WHEN 0 THEN 'password' WHEN 1 THEN 'sso' WHEN 2 THEN 'mfa' WHEN 3 THEN 'api_key'
         WHEN 4 THEN 'certificate' ELSE 'ssh_key' END AS auth_method,
    CASE WHEN event_type = 'error' OR (user_id % 7 = 0 AND day >= 7) THEN 'failure'
         WHEN event_type = 'signup' AND k % 10 = 0 THEN 'denied' ELSE 'success' END AS outcome,
    CAST(least(86400, floor(value * 60) * CASE WHEN h = 1 THEN 40 ELSE 1 END) AS INTEGER) AS session_duration_seconds,
    CAST(k % 4 AS INTEGER) AS command_count,
    CASE WHEN day >= 7 AND h = 3 THEN 'unknown_device'
         ELSE 'USER_' || lpad(CAST(user_id AS VARCHAR), 5, '0') || '_DEVICE_' || (n % 3 + 1) END AS fingerprint_id,
    CASE WHEN day >= 7 AND h = 2 THEN 'Android' ELSE 'macOS' END AS operating_system,
    'Firefox' AS browser, 'laptop' AS device_type,
    CASE WHEN h = 50 THEN NULL WHEN day >= 7 AND h = 2 THEN 'device_spoofing'
         WHEN day >= 7 AND h IN (5, 6) THEN 'impossible_travel'
         WHEN day >= 7 AND user_id % 7 = 0 THEN 'brute_force'
         WHEN day >= 7 AND h BETWEEN 90 AND 97 THEN 'lateral_movement' ELSE 'normal' END AS label,
    CAST(((9 + g % 5 + CASE WHEN h = 0 THEN 11 ELSE 0 END) + (w // 3600000000)) % 24 AS INTEGER) AS hour_of_day,
    CAST((ts_us // 86400000000 + 3) % 7 AS INTEGER) AS day_of_week,
    CAST(((9 + g % 5 + CASE WHEN h = 0 THEN 11 ELSE 0 END) + (w // 3600000000)) % 24 AS DOUBLE)
      + ((w // 60000000) % 60) / 60.0::DOUBLE AS fhour
  FROM b2 LEFT JOIN nation ON n_nationkey = nk),
p AS (SELECT * FROM t WHERE day BETWEEN 0 AND 3 AND coalesce(label, 'normal') = 'normal'),
s AS (SELECT * FROM t WHERE day >= 7),
st AS (
  SELECT entity_id, count(*) AS event_count, avg(fhour) AS mean_hour, stddev_pop(fhour) AS hour_std,
    avg(CAST(session_duration_seconds AS DOUBLE)) AS mean_session_duration,
    stddev_pop(CAST(session_duration_seconds AS DOUBLE)) AS session_duration_std,
    avg(CASE WHEN outcome = 'failure' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS authentication_failure_rate
  FROM p GROUP BY entity_id)
"""

DEV = """,
dev AS (
  SELECT x.*,
    CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.entity_id = x.entity_id AND p.source_ip = x.source_ip)
         THEN 0 ELSE 1 END AS is_new_ip,
    CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.entity_id = x.entity_id AND p.resource_accessed = x.resource_accessed)
         THEN 0 ELSE 1 END AS is_new_resource,
    CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.entity_id = x.entity_id AND p.fingerprint_id = x.fingerprint_id)
         THEN 0 ELSE 1 END AS is_new_device,
    CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.entity_id = x.entity_id AND p.fingerprint_id = x.fingerprint_id)
          AND NOT EXISTS (SELECT 1 FROM p WHERE p.entity_id = x.entity_id AND p.fingerprint_id = x.fingerprint_id
            AND p.operating_system IS NOT DISTINCT FROM x.operating_system
            AND p.browser IS NOT DISTINCT FROM x.browser AND p.device_type IS NOT DISTINCT FROM x.device_type)
         THEN 1 ELSE 0 END AS device_fingerprint_mismatch,
    least(abs(fhour - mean_hour), 24.0::DOUBLE - abs(fhour - mean_hour)) AS hour_deviation,
    abs(session_duration_seconds - mean_session_duration) AS session_duration_deviation,
    CASE WHEN hour_std > 0 THEN least(abs(fhour - mean_hour), 24.0::DOUBLE - abs(fhour - mean_hour)) / hour_std
         ELSE 0.0::DOUBLE END AS hour_deviation_zscore,
    CASE WHEN session_duration_std > 0 THEN abs(session_duration_seconds - mean_session_duration) / session_duration_std
         ELSE 0.0::DOUBLE END AS session_duration_deviation_zscore
  FROM {rows} x JOIN st USING (entity_id))
"""

HAVERSINE = (
    "12742.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + "
    "cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"
)


def windows(rows: str) -> str:
    """Window and travel columns of a CTE whose rows all see each other."""
    travel = HAVERSINE.replace("{a}lat", "plat").replace("{a}lon", "plon")
    travel = travel.replace("{b}lat", "latitude").replace("{b}lon", "longitude")
    return f""",
firsts AS (SELECT entity_id, ts_us, arg_min(latitude, seq) AS flat, arg_min(longitude, seq) AS flon
           FROM {rows} GROUP BY entity_id, ts_us),
prevs AS (SELECT entity_id, ts_us, lag(ts_us) OVER o AS pts, lag(flat) OVER o AS plat, lag(flon) OVER o AS plon
          FROM firsts WINDOW o AS (PARTITION BY entity_id ORDER BY ts_us)),
win0 AS (
  SELECT *,
    count(*) OVER e10 AS events_10m,
    count(*) FILTER (WHERE outcome = 'failure') OVER e10 AS failed_logins_10m,
    count(DISTINCT resource_accessed) OVER e30 AS unique_resources_30m,
    count(DISTINCT entity_id) OVER i10 AS source_ip_entity_fanout_10m
  FROM {rows}
  WINDOW e10 AS (PARTITION BY entity_id ORDER BY ts_us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW),
         e30 AS (PARTITION BY entity_id ORDER BY ts_us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW),
         i10 AS (PARTITION BY source_ip ORDER BY ts_us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW)),
win AS (
  SELECT win0.*, unique_resources_30m / 30.0::DOUBLE AS resource_access_velocity_30m,
    CASE WHEN pts IS NULL THEN 0.0::DOUBLE ELSE {travel} END AS distance_from_previous_km,
    CASE WHEN pts IS NULL THEN 0.0::DOUBLE ELSE {travel} / ((ts_us - pts) / 3600000000.0::DOUBLE) END AS implied_speed_kmh
  FROM win0 LEFT JOIN prevs USING (entity_id, ts_us))
"""


# the scoring days: their windows see the days before, or only each other
_AFTER_ALL = windows("t") + DEV.replace("{rows}", "(SELECT * FROM win WHERE day >= 7)")
_ALONE = windows("s") + DEV.replace("{rows}", "win")

FEATURES = T + _AFTER_ALL + """,
f AS (SELECT *, CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend,
        CASE WHEN outcome = 'failure' THEN 1 ELSE 0 END AS auth_failed FROM dev)
"""

MATRIX = """
SELECT event_id, entity_id, ts_us, label,
  round(hour_of_day::DOUBLE, 6) AS hour_of_day, round(day_of_week::DOUBLE, 6) AS day_of_week,
  round(is_weekend::DOUBLE, 6) AS is_weekend, round(auth_failed::DOUBLE, 6) AS auth_failed,
  round(session_duration_seconds::DOUBLE, 6) AS session_duration_seconds,
  round(command_count::DOUBLE, 6) AS command_count,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
  round(is_new_ip::DOUBLE, 6) AS is_new_ip, round(is_new_resource::DOUBLE, 6) AS is_new_resource,
  round(is_new_device::DOUBLE, 6) AS is_new_device,
  round(device_fingerprint_mismatch::DOUBLE, 6) AS device_fingerprint_mismatch,
  round(hour_deviation, 6) AS hour_deviation, round(hour_deviation_zscore, 6) AS hour_deviation_zscore,
  round(session_duration_deviation, 6) AS session_duration_deviation,
  round(session_duration_deviation_zscore, 6) AS session_duration_deviation_zscore,
  round(events_10m::DOUBLE, 6) AS events_10m, round(failed_logins_10m::DOUBLE, 6) AS failed_logins_10m,
  round(unique_resources_30m::DOUBLE, 6) AS unique_resources_30m,
  round(resource_access_velocity_30m, 6) AS resource_access_velocity_30m,
  round(source_ip_entity_fanout_10m::DOUBLE, 6) AS source_ip_entity_fanout_10m,
  round(distance_from_previous_km, 4) AS distance_from_previous_km,
  round(implied_speed_kmh, 3) AS implied_speed_kmh
FROM f
"""

_W = "CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"
_SPEED, _KM, _SCORE = _W.format(x="implied_speed_kmh"), _W.format(x="distance_from_previous_km"), _W.format(x="risk_score")

RISK = FEATURES + f""",
r0 AS (
  SELECT *,
    CASE WHEN failed_logins_10m >= 10 THEN 35.0 WHEN failed_logins_10m >= 5 THEN 20.0 ELSE 0.0 END::DOUBLE AS p1,
    CASE WHEN implied_speed_kmh >= 1000 THEN 45.0 WHEN implied_speed_kmh >= 500 THEN 25.0 ELSE 0.0 END::DOUBLE AS p2,
    CASE WHEN distance_from_previous_km >= 3000 THEN 10.0 ELSE 0.0 END::DOUBLE AS p3,
    CASE WHEN device_fingerprint_mismatch = 1 THEN 40.0 ELSE 0.0 END::DOUBLE AS p4,
    CASE WHEN source_ip_entity_fanout_10m >= 5 THEN 35.0 WHEN source_ip_entity_fanout_10m >= 3 THEN 20.0
         ELSE 0.0 END::DOUBLE AS p5,
    CASE WHEN unique_resources_30m >= 5 AND is_new_resource = 1 THEN 30.0 ELSE 0.0 END::DOUBLE AS p6,
    CASE WHEN resource_access_velocity_30m >= 0.2::DOUBLE THEN 10.0 ELSE 0.0 END::DOUBLE AS p7,
    CASE WHEN hour_deviation_zscore >= 3 THEN 10.0 ELSE 0.0 END::DOUBLE AS p8,
    CASE WHEN session_duration_deviation_zscore >= 3 THEN 10.0 ELSE 0.0 END::DOUBLE AS p9
  FROM f),
r AS (
  SELECT *, least(p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9, 80.0::DOUBLE) AS behavioral_contribution,
    0.0::DOUBLE AS ml_contribution,
    least(p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9, 80.0::DOUBLE) AS risk_score,
    CASE WHEN behavioral_contribution >= 80 THEN 'critical' WHEN behavioral_contribution >= 60 THEN 'high'
         WHEN behavioral_contribution >= 30 THEN 'medium' ELSE 'low' END AS severity,
    behavioral_contribution >= 30 AS is_suspicious,
    concat_ws('|',
      CASE WHEN p1 > 0 THEN failed_logins_10m || ' failed logins occurred within 10 minutes' END,
      CASE WHEN p2 = 45 THEN 'Travel between consecutive events would require ' || {_SPEED} || ' km/h'
           WHEN p2 = 25 THEN 'Unusually high travel speed of ' || {_SPEED} || ' km/h' END,
      CASE WHEN p3 > 0 THEN 'Consecutive activity occurred ' || {_KM} || ' km apart' END,
      CASE WHEN p4 > 0 THEN 'Known device identifier presented an unexpected fingerprint' END,
      CASE WHEN p5 = 35 THEN 'A single source IP accessed ' || source_ip_entity_fanout_10m || ' entities within 10 minutes'
           WHEN p5 = 20 THEN 'Source IP accessed multiple entities within a short period' END,
      CASE WHEN p6 > 0 THEN 'Entity rapidly accessed multiple resources including an unfamiliar resource' END,
      CASE WHEN p7 > 0 THEN 'Resource access velocity is unusually high' END,
      CASE WHEN p8 > 0 THEN 'Activity occurred far outside the entity''s typical access hours' END,
      CASE WHEN p9 > 0 THEN 'Session duration strongly deviates from the entity''s normal behavior' END,
      CASE WHEN p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9 = 0
           THEN 'No significant behavioral risk signals were observed' END) AS reasons
  FROM r0),
ex AS (
  SELECT *, upper(severity) || ' risk activity ' || CASE WHEN severity = 'low' THEN 'observed' ELSE 'detected' END
    || ' with a risk score of ' || {_SCORE} || '/100. ' ||
    CASE severity WHEN 'critical' THEN 'Immediate investigation is recommended.'
      WHEN 'high' THEN 'Multiple suspicious behavioral signals require investigation.'
      WHEN 'medium' THEN 'Behavioral deviations warrant review.'
      ELSE 'No significant threat indicators were detected.' END AS summary
  FROM r)
"""

CLASS = RISK + f""",
c0 AS (
  SELECT *,
    CASE WHEN failed_logins_10m >= 5 THEN 0.65::DOUBLE ELSE 0 END
      + CASE WHEN events_10m >= 6 THEN 0.20::DOUBLE ELSE 0 END AS s_bf,
    CASE WHEN source_ip_entity_fanout_10m >= 4 THEN 0.70::DOUBLE ELSE 0 END
      + CASE WHEN source_ip_entity_fanout_10m >= 4 AND failed_logins_10m >= 1 THEN 0.20::DOUBLE ELSE 0 END AS s_cs,
    CASE WHEN implied_speed_kmh >= 1000 THEN 0.75::DOUBLE ELSE 0 END
      + CASE WHEN distance_from_previous_km >= 3000 THEN 0.20::DOUBLE ELSE 0 END AS s_it,
    CASE WHEN unique_resources_30m >= 4 THEN 0.40::DOUBLE ELSE 0 END
      + CASE WHEN resource_access_velocity_30m >= 0.15::DOUBLE THEN 0.30::DOUBLE ELSE 0 END
      + CASE WHEN is_new_resource = 1 THEN 0.20::DOUBLE ELSE 0 END AS s_lm,
    CASE WHEN device_fingerprint_mismatch = 1 THEN 0.80::DOUBLE ELSE 0 END
      + CASE WHEN device_fingerprint_mismatch = 1 AND is_new_device = 1 THEN 0.10::DOUBLE ELSE 0 END AS s_ds
  FROM ex),
c AS (
  SELECT *, greatest(s_bf, s_cs, s_it, s_lm, s_ds) AS best,
    CASE WHEN NOT is_suspicious THEN 'normal' WHEN best < 0.40::DOUBLE THEN 'unknown'
      WHEN s_bf = best THEN 'brute_force' WHEN s_cs = best THEN 'credential_stuffing'
      WHEN s_it = best THEN 'impossible_travel' WHEN s_lm = best THEN 'lateral_movement'
      ELSE 'device_spoofing' END AS anomaly_type,
    CASE WHEN is_suspicious THEN least(best, 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS classification_confidence,
    CASE anomaly_type
      WHEN 'brute_force' THEN concat_ws('|',
        CASE WHEN failed_logins_10m >= 5 THEN failed_logins_10m || ' failed logins occurred within 10 minutes' END,
        CASE WHEN events_10m >= 6 THEN events_10m || ' events occurred within 10 minutes' END)
      WHEN 'credential_stuffing' THEN concat_ws('|',
        CASE WHEN source_ip_entity_fanout_10m >= 4
             THEN 'Source IP accessed ' || source_ip_entity_fanout_10m || ' entities within 10 minutes' END,
        CASE WHEN source_ip_entity_fanout_10m >= 4 AND failed_logins_10m >= 1
             THEN 'Multi-entity activity included authentication failures' END)
      WHEN 'impossible_travel' THEN concat_ws('|',
        CASE WHEN implied_speed_kmh >= 1000 THEN 'Travel would require ' || {_SPEED} || ' km/h' END,
        CASE WHEN distance_from_previous_km >= 3000 THEN 'Consecutive activity occurred ' || {_KM} || ' km apart' END)
      WHEN 'lateral_movement' THEN concat_ws('|',
        CASE WHEN unique_resources_30m >= 4
             THEN unique_resources_30m || ' unique resources were accessed within 30 minutes' END,
        CASE WHEN resource_access_velocity_30m >= 0.15::DOUBLE THEN 'Resource access velocity was unusually high' END,
        CASE WHEN is_new_resource = 1 THEN 'Entity accessed a resource outside its behavioral baseline' END)
      WHEN 'device_spoofing' THEN 'Known device ID presented a different fingerprint'
      ELSE '' END AS classification_evidence
  FROM c0),
al AS (
  SELECT *, substr(sha256(event_id), 1, 32) AS alert_id,
    CASE WHEN risk_score >= 85 THEN 'critical' WHEN risk_score >= 65 THEN 'high'
         WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END AS alert_severity
  FROM c WHERE is_suspicious)
"""

_TRUTH = "coalesce(label, 'None')"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


def _budget(fraction: str, total: str = "n") -> str:
    return RISK + f""",
ranked AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, event_id) AS rank,
             count(*) OVER () AS n FROM r),
cut AS (SELECT *, greatest(1, CAST(ceil(n * {fraction}::DOUBLE) AS BIGINT)) AS k,
          {_TRUTH} <> 'normal' AS attack FROM ranked),
agg AS (
  SELECT max(n) AS total_events, count(*) FILTER (WHERE attack) AS total_attacks, max(k) AS alert_count,
    count(*) FILTER (WHERE attack AND rank <= k) AS true_alerts,
    array_to_string(list_sort(list(DISTINCT {_TRUTH}) FILTER (WHERE attack AND rank <= k)), '|') AS types
  FROM cut)
SELECT total_events, total_attacks, {fraction}::DOUBLE AS budget_fraction, alert_count, true_alerts,
  alert_count - true_alerts AS false_alerts,
  round(true_alerts::DOUBLE / alert_count, 6) AS precision_at_budget,
  round({_ratio('true_alerts', 'total_attacks')}, 6) AS attack_recall_at_budget,
  round({_ratio('alert_count - true_alerts', 'total_events - total_attacks')}, 6) AS false_positive_rate,
  coalesce(types, '') AS attack_types_surfaced
FROM agg
"""


# Damaged payload fields; commands and labels as the JSON would carry them.
PAYLOAD = T + r""",
d AS (
  SELECT *, CASE WHEN seq % 509 < 4 THEN 23 + seq % 509 ELSE seq % 23 END AS damage FROM t),
j AS (
  SELECT seq, damage, city, longitude, operating_system, browser, device_type,
    event_id || CASE WHEN damage = 26 THEN repeat('x', 64) ELSE '' END AS event_id, entity_id, ts_us - CASE WHEN damage = 16 THEN 19800000000 ELSE 0 END AS ts_us,
    CASE WHEN damage = 16 THEN 330 ELSE 0 END AS tz_offset_minutes,
    damage <> 11 AS time_ok,
    CASE WHEN damage = 4 THEN 'robot' ELSE entity_type END AS entity_type,
    CASE damage WHEN 0 THEN 'not-an-ip' WHEN 14 THEN '2001:db8::' || (1 + seq % 9) ELSE source_ip END AS source_ip,
    CASE WHEN damage = 6 THEN lower(country_code) ELSE country_code END AS country_code,
    CASE WHEN damage = 1 THEN 200.0::DOUBLE ELSE latitude END AS latitude,
    resource_accessed || CASE damage WHEN 15 THEN '1' WHEN 17 THEN chr(233) ELSE '' END AS resource_accessed,
    auth_method, CASE WHEN damage = 2 THEN NULL ELSE outcome END AS outcome,
    CASE WHEN damage = 5 THEN -5 ELSE session_duration_seconds END AS session_duration_seconds,
    CASE WHEN damage = 10 THEN ['GET /profile', '']
         ELSE list_slice(['GET /profile', 'GET /projects', 'POST /run'], 1, command_count) END AS commands,
    fingerprint_id, CASE WHEN damage = 7 THEN 'zzz' ELSE label END AS label, damage = 3 AS extra
  FROM d),
v AS (
  SELECT *, CASE WHEN damage = 12 THEN 'not_serializable' WHEN damage = 13 THEN 'nesting_depth'
      WHEN damage = 23 THEN 'collection_items' WHEN damage = 24 THEN 'string_length' WHEN damage = 25 THEN 'payload_bytes' END AS guard,
    concat_ws('|',
      CASE WHEN outcome IS NULL THEN 'missing_outcome' END,
      CASE WHEN extra THEN 'unknown_field' END,
      CASE WHEN length(event_id) NOT BETWEEN 8 AND 64 THEN 'event_id' END,
      CASE WHEN entity_type NOT IN ('user', 'service_account', 'edge_device') THEN 'entity_type' END,
      CASE WHEN NOT time_ok THEN 'timestamp' END,
      CASE WHEN NOT regexp_full_match(source_ip, '[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9a-f:]+') THEN 'source_ip' END,
      CASE WHEN NOT regexp_full_match(country_code, '[A-Z]{2}') THEN 'country_code' END,
      CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude' END,
      CASE WHEN coalesce(outcome, '') NOT IN ('success', 'failure', 'denied') THEN 'outcome' END,
      CASE WHEN session_duration_seconds NOT BETWEEN 0 AND 86400 THEN 'session_duration_seconds' END,
      CASE WHEN list_contains(commands, '') THEN 'command_sequence' END,
      CASE WHEN label NOT IN ('normal', 'brute_force', 'impossible_travel', 'credential_stuffing', 'lateral_movement',
        'device_spoofing', 'low_slow_exfiltration', 'insider_drift') THEN 'label' END) AS schema_reasons
  FROM j)
"""

# Each failed or denied scoring event against all successful events and itself.
_HW = """,
hist AS (SELECT * FROM t WHERE outcome = 'success'),
tg AS (SELECT * FROM s WHERE outcome <> 'success'),
hwin0 AS (
  SELECT tg.event_id,
    1 + count(h.seq) FILTER (WHERE h.ts_us >= tg.ts_us - 600000000) AS events_10m,
    count(h.seq) FILTER (WHERE h.ts_us >= tg.ts_us - 600000000 AND h.outcome = 'failure')
      + max(CASE WHEN tg.outcome = 'failure' THEN 1 ELSE 0 END) AS failed_logins_10m,
    count(DISTINCT h.resource_accessed)
      + CASE WHEN coalesce(bool_or(h.resource_accessed = tg.resource_accessed), false) THEN 0 ELSE 1 END
      AS unique_resources_30m
  FROM tg LEFT JOIN hist h ON h.entity_id = tg.entity_id
    AND h.ts_us BETWEEN tg.ts_us - 1800000000 AND tg.ts_us
  GROUP BY tg.event_id),
hfan AS (
  SELECT tg.event_id, count(DISTINCT h.entity_id)
      + CASE WHEN coalesce(bool_or(h.entity_id = tg.entity_id), false) THEN 0 ELSE 1 END AS source_ip_entity_fanout_10m
  FROM tg LEFT JOIN hist h ON h.source_ip = tg.source_ip AND h.ts_us BETWEEN tg.ts_us - 600000000 AND tg.ts_us
  GROUP BY tg.event_id),
hprev AS (
  SELECT tg.event_id, arg_max(h.latitude, (h.ts_us, -h.seq)) AS plat, arg_max(h.longitude, (h.ts_us, -h.seq)) AS plon,
    max(h.ts_us) AS pts
  FROM tg JOIN hist h ON h.entity_id = tg.entity_id AND h.ts_us < tg.ts_us GROUP BY tg.event_id),
hwin AS (
  SELECT tg.*, events_10m, failed_logins_10m, unique_resources_30m, source_ip_entity_fanout_10m,
    unique_resources_30m / 30.0::DOUBLE AS resource_access_velocity_30m,
    CASE WHEN pts IS NULL THEN 0.0::DOUBLE ELSE {travel} END AS distance_from_previous_km,
    CASE WHEN pts IS NULL THEN 0.0::DOUBLE ELSE {travel} / ((ts_us - pts) / 3600000000.0::DOUBLE) END AS implied_speed_kmh
  FROM tg JOIN hwin0 USING (event_id) JOIN hfan USING (event_id) LEFT JOIN hprev USING (event_id))
""".replace(
    "{travel}",
    HAVERSINE.replace("{a}lat", "plat").replace("{a}lon", "plon").replace("{b}lat", "latitude").replace("{b}lon", "longitude"),
)

_ISO = "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"

ORACLES: dict[str, str] = {
    "event_features": T + """
SELECT event_id, entity_id, ts_us, hour_of_day, day_of_week,
  CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN outcome = 'failure' THEN 1 ELSE 0 END AS auth_failed,
  session_duration_seconds, command_count, latitude, longitude, operating_system, browser, device_type,
  resource_accessed, auth_method, source_ip, label FROM t
""",
    "event_export": T + f"""
SELECT event_id, entity_id, entity_type, {_ISO} AS timestamp, source_ip, resource_accessed, auth_method, outcome,
  session_duration_seconds,
  CASE command_count WHEN 0 THEN '[]' WHEN 1 THEN '["GET /profile"]' WHEN 2 THEN '["GET /profile","GET /projects"]'
    ELSE '["GET /profile","GET /projects","POST /run"]' END AS command_sequence, label,
  '{{"country_code":"' || country_code || '","city":"' || city || '","latitude":' || latitude || ',"longitude":' || longitude
    || '}}' AS geo_location,
  '{{"fingerprint_id":"' || fingerprint_id || '","operating_system":"' || operating_system || '","browser":"' || browser
    || '","device_type":"' || device_type || '"}}' AS device_fingerprint
FROM t
""",
    "profile_stats": T + """
SELECT entity_id, event_count, round(mean_hour, 6) AS mean_hour, round(hour_std, 6) AS hour_std,
  round(mean_session_duration, 6) AS mean_session_duration, round(session_duration_std, 6) AS session_duration_std,
  round(authentication_failure_rate, 6) AS authentication_failure_rate,
  mean_hour BETWEEN 0 AND 23 AS profile_valid
FROM st
""",
    "profile_sets": T + """
SELECT DISTINCT entity_id, 'source_ip' AS kind, source_ip AS value FROM p
UNION ALL SELECT DISTINCT entity_id, 'resource', resource_accessed FROM p
UNION ALL SELECT DISTINCT entity_id, 'auth_method', auth_method FROM p
UNION ALL SELECT DISTINCT entity_id, 'device',
  fingerprint_id || '|' || operating_system || '|' || browser || '|' || device_type FROM p
""",
    "profile_set_sizes": T + """
SELECT entity_id, 'source_ip' AS kind, count(DISTINCT source_ip) AS n_values FROM p GROUP BY entity_id
UNION ALL SELECT entity_id, 'resource', count(DISTINCT resource_accessed) FROM p GROUP BY entity_id
UNION ALL SELECT entity_id, 'auth_method', count(DISTINCT auth_method) FROM p GROUP BY entity_id
UNION ALL SELECT entity_id, 'device',
  count(DISTINCT fingerprint_id || '|' || operating_system) FROM p GROUP BY entity_id
""",
    "deviation_features": T + DEV.replace("{rows}", "s") + """
SELECT event_id, is_new_ip, is_new_resource, is_new_device, device_fingerprint_mismatch,
  round(hour_deviation, 6) AS hour_deviation, round(hour_deviation_zscore, 6) AS hour_deviation_zscore,
  round(session_duration_deviation, 6) AS session_duration_deviation,
  round(session_duration_deviation_zscore, 6) AS session_duration_deviation_zscore
FROM dev
""",
    "unknown_entities": T + """
SELECT event_id, entity_id FROM s
WHERE entity_id NOT IN (SELECT entity_id FROM p WHERE entity_type <> 'edge_device')
""",
    "window_counts": T + windows("t") + "SELECT event_id, events_10m, failed_logins_10m FROM win",
    "window_distinct": T + windows("t") + """
SELECT event_id, unique_resources_30m, round(resource_access_velocity_30m, 6) AS resource_access_velocity_30m,
  source_ip_entity_fanout_10m FROM win
""",
    "travel_features": T + windows("t") + """
SELECT event_id, round(distance_from_previous_km, 4) AS distance_from_previous_km,
  round(implied_speed_kmh, 3) AS implied_speed_kmh FROM win
""",
    "great_circle": f"""
WITH lines AS (
  SELECT s_nationkey AS supplier_nation, c_nationkey AS customer_nation,
    CAST((s_nationkey * 7) % 120 - 60 AS DOUBLE) AS alat, CAST((s_nationkey * 29) % 360 - 180 AS DOUBLE) AS alon,
    CAST((c_nationkey * 7) % 120 - 60 AS DOUBLE) AS blat, CAST((c_nationkey * 29) % 360 - 180 AS DOUBLE) AS blon,
    (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0::DOUBLE AS hours
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN customer ON c_custkey = o_custkey),
far AS (SELECT *, {HAVERSINE.format(a='a', b='b')} AS distance FROM lines)
SELECT supplier_nation, customer_nation, count(*) AS n_lines, round(max(distance), 4) AS distance_km,
  round(max(CASE WHEN hours > 0 THEN distance / hours ELSE 0.0::DOUBLE END), 4) AS max_speed_kmh
FROM far GROUP BY supplier_nation, customer_nation
""",
    "feature_matrix": FEATURES + MATRIX,
    "history_only_features": T + _HW + DEV.replace("{rows}", "hwin") + """,
f AS (SELECT *, CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend,
        CASE WHEN outcome = 'failure' THEN 1 ELSE 0 END AS auth_failed FROM dev)
""" + MATRIX,
    "id_collisions": T + """
SELECT event_id, entity_id FROM s WHERE event_id IN (SELECT event_id FROM t WHERE outcome = 'failure')
""",
    "missing_values": FEATURES + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE (hour_of_day + day_of_week + is_weekend + auth_failed
  + session_duration_seconds + command_count + latitude + longitude + is_new_ip + is_new_resource + is_new_device
  + device_fingerprint_mismatch + hour_deviation + hour_deviation_zscore + session_duration_deviation
  + session_duration_deviation_zscore + events_10m + failed_logins_10m + unique_resources_30m
  + resource_access_velocity_30m + source_ip_entity_fanout_10m + distance_from_previous_km + implied_speed_kmh)
  IS NULL) AS rows_with_missing FROM f
""",
    "risk_scores": RISK + """
SELECT event_id, behavioral_contribution, ml_contribution, risk_score, severity, is_suspicious FROM r
""",
    "risk_reasons": RISK + "SELECT event_id, reasons FROM r",
    "anomaly_types": CLASS + "SELECT event_id, anomaly_type, classification_confidence FROM c",
    "class_evidence": CLASS + "SELECT event_id, anomaly_type, classification_evidence FROM c",
    "explanations": RISK + "SELECT event_id, entity_id, risk_score, severity, summary FROM ex",
    "rule_assessments": CLASS + """
SELECT event_id, entity_id, risk_score, severity, is_suspicious, summary, reasons, -0.1::DOUBLE AS ml_anomaly_score,
  false AS ml_flagged, ml_contribution, behavioral_contribution, anomaly_type, classification_confidence,
  classification_evidence FROM c
""",
    "alerts": CLASS + """
SELECT alert_id, event_id, risk_score AS score, classification_confidence AS confidence, alert_severity AS severity,
  anomaly_type AS classification,
  concat_ws('|',
    CASE WHEN p1 > 0 THEN 'failed_logins_10m=' || CAST(p1 AS INTEGER) END,
    CASE WHEN p2 > 0 THEN 'implied_speed_kmh=' || CAST(p2 AS INTEGER) END,
    CASE WHEN p3 > 0 THEN 'distance_from_previous_km=' || CAST(p3 AS INTEGER) END,
    CASE WHEN p4 > 0 THEN 'device_fingerprint_mismatch=' || CAST(p4 AS INTEGER) END,
    CASE WHEN p5 > 0 THEN 'source_ip_entity_fanout_10m=' || CAST(p5 AS INTEGER) END,
    CASE WHEN p6 > 0 THEN 'unique_resources_30m=' || CAST(p6 AS INTEGER) END,
    CASE WHEN p7 > 0 THEN 'resource_access_velocity_30m=' || CAST(p7 AS INTEGER) END,
    CASE WHEN p8 > 0 THEN 'hour_deviation_zscore=' || CAST(p8 AS INTEGER) END,
    CASE WHEN p9 > 0 THEN 'session_duration_deviation_zscore=' || CAST(p9 AS INTEGER) END) AS evidence,
  'open' AS status FROM al
""",
    "alerts_by_severity": CLASS + """
SELECT alert_severity AS severity, anomaly_type AS classification, count(*) AS n_alerts, max(risk_score) AS max_score
FROM al GROUP BY alert_severity, anomaly_type
""",
    "alert_checks": CLASS + """
SELECT alert_id, CASE WHEN severity <> alert_severity THEN 'severity_bucket' ELSE '' END AS violations FROM al
""",
    "risk_checks": CLASS + """
SELECT event_id, concat_ws('|', CASE WHEN risk_score + 30 > 100 THEN 'score_range' END,
  CASE WHEN severity <> CASE WHEN risk_score + 30 >= 85 THEN 'critical' WHEN risk_score + 30 >= 65 THEN 'high'
    WHEN risk_score + 30 >= 35 THEN 'medium' ELSE 'low' END THEN 'severity_bucket' END) AS violations
FROM c
""",
    "entity_checks": """
SELECT c_custkey, concat_ws('|', CASE WHEN c_acctbal < 0 THEN 'entity_id_characters' END,
  CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY', 'AUTOMOBILE') THEN 'entity_type' END,
  CASE WHEN length(c_mktsegment) * c_nationkey > 64 THEN 'peer_group_length' END) AS violations
FROM customer
""",
    "detector_metrics": RISK + f""",
m AS (SELECT is_suspicious AS hit, {_TRUTH} <> 'normal' AS attack FROM r),
q AS (SELECT count(*) FILTER (WHERE hit AND attack) AS tp, count(*) FILTER (WHERE hit AND NOT attack) AS fp,
        count(*) FILTER (WHERE NOT hit AND NOT attack) AS tn, count(*) FILTER (WHERE NOT hit AND attack) AS fn FROM m),
z AS (SELECT *, {_ratio('tp', 'tp + fp')} AS pr, {_ratio('tp', 'tp + fn')} AS re FROM q)
SELECT tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
  round(pr, 6) AS precision, round(re, 6) AS recall, round({_ratio('2 * pr * re', 'pr + re')}, 6) AS f1_score,
  round({_ratio('fp', 'fp + tn')}, 6) AS false_positive_rate FROM z
""",
    "attack_metrics": RISK + f"""
SELECT {_TRUTH} AS attack_type, count(*) AS total, count(*) FILTER (WHERE is_suspicious) AS detected,
  round(count(*) FILTER (WHERE is_suspicious)::DOUBLE / count(*), 6) AS detection_rate,
  round(avg(risk_score), 6) AS mean_anomaly_score
FROM r WHERE {_TRUTH} <> 'normal' GROUP BY 1
""",
    "classification_accuracy": CLASS + f"""
SELECT coalesce(e, 'overall') AS expected, total, correct, round(correct::DOUBLE / total, 6) AS accuracy FROM (
  SELECT {_TRUTH} AS e, count(*) AS total, count(*) FILTER (WHERE {_TRUTH} = anomaly_type) AS correct
  FROM c GROUP BY ROLLUP ({_TRUTH}))
""",
    "label_rate": T + f"""
SELECT count(*) AS total_events, count(*) FILTER (WHERE {_TRUTH} <> 'normal') AS malicious_events,
  round(count(*) FILTER (WHERE {_TRUTH} <> 'normal')::DOUBLE / count(*), 6) AS anomaly_rate FROM t
""",
    "alert_budget": _budget("0.01"),
    "alert_budget_wide": _budget("0.07"),
    "top_alerts": RISK + "SELECT event_id, risk_score, label FROM r ORDER BY risk_score DESC, event_id LIMIT 500",
    "ingest_accepted": PAYLOAD + """
SELECT event_id, entity_id, entity_type, ts_us, tz_offset_minutes, source_ip, country_code, city, latitude, longitude,
  resource_accessed, auth_method, outcome, session_duration_seconds, array_to_string(commands, '|') AS commands,
  fingerprint_id, operating_system, browser, device_type, label
FROM v WHERE guard IS NULL AND schema_reasons = ''
""",
    "ingest_rejected": PAYLOAD + """
SELECT seq AS ingest_seq, CASE WHEN guard IS NOT NULL THEN 'guard' ELSE 'schema' END AS reject_stage,
  coalesce(guard, schema_reasons) AS reasons
FROM v WHERE guard IS NOT NULL OR schema_reasons <> ''
""",
    "deduplicate": T + "SELECT event_id, outcome, seq AS ingest_seq FROM t",
}

_HISTORY = (
    T
    + _HW.replace("t WHERE outcome = 'success'", "t WHERE day <= 6").replace("s WHERE outcome <> 'success'", "s")
    + DEV.replace("{rows}", "hwin")
    + """,
f AS (SELECT *, CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend,
        CASE WHEN outcome = 'failure' THEN 1 ELSE 0 END AS auth_failed FROM dev)
"""
)
ORACLES["assess_history"] = ORACLES["rule_assessments"].replace(FEATURES, _HISTORY)
# The verdict flags more than 6 events in 10 minutes; its score is a fortieth of the excess.
_POINTS = "least(p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9, 80.0::DOUBLE)"
_VERDICT = CLASS
for _old, _new in (
    (
        "0.0::DOUBLE AS ml_contribution",
        "CASE WHEN events_10m > 6 THEN least(10.0::DOUBLE + (events_10m - 6) * 2.5::DOUBLE, 20.0::DOUBLE) "
        "WHEN events_10m >= 5 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS ml_contribution",
    ),
    (f"{_POINTS} AS risk_score", f"least({_POINTS} + ml_contribution, 100.0::DOUBLE) AS risk_score"),
    ("WHEN behavioral_contribution >=", "WHEN risk_score >="),
    ("behavioral_contribution >= 30 AS is_suspicious", "risk_score >= 30 AS is_suspicious"),
    (
        "CASE WHEN p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9 = 0\n",
        "CASE WHEN events_10m > 6 THEN 'Isolation Forest classified the event as statistically anomalous' END,\n"
        "      CASE WHEN events_10m <= 6 AND p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9 = 0\n",
    ),
):
    _VERDICT = _VERDICT.replace(_old, _new)
ORACLES["risk_with_verdict"] = _VERDICT + """
SELECT event_id, behavioral_contribution, round(ml_contribution, 6) AS ml_contribution,
  round(risk_score, 6) AS risk_score, severity, is_suspicious, reasons, anomaly_type FROM c
"""
ORACLES["score_quantiles"] = RISK + """
SELECT q, round(risk_score, 6) AS risk_score FROM (
  SELECT 0.5::DOUBLE AS q, quantile_cont(risk_score, 0.5) AS risk_score FROM r
  UNION ALL SELECT 0.9::DOUBLE, quantile_cont(risk_score, 0.9) FROM r
  UNION ALL SELECT 0.99::DOUBLE, quantile_cont(risk_score, 0.99) FROM r)
"""
ORACLES["stream_assessments"] = ORACLES["rule_assessments"].replace(_AFTER_ALL, _ALONE)
ORACLES["stream_windows"] = T + windows("t") + """
SELECT event_id, events_10m, failed_logins_10m, unique_resources_30m, source_ip_entity_fanout_10m,
  round(distance_from_previous_km, 4) AS distance_from_previous_km, round(implied_speed_kmh, 3) AS implied_speed_kmh
FROM win
"""
# late: held back beyond the watermark (milliseconds) that the other events of the first six days set
ORACLES["stream_late"] = T + """,
x AS (SELECT *, ts_us < 1704067200000000 + 6 * 86400000000 AS early, seq % 50 = 0 AS held FROM t),
m AS (SELECT max(ts_us) // 1000 - 600000 AS passed FROM x WHERE early AND NOT held),
y AS (SELECT x.*, coalesce(early AND held AND ts_us // 1000 + 1 <= passed, false) AS late FROM x, m),
k AS (SELECT * FROM y WHERE NOT late)""" + windows("k") + """
SELECT event_id, events_10m, unique_resources_30m, source_ip_entity_fanout_10m, false AS late FROM win
UNION ALL SELECT event_id, NULL, NULL, NULL, true FROM y WHERE late
"""
_WALKED = (
    "[hour_of_day, day_of_week, session_duration_seconds, command_count, latitude, longitude, events_10m, "
    "failed_logins_10m, unique_resources_30m, source_ip_entity_fanout_10m]::DOUBLE[]"
)
ORACLES["forest_walk"] = FEATURES.replace("WITH src", "WITH RECURSIVE src", 1) + f""",
v AS (SELECT event_id, {_WALKED} AS x FROM f),
ends AS (SELECT i, min(x[i + 1]) AS low, max(x[i + 1]) AS high FROM v, (SELECT unnest(range(0, 10)) AS i) GROUP BY i),
cuts AS (SELECT t, slot, (7 * t + 3 * slot) % 10 AS i, low + (high - low) * (((31 * t + 17 * slot) % 101) / 101.0::DOUBLE) AS cut
         FROM (SELECT unnest(range(0, 12)) AS t), (SELECT unnest(range(0, 31)) AS slot), ends WHERE ends.i = (7 * t + 3 * slot) % 10),
walk AS (SELECT event_id, x, t, 0 AS level, 0::BIGINT AS slot FROM v, (SELECT unnest(range(0, 12)) AS t)
         UNION ALL
         SELECT event_id, x, w.t, level + 1, 2 * w.slot + 1 + CASE WHEN x[i + 1] > cut THEN 1 ELSE 0 END
         FROM walk w JOIN cuts c ON c.t = w.t AND c.slot = w.slot WHERE level < 5)
SELECT event_id, round(sum((slot % 7 + t) / 2.0::DOUBLE) / 12, 6) AS mean_path FROM walk WHERE level = 5 GROUP BY event_id
"""
ORACLES["forest_nodes"] = T + """,
m AS (SELECT count(*) AS n FROM t WHERE day BETWEEN 4 AND 6 AND entity_id IN (SELECT entity_id FROM p))
SELECT tree_id::INT AS tree_id, 1::BIGINT AS roots, least(n, 256)::BIGINT AS leaf_rows, true AS bounded, 0::BIGINT AS unbalanced
FROM m, (SELECT unnest(range(0, 200)) AS tree_id)
"""
ORACLES["baseline_merged"] = ORACLES["profile_stats"]
ORACLES["baseline_merged_sets"] = ORACLES["profile_sets"]
ORACLES["alerts_written"] = CLASS + """
SELECT alert_id, event_id, risk_score AS score, anomaly_type AS classification, 'open' AS status FROM al
"""
ORACLES["sql_views"] = CLASS + """
SELECT day::INT AS day, anomaly_type, count(*) AS n_events, count(DISTINCT entity_id) AS n_entities, max(risk_score) AS max_risk,
  count(*) FILTER (WHERE label = 'normal') AS labelled_normal
FROM c WHERE is_suspicious GROUP BY ALL
"""
# a sketch of so few values is exact; the bound of 3 % is checked by the estimates being equal
ORACLES["fanout_sketch"] = T + """,
q AS (SELECT DISTINCT source_ip, entity_id, ts_us // 60000000 AS minute FROM t),
w AS (SELECT DISTINCT source_ip, minute FROM q)
SELECT w.source_ip, w.minute, count(DISTINCT q.entity_id) AS entities
FROM w JOIN q ON q.source_ip = w.source_ip AND q.minute BETWEEN w.minute - 10 AND w.minute GROUP BY ALL
"""
