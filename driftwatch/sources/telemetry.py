"""`security_events` derived from the click-stream tables, by integer arithmetic only.

The source has no network, place or device fields, so each is a fixed function of the
event id, user id and payload. Days 0-3 are the profile period, 4-6 the training period
and 7-9 the scoring period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwatch.functions.clock import DAY_US, HOUR_US

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
SOURCE_DAY_US = 259_200_000_000  # three source days become one synthetic day
SQUEEZE = 432  # and its activity happens within ten minutes

PROFILE_DAYS = (0, 3)
TRAIN_DAYS = (4, 6)
SCORE_DAYS = (7, 2**31)  # every later day, however long the table


def telemetry(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Nested `security_events` plus `day`, `ingest_seq` and the source `user_id`.

    `source` replaces the event table, for example by a stream of it.
    """
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(
        "cast(n_nationkey AS bigint) AS nk", "n_name"
    )
    if source is None:
        source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = source.selectExpr(
        "event_id AS n",
        "user_id",
        "event_type",
        "value",
        "cast(get_json_object(props, '$.k') AS bigint) AS k",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts AS timestamp_ntz)) AS off",
        "(event_id * 7919 + 13) % 101 AS h",
        f"(off - pmod(off, {SOURCE_DAY_US})) div {SOURCE_DAY_US} AS day",
        f"pmod(off, {SOURCE_DAY_US}) div {SQUEEZE} AS w",
        "user_id div 15 AS g",
        "day >= 7 AS late",
        "CASE WHEN late AND h IN (5, 6) THEN (user_id + 11) % 25 ELSE user_id % 25 END AS nk",
    )
    entity = "concat('USER_', lpad(cast(user_id AS string), 5, '0'))"
    return source.join(nation, "nk", "left").selectExpr(
        "concat('EVENT_', lpad(cast(n AS string), 10, '0')) AS event_id",
        f"{entity} AS entity_id",
        "CASE user_id % 10 WHEN 0 THEN 'service_account' WHEN 1 THEN 'edge_device' ELSE 'user' END AS entity_type",
        f"timestamp_micros({EPOCH_US} + day * {DAY_US} + (9 + g % 5 + IF(h = 0, 11, 0)) * {HOUR_US} + w) "
        "AS timestamp",
        "concat('10.', g div 250, '.', g % 250, '.', k % 25 + 1) AS source_ip",
        "named_struct('country_code', upper(substr(n_name, 1, 2)), 'city', n_name, "
        "'latitude', cast((nk * 7) % 120 - 60 AS double), "
        "'longitude', cast((nk * 29) % 360 - 180 AS double)) AS geo_location",
        "CASE WHEN late AND h BETWEEN 90 AND 97 THEN concat('vault-', k % 4) "
        "ELSE concat('res-', (n * 31 + k) % IF(user_id % 4 = 0, 12, 4)) END AS resource_accessed",
        "CASE n % 6 WHEN 0 THEN 'password' WHEN 1 THEN 'sso' WHEN 2 THEN 'mfa' "
        "WHEN 3 THEN 'api_key' WHEN 4 THEN 'certificate' ELSE 'ssh_key' END AS auth_method",
        "CASE WHEN event_type = 'error' OR (user_id % 7 = 0 AND late) THEN 'failure' "
        "WHEN event_type = 'signup' AND k % 10 = 0 THEN 'denied' ELSE 'success' END AS outcome",
        "cast(least(86400, floor(value * 60) * IF(h = 1, 40, 1)) AS int) AS session_duration_seconds",
        "slice(array('GET /profile', 'GET /projects', 'POST /run'), 1, cast(k % 4 AS int)) AS command_sequence",
        f"named_struct('fingerprint_id', CASE WHEN late AND h = 3 THEN 'unknown_device' "
        f"ELSE concat({entity}, '_DEVICE_', n % 3 + 1) END, "
        "'operating_system', IF(late AND h = 2, 'Android', 'macOS'), "
        "'browser', 'Firefox', 'device_type', 'laptop') AS device_fingerprint",
        "CASE WHEN h = 50 THEN NULL WHEN late AND h = 2 THEN 'device_spoofing' "
        "WHEN late AND h IN (5, 6) THEN 'impossible_travel' "
        "WHEN late AND user_id % 7 = 0 THEN 'brute_force' "
        "WHEN late AND h BETWEEN 90 AND 97 THEN 'lateral_movement' ELSE 'normal' END AS label",
        "cast(day AS int) AS day",
        "n AS ingest_seq",
        "user_id",
    )


def split(events: DataFrame, days: tuple[int, int]) -> DataFrame:
    return events.filter(f"day BETWEEN {days[0]} AND {days[1]}")


def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(telemetry(spark, sf_dir), PROFILE_DAYS)


def training_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(telemetry(spark, sf_dir), TRAIN_DAYS)


def scoring_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(telemetry(spark, sf_dir), SCORE_DAYS)
