"""Table schemas, enumerations and the working column set of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftwatch.functions.clock import MINUTE_US

# Enumerations and feature order of the data model.
ENTITY_TYPES = ("user", "service_account", "edge_device")
AUTH_METHODS = ("password", "sso", "mfa", "api_key", "certificate", "ssh_key")
OUTCOMES = ("success", "failure", "denied")
LABELS = (
    "normal",
    "brute_force",
    "impossible_travel",
    "credential_stuffing",
    "lateral_movement",
    "device_spoofing",
    "low_slow_exfiltration",
    "insider_drift",
)
SEVERITIES = ("low", "medium", "high", "critical")
ALERT_STATUSES = ("open", "investigating", "confirmed_threat", "false_positive", "suppressed")
MODEL_FEATURES = (
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "auth_failed",
    "session_duration_seconds",
    "command_count",
    "latitude",
    "longitude",
    "is_new_ip",
    "is_new_resource",
    "is_new_device",
    "device_fingerprint_mismatch",
    "hour_deviation",
    "hour_deviation_zscore",
    "session_duration_deviation",
    "session_duration_deviation_zscore",
    "events_10m",
    "failed_logins_10m",
    "unique_resources_30m",
    "resource_access_velocity_30m",
    "source_ip_entity_fanout_10m",
    "distance_from_previous_km",
    "implied_speed_kmh",
)
# End of fixed values.

GEO_SCHEMA = T.StructType(
    [
        T.StructField("country_code", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)
DEVICE_SCHEMA = T.StructType(
    [
        T.StructField("fingerprint_id", T.StringType()),
        T.StructField("operating_system", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("device_type", T.StringType()),
    ]
)
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("geo_location", GEO_SCHEMA),
        T.StructField("resource_accessed", T.StringType()),
        T.StructField("auth_method", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("session_duration_seconds", T.IntegerType()),
        T.StructField("command_sequence", T.ArrayType(T.StringType())),
        T.StructField("device_fingerprint", DEVICE_SCHEMA),
        T.StructField("label", T.StringType()),
    ]
)

# Flat working columns every operator reads. `seq` orders events that share a timestamp.
FLAT_COLUMNS = (
    "event_id",
    "entity_id",
    "ts_us",
    "local_us",
    "seq",
    "source_ip",
    "resource_accessed",
    "auth_method",
    "outcome",
    "session_duration_seconds",
    "command_count",
    "latitude",
    "longitude",
    "fingerprint_id",
    "operating_system",
    "browser",
    "device_type",
    "label",
)


def flat_events(events: DataFrame) -> DataFrame:
    """Narrow projection of `security_events` that the operators share; a no-op on flat input.

    Optional columns: `ingest_seq` (arrival order, breaks timestamp ties; `event_id` otherwise)
    and `tz_offset_minutes` (hours of day are then read on the sender's clock).
    """
    if set(FLAT_COLUMNS) <= set(events.columns):
        return events
    local_us = "unix_micros(timestamp)"
    if "tz_offset_minutes" in events.columns:
        local_us += f" + coalesce(cast(tz_offset_minutes AS bigint), 0) * {MINUTE_US}"
    seq = "ingest_seq" if "ingest_seq" in events.columns else "event_id"
    return events.selectExpr(
        "event_id",
        "entity_id",
        "unix_micros(timestamp) AS ts_us",
        f"{local_us} AS local_us",
        f"{seq} AS seq",
        "source_ip",
        "resource_accessed",
        "auth_method",
        "outcome",
        "session_duration_seconds",
        "coalesce(size(command_sequence), 0) AS command_count",
        "geo_location.latitude",
        "geo_location.longitude",
        "device_fingerprint.fingerprint_id",
        "device_fingerprint.operating_system",
        "device_fingerprint.browser",
        "device_fingerprint.device_type",
        "label",
    )
