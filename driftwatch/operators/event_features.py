"""Per-event projections: clock, outcome, session, place, device; and table export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftwatch.functions import clock
from driftwatch.schema import flat_events


# feature columns of one flat event row
EVENT_COLUMNS = {
    "hour_of_day": clock.hour_of_day("local_us"),
    "day_of_week": clock.weekday("local_us"),
    "is_weekend": f"cast({clock.weekday('local_us')} >= 5 AS int)",
    "auth_failed": "cast(outcome = 'failure' AS int)",
}


def event_features(events: DataFrame) -> DataFrame:
    """Identity, clock, outcome, session, place and device columns of every event."""
    return flat_events(events).selectExpr(
        "event_id",
        "entity_id",
        "ts_us",
        *[f"{text} AS {name}" for name, text in EVENT_COLUMNS.items()],
        "session_duration_seconds",
        "command_count",
        "latitude",
        "longitude",
        "operating_system",
        "browser",
        "device_type",
        "resource_accessed",
        "auth_method",
        "source_ip",
        "label",
    )


def export_events(events: DataFrame) -> DataFrame:
    """Event table with text timestamps and nested fields as JSON, for text sinks."""
    # a zone-free timestamp prints the same in every session zone
    utc = "timestampadd(MICROSECOND, unix_micros(timestamp), TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return events.selectExpr(
        "event_id",
        "entity_id",
        "entity_type",
        f"date_format({utc}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS timestamp",
        "source_ip",
        "to_json(geo_location) AS geo_location",
        "resource_accessed",
        "auth_method",
        "outcome",
        "session_duration_seconds",
        "to_json(command_sequence) AS command_sequence",
        "to_json(device_fingerprint) AS device_fingerprint",
        "label",
    )
