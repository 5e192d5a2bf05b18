"""Raw JSON payloads derived from the event table, a share of them damaged on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwatch.session import spread
from driftwatch.sources.telemetry import telemetry

VARIANTS = 23  # ingest_seq modulo this picks the damage; 18 to 22 stay intact
LARGE = 509  # ingest_seq modulo this below 4 picks a damage by size, 23 to 26


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ingest_seq, raw): every event as one JSON text."""
    utc = "timestampadd(MICROSECOND, unix_micros(timestamp), TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    iso = f"date_format({utc}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    deep = "{\"a\":" * 11 + "1" + "}" * 11
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    damaged = telemetry(spark, sf_dir, events).selectExpr(
        "ingest_seq",
        f"IF(ingest_seq % {LARGE} < 4, {VARIANTS} + ingest_seq % {LARGE}, ingest_seq % {VARIANTS}) AS damage",
        "named_struct("
        "'event_id', CASE damage WHEN 9 THEN concat('  ', event_id, '\\t') "
        "WHEN 26 THEN concat(event_id, repeat('x', 64)) ELSE event_id END, "
        "'entity_id', entity_id, "
        "'entity_type', IF(damage = 4, 'robot', entity_type), "
        f"'timestamp', CASE damage WHEN 11 THEN 'yesterday' WHEN 16 THEN concat({iso}, '+05:30') "
        f"ELSE concat({iso}, 'Z') END, "
        "'source_ip', CASE damage WHEN 0 THEN 'not-an-ip' "
        "WHEN 14 THEN concat('2001:0DB8::', 1 + ingest_seq % 9) ELSE source_ip END, "
        "'geo_location', named_struct("
        "'country_code', IF(damage = 6, lower(geo_location.country_code), geo_location.country_code), "
        "'city', geo_location.city, "
        "'latitude', IF(damage = 1, 200D, geo_location.latitude), "
        "'longitude', geo_location.longitude), "
        "'resource_accessed', CASE damage WHEN 8 THEN concat(resource_accessed, chr(7)) "
        "WHEN 15 THEN concat(resource_accessed, '\\uFF11') WHEN 17 THEN concat(resource_accessed, '\\u00E9') "
        "WHEN 24 THEN repeat('r', 10001) ELSE resource_accessed END, "
        "'auth_method', auth_method, "
        "'outcome', IF(damage = 2, NULL, outcome), "
        "'session_duration_seconds', IF(damage = 5, -5, session_duration_seconds), "
        "'command_sequence', CASE damage WHEN 10 THEN array('GET /profile', ' ') "
        "WHEN 23 THEN array_repeat('GET /profile', 501) WHEN 25 THEN array_repeat(repeat('c', 9000), 8) "
        "ELSE command_sequence END, "
        "'device_fingerprint', device_fingerprint, "
        "'label', IF(damage = 7, 'zzz', label), "
        "'is_admin', IF(damage = 3, true, NULL)) AS event",
    )
    text = "to_json(event)"
    return damaged.selectExpr(
        "ingest_seq",
        f"CASE damage WHEN 12 THEN left({text}, length({text}) - 1) "
        f"WHEN 13 THEN concat(left({text}, length({text}) - 1), ',\"extra\":', '{deep}', '}}') "
        f"ELSE {text} END AS raw",
    )
