"""Intake of untrusted JSON text: guard, sanitise and validate, with a quarantine.

Every row keeps the list of rules it breaks instead of raising on the first. Ordinary rows
are checked by built-in expressions alone; only rows that might break a structural limit,
hold text that sanitising can change or carry an unusual address are shown to Python, in
Arrow batches. Accented and other text that is normal already stays in the engine.
"""

from __future__ import annotations

import ipaddress
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.text import present, quote, strip
from driftwatch.operators.records import broken, one_of
from driftwatch.schema import AUTH_METHODS, ENTITY_TYPES, LABELS, OUTCOMES


@dataclass(frozen=True)
class IngestLimits:
    """Structural limits of one payload."""

    # Fixed values.
    max_payload_bytes: int = 65_536
    max_string_length: int = 10_000
    max_nesting_depth: int = 10
    max_collection_items: int = 500


# Field names per level.
EVENT_FIELDS = (
    "event_id",
    "entity_id",
    "entity_type",
    "timestamp",
    "source_ip",
    "geo_location",
    "resource_accessed",
    "auth_method",
    "outcome",
    "session_duration_seconds",
    "command_sequence",
    "device_fingerprint",
    "label",
)
GEO_FIELDS = ("country_code", "city", "latitude", "longitude")
DEVICE_FIELDS = ("fingerprint_id", "operating_system", "browser", "device_type")
# End of fixed values.

# Re-serialising can widen text (separators, numbers such as 1e15), never beyond this factor.
_WIDENING = 6
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\\.{_OCTET}){{3}}$"
_ISO = (
    r"^\d{4}-\d{2}-\d{2}([Tt _]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s?([Zz]|[+-]\d{2}:?\d{2})?)?$"
)
# Fixed value: characters removed from every text; tab, line feed and return stay.
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
# In JSON those characters show up escaped, or as the last one itself.
_ESCAPED = r"\\[ubf]"
_USUAL_ADDRESS = r"^\"source_ip\"\s*:\s*\"[^\":]*\""
_ADDRESS_SPAN = 80


@cache
def _maybe_abnormal() -> str:
    """Pattern of characters that NFKC may change, alone or beside others.

    Left out are those that are their own NFKC form, combine with nothing before them and come
    in runs of eight or more. What is in the pattern by mistake is only looked at once more.
    ASCII is passed by before the class is asked: that tries its hundreds of ranges one by one.
    """
    second = {0x1161 + i for i in range(21)} | {0x11A8 + i for i in range(27)}  # conjoining vowels and finals
    for code in range(0xD800):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    spans: list[list[int]] = []
    for code in range(0x7F, 0xD800):
        c = chr(code)
        stable = unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)
        if code == 0x7F or code in second or not stable:
            continue
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    kept = "".join(f"\\u{low:04X}-\\u{high:04X}" for low, high in spans if high - low >= 7)
    return rf"(?=[^\x00-\x7E])[^\x00-\x7E{kept}]"


def _structure_problem(value: Any, limits: IngestLimits) -> str | None:
    """First structural limit that a parsed payload breaks."""
    pending = [(value, 0)]
    while pending:
        item, depth = pending.pop()
        if depth > limits.max_nesting_depth:
            return "nesting_depth"
        if isinstance(item, str):
            if len(item) > limits.max_string_length:
                return "string_length"
        elif isinstance(item, dict | list):
            if len(item) > limits.max_collection_items:
                return "collection_items"
            inner = item.values() if isinstance(item, dict) else item
            pending.extend((v, depth + 1) for v in inner)
    return None


def _sanitised(value: Any) -> Any:
    """String values in NFKC form without control characters; keys stay as they are."""
    if isinstance(value, str):
        return _CONTROL.sub("", unicodedata.normalize("NFKC", value))
    if isinstance(value, dict):
        return {k: _sanitised(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_sanitised(v) for v in value]
    return value


def _canonical_ip(value: Any) -> str | None:
    """Canonical text of an address given as text or number, else null."""
    try:
        return str(ipaddress.ip_address(value))
    except ValueError:
        return None


def inspect_payload(raw: str, limits: IngestLimits) -> tuple[str | None, str | None, str | None]:
    """(broken limit, sanitised JSON, canonical address) of one payload text."""
    try:
        parsed = json.loads(raw)
        size = len(json.dumps(parsed, ensure_ascii=False).encode("utf-8"))
        if size > limits.max_payload_bytes:
            return "payload_bytes", None, None
        problem = _structure_problem(parsed, limits)
        if problem:
            return problem, None, None
        clean = _sanitised(parsed)
        address = clean.get("source_ip") if isinstance(clean, dict) else None
        return None, json.dumps(clean, ensure_ascii=False), _canonical_ip(address)
    except (ValueError, RecursionError):
        return "not_serializable", None, None


def _inspector(limits: IngestLimits):
    columns = ["problem", "body", "address"]

    @F.pandas_udf("problem string, body string, address string")
    def inspect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        unseen = (None, None, None)
        for batch in batches:
            found = [unseen if raw is None else inspect_payload(raw, limits) for raw in batch]
            yield pd.DataFrame(found, columns=columns, dtype=object)

    return inspect


def with_shown(raw: DataFrame, limits: IngestLimits | None = None, column: str = "raw") -> DataFrame:
    """Add `shown`: the text of rows that cheap conditions cannot clear, else null."""
    limits = limits or IngestLimits()
    half = limits.max_nesting_depth // 2  # of braces and of brackets
    at = f"locate('\"source_ip\"', {column})"
    # sufficient conditions for the payload to be within every limit and to need no change
    plain = (
        f"octet_length({column}) * {_WIDENING} <= {limits.max_payload_bytes} "
        f"AND length({column}) <= {limits.max_string_length} "
        f"AND substring_index({column}, '{{', {half + 1}) = {column} "
        f"AND substring_index({column}, '[', {half + 1}) = {column} "
        f"AND substring_index({column}, ',', {limits.max_collection_items}) = {column} "
        f"AND ((octet_length({column}) = length({column}) AND NOT contains({column}, chr(127))) "
        f"OR NOT {column} RLIKE r'{_maybe_abnormal()}') "
        f"AND (NOT contains({column}, chr(92)) OR NOT {column} RLIKE r'{_ESCAPED}') "
        f"AND ({at} = 0 OR (substr({column}, {at}, {_ADDRESS_SPAN}) RLIKE r'{_USUAL_ADDRESS}' "
        f"AND locate('\"source_ip\"', {column}, {at} + 1) = 0))"
    )
    return raw.selectExpr("*", f"IF({plain}, NULL, {column}) AS shown")


def _guarded(raw: DataFrame, limits: IngestLimits | None, column: str) -> DataFrame:
    """`guard`, with the parsed body as `v`: null where a limit is broken."""
    seen = with_shown(raw, limits, column).select("*", _inspector(limits or IngestLimits())("shown").alias("seen"))
    return seen.selectExpr(
        *raw.columns,
        "seen.problem AS problem",
        f"coalesce(seen.body, {column}) AS body",
        "seen.address AS address",
        f"CASE WHEN shown IS NULL THEN try_parse_json({column}) "
        f"WHEN seen.problem IS NULL AND try_parse_json({column}) IS NOT NULL THEN try_parse_json(seen.body) END AS v",
    ).selectExpr(
        *raw.columns,
        "coalesce(problem, IF(v IS NULL, 'not_serializable', NULL)) AS guard_problem",
        "body",
        "address",
        "v",
    )


def guard(raw: DataFrame, limits: IngestLimits | None = None, column: str = "raw") -> DataFrame:
    """Add `guard_problem` (null when within limits), `body`, the sanitised JSON text, and
    `address`, the canonical form of an unusual source address."""
    return _guarded(raw, limits, column).drop("v")


# every field as text, whatever its JSON type
_TEXT_SCHEMA = (
    ", ".join(f"{f} string" for f in EVENT_FIELDS)
    .replace("geo_location string", f"geo_location struct<{','.join(f'{f}:string' for f in GEO_FIELDS)}>")
    .replace(
        "device_fingerprint string",
        f"device_fingerprint struct<{','.join(f'{f}:string' for f in DEVICE_FIELDS)}>",
    )
    .replace("command_sequence string", "command_sequence array<string>")
)


def _kind(path: str) -> str:
    """JSON type of a field: NULL when absent, VOID for a JSON null."""
    return f"schema_of_variant(try_variant_get(v, '$.{path}', 'variant'))"


def _alias(path: str) -> str:
    return path.replace(".", "_")


_PATHS = (
    *[f for f in EVENT_FIELDS if f not in ("geo_location", "device_fingerprint", "command_sequence")],
    *[f"geo_location.{f}" for f in GEO_FIELDS],
    *[f"device_fingerprint.{f}" for f in DEVICE_FIELDS],
)


def _numeric(path: str) -> str:
    """A number, a numeric text or a boolean as double; null otherwise."""
    t, k = f"t_{_alias(path)}", f"k_{_alias(path)}"
    return (
        f"CASE WHEN {k} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {k} LIKE 'DECIMAL%' THEN try_cast({t} AS double) "
        f"WHEN {k} = 'STRING' THEN try_cast(trim({t}) AS double) "
        f"WHEN {k} = 'BOOLEAN' THEN IF({t} = 'true', 1D, 0D) END"
    )


def _clean(path: str) -> str:
    """Text of a string field; null for any other type."""
    a = _alias(path)
    return f"IF(k_{a} = 'STRING', t_{a}, NULL)"


def _names(path: str) -> str:
    """Field names of the object at a path of the parsed body, null for anything else."""
    return f"map_keys(try_variant_get(v, '{path}', 'map<string,variant>'))"


def _fields_known(names: str, allowed: tuple[str, ...]) -> str:
    known = ", ".join(quote(f) for f in allowed)
    return f"size(array_except({names}, array({known}))) = 0"


def _parsed(guarded: DataFrame, keep: list[str]) -> DataFrame:
    """Typed and cleaned fields of every body within limits."""
    typed = guarded.selectExpr(
        "*",
        f"IF(guard_problem IS NULL, from_json(body, '{_TEXT_SCHEMA}'), NULL) AS t",
    ).selectExpr(
        *keep,
        "guard_problem",
        "address",
        "ltrim(body) LIKE '{%' AS is_object",
        *[f"t.{p} AS t_{_alias(p)}" for p in _PATHS],
        *[f"{_kind(p)} AS k_{_alias(p)}" for p in _PATHS],
        f"{_kind('geo_location')} AS k_geo_location",
        f"{_kind('device_fingerprint')} AS k_device_fingerprint",
        f"{_kind('command_sequence')} AS k_command_sequence",
        f"{_names('$')} AS names",
        f"{_names('$.geo_location')} AS geo_names",
        f"{_names('$.device_fingerprint')} AS device_names",
        "t.command_sequence AS t_commands",
    )
    stripped = ("event_id", "entity_id", "resource_accessed", *_PATHS[-8:-6], *_PATHS[-4:])
    exact = ("entity_type", "auth_method", "outcome", "label", "source_ip", "timestamp")
    numeric = ("session_duration_seconds", "geo_location.latitude", "geo_location.longitude", "timestamp")
    cleaned = typed.selectExpr(
        *keep,
        "guard_problem",
        "address",
        "is_object",
        "names",
        "geo_names",
        "device_names",
        "k_command_sequence",
        "k_geo_location",
        "k_device_fingerprint",
        *[f"k_{_alias(p)}" for p in _PATHS],
        *[f"{strip(_clean(p))} AS c_{_alias(p)}" for p in stripped],
        *[f"{_clean(p)} AS c_{_alias(p)}" for p in exact],
        *[f"{_numeric(p)} AS n_{_alias(p)}" for p in numeric],
        f"transform(t_commands, c -> {strip('c')}) AS c_commands",
        r"regexp_extract(c_timestamp, r'([Zz]|[+-]\d{2}:?\d{2})$', 1) AS zone",
    )
    # a zone-free time is UTC; a bare date is its midnight
    complete = (
        "CASE WHEN length(c_timestamp) = 10 THEN concat(c_timestamp, 'T00:00:00Z') "
        "WHEN zone = '' THEN concat(c_timestamp, 'Z') "
        "WHEN length(zone) = 5 THEN concat(left(c_timestamp, length(c_timestamp) - 2), ':', right(zone, 2)) "
        "ELSE c_timestamp END"
    )
    # a time without seconds is the start of its minute
    whole = "IF(substr(complete, 17, 1) = ':', complete, overlay(complete PLACING ':00' FROM 17 FOR 0))"
    # numbers are seconds, or milliseconds beyond the year 2603
    epoch = "timestamp_micros(cast(n_timestamp * IF(abs(n_timestamp) > 2e10D, 1000D, 1000000D) AS bigint))"
    return cleaned.selectExpr("*", f"upper({complete}) AS complete").selectExpr(
        "*",
        f"CASE WHEN c_timestamp RLIKE r'{_ISO}' THEN try_cast(replace({whole}, '_', 'T') AS timestamp) "
        f"WHEN abs(n_timestamp) < 2.5e11D THEN {epoch} END AS c_moment",
        "IF(zone RLIKE '^[+-]', cast(concat(left(zone, 1), '1') AS int) * "
        "(cast(substr(zone, 2, 2) AS int) * 60 + cast(right(zone, 2) AS int)), 0) AS tz_offset_minutes",
        f"IF(c_source_ip RLIKE '{_IPV4}', c_source_ip, address) AS c_address",
    )


def _optional(path: str, ok: str) -> str:
    a = _alias(path)
    return f"k_{a} IS NULL OR k_{a} = 'VOID' OR ({ok})"


def _rules() -> dict[str, str]:
    """Field rules of a body that is within the structural limits."""
    required = [
        f for f in EVENT_FIELDS if f not in ("command_sequence", "label")
    ] + ["geo_location.country_code", "geo_location.latitude", "geo_location.longitude",
         "device_fingerprint.fingerprint_id"]
    rules = {"object": "is_object"}
    rules |= {f"missing_{_alias(f)}": f"k_{_alias(f)} IS NOT NULL" for f in required}
    rules |= {
        "unknown_field": _fields_known("names", EVENT_FIELDS),
        "unknown_geo_field": _optional("geo_location", _fields_known("geo_names", GEO_FIELDS)),
        "unknown_device_field": _optional("device_fingerprint", _fields_known("device_names", DEVICE_FIELDS)),
        "event_id": "length(c_event_id) BETWEEN 8 AND 64",
        "entity_id": "length(c_entity_id) BETWEEN 3 AND 64",
        "entity_type": one_of("c_entity_type", ENTITY_TYPES),
        "timestamp": "c_moment IS NOT NULL",
        "source_ip": "c_address IS NOT NULL",
        "geo_location": "k_geo_location LIKE 'OBJECT%'",
        "country_code": "c_geo_location_country_code RLIKE '^[A-Z]{2}$'",
        "city": _optional("geo_location.city", "length(c_geo_location_city) BETWEEN 1 AND 100"),
        "latitude": "n_geo_location_latitude BETWEEN -90 AND 90",
        "longitude": "n_geo_location_longitude BETWEEN -180 AND 180",
        "resource_accessed": "length(c_resource_accessed) BETWEEN 1 AND 256",
        "auth_method": one_of("c_auth_method", AUTH_METHODS),
        "outcome": one_of("c_outcome", OUTCOMES),
        "session_duration_seconds": "n_session_duration_seconds BETWEEN 0 AND 86400 "
        "AND n_session_duration_seconds = floor(n_session_duration_seconds)",
        "command_sequence": "k_command_sequence IS NULL OR (k_command_sequence IN ('ARRAY<STRING>', "
        "'ARRAY<VOID>') AND size(c_commands) <= 100 "
        "AND forall(c_commands, c -> length(c) BETWEEN 1 AND 500))",
        "device_fingerprint": "k_device_fingerprint LIKE 'OBJECT%'",
        "fingerprint_id": "length(c_device_fingerprint_fingerprint_id) BETWEEN 8 AND 128",
        "label": _optional("label", one_of("c_label", LABELS)),
    }
    for part in DEVICE_FIELDS[1:]:
        path = f"device_fingerprint.{part}"
        rules[part] = _optional(path, f"length(c_{_alias(path)}) <= 64")
    return rules


_EVENT = (
    "struct(c_event_id AS event_id, c_entity_id AS entity_id, c_entity_type AS entity_type, "
    "c_moment AS timestamp, c_address AS source_ip, "
    "struct(c_geo_location_country_code AS country_code, c_geo_location_city AS city, "
    "n_geo_location_latitude AS latitude, n_geo_location_longitude AS longitude) AS geo_location, "
    "c_resource_accessed AS resource_accessed, c_auth_method AS auth_method, c_outcome AS outcome, "
    "cast(n_session_duration_seconds AS int) AS session_duration_seconds, "
    "coalesce(c_commands, cast(array() AS array<string>)) AS command_sequence, "
    "struct(c_device_fingerprint_fingerprint_id AS fingerprint_id, "
    "c_device_fingerprint_operating_system AS operating_system, "
    "c_device_fingerprint_browser AS browser, c_device_fingerprint_device_type AS device_type) "
    "AS device_fingerprint, c_label AS label, tz_offset_minutes AS tz_offset_minutes)"
)


def ingest(raw: DataFrame, limits: IngestLimits | None = None, column: str = "raw") -> DataFrame:
    """Add `reject_stage`, `reasons` and `event` to raw payload rows (batch or stream).

    `reject_stage` is null for accepted rows, `guard` for structural limits and `schema` for
    field rules; `event` is null for rejected rows.
    """
    parsed = _parsed(_guarded(raw, limits, column), raw.columns)
    judged = parsed.selectExpr(
        *raw.columns,
        "guard_problem",
        f"IF(guard_problem IS NULL, {broken(_rules())}, {present('guard_problem')}) AS reasons",
        f"{_EVENT} AS candidate",
    )
    stage = "CASE WHEN guard_problem IS NOT NULL THEN 'guard' WHEN size(reasons) > 0 THEN 'schema' END"
    verdict = (
        f"struct({stage} AS reject_stage, reasons AS reasons, "
        "IF(size(reasons) = 0, candidate, NULL) AS event)"
    )
    # A one-row generator: filters on the verdict stay above it. Pushed down as expressions
    # they would repeat every rule, and the parsing under it, many times over.
    return judged.selectExpr(*raw.columns, f"inline(array({verdict}))")


def accepted(ingested: DataFrame, *keep: str) -> DataFrame:
    return ingested.filter("reject_stage IS NULL").selectExpr(*keep, "event.*")


def quarantined(ingested: DataFrame) -> DataFrame:
    return ingested.filter("reject_stage IS NOT NULL").drop("event")


def deduplicate(events: DataFrame, order: str) -> DataFrame:
    """One row per event id, the first by `order`; reduced before the shuffle."""
    whole = f"struct({', '.join(events.columns)})"
    first = events.groupBy("event_id").agg(F.expr(f"min_by({whole}, {order})").alias("kept"))
    return first.select("kept.*")
