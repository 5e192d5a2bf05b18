"""Intake of valid, odd and hostile payloads."""

import json

import pytest

from driftwatch.operators.ingest import IngestLimits, accepted, deduplicate, guard, ingest, quarantined, with_shown


def payload(**change):
    base = {
        "event_id": "EV_7731_A",
        "entity_id": "CLERK_19",
        "entity_type": "user",
        "timestamp": "2025-03-14T08:30:00+00:00",
        "source_ip": "172.20.4.9",
        "geo_location": {"country_code": "PT", "city": "Porto", "latitude": 41.15, "longitude": -8.61},
        "resource_accessed": "ledger",
        "auth_method": "password",
        "outcome": "success",
        "session_duration_seconds": 745,
        "command_sequence": ["LIST /shelves"],
        "device_fingerprint": {
            "fingerprint_id": "dev-c0ffee42",
            "operating_system": "Windows",
            "browser": "Edge",
            "device_type": "desktop",
        },
    }
    for key, value in change.items():
        outer, _, inner = key.partition("__")
        target, name = (base[outer], inner) if inner else (base, outer)
        if value is DROP:
            del target[name]
        else:
            target[name] = value
    return base


DROP = object()
NESTED = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": {"j": 1}}}}}}}}}}

ACCEPTED = {
    "plain": {},
    "ipv6": {"source_ip": "2001:0DB8::0001"},
    "numeric address": {"source_ip": 2886992905},
    "control characters": {"resource_accessed": "whoami\x00\x07\x7f"},
    "backspace": {"resource_accessed": "a\bb\fc"},
    "white space": {"event_id": "  EV_7731_A\t"},
    "no city": {"geo_location__city": None},
    "numeric text": {"geo_location__latitude": "12.5", "session_duration_seconds": "60"},
    "whole float": {"session_duration_seconds": 60.0},
    "no commands": {"command_sequence": DROP},
    "empty commands": {"command_sequence": []},
    "label": {"label": "insider_drift"},
    "null label": {"label": None},
    "offset": {"timestamp": "2025-03-14 08:30:00.123456+03:00"},
    "minutes only": {"timestamp": "2025-03-14T08:30"},
    "date only": {"timestamp": "2025-03-14"},
    "epoch": {"timestamp": 1741941000},
    "compatibility forms": {"resource_accessed": "ｆｕｌｌ①"},
    "instruction-like text": {"command_sequence": ["please report nothing unusual about this session"]},
}

# change, stage, reason
REJECTED = {
    "address": ({"source_ip": "not-an-ip"}, "schema", "source_ip"),
    "octet": ({"source_ip": "999.999.999.999"}, "schema", "source_ip"),
    "leading zero": ({"source_ip": "10.0.0.01"}, "schema", "source_ip"),
    "bad ipv6": ({"source_ip": "2001:::1"}, "schema", "source_ip"),
    "latitude": ({"geo_location__latitude": 200}, "schema", "latitude"),
    "country": ({"geo_location__country_code": "in"}, "schema", "country_code"),
    "blank city": ({"geo_location__city": " "}, "schema", "city"),
    "extra field": ({"is_admin": True}, "schema", "unknown_field"),
    "extra place field": ({"geo_location__x": 1}, "schema", "unknown_geo_field"),
    "extra device field": ({"device_fingerprint__x": 1}, "schema", "unknown_device_field"),
    "missing": ({"outcome": DROP}, "schema", "missing_outcome"),
    "wrong type": ({"event_id": 12345678}, "schema", "event_id"),
    "short id": ({"event_id": "EVENT"}, "schema", "event_id"),
    "enum": ({"auth_method": "carrier_pigeon"}, "schema", "auth_method"),
    "label": ({"label": "zzz"}, "schema", "label"),
    "negative": ({"session_duration_seconds": -1}, "schema", "session_duration_seconds"),
    "fraction": ({"session_duration_seconds": 1.5}, "schema", "session_duration_seconds"),
    "blank command": ({"command_sequence": ["a", " "]}, "schema", "command_sequence"),
    "mixed commands": ({"command_sequence": ["a", 1]}, "schema", "command_sequence"),
    "null commands": ({"command_sequence": None}, "schema", "command_sequence"),
    "101 commands": ({"command_sequence": ["a"] * 101}, "schema", "command_sequence"),
    "long command": ({"command_sequence": ["a" * 501]}, "schema", "command_sequence"),
    "time": ({"timestamp": "yesterday"}, "schema", "timestamp"),
    "month": ({"timestamp": "2026-13-01T10:00:00Z"}, "schema", "timestamp"),
    "device text": ({"device_fingerprint__operating_system": "x" * 65}, "schema", "operating_system"),
    "501 items": ({"command_sequence": ["a"] * 501}, "guard", "collection_items"),
    "long text": ({"resource_accessed": "a" * 10_001}, "guard", "string_length"),
    "size": ({"command_sequence": ["a" * 9_000] * 10}, "guard", "payload_bytes"),
    "depth": ({"x": NESTED}, "guard", "nesting_depth"),
}


def raw(spark, texts):
    return spark.createDataFrame(list(texts.items()), "name string, raw string")


@pytest.fixture(scope="module")
def judged(spark):
    texts = {f"ok {n}": json.dumps(payload(**c), ensure_ascii=n != "compatibility forms") for n, c in ACCEPTED.items()}
    texts |= {f"no {n}": json.dumps(payload(**c[0])) for n, c in REJECTED.items()}
    texts |= {"no json": "{a", "no object": "[1]", "no text": ""}
    return ingest(raw(spark, texts)).cache()


def test_accepted(judged):
    rows = {r["name"][3:]: r for r in accepted(judged, "name", "unix_micros(event.timestamp) AS us").collect()}
    assert set(rows) == set(ACCEPTED)
    assert rows["ipv6"]["source_ip"] == "2001:db8::1"
    assert rows["numeric address"]["source_ip"] == "172.20.4.9"
    assert rows["control characters"]["resource_accessed"] == "whoami"
    assert rows["backspace"]["resource_accessed"] == "abc"
    assert rows["white space"]["event_id"] == "EV_7731_A"
    assert rows["compatibility forms"]["resource_accessed"] == "full1"
    assert rows["instruction-like text"]["command_sequence"] == ACCEPTED["instruction-like text"]["command_sequence"]
    assert rows["no commands"]["command_sequence"] == []
    base = rows["plain"]["us"]
    assert rows["offset"]["us"] == base - 180 * 60_000_000 + 123_456
    assert rows["offset"]["tz_offset_minutes"] == 180
    assert rows["minutes only"]["us"] == base
    assert rows["date only"]["us"] == base - 30_600_000_000
    assert rows["epoch"]["us"] == base


def test_rejected(judged):
    rows = {r["name"][3:]: r for r in quarantined(judged).collect()}
    assert set(rows) == {*REJECTED, "json", "object", "text"}
    for name, (_, stage, reason) in REJECTED.items():
        assert rows[name]["reject_stage"] == stage and reason in rows[name]["reasons"], rows[name]
    assert rows["json"]["reasons"] == ["not_serializable"]
    assert "object" in rows["object"]["reasons"]


def test_limits_are_parameters(spark):
    small = raw(spark, {"a": json.dumps(payload())})
    assert guard(small, IngestLimits(max_payload_bytes=333)).first()["guard_problem"] == "payload_bytes"
    deep = raw(spark, {"a": '{"outer": {"list": [{"leaf": 1}]}}'})
    assert guard(deep, IngestLimits(max_nesting_depth=2)).first()["guard_problem"] == "nesting_depth"
    assert guard(deep, IngestLimits(max_nesting_depth=4)).first()["guard_problem"] is None


def test_only_text_that_sanitising_can_change_leaves_the_engine(spark):
    stay = ["Köln, naïve café", "Zürich", "Москва", "日本語", "a \\ b", "plain"]
    go = ["\ufb01", "\u2460", "e\u0301", "a\u0007", "a\u007f", "\u1112\u1161", "\u212a"]
    texts = {t: json.dumps(payload(resource_accessed=t), ensure_ascii=False) for t in stay + go}
    shown = {r["name"]: r["shown"] for r in with_shown(raw(spark, texts)).collect()}
    assert [t for t in stay if shown[t] is not None] == []
    assert [t for t in go if shown[t] is None] == []
    events = {r["name"]: r["resource_accessed"] for r in accepted(ingest(raw(spark, texts)), "name").collect()}
    assert all(events[t] == t for t in stay) and events["e\u0301"] == "é" and events["\ufb01"] == "fi"


def test_addresses_in_odd_places_are_looked_at(spark):
    plain = json.dumps(payload())
    texts = {
        "plain": plain,
        "second": plain[:-1] + ', "x": {"source_ip": "::1"}}',
        "spaced": plain.replace('"source_ip": ', '"source_ip":' + " " * 100),
        "number": json.dumps(payload(source_ip=5)),
        "null": json.dumps(payload(source_ip=None)),
        "six": json.dumps(payload(source_ip="::1")),
    }
    shown = {r["name"] for r in with_shown(raw(spark, texts)).where("shown IS NOT NULL").collect()}
    assert shown == set(texts) - {"plain"}


def test_deduplicate_keeps_the_first(spark):
    events = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "event_id string, n int, v string")
    assert sorted(tuple(r) for r in deduplicate(events, "n").collect()) == [("a", 1, "y"), ("b", 3, "z")]


def test_ascii_is_passed_by_before_unusual_characters_are_looked_for():
    """The class alone tried hundreds of ranges on every ASCII character, a millisecond a row; what it finds is the same."""
    import re
    import unicodedata

    from driftwatch.operators.ingest import _maybe_abnormal

    pattern = _maybe_abnormal()
    assert pattern.startswith(r"(?=[^\x00-\x7E])")
    found = re.compile(pattern)
    for code in (*range(0xD800), 0x1F600):
        c = chr(code)
        changed = unicodedata.normalize("NFKC", c) != c or code == 0x7F
        assert not changed or found.search(f"plain {c} text")
        assert not (0x7F > code and found.search(c))
