"""Expected scores, reasons, attack types and summaries of single feature rows."""

import pytest
from pyspark.sql import functions as F

from driftwatch.operators.classify import classify
from driftwatch.operators.explain import alerts, explain
from driftwatch.operators.records import alert_violations, entity_violations, risk_violations
from driftwatch.operators.risk import ALERT_SEVERITY, NO_REASON, bucket, risk_scores

# a quiet row: no value reaches a threshold
NEUTRAL = {
    "failed_logins_10m": 1.0,
    "events_10m": 2.0,
    "implied_speed_kmh": 41.0,
    "distance_from_previous_km": 6.0,
    "device_fingerprint_mismatch": 0.0,
    "is_new_device": 0.0,
    "source_ip_entity_fanout_10m": 2.0,
    "unique_resources_30m": 2.0,
    "resource_access_velocity_30m": 0.01,
    "is_new_resource": 0.0,
    "hour_deviation_zscore": 0.2,
    "session_duration_deviation_zscore": 0.3,
    "ml_anomaly_score": -0.31,
    "ml_flagged": False,
}

# just below and at each threshold: change, score, severity, a word of a reason
RISK_CASES = {
    "quiet": ({}, 0.0, "low", NO_REASON),
    "four failures": ({"failed_logins_10m": 4.0}, 0.0, "low", NO_REASON),
    "five failures": ({"failed_logins_10m": 5.0}, 20.0, "low", "5 failed logins"),
    "ten failures": ({"failed_logins_10m": 10.0}, 35.0, "medium", "10 failed logins"),
    "not yet fast": ({"implied_speed_kmh": 499.9}, 0.0, "low", NO_REASON),
    "fast": ({"implied_speed_kmh": 500.0}, 25.0, "low", "speed of 500 km/h"),
    "half to even down": ({"implied_speed_kmh": 702.5}, 25.0, "low", "speed of 702 km/h"),
    "half to even up": ({"implied_speed_kmh": 703.5}, 25.0, "low", "speed of 704 km/h"),
    "very fast and far": ({"implied_speed_kmh": 1000.0, "distance_from_previous_km": 3000.0}, 55.0, "medium", "1000 km/h"),
    "far": ({"distance_from_previous_km": 3000.0}, 10.0, "low", "3000 km apart"),
    "shared address": ({"source_ip_entity_fanout_10m": 3.0}, 20.0, "low", "multiple entities"),
    "busy address": ({"source_ip_entity_fanout_10m": 5.0}, 35.0, "medium", "accessed 5 entities"),
    "known resources": ({"unique_resources_30m": 5.0}, 0.0, "low", NO_REASON),
    "one of them new": ({"unique_resources_30m": 5.0, "is_new_resource": 1.0}, 30.0, "medium", "unfamiliar resource"),
    "quick": ({"resource_access_velocity_30m": 0.2}, 10.0, "low", "velocity"),
    "odd hour and length": ({"hour_deviation_zscore": 3.0, "session_duration_deviation_zscore": 3.0}, 20.0, "low", "Session duration"),
    "other device": ({"device_fingerprint_mismatch": 1.0}, 40.0, "medium", "unexpected fingerprint"),
    "forest": ({"ml_anomaly_score": 0.03, "ml_flagged": True}, 13.0, "low", "Isolation Forest"),
    "forest, capped": ({"ml_anomaly_score": 0.7, "ml_flagged": True}, 20.0, "low", "Isolation Forest"),
    "high": ({"device_fingerprint_mismatch": 1.0, "source_ip_entity_fanout_10m": 3.0}, 60.0, "high", "fingerprint"),
    "all, capped": (
        {
            "failed_logins_10m": 10.0,
            "implied_speed_kmh": 1000.0,
            "device_fingerprint_mismatch": 1.0,
            "session_duration_deviation_zscore": 3.0,
            "ml_anomaly_score": 0.2,
            "ml_flagged": True,
        },
        100.0,
        "critical",
        "1000 km/h",
    ),
}

CLASS_CASES = {
    "failures": ({"failed_logins_10m": 5.0, "events_10m": 6.0}, "brute_force", 0.65 + 0.20),
    "address": ({"source_ip_entity_fanout_10m": 4.0, "failed_logins_10m": 0.0}, "credential_stuffing", 0.70),
    "address with failures": ({"source_ip_entity_fanout_10m": 4.0}, "credential_stuffing", 0.70 + 0.20),
    "travel": ({"implied_speed_kmh": 1000.0}, "impossible_travel", 0.75),
    "device": ({"device_fingerprint_mismatch": 1.0, "is_new_device": 1.0}, "device_spoofing", 0.80 + 0.10),
    "resources": (
        {"unique_resources_30m": 4.0, "resource_access_velocity_30m": 0.15}, "lateral_movement", 0.40 + 0.30
    ),
    "tie": (
        {
            "source_ip_entity_fanout_10m": 4.0,
            "unique_resources_30m": 4.0,
            "resource_access_velocity_30m": 0.15,
            "is_new_resource": 1.0,
        },
        "credential_stuffing",
        0.70 + 0.20,
    ),
    "nothing": ({}, "unknown", 0.0),
    "events alone": ({"events_10m": 6.0}, "unknown", 0.2),
}


def rows(spark, cases, **extra):
    first = next(iter(cases.values()))
    names = ["name", *NEUTRAL, *extra]
    assert first
    data = [
        (name, *{**NEUTRAL, **case[0]}.values(), *extra.values()) for name, case in cases.items()
    ]
    return spark.createDataFrame(data, names)


def test_risk_rows(spark):
    got = {r["name"]: r for r in risk_scores(rows(spark, RISK_CASES)).collect()}
    for name, (_, score, severity, word) in RISK_CASES.items():
        assert got[name]["risk_score"] == score, name
        assert got[name]["severity"] == severity, name
        assert any(word in reason for reason in got[name]["reasons"]), (name, got[name]["reasons"])
        assert got[name]["is_suspicious"] == (score >= 30)


def test_missing_features_count_as_zero(spark):
    bare = spark.createDataFrame([(-0.5, False)], "ml_anomaly_score double, ml_flagged boolean")
    assert risk_scores(bare).first()["risk_score"] == 0.0


def test_attack_types(spark):
    got = {r["name"]: r for r in classify(rows(spark, CLASS_CASES, is_suspicious=True)).collect()}
    for name, (_, kind, confidence) in CLASS_CASES.items():
        assert (got[name]["anomaly_type"], got[name]["classification_confidence"]) == (kind, confidence), name
        assert (kind == "unknown") == (got[name]["classification_evidence"] == [])


def test_unsuspicious_is_normal(spark):
    got = classify(rows(spark, CLASS_CASES, is_suspicious=False)).collect()
    assert {(r["anomaly_type"], r["classification_confidence"]) for r in got} == {("normal", 1.0)}


@pytest.mark.parametrize(
    ("severity", "score", "words"),
    [
        ("critical", 90.0, ("CRITICAL", "detected", "90/100", "Immediate investigation")),
        ("high", 62.5, ("HIGH", "62/100", "Multiple suspicious")),
        ("medium", 55.0, ("MEDIUM", "55/100", "warrant review")),
        ("low", 3.0, ("LOW", "observed", "3/100", "No significant threat")),
    ],
)
def test_summary(spark, severity, score, words):
    row = spark.createDataFrame([(severity, score)], "severity string, risk_score double")
    text = explain(row).first()["summary"]
    assert all(word in text for word in words), text


def test_alert_scale_differs_from_scorer_scale(spark):
    scores = spark.createDataFrame([(v,) for v in (30.0, 35.0, 64.9, 65.0, 80.0, 85.0)], "s double")
    found = [r[0] for r in scores.orderBy("s").selectExpr(bucket("s", ALERT_SEVERITY)).collect()]
    assert found == ["low", "medium", "medium", "high", "high", "critical"]


def test_alerts_are_valid_records(spark):
    scored = classify(risk_scores(rows(spark, RISK_CASES, event_id="EVENT_0001", entity_id="USER_1")))
    found = alert_violations(alerts(scored)).collect()
    assert len(found) == sum(score >= 30 for _, score, _, _ in RISK_CASES.values())
    assert all(r["violations"] == [] and r["status"] == "open" for r in found)


def test_risk_and_entity_checks(spark):
    risks = spark.createDataFrame(
        [(90.0, 0.5, "critical"), (90.0, 0.5, "high"), (101.0, 2.0, "critical"), (10.0, 0.1, "severe")],
        "score double, confidence double, severity string",
    )
    assert [r["violations"] for r in risk_violations(risks).collect()] == [
        [],
        ["severity_bucket"],
        ["score_range", "confidence_range"],
        ["severity_name", "severity_bucket"],
    ]
    entities = spark.createDataFrame(
        [("USER_1", "user"), (" USER_1 ", "user"), ("U!", "robot"), ("a" * 65, "edge_device")],
        "entity_id string, entity_type string",
    )
    assert [r["violations"] for r in entity_violations(entities).collect()] == [
        [],
        [],
        ["entity_id_length", "entity_id_characters", "entity_type"],
        ["entity_id_length"],
    ]


def test_feature_order_of_reasons(spark):
    row = risk_scores(rows(spark, {"all": RISK_CASES["all, capped"]})).select(F.col("reasons")).first()[0]
    assert [r.split()[0] for r in row] == ["10", "Travel", "Known", "Session", "Isolation"]
