"""Checks of entity, risk and alert tables; each row gets the list of rules it breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftwatch.functions.text import present, quote, strip
from driftwatch.operators.risk import ALERT_SEVERITY, bucket
from driftwatch.schema import ALERT_STATUSES, ENTITY_TYPES, SEVERITIES


def broken(rules: dict[str, str]) -> str:
    """Names of the rules that do not hold; a null outcome counts as broken."""
    return present(*[f"IF(coalesce({ok}, false), NULL, {quote(name)})" for name, ok in rules.items()])


def one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(quote(v) for v in values)})"


def entity_violations(entities: DataFrame) -> DataFrame:
    entity_id = strip("entity_id")
    rules = {
        "entity_id_length": f"length({entity_id}) BETWEEN 3 AND 64",
        "entity_id_characters": f"{entity_id} RLIKE '^[A-Za-z0-9_-]*$'",
        "entity_type": one_of("entity_type", ENTITY_TYPES),
    }
    if "peer_group" in entities.columns:
        rules["peer_group_length"] = f"peer_group IS NULL OR length({strip('peer_group')}) <= 64"
    return entities.selectExpr("*", f"{broken(rules)} AS violations")


def _risk_rules(score: str, confidence: str, severity: str) -> dict[str, str]:
    return {
        "score_range": f"{score} BETWEEN 0 AND 100",
        "confidence_range": f"{confidence} BETWEEN 0 AND 1",
        "severity_name": one_of(severity, SEVERITIES),
        "severity_bucket": f"{severity} = {bucket(score, ALERT_SEVERITY)}",
    }


def risk_violations(risks: DataFrame) -> DataFrame:
    """Rows of (score, confidence, severity); severity must match the score's bucket."""
    return risks.selectExpr("*", f"{broken(_risk_rules('score', 'confidence', 'severity'))} AS violations")


def alert_violations(alerts: DataFrame) -> DataFrame:
    rules = {
        "alert_id_length": "length(alert_id) BETWEEN 8 AND 64",
        "event_id_length": "length(event_id) BETWEEN 8 AND 64",
        "entity_id_length": "length(entity_id) BETWEEN 3 AND 64",
        **_risk_rules("risk.score", "risk.confidence", "risk.severity"),
        "classification_length": "classification IS NULL OR length(classification) <= 100",
        "evidence_count": "size(evidence) <= 20",
        "evidence_items": "forall(evidence, e -> length(e.signal) BETWEEN 1 AND 100 "
        "AND e.contribution BETWEEN 0 AND 100 AND length(e.description) BETWEEN 1 AND 500)",
        "status": one_of("status", ALERT_STATUSES),
    }
    return alerts.selectExpr("*", f"{broken(rules)} AS violations")
