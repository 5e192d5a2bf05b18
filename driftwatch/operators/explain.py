"""Explanation rows, the assessment table and alert records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftwatch.functions.text import quote, whole
from driftwatch.operators.risk import ALERT_SEVERITY, bucket, evidence

# Output columns and summary endings.
ASSESSMENT_COLUMNS = (
    "event_id",
    "entity_id",
    "risk_score",
    "severity",
    "is_suspicious",
    "summary",
    "reasons",
    "ml_anomaly_score",
    "ml_flagged",
    "ml_contribution",
    "behavioral_contribution",
    "anomaly_type",
    "classification_confidence",
    "classification_evidence",
)
ENDINGS = {
    "critical": "Immediate investigation is recommended.",
    "high": "Multiple suspicious behavioral signals require investigation.",
    "medium": "Behavioral deviations warrant review.",
    "low": "No significant threat indicators were detected.",
}
# End of fixed values.


_ENDING = " ".join(f"WHEN '{name}' THEN {quote(text)}" for name, text in ENDINGS.items())
_SUMMARY = (
    "concat(upper(severity), ' risk activity ', IF(severity = 'low', 'observed', 'detected'), "
    f"' with a risk score of ', {whole('risk_score')}, '/100. ', CASE severity {_ENDING} END)"
)


def explain(scored: DataFrame) -> DataFrame:
    """Add the one-sentence `summary` to scored events."""
    return scored.selectExpr("*", f"{_SUMMARY} AS summary")


def assessments(classified: DataFrame) -> DataFrame:
    """The fixed 14-column output table."""
    return explain(classified).select(*ASSESSMENT_COLUMNS)


def alerts(classified: DataFrame, *, created_at: str = "current_timestamp()") -> DataFrame:
    """Open alert records of suspicious events, on the alert severity scale."""
    severity = bucket("risk_score", ALERT_SEVERITY)
    return classified.filter("is_suspicious").selectExpr(
        "substr(sha2(event_id, 256), 1, 32) AS alert_id",
        "event_id",
        "entity_id",
        f"struct(risk_score AS score, classification_confidence AS confidence, {severity} AS severity) AS risk",
        "anomaly_type AS classification",
        f"{evidence(classified)} AS evidence",
        "'open' AS status",
        f"{created_at} AS created_at",
    )
