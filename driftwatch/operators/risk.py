"""Additive risk score with reasons: behavioural rules plus the forest's evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from driftwatch.functions.text import present, quote, whole

# Points, thresholds and wording of the score.
BEHAVIOURAL_CAP = 80.0
TOTAL_CAP = 100.0
ML_BASE = 10.0
ML_SCALE = 100.0
ML_CAP = 20.0
ML_NEAR_SCORE = -0.025
ML_NEAR_POINTS = 5.0
SUSPICIOUS_SCORE = 30.0
SCORE_SEVERITY = ((80.0, "critical"), (60.0, "high"), (30.0, "medium"))
ALERT_SEVERITY = ((85.0, "critical"), (65.0, "high"), (35.0, "medium"))
NO_REASON = "No significant behavioral risk signals were observed"
ML_REASON = "Isolation Forest classified the event as statistically anomalous"
# End of fixed values.


@dataclass(frozen=True)
class Rule:
    """One behavioural rule; `when` and `text` are SQL expressions."""

    signal: str
    points: float
    when: str
    text: str


def feature(df: DataFrame, name: str) -> str:
    """A feature column as double; 0 where the table lacks it or it is null."""
    return f"coalesce(cast({name} AS double), 0D)" if name in df.columns else "0D"


def count_feature(df: DataFrame, name: str) -> str:
    return f"cast({feature(df, name)} AS bigint)"


def rules(df: DataFrame) -> list[Rule]:
    """Behavioural rules in the order their reasons are listed."""
    failed = count_feature(df, "failed_logins_10m")
    speed = feature(df, "implied_speed_kmh")
    distance = feature(df, "distance_from_previous_km")
    mismatch = count_feature(df, "device_fingerprint_mismatch")
    fanout = count_feature(df, "source_ip_entity_fanout_10m")
    resources = count_feature(df, "unique_resources_30m")
    new_resource = count_feature(df, "is_new_resource")
    velocity = feature(df, "resource_access_velocity_30m")
    hour_z = feature(df, "hour_deviation_zscore")
    session_z = feature(df, "session_duration_deviation_zscore")
    burst = f"concat({failed}, ' failed logins occurred within 10 minutes')"
    return [
        Rule("failed_logins_10m", 35.0, f"{failed} >= 10", burst),
        Rule("failed_logins_10m", 20.0, f"{failed} BETWEEN 5 AND 9", burst),
        Rule(
            "implied_speed_kmh",
            45.0,
            f"{speed} >= 1000D",
            f"concat('Travel between consecutive events would require ', {whole(speed)}, ' km/h')",
        ),
        Rule(
            "implied_speed_kmh",
            25.0,
            f"{speed} >= 500D AND {speed} < 1000D",
            f"concat('Unusually high travel speed of ', {whole(speed)}, ' km/h')",
        ),
        Rule(
            "distance_from_previous_km",
            10.0,
            f"{distance} >= 3000D",
            f"concat('Consecutive activity occurred ', {whole(distance)}, ' km apart')",
        ),
        Rule(
            "device_fingerprint_mismatch",
            40.0,
            f"{mismatch} = 1",
            quote("Known device identifier presented an unexpected fingerprint"),
        ),
        Rule(
            "source_ip_entity_fanout_10m",
            35.0,
            f"{fanout} >= 5",
            f"concat('A single source IP accessed ', {fanout}, ' entities within 10 minutes')",
        ),
        Rule(
            "source_ip_entity_fanout_10m",
            20.0,
            f"{fanout} BETWEEN 3 AND 4",
            quote("Source IP accessed multiple entities within a short period"),
        ),
        Rule(
            "unique_resources_30m",
            30.0,
            f"{resources} >= 5 AND {new_resource} = 1",
            quote("Entity rapidly accessed multiple resources including an unfamiliar resource"),
        ),
        Rule(
            "resource_access_velocity_30m",
            10.0,
            f"{velocity} >= 0.20D",
            quote("Resource access velocity is unusually high"),
        ),
        Rule(
            "hour_deviation_zscore",
            10.0,
            f"{hour_z} >= 3D",
            quote("Activity occurred far outside the entity's typical access hours"),
        ),
        Rule(
            "session_duration_deviation_zscore",
            10.0,
            f"{session_z} >= 3D",
            quote("Session duration strongly deviates from the entity's normal behavior"),
        ),
    ]


def bucket(score: str, scale: tuple[tuple[float, str], ...]) -> str:
    """Severity of a score on one of the two scales."""
    steps = " ".join(f"WHEN {score} >= {bound}D THEN '{name}'" for bound, name in scale)
    return f"CASE {steps} ELSE 'low' END"


_ML_POINTS = (
    f"CASE WHEN ml_flagged THEN least({ML_BASE}D + greatest(ml_anomaly_score, 0D) * {ML_SCALE}D, {ML_CAP}D) "
    f"WHEN ml_anomaly_score >= {ML_NEAR_SCORE}D THEN {ML_NEAR_POINTS}D ELSE 0D END"
)


def evidence(df: DataFrame) -> str:
    """Every signal that fired, with its points and wording (needs `ml_contribution`)."""

    def item(when: str, signal: str, points: str, text: str) -> str:
        return (
            f"IF({when}, struct('{signal}' AS signal, {points} AS contribution, "
            f"{text} AS description), NULL)"
        )

    return present(
        *[item(r.when, r.signal, f"{r.points}D", r.text) for r in rules(df)],
        item("ml_flagged", "ml_anomaly_score", "ml_contribution", quote(ML_REASON)),
    )


def risk_scores(df: DataFrame) -> DataFrame:
    """Add contributions, `risk_score`, `severity`, `is_suspicious` and `reasons`.

    Needs `ml_anomaly_score` and `ml_flagged`. All rules are expressions over one row, so the
    step fuses with whatever produced the features.
    """
    found = rules(df)
    points = " + ".join(f"IF({r.when}, {r.points}D, 0D)" for r in found)
    said = present(
        *[f"IF({r.when}, {r.text}, NULL)" for r in found], f"IF(ml_flagged, {quote(ML_REASON)}, NULL)"
    )
    total = f"least(behavioral_contribution + ml_contribution, {TOTAL_CAP}D)"
    return df.selectExpr(
        "*",
        f"least({points}, {BEHAVIOURAL_CAP}D) AS behavioral_contribution",
        f"{_ML_POINTS} AS ml_contribution",
        f"{said} AS said",
        f"{total} AS risk_score",
        f"{bucket('risk_score', SCORE_SEVERITY)} AS severity",
        f"risk_score >= {SUSPICIOUS_SCORE}D AS is_suspicious",
        f"IF(size(said) = 0, array({quote(NO_REASON)}), said) AS reasons",
    ).drop("said")
