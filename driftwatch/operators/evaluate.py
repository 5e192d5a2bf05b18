"""Detection quality: confusion counts, per-attack rates, accuracy, label share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The label of ordinary events, and the name an absent label goes by.
NORMAL = "normal"
MISSING_LABEL = "None"
# End of fixed values.

# an absent label counts as an attack type of its own
TRUTH = f"coalesce(label, '{MISSING_LABEL}')"
IS_ATTACK = f"({TRUTH} <> '{NORMAL}')"


def ratio(numerator: str, denominator: str) -> str:
    """Quotient, 0 where the denominator is 0."""
    return f"IF(({denominator}) = 0, 0D, ({numerator}) / ({denominator}))"


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ValueError(f"cannot evaluate an empty {what}")


def detector_metrics(scored: DataFrame, predicted: str = "ml_flagged") -> DataFrame:
    """One row of counts and rates for a boolean decision column (one aggregation)."""
    counts = scored.agg(
        F.expr(f"count_if({predicted} AND {IS_ATTACK})").alias("true_positives"),
        F.expr(f"count_if({predicted} AND NOT {IS_ATTACK})").alias("false_positives"),
        F.expr(f"count_if(NOT {predicted} AND NOT {IS_ATTACK})").alias("true_negatives"),
        F.expr(f"count_if(NOT {predicted} AND {IS_ATTACK})").alias("false_negatives"),
    )
    return counts.selectExpr(
        "*",
        f"{ratio('true_positives', 'true_positives + false_positives')} AS precision",
        f"{ratio('true_positives', 'true_positives + false_negatives')} AS recall",
        f"{ratio('false_positives', 'false_positives + true_negatives')} AS false_positive_rate",
        f"{ratio('2D * precision * recall', 'precision + recall')} AS f1_score",
    )


def attack_metrics(
    scored: DataFrame, predicted: str = "ml_flagged", score: str = "ml_anomaly_score"
) -> DataFrame:
    """Total, detected, rate and mean score per attack type, sorted by name."""
    return (
        scored.filter(IS_ATTACK)
        .groupBy(F.expr(TRUTH).alias("attack_type"))
        .agg(
            F.count("*").alias("total"),
            F.expr(f"count_if({predicted})").alias("detected"),
            F.avg(score).alias("mean_anomaly_score"),
        )
        .selectExpr("*", f"{ratio('detected', 'total')} AS detection_rate")
        .orderBy("attack_type")
    )


def classification_accuracy(classified: DataFrame, expected: str, actual: str = "anomaly_type") -> DataFrame:
    """Accuracy per expected class, and over all rows under the name `overall`."""
    return (
        classified.selectExpr(f"{expected} AS expected", f"{expected} = {actual} AS hit")
        .rollup("expected")
        .agg(
            F.grouping("expected").alias("overall"),
            F.count("*").alias("total"),
            F.expr("count_if(hit)").alias("correct"),
        )
        .selectExpr(
            "IF(overall = 1, 'overall', expected) AS expected",
            "total",
            "correct",
            f"{ratio('correct', 'total')} AS accuracy",
        )
    )


def label_rate(events: DataFrame) -> DataFrame:
    """Number of events and the share that is not labelled normal (absent labels included)."""
    counts = events.agg(
        F.count("*").alias("total_events"), F.expr(f"count_if({IS_ATTACK})").alias("malicious_events")
    )
    return counts.selectExpr("*", f"{ratio('malicious_events', 'total_events')} AS anomaly_rate")
