"""End-to-end plans: learn a baseline, then score events against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.operators.classify import classify
from driftwatch.operators.deviation import unknown_entities
from driftwatch.operators.explain import assessments
from driftwatch.operators.forest import Forest, fit_forest, score_forest
from driftwatch.operators.matrix import feature_matrix
from driftwatch.operators.profiles import Baseline, learn_baseline
from driftwatch.operators.risk import risk_scores


@dataclass(frozen=True)
class Model:
    """What scoring needs: the baseline tables and the fitted forest (or rules alone)."""

    baseline: Baseline
    forest: Forest | None = None


def learn(profile_events: DataFrame, training_events: DataFrame, **forest_options) -> Model:
    """Baseline from one period, forest from the feature matrix of the next."""
    baseline = learn_baseline(profile_events)
    matrix = feature_matrix(training_events, baseline)
    return Model(baseline, fit_forest(matrix, **forest_options))


def judge(matrix: DataFrame) -> DataFrame:
    """Risk and attack type of feature rows that carry a forest score."""
    return classify(risk_scores(matrix))


def without_forest(matrix: DataFrame, score: float = -0.1) -> DataFrame:
    """A fixed unremarkable forest verdict, to run the rules on their own."""
    return matrix.withColumns({"ml_anomaly_score": F.lit(score), "ml_flagged": F.lit(False)})


def split_collisions(targets: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets that are new, and those whose event id the history already holds."""
    ids = history.select("event_id")
    return (
        targets.join(ids, "event_id", "left_anti"),
        targets.join(ids, "event_id", "left_semi"),
    )


def score_events(
    events: DataFrame,
    model: Model,
    *,
    history: DataFrame | None = None,
    mode: str = "joint",
) -> DataFrame:
    """Features, forest score, risk and attack type of every event of a known entity."""
    return judge_matrix(feature_matrix(events, model.baseline, history=history, mode=mode), model)


def judge_matrix(matrix: DataFrame, model: Model) -> DataFrame:
    """Forest score (if the model has a forest), risk and attack type of feature rows."""
    if model.forest is None:
        return judge(without_forest(matrix))
    return judge(score_forest(matrix, model.forest))


def assess(events: DataFrame, model: Model, **options) -> DataFrame:
    """The 14-column assessment of every event of a known entity."""
    return assessments(score_events(events, model, **options))


def unassessed(events: DataFrame, model: Model) -> DataFrame:
    """The events that `assess` has no output for: their entity has no baseline."""
    return unknown_entities(events, model.baseline.statistics)
