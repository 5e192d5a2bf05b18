"""The tables and results as SQL views, for those who ask in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftwatch.operators.event_features import event_features
from driftwatch.operators.explain import alerts, assessments
from driftwatch.operators.matrix import feature_matrix
from driftwatch.plans.assess import Model, judge_matrix, unassessed


def register_views(events: DataFrame, model: Model, prefix: str = "", history: DataFrame | None = None) -> list[str]:
    """Register temporary views over some events and a model; returns their names.

    ``events``, ``event_features``, ``profiles``, ``feature_matrix``, ``assessments``, ``alerts`` and ``unassessed``, each
    after ``prefix``. Views are plans: nothing runs until a query asks.
    """
    matrix = feature_matrix(events, model.baseline, history=history)
    judged = judge_matrix(matrix, model)
    views = {
        "events": events,
        "event_features": event_features(events),
        "profiles": model.baseline.statistics,
        "feature_matrix": matrix,
        "assessments": assessments(judged),
        "alerts": alerts(judged),
        "unassessed": unassessed(events, model),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
