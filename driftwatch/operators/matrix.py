"""The 23-column numeric feature table, keyed by event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.operators.deviation import (
    deviation_features,
    deviation_features_from_arrays,
    require_known,
)
from driftwatch.operators.event_features import EVENT_COLUMNS
from driftwatch.operators.profiles import Baseline
from driftwatch.operators.sequence import window_features
from driftwatch.schema import MODEL_FEATURES

IDENTITY = ("event_id", "entity_id", "ts_us", "label")


def feature_matrix(
    events: DataFrame,
    baseline: Baseline | DataFrame,
    *,
    history: DataFrame | None = None,
    mode: str = "joint",
    strict: bool = False,
) -> DataFrame:
    """Identity, label and the model features of every event that has a baseline.

    `baseline` is a `Baseline`, or the output of `profiles_with_sets` when its sets are small.
    Windows come before the baseline joins: they need all events of an address, including
    those of entities without a baseline, and a join by entity would pin a heavy entity to
    one partition for the windows after it.
    """
    if strict:
        if events.isEmpty():
            raise ValueError("no events to build features for: the table is empty")
        statistics = baseline.statistics if isinstance(baseline, Baseline) else baseline
        require_known(events, statistics)
    return matrix_of_windows(window_features(events, history, mode=mode), baseline)


def matrix_of_windows(rows: DataFrame, baseline: Baseline | DataFrame) -> DataFrame:
    """The matrix of flat events that have their window columns already."""
    if isinstance(baseline, Baseline):
        rows = deviation_features(rows, baseline)
    else:
        rows = deviation_features_from_arrays(rows, baseline)
    return model_columns(rows)


def model_columns(rows: DataFrame) -> DataFrame:
    """Identity and features, as doubles, of rows that carry all derived columns."""
    values = [f"cast({EVENT_COLUMNS.get(c, c)} AS double) AS {c}" for c in MODEL_FEATURES]
    return rows.selectExpr(*IDENTITY, *values)


def check_columns(matrix: DataFrame) -> None:
    """The model features in their order, all numeric."""
    features = [c for c in matrix.columns if c not in IDENTITY]
    if features != list(MODEL_FEATURES):
        raise ValueError("feature matrix columns do not match the model features")
    for field in matrix.schema:
        if field.name in MODEL_FEATURES and not isinstance(field.dataType, T.NumericType):
            raise ValueError("feature matrix must contain only numeric values")


def check_values(matrix: DataFrame) -> int:
    """No missing value (one aggregate); returns the number of rows."""
    found = missing_values(matrix).first()
    if found["rows_with_missing"]:
        raise ValueError("some features are missing (null or NaN)")
    return found["n_rows"]


def missing_values(matrix: DataFrame) -> DataFrame:
    """Row count and number of rows with a null or NaN feature."""
    missing = " OR ".join(f"{c} IS NULL OR isnan({c})" for c in MODEL_FEATURES)
    return matrix.agg(
        F.expr("count(*)").alias("n_rows"), F.expr(f"count_if({missing})").alias("rows_with_missing")
    )
