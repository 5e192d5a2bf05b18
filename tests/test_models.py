"""Forest, ranking, budget, metrics, geometry and trees as data."""

import math
import random

import pytest

from driftwatch.functions.geo import haversine_km, speed_kmh
from driftwatch.operators.budget import alert_budget, top_alerts
from driftwatch.operators.evaluate import attack_metrics, classification_accuracy, detector_metrics, require_rows
from driftwatch.operators.forest import (
    FOREST_SCHEMA,
    MAX_TREES,
    Forest,
    average_path,
    check_parameters,
    fit_forest,
    raw_scores,
    score_forest,
    tree_checks,
    walked_scores,
)
from driftwatch.operators.matrix import feature_matrix
from driftwatch.operators.profiles import learn_baseline
from driftwatch.operators.rank import quantile, value_at
from driftwatch.schema import MODEL_FEATURES
from driftwatch.sources.telemetry import profile_events, scoring_events

# --- forest -----------------------------------------------------------------------------


def matrix(spark, rows):
    schema = "event_id string, " + ", ".join(f"{c} double" for c in MODEL_FEATURES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(7)
    rows = [(f"E{i:05d}", *[rng.gauss(0, 1) for _ in MODEL_FEATURES]) for i in range(600)]
    return matrix(spark, rows)


@pytest.fixture(scope="module")
def forest(training):
    return fit_forest(training, n_estimators=30, contamination=0.05)


def test_extreme_rows_score_higher(spark, forest):
    probe = matrix(spark, [("far", *[8.0] * 23), ("near", *[0.0] * 23)])
    got = {r["event_id"]: r for r in score_forest(probe, forest).collect()}
    assert got["far"]["ml_anomaly_score"] > got["near"]["ml_anomaly_score"]
    assert got["far"]["ml_flagged"] and not got["near"]["ml_flagged"]


def test_share_flagged_is_the_contamination(training, forest):
    assert score_forest(training, forest).filter("ml_flagged").count() == 30
    assert score_forest(training, forest).filter("ml_flagged <> (ml_anomaly_score > 0)").isEmpty()


def test_forest_does_not_depend_on_partitions(training, forest):
    again = fit_forest(training.repartition(7, "latitude"), n_estimators=30, contamination=0.05)
    assert again.threshold == forest.threshold
    assert again.nodes.exceptAll(forest.nodes).isEmpty()


def test_forest_guards(spark, training, forest):
    for options in ({"contamination": 0.0}, {"contamination": 0.6}, {"n_estimators": 0}):
        with pytest.raises(ValueError):
            fit_forest(training, **options)
    with pytest.raises(ValueError, match="empty"):
        fit_forest(training.limit(0))
    with pytest.raises(RuntimeError):
        score_forest(training, Forest(forest.nodes, 256, None))


def test_single_row_forest(spark, training):
    one = fit_forest(training.limit(1), n_estimators=3)
    assert score_forest(training.limit(1), one).first()["ml_flagged"] is False


def test_average_path():
    assert (average_path(1), average_path(2)) == (0.0, 1.0)
    assert average_path(256) == pytest.approx(10.24, abs=0.01)


# --- ranking and budget -----------------------------------------------------------------


def scored(spark, rows):
    data = [(f"E{i:04d}", float(s), label) for i, (s, label) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id string, risk_score double, label string")


def test_rank_narrowing_is_exact(spark):
    rng = random.Random(3)
    values = sorted(rng.choice([1.0, 2.0, rng.random()]) for _ in range(500))
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for rank in (1, 2, 250, 499, 500):
        assert value_at(df, ["v"], rank, 500, pivots=4)[0] == values[rank - 1]
    assert quantile(df, "v", 0.5, 500, pivots=4) == (values[249] + values[250]) / 2


def test_one_value_everywhere_ends(spark):
    df = spark.range(1000).selectExpr("7D AS v")
    assert value_at(df, ["v"], 600, 1000, pivots=4)[0] == 7.0


def test_budget_cuts_ties_by_id_and_ranks_unusable_scores_last(spark):
    # 12 rows, a quarter of them alerted: the cut falls within five equal scores
    rows = [(70, "lateral_movement"), (55, "normal"), (55, "brute_force"), (55, None), (55, "normal"), (55, "normal")]
    rows += [(float("nan"), "brute_force"), (float("nan"), "normal")] + [(3, "normal")] * 4
    df = scored(spark, rows)
    got = alert_budget(df, 0.25).first()
    assert (got["alert_count"], got["true_alerts"], got["false_alerts"]) == (3, 2, 1)
    chosen = {r["event_id"] for r in top_alerts(df, 3).collect()}
    assert chosen == {r["event_id"] for r in df.where("risk_score = 70 OR risk_score = 55").orderBy("event_id").limit(3).collect()}
    assert alert_budget(df, 1.0).first()["alert_count"] == len(rows)
    assert alert_budget(df, 1e-9).first()["alert_count"] == 1


@pytest.mark.parametrize("pivots", [4, 64])
def test_budget_equals_sorting_at_any_number_of_pivots(spark, pivots):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 35, 35, rng.random() * 100, float("nan")]), None) for _ in range(400)]
    ranking = sorted(range(400), key=lambda i: (rows[i][0] != rows[i][0], -rows[i][0] if rows[i][0] == rows[i][0] else 0, i))
    df = scored(spark, rows)
    for k in (1, 150, 399, 400):
        assert {r["event_id"] for r in top_alerts(df, k, pivots=pivots).collect()} == {f"E{i:04d}" for i in ranking[:k]}
    assert alert_budget(df, 0.3, pivots=pivots).first()["true_alerts"] == 120


@pytest.mark.parametrize("fraction", [0.0, -3.0, 1.0001, 25.0])
def test_budget_fraction_guard(spark, fraction):
    with pytest.raises(ValueError):
        alert_budget(scored(spark, [(1, None)]), fraction)


def test_budget_input_guards(spark):
    df = scored(spark, [(1, None)])
    with pytest.raises(ValueError, match="no rows"):
        alert_budget(df.limit(0))
    with pytest.raises(ValueError, match="label"):
        alert_budget(df.drop("label"))


# --- metrics ----------------------------------------------------------------------------


def test_metrics(spark):
    rows = [("normal", True), ("normal", False), (None, True), ("brute_force", False)]
    df = spark.createDataFrame(rows, "label string, ml_flagged boolean").selectExpr("*", "0.5D AS ml_anomaly_score")
    got = detector_metrics(df).first()
    assert [got[c] for c in ("true_positives", "false_positives", "true_negatives", "false_negatives")] == [1] * 4
    assert (got["precision"], got["recall"], got["f1_score"], got["false_positive_rate"]) == (0.5,) * 4
    attacks = [(r["attack_type"], r["total"], r["detected"]) for r in attack_metrics(df).collect()]
    assert attacks == [("None", 1, 1), ("brute_force", 1, 0)]
    nothing = detector_metrics(df.limit(0)).first()
    assert nothing["precision"] == nothing["f1_score"] == 0.0
    with pytest.raises(ValueError):
        require_rows(df.limit(0), "feature matrix")


def test_accuracy(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "e string, anomaly_type string")
    got = {r["expected"]: r["accuracy"] for r in classification_accuracy(df, "e").collect()}
    assert got == {"a": 0.5, "b": 1.0, "overall": pytest.approx(2 / 3)}


# --- geometry ---------------------------------------------------------------------------


def test_distance_and_speed(spark):
    porto_wellington = haversine_km("41.15D", "-8.61D", "-41.29D", "174.78D")
    antipodes = haversine_km("0D", "0D", "0D", "180D")
    row = spark.range(1).selectExpr(
        f"{porto_wellington} AS far",
        f"{antipodes} AS half",
        f"{haversine_km('1D', '1D', '1D', '1D')} AS none",
        f"{haversine_km('1D', 'cast(NULL AS double)', '1D', '1D')} AS unknown",
        f"{speed_kmh('100D', '1800000000L')} AS speed",
        f"{speed_kmh('100D', '0L')} AS still",
    ).first()
    assert 19000 < row["far"] < 20010
    assert row["half"] == pytest.approx(math.pi * 6371)
    assert (row["none"], row["unknown"], row["speed"], row["still"]) == (0.0, None, 200.0, 0.0)
    with pytest.raises(Exception, match="positive"):
        spark.range(1).selectExpr(f"{speed_kmh('1D', '-id', strict=True)} AS s").collect()


# --- trees as data ----------------------------------------------------------------------


def test_expressions_walk_as_python_does(spark, sf_dir):
    baseline = learn_baseline(profile_events(spark, sf_dir))
    matrix = feature_matrix(scoring_events(spark, sf_dir), baseline)
    forest = fit_forest(matrix, n_estimators=10)
    got = {r["event_id"]: r["raw_score"] for r in walked_scores(matrix, forest).collect()}
    want = {r["event_id"]: r["raw_score"] for r in raw_scores(matrix, forest).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_damaged_trees_are_found(spark):
    rows = [(0, 0, "a", 1.0, 1, 2, 5, 0), (0, 1, None, None, None, None, 3, 1), (0, 2, None, None, None, None, 1, 1), (0, 7, None, None, None, None, 2, 3)]
    assert tuple(tree_checks(spark.createDataFrame(rows, FOREST_SCHEMA)).first()) == (0, 2, 6, 3, 1)


def test_forests_are_bounded():
    with pytest.raises(ValueError, match="does not fit"):
        check_parameters(0.1, MAX_TREES + 1)
