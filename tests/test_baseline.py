"""Profiles, novelty and deviation."""

import pytest
from test_windows import SCHEMA, event, table

from driftwatch.operators.deviation import (
    deviation_features,
    deviation_features_from_arrays,
    require_known,
    unknown_entities,
)
from driftwatch.operators.matrix import check_columns, check_values, feature_matrix
from driftwatch.operators.profiles import fits_arrays, learn_baseline, profiles_with_sets
from driftwatch.sources.models import store_baseline
from driftwatch.sources.telemetry import profile_events, scoring_events

AT = {c.split()[0]: i for i, c in enumerate(SCHEMA.split(", "))}


def changed(row, **values):
    row = list(row)
    for name, value in values.items():
        row[AT[name]] = value
    return tuple(row)


def learned(spark, events):
    return learn_baseline(table(spark, events))


def test_statistics_use_normal_events_only(spark):
    events = [
        changed(event(1), session_duration_seconds=100),
        changed(event(2), session_duration_seconds=300, outcome="failure", label="normal"),
        changed(event(3), session_duration_seconds=9000, label="brute_force"),
    ]
    row = learned(spark, events).statistics.first()
    assert (row["event_count"], row["mean_session_duration"], row["session_duration_std"]) == (2, 200.0, 100.0)
    assert row["authentication_failure_rate"] == 0.5
    assert row["profile_valid"]


def test_late_mean_hour_is_flagged(spark):
    late = 1_700_000_000_000_000 // 86_400_000_000 * 86_400_000_000 + (23 * 60 + 30) * 60_000_000
    row = learned(spark, [changed(event(1), ts_us=late, local_us=late)]).statistics.first()
    assert row["mean_hour"] == 23.5 and not row["profile_valid"]


def test_hours_wrap_at_midnight(spark):
    day = 1_700_000_000_000_000 // 86_400_000_000 * 86_400_000_000
    known = changed(event(1), ts_us=day, local_us=day + 23 * 3_600_000_000)
    now = changed(event(2), ts_us=day, local_us=day + 1 * 3_600_000_000)
    row = deviation_features(table(spark, [now]), learned(spark, [known])).first()
    assert row["hour_deviation"] == 2.0
    assert row["hour_deviation_zscore"] == 0.0  # no spread in the baseline


@pytest.mark.parametrize(
    ("change", "new", "mismatch"),
    [
        ({}, 0, 0),
        ({"fingerprint_id": "device_2"}, 1, 0),
        ({"operating_system": "Android"}, 0, 1),
        ({"browser": None}, 0, 1),
        ({"fingerprint_id": "device_n", "browser": None}, 0, 0),
    ],
)
def test_devices(spark, change, new, mismatch):
    known = [event(1), changed(event(2), fingerprint_id="device_n", browser=None)]
    now = table(spark, [changed(event(3), **change)])
    row = deviation_features(now, learned(spark, known)).first()
    assert (row["is_new_device"], row["device_fingerprint_mismatch"]) == (new, mismatch)
    row = deviation_features_from_arrays(now, profiles_with_sets(table(spark, known))).first()
    assert (row["is_new_device"], row["device_fingerprint_mismatch"]) == (new, mismatch)


def test_arrays_and_joins_agree(spark, sf_dir):
    period = profile_events(spark, sf_dir)
    baseline = learn_baseline(period)
    assert fits_arrays(baseline) and not fits_arrays(baseline, limit=2)

    def rounded(df):
        names = [f"round({c}, 6) AS {c}" if t == "double" else c for c, t in df.dtypes]
        return df.selectExpr(*names)

    events = scoring_events(spark, sf_dir)
    joins = rounded(deviation_features(events, baseline))
    arrays = rounded(deviation_features_from_arrays(events, profiles_with_sets(period)))
    assert joins.count() == events.count()
    assert joins.exceptAll(arrays).isEmpty() and arrays.exceptAll(joins).isEmpty()


def test_unknown_entities(spark):
    baseline = learned(spark, [event(1)])
    events = table(spark, [event(2), event(3, entity="stranger")])
    assert [r["event_id"] for r in unknown_entities(events, baseline.statistics).collect()] == ["EVENT_0003"]
    with pytest.raises(ValueError, match="stranger"):
        require_known(events, baseline.statistics)
    assert feature_matrix(events, baseline).count() == 1
    with pytest.raises(ValueError):
        feature_matrix(events, baseline, strict=True)


def test_empty_input_is_refused(spark):
    with pytest.raises(ValueError, match="empty"):
        learn_baseline(table(spark, []), check=True)
    with pytest.raises(ValueError, match="normal"):
        learn_baseline(table(spark, [changed(event(1), label="brute_force")]), check=True)


def test_matrix_checks(spark):
    matrix = feature_matrix(table(spark, [event(2)]), learned(spark, [event(1)]))
    check_columns(matrix)
    assert check_values(matrix) == 1
    with pytest.raises(ValueError, match="columns"):
        check_columns(matrix.drop("latitude"))
    with pytest.raises(ValueError, match="numeric"):
        check_columns(matrix.withColumn("latitude", matrix["latitude"].cast("string")))
    with pytest.raises(ValueError, match="missing"):
        check_values(matrix.selectExpr(*[c if c != "latitude" else "double('NaN') AS latitude" for c in matrix.columns]))


def rounded(df):
    names = [f"round({c}, 6) AS {c}" if t == "double" else c for c, t in df.dtypes]
    return df.selectExpr(*names)


@pytest.mark.parametrize("share", [1, 3, 10**6])
def test_busy_entities_are_dealt_into_shares(spark, sf_dir, tmp_path, share):
    """However many shares an entity has, the result is that of the arrays; the events are exchanged once."""
    period = profile_events(spark, sf_dir)
    baseline = store_baseline(learn_baseline(period), str(tmp_path / "baseline"))
    scoring_events(spark, sf_dir).write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = deviation_features(events, baseline, rows_per_share=share)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, rounded(found).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert got == sorted(map(str, rounded(deviation_features_from_arrays(events, profiles_with_sets(period))).collect()))


def test_absent_values_are_new(spark):
    known = event(1)
    now = table(spark, [known]).selectExpr("* EXCEPT (source_ip, resource_accessed)", "cast(NULL AS string) AS source_ip", "cast(NULL AS string) AS resource_accessed")
    found = deviation_features(now, learned(spark, [known])).first()
    assert (found["is_new_ip"], found["is_new_resource"], found["is_new_device"]) == (1, 1, 0)


def test_top_alerts_compute_the_scores_once(spark):
    """Ranking, cut and result read one stored table; the scores were computed again for the result."""
    from pyspark.sql import functions as F

    from driftwatch.operators.budget import top_alerts

    reads = spark.sparkContext.accumulator(0)

    @F.udf("double", useArrow=False)
    def score(i):
        reads.add(1)
        return float(i % 7)

    scored = spark.range(50).select(F.col("id").cast("string").alias("event_id"), score.asNondeterministic()("id").alias("risk_score"), F.lit("normal").alias("label"))
    got = {r["event_id"] for r in top_alerts(scored, 5).collect()}
    assert got == {"13", "20", "27", "34", "41"} and reads.value == 50
