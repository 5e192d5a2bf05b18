"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.functions.clock import DAY_US
from driftwatch.functions.geo import haversine_km, speed_kmh
from driftwatch.operators.budget import alert_budget, top_alerts
from driftwatch.operators.classify import classify
from driftwatch.operators.deviation import deviation_features
from driftwatch.operators.evaluate import (
    attack_metrics,
    classification_accuracy,
    detector_metrics,
    label_rate,
)
from driftwatch.operators.event_features import event_features, export_events
from driftwatch.operators.explain import alerts, assessments, explain
from driftwatch.operators.forest import fit_forest, score_forest, tree_checks, walked_paths
from driftwatch.operators.incremental import fold_day, merged_baseline
from driftwatch.operators.ingest import accepted, deduplicate, ingest, quarantined
from driftwatch.operators.matrix import feature_matrix, missing_values
from driftwatch.operators.profiles import learn_baseline, profile_sets, profile_statistics, set_sizes
from driftwatch.operators.records import alert_violations, entity_violations, risk_violations
from driftwatch.operators.rank import quantile
from driftwatch.operators.risk import risk_scores
from driftwatch.operators.sequence import (
    COUNTS,
    FAN_OUT,
    TRAVEL,
    carried_history,
    sketched_fan_out,
    window_features,
)
from driftwatch.plans.assess import (
    Model,
    assess,
    judge,
    score_events,
    split_collisions,
    unassessed,
    without_forest,
)
from driftwatch.plans.views import register_views
from driftwatch.schema import FLAT_COLUMNS, MODEL_FEATURES, flat_events
from driftwatch.session import shared_folder, stored
from driftwatch.sources.alerts import read_alerts, write_alerts
from driftwatch.sources.models import load_model, save_model, store_baseline
from driftwatch.sources.payloads import raw_payloads
from driftwatch.sources.telemetry import (
    EPOCH_US,
    PROFILE_DAYS,
    SCORE_DAYS,
    TRAIN_DAYS,
    profile_events,
    scoring_events,
    split,
    telemetry,
    training_events,
)
from driftwatch.streaming.scoring import (
    close_input,
    outputs,
    results,
    run_available,
    score_stream,
    window_stream,
)

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(*names: str) -> list[str]:
    return [f"round({n}, 6) AS {n}" for n in names]


def _joined(name: str) -> str:
    return f"concat_ws('|', {name}) AS {name}"


def _baseline(spark: SparkSession, d: str):
    return learn_baseline(profile_events(spark, d))


def _earlier(spark: SparkSession, d: str, first_day: int = SCORE_DAYS[0]) -> DataFrame:
    """What the windows of a day's events can see of the days before."""
    return carried_history(telemetry(spark, d).filter(f"day < {first_day}"), EPOCH_US + first_day * DAY_US)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return feature_matrix(scoring_events(spark, d), _baseline(spark, d), history=_earlier(spark, d))


def _rule_scores(spark: SparkSession, d: str) -> DataFrame:
    return risk_scores(without_forest(_matrix(spark, d)))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return classify(_rule_scores(spark, d))


def _learned(spark: SparkSession, d: str) -> Model:
    """A model whose baseline is stored, so that training and scoring both read what was learnt once."""
    baseline = store_baseline(_baseline(spark, d), f"{shared_folder(spark)}/baseline-{uuid.uuid4().hex}")
    training = feature_matrix(training_events(spark, d), baseline, history=_earlier(spark, d, TRAIN_DAYS[0]))
    return Model(baseline, fit_forest(training))


# --- events and baselines ---------------------------------------------------------------


def q_event_features(spark, d):
    return event_features(telemetry(spark, d))


def q_event_export(spark, d):
    return export_events(telemetry(spark, d))


def q_profile_stats(spark, d):
    names = (
        "mean_hour",
        "hour_std",
        "mean_session_duration",
        "session_duration_std",
        "authentication_failure_rate",
    )
    return profile_statistics(profile_events(spark, d)).selectExpr(
        "entity_id", "event_count", *_rounded(*names), "profile_valid"
    )


def q_profile_sets(spark, d):
    return profile_sets(_baseline(spark, d))


def q_profile_set_sizes(spark, d):
    return set_sizes(_baseline(spark, d))


def q_deviation_features(spark, d):
    return deviation_features(scoring_events(spark, d), _baseline(spark, d)).selectExpr(
        "event_id",
        "is_new_ip",
        "is_new_resource",
        "is_new_device",
        "device_fingerprint_mismatch",
        *_rounded(
            "hour_deviation",
            "hour_deviation_zscore",
            "session_duration_deviation",
            "session_duration_deviation_zscore",
        ),
    )


def q_unknown_entities(spark, d):
    """Events that cannot be scored when no edge device was learnt."""
    learnt = learn_baseline(profile_events(spark, d).filter("entity_type <> 'edge_device'"))
    return unassessed(scoring_events(spark, d), Model(learnt)).select("event_id", "entity_id")


def _folded(spark: SparkSession, d: str):
    """The baseline of the profile days, folded in one by one, the last of them twice."""
    folder = f"{shared_folder(spark)}/folded-{uuid.uuid4().hex}"
    first, last = PROFILE_DAYS
    for version, day in enumerate((*range(first, last + 1), last)):
        fold_day(spark, folder, split(telemetry(spark, d), (day, day)), min(version, last - first))
    return merged_baseline(spark, folder, last - first)


def q_baseline_merged(spark, d):
    return _folded(spark, d).statistics.selectExpr(
        "entity_id",
        "event_count",
        *_rounded("mean_hour", "hour_std", "mean_session_duration", "session_duration_std", "authentication_failure_rate"),
        "profile_valid",
    )


def q_baseline_merged_sets(spark, d):
    return profile_sets(_folded(spark, d))


# --- windows ----------------------------------------------------------------------------


def q_window_counts(spark, d):
    found = window_features(telemetry(spark, d), columns=COUNTS[:2])
    return found.select("event_id", "events_10m", "failed_logins_10m")


def q_window_distinct(spark, d):
    return window_features(telemetry(spark, d), columns=(*COUNTS[2:], FAN_OUT)).selectExpr(
        "event_id",
        "unique_resources_30m",
        *_rounded("resource_access_velocity_30m"),
        "source_ip_entity_fanout_10m",
    )


def q_travel_features(spark, d):
    return window_features(telemetry(spark, d), columns=TRAVEL).selectExpr(
        "event_id", "round(distance_from_previous_km, 4) AS distance_from_previous_km",
        "round(implied_speed_kmh, 3) AS implied_speed_kmh",
    )


def q_fanout_sketch(spark, d):
    return sketched_fan_out(telemetry(spark, d))


def q_great_circle(spark, d):
    """Distance and speed between supplier and customer of every order line, by nation pair."""

    def place(table: str, key: str, nation: str, who: str) -> DataFrame:
        return spark.read.parquet(f"{d}/{table}.parquet").selectExpr(
            f"{key} AS {who}_key",
            f"{nation} AS {who}_nation",
            f"cast(({nation} * 7) % 120 - 60 AS double) AS {who}_lat",
            f"cast(({nation} * 29) % 360 - 180 AS double) AS {who}_lon",
        )

    lines = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_suppkey AS supplier_key", "l_shipdate"
    )
    orders = spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "o_orderkey AS l_orderkey", "o_custkey AS customer_key", "o_orderdate"
    )
    distance = haversine_km("supplier_lat", "supplier_lon", "customer_lat", "customer_lon")
    elapsed = "timestampdiff(MICROSECOND, o_orderdate, l_shipdate)"
    return (
        lines.join(orders, "l_orderkey")
        .join(place("supplier", "s_suppkey", "s_nationkey", "supplier"), "supplier_key")
        .join(place("customer", "c_custkey", "c_nationkey", "customer"), "customer_key")
        .selectExpr(
            "supplier_nation",
            "customer_nation",
            f"{distance} AS distance",
            f"{speed_kmh('distance', elapsed)} AS speed",
        )
        .groupBy("supplier_nation", "customer_nation")
        .agg(
            F.count("*").alias("n_lines"),
            F.round(F.max("distance"), 4).alias("distance_km"),
            F.round(F.max("speed"), 4).alias("max_speed_kmh"),
        )
    )


# --- feature matrix ---------------------------------------------------------------------


def _matrix_out(matrix: DataFrame) -> DataFrame:
    coarse = {"distance_from_previous_km": 4, "implied_speed_kmh": 3}
    return matrix.selectExpr(
        "event_id",
        "entity_id",
        "ts_us",
        "label",
        *[f"round({c}, {coarse.get(c, 6)}) AS {c}" for c in MODEL_FEATURES],
    )


def q_feature_matrix(spark, d):
    return _matrix_out(_matrix(spark, d))


def q_history_only_features(spark, d):
    """Failed and denied events of the scoring days, each against all successful ones."""
    events = telemetry(spark, d)
    history = events.filter("outcome = 'success'")
    targets = scoring_events(spark, d).filter("outcome <> 'success'")
    return _matrix_out(
        feature_matrix(targets, _baseline(spark, d), history=history, mode="history_only")
    )


def q_id_collisions(spark, d):
    """Events of failed outcome re-submitted: those are already in the history."""
    history = telemetry(spark, d).filter("outcome = 'failure'")
    _, known = split_collisions(scoring_events(spark, d), history)
    return known.select("event_id", "entity_id")


def q_missing_values(spark, d):
    return missing_values(_matrix(spark, d))


# --- scoring ----------------------------------------------------------------------------


def q_risk_scores(spark, d):
    return _rule_scores(spark, d).select(
        "event_id", "behavioral_contribution", "ml_contribution", "risk_score", "severity", "is_suspicious"
    )


def q_risk_reasons(spark, d):
    return _rule_scores(spark, d).selectExpr("event_id", _joined("reasons"))


def q_anomaly_types(spark, d):
    return _judged(spark, d).select("event_id", "anomaly_type", "classification_confidence")


def q_class_evidence(spark, d):
    return _judged(spark, d).selectExpr("event_id", "anomaly_type", _joined("classification_evidence"))


def q_explanations(spark, d):
    return explain(_rule_scores(spark, d)).select("event_id", "entity_id", "risk_score", "severity", "summary")


def _assessment_out(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "event_id",
        "entity_id",
        "risk_score",
        "severity",
        "is_suspicious",
        "summary",
        _joined("reasons"),
        "ml_anomaly_score",
        "ml_flagged",
        "ml_contribution",
        "behavioral_contribution",
        "anomaly_type",
        "classification_confidence",
        _joined("classification_evidence"),
    )


def q_rule_assessments(spark, d):
    return _assessment_out(assessments(_judged(spark, d)))


def q_risk_with_verdict(spark, d):
    """Rules and a forest verdict together; the verdict is a fixed function of one feature."""
    verdict = {"ml_anomaly_score": F.expr("(events_10m - 6) / 40D"), "ml_flagged": F.expr("events_10m > 6")}
    return judge(_matrix(spark, d).withColumns(verdict)).selectExpr(
        "event_id",
        "behavioral_contribution",
        *_rounded("ml_contribution", "risk_score"),
        "severity",
        "is_suspicious",
        _joined("reasons"),
        "anomaly_type",
    )


def q_score_quantiles(spark, d):
    """Interpolated quantiles of the risk score, as the forest threshold takes them."""
    scores = stored(_rule_scores(spark, d).select("risk_score"), "scores")
    total = scores.count()
    found = [(q, quantile(scores, "risk_score", q, total)) for q in (0.5, 0.9, 0.99)]
    return spark.createDataFrame(found, "q double, risk_score double").selectExpr("q", *_rounded("risk_score"))


def q_assess_history(spark, d):
    """Each scoring event against the first seven days, by a rule model stored and loaded again."""
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    save_model(Model(_baseline(spark, d)), folder)
    model = load_model(spark, folder)
    history = carried_history(split(telemetry(spark, d), (0, 6)), EPOCH_US + SCORE_DAYS[0] * DAY_US)
    return _assessment_out(assess(scoring_events(spark, d), model, history=history, mode="history_only"))


def q_alerts(spark, d):
    return alerts(_judged(spark, d)).selectExpr(
        "alert_id",
        "event_id",
        "risk.score AS score",
        "risk.confidence AS confidence",
        "risk.severity AS severity",
        "classification",
        "concat_ws('|', transform(evidence, e -> concat(e.signal, '=', cast(e.contribution AS int)))) AS evidence",
        "status",
    )


def q_alerts_by_severity(spark, d):
    return (
        alerts(_judged(spark, d))
        .groupBy("risk.severity", "classification")
        .agg(F.count("*").alias("n_alerts"), F.max("risk.score").alias("max_score"))
    )


def q_alerts_written(spark, d):
    """Alerts of two runs, each written twice, the first at first with other rows; and one never finished."""
    folder = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    found = stored(alerts(_judged(spark, d)), "alerts")
    halves = [found.filter("pmod(hash(event_id), 2) = 0"), found.filter("pmod(hash(event_id), 2) <> 0")]
    write_alerts(found, folder, "even")
    for run, rows in (("even", halves[0]), ("odd", halves[1]), ("odd", halves[1])):
        write_alerts(rows, folder, run)
    found.write.parquet(f"{folder}/alerts/run=broken")  # no manifest
    return read_alerts(spark, folder).selectExpr("alert_id", "event_id", "risk.score AS score", "classification", "status")


def q_sql_views(spark, d):
    """Suspicious activity per day and attack type, asked in SQL alone."""
    register_views(scoring_events(spark, d), Model(_baseline(spark, d)), "scored_", history=_earlier(spark, d))
    return spark.sql("""
        SELECT day, anomaly_type, count(*) AS n_events, count(DISTINCT a.entity_id) AS n_entities,
               max(risk_score) AS max_risk, count_if(label <=> 'normal') AS labelled_normal
        FROM scored_assessments a JOIN scored_events e USING (event_id)
        WHERE is_suspicious GROUP BY ALL
    """)


# --- record checks ----------------------------------------------------------------------


def q_alert_checks(spark, d):
    """Alert records whose severity was taken from the scorer's scale by mistake."""
    judged = _judged(spark, d)
    wrong = alerts(judged).join(judged.select("event_id", F.col("severity").alias("scorer")), "event_id")
    swapped = wrong.withColumn("risk", F.col("risk").withField("severity", F.col("scorer")))
    return alert_violations(swapped).selectExpr("alert_id", _joined("violations"))


def q_risk_checks(spark, d):
    records = _judged(spark, d).selectExpr(
        "event_id", "risk_score + 30 AS score", "classification_confidence AS confidence", "severity"
    )
    return risk_violations(records).selectExpr("event_id", _joined("violations"))


def q_entity_checks(spark, d):
    entities = spark.read.parquet(f"{d}/customer.parquet").selectExpr(
        "c_custkey",
        "IF(c_acctbal < 0, c_name, replace(c_name, '#', '_')) AS entity_id",
        "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'user' WHEN 'MACHINERY' THEN 'service_account' "
        "WHEN 'AUTOMOBILE' THEN 'edge_device' ELSE lower(c_mktsegment) END AS entity_type",
        "repeat(c_mktsegment, c_nationkey) AS peer_group",
    )
    return entity_violations(entities).selectExpr("c_custkey", _joined("violations"))


# --- evaluation -------------------------------------------------------------------------


def q_detector_metrics(spark, d):
    return detector_metrics(_rule_scores(spark, d), "is_suspicious").selectExpr(
        "true_positives",
        "false_positives",
        "true_negatives",
        "false_negatives",
        *_rounded("precision", "recall", "f1_score", "false_positive_rate"),
    )


def q_attack_metrics(spark, d):
    return attack_metrics(_rule_scores(spark, d), "is_suspicious", "risk_score").selectExpr(
        "attack_type", "total", "detected", *_rounded("detection_rate", "mean_anomaly_score")
    )


def q_classification_accuracy(spark, d):
    judged = _judged(spark, d).selectExpr("coalesce(label, 'None') AS expected_type", "anomaly_type")
    return classification_accuracy(judged, "expected_type").selectExpr(
        "expected", "total", "correct", *_rounded("accuracy")
    )


def q_label_rate(spark, d):
    return label_rate(telemetry(spark, d)).selectExpr(
        "total_events", "malicious_events", *_rounded("anomaly_rate")
    )


def _budget_out(budget: DataFrame) -> DataFrame:
    return budget.selectExpr(
        "total_events",
        "total_attacks",
        "budget_fraction",
        "alert_count",
        "true_alerts",
        "false_alerts",
        *_rounded("precision_at_budget", "attack_recall_at_budget", "false_positive_rate"),
        _joined("attack_types_surfaced"),
    )


def q_alert_budget(spark, d):
    return _budget_out(alert_budget(_rule_scores(spark, d), 0.01))


def q_alert_budget_wide(spark, d):
    """A wider budget, its cut found with fewer pivots and so in more rounds."""
    return _budget_out(alert_budget(_rule_scores(spark, d), 0.07, pivots=16))


def q_top_alerts(spark, d):
    return top_alerts(_rule_scores(spark, d).select("event_id", "risk_score", "label"), 500)


# --- intake -----------------------------------------------------------------------------


def q_ingest_accepted(spark, d):
    return accepted(ingest(raw_payloads(spark, d))).selectExpr(
        "event_id",
        "entity_id",
        "entity_type",
        "unix_micros(timestamp) AS ts_us",
        "tz_offset_minutes",
        "source_ip",
        "geo_location.*",
        "resource_accessed",
        "auth_method",
        "outcome",
        "session_duration_seconds",
        "concat_ws('|', command_sequence) AS commands",
        "device_fingerprint.*",
        "label",
    )


def q_ingest_rejected(spark, d):
    return quarantined(ingest(raw_payloads(spark, d))).selectExpr(
        "ingest_seq", "reject_stage", _joined("reasons")
    )


def q_deduplicate(spark, d):
    """Every event delivered twice, the second time as failed; the first delivery stays."""
    events = telemetry(spark, d).select("event_id", "outcome", "ingest_seq")
    again = events.selectExpr("event_id", "'failure' AS outcome", "ingest_seq + 1000000000000 AS ingest_seq")
    return deduplicate(events.unionByName(again), "ingest_seq").select("event_id", "outcome", "ingest_seq")


# --- forest -----------------------------------------------------------------------------


def q_forest_scores(spark, d):
    model = _learned(spark, d)
    matrix = feature_matrix(scoring_events(spark, d), model.baseline, history=_earlier(spark, d))
    return score_forest(matrix, model.forest).selectExpr(
        "event_id", *_rounded("ml_anomaly_score"), "ml_flagged"
    )


# features whose values are whole or fixed numbers: a comparison with a cut is exact everywhere
WALKED = (
    "hour_of_day",
    "day_of_week",
    "session_duration_seconds",
    "command_count",
    "latitude",
    "longitude",
    "events_10m",
    "failed_logins_10m",
    "unique_resources_30m",
    "source_ip_entity_fanout_10m",
)


def q_forest_walk(spark, d):
    """Mean path of every scoring event through twelve trees whose cuts follow from the features' ranges."""
    matrix = stored(_matrix(spark, d).select("event_id", *MODEL_FEATURES), "matrix")
    ends = matrix.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in WALKED]).first()
    trees, height = 12, 5
    slots = range(2 ** (height + 1) - 1)
    at = [[(7 * t + 3 * i) % len(WALKED) for i in slots] for t in range(trees)]
    share = [[(31 * t + 17 * i) % 101 / 101.0 for i in slots] for t in range(trees)]
    low_high = [tuple(ends[c]) for c in WALKED]
    cut = [[low_high[f][0] + (low_high[f][1] - low_high[f][0]) * s for f, s in zip(fs, ss, strict=True)] for fs, ss in zip(at, share, strict=True)]
    feature = [[MODEL_FEATURES.index(WALKED[f]) for f in fs] for fs in at]
    path = [[(i % 7 + t) / 2.0 for i in slots] for t in range(trees)]
    return walked_paths(matrix, feature, cut, path, height).selectExpr("event_id", *_rounded("mean_path"))


def q_forest_nodes(spark, d):
    """Every tree of a fitted forest has one root, holds its whole sample, and is no deeper than allowed."""
    return tree_checks(_learned(spark, d).forest.nodes).selectExpr(
        "tree_id", "roots", "leaf_rows", "deepest <= 8 AS bounded", "unbalanced"
    )


def q_forest_metrics(spark, d):
    scored = score_events(scoring_events(spark, d), _learned(spark, d), history=_earlier(spark, d))
    return detector_metrics(scored, "ml_flagged")


def q_assess_full(spark, d):
    return assess(scoring_events(spark, d), _learned(spark, d), history=_earlier(spark, d))


# --- streaming --------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A folder for a stream's tables, and the event table as a stream."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a glob, since a streaming source takes a plain path for a folder; the table may be a file
    source = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", telemetry(spark, d, source)


def q_stream_assessments(spark, d):
    """The rule assessment of the scoring days, computed from a stream of the event table."""
    folder, events = _stream(spark, d)
    save_model(Model(_baseline(spark, d)), f"{folder}/model")
    model = load_model(spark, f"{folder}/model")
    for closed in (False, True):
        if closed:
            close_input(spark, folder)
        run_available(score_stream(split(events, SCORE_DAYS), model, folder, f"{folder}/checkpoint"))
    return _assessment_out(results(spark, folder))


def _fed(spark: SparkSession, parts: list[DataFrame]) -> str:
    """Feed parts of the events to a stream one after another; the folder of its tables.

    Each part is a run of its own that goes on from the checkpoint; the last run finds nothing new.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = parts[0].schema
    for step in range(len(parts) + 2):
        if step < len(parts):
            parts[step].write.parquet(f"{folder}/in/{step}")
        elif step == len(parts):
            close_input(spark, folder)
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        run_available(window_stream(source, folder, f"{folder}/checkpoint"))
    return folder


def q_stream_windows(spark, d):
    """Window columns of all events, which arrive in five parts of two days."""
    events = flat_events(telemetry(spark, d).drop("day", "user_id")).select(*FLAT_COLUMNS)
    bounds = [day * DAY_US + EPOCH_US for day in (2, 4, 6, 8)]
    cuts = [-(2**62), *bounds, 2**62]
    parts = [events.filter(f"ts_us >= {a} AND ts_us < {b}") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return outputs(spark, _fed(spark, parts), "windows").selectExpr(
        "event_id",
        "events_10m",
        "failed_logins_10m",
        "unique_resources_30m",
        "source_ip_entity_fanout_10m",
        "round(distance_from_previous_km, 4) AS distance_from_previous_km",
        "round(implied_speed_kmh, 3) AS implied_speed_kmh",
    )


def q_stream_late(spark, d):
    """Every fiftieth event of the first six days comes after the others, every seventh later one twice."""
    events = flat_events(telemetry(spark, d)).select(*FLAT_COLUMNS)
    held, start = "seq % 50 = 0", EPOCH_US + 6 * DAY_US
    early, rest = events.filter(f"ts_us < {start}"), events.filter(f"ts_us >= {start}")
    folder = _fed(
        spark,
        [
            early.filter(f"NOT ({held})"),
            rest.unionByName(early.filter(held)).unionByName(rest.filter("seq % 7 = 0")),
        ],
    )
    counted = ("event_id", "events_10m", "unique_resources_30m", "source_ip_entity_fanout_10m")
    nothing = [f"cast(NULL AS bigint) AS {c}" for c in counted[1:]]
    late = outputs(spark, folder, "late").selectExpr("event_id", *nothing, "true AS late")
    return outputs(spark, folder, "windows").selectExpr(*counted, "false AS late").unionByName(late)


QUERIES: dict[str, Query] = {
    name.removeprefix("q_"): query for name, query in list(globals().items()) if name.startswith("q_")
}


def with_utc(query: Query) -> Query:
    """Run with the session zone of the tables (they hold zone-free timestamps in UTC)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run
