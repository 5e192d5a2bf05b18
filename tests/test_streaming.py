"""The stream in the engine's state against the batch plan: order, repeats, late rows, restarts."""

import random

import pytest

from driftwatch.operators.explain import assessments
from driftwatch.operators.forest import fit_forest
from driftwatch.operators.matrix import feature_matrix
from driftwatch.operators.profiles import learn_baseline
from driftwatch.operators.sequence import WINDOW_COLUMNS, window_features
from driftwatch.plans.assess import Model, score_events
from driftwatch.schema import FLAT_COLUMNS, flat_events
from driftwatch.sources.models import load_model, save_model
from driftwatch.sources.telemetry import profile_events, scoring_events, training_events
from driftwatch.streaming.scoring import close_input, outputs, results, run_available, score_stream, window_stream
from test_windows import MINUTE, event, table


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Stateful operators keep the number of partitions of their first run: two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def write_parts(spark, parts, schema, source, first=0):
    for i, part in enumerate(parts, first):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/p{i}")


def read_stream(spark, schema, source):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.parquet(str(source))


def shuffled_parts(spark, events, n):
    """Rows in time order, cut into parts that are shuffled inside; one row is delivered again."""
    flat = flat_events(events).select(*FLAT_COLUMNS)
    rows = sorted(flat.collect(), key=lambda r: (r["ts_us"], r["seq"]))
    cuts = [len(rows) * i // n for i in range(n + 1)]
    parts = [list(rows[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    parts[1].insert(0, parts[0][-1])
    for i, part in enumerate(parts):
        random.Random(i).shuffle(part)
    return parts, flat.schema, len(rows)


@pytest.mark.parametrize("with_forest", [False, True])
def test_stream_equals_batch(spark, sf_dir, tmp_path, with_forest):
    parts, schema, n = shuffled_parts(spark, scoring_events(spark, sf_dir), 4)
    write_parts(spark, parts, schema, tmp_path / "in")
    # devices are not learnt, so their events have no output but `unknown`
    learnt = learn_baseline(profile_events(spark, sf_dir).filter("entity_type <> 'edge_device'"))
    forest = fit_forest(feature_matrix(training_events(spark, sf_dir), learnt), n_estimators=20) if with_forest else None
    save_model(Model(learnt, forest), str(tmp_path / "model"))
    model = load_model(spark, str(tmp_path / "model"))
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        run_available(score_stream(read_stream(spark, schema, tmp_path / "in"), model, folder, checkpoint, lateness_minutes=30))

    run()
    out = results(spark, folder).count() + outputs(spark, folder, "unknown").count()
    close_input(spark, folder)
    run()
    want = assessments(score_events(scoring_events(spark, sf_dir), model))
    got, unknown = results(spark, folder), outputs(spark, folder, "unknown")
    assert 0 < out < n == got.count() + unknown.count() and got.count() == want.count() and not unknown.isEmpty()
    assert got.exceptAll(want).isEmpty()
    assert outputs(spark, folder, "late").isEmpty()
    run()  # nothing new: nothing is added
    assert results(spark, folder).count() == want.count()


def test_windows_of_tied_and_crossing_rows(spark, tmp_path):
    """Ties, rows at the very borders of blocks and windows, over several micro-batches."""
    rng = random.Random(11)
    rows = [
        event(
            i,
            entity=rng.choice("aab"),
            minute=rng.choice([10 * rng.randrange(20), 30 * rng.randrange(7), rng.uniform(0, 200)]),
            us=rng.choice([-1, 0, 1]),
            ip=rng.choice("xy"),
            resource=f"r{rng.randrange(9)}",
            outcome=rng.choice(["success", "failure"]),
            place=(float(rng.randrange(3)), 0.0),
        )
        for i in range(160)
    ]
    parts, schema, _ = shuffled_parts(spark, table(spark, rows), 6)
    write_parts(spark, parts, schema, tmp_path / "in")
    folder = str(tmp_path / "out")
    for last in (False, True):
        if last:
            close_input(spark, folder)
        run_available(window_stream(read_stream(spark, schema, tmp_path / "in"), folder, str(tmp_path / "check"), lateness_minutes=1))
    got = outputs(spark, folder, "windows").select("event_id", *WINDOW_COLUMNS)
    want = window_features(table(spark, rows)).select("event_id", *WINDOW_COLUMNS)
    assert got.count() == want.count() == 160
    assert got.exceptAll(want).isEmpty()


def test_late_rows_are_kept_apart(spark, tmp_path):
    """A row at the watermark is late, one above it is not; late rows change no result."""
    start = event(0)[2]
    on_time = [event(i, minute=m) for i, m in enumerate((0, 20, 60, 61))]
    edge = [event(10, minute=50, us=1000), event(11, minute=50, us=-1000), event(12, minute=5), event(13, entity="new", minute=1)]
    source = tmp_path / "in"
    schema = table(spark, on_time[:1]).schema
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        run_available(window_stream(read_stream(spark, schema, source), folder, checkpoint, lateness_minutes=11))

    write_parts(spark, [on_time], schema, source)
    run()
    write_parts(spark, [edge, [event(20, minute=62)]], schema, source, first=1)
    run()
    close_input(spark, folder)
    run()
    late = {r["event_id"] for r in outputs(spark, folder, "late").collect()}
    assert late == {"EVENT_0011", "EVENT_0012", "EVENT_0013"}
    kept = [*on_time, edge[0], event(20, minute=62)]
    got = outputs(spark, folder, "windows").select("event_id", *WINDOW_COLUMNS)
    want = window_features(table(spark, kept)).select("event_id", *WINDOW_COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert start % MINUTE == event(0, minute=1)[2] % MINUTE
