"""Merged baselines, the alert table, sketches and views."""

import random

import pytest
from test_windows import event, table

from driftwatch.operators.incremental import fold_day, merged_baseline
from driftwatch.operators.profiles import learn_baseline, profile_sets
from driftwatch.operators.sequence import sketched_fan_out
from driftwatch.plans.assess import Model
from driftwatch.plans.views import register_views
from driftwatch.sources.alerts import read_alerts, write_alerts
from driftwatch.sources.telemetry import profile_events, scoring_events


def shown(baseline):
    names = [c for c, kind in baseline.statistics.dtypes if kind == "double"]
    rows = {r["entity_id"]: [r["event_count"], r["profile_valid"], *[round(r[c], 9) for c in names]] for r in baseline.statistics.collect()}
    return rows, sorted(map(tuple, profile_sets(baseline).collect()), key=str)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_days_fold_to_the_same_baseline_in_any_order(spark, sf_dir, tmp_path, order):
    events = profile_events(spark, sf_dir)
    folder = str(tmp_path / "folded")
    for version, day in enumerate(order):
        for _ in range(2 if version == 2 else 1):  # a day folded again changes nothing
            fold_day(spark, folder, events.filter(f"day = {day}"), version)
    assert shown(merged_baseline(spark, folder, 3)) == shown(learn_baseline(events))
    early = events.filter(f"day IN ({order[0]}, {order[1]})")
    assert shown(merged_baseline(spark, folder, 1)) == shown(learn_baseline(early))


def test_large_sums_keep_their_spread(spark, tmp_path):
    rows = [list(event(i, minute=i)) for i in range(4)]
    at = 9  # session_duration_seconds
    for r, seconds in zip(rows, (86_400, 86_399, 86_400, 86_399)):
        r[at] = seconds
    events = table(spark, [tuple(r) for r in rows])
    fold_day(spark, str(tmp_path / "f"), events, 0)
    assert merged_baseline(spark, str(tmp_path / "f"), 0).statistics.first()["session_duration_std"] == 0.5


def test_alert_runs_own_their_rows(spark, tmp_path):
    folder = str(tmp_path / "alerts")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "alert_id string")
    write_alerts(rows("a", "b"), folder, "2024-01-01")
    write_alerts(rows("c"), folder, "2024-01-01")
    write_alerts(rows("d", "d"), folder, "x")
    write_alerts(rows().limit(0), folder, "nothing")
    rows("half").write.parquet(f"{folder}/alerts/run=unfinished")
    assert sorted((r["run"], r["alert_id"]) for r in read_alerts(spark, folder).collect()) == [("2024-01-01", "c"), ("x", "d"), ("x", "d")]
    with pytest.raises(ValueError):
        write_alerts(rows("a"), folder, "../x")


def test_sketches_are_close_where_they_are_not_exact(spark):
    rng = random.Random(3)
    rows = [event(i, entity=f"e{rng.randrange(6000)}", minute=rng.randrange(30), ip=rng.choice("xy")) for i in range(20_000)]
    exact = {}
    for ip in "xy":
        for minute in range(30):
            exact[ip, minute] = len({r[1] for r in rows if r[5] == ip and 0 <= minute - (r[2] - rows_start(rows)) // 60_000_000 <= 10})
    first = rows_start(rows) // 60_000_000
    got = {(r["source_ip"], r["minute"] - first): r["entities"] for r in sketched_fan_out(table(spark, rows)).collect()}
    assert got.keys() == exact.keys() and max(exact.values()) > 2000
    assert all(abs(got[k] - exact[k]) <= 0.06 * exact[k] for k in exact)


def rows_start(rows):
    return min(r[2] for r in rows) // 60_000_000 * 60_000_000


def test_views_answer_sql(spark, sf_dir):
    names = register_views(scoring_events(spark, sf_dir), Model(learn_baseline(profile_events(spark, sf_dir))), "t_")
    assert names[0] == "t_events" and len(names) == 7
    both = spark.sql("SELECT (SELECT count(*) FROM t_assessments) + (SELECT count(*) FROM t_unassessed) AS n, (SELECT count(*) FROM t_events) AS m")
    assert both.first()["n"] == both.first()["m"] == 269
