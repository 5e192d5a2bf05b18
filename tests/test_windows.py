"""Window features against brute force, edge cases, and cutting of keys into blocks."""

import random

import pytest

from driftwatch.operators.sequence import carried_history, window_features
from driftwatch.schema import FLAT_COLUMNS

MINUTE = 60_000_000
SCHEMA = (
    "event_id string, entity_id string, ts_us bigint, local_us bigint, seq bigint, source_ip string, "
    "resource_accessed string, auth_method string, outcome string, session_duration_seconds int, "
    "command_count int, latitude double, longitude double, fingerprint_id string, "
    "operating_system string, browser string, device_type string, label string"
)
NAMES = ("events_10m", "failed_logins_10m", "unique_resources_30m", "source_ip_entity_fanout_10m")


def event(seq, entity="a", minute=0.0, us=0, ip="ip", resource="r", outcome="success", place=(0.0, 0.0)):
    ts = 1_700_000_000_000_000 + round(minute * MINUTE) + us
    return (
        f"EVENT_{seq:04d}", entity, ts, ts, seq, ip, resource, "sso", outcome, 60, 0,
        place[0], place[1], "device_1", "macOS", "Firefox", "laptop", None,
    )


def table(spark, events):
    return spark.createDataFrame(events, SCHEMA)


def features(spark, events, history=None, **options):
    history = table(spark, history) if history is not None else None
    found = window_features(table(spark, events), history, **options)
    return {r["event_id"]: r for r in found.collect()}


def brute(events, history=(), joint=True):
    out = {}
    at = {name: i for i, name in enumerate(FLAT_COLUMNS)}
    for e in events:
        def get(row, name):
            return row[at[name]]

        pool = list(history) + (list(events) if joint else [e])
        ts = get(e, "ts_us")
        near = [o for o in pool if ts - 10 * MINUTE <= get(o, "ts_us") <= ts]
        mine = [o for o in near if get(o, "entity_id") == get(e, "entity_id")]
        wide = [
            o for o in pool
            if ts - 30 * MINUTE <= get(o, "ts_us") <= ts and get(o, "entity_id") == get(e, "entity_id")
        ]
        earlier = [o for o in pool if get(o, "entity_id") == get(e, "entity_id") and get(o, "ts_us") < ts]
        previous = min(earlier, key=lambda o: (-get(o, "ts_us"), get(o, "seq")), default=None)
        out[e[0]] = (
            len(mine),
            sum(get(o, "outcome") == "failure" for o in mine),
            len({get(o, "resource_accessed") for o in wide}),
            len({get(o, "entity_id") for o in near if get(o, "source_ip") == get(e, "source_ip")}),
            previous is not None
            and (get(previous, "latitude"), get(previous, "longitude")) != (get(e, "latitude"), get(e, "longitude")),
        )
    return out


def measured(found):
    return {k: (*[r[n] for n in NAMES], r["distance_from_previous_km"] > 0) for k, r in found.items()}


def random_events(seed, n, start=0):
    rng = random.Random(seed)
    return [
        event(
            start + i,
            entity=rng.choice("aaaaabc"),
            minute=rng.choice([rng.uniform(0, 120), rng.randrange(0, 120, 10)]),
            ip=rng.choice(["x", "x", "y", "z"]),
            resource=rng.choice("pqrst"),
            outcome=rng.choice(["success", "failure", "denied"]),
            place=(float(rng.randrange(3)), 0.0),
        )
        for i in range(n)
    ]


def test_joint_equals_brute_force(spark):
    events = random_events(1, 150)
    assert measured(features(spark, events)) == brute(events)


def test_joint_with_history_equals_brute_force(spark):
    events, history = random_events(2, 80), random_events(3, 80, start=1000)
    assert measured(features(spark, events, history)) == brute(events, history)


def test_history_only_equals_brute_force(spark):
    events, history = random_events(4, 80), random_events(5, 80, start=1000)
    found = features(spark, events, history, mode="history_only")
    assert measured(found) == brute(events, history, joint=False)


def test_window_is_closed_at_both_ends(spark):
    found = features(spark, [event(1), event(2, minute=10)])
    assert found["EVENT_0002"]["events_10m"] == 2
    found = features(spark, [event(1), event(2, minute=10, us=1)])
    assert found["EVENT_0002"]["events_10m"] == 1


def test_peers_see_each_other_but_are_not_previous(spark):
    found = features(spark, [event(1, place=(10.0, 10.0)), event(2)])
    assert {r["events_10m"] for r in found.values()} == {2}
    assert {r["distance_from_previous_km"] for r in found.values()} == {0.0}
    assert {r["implied_speed_kmh"] for r in found.values()} == {0.0}


def test_earliest_arrival_stands_for_tied_predecessors(spark):
    tied = [event(5, place=(0.0, 0.0)), event(3, place=(0.0, 90.0)), event(9, minute=60, place=(0.0, 0.0))]
    found = features(spark, tied)["EVENT_0009"]
    assert found["distance_from_previous_km"] == pytest.approx(10007.5, abs=0.1)
    assert found["implied_speed_kmh"] == pytest.approx(10007.5, abs=0.1)


def test_later_events_change_nothing(spark):
    before = features(spark, [event(1), event(2, minute=5)])
    after = features(spark, [event(1), event(2, minute=5), event(3, minute=6, outcome="failure")])
    assert all(before[k] == after[k] for k in before)


def test_denied_is_no_failure(spark):
    found = features(spark, [event(1, outcome="denied"), event(2, minute=1, outcome="failure")])
    assert found["EVENT_0002"]["failed_logins_10m"] == 1


def test_modes_are_checked(spark):
    with pytest.raises(ValueError):
        features(spark, [event(1)], mode="other")
    with pytest.raises(ValueError):
        features(spark, [event(1)], mode="history_only")


def test_one_hot_key_over_many_blocks_equals_brute_force(spark):
    rng = random.Random(6)
    events = [
        event(
            i,
            minute=rng.choice([30 * rng.randrange(12), 10 * rng.randrange(36), rng.uniform(0, 360)]),
            us=rng.choice([-1, 0, 1]),
            resource=f"r{rng.randrange(40)}",
            outcome=rng.choice(["success", "failure"]),
            place=(float(rng.randrange(3)), 0.0),
        )
        for i in range(300)
    ]
    assert measured(features(spark, events)) == brute(events)


def test_previous_event_many_blocks_back(spark):
    far = [event(1, place=(0.0, 0.0)), event(2, minute=-5000, place=(0.0, 10.0)), event(3, minute=9000, place=(0.0, 90.0))]
    found = features(spark, far)["EVENT_0003"]
    assert found["distance_from_previous_km"] == pytest.approx(10007.5, abs=0.1)


@pytest.mark.parametrize("columns", [NAMES[:2], NAMES[2:3], NAMES[3:], ("implied_speed_kmh",), ()])
def test_only_wanted_columns_are_computed(spark, columns):
    events, history = random_events(7, 60), random_events(8, 60, start=1000)
    whole, part = features(spark, events, history), features(spark, events, history, columns=columns)
    assert {k: [r[c] for c in columns] for k, r in part.items()} == {k: [r[c] for c in columns] for k, r in whole.items()}
    assert not (set(NAMES) - set(columns)) & set(next(iter(part.values())).asDict())
    with pytest.raises(ValueError):
        window_features(table(spark, events), columns=["other"])


def test_counts_need_one_shuffle(spark):
    plan = window_features(table(spark, random_events(9, 5)), columns=("events_10m",))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


def test_carried_history_gives_what_the_whole_history_gives(spark):
    rows = random_events(17, 160)
    start = sorted(r[2] for r in rows)[90]
    events = [r for r in rows if r[2] >= start]
    history = [r for r in rows if r[2] < start]
    carried = carried_history(table(spark, history), start)
    assert 0 < carried.count() < len(history)
    for mode in ("joint", "history_only"):
        found = window_features(table(spark, events), carried, mode=mode).collect()
        assert measured({r["event_id"]: r for r in found}) == brute(events, history, joint=mode == "joint")


def test_carried_history_of_nothing(spark):
    empty = table(spark, [event(1)]).limit(0)
    assert carried_history(empty, 0).count() == 0


def test_carried_history_ranks_rows_before_the_shuffle(spark):
    """The last event of an entity, of tied ones the first to arrive, is left by task: no aggregate that sorts whole rows."""
    rows = [event(5, minute=1), event(3, minute=1, place=(0.0, 9.0)), event(7), event(9, entity=None), event(8, entity=None, minute=2)]
    carried = carried_history(table(spark, rows), event(0, minute=500)[2])
    plan = carried._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan
    assert sorted(r["event_id"] for r in carried.collect()) == ["EVENT_0003", "EVENT_0008"]
