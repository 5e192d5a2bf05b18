"""The state of the stream: calls of its API by bucket, not by event; results against brute force."""

import pyarrow as pa
import pytest
from test_windows import brute, event, random_events, table

from driftwatch.streaming import windows
from driftwatch.streaming.windows import Trails, dealt_out, keyed_rows, opened


class Calls:
    """A state handle that counts what it is asked."""

    def __init__(self):
        self.n, self.chunks, self.value, self.timers = 0, [], None, set()

    def getListState(self, name, schema):
        return Stored(self)

    def getValueState(self, name, schema):
        return Stored(self)

    def listTimers(self):
        self.n += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.discard(at)


class Stored:
    def __init__(self, calls):
        self.calls, self.held = calls, None

    def _say(self, held):
        self.calls.n += 1
        self.held = held

    def get(self):
        self.calls.n += 1
        return self.held

    def update(self, held):
        self._say(held)

    def put(self, held):
        self._say(held)

    def appendList(self, more):
        self._say([*(self.held or []), *more])

    def clear(self):
        self._say(None)


class At:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def parts_of(spark, monkeypatch, steps):
    """Parts of some events, given in steps of (events, watermark) to one bucket, and the calls this took."""
    monkeypatch.setattr(windows, "BUCKETS", 1)
    trails, calls, out = Trails(), Calls(), []
    trails.init(calls)
    for events, watermark in steps:
        keyed = keyed_rows(table(spark, events).selectExpr("*", "timestamp_micros(ts_us) AS event_time")).toArrow()
        batches = list(dealt_out(iter(keyed.to_batches())))
        packed = [windows.Row(*b.schema.names)(*r.values()) for b in batches for r in b.to_pylist()]
        found = list(trails.handleInputRows((0,), packed, At(calls.n and steps[0][1]))) if packed else []
        for timer in [t for t in sorted(calls.timers) if t <= watermark]:
            found += trails.handleExpiredTimer((0,), At(watermark), None)
            calls.timers.discard(timer)
        out += [r for x in found for t in opened([pa.record_batch([pa.array([x.chunk])], names=["chunk"])]) for r in t.to_pylist()]
    return out, calls


def test_calls_of_the_state_do_not_grow_with_events(spark, monkeypatch):
    events = random_events(21, 400)
    out, calls = parts_of(spark, monkeypatch, [(events, 2**50)])
    assert calls.n < 20  # one by one each event took a dozen
    want = brute(events)
    entity = {r["event_id"]: (r["events_10m"], r["failed_logins_10m"], r["distinct_values"]) for r in out if r["kind"] == "entity"}
    fan_out = {r["event_id"]: r["distinct_values"] for r in out if r["kind"] == "address"}
    assert {k: (*entity[k], fan_out[k]) for k in want} == {k: v[:4] for k, v in want.items()}
    assert len([r for r in out if r["kind"] == "place"]) == len(entity) == len(events)


@pytest.mark.parametrize("kind", ["entity", "place"])
def test_missing_keys_values_and_places_stay_missing(spark, monkeypatch, kind):
    """Rows without entity, resource or place, and one delivered again in a later step."""
    rows = [event(1, entity=None, resource=None, place=(None, None)), event(2, entity=None, minute=1), event(3, minute=1)]
    out, _ = parts_of(spark, monkeypatch, [(rows, 0), ([rows[1]], 2**50)])
    got = {r["event_id"]: r for r in out if r["kind"] == kind}
    assert len(got) == len([r for r in out if r["kind"] == kind]) == 3
    if kind == "entity":
        assert [got[f"EVENT_000{i}"]["distinct_values"] for i in (1, 2, 3)] == [1, 2, 1]
    else:
        assert [got[f"EVENT_000{i}"]["previous_us"] for i in (1, 2, 3)] == [None, rows[0][2], None]
        assert got["EVENT_0002"]["previous_latitude"] is None
