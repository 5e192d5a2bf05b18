"""Window features of a stream, in the engine's keyed state.

Each event goes to its entity's and its address's time block, a dozen windows long, and from the end
of a block to the next one too, which its window reaches; and to its entity for the place before it.
Keys are dealt by hash into buckets, and a bucket is a key of the engine's state: a call of the state API costs
about a millisecond, so it moves many rows at once, packed in Arrow. A bucket holds rows in list state as long
as a window can reach them, and a timer wakes it when the watermark has passed a waiting row; that row's windows
are final then, whatever order rows came in. All parts of an event come out in the same micro-batch.

The event-time column is dropped once it has fed the watermark: the operator then also gets the
rows behind it, which come out as late and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftwatch.functions.clock import floor_div
from driftwatch.operators.sequence import FAN_OUT, TEN_MINUTES, THIRTY_MINUTES
from driftwatch.schema import FLAT_COLUMNS, flat_events

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTITY, ADDRESS, PLACE, LATE = "entity", "address", "place", "late"
KINDS = (ENTITY, ADDRESS, PLACE, LATE)
WIDTHS = {ENTITY: THIRTY_MINUTES, ADDRESS: TEN_MINUTES}
BLOCKS = {kind: 12 * width for kind, width in WIDTHS.items()}
BUCKETS = 128  # a task holds what one of them waits for or can still see; a checkpoint keeps its number
PACKED_ROWS = 100_000  # rows dealt to the buckets at a time
PART_COLUMNS = (
    "kind string, event_id string, ts_us bigint, payload string, events_10m bigint, failed_logins_10m bigint, distinct_values bigint, "
    "previous_us bigint, previous_latitude double, previous_longitude double"
)
PACKED_COLUMNS = "bucket int, first_us bigint, wakes bigint, chunk binary"

_CHUNK = Row("chunk")
# by code of the kind; places have no windows
_CODES = {kind: code for code, kind in enumerate(KINDS)}
_WIDTH = np.array([WIDTHS.get(kind, 0) for kind in KINDS])
_BLOCK = np.array([BLOCKS.get(kind, 0) for kind in KINDS])
_SPAN = int((_BLOCK + 2 * _WIDTH).max()) + 2  # longer than any time that is counted within a block


def _wakes_at(ts_us):
    """The first watermark (milliseconds) that has passed a time."""
    return ts_us // 1000 + 1


def _ends_at(kind: np.ndarray, block: np.ndarray) -> np.ndarray:
    return _wakes_at((block + 1) * _BLOCK[kind])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(chunk: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(chunk)).read_all()


def _ints(table: pa.Table, name: str) -> np.ndarray:
    if table[name].null_count:
        raise ValueError(f"a row of the stream has no {name}")
    return table[name].to_numpy()


def _bools(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(bool)


def _codes(table: pa.Table, name: str) -> np.ndarray:
    """Whole numbers that are equal where values are; null is a value."""
    column = table[name].combine_chunks()
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket as one packed row, for so many rows at a time."""
    schema = pa.schema([("bucket", pa.int32()), ("first_us", pa.int64()), ("wakes", pa.int64()), ("chunk", pa.binary())])

    def packed(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting)
        table = table.cast(pa.schema([field.with_nullable(True) for field in table.schema]))  # chunks of any age go together
        bucket = _ints(table, "bucket")
        order = np.argsort(bucket, kind="stable")
        table, bucket = table.drop_columns("bucket").take(order).combine_chunks(), bucket[order]
        ts, kind = _ints(table, "ts_us"), _ints(table, "kind")
        wakes = np.where(_bools(table, "own"), _wakes_at(ts), _ends_at(kind, _ints(table, "block")))
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(starts[1:], len(bucket))
        chunks = [_packed(table.slice(a, b - a)) for a, b in zip(starts, ends, strict=True)]
        columns = [bucket[starts], np.minimum.reduceat(ts, starts), np.minimum.reduceat(wakes, starts), chunks]
        return pa.record_batch([pa.array(c, field.type) for c, field in zip(columns, schema, strict=True)], schema=schema)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= PACKED_ROWS:
            yield packed(waiting)
            waiting = []
    if waiting:
        yield packed(waiting)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in batch.column(0):
            yield from _unpacked(chunk.as_py()).to_batches()


def _part_rows(kind, rows: pa.Table, *, payload=None, events=None, failed=None, distinct=None, previous=None) -> pa.Table:
    """Rows of PART_COLUMNS; what is not given is null."""
    n = rows.num_rows
    place = previous if previous is not None else (None, None, None)
    whole = [payload, events, failed, distinct, *place]
    types = [pa.string(), *[pa.int64()] * 4, pa.float64(), pa.float64()]
    columns = [pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c, t) for c, t in zip(whole, types, strict=True)]
    names = [c.split()[0] for c in PART_COLUMNS.split(", ")]
    return pa.table([pa.array([kind] * n, pa.string()) if isinstance(kind, str) else kind, rows["event_id"], rows["ts_us"], *columns], names=names)


def _in_order(held: pa.Table, arrived: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Rows by key, time and arrival order, each event once in a key, and the number of each row's key."""
    seq = pc.rank(held["seq"].combine_chunks(), tiebreaker="dense").to_numpy()
    block = np.unique(_ints(held, "block"), return_inverse=True)[1]
    key = _codes(held, "key")
    group = (_ints(held, "kind").astype(np.int64) * (block.max() + 1) + block) * (key.max() + 1) + key
    group = np.unique(group, return_inverse=True)[1]
    event = _codes(held, "event_id")
    order = np.lexsort((seq, arrived, event, group))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (np.diff(group[order]) == 0) & (np.diff(event[order]) == 0)
    left = order[~again]
    left = left[np.lexsort((seq[left], _ints(held, "ts_us")[left], group[left]))]
    return held.take(left).combine_chunks(), group[left]


def _distinct(at: np.ndarray, group: np.ndarray, value: np.ndarray, width: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Distinct values in the window up to each asked time: stretches of a value begun less those that have ended."""
    order = np.lexsort((at, value, group))
    same = (np.diff(group[order]) == 0) & (np.diff(value[order]) == 0) & (np.diff(at[order]) <= width[order][1:])
    begins = np.sort(at[order][np.append(True, ~same)])
    ends = np.sort((at + width + 1)[order][np.append(~same, True)])
    return np.searchsorted(begins, asked, "right") - np.searchsorted(ends, asked, "right")


def passed(held: pa.Table, arrived: np.ndarray, watermark: int) -> tuple[list[pa.Table], pa.Table, int | None]:
    """What a watermark lets out of a bucket: the parts, the rows it still needs, and when to look again."""
    held, group = _in_order(held, arrived)
    kind, ts, block = _ints(held, "kind").astype(np.int64), _ints(held, "ts_us"), _ints(held, "block")
    own = _bools(held, "own")
    ready = own & (_wakes_at(ts) <= watermark)
    waits = own & ~ready
    out = []

    rows = np.flatnonzero(kind != _CODES[PLACE])
    if len(rows):
        width = _WIDTH[kind[rows]]
        # times that rise from row to row, key after key, with room for the windows between the keys
        at = group[rows] * _SPAN + (ts[rows] - block[rows] * _BLOCK[kind[rows]] + width)
        asked = at[ready[rows]]
        here = rows[ready[rows]]
        distinct = _distinct(at, group[rows], _codes(held, "value")[rows], width, asked)
        low, high = np.searchsorted(at, asked - TEN_MINUTES), np.searchsorted(at, asked, "right")
        failures = np.append(0, np.cumsum(_bools(held, "failed")[rows]))
        entity = kind[here] == _CODES[ENTITY]
        mine = held.take(here[entity])
        out.append(
            _part_rows(ENTITY, mine, payload=mine["payload"], events=(high - low)[entity], failed=(failures[high] - failures[low])[entity], distinct=distinct[entity])
        )
        out.append(_part_rows(ADDRESS, held.take(here[~entity]), distinct=distinct[~entity]))

    # of the last earlier time the first row in arrival order; a row that is not its own stands for all before
    rows = np.flatnonzero((kind == _CODES[PLACE]) & ~waits)
    last = rows[:0]
    if len(rows):
        new_key = np.append(True, np.diff(group[rows]) != 0)
        starts = np.flatnonzero(new_key | np.append(True, np.diff(ts[rows]) != 0))
        run = np.searchsorted(starts, np.arange(len(rows)), "right") - 1
        first_run = new_key[starts]
        before = rows[starts[np.maximum(run - 1, 0)]]
        none = first_run[run]
        last = rows[starts[np.append(first_run[1:], True)]]
        asks = ready[rows]
        seen = pa.array(before[asks], mask=none[asks])
        place = [held[c].combine_chunks().take(seen) for c in ("ts_us", "latitude", "longitude")]
        out.append(_part_rows(PLACE, held.take(rows[asks]), previous=place))

    reached = (kind != _CODES[PLACE]) & (ts >= 1000 * watermark - _WIDTH[kind]) & (_ends_at(kind, block) > watermark)
    carried = np.zeros(len(ts), dtype=bool)
    carried[last] = True
    left = np.flatnonzero(waits | reached | carried)
    kept = held.take(left)
    waits, carried = waits[left], carried[left]
    blank = pa.scalar(None, pa.string())
    for name, column in (
        ("own", pa.array(waits)),
        ("payload", pc.if_else(pa.array(waits), kept["payload"], blank)),
        ("event_id", pc.if_else(pa.array(carried), blank, kept["event_id"])),
    ):
        kept = kept.set_column(kept.schema.get_field_index(name), name, column)
    wakes = np.where(waits, _wakes_at(ts[left]), _ends_at(kind[left], block[left]))[~carried]
    return [t for t in out if t.num_rows], kept, int(wakes.min()) if len(wakes) else None


class Trails(StatefulProcessor):
    """One bucket: blocks of entities and of addresses, and last places of entities."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "arrived bigint, chunk binary")
        self.rounds = handle.getValueState("rounds", "n bigint")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        arrived = (self.rounds.get() or (0,))[0] + 1
        fresh, wakes = [], []
        for r in rows:
            chunk = r.chunk
            if _wakes_at(r.first_us) <= watermark:
                table = _unpacked(chunk)
                late = _wakes_at(_ints(table, "ts_us")) <= watermark
                mine = table.filter(pa.array(late & _bools(table, "own") & (_ints(table, "kind") == _CODES[ENTITY])))
                if mine.num_rows:
                    yield _CHUNK(_packed(_part_rows(LATE, mine, payload=mine["payload"])))
                if late.all():
                    continue
                chunk = _packed(table.filter(pa.array(~late)))
            fresh.append((arrived, chunk))
            wakes.append(max(r.wakes, watermark + 1))
        if not fresh:
            return
        self.rounds.update((arrived,))
        self.chunks.appendList(fresh)
        self._wake(min(wakes), watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored = [(arrived, _unpacked(chunk)) for arrived, chunk in self.chunks.get()]
        if not stored:
            return
        arrived = np.concatenate([np.full(t.num_rows, n) for n, t in stored])
        watermark = timerValues.getCurrentWatermarkInMs()
        out, kept, wakes = passed(pa.concat_tables([t for _, t in stored]), arrived, watermark)
        for table in out:
            yield _CHUNK(_packed(table))
        if kept.num_rows:
            self.chunks.put([(0, _packed(kept))])
        else:
            self.chunks.clear()
        if wakes is not None:
            self._wake(wakes, watermark)

    def _wake(self, at: int, watermark: int) -> None:
        """One timer a bucket, at the earliest time it was asked for; those that fire now are the engine's to remove."""
        timers = [t for t in self.handle.listTimers() if t > watermark]
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def keyed_rows(timed: DataFrame) -> DataFrame:
    """Flat events with an `event_time` as rows of the keys that they reach, and the bucket of each."""

    def part(kind: str, key: str, value: str, block: str, own: bool, payload: str = "NULL") -> str:
        return (
            f"struct(cast({_CODES[kind]} AS tinyint) AS kind, {key} AS key, cast({block} AS bigint) AS block, {str(own).lower()} AS own, "
            f"cast({value} AS string) AS value, cast({payload} AS string) AS payload)"
        )

    whole = f"to_json(struct({', '.join(FLAT_COLUMNS)}))"
    parts = [part(PLACE, "entity_id", "NULL", "0", True)]
    for kind, key, value, own in ((ENTITY, "entity_id", "resource_accessed", whole), (ADDRESS, "source_ip", "entity_id", "NULL")):
        block, reached = floor_div("ts_us", BLOCKS[kind]), floor_div(f"ts_us + {WIDTHS[kind]}", BLOCKS[kind])
        again = part(kind, key, value, f"{block} + 1", False)
        parts += [part(kind, key, value, block, True, own), f"IF({reached} > {block}, {again}, NULL)"]
    shared = ("event_id", "ts_us", "seq", "coalesce(outcome = 'failure', false) AS failed", "latitude", "longitude")
    # a condition on the event time too, or it would be pushed below the watermark and hide the rows from it
    keyed = timed.filter("event_id IS NOT NULL OR event_time IS NULL").selectExpr(*shared, f"inline(array_compact(array({', '.join(parts)})))")
    return keyed.selectExpr("*", f"cast(pmod(xxhash64(kind, key, block), {BUCKETS}) AS int) AS bucket")


def window_parts(events: DataFrame, lateness_minutes: int) -> DataFrame:
    """The parts of every event of a stream, as the watermark passes it; see PART_COLUMNS.

    An event delivered again (same id, entity and time) counts once. Rows without an id only move
    the watermark. `payload` is the flat event as JSON; late rows come as kind `late`.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    flat = flat_events(events).select(*FLAT_COLUMNS)
    timed = flat.selectExpr("*", "timestamp_micros(ts_us) AS event_time").withWatermark("event_time", f"{lateness_minutes} minutes")
    dealt = keyed_rows(timed).mapInArrow(dealt_out, PACKED_COLUMNS)
    chunks = dealt.groupBy("bucket").transformWithState(Trails(), T.StructType.fromDDL("chunk binary"), "append", "eventtime")
    return chunks.mapInArrow(opened, PART_COLUMNS)


def payload_of(parts: DataFrame, kind: str, flat: T.StructType, *more: str) -> DataFrame:
    """The flat events of one kind of part."""
    rows = parts.filter(F.col("kind") == kind).withColumn("event", F.from_json("payload", flat))
    return rows.selectExpr("event.*", *more)


def merged_parts(parts: DataFrame, flat: T.StructType) -> DataFrame:
    """Flat events with their window results and previous place, from the parts of one micro-batch."""
    own = payload_of(parts, ENTITY, flat, "events_10m", "failed_logins_10m", "distinct_values AS unique_resources_30m")
    same = ["event_id", "ts_us"]
    fan_out = parts.filter(F.col("kind") == ADDRESS).selectExpr(*same, f"distinct_values AS {FAN_OUT}")
    previous = "struct(previous_us AS ts_us, previous_latitude AS latitude, previous_longitude AS longitude)"
    places = parts.filter(F.col("kind") == PLACE).selectExpr(*same, f"IF(previous_us IS NULL, NULL, {previous}) AS previous")
    return own.join(fan_out, same).join(places, same)
