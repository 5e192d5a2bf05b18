"""Trailing-window and previous-event features.

All windows are closed, [t - m, t], and include the event itself and its timestamp peers.
Instead of one sliding frame per row (whose cost grows with the frame), every count is a
running balance: an event adds at its own time and takes back one microsecond after it
leaves the window, so one ordered pass yields the exact count at every time. A distinct
count works the same way on the stretches during which a value stays in the window.

Every key is cut into time blocks a dozen longest windows long. An event near the end of a block is
also shown to the next, in a copy without payload, so a block holds all its windows need and a key
of any size spreads over as many tasks as it has blocks. Only the previous event can lie
further back: one row per key and block carries it, pre-aggregated.

Cost: one shuffle by entity and block, and one by address and block if fan-out is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.clock import MINUTE_US, floor_div
from driftwatch.functions.geo import haversine_km, speed_kmh
from driftwatch.schema import flat_events

TEN_MINUTES = 10 * MINUTE_US
THIRTY_MINUTES = 30 * MINUTE_US

COUNTS = ("events_10m", "failed_logins_10m", "unique_resources_30m", "resource_access_velocity_30m")
FAN_OUT = "source_ip_entity_fanout_10m"
TRAVEL = ("distance_from_previous_km", "implied_speed_kmh")
WINDOW_COLUMNS = (*COUNTS, FAN_OUT, *TRAVEL)

BLOCK_WINDOWS = 12  # the longest windows in a block: one event in so many is shown to the next block too

_DELTAS = ("d_events", "d_failed", "d_unique")
_FAILED = "cast(outcome = 'failure' AS bigint)"
_PLACE = "struct(ts_us, latitude, longitude)"
_NO_PLACE = "cast(NULL AS struct<ts_us:bigint,latitude:double,longitude:double>)"
_UP_TO = "ORDER BY point_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_EARLIER = "ORDER BY point_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@dataclass(frozen=True)
class Trail:
    """What to accumulate along one key."""

    key: str
    value: str  # distinct values of this column are counted
    window_us: int  # the longest window
    result: str  # name of the distinct count
    full: bool = False  # also count events and failures
    travel: bool = False  # also find the previous event

    @property
    def block_us(self) -> int:
        return BLOCK_WINDOWS * self.window_us


ENTITY_TRAIL = Trail("entity_id", "resource_accessed", THIRTY_MINUTES, "unique_resources_30m", full=True)
ADDRESS_TRAIL = Trail("source_ip", "entity_id", TEN_MINUTES, FAN_OUT)


def _point(at: str, events: str, failed: str, unique: str, here: str) -> str:
    """A change of the balances at a time; `here` tells whether it stands for the row itself."""
    return (
        f"struct({at} AS point_us, cast({events} AS bigint) AS d_events, "
        f"cast({failed} AS bigint) AS d_failed, cast({unique} AS bigint) AS d_unique, {here} AS here)"
    )


def _in_blocks(rows: DataFrame, trail: Trail) -> DataFrame:
    """Every row in its block, and once more, unpaid, in the next if it counts there."""
    needed = (trail.key, trail.value, "ts_us", "outcome", "contributes")

    def part(own: str) -> str:
        block = f"{floor_div('ts_us', trail.block_us)}{'' if own == 'true' else ' + 1'}"
        kinds = dict(rows.dtypes)
        kept = [
            f"{c} AS {c}" if own == "true" or c in needed else f"cast(NULL AS {kinds[c]}) AS {c}"
            for c in rows.columns
        ]
        place = f"IF(contributes, {_PLACE}, NULL)" if own == "true" and trail.travel else _NO_PLACE
        return f"struct({', '.join(kept)}, {block} AS block, {own} AS own, {place} AS place)"

    reaches = f"{floor_div(f'ts_us + {trail.window_us}', trail.block_us)} > {floor_div('ts_us', trail.block_us)}"
    again = f"IF(contributes AND {reaches}, {part('false')}, NULL)"
    return rows.selectExpr(f"inline(array_compact(array({part('true')}, {again})))")


def _carried(rows: DataFrame, trail: Trail) -> DataFrame:
    """Per key and block the last place before the block, as a row just ahead of it.

    Of events that share a timestamp the first in arrival order stands for all.
    """
    block = floor_div("ts_us", trail.block_us)
    last = f"min(IF(contributes, struct(-ts_us AS age, seq AS seq, {_PLACE} AS place), NULL))"
    ends = rows.groupBy(trail.key, F.expr(block).alias("block")).agg(F.expr(last).alias("latest"))
    before = (
        f"OVER (PARTITION BY {trail.key} ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    return ends.selectExpr(
        trail.key,
        "block",
        f"block * {trail.block_us} - 1 AS ts_us",
        "false AS own",
        "false AS contributes",
        f"last(latest.place, true) {before} AS place",
    ).filter("place IS NOT NULL")


def _points(blocks: DataFrame, trail: Trail, history_only: bool) -> DataFrame:
    """Balance changes of every row, from marks that are local to the key and block."""
    m = trail.window_us
    group = f"{trail.key}, block"
    same_value = f"OVER (PARTITION BY {group}, contributes, {trail.value} ORDER BY ts_us)"
    marks = [
        f"contributes AND coalesce(ts_us - lag(ts_us) {same_value} > {m}, true) AS enters",
        f"contributes AND coalesce(lead(ts_us) {same_value} - ts_us > {m}, true) AS leaves",
    ]
    if history_only:
        marks.append(
            f"coalesce(ts_us - max(IF(contributes, ts_us, NULL)) OVER (PARTITION BY {group}, "
            f"{trail.value} ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {m}, "
            "false) AS value_active"
        )
    marked = blocks.selectExpr("*", *marks)
    adds = "cast(contributes AS int)"
    points = [
        _point("ts_us", adds, f"{adds} * {_FAILED}", "cast(enters AS int)", "true"),
        f"IF(leaves, {_point(f'ts_us + {m + 1}', '0', '0', '-1', 'false')}, NULL)",
    ]
    if trail.full:
        gone = _point(f"ts_us + {TEN_MINUTES + 1}", "-1", f"-{_FAILED}", "0", "false")
        points.append(f"IF(contributes, {gone}, NULL)")
    payload = [c for c in marked.columns if c not in ("enters", "leaves", "own", trail.key, "block")]
    return marked.selectExpr("*", f"inline(array_compact(array({', '.join(points)})))").selectExpr(
        trail.key,
        "block",
        "point_us",
        "here AND own AS own",
        *_DELTAS,
        *[f"IF(here, {c}, NULL) AS {c}" for c in payload],
    )


def _balances(points: DataFrame, trail: Trail, history_only: bool) -> DataFrame:
    """Run the balances along every key and block and keep the rows themselves."""
    group = f"PARTITION BY {trail.key}, block"
    # an event that does not contribute still counts itself
    alone = "IF(contributes, 0, 1)"
    unique = f"sum(d_unique) OVER ({group} {_UP_TO})"
    if history_only:
        unique += " + IF(value_active, 0, 1)"
    found = [f"{unique} AS {trail.result}"]
    if trail.full:
        found += [
            f"sum(d_events) OVER ({group} {_UP_TO}) + {alone} AS events_10m",
            f"sum(d_failed) OVER ({group} {_UP_TO}) + {alone} * {_FAILED} AS failed_logins_10m",
        ]
    if trail.travel:
        first = f"row_number() OVER ({group}, point_us, place IS NULL ORDER BY seq) = 1"
        others = [c for c in points.columns if c != "place"]
        points = points.selectExpr(*others, f"IF({first}, place, NULL) AS place")
        found.append(f"max(place) OVER ({group} {_EARLIER}) AS previous")
    inner = ("block", "point_us", "own", "place", "value_active", *_DELTAS)
    kept = [c for c in points.columns if c not in inner]
    return points.selectExpr(*kept, "own", *found).filter("own AND wanted").drop("own")


def _follow(rows: DataFrame, trail: Trail, history_only: bool) -> DataFrame:
    blocks = _in_blocks(rows, trail)
    if trail.travel:
        blocks = blocks.unionByName(_carried(rows, trail), allowMissingColumns=True)
    # the one shuffle: all windows after it are local to the key and block
    blocks = blocks.repartition(trail.key, "block")
    return _balances(_points(blocks, trail, history_only), trail, history_only)


def window_features(
    events: DataFrame,
    history: DataFrame | None = None,
    *,
    mode: str = "joint",
    columns: Sequence[str] = WINDOW_COLUMNS,
) -> DataFrame:
    """Flat events plus the wanted ones of counts, distinct counts, fan-out and travel.

    `history` rows are seen but not returned. In mode `joint` the events also see each
    other; in mode `history_only` each event sees the history and itself, nothing else.
    Only what the wanted `columns` need is computed.
    """
    if mode not in ("joint", "history_only"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "history_only" and history is None:
        raise ValueError("history_only needs a history")
    unknown = sorted(set(columns) - set(WINDOW_COLUMNS))
    if unknown:
        raise ValueError(f"unknown window columns: {', '.join(unknown)}")
    history_only = mode == "history_only"
    flat = flat_events(events)
    rows = flat.selectExpr("*", "true AS wanted", f"{not history_only} AS contributes")
    if history is not None:
        seen = flat_events(history).selectExpr("*", "false AS wanted", "true AS contributes")
        rows = rows.unionByName(seen)

    travel = any(c in columns for c in TRAVEL)
    found = rows
    if travel or any(c in columns for c in COUNTS):
        found = _follow(rows, replace(ENTITY_TRAIL, travel=travel), history_only)
    if FAN_OUT in columns:
        if history is not None and found is not rows:
            # the history must reach the address step as well, without entity results
            found = found.unionByName(rows.filter("NOT wanted"), allowMissingColumns=True)
        found = _follow(found, ADDRESS_TRAIL, history_only)
    elif found is rows:
        found = rows.filter("wanted")
    return with_derived(found, flat.columns, columns)


def carried_history(history: DataFrame, start_us: int) -> DataFrame:
    """The flat part of a history that events from ``start_us`` on can see in their windows or as previous place.

    These are the events of the longest window before, and of older ones the last of each entity (of
    equal times the first), found by one pass that leaves one row of an entity and task before the shuffle.
    Results equal those with the whole history.
    """
    flat = flat_events(history)
    since = start_us - max(ENTITY_TRAIL.window_us, ADDRESS_TRAIL.window_us)
    # a rank that is filtered, not min_by of the row: the engine sorts plain rows and drops the others at once
    nearest = "row_number() OVER (PARTITION BY entity_id ORDER BY ts_us DESC, seq) AS nearest"
    last = flat.filter(f"ts_us < {since}").selectExpr("*", nearest).filter("nearest = 1").drop("nearest")
    return flat.filter(f"ts_us >= {since}").unionByName(last)


def with_derived(found: DataFrame, keep: Sequence[str], columns: Sequence[str] = WINDOW_COLUMNS) -> DataFrame:
    """The wanted window columns, from counts and the place of the previous event."""
    distance = haversine_km("previous.latitude", "previous.longitude", "latitude", "longitude")
    texts = {
        "resource_access_velocity_30m": "unique_resources_30m / 30D",
        "distance_from_previous_km": f"coalesce({distance}, 0D)",
        "implied_speed_kmh": speed_kmh(f"coalesce({distance}, 0D)", "(ts_us - previous.ts_us)"),
    }
    return found.selectExpr(*keep, *[f"{texts.get(c, c)} AS {c}" for c in WINDOW_COLUMNS if c in columns])


def sketched_fan_out(events: DataFrame, minutes: int = 10) -> DataFrame:
    """(source_ip, minute, entities): about how many entities an address served in the minutes up to each of its own.

    One mergeable sketch per address and minute, made before the shuffle; a minute's sketch is shown to
    the minutes whose window holds it, and their sketches are united. Rows grow with busy minutes, not
    with events, so a hot address costs one sketch a minute. Error: about 1.6 % (one sigma), none for few.
    """
    flat = flat_events(events)
    minute = floor_div("ts_us", MINUTE_US)
    each = flat.groupBy("source_ip", F.expr(minute).alias("minute")).agg(F.expr("hll_sketch_agg(entity_id)").alias("sketch"))
    shown = each.selectExpr(
        "source_ip", "sketch", "minute", f"explode(sequence(0, {minutes})) AS later"
    ).selectExpr("source_ip", "sketch", "minute + later AS at", "later = 0 AS own")
    united = shown.groupBy("source_ip", F.col("at").alias("minute")).agg(
        F.expr("hll_sketch_estimate(hll_union_agg(sketch))").alias("entities"), F.expr("max(own)").alias("own")
    )
    return united.filter("own").drop("own")
