"""Novelty and deviation of events against the baseline of their entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.clock import fractional_hour
from driftwatch.operators.profiles import DEVICE_KEY, Baseline
from driftwatch.schema import flat_events

_STATISTICS = ("mean_hour", "hour_std", "mean_session_duration", "session_duration_std")


def unknown_entities(events: DataFrame, statistics: DataFrame) -> DataFrame:
    """Events whose entity has no baseline."""
    return events.join(statistics.select("entity_id"), "entity_id", "left_anti")


def require_known(events: DataFrame, statistics: DataFrame) -> None:
    """Strict mode: fail if any event has no baseline."""
    missing = unknown_entities(events, statistics).select("entity_id").take(1)
    if missing:
        raise ValueError(f"no baseline is known for entity {missing[0]['entity_id']}")


def _spread(deviation: str, spread: str) -> str:
    return f"CASE WHEN {spread} > 0 THEN {deviation} / {spread} ELSE 0D END"


_APART = f"abs({fractional_hour('local_us')} - mean_hour)"
_HOURS = f"least({_APART}, 24D - {_APART})"
_SESSION = "abs(session_duration_seconds - mean_session_duration)"
_DEVIATIONS = {
    "hour_deviation": _HOURS,
    "hour_deviation_zscore": _spread(_HOURS, "hour_std"),
    "session_duration_deviation": _SESSION,
    "session_duration_deviation_zscore": _spread(_SESSION, "session_duration_std"),
}
_PRINT = f"struct({', '.join(DEVICE_KEY)})"


def _finish(rows: DataFrame, keep: list[str], flags: dict[str, str]) -> DataFrame:
    return rows.selectExpr(
        *keep,
        *[f"{text} AS {name}" for name, text in _DEVIATIONS.items()],
        *[f"cast({text} AS int) AS {name}" for name, text in flags.items()],
    )


def _facts(baseline: Baseline) -> DataFrame:
    """All baseline tables as rows of one shape: the entity, one known value, and which kind it is."""
    blank = {
        "source_ip": "string",
        "resource_accessed": "string",
        **dict.fromkeys(DEVICE_KEY, "string"),
        "learnt": "struct<" + ", ".join(f"{c}: double" for c in _STATISTICS) + ">",
    }

    def rows(table: DataFrame, fact: str, **own: str) -> DataFrame:
        values = [f"{own[c]} AS {c}" if c in own else f"cast(NULL AS {kind}) AS {c}" for c, kind in blank.items()]
        return table.selectExpr("entity_id", f"'{fact}' AS fact", *values)

    learnt = f"struct({', '.join(_STATISTICS)})"
    return (
        rows(baseline.statistics, "statistics", learnt=learnt)
        .unionByName(rows(baseline.source_ips, "ip", source_ip="source_ip"))
        .unionByName(rows(baseline.resources, "resource", resource_accessed="resource_accessed"))
        .unionByName(rows(baseline.devices, "device", **{c: c for c in DEVICE_KEY}))
    )


def _spread_out(events: DataFrame, facts: DataFrame, statistics: DataFrame, rows_per_share: int) -> tuple[DataFrame, DataFrame]:
    """Give the events of busy entities several shares, and each share the entity's facts.

    Entities with more baseline events than ``rows_per_share`` are busy; there are at most as many
    as the baseline has events over that number, so their list is small enough to broadcast.
    """
    busy = statistics.filter(f"event_count > {rows_per_share}").selectExpr(
        "entity_id", f"cast(ceil(event_count / {rows_per_share}) AS int) AS shares"
    )
    dealt = events.join(F.broadcast(busy), "entity_id", "left").selectExpr(
        *[c for c in events.columns], "IF(shares IS NULL, 0, pmod(xxhash64(event_id), shares)) AS share"
    )
    copied = facts.join(F.broadcast(busy), "entity_id", "left").selectExpr(
        *[c for c in facts.columns], "explode(sequence(0L, coalesce(shares, 1) - 1L)) AS share"
    )
    return dealt, copied


def deviation_features(events: DataFrame, baseline: Baseline, *, rows_per_share: int = 1_000_000) -> DataFrame:
    """Events that have a baseline, with novelty flags and deviations.

    One exchange: the baseline's facts join the events as rows of the same entity, and whether a value is known
    is carried from the fact to the events beside it. No set is held in memory, sorts can spill,
    and a busy entity is dealt into shares. Events without a baseline are left to `unknown_entities`.
    """
    flat = flat_events(events)
    dealt, facts = _spread_out(flat, _facts(baseline), baseline.statistics, rows_per_share)
    rows = dealt.unionByName(facts, allowMissingColumns=True).repartition("entity_id", "share")

    def known(fact: str, *values: str) -> str:
        return f"max(fact <=> '{fact}') OVER (PARTITION BY {', '.join(('entity_id', 'share', *values))})"

    # windows on longer keys first: the sort of the last of them serves those after it
    rows = (
        rows.selectExpr("*", f"{known('ip', 'source_ip')} AS ip_known")
        .selectExpr("*", f"{known('resource', 'resource_accessed')} AS resource_known")
        .selectExpr("*", f"{known('device', *DEVICE_KEY)} AS print_known")
        .selectExpr("*", f"{known('device', DEVICE_KEY[0])} AND {DEVICE_KEY[0]} IS NOT NULL AS device_known")
        .selectExpr("* EXCEPT (learnt)", "max(learnt) OVER (PARTITION BY entity_id, share) AS learnt")
        .filter("fact IS NULL AND learnt IS NOT NULL")
        .selectExpr("*", "learnt.*")
    )
    flags = {
        "is_new_ip": "source_ip IS NULL OR NOT ip_known",
        "is_new_resource": "resource_accessed IS NULL OR NOT resource_known",
        "is_new_device": "NOT device_known",
        "device_fingerprint_mismatch": "device_known AND NOT print_known",
    }
    # what windows and travel added to the events passes on
    return _finish(rows, flat.columns, flags)


def deviation_features_from_arrays(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Same result from `profiles_with_sets`, in one join; see `fits_arrays` for its bound."""
    flat = flat_events(events)
    sets = ("known_source_ips", "known_resources", "known_devices")
    rows = flat.join(profiles.select("entity_id", *_STATISTICS, *sets), "entity_id")
    same_id = "exists(known_devices, d -> d.fingerprint_id = fingerprint_id)"
    flags = {
        "is_new_ip": "NOT array_contains(known_source_ips, source_ip)",
        "is_new_resource": "NOT array_contains(known_resources, resource_accessed)",
        "is_new_device": f"NOT {same_id}",
        "device_fingerprint_mismatch": f"{same_id} AND NOT exists(known_devices, d -> d = {_PRINT})",
    }
    return _finish(rows, flat.columns, flags)
