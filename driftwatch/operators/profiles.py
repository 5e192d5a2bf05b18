"""Per-entity baseline: usual hours, sessions and failures, and the values seen so far."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.clock import fractional_hour
from driftwatch.schema import flat_events

DEVICE_KEY = ("fingerprint_id", "operating_system", "browser", "device_type")


def normal_events(events: DataFrame) -> DataFrame:
    """Events fit for learning: unlabelled or labelled normal."""
    return events.filter("label IS NULL OR label = 'normal'")


_STATISTICS = {
    "event_count": "count(*)",
    "mean_hour": f"avg({fractional_hour('local_us')})",
    "hour_std": f"stddev_pop({fractional_hour('local_us')})",
    "mean_session_duration": "avg(cast(session_duration_seconds AS double))",
    "session_duration_std": "stddev_pop(cast(session_duration_seconds AS double))",
    "authentication_failure_rate": "avg(cast(outcome = 'failure' AS double))",
}
_SETS = {
    "known_source_ips": "sort_array(collect_set(source_ip))",
    "known_resources": "sort_array(collect_set(resource_accessed))",
    "known_auth_methods": "sort_array(collect_set(auth_method))",
    "known_devices": f"sort_array(collect_set(struct({', '.join(DEVICE_KEY)})))",
}
VALID_PROFILE = (
    "mean_hour BETWEEN 0 AND 23 AND hour_std >= 0 AND mean_session_duration >= 0 "
    "AND session_duration_std >= 0 AND authentication_failure_rate BETWEEN 0 AND 1"
)


def _profile(events: DataFrame, columns: dict[str, str]) -> DataFrame:
    flat = flat_events(normal_events(events))
    found = flat.groupBy("entity_id").agg(*[F.expr(c).alias(n) for n, c in columns.items()])
    return found.selectExpr("*", f"{VALID_PROFILE} AS profile_valid")


def profile_statistics(events: DataFrame) -> DataFrame:
    """One row per entity; partial aggregation keeps a heavy entity cheap."""
    return _profile(events, _STATISTICS)


def known_values(events: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of `columns` per entity, one per row, so no set has to fit a task."""
    return flat_events(normal_events(events)).select("entity_id", *columns).distinct()


def profiles_with_sets(events: DataFrame) -> DataFrame:
    """Statistics plus the known values as sorted arrays.

    An array must fit a row: meant for entities with modest sets. `fits_arrays` tells whether
    a baseline qualifies; the row-per-value tables of `known_values` serve any size.
    """
    return _profile(events, {**_STATISTICS, **_SETS})


@dataclass(frozen=True)
class Baseline:
    """The learned tables of a profile period."""

    statistics: DataFrame
    source_ips: DataFrame
    resources: DataFrame
    auth_methods: DataFrame
    devices: DataFrame


def learn_baseline(events: DataFrame, *, check: bool = False) -> Baseline:
    """Baseline tables of `events`. With `check`, refuse input that can teach nothing."""
    if check:
        if events.isEmpty():
            raise ValueError("no events to learn from: the table is empty")
        if normal_events(events).isEmpty():
            raise ValueError("every event is labelled as an attack, so nothing normal is left to learn")
    flat = flat_events(events)
    return Baseline(
        statistics=profile_statistics(flat),
        source_ips=known_values(flat, "source_ip"),
        resources=known_values(flat, "resource_accessed"),
        auth_methods=known_values(flat, "auth_method"),
        devices=known_values(flat, *DEVICE_KEY),
    )


def profile_sets(baseline: Baseline) -> DataFrame:
    """All known values as (entity_id, kind, value) rows; devices as their four parts."""
    device = "concat_ws('|', " + ", ".join(f"coalesce({c}, '')" for c in DEVICE_KEY) + ")"
    kinds = (
        ("source_ip", baseline.source_ips, "source_ip"),
        ("resource", baseline.resources, "resource_accessed"),
        ("auth_method", baseline.auth_methods, "auth_method"),
        ("device", baseline.devices, device),
    )
    tables = [
        table.selectExpr("entity_id", f"'{kind}' AS kind", f"{value} AS value")
        for kind, table, value in kinds
    ]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def set_sizes(baseline: Baseline) -> DataFrame:
    """Number of known values per entity and kind."""
    return profile_sets(baseline).groupBy("entity_id", "kind").agg(F.count("*").alias("n_values"))


def fits_arrays(baseline: Baseline, limit: int = 1_000) -> bool:
    """Whether no entity knows more than `limit` values of a kind (an eager check)."""
    return set_sizes(baseline).filter(F.col("n_values") > limit).isEmpty()


def invalid_profiles(statistics: DataFrame) -> DataFrame:
    return statistics.filter(~F.col("profile_valid"))
