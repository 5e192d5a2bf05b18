"""A baseline that grows day by day, in versions, without reading earlier events again.

What a day adds is kept in mergeable form: whole-number sums (of minutes of the day and of seconds of
sessions, and of their squares) that give the same mean and spread in whatever order days are
folded, and the values not known before. A version is written from the one before it, so folding a
day again replaces its own version and nothing else.

    states/version=N    sums per entity over all days so far
    values/version=N    values first seen on day N
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.functions.clock import HOUR_US, MINUTE_US, hour_of_day
from driftwatch.operators.profiles import DEVICE_KEY, VALID_PROFILE, Baseline, normal_events
from driftwatch.schema import flat_events

_MINUTES = f"({hour_of_day('local_us')} * 60 + pmod(local_us, {HOUR_US}) div {MINUTE_US})"
_SUMS = {
    "event_count": "count(*)",
    "minutes": f"sum(cast({_MINUTES} AS decimal(28, 0)))",
    "minutes_squared": f"sum(cast({_MINUTES} * {_MINUTES} AS decimal(28, 0)))",
    "seconds": "sum(cast(session_duration_seconds AS decimal(28, 0)))",
    "seconds_squared": "sum(cast(cast(session_duration_seconds AS bigint) * session_duration_seconds AS decimal(28, 0)))",
    "failures": "count_if(outcome = 'failure')",
}
_STATE = "entity_id string, event_count bigint, minutes decimal(38,0), minutes_squared decimal(38,0), seconds decimal(38,0), seconds_squared decimal(38,0), failures bigint"
_VALUES = "entity_id string, kind string, value string, operating_system string, browser string, device_type string"
_KINDS = {"source_ip": "source_ip", "resource": "resource_accessed", "auth_method": "auth_method"}


def _read(spark: SparkSession, folder: str, schema: str, versions: range) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/version={v}" for v in versions])


def _cast(df: DataFrame, schema: str) -> DataFrame:
    return df.selectExpr(*[f"cast({c} AS {kind}) AS {c}" for c, kind in (x.split(" ", 1) for x in schema.split(", "))])


def day_states(events: DataFrame) -> DataFrame:
    """Mergeable sums per entity of some normal events."""
    flat = flat_events(normal_events(events))
    sums = [F.expr(text).alias(name) for name, text in _SUMS.items()]
    return _cast(flat.groupBy("entity_id").agg(*sums), _STATE)


def day_values(events: DataFrame) -> DataFrame:
    """Distinct values per entity and kind, in one pass over the events."""
    others = "NULL AS operating_system, NULL AS browser, NULL AS device_type"
    rows = [f"struct('{kind}' AS kind, {column} AS value, {others})" for kind, column in _KINDS.items()]
    rows.append(f"struct('device' AS kind, {DEVICE_KEY[0]} AS value, {', '.join(DEVICE_KEY[1:])})")
    flat = flat_events(normal_events(events))
    return _cast(flat.selectExpr("entity_id", f"inline(array({', '.join(rows)}))"), _VALUES).distinct()


def fold_day(spark: SparkSession, folder: str, events: DataFrame, version: int) -> None:
    """Write version `version` (from 0) from the one before it and one day's events."""
    before = _read(spark, f"{folder}/states", _STATE, range(max(0, version - 1), version))
    both = before.unionByName(day_states(events)).groupBy("entity_id")
    sums = _cast(both.agg(*[F.sum(name).alias(name) for name in _SUMS]), _STATE)
    sums.write.mode("overwrite").parquet(f"{folder}/states/version={version}")
    known = _read(spark, f"{folder}/values", _VALUES, range(version)).withColumnsRenamed({c: f"k_{c}" for c in _names(_VALUES)})
    today = day_values(events)
    same = [today[c].eqNullSafe(known[f"k_{c}"]) for c in _names(_VALUES)]
    today.join(known, same, "left_anti").write.mode("overwrite").parquet(f"{folder}/values/version={version}")


def _names(schema: str) -> list[str]:
    return [x.split(" ", 1)[0] for x in schema.split(", ")]


def _spread(total: str, squared: str, unit: str = "1D") -> str:
    """Population deviation from whole sums; the difference of products is exact."""
    exact = f"cast(event_count AS decimal(18, 0)) * cast({squared} AS decimal(20, 0)) - cast({total} AS decimal(19, 0)) * cast({total} AS decimal(19, 0))"
    return f"sqrt(cast({exact} AS double)) / event_count / {unit}"


def merged_baseline(spark: SparkSession, folder: str, version: int) -> Baseline:
    """The baseline of all days up to a version, with the tables that `learn_baseline` gives."""
    states = _read(spark, f"{folder}/states", _STATE, range(version, version + 1))
    statistics = states.selectExpr(
        "entity_id",
        "event_count",
        "cast(minutes AS double) / event_count / 60D AS mean_hour",
        f"{_spread('minutes', 'minutes_squared', '60D')} AS hour_std",
        "cast(seconds AS double) / event_count AS mean_session_duration",
        f"{_spread('seconds', 'seconds_squared')} AS session_duration_std",
        "cast(failures AS double) / event_count AS authentication_failure_rate",
    ).selectExpr("*", f"{VALID_PROFILE} AS profile_valid")
    values = _read(spark, f"{folder}/values", _VALUES, range(version + 1))
    tables = {kind: values.filter(f"kind = '{kind}'").selectExpr("entity_id", f"value AS {column}") for kind, column in _KINDS.items()}
    devices = values.filter("kind = 'device'").selectExpr("entity_id", f"value AS {DEVICE_KEY[0]}", *DEVICE_KEY[1:])
    return Baseline(statistics, tables["source_ip"], tables["resource"], tables["auth_method"], devices)
