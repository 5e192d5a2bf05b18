"""Continuous scoring: windows from the engine's keyed state, then the batch plan per micro-batch.

The engine keeps watermark, offsets and state in its checkpoint. An event is scored once the
watermark (latest event time minus the allowed lateness) has passed it, so a late but allowed event
never changes a result that is already out. Every output of a micro-batch is its own folder and is
replaced when the batch runs again, so a restart adds nothing twice.

    parts/batch=N         what the keyed state gave out
    assessments/batch=N   results
    unknown/batch=N       events whose entity has no baseline
    late/batch=N          events behind the watermark when their micro-batch began
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from driftwatch.operators.deviation import unknown_entities
from driftwatch.operators.explain import assessments
from driftwatch.operators.matrix import matrix_of_windows
from driftwatch.operators.sequence import with_derived
from driftwatch.plans.assess import Model, judge_matrix
from driftwatch.schema import FLAT_COLUMNS, flat_events
from driftwatch.streaming.windows import LATE, merged_parts, payload_of, window_parts

CLOSING_US = 253_402_300_000_000_000  # the end of year 9999: a marker at this time lets every event out


def _write(df: DataFrame, folder: str, table: str, batch_id: int) -> DataFrame:
    path = f"{folder}/{table}/batch={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _markers(spark: SparkSession, schema, folder: str) -> DataFrame:
    """A stream of rows that carry nothing but a time; its folder is made on first use."""
    path = f"{folder}/markers"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def _parts(events: DataFrame, folder: str, lateness_minutes: int) -> tuple[DataFrame, object]:
    flat = flat_events(events).select(*FLAT_COLUMNS)
    together = flat.unionByName(_markers(events.sparkSession, flat.schema, folder))
    return window_parts(together, lateness_minutes), flat.schema


def window_stream(events: DataFrame, folder: str, checkpoint: str, *, lateness_minutes: int = 10) -> DataStreamWriter:
    """Writer of the window columns of a stream of events, to `windows` and `late` under `folder`."""
    parts, flat = _parts(events, folder, lateness_minutes)

    def step(batch: DataFrame, batch_id: int) -> None:
        stored = _write(batch, folder, "parts", batch_id)
        _write(with_derived(merged_parts(stored, flat), FLAT_COLUMNS), folder, "windows", batch_id)
        _write(payload_of(stored, LATE, flat), folder, "late", batch_id)

    return parts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def score_stream(events: DataFrame, model: Model, folder: str, checkpoint: str, *, lateness_minutes: int = 10) -> DataStreamWriter:
    """Writer that scores a stream of events into tables under `folder` (shared storage)."""
    parts, flat = _parts(events, folder, lateness_minutes)

    def step(batch: DataFrame, batch_id: int) -> None:
        stored = _write(batch, folder, "parts", batch_id)
        rows = with_derived(merged_parts(stored, flat), FLAT_COLUMNS)
        scored = judge_matrix(matrix_of_windows(rows, model.baseline), model)
        _write(assessments(scored), folder, "assessments", batch_id)
        unknown = unknown_entities(rows.select(*FLAT_COLUMNS), model.baseline.statistics)
        _write(unknown.select(*FLAT_COLUMNS), folder, "unknown", batch_id)
        _write(payload_of(stored, LATE, flat), folder, "late", batch_id)

    return parts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def run_available(writer: DataStreamWriter) -> None:
    """Take all input there is, in micro-batches, and stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def close_input(spark: SparkSession, folder: str) -> None:
    """Mark the input as closed: the next run lets every waiting event out, and later ones are late."""
    path = f"{folder}/markers"
    schema = spark.read.parquet(path).schema
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != "ts_us"]
    spark.range(1).select(F.lit(CLOSING_US).alias("ts_us"), *blank).select(*schema.names).write.mode("append").parquet(path)


def outputs(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One output table of all micro-batches so far, without the batch column."""
    return spark.read.parquet(f"{folder}/{table}").drop("batch")


def results(spark: SparkSession, folder: str) -> DataFrame:
    return outputs(spark, folder, "assessments")
