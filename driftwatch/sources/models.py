"""Stored models and event tables: parquet folders that another job can load."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from driftwatch.operators.forest import Forest
from driftwatch.operators.profiles import Baseline
from driftwatch.plans.assess import Model
from driftwatch.schema import EVENT_SCHEMA

_FACTS = "sample int, threshold double"


def save_model(model: Model, folder: str) -> None:
    """Write the baseline tables and, if there is one, the forest to a new folder.

    ``forest`` holds the nodes and ``facts`` one row with sample and threshold; without a forest ``facts``
    has no rows. ``facts`` is written last, so a half-written model cannot be loaded.
    """
    store_baseline(model.baseline, folder)
    forest = model.forest
    if forest is not None:
        forest.nodes.write.parquet(f"{folder}/forest")
    facts = [] if forest is None else [(forest.sample, forest.threshold)]
    model.baseline.statistics.sparkSession.createDataFrame(facts, _FACTS).write.parquet(f"{folder}/facts")


def load_model(spark: SparkSession, folder: str) -> Model:
    facts = spark.read.schema(_FACTS).parquet(f"{folder}/facts").first()
    tables = {f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(Baseline)}
    if facts is None:
        return Model(Baseline(**tables))
    return Model(Baseline(**tables), Forest(spark.read.parquet(f"{folder}/forest"), facts["sample"], facts["threshold"]))


def store_baseline(baseline: Baseline, folder: str) -> Baseline:
    """Write the baseline tables once and read them back, so that what uses them does not learn them again."""
    spark = baseline.statistics.sparkSession
    for field in fields(Baseline):
        getattr(baseline, field.name).write.parquet(f"{folder}/{field.name}")
    return Baseline(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(Baseline)})


def read_events(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A table of security events (``parquet`` or ``json`` lines) under the event schema."""
    return spark.read.schema(EVENT_SCHEMA).format(form).load(path)
