"""A table of alerts that repeats nothing: each run owns its rows and a line in a manifest.

    alerts/run=ID      the rows of a run, replaced as a whole when the run is written again
    manifest/run=ID    how many there are, written last: a run without it does not count
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_alerts(alerts: DataFrame, folder: str, run: str) -> None:
    """Write the alerts of a run; doing so again, after a failure or not, leaves one copy."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
        raise ValueError("a run is named by letters, digits, - and _")
    spark, rows = alerts.sparkSession, f"{folder}/alerts/run={run}"
    alerts.write.mode("overwrite").parquet(rows)
    written = spark.read.schema(alerts.schema).parquet(rows).agg(F.count("*").alias("n_alerts"))
    written.write.mode("overwrite").parquet(f"{folder}/manifest/run={run}")


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts of all finished runs, with the run; an unfinished run's rows stay out."""
    finished = spark.read.parquet(f"{folder}/manifest").select(F.col("run").cast("string"))
    rows = spark.read.parquet(f"{folder}/alerts").withColumn("run", F.col("run").cast("string"))
    return rows.join(F.broadcast(finished), "run", "left_semi")  # one row a run
