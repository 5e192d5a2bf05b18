"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows sent to Python in batches of 4 MB instead of 64: a batch is held several times on the way, in the JVM and in Python.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode without one, a new temporary folder.

    A cluster without the setting is refused: its executors share no temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the jobs started inside; those before are put back."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: short lineage, safe from lost executors.

    The shuffle files of the write are dropped when it ends, since nothing reads them again.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def least_keys(df: DataFrame, n: int, wanted: int, key: str = "key") -> DataFrame:
    """The ``wanted`` rows of least ``key``, a 64-bit hash that differs in most of the ``n`` rows.

    A bound on the key first leaves about twice the wanted rows, so that the sort gets no more from
    all partitions together, however many there are.
    """
    share = min(1.0, (2 * wanted + 100) / max(n, 1))
    low = df.where(F.col(key) <= -(2.0**63) + share * 2.0**64)
    return low.orderBy(key, *[c for c in df.columns if c != key]).limit(wanted)
