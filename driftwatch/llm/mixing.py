"""Mix sources to target weights: repetition rates per source, seeded copies per document."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.scratch import kept

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone (52 bits of MD5)."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _running(df: DataFrame, order: Sequence[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Add sums over all rows before each row in ``order``, by ranges: no task holds all rows.

    The ranged table is written once, so that both readings see the same ranges.
    """
    ranged = kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "_range")
    for k, c in sums.items():
        out = out.withColumn(k, F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{k}"))
    return out.drop("_range", *[f"_o_{k}" for k in sums])


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """(source, source_size) to target: weights by code point order, null last; capped and reshared.

    With the level L, a source gets min(most_repeats * size, L * weight), and the targets sum to all
    sizes. With sources sorted by cap / weight, the level left for a source once all before it are
    filled rises up to the first that stays unfilled and falls after it: the highest is L.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ordered = _running(
        sizes.select("source", "source_size", F.lit(1).alias("one")),
        [F.col("source").asc_nulls_last()],
        {"before": "one"},
        "mix-sources",
    )
    weighed = ordered.select(
        "source",
        "source_size",
        F.element_at(cycle, (F.col("before") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * most_repeats).alias("cap"),
    )
    total = sizes.agg(F.sum("source_size").alias("total"))
    by_fill = _running(
        weighed, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"cap_before": "cap", "weight_before": "weight"}, "mix-fill"
    )
    all_weights = by_fill.agg(F.sum("weight").alias("all_weight"))
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    found = by_fill.join(F.broadcast(total)).join(F.broadcast(all_weights)).agg(F.max(level).alias("fill"))  # one row each
    return by_fill.join(F.broadcast(found)).select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(F.col("fill"), F.lit(0.0))).alias("target"),
    )


def mix_counts(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    seed: int = SEED,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """Every document with how often the mix takes it.

    Adds ``size`` (words), ``source_size``, ``target`` and ``copies``: floor(rate) and, with the
    probability of the fraction, one more, drawn by a hash of key and seed. Columns of ``docs`` with
    these names are replaced. Null text has size 0; a null source is a source of its own; rows with the
    same key share their draw; a source of size 0 has rate 0. No rows give no rows.
    """
    added = ("size", "source_size", "target", "copies")
    docs = docs.drop(*added)
    sized = docs.withColumn("size", word_count(F.col(text)))
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    sizes = kept(sizes, "mix-sizes")  # one row a source; read several times
    of = f"source_{uuid.uuid4().hex}"  # no column of the input has this name
    targets = source_targets(sizes, weights, most_repeats).withColumnRenamed("source", of)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (unit_hash(F.col(key), seed) < rate - F.floor(rate)).cast("long")
    return (
        sized.join(targets, F.col(source).eqNullSafe(F.col(of)), "left")
        .drop(of)
        .withColumn("copies", F.floor(rate) + extra)
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document repeated ``copies`` times, with the columns of ``docs``."""
    columns = docs.columns
    taken = mix_counts(docs, **options).where(F.col("copies") > 0)
    copy = f"copy_{uuid.uuid4().hex}"
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
