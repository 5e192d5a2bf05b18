"""Isolation forest (Liu, Ting and Zhou, ICDM 2008) on Spark.

Fitting draws one bounded sample per tree by hashing event ids and grows each tree in its
own task. Scoring walks all trees over Arrow batches. The forest itself is small whatever
the data: at most n_estimators * (2 * sample - 1) nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.operators.matrix import check_columns, check_values
from driftwatch.operators.rank import quantile
from driftwatch.schema import MODEL_FEATURES

MAX_SAMPLE = 256
MAX_TREES = 10_000  # nodes of all trees come to the driver and go to every task: 5 million at most
MARGIN = 1.5
CONSTANT = 1e-7  # a feature that varies less than this within a node is not split on
_EULER = 0.5772156649

FOREST_SCHEMA = T.StructType(
    [
        T.StructField("tree_id", T.IntegerType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
    ]
)


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def check_parameters(contamination: float, n_estimators: int) -> None:
    if not 0.0 < contamination <= 0.5:
        raise ValueError("the share of outliers has to lie above 0 and not above 0.5")
    if n_estimators <= 0:
        raise ValueError("a forest needs one tree at least")
    if n_estimators > MAX_TREES:
        raise ValueError(f"a forest of more than {MAX_TREES} trees does not fit into a task")


@dataclass(frozen=True)
class Forest:
    """A fitted forest: node rows plus the score above which an event is anomalous."""

    nodes: DataFrame
    sample: int
    threshold: float | None

    @property
    def is_fitted(self) -> bool:
        return self.threshold is not None


def _grow(seed: int, height: int, features: tuple[str, ...]):
    """Function that turns the sample of one tree into its node rows."""

    def grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        x = sample.sort_values("draw")[list(features)].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes: list[tuple] = []
        open_nodes = [(np.arange(len(x)), 0, 0)]  # members, depth, node id
        free = 1
        while open_nodes:
            members, depth, node = open_nodes.pop(0)
            part = x[members]
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
            usable = np.flatnonzero(high > low + CONSTANT) if len(part) > 1 else []
            if depth >= height or len(usable) == 0:
                nodes.append((tree, node, None, None, None, None, len(members), depth))
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            if cut >= high[f]:  # keep both sides non-empty
                cut = float(low[f])
            goes_left = part[:, f] <= cut
            nodes.append((tree, node, features[f], cut, free, free + 1, len(members), depth))
            open_nodes.append((members[goes_left], depth + 1, free))
            open_nodes.append((members[~goes_left], depth + 1, free + 1))
            free += 2
        # nullable integers: children are absent on leaves
        return pd.DataFrame(nodes, columns=FOREST_SCHEMA.names).astype(
            {"left": "Int32", "right": "Int32"}
        )

    return grow


def draw_samples(matrix: DataFrame, total: int, trees: int, seed: int, pool_limit: int | None = None) -> DataFrame:
    """(tree_id, draw, features): at most MAX_SAMPLE rows per tree, the same on every run.

    With `pool_limit`, trees draw from a uniform pool of about that many rows instead of all rows.
    """
    pool = matrix
    pool_rows = total
    if pool_limit is not None and total > pool_limit:
        share = pool_limit / total
        unit = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(2**31)) / F.lit(float(2**31))
        pool, pool_rows = matrix.filter(unit < share), pool_limit
    keep = min(1.0, MARGIN * MAX_SAMPLE / pool_rows)
    top = F.lit(int(keep * 2**31))
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda tree: F.struct(
            tree.alias("tree_id"),
            F.pmod(F.xxhash64(F.col("event_id"), tree, F.lit(seed)), F.lit(2**31)).alias("draw"),
        ),
    )
    drawn = pool.select(
        "event_id", *MODEL_FEATURES, F.inline(F.filter(draws, lambda d: d["draw"] <= top))
    )
    best = F.row_number().over(
        # event_id decides between equal hashes
        Window.partitionBy("tree_id").orderBy("draw", "event_id")
    )
    return drawn.withColumn("place", best).filter(F.col("place") <= MAX_SAMPLE).drop("place")


def fit_forest(
    matrix: DataFrame,
    *,
    contamination: float = 0.01,
    n_estimators: int = 200,
    random_state: int = 42,
    pool_limit: int | None = None,
) -> Forest:
    """Fit on the feature matrix of normal history (identity columns plus features).

    Every row may be drawn for a tree; `pool_limit` bounds the rows drawn from, where hashing all rows
    once a tree is too much.
    """
    check_parameters(contamination, n_estimators)
    check_columns(matrix)
    spark = matrix.sparkSession
    matrix = matrix.select("event_id", *MODEL_FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = check_values(matrix)
        if total == 0:
            raise ValueError("no rows to grow a forest from: the matrix is empty")
        sample = min(MAX_SAMPLE, total)
        height = math.ceil(math.log2(max(sample, 2)))
        grown = (
            draw_samples(matrix, total, n_estimators, random_state, pool_limit)
            # a fixed count: the data is tiny but growing trees is not, so keep it spread out
            .repartition(min(n_estimators, spark.sparkContext.defaultParallelism), "tree_id")
            .groupBy("tree_id")
            .applyInPandas(_grow(random_state, height, MODEL_FEATURES), FOREST_SCHEMA)
        )
        nodes = spark.createDataFrame(grown.collect(), FOREST_SCHEMA)
        scores = raw_scores(matrix, Forest(nodes, sample, None)).select("raw_score")
        scores = scores.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            threshold = quantile(scores, "raw_score", 1.0 - contamination, total)
        finally:
            scores.unpersist()
    finally:
        matrix.unpersist()
    return Forest(nodes, sample, threshold)


def _tables(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Trees as complete binary heaps: feature, cut and final path length by slot.

    A leaf above the last level sends everything left down to it, so all rows of all trees
    take the same number of steps and no branch is needed.
    """
    height = int(nodes["depth"].max())
    trees = np.sort(nodes["tree_id"].unique())
    slots = 2 ** (height + 1) - 1
    feature = np.zeros((len(trees), slots), dtype=np.int32)
    cut = np.full((len(trees), slots), np.inf)
    path = np.zeros((len(trees), slots))
    order = {name: i for i, name in enumerate(MODEL_FEATURES)}
    for at, tree in enumerate(trees):
        rows = {int(r.node_id): r for r in nodes[nodes["tree_id"] == tree].itertuples()}
        todo = [(0, 0)]
        while todo:
            node, slot = todo.pop()
            row = rows[node]
            if row.feature is None or pd.isna(row.feature):
                length = row.depth + average_path(int(row.size))
                for _ in range(height - int(row.depth)):
                    slot = 2 * slot + 1
                path[at, slot] = length
            else:
                feature[at, slot] = order[row.feature]
                cut[at, slot] = row.threshold
                todo.append((int(row.left), 2 * slot + 1))
                todo.append((int(row.right), 2 * slot + 2))
    return feature, cut, path, height


def raw_scores(matrix: DataFrame, forest: Forest) -> DataFrame:
    """Add `raw_score` in (0, 1]: 2 to the minus mean path over the expected path."""
    spark: SparkSession = matrix.sparkSession
    # bounded by n_estimators * (2 * MAX_SAMPLE - 1) rows
    tables = spark.sparkContext.broadcast(_tables(forest.nodes.toPandas()))
    expected = average_path(forest.sample)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        feature, cut, path, height = tables.value
        for batch in batches:
            n = len(batch)
            x = np.ascontiguousarray(batch.to_numpy(dtype=float).T).ravel()  # feature by feature
            row = np.arange(n)
            depth = np.zeros(n)
            for tree in range(len(feature)):
                slot = np.zeros(n, dtype=np.int64)
                for _ in range(height):
                    value = x[feature[tree].take(slot) * n + row]
                    slot = 2 * slot + 1 + (value > cut[tree].take(slot))
                depth += path[tree].take(slot)
            mean = depth / len(feature)
            yield pd.Series(np.power(2.0, -mean / expected) if expected > 0 else np.ones(n) * 0.5)

    columns = F.struct(*[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES])
    return matrix.withColumn("raw_score", score(columns))


def walked_paths(matrix: DataFrame, feature: list[list[int]], cut: list[list[float]], path: list[list[float]], height: int) -> DataFrame:
    """Add `mean_path`, walking the trees in expressions alone, without a Python worker.

    Trees are complete heaps as `_tables` makes them, held as arrays in one broadcast row: slot 0 is the root, a value
    above the cut goes to slot 2 i + 2, any other to 2 i + 1, and after `height` steps `path` holds the length.
    """
    trees, slots = len(feature), len(feature[0])
    flat = lambda rows: [x for row in rows for x in row]
    held = matrix.sparkSession.createDataFrame(
        [(flat(feature), flat(cut), flat(path))], "tree_feature array<int>, tree_cut array<double>, tree_path array<double>"
    )
    values = "array(" + ", ".join(f"cast({c} AS double)" for c in MODEL_FEATURES) + ")"
    step = f"2 * slot + 1 + IF(tree_values[tree_feature[t * {slots} + slot]] > tree_cut[t * {slots} + slot], 1, 0)"
    leaf = f"aggregate(sequence(1, {height}), 0, (slot, level) -> {step})"
    total = f"aggregate(sequence(0, {trees - 1}), 0D, (sum, t) -> sum + tree_path[t * {slots} + {leaf}])"
    return (
        matrix.selectExpr("*", f"{values} AS tree_values")
        .crossJoin(F.broadcast(held))  # one row, bounded by MAX_TREES
        .selectExpr(*matrix.columns, f"{total} / {trees} AS mean_path")
    )


def walked_scores(matrix: DataFrame, forest: Forest) -> DataFrame:
    """Add `raw_score` as `raw_scores` does, by `walked_paths`."""
    feature, cut, path, height = _tables(forest.nodes.toPandas())
    found = walked_paths(matrix, feature.tolist(), cut.tolist(), path.tolist(), height)
    expected = average_path(forest.sample)
    score = f"power(2D, -mean_path / {expected}D)" if expected > 0 else "0.5D"
    return found.selectExpr(*matrix.columns, f"{score} AS raw_score")


def tree_checks(nodes: DataFrame) -> DataFrame:
    """(tree_id, roots, leaf_rows, deepest, unbalanced): what must hold of every tree.

    One root that no node points to, leaf sizes that sum to the sample, a bounded depth, and no inner
    node whose size differs from its children's together.
    """
    children = nodes.selectExpr("tree_id", "node_id AS parent", "size AS parent_size", "explode(array(left, right)) AS node_id").filter("node_id IS NOT NULL")
    linked = nodes.join(children, ["tree_id", "node_id"], "left")
    sums = linked.filter("parent IS NOT NULL").groupBy("tree_id", "parent").agg(F.expr("any_value(parent_size) <> sum(size)").alias("differs"))
    wrong = sums.groupBy("tree_id").agg(F.expr("count_if(differs)").alias("unbalanced"))
    per_tree = linked.groupBy("tree_id").agg(
        F.expr("count_if(parent IS NULL)").alias("roots"),
        F.expr("sum(IF(feature IS NULL, size, 0))").alias("leaf_rows"),
        F.expr("max(depth)").alias("deepest"),
    )
    return per_tree.join(wrong, "tree_id", "left").selectExpr("tree_id", "roots", "leaf_rows", "deepest", "coalesce(unbalanced, 0) AS unbalanced")


def score_forest(matrix: DataFrame, forest: Forest) -> DataFrame:
    """Add `ml_anomaly_score` (above 0 is anomalous) and `ml_flagged`."""
    if not forest.is_fitted:
        raise RuntimeError("this forest has not been grown yet")
    return (
        raw_scores(matrix, forest)
        .withColumn("ml_anomaly_score", F.col("raw_score") - F.lit(forest.threshold))
        .withColumn("ml_flagged", F.col("ml_anomaly_score") > 0)
        .drop("raw_score")
    )
