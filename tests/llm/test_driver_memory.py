"""What fitting and the rounds of components hold in the driver."""

import random
import tracemalloc

import numpy as np

from driftwatch.llm import quality
from driftwatch.llm.components import components


def test_fitting_holds_its_counts_twice_at_most(spark):
    rng = random.Random(3)
    rows = [(" ".join(str(rng.randrange(500)) for _ in range(20)), i % 2) for i in range(800)]
    docs = spark.createDataFrame(rows, "text string, quality int").repartition(3)
    docs.count()
    tracemalloc.start()
    model = quality.fit(docs.select("text"), docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.vectors.shape == (800, quality.DIMENSIONS) and model.prior == 0.5
    assert peak < 3 * 800 * quality.TERMS * 4


def test_the_model_does_not_depend_on_the_order_of_rows(spark):
    rows = [("one two three", 1), ("one two three", 0), ("four five", 0), ("", 1), ("six", 1), ("six", 1)]
    docs = spark.createDataFrame(rows, "text string, quality int").coalesce(1)
    turned = spark.createDataFrame(rows[::-1], "text string, quality int").coalesce(1)
    a, b = (quality.fit(d.select("text"), d) for d in (docs, turned))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.votes, b.votes) and np.array_equal(a.projection, b.projection)


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    plans = []
    kept = components.__globals__["kept"]
    monkeypatch.setitem(components.__globals__, "kept", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or kept(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30}
    assert plans and not any("Broadcast" in p for p in plans)


def test_a_round_of_components_reads_its_edges_four_times_at_most(spark, monkeypatch):
    plans = []
    kept = components.__globals__["kept"]
    monkeypatch.setitem(components.__globals__, "kept", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or kept(df, name))
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 330)] + [(400, i) for i in range(380, 420)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {x: x for a, b in pairs if a != b for x in (a, b)}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least
    assert len(plans) > 2 and all(p.count("Join") <= 3 and p.count("FileScan parquet") <= 4 for p in plans)


def test_counts_come_to_the_driver_compressed(spark, monkeypatch):
    sent = []
    collected = quality.collected
    monkeypatch.setattr(quality, "collected", lambda rows: sent.extend(len(r.counts) for r in rows.collect()) or collected(rows))
    rows = [(f"some words of a text {i} ünd", i % 2) for i in range(50)] + [(None, 1), ("", 0)]
    docs = spark.createDataFrame(rows, "text string, quality int")
    model = quality.fit(docs.select("text"), docs)
    assert len(sent) == len(model.votes) == 52 and model.votes.sum() == 26
    assert sum(sent) < 52 * quality.TERMS * 4 / 8
