"""Clusters of many near copies: queries in proportion to the members, links whole."""

import numpy as np
import pytest
from test_operators import brute_components, by_id

from driftwatch.llm import jaccard


def cluster(n, changes, seed):
    """Texts of 100 words with one ancestor, each with some words of its own."""
    draw = np.random.default_rng(seed)
    base = [f"b{seed}w{i}" for i in range(100)]
    out = []
    for i in range(n):
        words = list(base)
        for at in draw.choice(100, int(draw.integers(1, changes + 1)), replace=False):
            words[at] = f"own{seed}x{i}x{at}"
        out.append(" ".join(words))
    return out


@pytest.fixture
def counted(monkeypatch):
    """Rows of the tables that the join keeps, by name."""
    rows = {}
    real = jaccard.kept

    def kept(df, name):
        out = real(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "kept", kept)
    return rows


def test_queries_of_a_cluster_grow_with_its_members(spark, counted):
    texts = cluster(1200, 1, 1) + cluster(30, 1, 2) + [" ".join(f"s{i}w{j}" for j in range(60)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert counted["group-queries"] < 3000
    assert all(got[i] == 0 for i in range(1200)) and all(got[i] == 1200 for i in range(1200, 1230))
    assert all(got[i] == i for i in range(1230, 1250))


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (3, 90)])
def test_loose_clusters_equal_brute_force(spark, monkeypatch, size, percent):
    """Small groups, and copies that differ so much that only some of them link."""
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 4)
    shared = " ".join(f"passage{i}" for i in range(40))
    texts = cluster(60, 4, 3) + cluster(60, 3, 4) + [f"{shared} " + " ".join(f"p{i}w{j}" for j in range(i % 25)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert by_id(jaccard.near_duplicates(docs, size, percent), "id", "n_shingles", "component_id") == brute_components(dict(enumerate(texts)), size, percent)
