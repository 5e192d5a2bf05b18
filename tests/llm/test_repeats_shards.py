"""Anchors are dealt evenly: they are least hashes, whose own order would give the first shard most of them."""

import numpy as np
import pyarrow as pa
import pytest

from driftwatch.llm import repeats
from driftwatch.llm.words import prefix_sums


@pytest.mark.parametrize("shards", [16, 51])
def test_contexts_are_dealt_evenly(shards):
    text = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 200_000)))
    data = np.frombuffer(text.encode(), np.uint8)
    hashes = np.unique(repeats.anchors(data, np.array([0, len(data)]), prefix_sums(data))[0])
    rows = repeats.contexts(pa.table({"id": pa.array([1]), "text": pa.array([text])}), hashes, shards)
    held = [repeats.unpacked(r[1], np.uint64) for r in rows]
    assert np.array_equal(np.unique(np.concatenate(held)), hashes)  # none is lost
    assert len(held) == shards and max(map(len, held)) < 2 * len(hashes) / shards
