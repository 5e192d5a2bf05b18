"""Components and scores that are large: exact, or refused."""

import pytest

from driftwatch.llm import topk

ROWS = [(20, [3e6, -1.0]), (1, [2.5e6, 0.0]), (2, [3e6, 1.0]), (3, [9e6, 0.0]), (4, [-9e6, 5.0])]


def test_unscaled_vectors_keep_their_scores(spark):
    df = spark.createDataFrame(ROWS, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 20")).orderBy("rank").collect()]
    dot = {i: sum(int(64 * a) * int(64 * b) for a, b in zip(v, ROWS[0][1], strict=True)) for i, v in ROWS[1:]}
    assert got == sorted(dot.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("large", [1e18, 1e12])
def test_what_64_bits_cannot_hold_is_refused(spark, large):
    df = spark.createDataFrame([(20, [large]), (1, [large])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="cannot be quantised|64 bits"):
        topk.top_k(df, df.where("vec_id = 20")).collect()


def test_ragged_vectors_get_k_rows_a_query(spark):
    """Blocks of different widths cut a query differently, and still answer one query."""
    rows = [(i, [float((i * 7 + j) % 5) for j in range(2 if i % 3 else 6)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(frame, frame.where("vec_id % 4 = 0"), k=3, scale=1, block_rows=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i, q in rows[::4]:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:3]
        assert sorted(got[i]) == [(n, j, int(-s)) for n, (s, j) in enumerate(scores, 1)]


def test_repeated_rows_and_many_blocks(spark):
    """A row that is there 300 times fills the ranks of its queries; blocks and lanes change nothing."""
    rows = [(7, [2.0, -1.0])] * 300 + [(i, [float(i % 9), float(i % 4)]) for i in range(8, 60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    answers = []
    for block_rows, lane_rows in ((1 << 16, 512), (16, 1), (64, 3)):
        found = topk.top_k(frame, frame.where("vec_id % 20 = 0 or vec_id = 7"), k=5, block_rows=block_rows, lane_rows=lane_rows)
        answers.append(sorted(map(tuple, found.collect())))
    assert answers[0] == answers[1] == answers[2]
    for q, v in {i: v for i, v in rows if i % 20 == 0 or i == 7}.items():
        scored = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:5]
        assert [(r, i, s) for x, r, i, s in answers[0] if x == q] == [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]
