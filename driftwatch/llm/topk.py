"""Exact top-k by inner product over a bit-sliced index of quantised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.scratch import kept

K = 20
SCALE = 64
QUERY_EVERY = 20
BLOCK_ROWS = 65_536
BLOCK_CELLS = 1 << 24  # rows x components of a block: wider vectors get blocks of fewer rows
LANE_ROWS = 512
TASKS_PER_CORE = 4
INDEX = "block int, ids binary, low binary, bits binary, up binary"
LIMIT = 1 << 61  # differences of components within +-LIMIT fit into 64 bits; others are refused


def quantised(vector: str = "embedding", scale: int = SCALE):
    """floor(scale * x) of each component as a double first, as an array of longs; fails beyond +-LIMIT."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    refused = F.raise_error(F.lit(f"a component is beyond {LIMIT // scale} and cannot be quantised exactly")).cast("long")
    held = lambda x: F.when(F.abs(scaled(x)) <= float(LIMIT), F.floor(scaled(x))).otherwise(refused)
    return F.transform(F.col(vector), held)


def usable(vector: str = "embedding"):
    """Neither null nor empty, and every component a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def _bitmap(bit: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(bit) + 63) // 64 * 64, np.uint8)
    padded[: len(bit)] = bit & np.uint64(1)
    return np.packbits(padded, bitorder="little").view(np.uint64)


class Slices:
    """Bitmaps of a block: slice b of attribute j has a bit for each row whose value has bit b.

    Values are shifted by the attribute's least value, so all are positive; the complement slices
    hold (largest - value) and serve negative query weights.
    """

    def __init__(self, rows: int, low: np.ndarray, bits: np.ndarray, bitmaps: np.ndarray):
        self.rows, self.words, self.dimensions = rows, (rows + 63) // 64, len(bits)
        self.low, self.bits = low, bits.tolist()
        self.all = _bitmap(np.ones(rows, np.uint64))
        bitmaps = bitmaps.reshape(-1, self.words)
        ends = np.cumsum(bits).tolist()
        self.up = [list(bitmaps[end - n : end]) for end, n in zip(ends, self.bits, strict=True)]
        self.down = [[s ^ self.all for s in own] for own in self.up]

    @staticmethod
    def packed(matrix: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """Least values, bits an attribute and all bitmaps, as the index stores them."""
        low = matrix.min(axis=0)
        shifted = (matrix - low).astype(np.uint64)
        bits = np.array([int(x).bit_length() for x in shifted.max(axis=0)], np.int64)
        up = [_bitmap(shifted[:, j] >> np.uint64(b)) for j, n in enumerate(bits.tolist()) for b in range(n)]
        return low.tobytes(), bits.tobytes(), b"".join(x.tobytes() for x in up)

    def rows_of(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The query's inner products as bit slices, lowest first, and the constant to add to them."""
        columns: dict[int, list[np.ndarray]] = {}
        constant = 0
        for j, weight in enumerate(query.tolist()):
            constant += weight * int(self.low[j])
            size, own = abs(weight), self.up[j]
            if weight < 0:
                constant -= size * ((1 << self.bits[j]) - 1)
                own = self.down[j]
            place = 0
            while size:
                if size & 1:
                    for b, bitmap in enumerate(own):
                        columns.setdefault(place + b, []).append(bitmap)
                size >>= 1
                place += 1
        out, place = [], 0
        while columns:
            column = columns.pop(place, [])
            above = columns.setdefault(place + 1, []) if len(column) > 1 else None
            while len(column) > 2:  # carry-save: three bitmaps become a sum here and a carry one place up
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                above.append((a & b) | (half & c))
                column.append(half ^ c)
            if len(column) == 2:
                a, b = column
                above.append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            place += 1
        return out, constant

    def top(self, slices: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """From the highest slice down: rows surely among the k best, and the rows tied at the border."""
        sure, tied = np.zeros(self.words, np.uint64), allowed.copy()
        if int(np.bitwise_count(allowed).sum()) <= k:
            return tied, sure
        for bitmap in reversed(slices):
            ones = tied & bitmap
            n = int(np.bitwise_count(sure | ones).sum())
            if n > k:
                tied = ones
            else:
                sure |= ones
                tied &= ~bitmap
                if n == k:
                    return sure, np.zeros(self.words, np.uint64)
        return sure, tied

    def values(self, slices: list[np.ndarray], rows: np.ndarray) -> list[int]:
        out = [0] * len(rows)
        word, shift = rows >> 6, (rows & 63).astype(np.uint64)
        for place, bitmap in enumerate(slices):
            for i, bit in enumerate(((bitmap[word] >> shift) & np.uint64(1)).tolist()):
                out[i] += bit << place
        return out


def best_in_block(block: Slices, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
    """Rows and scores of the k best rows of the block, ties to smaller ids; ``ids`` is sorted."""
    slices, constant = block.score_slices(query)
    allowed = block.all
    first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    if last > first:
        allowed = allowed.copy()
        for row in range(first, last):
            allowed[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
    sure, tied = block.top(slices, allowed, k)
    rows = block.rows_of(sure)
    # rows left at the border have equal scores, and the smallest ids come first
    rows = np.concatenate([rows, block.rows_of(tied)[: max(0, k - len(rows))]])
    scores = [x + constant for x in block.values(slices, rows)]
    if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
        raise OverflowError(f"a score of query {own} does not fit into 64 bits")
    return rows, scores


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones padded with zeros, longer ones cut at ``width``."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = column.values.to_numpy()[offsets[0] : offsets[-1]]
    width = int(sizes.max(initial=0)) if width is None else width
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out = np.zeros((len(sizes), width), np.int64)
    held = place < width
    out[owner[held], place[held]] = flat[held]
    return out


def _vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    return df.where(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), quantised(vector, scale).alias("v")
    )


def sliced_index(vectors: DataFrame, k: int, block_rows: int) -> DataFrame:
    """One stored row (INDEX) for each block of about ``block_rows`` vectors (id, v), dealt by hash.

    Rows that repeat id and vector are counted before they are shuffled, and k of them at most can be
    among a query's k best; so no repeated row fills a block.
    """
    counted = kept(vectors.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies")), "counted-vectors")
    shape = counted.agg(F.sum(F.least("copies", F.lit(k))).alias("n"), F.max(F.size("v")).alias("width")).first()
    size = min(block_rows, max(64, BLOCK_CELLS // (shape["width"] or 1)))
    blocks = max(1, -(-(shape["n"] or 0) // size))
    copies = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("copy")
    each = counted.select("id", "v", copies)
    dealt = each.select(F.pmod(F.xxhash64("id", "v", "copy"), F.lit(blocks)).cast("int").alias("block"), "id", "v")

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        ids = rows["id"].to_numpy().astype(np.int64).tobytes()
        packed = Slices.packed(_matrix(rows["v"].chunk(0)))
        return pa.table([rows["block"][:1], *[pa.array([x], pa.binary()) for x in (ids, *packed)]], names=["block", "ids", "low", "bits", "up"])

    return kept(dealt.groupBy("block").applyInArrow(build, INDEX), "sliced-index")


def _search(k: int):
    """Answers of blocks to the queries that follow them in the rows of a partition."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, block, ids = None, None, None
        for batch in batches:
            cells, starts = batch["cell"].to_numpy(), batch["up"].is_valid().to_numpy(zero_copy_only=False)
            bounds = [0, *np.flatnonzero(starts | np.concatenate([[False], cells[1:] != cells[:-1]])).tolist(), batch.num_rows]
            for first, end in zip(bounds[:-1], bounds[1:], strict=True):
                if first == end:
                    continue
                if starts[first]:
                    read = lambda name, kind: np.frombuffer(batch[name][first].as_buffer(), kind)  # noqa: B023, E731
                    cell, ids = cells[first], read("ids", np.int64).copy()
                    block = Slices(len(ids), read("low", np.int64).copy(), read("bits", np.int64), read("up", np.uint64).copy())
                    first += 1
                if first == end or cells[first] != cell:  # a block without rows answers nothing
                    continue
                part = batch.slice(first, end - first)
                found: list[tuple[int, int, int, int]] = []
                weights = _matrix(part["v"], block.dimensions)
                for own, ask, query in zip(part["id"].to_pylist(), part["ask"].to_pylist(), weights, strict=True):
                    at, scores = best_in_block(block, ids, query, own, k)
                    found += [(own, ask, int(ids[i]), s) for i, s in zip(at, scores, strict=True)]
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "ask", "vec_id", "score"])

    return search


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int = K,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    lane_rows: int = LANE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by integer inner product.

    Rows with the query's own id are no candidates; ties go to smaller ids; fewer candidates give
    fewer rows. Null ids, and vectors that are null, empty or hold null or non-finite components, take
    no part; a shorter vector counts as padded with zeros. Of repeated ids each row is a candidate, and
    equal queries are asked once. Components beyond LIMIT and scores beyond 64 bits are errors. No rows or no queries give no rows.

    The index is built once and stored, a packed row for each block of about ``block_rows`` vectors.
    Queries go to every block, as a stream that a task reads behind its block: it holds one block and
    one batch of queries, however many there are. Where blocks are fewer than the tasks that keep the
    cores busy, queries are dealt into lanes of at least ``lane_rows``, each with a copy of the blocks,
    so copies grow with the cores and not with the table. A block answers with k rows a query; a window merges them.
    """
    spark = rows.sparkSession
    index = sliced_index(_vectors(rows, key, vector, scale), k, block_rows)
    # a mark of the whole query, so that blocks of different widths answer the same one
    asked = kept(_vectors(queries, key, vector, scale).distinct().withColumn("ask", F.xxhash64("v")), "queries")
    blocks = index.agg(F.max("block")).first()[0]
    blocks = 1 if blocks is None else blocks + 1
    busy = -(-TASKS_PER_CORE * spark.sparkContext.defaultParallelism // blocks)
    lanes = max(1, min(busy, -(-asked.count() // lane_rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("block") * lanes + F.col("lane")).alias("cell")
    inside = index.withColumn("lane", every(lanes)).select(cell, "ids", "low", "bits", "up")
    lane = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(lanes)).cast("int")
    outside = asked.withColumn("lane", lane).withColumn("block", every(blocks)).select(cell, "id", "ask", "v")
    both = inside.unionByName(outside, allowMissingColumns=True).repartition(blocks * lanes, "cell")
    ordered = both.sortWithinPartitions("cell", F.col("id").asc_nulls_first())
    answers = ordered.mapInArrow(_search(k), "query_id long, ask long, vec_id long, score long")
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
