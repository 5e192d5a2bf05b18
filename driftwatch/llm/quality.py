"""Quality by nearest-neighbour voting over latent-semantic vectors of labelled documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.scratch import kept, least_keys
from driftwatch.llm.words import Chunk, chunks, mixed, words_of

TERMS = 2048
SHAPES = 16  # the first terms: shapes of words; the others: byte trigrams
DIMENSIONS = 48
SAMPLE_ROWS = 4000
NEIGHBOURS = 15
SHARPNESS = 4
THRESHOLD = 0.3
BLOCK = 512
SEED = 5

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[ord("A") : ord("Z") + 1] = _ALPHA[ord("a") : ord("z") + 1] = True
_ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True


@dataclass
class Model:
    """Projection (terms x dimensions, idf included) and the labelled vectors with their votes."""

    projection: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    prior: float


def term_counts(chunk: Chunk) -> np.ndarray:
    """(texts, TERMS) counts of hashed byte trigrams and of word shapes in the whole texts."""
    n = len(chunk)
    out = np.zeros((n, TERMS), np.float32)
    if not len(chunk.data):
        return out
    data = chunk.data.astype(np.uint32)
    owner = np.repeat(np.arange(n), np.diff(chunk.offsets))
    if len(data) > 2:
        grams = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        grams = (grams * np.uint32(0x9E3779B1)) >> np.uint32(8)
        bucket = SHAPES + grams % np.uint32(TERMS - SHAPES)
        same = owner[:-2] == owner[2:]
        out += np.bincount(owner[:-2][same] * TERMS + bucket[same], minlength=n * TERMS).reshape(n, TERMS)
    words = words_of(chunk)
    if len(words.starts):
        sums = lambda mask: np.concatenate([[0], np.cumsum(mask[chunk.data])])
        within = lambda s: s[words.ends] - s[words.starts]
        size = words.ends - words.starts
        alpha, upper, digit = (within(sums(m)) for m in (_ALPHA, _UPPER, _DIGIT))
        code = np.concatenate([[0], np.cumsum(mixed(chunk.data.astype(np.uint64)))])
        bag = code[words.ends] - code[words.starts]
        texts = words.texts()
        again = np.concatenate([[False], (bag[1:] == bag[:-1]) & (size[1:] == size[:-1]) & (texts[1:] == texts[:-1])])
        shapes = (
            (upper == alpha) & (alpha > 1),
            (upper == 1) & (alpha > 1),
            (upper == 0) & (alpha == size),
            alpha == 0,
            (alpha > 0) & (size - alpha - digit >= 2),
            (alpha > 0) & (size - alpha - digit == 1),
            digit > 0,
            size > 20,
            again,
        )
        for k, mask in enumerate(shapes):
            out[:, k] = np.bincount(texts[mask], minlength=n) * 8  # a word counts as about eight trigrams
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def weighted_terms(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares: term weight before idf, independent of length."""
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.sqrt(shares, out=shares)


def latent(counts: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return unit_rows(weighted_terms(counts) @ projection)


def votes_of(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors (exact, by blocks)."""
    score = np.full(len(vectors), model.prior)
    if not len(model.vectors):
        return score
    k = min(NEIGHBOURS, len(model.vectors))
    for i in range(0, len(vectors), BLOCK):
        block = vectors[i : i + BLOCK]
        near = block @ model.vectors.T
        top = np.argpartition(near, len(model.vectors) - k, axis=1)[:, len(model.vectors) - k :]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        share = (weight * model.votes[top]).sum(axis=1) / np.maximum(total, 1e-12)
        known = (total > 1e-12) & (np.abs(block).sum(axis=1) > 0)
        score[i : i + BLOCK] = np.where(known, np.clip(share, 0, 1), model.prior)
    return score


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """In how many documents each term occurs, and the number of documents last; over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                total[:-1] += (term_counts(chunk) > 0).sum(axis=0)
                total[-1] += len(chunk)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], ["term", "n"])

    rows = docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(TERMS + 1)
    for row in rows:
        found[row.term] = row.n
    return found


def collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts (from their compressed bytes) and votes of all rows, in an order that does not depend on theirs."""

    def read() -> tuple[np.ndarray, np.ndarray]:
        table = rows.toArrow()
        counts = np.empty((table.num_rows, TERMS), np.float32)
        for i, row in enumerate(table.column("counts")):
            counts[i] = np.frombuffer(zlib.decompress(row.as_buffer()), np.float32)
        return counts, table.column("quality").to_numpy().astype(np.float64)

    counts, votes = read()  # the table is let go before the rows are copied in order
    order = np.lexsort((votes, counts.view(f"S{counts.itemsize * TERMS}").ravel()))
    return counts[order], votes[order]


def fit(docs: DataFrame, labelled: DataFrame, text: str = "text") -> Model:
    """Learn from all rows of ``labelled`` (text, quality), a bounded sample such as ``training_rows`` gives.

    Inverse document frequencies are counted over all of ``docs``. The sample bounds what comes to the
    driver (rows x 2048 counts, compressed on the way, held twice at most) and what is broadcast (rows x 48 numbers).
    """
    frequency = document_frequencies(docs, text)
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                rows = [zlib.compress(r.tobytes(), 1) for r in term_counts(chunk)]  # most counts are 0
                label = batch.column(1).slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), label], ["counts", "quality"])

    chosen = labelled.select(F.col(text).alias("text"), F.col("quality").cast("int").alias("quality"))
    counts, votes = collected(chosen.mapInArrow(count, "counts binary, quality int"))
    if not len(votes):
        return Model(np.zeros((TERMS, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32), votes, 0.5)
    weights = weighted_terms(counts)
    del counts
    basis = principal_directions(weights * idf.astype(np.float32))
    projection = (idf[:, None] * basis).astype(np.float32)
    return Model(projection, unit_rows(weights @ projection).astype(np.float32), votes, float(votes.mean()))


def principal_directions(matrix: np.ndarray) -> np.ndarray:
    """Right singular vectors by subspace iteration from a seeded start."""
    width = DIMENSIONS + 8
    start = np.random.default_rng(SEED).standard_normal((matrix.shape[1], width)).astype(np.float32)
    for _ in range(4):
        start, _ = np.linalg.qr(matrix.T @ (matrix @ start))
    small = matrix @ start
    _, _, turn = np.linalg.svd(small, full_matrices=False)
    basis = start @ turn.T
    out = np.zeros((matrix.shape[1], DIMENSIONS), np.float32)
    out[:, : min(DIMENSIONS, basis.shape[1])] = basis[:, :DIMENSIONS]
    return out


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to every row, from the whole text alone.

    Null and empty texts, and any text when nothing is labelled, score the share of label 1 among the
    labelled rows (0.5 without any). Columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = np.full(batch.num_rows, model.prior)
            for chunk in chunks(batch.column(at)):
                found[chunk.first : chunk.first + len(chunk)] = votes_of(latent(term_counts(chunk), model.projection), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])

    out = docs.mapInArrow(score, schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, quality) of at most ``sample_rows`` labelled documents that are not held out.

    Chosen by hash of the text, equal texts of equal label once. Only hashes are joined with the labels;
    the hashes chosen, at most ``sample_rows``, are broadcast to the texts.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    keyed = docs.select("doc_id", "text", F.xxhash64("text", F.lit(SEED)).alias("key"))
    keys = kept(keyed.select("doc_id", "key").join(known, "doc_id").select("key", "quality").distinct(), "labelled")
    chosen = kept(least_keys(keys, keys.count(), sample_rows), "labelled-sample")
    return keyed.join(F.broadcast(chosen), "key").dropDuplicates(["key", "quality"]).select("text", "quality")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted and held_out, learnt from the labels that are not held out."""
    model = fit(docs, training_rows(docs, labels))
    return scored(docs, model, threshold=threshold).withColumn("held_out", held_out(F.col("doc_id")))
