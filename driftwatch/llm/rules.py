"""Quality rules: counts of the whole text, and divergence from language references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.scratch import kept
from driftwatch.llm.words import Chunk, Words, chunks, combined, prefix_sums, span_hashes, word_hashes, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
GUARD_WORDS = 50  # shorter texts have too rough a histogram to be judged by it
COMMON_SHARE = 0.001  # a word is common from this share of its language's words on: 1,000 a language at most
MOST_LANGUAGES = 20_000  # more references than this are refused: they go to every task
MOST_CLASS_DISTANCE = 0.27
MOST_WORD_DISTANCE = 0.5
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")

_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[192:] = 0  # first byte of a character beyond Latin-1's controls: counted as a letter
_CLASS[128:192] = 7  # continuation: not a character of its own
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(SYMBOLS)] = 5
_IS_SYMBOL = _CLASS == 5

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def per_text(mask_or_weight: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask_or_weight, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def earlier_equal(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every item: has its owner an earlier equal one, and any other equal one?"""
    order = np.lexsort((np.arange(len(hashes)), hashes, owner))
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again, twice = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    again[order] = same
    either = same.copy()
    either[:-1] |= same[1:]
    twice[order] = either
    return again, twice


def base_counts(chunk: Chunk, words: Words, hashes: np.ndarray, sums: np.ndarray) -> dict[str, np.ndarray]:
    n = len(chunk)
    texts = words.texts()
    heads = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    out = {
        "n_words": np.diff(words.bounds),
        "word_chars": np.bincount(texts, heads[words.ends] - heads[words.starts], minlength=n).astype(np.int64),
        "n_symbols": per_text(_IS_SYMBOL[chunk.data], chunk.offsets),
    }
    # lines: cut at every line feed and at the borders of texts
    feeds = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate([chunk.offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([feeds, chunk.offsets[1:]]))
    owner = np.sort(np.concatenate([np.arange(n), np.searchsorted(chunk.offsets, feeds, "right") - 1]))
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, owner = starts[has_word], ends[has_word], owner[has_word]
    again, _ = earlier_equal(owner, span_hashes(sums, starts, ends))
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)
    # windows of eight words that occur twice; every word that such a window covers
    runs = combined(hashes, WINDOW_WORDS)
    whole = np.flatnonzero(np.arange(len(runs)) + WINDOW_WORDS <= words.bounds[1:][texts[: len(runs)]])
    _, twice = earlier_equal(texts[whole], runs[whole])
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, whole[twice], 1)
    np.add.at(cover, whole[twice] + WINDOW_WORDS, -1)
    covered = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = np.bincount(texts[covered], minlength=n)
    return out


def class_counts(chunk: Chunk) -> np.ndarray:
    n = len(chunk)
    owner = np.repeat(np.arange(n), np.diff(chunk.offsets))
    return np.bincount(owner * 8 + _CLASS[chunk.data], minlength=n * 8).reshape(n, 8)[:, : len(CLASSES)]


def reference_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, item, n) over all documents: characters by class, words by hash.

    Each task adds up its own rows first; a map of more than a million words is passed on early.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names: dict[str, int] = {}
        classes: dict[int, np.ndarray] = {}
        size = 0

        def merged():
            lang_of, item, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((item, lang_of))
            lang_of, item, n = lang_of[order], item[order], n[order]
            fresh = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (lang_of[1:] != lang_of[:-1])]))
            return lang_of[fresh], item[fresh], np.add.reduceat(n, fresh)

        def batch_of(lang_of, kind, item, n):
            label = pa.array([*names], pa.string()).take(pa.array(lang_of.astype(np.int32)))
            return pa.RecordBatch.from_arrays(
                [label, pa.array(np.full(len(item), kind), pa.string()), pa.array(item.view(np.int64)), pa.array(n)],
                ["lang", "kind", "item", "n"],
            )

        for batch in batches:
            langs = batch.column(1).to_pylist()
            ids = np.array([names.setdefault(x or "", len(names)) for x in langs], np.int64)
            for chunk in chunks(batch.column(0)):
                own = ids[chunk.first : chunk.first + len(chunk)]
                words = words_of(chunk)
                if len(words.starts):
                    of = own[words.texts()]
                    held.append((of, word_hashes(chunk, words), np.ones(len(of), np.int64)))
                    size += len(of)
                for k, row in zip(own, class_counts(chunk), strict=True):
                    classes[k] = classes.get(k, 0) + row
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield batch_of(held[0][0], "word", held[0][1], held[0][2])
                        held, size = [], 0
        if held:
            lang_of, item, n = merged()
            yield batch_of(lang_of, "word", item, n)
        for k, row in classes.items():
            yield batch_of(np.full(len(CLASSES), k), "class", np.arange(len(CLASSES), dtype=np.uint64), row.astype(np.int64))

    counted = docs.select(text, lang).mapInArrow(count, "lang string, kind string, item long, n long")
    return counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def references(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    common_share: float = COMMON_SHARE,
    least_words: int = GUARD_WORDS,
) -> dict[str, dict[str, dict[int, float]]]:
    """Shares of character classes and of common words, for every language of at least ``least_words`` words.

    Counts cover all documents. A language brings back its common words alone, 1 / ``common_share``
    at most. More than MOST_LANGUAGES languages are an error, since no language may be left out.
    """
    counts = kept(reference_counts(docs, text, lang), "word-counts")
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    named = totals.where((F.col("kind") == "word") & (F.col("total") >= least_words)).select("lang")
    if named.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages have references")
    large = totals.join(F.broadcast(named), "lang")
    own = counts.join(F.broadcast(large), ["lang", "kind"]).where(
        (F.col("kind") == "class") | (F.col("n") >= common_share * F.col("total"))
    )
    out: dict[str, dict[str, dict[int, float]]] = {}
    for row in own.collect():
        out.setdefault(row.lang, {"class": {}, "word": {}})[row.kind][row.item] = row.n / max(row.total, 1)
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of the rows of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def distances(
    chunk: Chunk, words: Words, hashes: np.ndarray, langs: list[str], refs: dict
) -> tuple[np.ndarray, np.ndarray]:
    """Distances of every text's class and common-word histograms from its language's; 0 without a reference."""
    n = len(chunk)
    classes = class_counts(chunk)
    classes = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
    by_class, by_word = np.zeros(n), np.zeros(n)
    texts, total = words.texts(), np.maximum(np.diff(words.bounds), 1)
    for name in sorted(set(langs) & set(refs)):
        ref = refs[name]
        own = np.array([x == name for x in langs])
        q = np.array([ref["class"].get(k, 0.0) for k in range(len(CLASSES))])
        by_class[own] = divergence(classes[own], q)
        items = np.array(sorted(ref["word"]), np.int64)
        if not len(items):  # no word is common: nothing to compare
            continue
        share = np.array([ref["word"][k] for k in items])
        row = np.cumsum(own) - 1
        mine = np.flatnonzero(own[texts])
        found = hashes[mine].view(np.int64)
        slot = np.searchsorted(items, found)
        slot[slot == len(items)] = 0
        common = items[slot] == found
        rows = int(own.sum())
        seen = np.bincount(row[texts[mine[common]]] * len(items) + slot[common], minlength=rows * len(items)).reshape(rows, -1)
        p = np.column_stack([seen, total[own] - seen.sum(axis=1)]) / total[own][:, None]
        by_word[own] = divergence(p, np.append(share, max(0.0, 1 - share.sum())))
    return by_class, by_word


def judged(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    most_class_distance: float = MOST_CLASS_DISTANCE,
    most_word_distance: float = MOST_WORD_DISTANCE,
    guard_words: int = GUARD_WORDS,
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """Every row, without its text, with its counts, ``base_failed``, both distances and ``kept``.

    A document is dropped when the base rules fail, or when it has at least ``guard_words`` words and a
    histogram farther from that of its own language than allowed. A language has a reference from
    ``guard_words`` words on, however small its share; without one the base rules decide. Null and
    empty texts have no words and fail the base rules. Rows without a language are the language of no
    name. Columns named like the added ones are replaced. No rows give no rows.
    """
    added = (*BASE_COLUMNS, "class_distance", "word_distance", "base_failed", "kept")
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(references(docs, text, lang, common_share, guard_words))
    at, lang_at = docs.columns.index(text), docs.columns.index(lang)
    numbers = [F.lit(0).cast("long").alias(c) for c in BASE_COLUMNS]
    schema = docs.select("*", *numbers, F.lit(0.0).alias("class_distance"), F.lit(0.0).alias("word_distance")).schema
    out_columns = [c for c in docs.columns if c != text]
    schema = type(schema)([f for f in schema.fields if f.name != text])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            langs = [x or "" for x in batch.column(lang_at).to_pylist()]
            parts: dict[str, list[np.ndarray]] = {c: [] for c in (*BASE_COLUMNS, "class_distance", "word_distance")}
            for chunk in chunks(batch.column(at)):
                words = words_of(chunk)
                sums = prefix_sums(chunk.data)
                hashes = span_hashes(sums, words.starts, words.ends)
                found = base_counts(chunk, words, hashes, sums)
                found["class_distance"], found["word_distance"] = distances(
                    chunk, words, hashes, langs[chunk.first : chunk.first + len(chunk)], shared.value
                )
                for k, v in found.items():
                    parts[k].append(v)
            joined = [np.concatenate(v) if v else np.zeros(0) for v in parts.values()]
            kinds = [pa.int64()] * len(BASE_COLUMNS) + [pa.float64()] * 2
            arrays = [pa.array(v, k) for v, k in zip((x.astype(np.int64) if k == pa.int64() else x for x, k in zip(joined, kinds, strict=True)), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*rest, *arrays], [*out_columns, *parts])

    measured = docs.mapInArrow(measure, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    far = (F.col("class_distance") > most_class_distance) | (F.col("word_distance") > most_word_distance)
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & ~((F.col("n_words") >= guard_words) & far)
    )
