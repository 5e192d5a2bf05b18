"""Periodic runs of words, found on a grammar of the text.

A run is a maximal stretch of words that repeats with some smallest period. Only words inside windows
that occur twice in their text can lie in one; the stretches of such words are compressed by Re-Pair:
frequent pairs of neighbouring symbols become nonterminals, until each stretch is one symbol. Every
run crosses the boundary between the two halves of exactly one symbol of the derivation, the lowest
that holds it; so the runs across each nonterminal's boundary are computed once, translated to all its
positions, and those that go on beyond it there are left to the symbols above.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.words import Chunk, Words, chunks, combined, mixed, word_hashes, words_of

LEAST_WORDS = 12
CHUNK_BYTES = 4 << 20
PAIRS_AT_ONCE = 4 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), then first[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def stretches(hashes: np.ndarray, words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the stretches of words that can hold a run.

    Half of the words of a run of ``least`` repeat one period on, so each of its words lies in a window
    of half that size that occurs again in the text. Other words part the stretches.
    """
    size = (least + 1) // 2
    texts = words.texts()
    windows = combined(hashes, size)
    whole = np.flatnonzero(np.arange(len(windows)) + size <= words.bounds[1:][texts[: len(windows)]])
    keys = mixed(windows[whole] ^ mixed(texts[whole].astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    none = np.zeros(0, np.int64)
    if not len(twice):
        return none, none
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    hit = np.zeros(len(hashes) + 1, np.int64)
    hit[whole[twice[at] == keys]] = 1
    sums = np.concatenate([np.zeros(size, np.int64), np.cumsum(hit)])
    inside = sums[size : size + len(hashes)] > sums[: len(hashes)]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = texts[1:] != texts[:-1]
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & (fresh | ~before))
    after = np.concatenate([inside[1:], [False]])
    last = np.flatnonzero(inside & (np.concatenate([fresh[1:], [True]]) | ~after)) + 1
    long = last - first >= least
    return first[long], last[long]


@dataclass
class Grammar:
    """Nonterminals of two symbols: words in the left half, in all, and every position in the text."""

    left: np.ndarray
    length: np.ndarray
    bounds: np.ndarray  # the positions of nonterminal i are at[bounds[i]:bounds[i + 1]]
    at: np.ndarray


def repaired(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Grammar:
    """Re-Pair over all stretches together, in rounds.

    A round replaces the pairs of more than half the highest count, each where it ranks above the
    pairs it overlaps; in a row of one symbol, every other pair. When no pair repeats, neighbours are
    joined two by two, so that what is left has logarithmic height.
    """
    symbol, place = ids.astype(np.int64), np.arange(len(ids))
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    length = np.ones(int(ids.max(initial=-1)) + 1, np.int64)
    lefts, lengths, counts, positions = [], [], [], []
    repeating = True
    while len(symbol) > len(starts):
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        key = symbol[pair] * len(length) + symbol[pair + 1]
        if repeating:
            found, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            repeating = count.max() >= 2
        if repeating:
            # pairs by count; those of equal count in a scrambled order, so that they do not line up
            order = np.lexsort((mixed(found.astype(np.uint64) + np.uint64(1)), count))
            rank = np.empty(len(found), np.int64)
            rank[order] = np.arange(1, len(found) + 1)
            rank[2 * count <= count.max()] = 0
            rank[count < 2] = 0
            ranks = np.zeros(len(symbol) + 1, np.int64)  # by the pair's first symbol, with an edge behind
            ranks[pair] = rank[inverse]
            row = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))  # rows of equal pairs
            high = ranks[row]
            before, after = np.concatenate([[0], high[:-1]]), np.concatenate([high[1:], [0]])
            width = np.diff(np.append(row, len(ranks)))
            wins = (high > before) & (high > after)
            width = (width[wins] + 1) // 2
            hit = spans(np.zeros(len(width), np.int64), width) * 2 + np.repeat(row[wins], width)
        else:
            own_first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            turn = np.arange(len(symbol)) - np.repeat(own_first, np.diff(np.append(own_first, len(symbol))))
            hit = pair[turn[pair] % 2 == 0]
        made, which = np.unique(symbol[hit] * len(length) + symbol[hit + 1], return_inverse=True)
        a, b = made // len(length), made % len(length)
        lefts.append(length[a])
        lengths.append(length[a] + length[b])
        counts.append(np.bincount(which, minlength=len(made)))
        positions.append(place[hit][np.argsort(which, kind="stable")])
        symbol[hit] = len(length) + which
        stay = np.ones(len(symbol), bool)
        stay[hit + 1] = False
        symbol, place, owner = symbol[stay], place[stay], owner[stay]
        length = np.concatenate([length, lengths[-1]])
    joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    return Grammar(joined(lefts), joined(lengths), np.concatenate([[0], np.cumsum(joined(counts))]), joined(positions))


class Extensions:
    """How far two positions agree, by names of all substrings whose length is a power of two.

    ``names[k][i]`` is equal for equal substrings of 2**k words from i on; nothing is decided by hashes.
    """

    def __init__(self, ids: np.ndarray, most: int):
        self.names = [ids.astype(np.int32)]
        width = 1
        while 2 * width <= most and 2 * width <= len(ids):
            own = self.names[-1].astype(np.int64)
            key = own[: len(own) - width] * (int(own.max()) + 1) + own[width:]
            self.names.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
            width *= 2

    def forward(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest n with words i .. i+n equal to words j .. j+n and j+n <= end."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            fits = np.flatnonzero(j + n + (1 << k) <= end)
            same = self.names[k][i[fits] + n[fits]] == self.names[k][j[fits] + n[fits]]
            n[fits[same]] += 1 << k
        return n

    def backward(self, i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The longest n with words i-n .. i equal to words j-n .. j and i-n >= start."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            fits = np.flatnonzero(i - n - (1 << k) >= start)
            same = self.names[k][i[fits] - n[fits] - (1 << k)] == self.names[k][j[fits] - n[fits] - (1 << k)]
            n[fits[same]] += 1 << k
        return n


def crossing(ids: np.ndarray, grammar: Grammar, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nonterminal, start, end, period) of the repetitions across each nonterminal's boundary.

    Starts and ends count from the nonterminal's first word. For each period the word on one side is
    compared with its partner on the other first; what agrees is extended both ways. A repetition of
    at least two periods holds a whole one beside the boundary, on its right or on its left.
    """
    nodes = np.flatnonzero(grammar.length >= least)
    empty = np.zeros(0, np.int64)
    if not len(nodes):
        return empty, empty, empty, empty
    reach = Extensions(ids, int(grammar.length[nodes].max()))
    found = []
    weights = np.cumsum(grammar.length[nodes])
    cuts = np.searchsorted(weights, np.arange(PAIRS_AT_ONCE, weights[-1] + PAIRS_AT_ONCE, PAIRS_AT_ONCE)) + 1
    for part in np.split(nodes, cuts[cuts < len(nodes)]):
        start, length, left = grammar.at[grammar.bounds[part]], grammar.length[part], grammar.left[part]
        for on_right in (True, False):
            most = np.minimum(length - left if on_right else left, length // 2)
            node = np.repeat(np.arange(len(part)), most)
            period = spans(np.ones(len(part), np.int64), most)
            middle = (start + left)[node]
            other = middle - 1 + period if on_right else middle - period
            same = np.flatnonzero(ids[middle - 1 if on_right else middle] == ids[other])
            node, period, middle = node[same], period[same], middle[same]
            low = middle if on_right else middle - period
            ahead = reach.forward(low, low + period, (start + length)[node])
            behind = reach.backward(low, low + period, start[node])
            begin, stop = low - behind, low + period + ahead
            fits = (ahead + behind >= period) & (stop - begin >= least)
            found.append((part[node[fits]], (begin - start[node])[fits], (stop - start[node])[fits], period[fits]))
    node, begin, stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, stop, begin, node))  # multiples of a period give the same stretch: the least stays
    node, begin, stop, period = node[order], begin[order], stop[order], period[order]
    fresh = np.ones(len(node), bool)
    fresh[1:] = (node[1:] != node[:-1]) | (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1])
    return node[fresh], begin[fresh], stop[fresh], period[fresh]


def maximal_runs(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in the stretches of a sequence, by start and period."""
    grammar = repaired(ids, starts, ends)
    node, begin, stop, period = crossing(ids, grammar, least)
    times = np.diff(grammar.bounds)[node]
    at = grammar.at[spans(grammar.bounds[node], times)]
    begin, stop, period = np.repeat(begin, times) + at, np.repeat(stop, times) + at, np.repeat(period, times)
    own = np.searchsorted(starts, begin, "right") - 1
    first, last = starts[own], ends[own]
    outer = begin == first
    outer[~outer] = ids[begin[~outer] - 1] != ids[begin[~outer] - 1 + period[~outer]]
    close = stop == last
    close[~close] = ids[stop[~close]] != ids[stop[~close] - period[~close]]
    whole = outer & close
    begin, stop, period = begin[whole], stop[whole], period[whole]
    order = np.lexsort((stop, period, begin))
    begin, stop, period = begin[order], stop[order], period[order]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] != begin[:-1]) | (period[1:] != period[:-1])
    return begin[fresh], stop[fresh], period[fresh]


def runs_of(chunk: Chunk, words: Words, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of all texts of a chunk, by text, start and period."""
    first, last = stretches(word_hashes(chunk, words), words, least)
    empty = np.zeros(0, np.int64)
    if not len(first):
        return empty, empty, empty, empty
    position = spans(first, last - first)
    raw = chunk.data.tobytes()
    known: dict[bytes, int] = {}
    edges = zip(words.starts[position].tolist(), words.ends[position].tolist(), strict=True)
    ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in edges], np.int64)
    ends = np.cumsum(last - first)
    begin, stop, period = maximal_runs(ids, ends - (last - first), ends, least)
    text = np.searchsorted(words.bounds, position[begin], "right") - 1
    return text, position[begin] - words.bounds[text], stop - begin, period


def without_repeats(raw: bytes, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words of a text that lie in no run beyond its first period, joined by spaces."""
    parts = raw.split()
    if not len(start):
        return b" ".join(parts)
    cover = np.zeros(len(parts) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    return b" ".join(compress(parts, (np.cumsum(cover)[:-1] == 0).tolist()))


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Every row without its text, with ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` holds (start, length, period) in words from 0, by start and period: stretches of at least
    ``least`` words and two periods, repeating with their smallest period, that no neighbouring word
    extends. ``collapsed`` is the text's words without those that a run holds after its first period,
    joined by one space. Words are separated by ASCII white space and compared byte by byte.

    Null and empty texts have no words, no runs and an empty ``collapsed``; rows repeat as they come;
    columns of the added names are replaced, others pass. No rows give no rows. A text is worked on
    whole, in memory of some tens of bytes a byte of it, more for words in long repetitions.
    """
    added = ("n_words", "runs", "collapsed")
    docs = docs.drop(*[c for c in added if c != text])
    at = docs.columns.index(text)
    names = [c for c in docs.columns if c != text]
    quoted = [f"`{c}`" for c in names]
    schema = docs.selectExpr(*quoted, "0L AS n_words", f"cast(array() AS {RUNS}) AS runs", "'' AS collapsed").schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            for chunk in chunks(batch.column(at), CHUNK_BYTES):
                words = words_of(chunk)
                owner, *found = runs_of(chunk, words, least)
                bounds = np.searchsorted(owner, np.arange(len(chunk) + 1))
                raw, offsets = chunk.data.tobytes(), chunk.offsets.tolist()
                cut = [
                    without_repeats(raw[offsets[i] : offsets[i + 1]], *(x[bounds[i] : bounds[i + 1]] for x in found))
                    for i in range(len(chunk))
                ]
                struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["start", "length", "period"])
                columns = [
                    *(c.slice(chunk.first, len(chunk)) for c in rest),
                    pa.array(np.diff(words.bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct),
                    pa.array(cut, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return docs.mapInArrow(scan, schema)


def longest(runs: str = "runs"):
    """The run of greatest length, then smallest start, then smallest period; null without runs."""
    ordered = F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(ordered, F.lit(0))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))
