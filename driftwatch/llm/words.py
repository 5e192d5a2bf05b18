"""Vectorised work on the UTF-8 bytes of many texts: words, hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RANDOM = np.random.default_rng(20_240_611)
BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Chunk:
    """Some whole texts: their bytes one after another, and where each begins (with the end)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column into runs of whole texts of about ``limit`` bytes (one text at least)."""
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        base = offsets[first]
        yield Chunk(first, data[base : offsets[last]], offsets[first : last + 1] - base)
        first = last


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # the words of text i are bounds[i] .. bounds[i + 1]

    def texts(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words_of(chunk: Chunk) -> Words:
    """Runs of bytes that are not space, tab, line feed, vertical tab, form feed or return."""
    inside = ~IS_SPACE[chunk.data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[chunk.offsets] = True
    before = np.concatenate([[False], inside])
    starts = np.flatnonzero(inside & (~before[:n] | edge[:n]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Rolling hash sums: the hash of bytes s..e is (sums[e] - sums[s]) * BASE**-s."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts])


def word_hashes(chunk: Chunk, words: Words, lower: bool = False) -> np.ndarray:
    data = LOWER[chunk.data] if lower else chunk.data
    return span_hashes(prefix_sums(data), words.starts, words.ends)


def combined(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbouring words (runs over text borders included)."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, (size * int(PLACE[-1])) % 2**64, np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * PLACE[j % 48] + np.uint64(j // 48)
    return mixed(out)


def shingle_sets(chunk: Chunk, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and their bounds.

    A text of fewer words has its whole word sequence as the one shingle; one without words has none.
    """
    words = words_of(chunk)
    hashes = word_hashes(chunk, words, lower)
    counts = np.diff(words.bounds)
    runs = combined(hashes, size)
    texts = words.texts()
    where = np.arange(len(runs))
    whole = where + size <= words.bounds[1:][texts[: len(runs)]]
    found, owner = runs[whole], texts[: len(runs)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = [combined(hashes[words.bounds[i] : words.bounds[i + 1]], int(counts[i]))[0] for i in short]
        found = np.concatenate([found, np.array(extra, np.uint64)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        fresh = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])
        found, owner = found[fresh], owner[fresh]
    return found, np.searchsorted(owner, np.arange(len(chunk) + 1))
