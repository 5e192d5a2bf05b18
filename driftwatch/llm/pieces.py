"""SentencePiece encoding and decoding by a suffix array over each batch.

The distinct segments of a batch are laid side by side and their suffixes sorted. Every vocabulary piece
is found by binary search as a range of the array; the occurrences, as edges from start to end, are
sorted by position. Relaxing them gives the tokens: a unigram model takes the path of the best total
score; a BPE model, whose result is not a best path, repeatedly contracts the edge of the best score
between neighbouring symbols, leftmost first.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNIGRAM, BPE = 1, 2
SLICE_BYTES = 1 << 20  # of texts encoded together, one at least
LEARN_CHARS = 1 << 16  # of new segments encoded together, one at least; about 200 bytes of work space a character
CACHE_SEGMENTS = 150_000  # in each of two generations
LONG = 128  # characters from which a segment is contracted with a heap instead of in rounds
OTHER = 0xFFFF
NONE = -1e30


@dataclass
class Model:
    """A vocabulary as plain arrays; its size does not depend on the data."""

    kind: int
    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray  # pieces that texts can hold, not control, unknown or byte pieces
    byte_ids: list[int]  # by byte; empty without byte fallback
    unknown: int
    dummy_prefix: bool


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's top fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


def read_model(path: str) -> Model:
    """Load a model file. Models that rewrite texts first, or have user-defined pieces, are refused."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    parts = {}
    for number, value in fields(processor.serialized_model_proto()):
        if number in (2, 3):
            parts[number] = dict(fields(value))
    trainer, normalizer = parts.get(2, {}), parts.get(3, {})
    # Field numbers of the model format, and what holds when a field is absent.
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("the model rewrites texts before it encodes them; only identity models are supported")
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("neither a unigram nor a BPE model")
    n = processor.get_piece_size()
    special = lambda i: processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i)
    bytes_ = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(processor.is_byte(i) for i in range(n)) else []
    return Model(
        kind,
        [processor.id_to_piece(i) for i in range(n)],
        np.array([processor.get_score(i) for i in range(n)]),
        np.array([not special(i) for i in range(n)]),
        bytes_,
        processor.unk_id(),
        bool(normalizer.get(3, 1)),
    )


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        ids = np.flatnonzero(model.normal)
        found = [model.pieces[i] for i in ids]
        alphabet = sorted({c for p in found for c in p})
        if len(alphabet) >= OTHER:
            raise ValueError("the vocabulary has too many different characters")
        self.code = np.full(0x110000, OTHER, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.most = max((len(p) for p in found), default=1)
        self.quads = -(-self.most // 4)
        self.ids = ids
        self.lengths = np.array([len(p) for p in found], np.int64)
        table = np.zeros((len(found), 4 * self.quads), np.uint64)
        for i, p in enumerate(found):
            table[i, : len(p)] = [self.code[ord(c)] for c in p]
        filled = np.where(np.arange(4 * self.quads) < self.lengths[:, None], table, OTHER)
        self.low, self.high = ([self.quad(t[:, 4 * k : 4 * k + 4]) for k in range(self.quads)] for t in (table, filled))
        # a word can be encoded alone if no piece goes on beyond it into the next one's space
        self.split = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in found)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        shown = [p.replace(SPACE, " ").encode() if ok else b"" for p, ok in zip(model.pieces, model.normal, strict=True)]
        for byte, i in enumerate(model.byte_ids):
            shown[i] = bytes([byte])
        shown[model.unknown] = " ⁇ ".encode()
        self.shown = shown

    @staticmethod
    def quad(codes: np.ndarray) -> np.ndarray:
        c = codes.astype(np.uint64)
        return (c[:, 0] << np.uint64(48)) | (c[:, 1] << np.uint64(32)) | (c[:, 2] << np.uint64(16)) | c[:, 3]

    def segments(self, text: str) -> list[str]:
        """Parts that no piece crosses. A visible space counts as a space, which takes half the memory."""
        if not text:
            return []
        whole = (" " if self.model.dummy_prefix else "") + text.replace(SPACE, " ")
        return re.findall(" +[^ ]*|[^ ]+", whole) if self.split else [whole]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every occurrence of a piece, sorted by start and length."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(4 * self.quads + 4, np.uint16)])
        quads = self.quad(np.lib.stride_tricks.sliding_window_view(padded, 4)[: n + 4 * self.quads])
        rank = self.ranks(quads[:n])
        width = 4
        while width < self.most:
            later = np.zeros(n, np.int64)
            later[: max(0, n - width)] = rank[width:] + 1
            rank = self.ranks(rank * np.int64(n + 1) + later)
            width *= 2
        suffixes = np.argsort(rank)
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
        for k in range(self.quads):
            some = np.flatnonzero((self.lengths > 4 * k) & (low < high))
            keys = quads[suffixes + 4 * k]
            if k == 0:  # every range is still the whole array
                low[some], high[some] = np.searchsorted(keys, self.low[0][some]), np.searchsorted(keys, self.high[0][some], "right")
                continue
            lo, hi = low[some], high[some]
            low[some] = self.bisect(keys, lo, hi, self.low[k][some], False)
            high[some] = self.bisect(keys, lo, hi, self.high[k][some], True)
        counts = np.maximum(high - low, 0)
        ends = np.cumsum(counts)
        flat = np.repeat(low - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        start, piece = suffixes[flat], np.repeat(np.arange(len(self.ids)), counts)
        length = self.lengths[piece]
        order = np.argsort(start * np.int64(64) + length)
        return start[order], length[order], piece[order]

    @staticmethod
    def ranks(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        fresh = np.ones(len(keys), np.int64)
        fresh[1:] = keys[order][1:] != keys[order][:-1]
        out = np.empty(len(keys), np.int64)
        out[order] = np.cumsum(fresh) - 1
        return out

    @staticmethod
    def bisect(keys: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of every target within its own range of ``keys``."""
        low, high = low.copy(), high.copy()
        while (some := np.flatnonzero(low < high)).size:
            middle = (low[some] + high[some]) // 2
            go = keys[middle] <= target[some] if right else keys[middle] < target[some]
            low[some] = np.where(go, middle + 1, low[some])
            high[some] = np.where(go, high[some], middle)
        return low

    def learn(self, segments: list[str]) -> None:
        """Encode new segments together and remember their ids."""
        text = "\0".join(segments).replace(" ", SPACE) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(s) for s in segments], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        codes = self.code[points]
        codes[starts + sizes] = 0
        start, length, piece = self.edges(codes)
        keys = start * np.int64(64) + length
        if self.model.kind == BPE:
            begin, size, owner = self.contracted(keys, piece, starts, sizes)
        else:
            begin, size, owner = self.best_paths(start, length, piece, starts, sizes)
        at = np.searchsorted(keys, begin * 64 + size)
        at[at == len(keys)] = 0
        known = keys[at] == begin * 64 + size if len(keys) else np.zeros(len(begin), bool)
        ids = np.where(known, self.ids[piece[at]] if len(keys) else 0, -1)
        bounds = np.searchsorted(owner, np.arange(len(segments) + 1))
        raw = ids.astype("<i4").tobytes()
        unknown = np.add.reduceat(np.append(~known, False).astype(np.int64), bounds[:-1]) if len(ids) else np.zeros(len(segments))
        unknown[np.diff(bounds) == 0] = 0
        bounds = bounds.tolist()
        for s, odd, a, b in zip(segments, unknown.tolist(), bounds[:-1], bounds[1:], strict=True):
            if odd:
                out: list[int] = []
                for j in range(a, b):
                    if known[j]:
                        out.append(int(ids[j]))
                    elif self.model.byte_ids:
                        chars = text[begin[j] : begin[j] + size[j]]
                        out += [self.model.byte_ids[x] for x in chars.encode("utf-8", "replace")]
                    elif not out or out[-1] != self.model.unknown:
                        out.append(self.model.unknown)
                self.cache[s] = np.array(out, "<i4").tobytes()
            else:
                self.cache[s] = raw[4 * a : 4 * b]

    def contracted(self, keys, piece, starts, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols (start, size, segment) left when no two neighbours form a piece."""
        score = self.model.scores[self.ids]

        def worth(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(begin), NONE)
            wanted = begin * 64 + np.minimum(size, 63)
            at = np.searchsorted(keys, wanted)
            at[at == len(keys)] = 0
            return np.where((keys[at] == wanted) & (size <= self.most), score[piece[at]], NONE)

        done = []
        short = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        owner = np.repeat(short, sizes[short])
        ends = np.cumsum(sizes[short])
        begin = np.repeat(starts[short] - ends + sizes[short], sizes[short]) + np.arange(ends[-1] if len(ends) else 0)
        size = np.ones(len(begin), np.int64)
        while len(begin):
            value = np.full(len(begin), NONE)
            same = np.flatnonzero(owner[1:] == owner[:-1])
            value[same] = worth(begin[same], size[same] + size[same + 1])
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            width = np.diff(np.append(first, len(owner)))
            best = np.maximum.reduceat(value, first)
            live = best > NONE
            over = np.repeat(~live, width)
            done.append((begin[over], size[over], owner[over]))
            hit = np.flatnonzero(value == np.repeat(best, width))
            hit = hit[~over[hit]]
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])] if len(hit) else hit  # leftmost
            size[hit] += size[hit + 1]
            stay = ~over
            stay[hit + 1] = False
            begin, size, owner = begin[stay], size[stay], owner[stay]
        for i in np.flatnonzero(sizes > LONG):
            b, s = self.contracted_long(worth, int(starts[i]), int(sizes[i]))
            done.append((b, s, np.full(len(b), i)))
        begin, size, owner = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(begin, kind="stable")
        return begin[order], size[order], owner[order]

    def contracted_long(self, worth, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long segment, with a heap of neighbouring pairs."""
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        first = worth(start + np.arange(n - 1), np.full(n - 1, 2))
        heap = [(-float(v), i, 1, 1) for i, v in enumerate(first) if v > NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                v = worth(np.array([start + i]), np.array([size[i] + size[j]]))[0]
                if v > NONE:
                    heapq.heappush(heap, (-float(v), i, size[i], size[j]))

        while heap:
            _, i, own, other = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if size[i] != own or j >= n or size[j] != other:
                continue
            size[i] += size[j]
            size[j] = 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        kept = [i for i in range(n) if size[i]]
        return start + np.array(kept, np.int64), np.array([size[i] for i in kept], np.int64)

    def best_paths(self, start, length, piece, starts, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols on the path of the best total score through each segment (unknown characters cost most)."""
        score = self.model.scores[self.ids]
        penalty = float(score.min(initial=0.0)) - 10
        begins, widths, owners = [], [], []
        at = np.searchsorted(start, starts)
        for i, (first, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            best, back = [0.0] + [NONE] * n, [0] * (n + 1)
            e = at[i]
            for p in range(n):
                single = False
                while e < len(start) and start[e] == first + p:
                    value, end = best[p] + score[piece[e]], p + int(length[e])
                    single |= length[e] == 1
                    if value > best[end]:
                        best[end], back[end] = value, p
                    e += 1
                if not single and best[p] + penalty > best[p + 1]:
                    best[p + 1], back[p + 1] = best[p] + penalty, p
            p, cut = n, []
            while p:
                cut.append((back[p], p - back[p]))
                p = back[p]
            for b, w in reversed(cut):
                begins.append(first + b)
                widths.append(w)
                owners.append(i)
        return np.array(begins, np.int64), np.array(widths, np.int64), np.array(owners, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = [self.segments(t) for t in texts]
        wanted = set()
        for p in parts:
            wanted.update(p)
        if len(self.cache) > CACHE_SEGMENTS:
            self.cache, self.old = {}, self.cache
        new = []
        for s in wanted.difference(self.cache):
            ids = self.old.get(s)
            if ids is None:
                new.append(s)
            else:  # still in use: it lives on in the young generation
                self.cache[s] = ids
        for first, last in _cuts(np.array([len(s) for s in new], np.int64), LEARN_CHARS):
            self.learn(new[first:last])
        look = self.cache.__getitem__
        return [b"".join(map(look, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_HELD: list[Encoder] = []


def held_encoder(model: Model) -> Encoder:
    """The encoder of a broadcast model, held with its cached segments for the next tasks of this Python worker."""
    if not _HELD or _HELD[0].model is not model:
        _HELD[:] = [Encoder(model)]
    return _HELD[0]


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) of successive stretches that add up to ``most`` at most, or hold one item."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + most, "right")))
        yield first, last
        first = last


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in parts with about SLICE_BYTES of text in column ``at``, and their texts, null as empty."""
    for first, last in _cuts(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(), SLICE_BYTES):
        rows = batch.slice(first, last - first)
        yield rows, [t or "" for t in rows.column(at).to_pylist()]


def encoded(docs: DataFrame, model: Model, text: str = "text", name: str = "ids") -> DataFrame:
    """Add the token ids of every whole text as an array; a column of that name is replaced.

    Null and empty texts have no tokens. No rows give no rows.
    """
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = docs.select("*", F.array().cast("array<int>").alias(name)).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(shared.value)
        for batch in batches:
            for rows, texts in _slices(batch, at):
                raw = encoder.encode(texts)
                ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([*rows.columns, ids], [*batch.schema.names, name])

    return docs.mapInArrow(encode, schema)


def decoded(tokens: DataFrame, model: Model, ids: str = "ids", name: str = "text") -> DataFrame:
    """Add the text of every array of ids; null gives an empty text. A column of that name is replaced."""
    tokens = tokens.drop(name)
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    at = tokens.columns.index(ids)
    schema = tokens.select("*", F.lit("").alias(name)).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(shared.value)
        for batch in batches:
            column = batch.column(at)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype("<i4")
            texts = [encoder.decode(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return tokens.mapInArrow(decode, schema)


def round_trips(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, round_trip) of every row: encoded, decoded again and compared.

    Ids are digested as little-endian 32-bit numbers. Null counts as empty: no tokens, round trip true.
    The visible space U+2581 in a text decodes to a space, so such a text does not come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = source.select(key, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit(True).alias("round_trip")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(shared.value)
        for batch in batches:
            for rows, texts in _slices(batch, 1):
                raw = encoder.encode(texts)
                columns = [
                    rows.column(0),
                    pa.array([len(r) // 4 for r in raw], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                    pa.array([encoder.decode(r) == t for r, t in zip(raw, texts, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)
