"""Packing documents into token windows by best-fit decreasing.

Documents longer than a window are first cut into full windows. What is left of each is placed, longest
first, into the open window with the least room that still holds it; a segment tree over remaining
capacities finds that window. Few windows stay with much room: these are opened again, and their pieces
laid end to end and cut anew.

Documents are packed in groups of a bounded number of tokens, each inside one task, so no shuffle is
needed and memory does not grow with the input or with the share of one source.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END = 1
ROOM = 32  # windows with more room than this are opened again, unless their length is a power of two
GROUP_TOKENS = 4 << 20  # tokens packed together: about 2,000 windows
SLICE_BYTES = 4 << 20
CACHE_WORDS = 400_000
CACHED_BYTES = 64  # longer words are encoded each time
SEQUENCE_BITS = 40  # sequences a task may number
WORD = re.compile("[^ \\t-\\r]+")
OTHER = re.compile("[^ \\t-\\r!-~\u00c0-\u00ff]")  # beyond the characters that lower case and composition leave one each

_SCHEMA = pa.schema(
    [
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


class Held(dict):
    """Values by key, made when first asked for, in two generations.

    When the young generation is full it becomes the old one; keys still in use move back.
    """

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_BYTES:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """The ids of texts as bytes (little-endian 32-bit), by a tokenizer file.

    A tokenizer that rewrites white space to spaces, lowers case and drops the spaces gives a text the
    ids of its words in turn. Text of ASCII and Latin-1 letters is lowered and split here by the file's
    own pattern, and the parts, which are held, go to the file's merges; words with other characters go
    through the whole tokenizer, and so do whole texts if the file works in another way.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["normalizer"] or {}).get("normalizers") or []
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers") or []
        self.by_words = (
            [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
            and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
            and (cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == (False, False)
            and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
        )
        if self.by_words:
            # of the characters met here, these are all letters and all digits
            pattern = cuts[0]["pattern"]["Regex"].replace(r"\p{L}", "a-z\u00df-\u00f6\u00f8-\u00ff").replace(r"\p{N}", "0-9")
            self.split = re.compile(pattern).findall
            shown = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.bytes_shown = {c: "".join(x for x, _ in shown(chr(c))) for c in range(0xC0, 0x100)}
            self.special = [x["content"] for x in spec["added_tokens"]]
            self.parts, self.others = Held(self._part, most), Held(self._whole, most // 8)

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.translate(self.bytes_shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return self._whole(text)
        special = any(x in text for x in self.special)
        if not special and not OTHER.search(text):
            return b"".join(map(self.parts.__getitem__, self.split(text.lower())))
        out: list[bytes] = []
        for word in WORD.findall(text):
            if OTHER.search(word) or special and any(x in word for x in self.special):
                out.append(self.others[word])
            else:
                out += map(self.parts.__getitem__, self.split(word.lower()))
        return b"".join(out)


_HELD: list[WordIds] = []


def held_words(path: str) -> WordIds:
    """The word table of this Python worker, held for its next tasks."""
    if not _HELD or _HELD[0].path != path:
        _HELD[:] = [WordIds(path)]
    return _HELD[0]


class OpenWindows:
    """Open windows by remaining capacity: node i of the tree counts the windows below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, name: int) -> None:
        self.stacks[room].append(name)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take the window of least room >= need out of the tree: (room, name)."""
        count, node = self.count, need + self.leaves
        while not count[node]:
            while node & 1:  # a right child: what follows it begins above
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.stacks[room].pop()


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Indices of the lengths (1 to window each) in each window, longest first, ties by index."""
    tree, windows = OpenWindows(window), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.tightest(lengths[i])
        room, name = found or (window, len(windows))
        if not found:
            windows.append([])
        windows[name].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], name)
    return windows


def laid_out(sizes: list[int], window: int = WINDOW, room: int = ROOM) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token of documents of these sizes."""
    done, rest = [], []
    for doc, size in enumerate(sizes):
        full = size // window * window
        done += [[(doc, at, window)] for at in range(0, full, window)]
        if size > full:
            rest.append((doc, full, size - full))
    loose = []
    for own in best_fit([p[2] for p in rest], window):
        pieces = [rest[i] for i in own]
        length = sum(p[2] for p in pieces)
        if window - length <= room or length & (length - 1) == 0:
            done.append(pieces)
        else:
            loose += pieces
    left = sum(p[2] for p in loose)
    wanted = [window] * (left // window)  # then one sequence for each binary digit of what is left
    left %= window
    wanted += [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
    at = 0
    for size in wanted:
        pieces = []
        while size:
            doc, start, length = loose[at]
            cut = min(size, length)
            pieces.append((doc, start, cut))
            size -= cut
            if cut < length:
                loose[at] = (doc, start + cut, length - cut)
            else:
                at += 1
        done.append(pieces)
    return done


def packed(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end: int = END,
    room: int = ROOM,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row a piece of a document.

    A document's tokens are the ids of its text and then ``end``; every token lies in one piece. ``ids``
    holds a piece's tokens as little-endian 32-bit numbers. Pieces of a sequence lie side by side from
    offset 0 and fill at most ``window``; a sequence has at most ``room`` places left, or a power of two
    of tokens. ``tokenizer`` names a tokenizer file, at the same place on every executor.

    Null and empty texts are one token, ``end``. Null keys stay null and repeated rows are documents of
    their own. Other columns are left out, whatever their names. No rows give no rows. Texts are never
    cut before encoding: a task holds ``group_tokens`` tokens or one document. Sequences are numbered by
    task, so a table gets the same ones as long as it is read in the same parts.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = rows.select("id").selectExpr(
        "id",
        "0L AS start",
        "0L AS length",
        "cast('' AS binary) AS ids",
        "0L AS doc_tokens",
        "0L AS sequence_id",
        "0L AS offset",
    ).schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held_words(tokenizer)
        closing = np.array([end], "<u4").tobytes()
        number = TaskContext.get().partitionId() << SEQUENCE_BITS
        keys: list[pa.Array] = []
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, keys, held, size
            sequences = laid_out([len(x) // 4 for x in held], window, room)
            names = pa.concat_arrays(keys)
            part: list[tuple[int, int, int, bytes, int, int, int]] = []
            weight = 0
            for pieces in sequences:
                offset = 0
                for doc, start, length in pieces:
                    ids = held[doc][4 * start : 4 * (start + length)]
                    part.append((doc, start, length, ids, len(held[doc]) // 4, number, offset))
                    offset += length
                    weight += len(ids)
                number += 1
                if weight > SLICE_BYTES:
                    yield batch_of(names, part)
                    part, weight = [], 0
            if part:
                yield batch_of(names, part)
            keys, held, size = [], [], 0

        def batch_of(names: pa.Array, part: list[tuple]) -> pa.RecordBatch:
            own, *rest = zip(*part, strict=True)
            columns = [pa.array(x, f.type) for x, f in zip(rest, _SCHEMA, strict=True)]
            return pa.RecordBatch.from_arrays([names.take(pa.array(own, pa.int64())), *columns], ["id", *_SCHEMA.names])

        for batch in batches:
            names, texts, first = batch.column(0), batch.column(1), 0
            for i in range(len(texts)):
                held.append(words.encode(texts[i].as_py() or "") + closing)
                size += len(held[-1]) // 4
                if size >= group_tokens:
                    keys.append(names.slice(first, i + 1 - first))
                    first = i + 1
                    yield from flush()
            if first < len(texts):
                keys.append(names.slice(first))
        if held:
            yield from flush()

    return rows.mapInArrow(pack, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, ids_of, lengths) of packed pieces: the tokens of a whole sequence, and whose they are.

    One row a sequence, of at most one window; ``ids_of`` and ``lengths`` tell the documents in turn, so
    that attention need not cross them. Padding is left to the reader.
    """
    each = F.sort_array(F.collect_list(F.struct("offset", "length", "id", "ids")))
    joined = F.aggregate("pieces", F.lit("").cast("binary"), lambda held, p: F.concat(held, p["ids"]))
    return (
        pieces.groupBy("sequence_id")
        .agg(each.alias("pieces"))
        .select("sequence_id", joined.alias("ids"), F.col("pieces.id").alias("ids_of"), F.col("pieces.length").alias("lengths"))
    )
