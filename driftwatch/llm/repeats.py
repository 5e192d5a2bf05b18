"""Exact removal of repeated byte strings: shared anchors first, then a suffix array of what they surround.

1. The anchor of a 50-byte window is its least hashed 24-gram; equal windows have equal anchors.
2. Anchors that occur in two documents or more are found by shards of their hash. Documents are dealt
   into buckets by id, and a bucket gets back the shared anchors of its own.
3. The windows of shared anchors, cut out as contexts and once a bucket, meet by anchor. Their suffixes
   are sorted by bucket-pointer refinement: q-gram buckets first, then each bucket by the buckets of
   later offsets, every round using the pointers that the round before refined.
4. Windows in one final bucket are equal: those whose document is not the least are removed. Buckets
   get the verdicts of their contexts back and cut their texts.

Only packed arrays are shuffled, besides the texts. A hot passage is one entry a task (step 2) or one a
bucket (step 3), however many documents hold it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.scratch import kept
from driftwatch.llm.words import BASE_INVERSE, chunks, mixed, powers, prefix_sums, span_hashes

WINDOW = 50
GRAM = 24
SPAN = WINDOW - GRAM + 1  # grams in a window
PIECE = 1 << 23  # window starts that are handled at once
LOW = np.uint64((1 << 24) - 1)
SORT_BYTES = 1 << 19  # contexts whose suffixes are sorted at once
BUCKET_BYTES = 1 << 20  # a task handles its buckets of texts one by one
FLUSH = 1_000_000  # anchors that a task holds before it passes them on
MANY = 0xFFFFFFFF  # instead of a bucket: the task has seen the anchor in several documents
FIRST_GRAM = 8
DEPTHS = ((8, 16), (16, 32), (18, 50))  # offset of the pointers used, depth reached


def _anchors(data: np.ndarray, sums: np.ndarray, start: int, stop: int, leaves: np.ndarray):
    """Anchors of the windows that start in start..stop - 1 and do not leave their text."""
    grams = stop - start + SPAN - 1
    spans = sums[start + GRAM : start + GRAM + grams] - sums[start : start + grams]
    h = mixed(spans * powers(BASE_INVERSE, start + grams)[start:])
    low, width = (h & ~LOW) | np.arange(grams, dtype=np.uint64), 1  # ties go to the left
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = stop - start
    low = np.minimum(low[:n], low[SPAN - width : SPAN - width + n])
    starts = np.flatnonzero(~leaves[start:stop])
    own = low[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    at = (own[first] & LOW).astype(np.int64)
    return h[at], starts[first] + start, starts[last] + start


def anchors(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor its hash, and the first and last start of the windows that it stands for.

    ``data`` holds texts one after another; every window lies within one text and has one anchor.
    """
    n = len(data) - WINDOW + 1
    parts = []
    if n > 0:
        mark = np.zeros(len(data) + 1, np.int32)
        np.add.at(mark, np.maximum(offsets[1:] - WINDOW + 1, offsets[:-1]), 1)
        np.add.at(mark, offsets[1:], -1)
        leaves = np.cumsum(mark)[:n] > 0
        parts = [_anchors(data, sums, i, min(i + PIECE, n), leaves) for i in range(0, n, PIECE)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def packed(x: np.ndarray) -> bytes:
    """Numbers by byte planes: sorted ones compress well in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpacked(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def shards_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The shard of each anchor: by a scrambled hash, since anchors are least hashes and so mostly small numbers."""
    return (mixed(h) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def shared_anchors(docs: DataFrame, parts: int, each: int) -> DataFrame:
    """(bucket, hashes): the anchors of each bucket's documents that occur in two documents or more.

    Anchors travel by ``parts`` shards, and back by as many groups of ``each`` buckets.
    """

    def emit(hashes: list, owners: list, of: list):
        h, doc, bucket = np.concatenate(hashes), np.concatenate(owners), np.concatenate(of)
        order = np.lexsort((doc, h))
        h, doc, bucket = h[order], doc[order], bucket[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, bucket = h[fresh], bucket[fresh]
        first = runs(h)
        many = np.diff(np.append(first, len(h))) > 1
        rows = []
        # what this task knows to be shared goes straight to its buckets
        direct = np.repeat(many, np.diff(np.append(first, len(h))))
        own_h, own_b = h[direct], bucket[direct].astype(np.uint32)
        for group, own in split(bucket[direct] // each, np.arange(len(own_h))):
            rows.append((1, group, packed(own_h[own]), packed(own_b[own])))
        single = np.where(many, MANY, bucket[first]).astype(np.uint32)
        for shard_id, own in split(shards_of(h[first], parts), np.arange(len(first))):
            rows.append((0, shard_id, packed(h[first][own]), packed(single[own])))
        return table(rows)

    def split(keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        at = runs(keys[order])
        return zip(keys[order][at].tolist(), np.split(values[order], at[1:]), strict=True) if len(at) else ()

    def table(rows: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["kind", "id", "hashes", "of"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, of, size, seen = [], [], [], 0, 0
        for batch in batches:
            bucket_of = batch.column(2).to_numpy()
            for chunk in chunks(batch.column(1)):
                h, first, _ = anchors(chunk.data, chunk.offsets, prefix_sums(chunk.data))
                doc = np.searchsorted(chunk.offsets, first, "right") - 1
                hashes.append(h)
                owners.append(doc + seen)
                of.append(bucket_of[chunk.first + doc])
                size, seen = size + len(h), seen + len(chunk)
                if size > FLUSH:
                    yield emit(hashes, owners, of)
                    hashes, owners, of, size = [], [], [], 0
        if size:
            yield emit(hashes, owners, of)

    def read(frame: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        columns = ((c, k) for c, k in (("hashes", np.uint64), ("of", np.uint32)))
        h, of = (np.concatenate([unpacked(x, k) for x in frame.column(c).to_pylist()]) for c, k in columns)
        order = np.argsort(h, kind="stable")
        return h[order], of[order]

    def meet(frame: pa.Table) -> pa.Table:
        rows = []
        if frame.num_rows:
            kind, own = frame.column("kind")[0].as_py(), frame.column("id")[0].as_py()
            h, of = read(frame)
            if kind:
                rows.append((own, packed(h), packed(of)))
            else:
                first = runs(h)
                size = np.diff(np.append(first, len(h)))
                shared = (size > 1) | (of[first] == MANY)
                back = np.flatnonzero(np.repeat(shared, size) & (of != MANY))
                rows = [(g, packed(h[x]), packed(of[x])) for g, x in split(of[back] // np.uint32(each), back)]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["part", "hashes", "of"])

    def spread(frame: pa.Table) -> pa.Table:
        rows = []
        if frame.num_rows:
            h, of = read(frame)
            rows = [(b, packed(np.unique(x))) for b, x in split(of, h)]
        columns = zip(*rows, strict=True) if rows else ([], [])
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.binary()), strict=True)], ["bucket", "hashes"])

    entries = docs.select("id", "text", "bucket").mapInArrow(collect, "kind int, id long, hashes binary, of binary")
    met = entries.groupBy("kind", "id").applyInArrow(meet, "part long, hashes binary, of binary")
    return met.groupBy("part").applyInArrow(spread, "bucket long, hashes binary")


class Contexts:
    """The anchors of one bucket's texts with their contexts' keys, chunk by chunk."""

    def __init__(self, texts: pa.Table):
        self.chunks = []
        ids = texts.column("id").combine_chunks()
        for chunk in chunks(texts.column("text")):
            sums = prefix_sums(chunk.data)
            h, first, last = anchors(chunk.data, chunk.offsets, sums)
            doc = np.searchsorted(chunk.offsets, first, "right") - 1
            key = span_hashes(sums, first, last + WINDOW)
            own = ids.slice(chunk.first, len(chunk))
            known = np.asarray(own.is_valid())[doc]
            number = np.asarray(own.fill_null(0).to_numpy(zero_copy_only=False), np.int64)[doc]
            self.chunks.append((chunk, h[known], first[known], last[known], key[known], number[known]))


def contexts(texts: pa.Table, hashes: np.ndarray, shards: int) -> list[tuple]:
    """(shard, anchors, least ids, lengths, compressed bytes) of the bucket's distinct contexts of shared anchors."""
    found = []
    for chunk, h, first, last, key, doc in Contexts(texts).chunks:
        shared = np.flatnonzero(np.isin(h, hashes, kind="sort"))
        at, sizes = first[shared], last[shared] + WINDOW - first[shared]
        ends = np.cumsum(sizes)
        flat = np.repeat(at - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        found.append((key[shared], h[shared], doc[shared], sizes, chunk.data[flat]))
    if not found:
        return []
    key, h, doc, sizes = (np.concatenate([f[i] for f in found]) for i in range(4))
    data = np.concatenate([f[4] for f in found])
    starts = np.cumsum(sizes) - sizes
    order = np.lexsort((doc, h, key))  # the least id of equal contexts comes first
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])
    order = order[fresh]
    shard = shards_of(h[order], shards).astype(np.int64)
    by = np.lexsort((h[order], shard))  # sorted anchors pack well
    order, shard = order[by], shard[by]
    at = runs(shard)
    out = []
    for own, s in zip(np.split(order, at[1:]) if len(at) else [], shard[at].tolist(), strict=True):
        total = np.cumsum(sizes[own])
        flat = np.repeat(starts[own] - total + sizes[own], sizes[own]) + np.arange(total[-1])
        out.append((s, packed(h[own]), packed(doc[own]), packed(sizes[own].astype(np.uint8)), zlib.compress(data[flat], 1)))
    return out


def refined_buckets(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Bucket pointers of all positions with 50 bytes left, equal for equal 50-byte strings.

    ``left`` is the number of bytes from a position to the end of its context. The first buckets are
    those of the 8-grams; each round sorts the buckets that still hold several positions by the bucket
    pointers at a later offset, and the pointers it sets serve the next round.
    """
    n = len(data)
    pointer = np.full(n, -1, np.int32)

    def deal(positions: np.ndarray, keys: np.ndarray, base: np.ndarray | None) -> np.ndarray:
        """Set pointers to where each new bucket begins; returns positions that are not alone."""
        order = np.argsort(keys, kind="stable")
        positions, keys = positions[order], keys[order]
        first = runs(keys).astype(np.int32)
        size = np.diff(np.append(first, len(keys)))
        begin = np.repeat(first, size)
        if base is not None:
            base = base[order]
            parents = runs(base)
            begin = base + begin - np.repeat(parents, np.diff(np.append(parents, len(base))))
        pointer[positions] = begin
        return np.sort(positions[np.repeat(size > 1, size)])

    grams = np.zeros(n, np.uint64)
    for j in range(FIRST_GRAM):
        grams[: n - j] |= data[j:].astype(np.uint64) << np.uint64(8 * (FIRST_GRAM - 1 - j))
    some = np.flatnonzero(left >= FIRST_GRAM).astype(np.int32)
    many = deal(some, grams[some], None)
    del grams, some
    for offset, depth in DEPTHS:
        deeper = many[left[many] >= depth]
        if not len(deeper):
            break
        own = pointer[deeper].copy()
        many = deal(deeper, own.astype(np.int64) * (n + 1) + pointer[deeper + offset], own)
    return pointer


def anchor_pieces(h: np.ndarray, sizes: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
    """Contexts in runs of whole anchors of about SORT_BYTES: only those of one anchor can meet."""
    first = runs(h)
    before = (np.cumsum(sizes) - sizes)[first] // SORT_BYTES
    piece = np.repeat(before, np.diff(np.append(first, len(h))))
    return np.split(members, runs(piece)[1:]) if len(members) else []


def verdicts(frame: pa.Table) -> pa.Table:
    """(bucket, keys, anchors, masks): in which windows of a context an earlier document has the same bytes.

    Bit w of a mask: the window at w also starts in a document below the least one of that bucket.
    """
    schema = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("anchors", pa.binary()), ("masks", pa.binary())])
    if not frame.num_rows:
        return schema.empty_table()
    read = lambda name, kind: [unpacked(x, kind) for x in frame.column(name).to_pylist()]
    parts = read("anchors", np.uint64)
    bucket = np.repeat(frame.column("bucket").to_numpy(), [len(p) for p in parts])
    h, doc = np.concatenate(parts), np.concatenate(read("ids", np.int64))
    sizes = np.concatenate(read("sizes", np.uint8)).astype(np.int64)
    data = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in frame.column("bytes").to_pylist()])
    starts = np.cumsum(sizes) - sizes
    key = span_hashes(prefix_sums(data), starts, starts + sizes)
    order = np.lexsort((key, h))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])
    context = np.empty(len(order), np.int64)
    context[order] = np.cumsum(fresh) - 1
    one = order[fresh]  # an entry of every distinct context
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, context, doc)
    windows = sizes[one] - WINDOW + 1
    base = np.cumsum(windows) - windows
    earliest = np.repeat(least, windows)
    # an anchor with one context only meets no other: its windows are equal to its own alone
    group = runs(h[one])
    alone = np.repeat(np.diff(np.append(group, len(one))), np.diff(np.append(group, len(one)))) == 1
    open_ = np.flatnonzero(~alone)
    for some in anchor_pieces(h[one][open_], sizes[one][open_], open_):
        size = sizes[one][some]
        total = np.cumsum(size)
        flat = np.repeat((starts[one][some] - total + size).astype(np.int32), size) + np.arange(total[-1], dtype=np.int32)
        left = np.repeat(total.astype(np.int32), size) - np.arange(total[-1], dtype=np.int32)
        pointer = refined_buckets(data[flat], left)
        at = np.flatnonzero(left >= WINDOW)
        owner = np.repeat(some, size)[at]
        slot = base[owner] + sizes[one][owner] - left[at]
        by = np.argsort(pointer[at], kind="stable")
        first = runs(pointer[at][by])
        lows = np.minimum.reduceat(least[owner][by], first)
        earliest[slot[by]] = np.repeat(lows, np.diff(np.append(first, len(by))))
    mask = np.zeros(len(key), np.uint32)
    for w in range(int(windows.max())):
        has = windows[context] > w
        there = base[context[has]] + w
        mask[has] |= ((earliest[there] < doc[has]).astype(np.uint32)) << np.uint32(w)
    told = np.flatnonzero(mask)
    told = told[np.argsort(bucket[told], kind="stable")]
    at = runs(bucket[told])
    rows = [(int(bucket[own[0]]), packed(key[own]), packed(h[own]), packed(mask[own])) for own in (np.split(told, at[1:]) if len(at) else [])]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def cut(texts: pa.Table, told: pa.Table) -> pa.Table:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of a bucket's texts, by its verdicts."""
    read = lambda name, kind: np.concatenate([np.zeros(0, kind), *[unpacked(x, kind) for x in told.column(name).to_pylist()]])
    keys, marks, masks = read("keys", np.uint64), read("anchors", np.uint64), read("masks", np.uint32)
    order = np.argsort(keys, kind="stable")
    keys, marks, masks = keys[order], marks[order], masks[order]
    parts = Contexts(texts).chunks
    key = np.concatenate([np.zeros(0, np.uint64), *[p[4] for p in parts]])
    doc = np.concatenate([np.zeros(0, np.int64), *[p[5] for p in parts]])
    by = np.argsort(key, kind="stable")
    first = runs(key[by])
    least = np.empty(len(key), np.int64)
    if len(first):
        least[by] = np.repeat(np.minimum.reduceat(doc[by], first), np.diff(np.append(first, len(by))))
    sizes, removed, spans, digests, texts_left, done = [], [], [], [], [], 0
    for chunk, h, start, last, own, number in parts:
        n = len(chunk.data)
        low = least[done : done + len(own)]
        done += len(own)
        cover = np.zeros(n + 1, np.int64)
        later = number > low  # the bucket itself has the context in a lesser document
        np.add.at(cover, start[later], 1)
        np.add.at(cover, last[later] + WINDOW, -1)
        if len(keys):
            at = np.searchsorted(keys, own)
            at[at == len(keys)] = 0
            mask = np.where(~later & (keys[at] == own) & (marks[at] == h), masks[at], 0)
            some = np.flatnonzero(mask)
            for w in range(SPAN):
                hit = start[some][(mask[some] >> np.uint32(w)) & np.uint32(1) == 1] + w
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + WINDOW, -1)
        gone = np.cumsum(cover)[:n] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edges = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
        begins[edges] = gone[edges]
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[chunk.offsets])
        sizes.append(np.diff(chunk.offsets))
        removed.append(count(gone))
        spans.append(count(begins))
        for a, b, any_ in zip(chunk.offsets[:-1], chunk.offsets[1:], removed[-1], strict=True):
            left = chunk.data[a:b][~gone[a:b]] if any_ else chunk.data[a:b]
            raw = left.tobytes()
            digests.append(hashlib.sha256(raw).hexdigest())
            texts_left.append(raw)
    joined = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
    return pa.table(
        [texts.column("id").combine_chunks(), joined(sizes), joined(removed), joined(spans), pa.array(digests, pa.string()), pa.array(texts_left, pa.binary())],
        ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row.

    Removed is each byte that a 50-byte string covers which also starts in a text of a smaller id; all
    strings are judged on the input. Null texts are empty; rows with a null id neither lose bytes nor
    count as earlier; rows that repeat an id do not remove from each other. ``kept`` holds the remaining
    bytes (a cut may fall within a character); without ``texts`` it is left out. No rows give no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    each = max(1, -(-total // (parts * BUCKET_BYTES)))
    buckets = each * parts
    named = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = named.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    lists = kept(shared_anchors(named.where("id is not null"), parts, each), "shared-anchors")

    def send(own: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("anchors", "ids", "sizes", "bytes")], ("bucket", pa.int64())])
        rows = []
        if own.num_rows and told.num_rows:
            bucket = own.column("bucket")[0].as_py()
            hashes = np.unique(np.concatenate([unpacked(x, np.uint64) for x in told.column("hashes").to_pylist()]))
            rows = [(*r, bucket) for r in contexts(own, hashes, buckets)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    sent = named.groupBy("bucket").cogroup(lists.groupBy("bucket")).applyInArrow(
        send, "shard long, anchors binary, ids binary, sizes binary, bytes binary, bucket long"
    )
    told = kept(sent.groupBy("shard").applyInArrow(verdicts, "bucket long, keys binary, anchors binary, masks binary"), "verdicts")
    result = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(own: pa.Table, masks: pa.Table) -> pa.Table:
        out = cut(own, masks)
        return out if texts else out.drop_columns(["kept"])

    return named.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(finish, result + (", kept binary" if texts else ""))
