"""WARC records in ZIP archives: written by tasks, read back by byte ranges without extraction.

An archive holds stored (uncompressed) members only: ``archive/data.warc.gz``, one gzip member a record,
and ``indexes/index.cdx``, one line a record. Readers parse the end record, the ZIP64 records where the
plain ones overflow, and the central directory; then they seek.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.scratch import kept, new_folder

LEAST_REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
ARCHIVE_BYTES = 512 << 20
DATA_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdx"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Signatures and sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR64_SIZE = 30, 46, 22, 56, 20
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


class ZipWriter:
    """Stored members one after another; ZIP64 records wherever a number needs them."""

    def __init__(self, out, zip64_from: int = FULL32):
        self.out, self.at, self.members, self.zip64_from = out, 0, [], zip64_from

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Sizes follow in a data descriptor (flag bit 3); the directory repeats them."""
        self.current = [name.encode(), self.at, 0, 0]
        raw = self.current[0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> None:
        self.current[2] += len(data)
        self.current[3] = zlib.crc32(data, self.current[3])
        self.write(data)

    def finish(self) -> None:
        _, _, size, crc = self.current
        self.write(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
        self.members.append(self.current)

    def close(self) -> None:
        start = self.at
        for raw, header, size, crc in self.members:
            large = [x for x in (size, size, header) if x >= self.zip64_from]
            extra = struct.pack(f"<HH{len(large)}Q", 1, 8 * len(large), *large) if large else b""
            small = lambda x: FULL32 if x >= self.zip64_from else x
            self.write(
                struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8, 0, 0, 33, crc, small(size), small(size), len(raw), len(extra), 0, 0, 0, 0, small(header))
                + raw
                + extra
            )
        size, count = self.at - start, len(self.members)
        if max(size, start) >= self.zip64_from or count >= FULL16:
            end64 = self.at
            self.write(struct.pack("<4sQHHIIQQQQ", END64, END64_SIZE - 12, 45, 45, 0, 0, count, count, size, start))
            self.write(struct.pack("<4sIQI", LOCATOR64, 0, end64, 1))
            size, start, count = FULL32, FULL32, FULL16
        self.write(struct.pack("<4sHHHHIIH", END, 0, 0, count, count, size, start, 0))


def directory(file, length: int) -> dict[str, Member]:
    """Members by name, from the central directory. ``file`` is seekable."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, length - END_SIZE - FULL16)
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(END)
    while at >= 0:
        fields = struct.unpack_from("<HHHHIIH", tail, at + 4) if len(tail) - at >= END_SIZE else None
        if fields and at + END_SIZE + fields[-1] == len(tail):  # the comment ends the file
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    _, _, _, count, size, start, _ = fields
    if FULL32 in (size, start) or count == FULL16:
        locator = read(tail_at + at - LOCATOR64_SIZE, LOCATOR64_SIZE)
        if locator[:4] == LOCATOR64:
            end64 = read(struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
            if end64[:4] != END64:
                raise ValueError("ZIP64 locator points to no ZIP64 end record")
            count, size, start = struct.unpack_from("<QQQ", end64, 32)
    raw, found, at = read(start, size), {}, 0
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, packed, plain, names, extras, comments, header = struct.unpack_from("<10xH8xIIHHH8xI", raw, at)
        name = raw[at + CENTRAL_SIZE : at + CENTRAL_SIZE + names].decode()
        extra = raw[at + CENTRAL_SIZE + names : at + CENTRAL_SIZE + names + extras]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # 64-bit numbers, only of the fields that overflow, in this order
                numbers = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = numbers.pop(0) if plain == FULL32 else plain
                packed = numbers.pop(0) if packed == FULL32 else packed
                header = numbers.pop(0) if header == FULL32 else header
            extra = extra[4 + n :]
        found[name] = Member(name, method, packed, header)
        at += CENTRAL_SIZE + names + extras + comments
    return found


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin: after the local header, whose extra field has its own length."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    file.seek(member.header)
    local = file.read(LOCAL_SIZE)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    names, extras = struct.unpack_from("<HH", local, 26)
    return member.header + LOCAL_SIZE + names + extras


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_bytes(row_id, uri, payload: bytes, refers_to) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP header and drops the payload."""
    name = lambda x: f"<urn:row:{x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(row_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {json.dumps(uri)[1:-1]}"] if uri is not None else []),
        f"WARC-Payload-Digest: {sha1_label(hashlib.sha1(payload).digest())}",
        *([f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def parsed_record(raw: bytes) -> dict:
    """Headers and payload of one gzip member; the digest of a response is computed from its payload."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != told or len(payload) != length):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have the payload it tells of")
    number = lambda x: None if x in (None, "<urn:row:None>") else int(x[len("<urn:row:") : -1])
    uri = fields.get("WARC-Target-URI")
    return {
        "row_id": number(fields["WARC-Record-ID"]),
        "uri": None if uri is None else json.loads(f'"{uri}"'),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": told,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


def with_references(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Add ``_refers_to``: the largest key with an equal payload, where that is another row's.

    Only digests that occur more than once are joined back, so a hot payload is a join key of small
    rows that adaptive execution can split. Rows that can be no revisit have join keys of their own,
    which match nothing and spread them over all tasks.
    """
    digest = F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary"))
    alone = F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string"))
    long = (F.octet_length(payload) >= LEAST_REVISIT_BYTES) & F.col(key).isNotNull()
    marked = rows.withColumn("_digest", F.when(long, digest).otherwise(alone))
    shared = (
        marked.where(~F.col("_digest").startswith("-"))
        .groupBy("_digest")
        .agg(F.max(key).alias("_largest"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select("_digest", "_largest")
    )
    joined = marked.join(shared, "_digest", "left")
    return joined.withColumn("_refers_to", F.when(F.col("_largest") != F.col(key), F.col("_largest")))


def write_archives(rows: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Write every row as a record; returns the manifest (path, records), kept as a table.

    Each task attempt writes files of its own name; the manifest, which Spark commits, names those of
    the attempts that count, so lost executors and repeated tasks leave no double records. A file is
    closed at about 512 MB.
    """
    named = rows.select(F.col(key).cast("long").alias("key"), F.col(uri).alias("uri"), F.col(payload).alias("payload"))
    source = with_references(named, "key", "payload").select("key", "uri", "payload", "_refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        paths, counts = [], []
        archive = None

        def close():
            nonlocal archive
            zipped, stream, index = archive
            zipped.finish()
            zipped.begin(INDEX_MEMBER)
            zipped.add("".join(index).encode())
            zipped.finish()
            zipped.close()
            stream.close()
            counts.append(len(index))
            archive = None

        for batch in batches:
            for row_id, link, text, refers in zip(*[batch.column(i) for i in range(4)], strict=True):
                if archive is None:
                    fs.create_dir(base, recursive=True)
                    path = f"{folder}/{uuid.uuid4().hex}.wacz"
                    stream = fs.open_output_stream(opened(path)[1])
                    archive = ZipWriter(stream), stream, []
                    archive[0].begin(DATA_MEMBER)
                    paths.append(path)
                zipped, _, index = archive
                body = (text.as_py() or "").encode()
                raw = record_bytes(row_id.as_py(), link.as_py(), body, refers.as_py())
                index.append(f"{zipped.current[2]} {len(raw)}\n")
                zipped.add(raw)
                if zipped.current[2] >= ARCHIVE_BYTES:
                    close()
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return kept(source.mapInArrow(write, "path string, records long"), "warc-manifest")


def record_ranges(manifest: DataFrame) -> DataFrame:
    """(path, start, sizes): runs of neighbouring records of about 8 MB, from the archives' own indexes."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = opened(path)
                with fs.open_input_file(name) as file:
                    members = directory(file, file.size())
                    index, data = members[INDEX_MEMBER], members[DATA_MEMBER]
                    base, at = data_offset(file, data), data_offset(file, index)
                    file.seek(at)
                    lines = io.BytesIO(file.read(index.size))
                starts, runs, held = [], [], []
                first = 0
                for line in lines:
                    offset, size = map(int, line.split())
                    if held and offset + size - first > RANGE_BYTES:
                        starts.append(base + first)
                        runs.append(held)
                        held = []
                    if not held:
                        first = offset
                    held.append(size)
                if held:
                    starts.append(base + first)
                    runs.append(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(runs), pa.string()), pa.array(starts, pa.int64()), pa.array(runs, pa.list_(pa.int64()))],
                    ["path", "start", "sizes"],
                )

    return manifest.select("path").mapInArrow(locate, "path string, start long, sizes array<bigint>")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives: row_id, uri, record_type, payload_bytes, payload_digest, refers_to, payload.

    Each range is one seek and one read. ``payload`` is null for revisits, and for all records if
    ``payloads`` is false; digests of responses are checked in any case.
    """
    fields = [
        ("row_id", pa.int64(), "long"), ("uri", pa.string(), "string"), ("record_type", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"),
        ("payload_digest", pa.string(), "string"), ("refers_to", pa.int64(), "long"), ("payload", pa.binary(), "binary"),
    ]
    if not payloads:
        fields.pop()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, sizes in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                fs, name = opened(path)
                with fs.open_input_file(name) as file:
                    file.seek(start)
                    raw = file.read(sum(sizes))
                rows, at = [], 0
                for size in sizes:
                    rows.append(parsed_record(raw[at : at + size]))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t, _ in fields], [c for c, _, _ in fields])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = record_ranges(manifest).repartition(tasks, "path", "start")  # a row stands for 8 MB: never coalesced
    return ranges.mapInArrow(read, ", ".join(f"{c} {t}" for c, _, t in fields))


def archived(rows: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", payloads: bool = False) -> DataFrame:
    """Write ``rows`` to archives in the shared folder and read the records back.

    Null payloads are empty; null uris are left out of the record; rows without a key are responses
    and never referred to; repeated keys with equal payloads are all responses. No rows give no rows.
    """
    folder = new_folder(rows.sparkSession, "warc")
    return read_archives(write_archives(rows, folder, key, uri, payload), payloads)
