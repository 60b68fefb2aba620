"""WARC records in ZIP archives: writing files, and reading them by byte ranges.

A task streams its pages into ZIP files of the shared store.  Such an archive has two
stored members: the WARC file, and an index that gives each record's offset and length in
it.  The reader works in two steps.  The first opens each file, finds the end record,
follows the ZIP64 locator where there is one, parses the central directory, learns from
a member's local header where its bytes lie, and reads the index (or, without one, walks
the records' heads); it gives ranges of whole records.  The second, dealt by ranges, reads
the records by position.  Nothing is extracted and no file is read whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc", "indexes/index.jsonl"
#: A range that one step of reading takes holds about so many bytes.
RANGE_BYTES = 8 << 20


class Ranges(Protocol):
    """Something that bytes can be read from by position."""

    size: int

    def read(self, offset: int, length: int) -> bytes: ...


class Blob:
    """Ranges of bytes that are in memory."""

    def __init__(self, data: bytes) -> None:
        self._view, self.size = memoryview(data), len(data)

    def read(self, offset: int, length: int) -> bytes:
        return bytes(self._view[offset : offset + length])


class OpenFile:
    """Ranges of an open file of any store."""

    def __init__(self, file: pa.NativeFile) -> None:
        self._file, self.size = file, file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)


@contextmanager
def opened(path: str) -> Iterator[OpenFile]:
    """A file by its URI, in a store that both Spark and pyarrow know (local, HDFS, object stores)."""
    store, own = fs.FileSystem.from_uri(path)
    with store.open_input_file(own) as file:
        yield OpenFile(file)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


class BadArchive(ValueError):
    """The bytes are no readable ZIP archive."""


# Signatures of the ZIP format's records.
_END, _END64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def directory(source: Ranges) -> dict[str, Member]:
    """The members by name, from the central directory (ZIP64 included)."""
    tail_at = max(0, source.size - 22 - 65_535 - 20)
    tail = source.read(tail_at, source.size - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise BadArchive("no end record")
    n, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR:
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        record = source.read(end64, 56)
        if record[:4] != _END64:
            raise BadArchive("no ZIP64 end record where the locator points")
        n, length, offset = struct.unpack_from("<QQQ", record, 32)
    data, pos, out = source.read(offset, length), 0, {}
    for _ in range(n):
        if data[pos : pos + 4] != _CENTRAL:
            raise BadArchive("broken central directory")
        flags, method = struct.unpack_from("<HH", data, pos + 8)
        packed, size, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", data, pos + 20)
        (header,) = struct.unpack_from("<I", data, pos + 42)
        name = data[pos + 46 : pos + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[pos + 46 + name_n : pos + 46 + name_n + extra_n]
        size, packed, header = _zip64(extra, size, packed, header)
        out[name] = Member(name, method, size, packed, header)
        pos += 46 + name_n + extra_n + note_n
    return out


def _zip64(extra: bytes, *values: int) -> tuple[int, ...]:
    """Size, packed size and offset, each from the ZIP64 field if its own place is full."""
    pos, wide = 0, b""
    while pos + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, pos)
        if kind == 1:
            wide = extra[pos + 4 : pos + 4 + n]
        pos += 4 + n
    out, at = [], 0
    for v in values:
        if v == 0xFFFFFFFF:
            (v,) = struct.unpack_from("<Q", wide, at)
            at += 8
        out.append(v)
    return tuple(out)


def data_start(source: Ranges, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise BadArchive(f"{member.name} is not stored")
    head = source.read(member.header, 30)
    if head[:4] != _LOCAL:
        raise BadArchive(f"no local header for {member.name}")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name_n + extra_n


_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record.  A revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    uri = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def parse(data: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest."""
    head, _, block = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = block[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    kind, refers = warc["warc-type"], warc.get("warc-refers-to")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise BadArchive(f"payload of {warc['warc-record-id']} doesn't match its digest")
    number = lambda s: None if s is None or s.endswith(":None>") else int(s.rpartition(":")[2].rstrip(">"))
    return {
        "page_id": number(warc["warc-record-id"]), "url": warc["warc-target-uri"], "payload_bytes": int(_headers(http)["content-length"]), "payload_digest": digest,
        "record_type": kind, "refers_to": number(refers), "payload": payload if kind == "response" else None,
    }


class Packer:
    """Writes one archive to a stream that needs no seeking, record by record."""

    def __init__(self, stream) -> None:
        self._zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._data = self._zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
        self._lines: list[str] = []
        self.size = 0

    def add(self, one: bytes) -> None:
        self._lines.append(json.dumps({"filename": WARC_MEMBER, "offset": self.size, "length": len(one)}))
        self._data.write(one)
        self.size += len(one)

    def close(self) -> None:
        self._data.close()
        self._zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "\n".join(self._lines))
        self._zip.close()


def _indexed(source: Ranges, members: dict[str, Member]) -> dict[str, list[tuple[int, int]]]:
    """By data member: (offset, length) of its records, as the archive's indexes have them.

    A line names its data member by path or by last part; with one data member it needn't.
    """
    data = [n for n in members if n.endswith(".warc")]
    by_name = {n.rpartition("/")[2]: n for n in data} | {n: n for n in data}
    out: dict[str, list[tuple[int, int]]] = {}
    for index in members.values():
        if index.name.endswith(".jsonl"):
            for line in source.read(data_start(source, index), index.size).splitlines():
                entry = json.loads(line)
                if isinstance(entry, dict) and "offset" in entry and "length" in entry:
                    name = by_name.get(entry.get("filename", data[0] if len(data) == 1 else None))
                    if name:
                        out.setdefault(name, []).append((int(entry["offset"]), int(entry["length"])))
    return out


def _walked(source: Ranges, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of a data member, from their heads alone."""
    at = 0
    while at < size:
        head, want = b"", 4096
        while b"\r\n\r\n" not in head and len(head) < size - at:
            head = source.read(start + at, min(want, size - at))
            want *= 2
        fields, found, _ = head.partition(b"\r\n\r\n")
        if not found:
            raise BadArchive("a record's head doesn't end")
        length = len(fields) + 4 + int(_headers(fields)["content-length"]) + 4
        yield at, length
        at += length


def record_ranges(source: Ranges) -> Iterator[tuple[int, int]]:
    """(position in the archive, length) of every record of every .warc member."""
    members = directory(source)
    indexed = _indexed(source, members)
    for data in members.values():
        if data.name.endswith(".warc"):
            start = data_start(source, data)
            for offset, length in indexed.get(data.name) or _walked(source, start, data.size):
                yield start + offset, length


def records_of(source: Ranges) -> Iterator[bytes]:
    """Every record, by range."""
    for offset, length in record_ranges(source):
        yield source.read(offset, length)


def deduplicated(pages: DataFrame, least_bytes: int = 0, broadcast_rows: int = 200_000, spread: int = 64) -> DataFrame:
    """page_id, url, payload (UTF-8 bytes, null html empty), refers_to: for payloads of
    at least ``least_bytes`` that occur more than once, the least page_id (null for it)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    # counts from the hashes alone; the payloads only move if very many of them repeat
    copies = rows.filter(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("sha", "n", "first")
    copies = common.written(copies)
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    if copies.count() <= broadcast_rows:
        found = rows.join(F.broadcast(copies), ["sha", "n"], "left")
    else:  # one payload, such as the empty one, may be that of very many pages: it is spread
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(spread)))
        found = rows.join(copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<long>"))), ["sha", "n", "salt"], "left")
    return found.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20, least_bytes: int = 0) -> DataFrame:
    """(path string, length long) of the ZIP files written under ``folder``, a URI of the
    shared store: each of about ``archive_bytes``, a record per row of pages.

    A file's name is new for each attempt of a task, and the list of files is a table that
    Spark commits: of a lost or repeated attempt a file may stay, but no list names it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        paths, packer, stream = [], None, None
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    if packer is None:
                        name = f"pages-{uuid.uuid4().hex}.zip"
                        stream = store.open_output_stream(f"{root}/{name}")
                        packer = Packer(stream)
                        paths.append(f"{folder}/{name}")
                    page_id, url, payload, refers = (batch.column(k)[i].as_py() for k in range(4))
                    packer.add(record(page_id, url, payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), refers))
                    if packer.size >= archive_bytes:
                        packer.close()
                        stream.close()
                        packer = None
            if packer is not None:
                packer.close()
        finally:
            if stream is not None:
                stream.close()
        sizes = [store.get_file_info(f"{root}/{x.rpartition('/')[2]}").size for x in paths]
        yield pa.RecordBatch.from_arrays([pa.array(paths, type=pa.string()), pa.array(sizes, type=pa.int64())], names=["path", "length"])

    return common.written(deduplicated(pages, least_bytes).mapInArrow(run, "path string, length long"))


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def archive_ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offsets array, lengths array): neighbouring records of (path) archives, about ``range_bytes`` a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))

        def row(path: str, held: list[tuple[int, int]]) -> pa.RecordBatch:
            values = ([path], [[o for o, _ in held]], [[n for _, n in held]])
            return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(values, kinds, strict=True)], names=["path", "offsets", "lengths"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple[int, int]] = []
                with opened(path) as source:
                    for one in record_ranges(source):
                        held.append(one)
                        if one[0] + one[1] - held[0][0] >= range_bytes:
                            yield row(path, held)
                            held = []
                if held:
                    yield row(path, held)

    return archives.select("path").filter("path IS NOT NULL").mapInArrow(run, "path string, offsets array<long>, lengths array<long>")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a table of paths (path string) names.

    Without ``payloads`` that column is null.  A null path is no archive; a file
    that can't be parsed fails the query rather than losing records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in _READ.split(", ")]
        for batch in batches:
            for path, offsets, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with opened(path) as source:
                    rows = [parse(source.read(at, n)) for at, n in zip(offsets, lengths, strict=True)]
                if not payloads:
                    rows = [r | {"payload": None} for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=k) for n, k in zip(names, kinds, strict=True)], names=names)

    ranges = archive_ranges(archives).repartition(F.col("path"), F.get("offsets", F.lit(0)))
    return ranges.mapInArrow(run, _READ)


def read_zip_files(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """The records of all ZIP archives under a path: Spark lists the files, never their contents, and
    tasks read them by range.  The store must be one that pyarrow knows too."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page, as read back from the archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    A null html is an empty payload (equal to other empty ones); a null url is
    replaced by a URN; repeated page_ids with one payload are all responses if
    theirs is the least; a page with a null page_id is a response.  An empty
    table gives no rows; more columns are ignored.
    """
    return read_archives(write_archives(pages, common.shared_dir(pages.sparkSession)), payloads=False).drop("payload", "url")
