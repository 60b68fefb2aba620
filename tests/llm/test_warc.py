import base64
import hashlib
import io
import json
import zipfile

import pyarrow as pa
import pytest
from statuta.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_pages_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(9001, None, None), (9002, "http://x/ y\r\nz", ""), (9003, "u", "é" * 300_000), (9000, "v", "é" * 300_000)], "page_id long, url string, html string")
    both = pages.union(extra).selectExpr("*", "'x' AS payload", "1 AS n")
    rows = both.collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    want = {(r.page_id, len((r.html or "").encode()), digest(r.html), "response" if first[r.html or ""] == r.page_id else "revisit", None if first[r.html or ""] == r.page_id else first[r.html or ""]) for r in rows}
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(both).collect()]
    assert set(got) == want and len(got) == len(rows)
    assert warc.round_trip(both.limit(0)).count() == 0
    few, many = (sorted(((r.page_id, r.refers_to) for r in warc.deduplicated(both, broadcast_rows=n).collect())) for n in (1 << 20, 0))
    assert few == many


def pack(records):
    out = io.BytesIO()
    packer = warc.Packer(out)
    for r in records:
        packer.add(r)
    packer.close()
    return out.getvalue()


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x\r\n\r\ny"), (2, "b", "x\r\n\r\ny"), (3, None, "z"), (None, "n", "z"), (None, "n", None)], "page_id long, url string, html string")
    files = warc.write_archives(pages, f"file://{tmp_path}/zips", archive_bytes=1).collect()
    assert len(files) == 5 and sum(r.length for r in files) == sum(x.stat().st_size for x in (tmp_path / "zips").iterdir())
    (tmp_path / "zips" / "note.txt").write_text("no archive")
    got = {(r.page_id, r.record_type, r.payload and bytes(r.payload)) for r in warc.read_zip_files(spark, f"{tmp_path}/zips").collect()}
    assert got == {(1, "response", b"x\r\n\r\ny"), (2, "revisit", None), (3, "response", b"z"), (None, "response", b"z"), (None, "response", b"")}


def test_ranges_are_dealt_and_cover_all_records(spark, tmp_path):
    rows = [(i, f"u{i}", "p" * (i % 50)) for i in range(500)]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/z", archive_bytes=1 << 30)
    ranges = warc.archive_ranges(files, range_bytes=10_000).collect()
    assert len({r.path for r in ranges}) == 1 and len(ranges) > 10 and sum(len(r.offsets) for r in ranges) == 500
    assert all(r.offsets[-1] + r.lengths[-1] - r.offsets[0] < 12_000 for r in ranges)


def test_foreign_archives(tmp_path):
    """Other member names, several data members, indexes by last name part, and none at all."""
    made = [[warc.record(10 * k + i, "u", b"p" * (300 * i), digest("p" * (300 * i)), None) for i in range(4)] for k in range(3)]
    names = ["archive/one.warc", "two.warc", "deep/er/three.warc"]
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_STORED) as z:
        for name, records in zip(names, made, strict=True):
            z.writestr(name, b"".join(records))
        lines, at = [json.dumps({"format": "cdxj", "note": "no record"})], 0
        for r in made[1]:
            lines.append(json.dumps({"filename": "two.warc", "offset": str(at), "length": str(len(r))}))
            at += len(r)
        z.writestr("indexes/i.jsonl", "\n".join(lines))
        z.writestr("pages/readme.md", "text")
    with warc.opened(f"file://{tmp_path}/x.zip") as source:
        assert list(warc.records_of(source)) == [r for records in made for r in records]


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    records = [warc.record(i, f"u{i}", b"p" * i, digest("p" * i), None) for i in range(5)]
    data = pack(records)
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    assert list(warc.records_of(warc.Blob(data))) == records
    assert list(warc.records_of(warc.OpenFile(pa.BufferReader(data)))) == records


def test_ranges_only_and_errors():
    records = [warc.record(i, "u", b"p" * 9000, digest("p" * 9000), None) for i in range(50)]
    data = pack(records)

    class Counting(warc.Blob):
        read_bytes = 0

        def read(self, offset, length):
            self.read_bytes += length
            return super().read(offset, length)

    source = Counting(data)
    next(warc.records_of(source))
    assert source.read_bytes < len(data) / 3
    with pytest.raises(warc.BadArchive):
        warc.directory(warc.Blob(b"no archive"))
    with pytest.raises(warc.BadArchive):
        warc.parse(records[0].replace(b"ppp", b"ppq", 1))
    note = io.BytesIO()
    with zipfile.ZipFile(note, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
        z.comment = b"PK\x05\x06 in a comment"
    members = warc.directory(warc.Blob(note.getvalue()))
    with pytest.raises(warc.BadArchive):
        warc.data_start(warc.Blob(note.getvalue()), members["a"])
