"""WARC records in ZIP archives: written as stored members, read back by range reads without extraction.

``write`` makes a WARC/1.1 record of each page - ``response`` with the payload, or ``revisit`` where a page with an equal
payload of at least ``MIN_REVISIT`` bytes and a larger page_id has it - gzips each record by itself, and
puts the records of a task into ZIP archives.  An archive's members are stored, not deflated: ``archive/data.warc.gz`` with the
records and ``indexes/index.cdx`` with a line (page_id, offset, length) for each.  ZIP64 directories are written when sizes
or counts need them (or ``force_zip64`` asks for them).

``read`` opens an archive by its end: the end-of-directory record (and the ZIP64 one), the central directory, then the local headers of
the members it needs, then the index, and at last each record's own range.  Tasks get ranges of an archive's index, so one
archive can be read by several.

Revisits are found from digests alone: (page_id, SHA-1, length) are grouped by digest with partial aggregation,
and the decision goes back by digest over salted copies of the few digests that have revisits, so a payload
that a third of all pages hold is no hot partition.

Archive names carry the task attempt and count only through the manifest, which is written to the shared folder
first: lost or repeated tasks leave unused files, never doubled records.

Defined results: a null html is an empty payload; payloads under MIN_REVISIT bytes are all responses; rows that repeat a
page_id are all kept, and of equal payloads with one page_id each row is a response; rows without a page_id are dropped; a null url
is recorded as ``urn:page:<id>``; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _files, _spark

MIN_REVISIT = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ARCHIVE_BYTES, READ_RECORDS, SALTS = 32 << 20, 4096, 16
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


class ZipWriter:
    """Stored members written in one pass; sizes and checksums follow in the directory and in data descriptors."""

    def __init__(self, out, force_zip64: bool = False):
        self.out, self.at, self.members, self.force = out, 0, [], force_zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.begun, self.crc, self.size = name.encode(), self.at, 0, 0
        # flag 8: crc and sizes come after the data, as 64 bits
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45, 0x808, 0, 0, 0x21, 0, _FULL32, _FULL32, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Adds to the open member; returns where in the member the data begin."""
        at = self.size
        self.crc, self.size = zlib.crc32(data, self.crc), at + len(data)
        self._put(data)
        return at

    def end(self) -> None:
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.begun))

    def close(self) -> None:
        start = self.at
        for name, crc, size, begun in self.members:
            big = self.force or size >= _FULL32 or begun >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, begun) if big else b""
            s, b = (_FULL32, _FULL32) if big else (size, begun)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, s, s, len(name), len(extra), 0, 0, 0, 0, b) + name + extra)
        length, n = self.at - start, len(self.members)
        if self.force or n >= _FULL16 or start >= _FULL32 or length >= _FULL32:
            where = self.at
            self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<IIQI", _LOCATOR, 0, where, 1))
            n, length, start = _FULL16, _FULL32, _FULL32
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, n, n, length, start, 0))


class ZipDirectory:
    """Members of an archive, from its directories alone; ``span`` gives the range of a stored member's data."""

    def __init__(self, reader):
        self.reader = reader
        tail_at = max(0, reader.size - 22 - _FULL16)
        tail = reader.read(tail_at, reader.size - tail_at)
        end = tail.rfind(struct.pack("<I", _END))
        if end < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, n, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, end)
        if _FULL16 == n or _FULL32 in (length, start):
            kind, _, where, _ = struct.unpack("<IIQI", reader.read(tail_at + end - 20, 20))
            if kind == _LOCATOR:
                kind, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", reader.read(where, 56))
                if kind != _END64:
                    raise ValueError("broken ZIP64 directory")
        body, at, self.members = reader.read(start, length), 0, {}
        for _ in range(n):
            kind, _, _, _, method, _, _, crc, packed, size, a, b, c, _, _, _, begun = struct.unpack_from("<IHHHHHHIIIHHHHHII", body, at)
            if kind != _CENTRAL:
                raise ValueError("broken central directory")
            name = body[at + 46 : at + 46 + a].decode()
            x, stop = at + 46 + a, at + 46 + a + b
            while x + 4 <= stop:
                tag, width = struct.unpack_from("<HH", body, x)
                if tag == 1:
                    y = x + 4
                    wide = []
                    for v in (size, packed, begun):
                        if v == _FULL32:
                            v = struct.unpack_from("<Q", body, y)[0]
                            y += 8
                        wide.append(v)
                    size, packed, begun = wide
                x += 4 + width
            self.members[name] = (method, crc, packed, size, begun)
            at += 46 + a + b + c

    def span(self, name: str) -> tuple[int, int]:
        method, _, packed, _, begun = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = struct.unpack("<IHHHHHIIIHH", self.reader.read(begun, 30))
        if head[0] != _LOCAL:
            raise ValueError("broken local header")
        return begun + 30 + head[9] + head[10], packed


def record(page: int, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block of its own, only what its payload was."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}:{kind}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (" ".join(url.split()) if url else f"urn:page:{page}"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {page}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:response>", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    return head, data[end + 4 : end + 4 + int(head["content-length"])]


def decisions(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, size, refers_to): which pages revisit which."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where("page_id is not null")
    base = base.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    small = base.where(F.col("size") >= MIN_REVISIT).select("page_id", "digest", "size")
    best = small.groupBy("digest", "size").agg(F.max("page_id").alias("best"), F.min("page_id").alias("least")).where("best > least").drop("least")
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = small.withColumn("salt", F.pmod("page_id", F.lit(SALTS)).cast("int")).join(salted, ["digest", "size", "salt"]).where("page_id < best").select("page_id", "digest", F.col("best").alias("refers_to")).distinct()
    return base.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "size", "refers_to")


def write(pages: DataFrame, force_zip64: bool = False) -> DataFrame:
    """Writes pages(page_id, url, html) as archives; returns their manifest (path, records)."""
    spark = pages.sparkSession
    _spark.small_batches(spark)
    folder = _spark.fresh_path(spark, "warc")
    _files.make_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, made = TaskContext.get(), []
        z = index = None
        for b in batches:
            for row in b.to_pylist():
                if z is None:
                    uri = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz"
                    system, path = _files.open_fs(uri)
                    z, index = ZipWriter(system.open_output_stream(path), force_zip64), []
                    z.begin(DATA)
                data = gzip.compress(record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["size"], row["refers_to"]), 4, mtime=0)
                index.append(f"{row['page_id']} {z.write(data)} {len(data)}")
                if z.at >= ARCHIVE_BYTES:
                    made.append(finish(z, index, uri))
                    z = None
        if z is not None:
            made.append(finish(z, index, uri))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64())], ["path", "records"])

    def finish(z: ZipWriter, index: list[str], uri: str) -> tuple[str, int]:
        z.end()
        z.begin(INDEX)
        z.write("\n".join(index).encode())
        z.end()
        z.close()
        z.out.close()
        return uri, len(index)

    decided = decisions(pages).coalesce(_spark.tasks(spark, _spark.text_size(pages, "html")[1], ARCHIVE_BYTES))
    return _spark.written(decided.mapInArrow(run, "path string, records long"), "manifest")


def records(path: str, first: int, last: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records [first, last) of an archive by range reads; neighbours in the file share a read."""
    r = _files.RangeReader(path)
    z = ZipDirectory(r)
    lines = r.read(*z.span(INDEX)).decode().split("\n")[first:last]
    base, _ = z.span(DATA)
    spans = [tuple(map(int, x.split(" ")[1:])) for x in lines if x]
    i = 0
    while i < len(spans):
        j, stop = i, spans[i][0]
        while j < len(spans) and spans[j][0] == stop and (j == i or stop - spans[i][0] < 1 << 20):
            stop += spans[j][1]
            j += 1
        data = r.read(base + spans[i][0], stop - spans[i][0])
        for at, n in spans[i:j]:
            yield parse(gzip.decompress(data[at - spans[i][0] : at - spans[i][0] + n]))
        i = j
    r.close()


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record of the archives; a revisit's payload is null."""
    parts = manifest.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("records") - 1, F.lit(0)), F.lit(READ_RECORDS))).alias("first"))
    n = max(1, parts.count())
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                rows = []
                for head, block in records(path, first, first + READ_RECORDS):
                    kind, digest, size = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    if kind == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != size):
                        raise ValueError(f"{path}: page {head['x-page-id']} is damaged")
                    rows.append((int(head["x-page-id"]), head["warc-target-uri"], kind, size, digest, int(head["x-refers-to-page"]) if kind == "revisit" else None, block if kind == "response" else None))
                    if len(rows) == 256:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return parts.repartition(n, "path", "first").mapInArrow(run, schema)
