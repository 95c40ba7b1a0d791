"""WARC records in stored ZIP archives, written by Spark and read by ranges."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage, shared_dir
from .common import rows_of, table

#: Compressed bytes of records after which a task begins the next archive, and bytes of a range read.
ARCHIVE_BYTES, RANGE_BYTES = 8 << 20, 1 << 20
DATE = "1970-01-01T00:00:00Z"  # of records whose capture time is not known
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> tuple[bytes, str]:
    """A WARC/1.1 record and its payload digest. A revisit has the HTTP header alone."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:  # a header value has no line ends
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _gzip(raw: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


class ArchiveWriter:
    """Records of one archive, each a gzip member, with an index line each."""

    def __init__(self) -> None:
        self.data, self.lines = io.BytesIO(), []

    def add(self, page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> None:
        raw, digest = record(page, url, payload, refers_to)
        packed = _gzip(raw)
        note = {"offset": self.data.tell(), "length": len(packed), "filename": RECORDS, "digest": f"sha1:{digest}"}
        self.lines.append(f"{re.sub(r'\s', '%20', url or '-')} {re.sub('[^0-9]', '', DATE)} {json.dumps(note)}\n")
        self.data.write(packed)

    def close(self) -> bytes:
        """The archive: stored members, so that a range of a member is a range of the file."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(zipfile.ZipInfo(RECORDS), self.data.getvalue())
            z.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.lines)))
            z.writestr(zipfile.ZipInfo(PACKAGE), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": p} for p in (RECORDS, INDEX)]}))
            z.comment = b"\n"
        return out.getvalue()


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of ``pages`` into ZIP archives below ``path``.

    The payload is the UTF-8 html, empty for null. Of records with equal payloads
    of at least ``min_bytes`` bytes, that with the smallest page_id is a response
    and the others revisit it; rows that repeat that id are responses too, and so
    are rows whose ids are all null. Shorter payloads are all responses. An empty
    table makes no archive.

    Tasks hold one archive of bounded size. Spark's text writer commits it: an
    archive is one row and one file, and the line end that closes the row is the
    archive's comment, so it is a valid ZIP file and any file system that Spark
    reaches will do. The payloads of a group meet by digest only: where one group
    has very many rows, Spark splits the join.
    """
    src = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("body"))
    src = src.withColumn("mark", F.sha2("body", 256))
    groups = src.where(F.length("body") >= min_bytes).groupBy("mark").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = cut_lineage(groups.select(F.col("mark").alias("m"), "first"))
    other = F.when(F.col("page") != F.col("first"), F.col("first")).when(F.col("page").isNull(), F.col("first"))
    rows = src.join(groups, F.col("mark") == F.col("m"), "left").select(F.col("page").cast("string"), "url", "body", other.cast("string").alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ArchiveWriter()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([made.close()[:-1]], pa.binary())], names=["value"])
        for batch in rows_of(batches):
            for row in zip(*batch.columns, strict=True):
                page, at, body, refers_to = (x.as_py() for x in row)
                made.add(page, at, body, refers_to)
                if made.data.tell() >= archive_bytes:
                    yield done()
                    made = ArchiveWriter()
        if made.lines:
            yield done()

    # A cast leaves the bytes as they are.
    rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def opened(path: str) -> pa.NativeFile:
    """Random access to a file of any system that Arrow knows."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(unquote(urlparse(path).path))
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


Read = Callable[[int, int], bytes]


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset of a directory entry, those of 32 set bits from its ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            held = [x[0] for x in struct.iter_unpack("<Q", extra[at + 4:at + 4 + n // 8 * 8])]
            return [held.pop(0) if v == 0xFFFFFFFF and held else v for v in values]
        at += 4 + n
    return values


def members(read: Read, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset of its bytes, length) of the stored members of a ZIP file.

    Reads the end record, the ZIP64 end record where there is one, the central
    directory, and the local headers: no member.
    """
    base = max(0, size - 65_557)
    tail = read(base, size - base)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end record: not a ZIP file")
    n, cd_size, cd_at = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        end = read(where, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
        n, cd_size, cd_at = struct.unpack_from("<QQQ", end, 32)
    listing, found, at = read(cd_at, cd_size), {}, 0
    for _ in range(n):
        if listing[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", listing, at + 8)
        packed, full, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", listing, at + 20)
        offset = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46:at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = listing[at + 46 + name_n:at + 46 + name_n + extra_n]
        full, packed, offset = _zip64(extra, [full, packed, offset])
        if method == 0:
            local = read(offset, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            found[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + name_n + extra_n + note_n
    return found


def parse_record(raw: bytes) -> dict:
    """Fields of a WARC record; the payload is None in a revisit."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    name = lambda key: (fields[key][len("<urn:page:"):-1] or None) if key in fields else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(body) != length or payload_digest(body) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its header says")
    return {"page": name("WARC-Record-ID"), "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, "record_type": kind,
            "refers_to": name("WARC-Refers-To"), "payload_bytes": length, "payload_digest": digest, "payload": body if kind == "response" else None}


def records(read: Read, size: int) -> Iterator[dict]:
    """The records that an archive's indexes list, read in ranges of a bounded size."""
    found = members(read, size)
    listed = []
    for name, (at, n) in found.items():
        if name.startswith("indexes/") and name.endswith(".cdxj"):
            for line in read(at, n).decode().splitlines():
                note = json.loads(line.split(" ", 2)[2])
                listed.append((found[note["filename"]][0] + note["offset"], note["length"]))
    listed.sort()
    i = 0
    while i < len(listed):
        lo, hi, j = listed[i][0], listed[i][0], i
        while j < len(listed) and (j == i or listed[j][0] == hi and listed[j][0] + listed[j][1] - lo <= RANGE_BYTES):
            hi = listed[j][0] + listed[j][1]
            j += 1
        got = read(lo, hi - lo)
        for at, n in listed[i:j]:
            yield {"offset": at, "length": n, **parse_record(zlib.decompress(got[at - lo:at - lo + n], 31))}
        i = j


FIELDS = {"page": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "offset": pa.int64(), "length": pa.int64()}
SCHEMA = "page string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, offset bigint, length bigint"


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Every record of the ZIP archives below ``path``: page, url, record_type,
    refers_to, payload_bytes and payload_digest (both of the full payload, in
    revisits too), payload (null in revisits, or with ``payloads`` off), and the
    place in the file. A folder without archives gives no rows.

    Spark lists the files and deals them out by size; a task reads the directory
    and the index of each and then ranges of records. Nothing is extracted.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(name) as f:
                    def read(at: int, n: int, f=f) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    rows, held = [], 0
                    for r in records(read, size):
                        rows.append(r)
                        held += len(r["payload"] or b"") if payloads else 100
                        if not payloads:
                            r["payload"] = None
                        if held > RANGE_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return files.mapInArrow(run, SCHEMA)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in FIELDS.items()], names=list(FIELDS))


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    got = read_archives(spark, path, payloads=False)
    return got.select(F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))
