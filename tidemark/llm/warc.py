"""Web archives in ZIP packages: written with stored members, read by their central directories and record ranges.

A package holds ``archive/data.warc.gz`` (records, one gzip member each) and ``indexes/index.jsonl`` (one line per record with its
range in the archive member). Both are stored, not compressed again, so a record is read by its range alone.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Payloads from this many bytes on are kept once.
MIN_SHARED = 100
_SALTS = 64


def open_input(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def directory(f, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, offset of the local header, stored size) of every member, by the end record, ZIP64's if there is one."""
    tail = f.read_at(min(size, 65_557), max(0, size - 65_557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<10xHII", tail[at : at + 20])
    locator = tail[at - 20 : at]
    if at >= 20 and locator[:4] == b"PK\x06\x07":
        where = struct.unpack("<8xQ", locator[:16])[0]
        n, length, start = struct.unpack("<32xQQQ", f.read_at(56, where))
    raw, out, at = f.read_at(length, start), [], 0
    for _ in range(n):
        head = struct.unpack("<4s4xHH4xIIIHHH8xI", raw[at : at + 46])
        sign, _, method, _, packed, full, names, extras, comments, offset = head
        if sign != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        name = raw[at + 46 : at + 46 + names].decode()
        extra, k = raw[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, n_bytes = struct.unpack("<HH", extra[k : k + 4])
            if kind == 1:  # ZIP64: values in a fixed order, those only that didn't fit
                values = iter(struct.unpack(f"<{n_bytes // 8}Q", extra[k + 4 : k + 4 + n_bytes // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            k += 4 + n_bytes
        out.append((name, method, offset, packed))
        at += 46 + names + extras + comments
    return out


def member_range(f, offset: int) -> int:
    """Where a member's bytes begin: after its local header."""
    sign, names, extras = struct.unpack("<4s22xHH", f.read_at(30, offset))
    if sign != b"PK\x03\x04":
        raise ValueError("bad local header")
    return offset + 30 + names + extras


class _Counted(io.RawIOBase):
    """A stream that can only be written, which counts its bytes."""

    def __init__(self, to):
        self.to, self.n = to, 0

    def writable(self):
        return True

    def write(self, data):
        self.to.write(data)
        self.n += len(data)
        return len(data)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has no block but the digest and length of its payload."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = payload if refers_to is None else b""
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def gzip_member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: Bytes of records after which a package is closed and the next begun, which bounds what its index takes while it is written.
PACKAGE_BYTES = 1 << 30


class _Package:
    """One ZIP package while it is written."""

    def __init__(self, path: str):
        store, where = fs.FileSystem.from_uri(path)
        store.create_dir(where.rpartition("/")[0], recursive=True)
        self.path, self.stream, self.index, self.at = path, store.open_output_stream(where), io.BytesIO(), 0
        self.zip = zipfile.ZipFile(_Counted(self.stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, raw: bytes) -> None:
        self.data.write(raw)
        self.index.write(json.dumps({"offset": self.at, "length": len(raw)}).encode() + b"\n")
        self.at += len(raw)

    def close(self) -> pa.RecordBatch:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue())
        self.zip.close()
        self.stream.close()
        return pa.record_batch([pa.array([self.path])], names=["path"])


def write_archives(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages of pages (page_id, url, payload, digest, refers_to), one or more for each partition with rows; returns their paths (column path).

    A task writes to names of its own and reports each when it is complete, so that a task that ran twice counts once.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/tidemark-warc-{uuid.uuid4().hex}"

    def run(batches):
        package = None
        for b in batches:
            for page in zip(*(c.to_pylist() for c in b.columns)):
                package = package or _Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                package.add(gzip_member(record(*page)))
                if package.at >= package_bytes:
                    yield package.close()
                    package = None
        if package is not None:
            yield package.close()

    return materialize(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string"))


def member_lines(f, start: int, size: int, chunk: int = 1 << 20):
    """The lines of a stored member, read chunk by chunk."""
    rest = b""
    for at in range(0, size, chunk):
        *lines, rest = (rest + f.read_at(min(chunk, size - at), start + at)).split(b"\n")
        yield from lines
    if rest:
        yield rest


def read_index(paths: DataFrame) -> DataFrame:
    """path, offset (in the package) and length of every record of the packages, from their directories and index members."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with open_input(path) as f:
                    members = {name: (method, offset, size) for name, method, offset, size in directory(f, f.size())}
                    if any(method for method, _, _ in members.values()):
                        raise ValueError(f"{path}: members must be stored")
                    base, lines = member_range(f, members[DATA][1]), member_lines(f, member_range(f, members[INDEX][1]), members[INDEX][2])
                    while rows := [json.loads(x) for x in islice(lines, 10_000)]:
                        yield pa.record_batch([pa.array([path] * len(rows)), pa.array([base + r["offset"] for r in rows], pa.int64()), pa.array([r["length"] for r in rows], pa.int64())], names=["path", "offset", "length"])

    return paths.select("path").mapInArrow(run, "path string, offset long, length long")


def by_ranges(index: DataFrame, task_bytes: int = 1 << 24) -> DataFrame:
    """The index dealt out to tasks that each read about ``task_bytes`` of a package's records, in order; the number of tasks comes from the records' bytes."""
    total = index.agg(F.sum("length")).first()[0] or 0
    least = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // task_bytes), min(least, total // (1 << 18)))
    return index.repartition(int(tasks), "path", F.expr(f"offset div {min(task_bytes, max(1, total // tasks))}")).sortWithinPartitions("path", "offset")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Range-reads every record; the digest and length of a response are taken of its bytes, those of a revisit from its header."""

    def page(text):
        digits = text.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches):
        at, f = None, None
        for b in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if path != at:
                    if f:
                        f.close()
                    at, f = path, open_input(path)
                fields, block = parse_record(zlib.decompress(f.read_at(length, offset), 31))
                again = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if again else hashlib.sha256(block).hexdigest()
                if digest != fields["WARC-Payload-Digest"].removeprefix("sha256:"):
                    raise ValueError(f"{path}: the record at {offset} doesn't match its digest")
                rows.append((page(fields["WARC-Record-ID"]), int(fields["WARC-Payload-Length"]) if again else len(block), digest, fields["WARC-Type"], page(fields["WARC-Refers-To"]) if again else None, block if payloads and not again else None))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if f:
            f.close()

    return index.select("path", "offset", "length").mapInArrow(run, RECORD)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to: of equal payloads of MIN_SHARED bytes or more, all but the smallest page_id refer to that one.

    Counts come first, so only digests that occur twice are joined; the join is salted, so one payload may hold a third of all pages. Payloads
    move once, by page_id.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keys = src.where(F.length("payload") >= MIN_SHARED).select("page_id", F.sha2("payload", 256).alias("digest"))
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = first.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])))
    later = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")).join(first, ["digest", "salt"]).where("page_id > refers_to")
    later = materialize(later.select(F.col("page_id").alias("id"), F.col("digest").alias("same"), F.col("refers_to")).distinct())
    own = src.withColumn("digest", F.sha2("payload", 256))
    return own.join(later, (own["page_id"] == later["id"]) & (own["digest"] == later["same"]), "left").select("page_id", "url", "payload", "digest", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives all pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type and refers_to of every record.

    A null html is an empty payload. Smaller payloads, and pages without an id, are responses each. Repeated rows of the smallest page_id are
    all responses. No rows give no archives and no rows; other columns are ignored.
    """
    paths = write_archives(with_revisits(pages))
    index = materialize(read_index(paths.repartition("path")))
    return read_records(by_ranges(index), payloads=False).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""
