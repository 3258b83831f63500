"""Web archives in ZIP packages: writer, and a reader that never extracts.

A package holds two stored members: ``archive/data.warc.gz``, one gzip member per
record, and ``indexes/index.cdxj``, a line per record with place and length. The
reader parses the end record, the ZIP64 end record and the central directory,
finds where the stored members begin, reads the index in pieces, and fetches
records by ranges of a few megabytes, which are dealt out as tasks of their own.

Packages go to the shared folder through pyarrow's file systems, one or more per
task; a task names its files anew each time, and only files in the written list
of packages count, so a repeated task leaves no double record.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, the one with the
largest page id is a response, the others are revisits that carry no payload.

Defined results: a null page is an empty payload; a null url is an empty one; a
null page id reads back as null and is a revisit where a page with an id has its
payload; rows that repeat the largest id are all responses; an empty table gives
no packages and no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygraph.session import fresh_path, written

MIN_REVISIT = 1000
#: A package is closed beyond this size; records are read in ranges of about this size.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Ranges that a reading task takes one after the other, where there are more than cores.
RANGES_A_TASK = 16
#: Rows up to which the table of repeated payloads may be broadcast.
BROADCAST_ROWS = 200_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class Package:
    """Streaming writer of a ZIP64 package of stored members."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        self.name, self.start, self.crc = name.encode(), self.at, 0
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(self.name), 0) + self.name)
        self.begin = self.at

    def write(self, data: bytes) -> int:
        place = self.at - self.begin
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)
        return place

    def close_member(self) -> None:
        size = self.at - self.begin
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, size, size))
        extra = struct.pack("<HHQQQ", 1, 24, size, size, self.start)
        self.entries.append(_ENTRY + struct.pack(
            "<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, self.crc, _MAX32, _MAX32, len(self.name), len(extra), 0, 0, 0, 0, _MAX32) + self.name + extra)

    def close(self) -> None:
        start, n = self.at, len(self.entries)
        self._put(b"".join(self.entries))
        size, end = self.at - start, self.at
        self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(_LOCATOR + struct.pack("<IQI", 0, end, 1))
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0))


def _at(file, place: int, size: int) -> bytes:
    file.seek(place)
    return file.read(size)


def directory(file, length: int) -> dict[str, tuple[int, int]]:
    """Members of a package as name -> (first byte of the data, size); only stored members are given."""
    tail_at = max(0, length - 66_000)
    tail = _at(file, tail_at, length - tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("no end of central directory")
    n, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if (n == _MAX16 or _MAX32 in (size, start)) and tail[end - 20 : end - 16] == _LOCATOR:
        (at64,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        record = _at(file, at64, 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end record")
        n, size, start = struct.unpack("<QQQ", record[32:56])
    entries, at, found = _at(file, start, size), 0, {}
    for _ in range(n):
        if entries[at : at + 4] != _ENTRY:
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", entries[at + 10 : at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", entries[at + 20 : at + 34])
        (local,) = struct.unpack("<I", entries[at + 42 : at + 46])
        name = entries[at + 46 : at + 46 + n_name].decode()
        extra = entries[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, k = struct.unpack("<HH", extra[:4])
            if kind == 1:  # values that did not fit, in this order
                values = iter(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                plain = next(values) if plain == _MAX32 else plain
                packed = next(values) if packed == _MAX32 else packed
                local = next(values) if local == _MAX32 else local
            extra = extra[4 + k :]
        at += 46 + n_name + n_extra + n_comment
        if method == 0:
            head = _at(file, local, 30)
            if head[:4] != _LOCAL:
                raise ValueError("broken local header")
            a, b = struct.unpack("<HH", head[26:30])
            found[name] = (local + 30 + a + b, packed)
    return found


def _header(lines: list[tuple[str, str]], first: str) -> bytes:
    clean = lambda v: "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in v)
    return "".join([f"{first}\r\n", *[f"{k}: {clean(v)}\r\n" for k, v in lines], "\r\n"]).encode()


def _urn(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record_bytes(page, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzipped WARC record; a revisit keeps the HTTP header of its page, with the length of the full payload."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http + (payload if refers_to is None else b"")
    revisit = [] if refers_to is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head = _header([
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        *revisit, ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], "WARC/1.1")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def parse_record(data: bytes) -> dict:
    """Type, page, reference, digest, full payload length and payload of one gzipped record, checked against its digest."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    warc = _fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    number = lambda urn: int(urn[10:-1]) if urn and urn[10:-1] else None
    response = warc["warc-type"] == "response"
    if response and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {warc['warc-record-id']} does not fit its digest")
    return {
        "page_id": number(warc["warc-record-id"]), "payload_bytes": len(payload) if response else int(_fields(http)["content-length"]),
        "payload_digest": digest, "record_type": warc["warc-type"], "refers_to": number(warc.get("warc-refers-to", "")), "payload": payload}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        package = out = None
        index: list[str] = []

        def finish() -> pa.RecordBatch:
            package.close_member()
            package.open(INDEX)
            for at in range(0, len(index), 1000):
                package.write("".join(index[at : at + 1000]).encode())
            package.close_member()
            package.close()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(index)], "bytes": [package.at]}, schema=_PACKAGES)

        for batch in batches:
            for row in batch.to_pylist():
                if package is None:
                    name = f"pages-{uuid.uuid4().hex}.wacz"
                    path, index = f"{folder}/{name}", []
                    out = system.open_output_stream(f"{base}/{name}")
                    package = Package(out)
                    package.open(DATA)
                data = record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                place = package.write(data)
                index.append(f"{row['page_id']} {DATE} {json.dumps({'offset': place, 'length': len(data), 'digest': row['digest']})}\n")
                if package.at >= PACKAGE_BYTES:
                    yield finish()
                    package = None
        if package is not None:
            yield finish()

    return run


_PACKAGES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_packages(pages: DataFrame) -> DataFrame:
    """Writes all pages (page_id, url, html) as packages; returns the list ``path, records, bytes``."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    repeated = written(rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(
        F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1 AND largest IS NOT NULL").drop("n"), "repeated")
    small = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = rows.join(F.broadcast(repeated) if small else repeated, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when((F.col("size") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))
    folder = fresh_path(pages.sparkSession, "packages")
    return written(marked.mapInArrow(_writer(folder), "path string, records long, bytes long"), "package-list")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of neighbouring records of each package, from its directory and index."""
    kind = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, name = file_system(path)
            with system.open_input_file(name) as file:
                members = directory(file, file.size())
                data, (at, left), rest = members[DATA][0], members[INDEX], b""
                start, end, lengths, rows = None, 0, [], []
                while left or rest:
                    piece = _at(file, at, min(left, 1 << 20))
                    at, left = at + len(piece), left - len(piece)
                    *lines, rest = (rest + piece).split(b"\n")
                    for line in lines:
                        entry = json.loads(line[line.index(b"{") :])
                        if start is not None and (entry["offset"] != end or end - start > RANGE_BYTES):
                            rows.append((path, data + start, lengths))
                            start = None
                        if start is None:
                            start, lengths = entry["offset"], []
                        lengths.append(entry["length"])
                        end = entry["offset"] + entry["length"]
                    if not left:
                        break
                if start is not None:
                    rows.append((path, data + start, lengths))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)] if rows else [pa.array([], f.type) for f in kind], schema=kind)


def _reader(with_payload: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = file_system(row["path"])
                with system.open_input_file(name) as file:
                    data, at, records = _at(file, row["start"], sum(row["lengths"])), 0, []
                for length in row["lengths"]:
                    records.append(parse_record(data[at : at + length]))
                    at += length
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return run


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the listed packages, read by ranges: ids, digest, type and, if wanted, the payload."""
    cores = packages.sparkSession.sparkContext.defaultParallelism
    spread = lambda n, share: max(1, min(n, max(cores, n // share)))  # a given number of tasks is not merged for the few bytes of their rows
    ranges = written(packages.repartition(spread(packages.count(), 4), "path").mapInArrow(_ranges, "path string, start long, lengths array<long>"), "ranges")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return ranges.repartition(spread(ranges.count(), RANGES_A_TASK), "path", "start").mapInArrow(_reader(with_payload), schema)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All of ``pages`` written to packages and read back."""
    return read_packages(write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet")))


QUERIES = {"op3_warc": op3_warc}
ORACLE = {"op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
r AS (SELECT digest, max(page_id) AS largest FROM p WHERE n >= {MIN_REVISIT} GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM p LEFT JOIN r USING (digest)
"""}
