"""Operator 6: WARC records in ZIP-packaged archives, written and range-read."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolith.storage import cut, new_path, spread

#: Payloads shorter than this are always written whole.
REVISIT_BYTES = 1000
#: Bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Records, and bytes of them after which no more follow, that are read by one request.
READ_TOGETHER, READ_BYTES = 500, 8 << 20
_WARC, _INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_LOCAL, _CENTRAL, _END, _END64, _FIND64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_PARTS = pa.list_(pa.struct([("at", pa.int64()), ("bytes", pa.int64())]))
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


class Member(NamedTuple):
    """A file in a ZIP package: where its bytes begin, and how many there are."""

    name: str
    method: int
    offset: int
    size: int


class StoredZip:
    """Writes a package of stored members one after another; ZIP64 fields are always there."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, begin = name.encode(), zlib.crc32(data), self.at
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        self._put(_LOCAL + struct.pack("<5H3I2H", 45, 0, 0, 0, 33, crc, _MAX32, _MAX32, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, crc, len(data), begin))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, at in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(_CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 0, 0, 0, 33, crc, _MAX32, _MAX32, len(raw), len(extra), 0, 0, 0, 0, _MAX32) + raw + extra)
        size, end = self.at - begin, self.at
        n = len(self.entries)
        self._put(_END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, size, begin))
        self._put(_FIND64 + struct.pack("<IQI", 0, end, 1))
        self._put(_END + struct.pack("<4H2IH", 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0))


class ZipReader:
    """Finds the members of a package by its directories, without unpacking it."""

    def __init__(self, file: BinaryIO, size: int) -> None:
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def members(self) -> dict[str, Member]:
        """Parse the end record, the ZIP64 one where its fields point there, and the central directory."""
        tail_at = max(0, self.size - 22 - _MAX16)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(_END)
        if at < 0:
            raise ValueError("no ZIP end record")
        _, _, _, n, size, begin, _ = struct.unpack_from("<4H2IH", tail, at + 4)
        if n == _MAX16 or size == _MAX32 or begin == _MAX32:
            place = self.read(tail_at + at - 20, 20)
            if place[:4] != _FIND64:
                raise ValueError("no ZIP64 locator")
            end64 = self.read(struct.unpack_from("<IQ", place, 4)[1], 56)
            if end64[:4] != _END64:
                raise ValueError("no ZIP64 end record")
            n, size, begin = struct.unpack_from("<3Q", end64, 32)
        directory, at, found = self.read(begin, size), 0, {}
        for _ in range(n):
            if directory[at : at + 4] != _CENTRAL:
                raise ValueError("bad central directory")
            _, _, _, method, _, _, _, packed, full, names, extras, notes, _, _, _, local = struct.unpack_from("<6H3I5H2I", directory, at + 4)
            name = directory[at + 46 : at + 46 + names].decode()
            extra, i = directory[at + 46 + names : at + 46 + names + extras], 0
            while i + 4 <= len(extra):
                kind, length = struct.unpack_from("<2H", extra, i)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, i + 4))
                    full = next(wide) if full == _MAX32 else full
                    packed = next(wide) if packed == _MAX32 else packed
                    local = next(wide) if local == _MAX32 else local
                i += 4 + length
            head = self.read(local, 30)
            if head[:4] != _LOCAL:
                raise ValueError("bad local header")
            found[name] = Member(name, method, local + 30 + sum(struct.unpack_from("<2H", head, 26)), packed)
            at += 46 + names + extras + notes
        return found

    def stored(self, suffix: str) -> Member:
        """The one stored member of that ending."""
        found = [m for m in self.members().values() if m.name.endswith(suffix)]
        if len(found) != 1 or found[0].method:
            raise ValueError(f"no stored {suffix}")
        return found[0]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a response or revisit record. A revisit has the HTTP head and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
    return zipped.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + zipped.flush()


def parse(member: bytes) -> dict:
    """Of a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (None for a revisit)."""
    import hashlib

    raw = zlib.decompress(member, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _decided(pages: DataFrame) -> DataFrame:
    """page_id, digest, size, keeper of each row's payload; keeper is null where the row is written whole."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("size"))
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    # A written table, so that the join deals both sides itself and Spark can split a very common payload.
    shared = cut(groups.select("digest", "keeper"), "payloads")
    return rows.join(shared, "digest").where("page_id is null or page_id <> keeper").select("page_id", "digest", "keeper").distinct()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row of (page_id, url, html) as a record; (path, records, parts) of each archive.

    A part is the place and the bytes of the index lines of records that are
    read together.

    Of rows with equal payloads of 1,000 bytes or more the one with the
    largest page_id is a response, and the others revisit it; copies of that
    very row are responses too. Null html is an empty payload; rows without a
    page_id are records without a number.
    """
    pages = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    decided = cut(_decided(pages).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "keeper"), "revisits")
    rows = pages.withColumn("digest", F.sha1(payload))
    rows = rows.join(decided, rows.page_id.eqNullSafe(decided.p) & (rows.digest == decided.d), "left").select("page_id", "url", "digest", "keeper", "html")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        data, index = bytearray(), []

        def parts() -> list[dict]:
            found, at, records, begun = [], 0, 0, 0
            for line in index:
                begins = int(line.split(" ")[1])
                if not found or records == READ_TOGETHER or begins - begun >= READ_BYTES:
                    found.append({"at": at, "bytes": 0})
                    records, begun = 0, begins
                found[-1]["bytes"] += len(line)
                at, records = at + len(line), records + 1
            return found

        def flush() -> pa.RecordBatch:
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as out:
                package = StoredZip(out)
                package.add(_WARC, bytes(data))
                package.add(_INDEX, "".join(index).encode())
                package.close()
            done = pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(index)], pa.int64()), "parts": pa.array([parts()], _PARTS)})
            data.clear()
            index.clear()
            return done

        for batch in batches:
            for page_id, url, digest, keeper, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (html or "").encode("utf-8", "surrogatepass")
                one = record(page_id, url, body, digest, len(body), keeper, keeper is not None)
                index.append(f"{'' if page_id is None else page_id} {len(data)} {len(one)}\n")
                data += one
                if len(data) >= archive_bytes:
                    yield flush()
        if index:
            yield flush()

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return rows.mapInArrow(each, "path string, records long, parts array<struct<at:bigint,bytes:bigint>>")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives (path, parts): parse() without url and payload, by range reads.

    A task that reads a part looks up the members in the package's directory,
    reads the part's index lines, and then the records that they name, which
    stand in a row, by one request.
    """
    names = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for path, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = store.get_file_info(path).size
                with store.open_input_file(path) as file:
                    package = ZipReader(file, size)
                    index, warc = package.stored(".cdx"), package.stored(".warc.gz")
                    places = [tuple(map(int, line.split(" ")[1:])) for line in package.read(index.offset + at, n).decode().splitlines()]
                    begin, end = places[0][0], sum(places[-1])
                    data = package.read(warc.offset + begin, end - begin)
                rows = [parse(data[a - begin : a - begin + k]) for a, k in places]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in names.items()], list(names))

    parts = archives.select("path", F.inline("parts"))
    return parts.repartition(spread(parts), "path", "at").mapInArrow(each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back, a row for each record.

    Repeated rows make repeated records; an empty table gives an empty
    result; extra columns are ignored.
    """
    folder = new_path(pages.sparkSession, "archives")
    archives = cut(write_archives(pages, folder, archive_bytes), "archives")
    return read_archives(archives, folder)
