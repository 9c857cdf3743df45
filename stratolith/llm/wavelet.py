"""Operator 10: token ids in files that each hold a wavelet matrix."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from io import BytesIO
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratolith.storage import cut, new_path, own, spread
from .tokens import Encoder, ended, slices

END = 0
#: Ids in a shard, unless one document alone has more.
SHARD_IDS = 1 << 20
#: Bits of a block, and blocks that an open file keeps.
BLOCK_BITS, BLOCKS_KEPT = 1 << 16, 64
#: Ids that are put back in their places at once.
_STEP = 1 << 15
_MAGIC = b"WVM2"
#: Ids, documents, planes, entries of each plane's directory, bytes of the documents' part.
_HEAD = struct.Struct("<QQIIQ")


class WaveletMatrix:
    """Bit-planes of a sequence of ids, highest bit first, each stably parted by its bit for the next.

    Planes are cut into blocks, and a directory holds the ones before each, so
    access, counting and lookup take a block or two of each plane (Claude,
    Navarro and Ordonez 2015). A file holds the directory and its blocks, each
    compressed on its own; one that is opened reads only the blocks it needs.
    """

    def __init__(self, n: int, ones: np.ndarray, block: Callable[[int, int], np.ndarray]) -> None:
        self.n, self.ones, self.block = n, ones, block  # ones: planes x (blocks + 1); a block's bytes are in little bit order
        self.bits = len(ones)
        self.zeros = [n - int(row[-1]) for row in ones]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        row = np.ascontiguousarray(ids)
        bits = bits or max(1, int(row.max(initial=0)).bit_length())
        planes, step = [], BLOCK_BITS // 8
        for k in reversed(range(bits)):
            bit = (row >> k & 1).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            # Rows by their numbers: masks of bits without order take more than twice the time.
            row = np.concatenate([row.take(np.flatnonzero(~bit)), row.take(np.flatnonzero(bit))])
        ones = np.zeros((bits, -(-len(ids) // BLOCK_BITS) + 1), np.int64)
        for k, plane in enumerate(planes):
            if len(plane):
                ones[k, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), step), dtype=np.int64))
        return cls(len(ids), ones, lambda k, b: planes[k][b * step : (b + 1) * step])

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        b, rest = divmod(i, BLOCK_BITS)
        count = int(self.ones[k][b])
        if rest:
            data = self.block(k, b)
            count += int(np.bitwise_count(data[: rest // 8]).sum(dtype=np.int64))
            count += int(data[rest // 8] & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0
        return count

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            b, rest = divmod(i, BLOCK_BITS)
            bit = int(self.block(k, b)[rest // 8] >> (rest % 8) & 1)
            ones = self._rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        for k in range(self.bits):
            p, q = self._rank1(k, a), self._rank1(k, b)
            if value >> (self.bits - 1 - k) & 1:
                a, b = self.zeros[k] + p, self.zeros[k] + q
            else:
                a, b = a - p, b - q
        return a, b

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of ``value`` from a to b."""
        if value >> self.bits:
            return 0
        a, b = self._range(value, a, self.n if b is None else b)
        return b - a

    def _select(self, k: int, bit: int, j: int) -> int:
        """Where bit number j (from 0) of that kind stands in plane k."""
        before = self.ones[k] if bit else np.minimum(np.arange(len(self.ones[k])) * BLOCK_BITS, self.n) - self.ones[k]
        b = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self.block(k, b), bitorder="little")[: self.n - b * BLOCK_BITS]
        return b * BLOCK_BITS + int(np.flatnonzero(bits == bit)[j - int(before[b])])

    def lookup(self, value: int, j: int) -> int:
        """Where occurrence number j (from 0) of ``value`` stands."""
        if not 0 <= j < self.count(value):
            raise IndexError(j)
        i = self._range(value, 0, self.n)[0] + j
        for k in reversed(range(self.bits)):
            bit = value >> (self.bits - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, by undoing the parting plane by plane from the lowest bit."""
        row = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for k in reversed(range(self.bits)):
            plane = np.concatenate([np.empty(0, np.uint8), *[self.block(k, b) for b in range(self.ones.shape[1] - 1)]])
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            back, zero, one = np.empty_like(row), 0, self.zeros[k]
            row[one:] |= row.dtype.type(1 << (self.bits - 1 - k))
            # In steps whose numbers of rows stay in a core's cache.
            for i in range(0, self.n, _STEP):
                some, part = bit[i : i + _STEP], back[i : i + _STEP]
                zeros, ones = np.flatnonzero(~some), np.flatnonzero(some)
                part[zeros], part[ones] = row[zero : zero + len(zeros)], row[one : one + len(ones)]
                zero, one = zero + len(zeros), one + len(ones)
            row = back
        return row

    def to_bytes(self, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
        """The file: head, ones before each block, compressed bytes of each block, documents, then the blocks plane by plane."""
        zip_ = zstandard.ZstdCompressor(level=1).compress
        known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
        docs = zip_(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<i8").tobytes() + known.tobytes())
        blocks = [zip_(self.block(k, b).tobytes()) for k in range(self.bits) for b in range(self.ones.shape[1] - 1)]
        head = _MAGIC + _HEAD.pack(self.n, len(doc_ids), *self.ones.shape, len(docs))
        return b"".join([head, self.ones.astype("<i8").tobytes(), np.array(list(map(len, blocks)), "<u4").tobytes(), docs, *blocks])

    @classmethod
    def open(cls, file: BinaryIO) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
        """(the matrix, doc ids, lengths) of a file; blocks are read when they are asked for."""

        def read(at: int, n: int) -> bytes:
            file.seek(at)
            return file.read(n)

        head = read(0, len(_MAGIC) + _HEAD.size)
        if head[: len(_MAGIC)] != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, docs, planes, width, size = _HEAD.unpack_from(head, len(_MAGIC))
        at, unzip = len(head), zstandard.ZstdDecompressor().decompress
        directory = read(at, planes * (8 * width + 4 * (width - 1)))
        ones = np.frombuffer(directory, "<i8", planes * width).reshape(planes, width)
        at += len(directory)
        raw = unzip(read(at, size))
        ids, lengths, known = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "<i8", docs, 8 * docs), np.frombuffer(raw, np.uint8, docs, 16 * docs)
        ends = at + size + np.cumsum([0, *np.frombuffer(directory, "<u4", offset=8 * planes * width).tolist()])

        @lru_cache(BLOCKS_KEPT)
        def block(k: int, b: int) -> np.ndarray:
            i = k * (width - 1) + b
            return np.frombuffer(unzip(read(int(ends[i]), int(ends[i + 1] - ends[i]))), np.uint8)

        return cls(n, ones, block), [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], lengths


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Write all documents in ascending doc_id order; (part, shard, path, ids) of every file.

    A task writes files of names of its own, so one that runs again leaves
    its first files unused; only the returned paths count.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        store, base = fs.FileSystem.from_uri(folder)
        doc_ids: list[int | None] = []
        rows: list[np.ndarray] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard
            path = f"{base}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wvm"
            ids = np.concatenate(rows)
            with store.open_output_stream(path) as out:
                out.write(WaveletMatrix.build(ids).to_bytes(doc_ids, np.array(sizes)))
            done = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "shard": pa.array([shard], pa.int64()), "path": [path], "ids": pa.array([len(ids)], pa.int64())})
            shard += 1
            for x in (doc_ids, rows, sizes):
                x.clear()
            return done

        for whole in batches:
            for batch in slices(whole, 1):
                ids, at = ended(*encoder.encode(batch.column(1)), end)
                for k, doc_id in enumerate(batch.column(0).to_pylist()):
                    if rows and sum(sizes) + at[k + 1] - at[k] > SHARD_IDS:
                        yield flush()
                    doc_ids.append(doc_id)
                    rows.append(ids[at[k] : at[k + 1]])
                    sizes.append(int(at[k + 1] - at[k]))
        if rows:
            yield flush()

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    rows = own(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(each, "part long, shard long, path string, ids long")


def with_starts(files: DataFrame) -> DataFrame:
    """Add how many ids all files before each hold: sums over parts first, then within them."""
    sums = files.groupBy("part").agg(F.sum("ids").alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("inside", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part").select("path", (F.col("base") + F.col("inside")).alias("start"))


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files (path, start)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # All ids are wanted here, so the file comes in one read.
                with store.open_input_file(path) as file:
                    matrix, doc_ids, lengths = WaveletMatrix.open(BytesIO(file.read()))
                ids, ends = matrix.decode().astype("<u4"), np.cumsum(lengths)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return files.repartition(spread(files), "path").mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write ``docs`` as wavelet matrix files in the shared folder and read them back, per document.

    Rows without a doc_id come first; rows that share one are ordered by a
    hash of their texts. Null and empty texts have the end id only. An empty
    table gives an empty result; extra columns are ignored.
    """
    folder = new_path(docs.sparkSession, "ids")
    files = cut(write_shards(docs, tokenizer, folder, end), "files")
    return read_shards(with_starts(files), folder)
