"""Operator 7: packing by shortest-pack-first over the length histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratolith.storage import cut, own
from .tokens import Encoder, ended, slices

SEQUENCE = 2048
END = 1
#: Parts into which the pieces of each length are dealt to be ranked: so many, and more where a part would have more than RANKED pieces.
SALTS, RANKED = 64, 1 << 16


class Lot(NamedTuple):
    """``each`` pieces of one length in every sequence of a pack: those of rank ``first`` on, sequence by sequence."""

    length: int
    each: int
    first: int


class Pack(NamedTuple):
    """``count`` sequences alike, with ``total`` tokens each."""

    lots: tuple[Lot, ...]
    count: int
    total: int

    def split(self, n: int) -> tuple[Pack, Pack]:
        rest = tuple(lot._replace(first=lot.first + lot.each * n) for lot in self.lots)
        return self._replace(count=n), Pack(rest, self.count - n, self.total)


def _place(histogram: dict[int, int], size: int) -> list[Pack]:
    """Longest first, each length into the shortest packs that have room, as often as they have; new packs where none has.

    A length changes all of a pack, or ends in it: it leaves at most two
    parted packs and a new one.
    """
    by_gap: dict[int, list[Pack]] = {}
    gaps: list[int] = []
    done: list[Pack] = []

    def put(pack: Pack) -> None:
        gap = size - pack.total
        if gap == 0:
            done.append(pack)
        elif pack.count:
            if not by_gap.get(gap):
                insort(gaps, gap)
            by_gap.setdefault(gap, []).append(pack)

    for length in sorted(histogram, reverse=True):
        first, left = 0, histogram[length]
        while left:
            if not gaps or gaps[-1] < length:
                put(Pack((Lot(length, 1, first),), left, length))
                break
            gap = gaps[-1]
            pack = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(bisect_left(gaps, gap))
            each = min(gap // length, left)
            n = min(pack.count, left // each)
            used, rest = pack.split(n)
            put(rest)
            put(Pack((*used.lots, Lot(length, each, first)), n, used.total + each * length))
            first, left = first + each * n, left - each * n
    return done + sorted((p for packs in by_gap.values() for p in packs), key=lambda p: -p.total)


def plan_rows(size: int = SEQUENCE) -> int:
    """The most rows that a plan can have, whatever the histogram.

    Three packs for each length below ``size``, and in each only distinct
    lengths that add up to ``size`` at most, of which there are about the root
    of twice ``size``.
    """
    return 3 * (size - 1) * int((2 * size) ** 0.5)


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, each, first, count, total, at) that place every piece of every length in one stream of tokens.

    The sequences of a pack have ``total`` tokens each and ``each`` pieces of that
    length: the piece of rank r, for the each * count ranks from first on, is number
    j = (r - first) % each of sequence i = (r - first) div each, and begins at the
    token at + i * total + j * length. Full packs come first, so that each of
    their sequences is ``size`` tokens of the stream. The others follow, the
    fullest first: what stays open in one is filled from the next, which cuts
    one piece for each sequence, and only the stream's last sequence is padded.
    """
    rows, begin = [], 0
    for pack in _place({k: n for k, n in histogram.items() if k and n}, size):
        at = begin
        for lot in pack.lots:
            rows.append((lot.length, lot.each, lot.first, pack.count, pack.total, at))
            at += lot.each * lot.length
        begin += pack.count * pack.total
    return rows


def tokenized(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """(doc_id, ids, n, part, before) of every row: its ids with the end id as little-endian 16-bit integers, the task, and the whole sequences of its earlier rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1):
                ids, at = ended(*encoder.encode(batch.column(1)), end)
                data = pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                n = np.diff(at)
                upto = before + np.cumsum(n // size)
                columns = [batch.column(0), data, pa.array(n, pa.int64()), pa.array(np.full(len(n), part), pa.int64()), pa.array(upto - n // size, pa.int64())]
                before = int(upto[-1])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n", "part", "before"])

    rows = own(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(each, "doc_id long, ids binary, n long, part long, before long")


def _ranked(rests: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Add the rank of each row (row, length) among those of its length, from 0; a common length's rows are dealt to many tasks."""
    spark = rests.sparkSession
    # Fewer than SEQUENCE rows.
    salts = F.broadcast(spark.createDataFrame([(k, max(SALTS, -(-n // RANKED))) for k, n in histogram.items()], "length int, salts long"))
    salted = rests.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    return salted.withColumn("within", within).join(first, ["length", "salt"]).select("row", "length", (F.col("before") + F.col("within")).alias("rank"))


def _digests(size: int):
    """A row for each piece of documents (doc_id, ids, n, sequence, at): whole sequences from ``sequence`` on, and the rest at token ``at`` of the stream."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pieces(n: int, sequence: int, at: int | None) -> list[tuple[int, int, int, int]]:
        found = [(k * size, size, sequence + k, 0) for k in range(n // size)]
        if n % size:
            start, offset = n - n % size, at % size
            first = min(n % size, size - offset)
            found.append((start, first, at // size, offset))
            if first < n % size:
                found.append((start + first, n % size - first, at // size + 1, 0))
        return found

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, data, n, sequence, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(data, "<u2").astype("<u4")
                out += [(doc_id, a, k, zlib.crc32(ids[a : a + k].tobytes()), n, s, o) for a, k, s, o in pieces(n, sequence, at)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names)

    return task


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is a document of its own, repeated ids too; null and
    empty texts have the end id only. A document gives as many whole sequences
    as it has; the rests, one for a document, are placed by
    shortest-pack-first, and packs that stay open are laid end to end and cut
    at the sequences' ends, so that at most one sequence is padded. An empty
    table gives an empty result; extra columns are ignored.

    Only the histogram of the rests' lengths (fewer than ``size`` rows) comes to
    the driver, and the plan that goes back has ``plan_rows(size)`` rows at
    most, however many documents there are.
    """
    spark = docs.sparkSession
    rows = cut(tokenized(docs, path, size, end).withColumn("row", F.monotonically_increasing_id()), "tokens")
    rests = rows.select("row", (F.col("n") % size).cast("int").alias("length")).where("length > 0")
    histogram = {r["length"]: r["count"] for r in rests.groupBy("length").count().collect()}
    slots = F.broadcast(spark.createDataFrame(plan(histogram, size), "length int, each long, first long, count long, total long, at long"))
    past = F.col("rank") - F.col("first")
    placed = (
        _ranked(rests, histogram)
        .join(slots, "length")
        .where((past >= 0) & (past < F.col("each") * F.col("count")))
        .select("row", (F.col("at") + F.floor(past / F.col("each")) * F.col("total") + past % F.col("each") * F.col("length")).alias("at"))
    )
    # Whole sequences are numbered behind those of the stream: a row for each task that encoded documents.
    filled = -(-sum(k * n for k, n in histogram.items()) // size)
    earlier = F.sum("wholes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    wholes = rows.groupBy("part").agg(F.sum(F.floor(F.col("n") / size)).alias("wholes")).select("part", (filled + F.coalesce(earlier, F.lit(0))).alias("base"))
    return (
        rows.join(F.broadcast(wholes), "part")
        .select("row", "doc_id", "ids", "n", (F.col("base") + F.col("before")).alias("sequence"))
        .join(placed, "row", "left")
        .select("doc_id", "ids", "n", "sequence", "at")
        .mapInArrow(_digests(size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )
