"""Operator 2: SimHash fingerprints and exact tiled near-duplicate search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolith.operators.components import connected_components
from stratolith.storage import cut, own, small, spread, unused
from .tiles import VISITORS, deal, forest, plan

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Least rows of a block, and meetings of blocks that a task has where there are more of them than tiles.
BLOCK, MEETINGS = 2048, 40
#: Texts (keys of 16 bytes) up to which what is known of them is broadcast to the documents; more are joined by shuffle.
BROADCAST_KEYS = 500_000
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HASHED_AT_ONCE = 1 << 15


def words_of(text: str | None, words: int) -> tuple[bytes, list[int], list[int]]:
    """The lower-cased words of a text, space-joined, and where each shingle begins and ends in them."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not parts:
        return b"", [], []
    width = min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - width + 1]
    return b" ".join(parts), starts.tolist(), ends[width - 1 :].tolist()


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text.

    A-Z are lower-cased, words are runs without ASCII white space. Each
    ``words``-word shingle counts as often as it occurs; a shorter text is one
    shingle; a text without words (or null) has fingerprint 0.
    """
    line, starts, stops = words_of(text, words)
    if not starts:
        return 0
    ones, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), _HASHED_AT_ONCE):
        some = [hashed(line[a:b], seed) for a, b in zip(starts[i : i + _HASHED_AT_ONCE], stops[i : i + _HASHED_AT_ONCE], strict=True)]
        bits = np.unpackbits(np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def row_key(doc_id, text) -> F.Column:
    """16 bytes for a doc_id with a text, so that rows which share an id are told apart; null and empty texts are the same."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return own(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(each, "doc_id long, fp long")


def _tile(fp) -> F.Column:
    """The population counts of the four 16-bit quarters, five bits for each (at most 17**4 tiles)."""
    counts = [(F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(65535)) + 2).cast("int") for i in range(4)]
    return sum((c * (1 << (5 * i)) for i, c in enumerate(counts[1:], 1)), counts[0])


def _steps(radius: int) -> list[int]:
    """Tile numbers that lie within the radius: fingerprints whose quarter counts differ by more in all can't link.

    Of every two opposite steps one is kept, so that each tile pair meets once.
    """
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d > (0, 0, 0, 0)]
    return [sum(x << (5 * i) for i, x in enumerate(d)) for d in steps]


@dataclass
class _Prints:
    """Fingerprints and their representatives."""

    fp: np.ndarray
    rep: np.ndarray

    @classmethod
    def load(cls, parts: list[pa.RecordBatch]) -> _Prints:
        fp, rep = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("fp", "rep"))
        return cls(fp.view(np.uint64), rep)

    def near(self, home: _Prints, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        step = min(256, max(1, (1 << 20) // max(len(home.fp), 1)))
        for i in range(0, len(self.fp), step):
            close = np.bitwise_count(self.fp[i : i + step, None] ^ home.fp[None, :]) <= radius
            # Every member is close to itself.
            for row in np.flatnonzero(close.sum(axis=1) > (self is home)).tolist():
                yield i + row, np.flatnonzero(close[row])


def block_size(counts: DataFrame, steps: list[int], least: int = BLOCK) -> int:
    """Rows of a block for tiles of these sizes (tile, n): ``least``, or as many as leave about ``MEETINGS`` of them for each task.

    A row goes to each part that its tile's visitors are dealt into. Blocks
    that grow with the tiles keep those parts, and so what is shuffled for a
    row, to the root of the number of tasks, however many rows there are.
    """
    moved = counts.withColumn("step", F.explode(F.array(*[F.lit(x).cast("long") for x in [0, *steps]]))).withColumn("to", F.col("tile") + F.col("step"))
    met = moved.groupBy("to").agg(F.max(F.when(F.col("step") == 0, F.col("n"))).alias("own"), F.sum("n").alias("all"))
    pairs = met.agg(F.sum(F.col("own").cast("double") * F.col("all"))).first()[0] or 0.0
    return max(least, math.ceil(math.sqrt(pairs / (VISITORS * MEETINGS * spread(counts)))))


def near_links(reps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all representatives within ``radius`` bits, directly or by others.

    ``reps`` has one row (fp, rep) for each distinct fingerprint. The search is
    exact: every two fingerprints within the radius meet in one task, where
    exclusive-or and bit counts compare whole blocks (of ``block`` rows or
    more, see ``block_size``); tiles whose population counts differ beyond the
    radius are never sent to each other. A task returns a spanning forest of
    what it found, not all pairs.
    """
    return dealt(reps, radius, block).mapInArrow(forest(_Prints.load, partial(_Prints.near, radius=radius)), "a long, b long")


def dealt(reps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """The rows of ``near_links`` as they are dealt to tasks."""
    steps = _steps(radius)
    tiled = reps.withColumn("tile", _tile(F.col("fp")).cast("long"))
    # At most 17**4 = 83,521 rows, however many documents there are.
    counts = cut(tiled.groupBy("tile").agg(F.count("*").alias("n")), "tiles")
    size = block_size(counts, steps, block)
    sizes = F.broadcast(plan(counts.select("tile", (F.col("n") / size).alias("need")), steps))
    sent = tiled.withColumn("visits", F.explode(F.array(*[F.lit(x).cast("long") for x in [0, *steps]]))).withColumn("tile", F.col("tile") + F.col("visits"))
    return deal(sent.join(sizes, "tile"), ["fp", "rep"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable by links between fingerprints
    that differ in at most ``radius`` bits. Equal fingerprints are one
    representative, so thousands of copies cost one comparison. Rows with a
    null doc_id are returned; they don't link other fingerprints, and their
    component_id is that of documents with the same fingerprint, else null.
    Null texts count as empty; repeated rows stay repeated; extra columns are
    dropped; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "reps")
    found = connected_components(near_links(reps, radius, block), "a", "b")
    named = cut(reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "named")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of fingerprints that hang together within ``radius`` bits, with all columns of ``docs`` (see ``one_of_each``).

    Rows without a doc_id stay.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(3).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps)], ["doc_id", "key", "chars", "fp"])

    named = docs.where("doc_id is not null")
    rows = cut(keyed(named).mapInArrow(each, "doc_id long, key binary, chars int, fp long"), "fingerprints")
    reps = cut(rows.select("fp").distinct().withColumn("rep", F.monotonically_increasing_id()), "reps")
    found = connected_components(near_links(reps, radius), "a", "b")
    groups = cut(reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("group")), "named")
    return one_of_each(named, rows.join(groups, "fp")).unionByName(docs.where("doc_id is null"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, chars, text) of every row: its ``row_key``, and its text's length (-1 for null)."""
    key, chars = row_key(docs["doc_id"], docs["text"]), F.coalesce(F.length(docs["text"]), F.lit(-1))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), key.alias("key"), chars.alias("chars"), docs["text"].alias("text"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group of ``groups`` (doc_id, key, chars, group; a row for each of ``docs``), with all columns of ``docs``.

    Rows are judged by their texts, whatever ids they share: of a group the
    row with the smallest doc_id stays, of several the one with the longest
    text. Rows without a doc_id stay only where their group has none with one.
    Of repeated rows one stays.
    """
    names = docs.columns
    texts = cut(groups.groupBy("key").agg(*[F.min(c).alias(c) for c in ("group", "doc_id", "chars")], F.count("*").alias("n")), "texts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", (-F.col("chars")).alias("short"), "key", "n"))
    key = unused(docs, "key")
    best = cut(texts.groupBy("group").agg(first.alias("best")).select(F.col("best.key").alias("key"), F.col("best.n").alias("copies")), "best")
    # What goes is looked up, not what stays: where that is little, no text leaves its task.
    gone = cut(texts.join(best.where("copies = 1"), "key", "left_anti").select(F.col("key").alias(key)), "gone")
    rows = docs.withColumn(key, row_key(docs["doc_id"], docs["text"]))
    kept = rows.join(small(gone, BROADCAST_KEYS), key, "left_anti").select(*names)
    again = cut(best.where("copies > 1").select(F.col("key").alias(key)), "again")
    if again.isEmpty():
        return kept
    # Aggregated, not ranked: every task leaves one of the repeated rows before they meet.
    one = F.max_by(F.struct(*names), F.col("text").isNotNull()).alias("row")
    return kept.unionByName(rows.join(small(again, BROADCAST_KEYS), key, "left_semi").groupBy(key).agg(one).select("row.*"))
