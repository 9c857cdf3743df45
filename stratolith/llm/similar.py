"""Operator 2 at a shingle similarity: 128-bit SimHash fingerprints propose pairs, exact shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolith.operators.components import connected_components
from stratolith.storage import cut, small, spread
from .simhash import BROADCAST_KEYS, SEED, keyed, words_of
from .tiles import deal, forest, plan

WORDS = 5
SIMILARITY = 0.8
#: Sets of up to FEW shingles have noisier fingerprints, as majorities of few hashes are.
FEW = 16
#: Differing bits within which a pair is looked at, for (sets of up to FEW, larger sets): of all 128, and of the first 64.
#: Pairs at a similarity of 0.8 differ in 24 +- 4.4 and 19.4 +- 4.1 of 128 bits, and in half as many of 64 (+- 3.1 and 2.9).
RADIUS, HALF_RADIUS = (40, 34), (25, 22)
#: Least rows of a block of fingerprints; rows and shingles of a block of shingle sets.
BLOCK, SET_ROWS, SET_SHINGLES = 2048, 512, 1 << 20


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's ``words``-word shingles (fewer words: the whole sequence)."""
    line, starts, stops = words_of(text, words)
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64))


def wide_fingerprint(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves, each the majority of a set's hashes bit by bit; the second takes the hashes mixed once more."""
    halves, ones = [], np.empty(0)
    mixed = (found ^ (found >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    for some in (found, mixed ^ (mixed >> np.uint64(29))):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(some), 1 << 15):
            ones += np.unpackbits(some[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        halves.append(int(np.packbits(ones * 2 > len(some), bitorder="little").view("<i8")[0]))
    return halves[0], halves[1]


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, chars, digest, lo, hi, size) of every row; texts with equal shingle sets share the digest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(3).to_pylist():
                found = shingle_set(text)
                rows.append((_digest(found), *wide_fingerprint(found), len(found)))
            digest, lo, hi, size = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [*batch.columns[:3], pa.array(digest, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "chars", "digest", "lo", "hi", "size"])

    return keyed(docs).mapInArrow(each, "doc_id long, key binary, chars int, digest binary, lo long, hi long, size int")


@dataclass
class _Prints:
    """Fingerprints by ascending set size, so that sizes which can be similar enough lie in one slice."""

    rep: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    size: np.ndarray

    @classmethod
    def load(cls, parts: list[pa.RecordBatch]) -> _Prints:
        rep, lo, hi, size = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("rep", "lo", "hi", "size"))
        order = np.argsort(size, kind="stable")
        return cls(rep[order], lo[order].view(np.uint64), hi[order].view(np.uint64), size[order].astype(np.int64))

    def sized(self, home: _Prints) -> Iterator[tuple[int, np.ndarray]]:
        """All members of home whose sizes allow the similarity, whatever their bits."""
        low = np.searchsorted(home.size, np.ceil(self.size * SIMILARITY - 1e-9))
        high = np.searchsorted(home.size, np.floor(self.size / SIMILARITY + 1e-9), "right")
        for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            yield i, np.arange(a, b)

    def near(self, home: _Prints) -> Iterator[tuple[int, np.ndarray]]:
        step = min(128, max(1, (1 << 21) // max(len(home.rep), 1)))
        for i in range(0, len(self.rep), step):
            mine = self.size[i : i + step]
            a = int(np.searchsorted(home.size, math.ceil(mine[0] * SIMILARITY - 1e-9)))
            b = int(np.searchsorted(home.size, math.floor(mine[-1] / SIMILARITY + 1e-9), "right"))
            half = np.bitwise_count(self.lo[i : i + step, None] ^ home.lo[None, a:b])
            rows, columns = np.nonzero(half <= (HALF_RADIUS[0] if mine[0] * SIMILARITY <= FEW else HALF_RADIUS[1]))
            columns += a
            half, other = half[rows, columns - a], np.bitwise_count(self.hi[i + rows] ^ home.hi[columns])
            few = np.minimum(self.size[i + rows], home.size[columns]) <= FEW
            alike = np.minimum(self.size[i + rows], home.size[columns]) >= SIMILARITY * np.maximum(self.size[i + rows], home.size[columns]) - 1e-9
            kept = alike & (half <= np.where(few, *HALF_RADIUS)) & (half.astype(np.int64) + other <= np.where(few, *RADIUS))
            rows, columns = rows[kept], columns[kept]
            for row, found in zip(np.unique(rows), np.split(columns, np.flatnonzero(np.diff(rows)) + 1), strict=True) if len(rows) else ():
                yield i + int(row), found


@dataclass
class _Sets:
    """Shingle sets as one array, and the same with every shingle's rows together."""

    rep: np.ndarray
    prints: _Prints
    sets: list[np.ndarray]

    @classmethod
    def load(cls, parts: list[pa.RecordBatch]) -> _Sets:
        rep, lo, hi = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("rep", "lo", "hi"))
        sets = [np.frombuffer(x, np.uint64) for p in parts for x in p.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        order = np.argsort(size, kind="stable")
        prints = _Prints(rep[order], lo[order].view(np.uint64), hi[order].view(np.uint64), size[order])
        return cls(rep[order], prints, [sets[k] for k in order])

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct shingles, start of each one's rows, rows)."""
        flat, row = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.prints.size)
        order = np.argsort(flat, kind="stable")
        shingle, start = np.unique(flat[order], return_index=True)
        return shingle, np.append(start, len(flat)), row[order]

    def near(self, home: _Sets, exact: bool) -> Iterator[tuple[int, np.ndarray]]:
        shingle, start, row = home.postings()
        for i, candidates in self.prints.sized(home.prints) if exact else self.prints.near(home.prints):
            mine = self.sets[i]
            at = np.minimum(np.searchsorted(shingle, mine), len(shingle) - 1)
            at = at[shingle[at] == mine]
            lengths = start[at + 1] - start[at]
            places = np.repeat(start[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            shared = np.bincount(row[places], minlength=len(home.rep))[candidates]
            union = len(mine) + home.prints.size[candidates] - shared
            yield i, candidates[shared >= SIMILARITY * union - 1e-9]


def _proposed(reps: DataFrame, block: int) -> DataFrame:
    """Links that span all pairs whose sizes and fingerprints allow the similarity."""
    # Similar sets are in the same size class or the next; bit counts that differ beyond the radius are two bins apart.
    ratio, width = math.log(1 / SIMILARITY), max(RADIUS) + 1
    tile = (F.floor(F.log("size") / ratio) + 1) * 8 + F.floor((F.bit_count("lo") + F.bit_count("hi")) / width) + 1
    tiled = reps.where("size > 0").select(tile.cast("long").alias("tile"), "rep", "lo", "hi", "size")
    steps = [1, 7, 8, 9]
    # Classes grow with the logarithm of a text's length: a few hundred rows.
    sizes = F.broadcast(plan(tiled.groupBy("tile").agg((F.count("*") / block).alias("need")), steps))
    sent = tiled.withColumn("visits", F.explode(F.array(*[F.lit(x).cast("long") for x in [0, *steps]]))).withColumn("tile", F.col("tile") + F.col("visits"))
    return deal(sent.join(sizes, "tile"), ["rep", "lo", "hi", "size"]).mapInArrow(forest(_Prints.load, _Prints.near), "a long, b long")


def _sharing(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links that span all pairs whose sizes allow the similarity and that share one of their least shingles, as all similar pairs do.

    Of sets at a similarity of 0.8 each holds 0.8 of the other's shingles, so
    the least n - ceil(0.8 n) + 1 of both have one in common.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            least = [s[: len(s) - math.ceil(len(s) * SIMILARITY - 1e-9) + 1].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["digest", "least"])

    kept = keyed(docs).select("text").mapInArrow(each, "digest binary, least array<long>").dropDuplicates(["digest"])
    # Similar sets are in the same size class or the next, so one of two numbers is the same.
    size_class = F.floor(F.log("size") / math.log(1 / SIMILARITY)).cast("int")
    rows = kept.join(reps.where("size > 0").select("digest", "rep", size_class.alias("class")), "digest").select("rep", "class", F.explode("least").alias("shingle"))
    held = cut(rows.select("rep", "shingle", F.explode(F.array("class", F.col("class") + 1)).alias("class")), "held")
    first = held.groupBy("shingle", "class").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return held.join(first, ["shingle", "class"]).where("rep <> a").select("a", F.col("rep").alias("b"))


def _verified(docs: DataFrame, wanted: DataFrame, exact: bool) -> DataFrame:
    """Links that span all pairs of a proposed group which are similar enough. ``wanted``: tile, rep, key, size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Repeated rows have one key; a task takes the first.
        seen: set[int] = set()
        for batch in batches:
            fresh = [not (r in seen or seen.add(r)) for r in batch.column("rep").to_pylist()]
            kept = batch.filter(pa.array(fresh, pa.bool_()))
            sets = [shingle_set(t).tobytes() for t in kept.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*kept.select(columns).columns, pa.array(sets, pa.binary())], [*columns, "shingles"])

    columns = ["tile", "blocks", "parts", "rep", "lo", "hi"]
    need = F.greatest(F.count("*") / SET_ROWS, F.sum("size") / SET_SHINGLES)
    sized = cut(wanted.join(plan(wanted.groupBy("tile").agg(need.alias("need")), []), "tile"), "sized")
    texts = keyed(docs).select("key", "text").join(small(sized, BROADCAST_KEYS), "key").select(*columns, "text")
    sets = texts.mapInArrow(each, "tile long, blocks int, parts int, rep long, lo long, hi long, shingles binary").withColumn("visits", F.lit(0))
    return deal(sets, ["rep", "lo", "hi", "shingles"]).mapInArrow(forest(_Sets.load, partial(_Sets.near, exact=exact)), "a long, b long")


def near_copies(docs: DataFrame, block: int | None = None, exact: bool = False) -> DataFrame:
    """(doc_id, component_id, key, chars, group) for every row of ``docs``, grouped by near copies.

    Texts link when the sets of their five-word shingles (words and case as in
    ``simhash.fingerprint``) have a Jaccard similarity of 0.8 or more, and
    their 128-bit fingerprints lie within the stated radius, which holds for
    nearly all such pairs. With ``exact`` every such pair links, whatever its
    fingerprints: sets meet where they share one of their least shingles.
    Texts that hang together by passages many of them hold are then one
    proposed group, whose work grows with its square. group is a number of the group; component_id is its
    smallest doc_id, null without one. key and chars are those of
    ``simhash.keyed``.

    Texts with equal shingle sets are one representative; rows link by their
    texts alone, so rows that share a doc_id, or have none, are told apart.
    Fingerprints are compared tile by tile; whatever they propose is decided
    on the sets, group by group and in blocks. Null texts count as empty, and
    texts without words are copies of one another; repeated rows stay
    repeated; extra columns are dropped; an empty table gives an empty result.
    """
    rows = cut(_sketches(docs), "sketches")
    same = rows.groupBy("digest").agg(*[F.min(c).alias(c) for c in ("doc_id", "key", "lo", "hi", "size")])
    reps = cut(same.withColumn("rep", F.monotonically_increasing_id()), "reps")
    if block is None and not exact:
        # About 40 blocks' meetings for each task: a row's copies grow with the root of the tasks, not with the rows.
        block = min(max(BLOCK, math.ceil(reps.count() / math.sqrt(40 * spread(reps)))), 1 << 20)
    groups = connected_components(_sharing(docs, reps) if exact else _proposed(reps, block), "a", "b")
    wanted = cut(groups.join(reps, groups.node == reps.rep).select(F.col("component").alias("tile"), "rep", "key", "lo", "hi", "size"), "proposed")
    found = connected_components(_verified(docs, wanted, exact), "a", "b")
    named = reps.join(found, reps.rep == found.node, "left").select("digest", "doc_id", "component", F.coalesce("component", "rep").alias("group"))
    # Only groups of several representatives have to look up their smallest id.
    ids = named.where("component is not null").groupBy("group").agg(F.min("doc_id").alias("least"), F.lit(True).alias("several"))
    named = cut(named.join(ids, "group", "left").select("digest", "group", F.when(F.col("several"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id")), "named")
    return rows.join(named, "digest", "left").select("doc_id", "component_id", "key", "chars", "group")
