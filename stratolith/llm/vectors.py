"""Operator 3: embedding near-duplicates by product quantisation and exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from stratolith.operators.components import connected_components
from stratolith.storage import cut, new_path, own, remove

COSINE = 0.9
#: Vectors on which lists and codes are fitted, in the order of a hash of the vector; lengths share them by their numbers of vectors.
SAMPLE = 16_384
#: Vectors of a length on which its lists and codes are fitted at least, where it has as many.
LEAST_SAMPLE = 64
SUBSPACES = 8
CODES = 256
#: Coarse lists: about the square root of the number of vectors, within these bounds.
LISTS = (1, 4096)
#: Vectors in a block of the index at most; a task compares two blocks at a time.
BLOCK = 32_768
#: Blocks of a length at least, so that tasks share the work, where they have so many vectors each.
SPREAD, LEAST_BLOCK = 8, 1024
#: Vectors that look up the codes of so many others at once, and pairs whose cosines are computed at once.
VISITORS, MEMBERS, RERANK = 256, 512, 1 << 15
#: Slack for the rounding of unit vectors, codes and distances in single precision; it only adds candidates.
_SLACK = 1e-3
#: Columns of a block's files.
_ROWS = pa.schema([("tile", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()), ("codes", pa.binary()), ("v", pa.binary())])
#: Tasks that search, and write blocks, at most; one takes several pairs, or blocks, where there are more.
_TASKS = 4096


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres * centres).sum(axis=1)
    return np.concatenate([np.argmin(norms - 2 * (x[i : i + 4096] @ centres.T), axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 42) -> np.ndarray:
    """Lloyd's rounds from distinct random rows; a centre that loses all its rows keeps its place."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres).astype(np.float32)
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres, and for each subspace the centres of the residuals."""

    coarse: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # for each subspace: codes x its dimensions
    cuts: list[int]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Quantiser:
        coarse = _kmeans(sample, lists, 8)
        rest = sample - coarse[_nearest(sample, coarse)]
        cuts = [round(i * sample.shape[1] / SUBSPACES) for i in range(SUBSPACES + 1)]
        books = [_kmeans(np.ascontiguousarray(rest[:, a:b]), CODES, 6) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        return cls(coarse, books, sorted(set(cuts)))

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.coarse)

    def codes(self, rest: np.ndarray) -> np.ndarray:
        """Residual codes, a column for each subspace."""
        return np.stack([_nearest(np.ascontiguousarray(rest[:, a:b]), book) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)], axis=1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def probed(self, x: np.ndarray, lists: np.ndarray, low: int, high: int, radius: float) -> np.ndarray:
        """Which of the lists from ``low`` to ``high`` can hold a vector within ``radius`` of any row of ``x``.

        Such a vector lies on the other side of the plane halfway between the
        centre of the row's own list and another only if that plane is within
        the radius, so lists whose plane is farther need no probe.
        """
        own_list, others = self.coarse[lists], self.coarse[low:high]
        norms, own_norms = (others * others).sum(axis=1), (own_list * own_list).sum(axis=1)
        far = norms - 2 * (x @ others.T) - (own_norms - 2 * (x * own_list).sum(axis=1))[:, None]
        apart = np.sqrt(np.maximum(own_norms[:, None] + norms - 2 * (own_list @ others.T), 0))
        return (far <= 2 * (radius + _SLACK) * apart + _SLACK).any(axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Double-precision unit vectors; scaled first so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Quantisers:
    """A quantiser for each length of vectors; a tile's number holds the length and the list."""

    of: dict[int, Quantiser]
    first: dict[int, int]  # for each length the tile of its first list
    length: np.ndarray  # for each tile the length

    @classmethod
    def fit(cls, samples: dict[int, np.ndarray], lists: dict[int, int]) -> Quantisers:
        of = {d: Quantiser.fit(_unit(x).astype(np.float32), lists[d]) for d, x in sorted(samples.items())}
        counts = [len(q.coarse) for q in of.values()]
        return cls(of, dict(zip(of, np.cumsum([0, *counts[:-1]]).tolist(), strict=True)), np.repeat(list(of), counts))

    def of_tile(self, tile: int) -> tuple[Quantiser, int]:
        """The quantiser of a tile's length, and the tile's list in it."""
        d = int(self.length[tile])
        return self.of[d], tile - self.first[d]


def _index(sent, width: str):
    """Each representative as a row of its block: the list, the codes and the vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, blocks = sent.value
        for batch in batches:
            for d, part in _lengths(batch):
                q, given = fitted.of[d], _matrix(part.column(2)).astype(width)
                x = _unit(given).astype(np.float32)
                lists = q.lists(x)
                codes = q.codes(x - q.coarse[lists]).astype(np.uint8)
                tiles, reps = lists + fitted.first[d], part.column(0).to_numpy()
                block = blocks.first[tiles] + (reps * 0x9E3779B1 >> 16) % blocks.cut[tiles]
                as_bytes = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (codes, given)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int32()), pa.array(tiles, pa.int32()), *part.columns[:2], *as_bytes], ["block", "tile", "rep", "copies", "codes", "v"]
                )

    return task


def _tiles(sent):
    """How many representatives of each batch lie in each tile."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Quantisers = sent.value
        for batch in batches:
            for d, part in _lengths(batch):
                lists = fitted.of[d].lists(_unit(_matrix(part.column(2))).astype(np.float32))
                tiles, counts = np.unique(lists + fitted.first[d], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int32()), pa.array(counts, pa.int64())], ["tile", "n"])

    return task


def _lengths(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows (rep, copies, v) of each length of vectors."""
    sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(sizes == d)))


@dataclass(frozen=True)
class Blocks:
    """Blocks of the index: each holds some lists of one length, or a part of one long list."""

    first: np.ndarray  # for each tile its first block
    cut: np.ndarray  # for each tile the blocks into which it is cut: 1, but for long lists
    length: np.ndarray  # for each block the length of its vectors

    @classmethod
    def plan(cls, counts: np.ndarray, length: np.ndarray, block: int) -> Blocks:
        """Lists go into a block one after another while there is room; a list with more rows than ``block`` is cut into blocks of its own."""
        most = {d: min(block, max(LEAST_BLOCK, -(-int(counts[length == d].sum()) // SPREAD))) for d in np.unique(length).tolist()}
        first, cut_in, of, held = [], [], [], 0
        for n, d in zip(counts.tolist(), length.tolist(), strict=True):
            parts = max(1, -(-n // most[d]))
            if not of or of[-1] != d or held + n > most[d]:
                of += [d] * parts
                first.append(len(of) - parts)
                held = n if parts == 1 else most[d]
            else:
                first.append(len(of) - 1)
                held += n
            cut_in.append(parts)
        return cls(np.array(first), np.array(cut_in), np.array(of))

    def pairs(self) -> np.ndarray:
        """(a, b) of all blocks of one length, a block with itself first."""
        ends = np.searchsorted(self.length, self.length, side="right")
        return np.array([(a, b) for a, end in enumerate(ends.tolist()) for b in range(a, end)], np.int32)


class _Block:
    """The rows of one block in the order of their lists, with bounds for the search of their codes."""

    def __init__(self, fitted: Quantisers, rows: pa.Table, radius: float, width: str) -> None:
        order = np.lexsort([rows.column("rep").to_numpy(), tiles := rows.column("tile").to_numpy()])
        self.q, first = fitted.of_tile(int(tiles[0]))
        self.lists = (first + tiles - tiles[0])[order]
        self.reps, self.copies = rows.column("rep").to_numpy()[order], rows.column("copies").to_numpy()[order]
        as_rows = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).reshape(len(order), -1)[order]
        self.x = _unit(as_rows("v", width))
        codes = as_rows("codes", np.uint8).astype(np.intp)
        near = self.q.coarse[self.lists] + self.q.decoded(codes)
        error = np.sqrt(((self.x.astype(np.float32) - near) ** 2).sum(axis=1))
        # The squared distance from x is |x|^2 + |near|^2 - 2 x near; x near is a sum over the list's centre and the codes.
        self.bound = ((radius + error + _SLACK) ** 2 - (near * near).sum(axis=1)).astype(np.float64)
        self.low, self.high = int(self.lists[0]), int(self.lists[-1]) + 1
        self.begins = np.searchsorted(self.lists, np.arange(self.low, self.high + 1))
        self.codes = [self.lists - self.low, *np.ascontiguousarray(codes.T)]

    def candidates(self, x: np.ndarray, lists: np.ndarray, radius: float, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of x, row of the block from ``start`` on) of all pairs that can lie within ``radius``, in parts.

        The table look-up distance is off by the code's own error at most, so
        whatever lies farther than the radius and that error can't link. Tables
        hold 16-bit integers that are rounded down; that only adds candidates.
        """
        q = self.q
        wanted = q.probed(x, lists, self.low, self.high, radius)
        if not wanted.any():
            return
        tables = [(x * x).sum(axis=1) - 2 * (q.coarse[self.low : self.high] @ x.T)]
        tables += [-2 * (book @ x[:, a:b].T) for book, a, b in zip(q.books, q.cuts[:-1], q.cuts[1:], strict=True)]
        lows = [float(t.min()) for t in tables]
        scale = 60_000 / max(1e-6, sum(float(t.max()) - low for t, low in zip(tables, lows, strict=True)))
        tables = [((t - low) * scale).astype(np.uint16) for t, low in zip(tables, lows, strict=True)]
        tables[0] += 2
        # 0 and 1 hold for no sum, as one is 2 at least; sums are under 60,003.
        limit = np.clip(np.floor((self.bound - sum(lows)) * scale) + 3, 0, 65_535).astype(np.uint16)[:, None]
        total, term = (np.empty((MEMBERS, len(x)), np.uint16) for _ in range(2))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], wanted, [False]])))
        for begin, end in self.begins[edges].reshape(-1, 2).tolist():
            for i in range(max(start, begin), end, MEMBERS):
                j = min(i + MEMBERS, end)
                held, more = total[: j - i], term[: j - i]
                np.take(tables[0], self.codes[0][i:j], axis=0, out=held, mode="clip")
                for table, code in zip(tables[1:], self.codes[1:], strict=True):
                    np.take(table, code[i:j], axis=0, out=more, mode="clip")
                    np.add(held, more, out=held)
                at = _true(held <= limit[i:j])
                for k in range(0, len(at), RERANK):
                    b, a = np.divmod(at[k : k + RERANK], len(x))
                    yield a, b + i


def _true(found: np.ndarray) -> np.ndarray:
    """Where few of many are true, in order; eight are looked at in one."""
    flat = found.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    at = (eights[:, None] * 8 + np.arange(8)).ravel()
    return at[flat[at]]


class _Groups:
    """Which of a task's rows hang together."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.of[rows]
        while (found != (up := self.of[found])).any():
            found = up
        self.of[rows] = found
        return found

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Put each row of ``a`` together with that of ``b``: roots hang on lesser ones until no pair is apart."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))


def _meet(home: _Block, other: _Block, cosine: float, radius: float) -> pa.RecordBatch:
    """(rep, links, on) of the rows of two blocks, or of one with itself, that link; every pair is taken once."""
    same, n = home is other, len(home.reps)
    links, groups = np.zeros(n + len(other.reps), np.int64), _Groups(n + len(other.reps))
    copies, reps = np.concatenate([home.copies, other.copies]), np.concatenate([home.reps, other.reps])
    shift = 0 if same else n
    for begin in range(0, len(other.reps), VISITORS):
        some = slice(begin, begin + VISITORS)
        x = other.x[some].astype(np.float32)
        for a, b in home.candidates(x, other.lists[some], radius, begin if same else 0):
            a = a + begin
            keep = np.einsum("ij,ij->i", other.x[a], home.x[b]) >= cosine
            if same:
                keep &= a < b
            a, b = a[keep] + shift, b[keep]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            groups.join(a, b)
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(links[some]), pa.array(reps[groups.roots(some)])], ["rep", "links", "on"])


def _search(sent, folder: str, cosine: float, radius: float, width: str):
    """The links of each pair of blocks; a task reads two blocks of the index at once, whatever the table's size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, pairs = sent.value
        store, base = fs.FileSystem.from_uri(folder)

        def load(k: int) -> _Block | None:
            path = f"{base}/block={k}"
            if store.get_file_info(path).type == fs.FileType.NotFound:
                return None
            rows = dataset.dataset(path, schema=_ROWS, filesystem=store, format="parquet").to_table(use_threads=False)
            return _Block(fitted, rows, radius, width) if len(rows) else None

        at, home = None, None
        for batch in batches:
            for a, b in pairs[batch.column(0).to_numpy()].tolist():
                if a != at:
                    at, home = a, load(a)
                other = home if a == b else load(b)
                if home is not None and other is not None:
                    yield _meet(home, other, cosine, radius)

    return task


def _samples(reps: DataFrame, sizes: dict[int, int], sample: int) -> dict[int, np.ndarray]:
    """For each length the vectors of least hash: ``sample`` in all, shared by the numbers of vectors, and a few for each at least."""
    total = sum(sizes.values())
    wanted = {d: min(n, max(math.ceil(sample * n / total), LEAST_SAMPLE)) for d, n in sizes.items()}
    # Hashes are even, so of those under a bound about as many are there as wanted and a few more; the rest is cut off here.
    share = {d: min(1.0, (k + 6 * k**0.5) / sizes[d]) for d, k in wanted.items()}
    bounds = F.create_map(*[F.lit(x) for d, p in share.items() for x in (d, min(int(-(2.0**63) + p * 2.0**64), 2**63 - 1))])
    hashed = reps.withColumn("h", F.xxhash64("v")).where(F.col("h") <= bounds[F.size("v")])
    found: dict[int, list] = {d: [] for d in sizes}
    for r in hashed.orderBy("h", "rep").select("v").collect():
        if len(found[len(r["v"])]) < wanted[len(r["v"])]:
            found[len(r["v"])].append(r["v"])
    for d in [d for d, x in found.items() if not x]:
        found[d] = [r["v"] for r in reps.where(F.size("v") == d).orderBy("rep").select("v").limit(wanted[d]).collect()]
    return {d: np.array(x) for d, x in found.items()}


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    n_links counts the other rows linked directly: those of the same vector,
    and all copies of vectors of the same length with a cosine of ``cosine`` or
    more, in double precision. Equal vectors are one representative, and rows
    link by their vectors alone: an id on several vectors doesn't join them. Each
    length is searched by lists and codes of its own. Vectors that are null,
    zero or not finite link with nothing at all. Rows with a
    null vec_id are returned with their links, and stand for nothing; the
    component of a group without any vec_id is null, and kept false. Repeated
    rows link each other; an empty table gives an empty result; extra columns
    are ignored.
    """
    spark = vectors.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    rows = own(vectors, vec_id="vec_id", v="embedding")
    # Single-precision vectors stay so wherever they are written; cosines are in double precision.
    single = isinstance(getattr(rows.schema["v"].dataType, "elementType", None), FloatType)
    kind, width = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("v", F.col("v").cast(kind))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda e: e + F.lit(0.0)).cast(kind)))
    # A class's node is a number of its own: one id may stand on several vectors.
    equal = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = cut(equal.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = classes.where("least is not null").select("rep", "copies", "v")
    # A row for each length; one with a single representative has nothing to search.
    sizes = {r["d"]: r["count"] for r in reps.groupBy(F.size("v").alias("d")).count().where("count > 1").collect()}
    if not sizes:
        linked = spark.createDataFrame([], "rep long, links long, on long")
    else:
        reps = reps.where(F.size("v").isin(list(sizes)))
        lists = {d: int(np.clip(round(n**0.5 / 2), *LISTS)) for d, n in sizes.items()}
        fitted = Quantisers.fit(_samples(reps, sizes, sample), lists)  # 4,096 centres a length at most
        counts = np.zeros(len(fitted.length), np.int64)
        # A row for each list.
        for r in reps.mapInArrow(_tiles(spark.sparkContext.broadcast(fitted)), "tile int, n long").groupBy("tile").agg(F.sum("n").alias("n")).collect():
            counts[r["tile"]] = r["n"]
        blocks = Blocks.plan(counts, fitted.length, block)
        pairs, folder = blocks.pairs(), new_path(spark, "blocks")
        placed = reps.mapInArrow(_index(spark.sparkContext.broadcast((fitted, blocks)), width), "block int, tile int, rep long, copies long, codes binary, v binary")
        placed.repartition(min(len(blocks.length), _TASKS), "block").write.partitionBy("block").parquet(folder)
        searched = spark.range(0, len(pairs), 1, min(len(pairs), _TASKS))
        found = searched.mapInArrow(_search(spark.sparkContext.broadcast((fitted, pairs)), folder, cosine, radius, width), "rep long, links long, on long")
        linked = cut(found, "links")
        remove(spark, folder)
    groups = connected_components(linked, "rep", "on")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    # Vectors meet in one join only; from there on classes go by their numbers. Both sides are written, so Spark can split a very common one.
    members = cut(rows.join(classes, "v", "left").select("vec_id", "rep", "least", "copies"), "members")
    named = cut(counts.join(groups, F.col("rep") == F.col("node")).select("rep", "component", "links"), "named")
    smallest = named.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("smallest"))
    named = cut(named.join(smallest, "component").select("rep", "links", "smallest"), "smallest")
    return members.join(named, "rep", "left").select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("rep").isNull(), F.col("vec_id")).otherwise(F.coalesce("smallest", "least")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
