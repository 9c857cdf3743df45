"""Rows that are dealt out as (tile, block, part, side), read back run by run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolith.storage import spread


def runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Split sorted batches wherever a key changes. A run may go on in the next batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for v in values:
            change |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            yield tuple(int(v[i]) for v in values), batch.slice(i, j - i)


class Labels:
    """Which rows of a block hang together; the representative is the least row."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, rows: np.ndarray) -> int:
        """Put ``rows`` together; return their least row."""
        own = self.of[rows]
        least = own.min()
        if (own != least).any():
            self.of[np.isin(self.of, np.unique(own))] = least
        return int(least)



#: Blocks' worth of visitors that a task takes for one block at once.
VISITORS = 2


def plan(need: DataFrame, steps: list[int]) -> DataFrame:
    """(tile, blocks, parts) of each tile: its blocks, and the parts into which their visitors are dealt.

    ``need`` has (tile, need), a tile's rows in blocks; the tiles that lie
    ``steps`` before it send it all of theirs, and its own blocks theirs to
    later ones.
    """
    moved = need.withColumn("step", F.explode(F.array(*[F.lit(x).cast("long") for x in [0, *steps]]))).withColumn("to", F.col("tile") + F.col("step"))
    sums = moved.groupBy("to").agg(F.max(F.when(F.col("step") == 0, F.col("need"))).alias("own"), F.sum("need").alias("all"))
    parts = F.greatest(F.ceil(F.col("all") / VISITORS), F.lit(1)).cast("int")
    return sums.where("own is not null").select(F.col("to").alias("tile"), F.ceil("own").cast("int").alias("blocks"), parts.alias("parts"))


def deal(sent: DataFrame, columns: list[str]) -> DataFrame:
    """(tile, block, part, side, *columns): rows as members of their block (side 0) and as visitors of others (side 1), dealt and sorted.

    ``sent`` has tile, rep, visits (0 on a row's own tile), and the tile's
    blocks and parts. Members come to each part, visitors to one, so any two
    rows meet once, and no task sees more of a block than its members and
    ``VISITORS`` blocks of others, however large the tile is.
    """
    at = F.when(F.col("visits") == 0, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).otherwise(-1)
    place = lambda block, part, side: F.struct(block.alias("block"), part.alias("part"), F.lit(side).alias("side"))
    member = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(F.col("at"), p, 0))
    visitor = F.transform(F.sequence(F.col("at") + 1, F.col("blocks") - 1), lambda b: place(b, F.col("visited"), 1))
    none = F.array().cast("array<struct<block:int,part:int,side:int>>")
    places = F.concat(F.when(F.col("at") >= 0, member).otherwise(none), F.when(F.col("at") + 1 < F.col("blocks"), visitor).otherwise(none))
    numbered = sent.withColumns({"at": at, "visited": F.pmod(F.xxhash64("rep", F.lit("visits")), F.col("parts")).cast("int")})
    dealt = numbered.withColumn("place", F.explode(places)).select("tile", "place.*", *columns)
    return dealt.repartition(spread(sent), "tile", "block", "part").sortWithinPartitions("tile", "block", "part", "side")


def forest(load: Callable, near: Callable) -> Callable:
    """A task over dealt rows that returns links (a, b) spanning all it finds.

    ``load(parts)`` makes one object of the batches of a side, with the ids in
    ``rep``. ``near(rows, home)`` yields (row, members of home it links with);
    a block's members are compared with one another in its first part.
    Not all pairs come out, but a spanning forest of them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(visitors, home, labels: Labels, same: bool) -> Iterator[tuple[int, int]]:
            for i, members in near(visitors, home):
                if len(members) > same:
                    least = labels.join(members)
                    if not same:
                        yield int(visitors.rep[i]), int(home.rep[least])

        def out(pairs: list) -> Iterator[pa.RecordBatch]:
            if pairs:
                a, b = (pa.array(x, pa.int64()) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        def close() -> list:
            moved = np.flatnonzero(labels.of != np.arange(len(labels.of))) if labels is not None else []
            return [(int(home.rep[i]), int(home.rep[labels.of[i]])) for i in moved]

        def settle():
            whole = load(parts)
            fresh = Labels(len(whole.rep))
            if key[2] == 0:
                list(links(whole, whole, fresh, True))
            return whole, fresh

        key, parts, home, labels = None, [], None, None
        for (*place, side), rows in runs(batches, ("tile", "block", "part", "side")):
            if place != key:
                if parts:
                    home, labels = settle()
                yield from out(close())
                key, parts, home, labels = place, [], None, None
            if side == 0:
                parts.append(rows)
                continue
            if parts:
                (home, labels), parts = settle(), []
            if home is not None:
                yield from out(list(links(load([rows]), home, labels, False)))
        if parts:
            home, labels = settle()
        yield from out(close())

    return task
