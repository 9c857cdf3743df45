"""Outlines of regions, assembled tile by tile and joined across tiles by list ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratolith.storage import cut

from .components import connected_components

RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


def _turn(came: tuple[int, int], goes: tuple[int, int]) -> int:
    """How far to the right a way turns: the greater, the sharper. Of two ways on, the sharper is taken."""
    return came[0] * goes[1] - came[1] * goes[0]


def _straightened(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A way without the points at which it doesn't turn; its ends stay."""
    inner = [q for p, q, r in zip(path, path[1:], path[2:], strict=False) if (q[0] - p[0]) * (r[1] - q[1]) != (q[1] - p[1]) * (r[0] - q[0])]
    return [path[0], *inner, path[-1]]


def _ways(sides: list[tuple[int, int, int, int]], tile: int) -> list[tuple[bool, list[tuple[int, int]]]]:
    """(closed, points) of the ways that one tile's sides of one region make; they end at the tile's edge, where others' sides may meet theirs."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x0, y0, x1, y1 in sides:
        out.setdefault((x0, y0), []).append((x1, y1))
    border = lambda p: p[0] % tile == 0 or p[1] % tile == 0
    found = []

    def walk(at: tuple[int, int], to: tuple[int, int]) -> tuple[bool, list[tuple[int, int]]]:
        path = [at, to]
        while not border(to) and to != path[0]:
            options = out[to]
            came = (to[0] - at[0], to[1] - at[1])
            best = max(options, key=lambda p: _turn(came, (p[0] - to[0], p[1] - to[1])))
            options.remove(best)
            at, to = to, best
            path.append(to)
        return not border(to), _straightened(path)

    # Open ways first: they begin at the tile's edge.
    for at in [p for p in out if border(p)]:
        while out[at]:
            found.append(walk(at, out[at].pop()))
    # The rest are rings; the least corner of one is no pinch, where two ways on would be left.
    for at in sorted(out):
        while out[at]:
            found.append(walk(at, out[at].pop()))
    return found


def ways(sides: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """(*keys, closed, points, sx, sy, ex, ey, ix, iy, ox, oy): the ways within tiles; where each begins and ends, and in which direction it leaves and arrives.

    ``sides`` has the keys and (x0, y0, x1, y1, ty, tx) of every pixel side and
    the tile of its pixel.
    """
    columns = [*keys, "closed", "points", "sx", "sy", "ex", "ey", "ix", "iy", "ox", "oy"]

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        made = []
        for key, group in rows.groupby(keys, sort=False):
            for closed, path in _ways(list(zip(*(group[c].tolist() for c in ("x0", "y0", "x1", "y1")), strict=True)), tile):
                (ax, ay), (bx, by), (cx, cy), (dx, dy) = path[0], path[1], path[-2], path[-1]
                ways_ = [int(np.sign(v)) for v in (bx - ax, by - ay, dx - cx, dy - cy)]
                made.append((*key, closed, [{"x": float(x), "y": float(y)} for x, y in path], ax, ay, dx, dy, *ways_))
        return pd.DataFrame(made, columns=columns)

    types = {f.name: f.dataType.simpleString() for f in sides.schema.fields}
    ddl = ", ".join(f"{k} {types[k]}" for k in keys) + ", closed boolean, points array<struct<x:double,y:double>>, sx int, sy int, ex int, ey int, ix int, iy int, ox int, oy int"
    return sides.groupBy(*dict.fromkeys([*keys[:-1], "ty", "tx"])).applyInPandas(assemble, ddl)


def ranked(links: DataFrame) -> DataFrame:
    """(way, ring, rank): the place of each way in its ring, from ``links`` (way, next), by pointer doubling.

    A ring's number is its least way's. All other ways look ahead to it: each
    round doubles how far, so a ring of n ways takes log2(n) rounds of joins of
    whole numbers, and no task holds a ring.
    """
    rings = cut(connected_components(links.where("way <> next"), "way", "next"), "rings")
    ring = F.coalesce("component", "way")
    now = cut(links.join(rings, links.way == rings.node, "left").select("way", ring.alias("ring"), F.col("next").alias("to"), F.lit(1).cast("long").alias("steps")), "ranks")
    while True:
        open_ = now.where("to <> ring")
        if open_.isEmpty():
            break
        ahead = now.select(F.col("way").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        # One that has come to the ring's first way stops there.
        joined = open_.join(ahead, "to").select("way", "ring", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        now = cut(joined.unionByName(now.where("to = ring")), "ranks")
    # Steps to the first way: the more, the earlier, and the first itself has gone all around.
    return now.select("way", "ring", (-F.col("steps")).alias("rank"))


def joined(found: DataFrame, keys: list[str]) -> DataFrame:
    """(way, next) of all open ways: at a place where two ways of a region end and two begin, each takes the sharper turn to the right."""
    ends = found.select(*keys, "way", F.col("ex").alias("x"), F.col("ey").alias("y"), "ox", "oy")
    starts = found.select(*keys, F.col("way").alias("next"), F.col("sx").alias("x"), F.col("sy").alias("y"), "ix", "iy")
    turn = F.col("ox") * F.col("iy") - F.col("oy") * F.col("ix")
    return ends.join(starts, [*keys, "x", "y"]).groupBy("way").agg(F.max_by("next", turn).alias("next"))


@F.pandas_udf(RINGS)
def _rings(regions: pd.Series) -> pd.Series:
    """Each region's parts (ring, rank, points) as closed rings without points that don't turn, that of the largest area first."""

    def area(r: list[tuple[float, float]]) -> float:
        return abs(sum((a[0] - r[0][0]) * (b[1] - r[0][1]) - (b[0] - r[0][0]) * (a[1] - r[0][1]) for a, b in zip(r[:-1], r[1:], strict=True)))

    def one(parts) -> list[list[dict]]:
        rings: dict[int, list[tuple[float, float]]] = {}
        for part in sorted(parts, key=lambda p: (p["ring"], p["rank"])):
            rings.setdefault(part["ring"], []).extend((p["x"], p["y"]) for p in part["points"][:-1])
        done = []
        for path in rings.values():
            turns = [q for i, q in enumerate(path) if (q[0] - path[i - 1][0]) * (path[(i + 1) % len(path)][1] - q[1]) != (q[1] - path[i - 1][1]) * (path[(i + 1) % len(path)][0] - q[0])]
            least = turns.index(min(turns))
            done.append([*turns[least:], *turns[:least], turns[least]])
        return [[{"x": x, "y": y} for x, y in ring] for ring in sorted(done, key=area, reverse=True)]

    return pd.Series([one(parts) for parts in regions])


def assembled(sides: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """(*keys, rings) of all regions, from their pixel sides (*keys, x0, y0, x1, y1, ty, tx).

    Ways are made within tiles; only their ends meet across tiles, and their
    order in each ring comes from ``ranked``. A region's points come together
    in one row once, as the polygon that is the result.
    """
    found = cut(ways(sides, keys, tile).withColumn("way", F.monotonically_increasing_id()), "ways")
    whole = found.where("closed").select(*keys, F.col("way").alias("ring"), F.lit(1).cast("long").alias("rank"), "points")
    links = cut(joined(found.where("not closed"), keys), "links")
    open_ = found.where("not closed").join(ranked(links), "way").select(*keys, "ring", "rank", "points")
    return whole.unionByName(open_).groupBy(*keys).agg(F.collect_list(F.struct("ring", "rank", "points")).alias("parts")).select(*keys, _rings("parts").alias("rings"))
