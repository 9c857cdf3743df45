"""Minimum enclosing circles (Welzl 1991) and convex hulls, one vector of point lists at a time."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-9
#: Lists of up to this many points are solved together, by trying all pairs and triples.
_FEW = 6
#: Points of a group that one task reduces to their hull at once, about.
_TOGETHER = 10_000
_POINTS = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y")]))
_ARROW_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _two(p, q):
    return ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, math.hypot(p[0] - q[0], p[1] - q[1]) / 2)


def _three(p, q, r):
    """The circle through three points; of points on a line, that of the farthest two."""
    bx, by, cx, cy = q[0] - p[0], q[1] - p[1], r[0] - p[0], r[1] - p[1]
    d = 2 * (bx * cy - by * cx)
    if abs(d) < 1e-12:
        return max((_two(p, q), _two(p, r), _two(q, r)), key=lambda c: c[2])
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    return (p[0] + ux, p[1] + uy, math.hypot(ux, uy))


def _outside(c, p) -> bool:
    return math.hypot(p[0] - c[0], p[1] - c[1]) > c[2] * (1 + _EPS) + _EPS


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the convex hull, counter-clockwise from the least (monotone chain); points on a side are left out."""
    rest = sorted(set(points))
    if len(rest) < 3:
        return rest

    def chain(way: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in way:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(rest) + chain(rest[::-1])


def minimum_circle(points) -> tuple[float, float, float] | None:
    """(cx, cy, r) of the least circle around all points, rounded to 6 decimals first; None without points.

    Incremental over the hull's corners, so depth doesn't grow with the points;
    the order is shuffled with a fixed seed, which keeps the expected time linear.
    """
    rest = hull([(round(p["x"], 6), round(p["y"], 6)) for p in points if p is not None and p["x"] is not None and p["y"] is not None])
    if not rest:
        return None
    random.Random(7).shuffle(rest)
    best = (*rest[0], 0.0)
    for i, p in enumerate(rest):
        if not _outside(best, p):
            continue
        best = (*p, 0.0)
        for j, q in enumerate(rest[:i]):
            if not _outside(best, q):
                continue
            best = _two(p, q)
            for r in rest[:j]:
                if _outside(best, r):
                    best = _three(p, q, r)
    return best


def _few(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """cx, cy, r of many lists of equally few points (a row each): the least circle of any pair or triple that holds all."""
    best = np.full((len(x), 3), np.inf)

    def offer(cx: np.ndarray, cy: np.ndarray, r: np.ndarray) -> None:
        with np.errstate(invalid="ignore"):
            holds = np.hypot(x - cx[:, None], y - cy[:, None]).max(axis=1) <= r * (1 + _EPS) + _EPS
            better = holds & (r < best[:, 2])
        best[better] = np.stack([cx, cy, r], axis=1)[better]

    offer(x[:, 0], y[:, 0], np.zeros(len(x)))
    for i, j in combinations(range(x.shape[1]), 2):
        offer((x[:, i] + x[:, j]) / 2, (y[:, i] + y[:, j]) / 2, np.hypot(x[:, i] - x[:, j], y[:, i] - y[:, j]) / 2)
    for i, j, k in combinations(range(x.shape[1]), 3):
        bx, by, cx, cy = x[:, j] - x[:, i], y[:, j] - y[:, i], x[:, k] - x[:, i], y[:, k] - y[:, i]
        d = 2 * (bx * cy - by * cx)
        d = np.where(np.abs(d) < 1e-12, np.nan, d)  # on a line: a pair does
        b2, c2 = bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
        offer(x[:, i] + ux, y[:, i] + uy, np.hypot(ux, uy))
    return best


def circles(points: pa.Array) -> np.ndarray:
    """cx, cy, r of each list of an array<struct<x, y>>; not a number for null and empty ones."""
    sizes = points.value_lengths().fill_null(0).to_numpy()
    flat = points.flatten()
    x, y = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    bad = np.zeros(len(flat) + 1, np.int64)
    bad[1:] = np.cumsum(~(np.isfinite(x) & np.isfinite(y)) | flat.is_null().to_numpy(zero_copy_only=False))
    begins = np.cumsum(sizes) - sizes
    out = np.full((len(points), 3), np.nan)
    easy = (sizes > 0) & (sizes <= _FEW) & (bad[begins + sizes] == bad[begins])
    for n in np.unique(sizes[easy]).tolist():
        rows = np.flatnonzero(easy & (sizes == n))
        at = begins[rows, None] + np.arange(n)
        out[rows] = _few(np.round(x[at], 6), np.round(y[at], 6))
    for row in np.flatnonzero((sizes > 0) & ~easy).tolist():
        found = minimum_circle(points[row].as_py())
        if found is not None:
            out[row] = found
    return out


#: A type, not text: text would need a session where tasks import this.
_CIRCLE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("cx", "cy", "r")])


@F.arrow_udf(_CIRCLE)
def bounding_circle(points: pa.Array) -> pa.Array:
    """Arrow UDF: array<struct<x, y>> to its circle; its fields are null where there are no points."""
    columns = [pa.array(c, pa.float64(), from_pandas=True) for c in circles(points).T]
    return pa.StructArray.from_arrays(columns, ["cx", "cy", "r"])


@F.arrow_udf(_POINTS)
def convex_hull(points: pa.Array) -> pa.Array:
    """Arrow UDF: array<struct<x, y>> to the corners of its hull, as ``hull`` gives them; null points are left out."""
    lists = [None if p is None else [{"x": x, "y": y} for x, y in hull([(q["x"], q["y"]) for q in p if q is not None and q["x"] is not None and q["y"] is not None])] for p in points.to_pylist()]
    return pa.array(lists, _ARROW_POINTS)


def group_circles(points: DataFrame, key: str, together: int = _TOGETHER) -> DataFrame:
    """(key, cx, cy, r): the least circle around the points (x, y) of each group.

    A group's points are reduced to hulls part by part, and the hulls' corners
    to their own, so that no task holds all points of a large group.
    """
    at = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sizes = points.groupBy(key).agg(F.ceil(F.count("*") / together).cast("int").alias("parts"))
    dealt = points.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")))
    parts = dealt.groupBy(key, "part").agg(F.collect_set(at).alias("p")).select(key, convex_hull("p").alias("p"))
    whole = parts.groupBy(key).agg(F.flatten(F.collect_list("p")).alias("p"))
    return whole.select(key, bounding_circle("p").alias("c")).select(key, "c.*")
