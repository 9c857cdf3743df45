"""Area, perimeter and enclosing radius of many polygons at once, from flat arrays of coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .circle import circles
from .projections import ARRAYS, MERCATOR, Srs, between, parse

_MEASURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("area", "perim", "r")])


def _flat(rings: pa.Array, source: Srs | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(rings of each polygon, points of each ring, x and y of each point, the rings), in web mercator with a ``source``."""
    sizes = rings.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    lists = rings.flatten()
    lengths = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    points = lists.flatten()
    x, y = (points.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
    x[points.is_null().to_numpy(zero_copy_only=False)] = np.nan
    return sizes, lengths, *(between(x, y, source, MERCATOR, ARRAYS) if source is not None else (x, y)), lists


def _edges(lengths: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(each point's ring, the place of that ring's first point, the points seen from there, the places where an edge begins)."""
    ring = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return ring, begin, x - x[begin], y - y[begin], np.flatnonzero(ring[1:] == ring[:-1])


def _areas(sizes: np.ndarray, lengths: np.ndarray, ring: np.ndarray, dx: np.ndarray, dy: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Shell minus holes of each polygon."""
    area = np.abs(np.bincount(ring[a], dx[a] * dy[a + 1] - dx[a + 1] * dy[a], len(lengths))) / 2
    signed = -area
    shells = (np.cumsum(sizes) - sizes)[sizes > 0]
    signed[shells] = area[shells]
    return np.where(sizes > 0, np.bincount(np.repeat(np.arange(len(sizes)), sizes), signed, len(sizes)), np.nan)


def measured(rings: pa.Array, source: Srs | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(area, perimeter, radius of the shell's least circle) of each polygon, not a number where there is none.

    Coordinates are moved to their ring's first point before they are
    multiplied, so an area far from the origin keeps its digits. With a
    ``source`` they are taken in web mercator.
    """
    sizes, lengths, x, y, lists = _flat(rings, source)
    polygon = np.repeat(np.arange(len(sizes)), sizes)
    shell = np.zeros(len(lists), bool)
    shell[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    ring, begin, dx, dy, a = _edges(lengths, x, y)
    b = a + 1
    length = np.bincount(ring[a], np.hypot(dx[b] - dx[a], dy[b] - dy[a]), len(lists))
    perims = np.where(rings.is_null().to_numpy(zero_copy_only=False), np.nan, np.bincount(polygon, length, len(sizes)))
    # Circles round to six decimals where the points are, and lose none of them near the shell's first point.
    near = [np.round(v, 6) - np.round(v[begin], 6) for v in (x, y)]
    kept = np.flatnonzero(shell[ring]) if len(ring) else np.empty(0, np.int64)
    counts = np.zeros(len(sizes), np.int64)
    counts[polygon[shell]] = lengths[shell]
    flat = pa.StructArray.from_arrays([pa.array(v[kept]) for v in near], ["x", "y"])
    shells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)
    return _areas(sizes, lengths, ring, dx, dy, a), perims, circles(shells)[:, 2]


def areas(srs: str | None = None):
    """Arrow UDF: polygon to its area alone, as ``measures`` has it."""
    source = parse(srs) if srs else None

    @F.arrow_udf(T.DoubleType())
    def area(rings: pa.Array) -> pa.Array:
        sizes, lengths, x, y, _ = _flat(rings, source)
        ring, _, dx, dy, a = _edges(lengths, x, y)
        return pa.array(_areas(sizes, lengths, ring, dx, dy, a), pa.float64(), from_pandas=True)

    return area


def measures(srs: str | None = None):
    """Arrow UDF: polygon to struct<area, perim, r>; in web mercator, whatever ``srs`` its coordinates have, or as they are without one."""
    source = parse(srs) if srs else None

    @F.arrow_udf(_MEASURES)
    def measure(rings: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(v, pa.float64(), from_pandas=True) for v in measured(rings, source)], ["area", "perim", "r"])

    return measure
