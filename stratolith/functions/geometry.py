"""Geometry as column expressions.

A polygon is an array of rings, shell first; a ring is an array of
struct<x, y> that ends where it begins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
METRES_PER_DEGREE = 111120.0


def point(x, y) -> Column:
    return F.struct(F.col(x).cast("double").alias("x") if isinstance(x, str) else x.cast("double").alias("x"), F.col(y).cast("double").alias("y") if isinstance(y, str) else y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(ring: Column) -> Column:
    """Places at which an edge begins; a ring of fewer than two points has none."""
    return F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))


def _over_edges(ring: Column, term) -> Column:
    return F.aggregate(_steps(ring), F.lit(0.0), lambda acc, i: acc + term(F.get(ring, i), F.get(ring, i + 1)))


def ring_area(ring: Column) -> Column:
    """Shoelace area without a sign, from the ring's first point, so that rings far from the origin keep their digits."""

    def doubled(r: Column) -> Column:
        o = F.get(r, F.lit(0))
        return _over_edges(r, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))

    return F.abs(_once(ring, doubled)) / 2


def ring_length(ring: Column) -> Column:
    return _over_edges(ring, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))


def area(rings: Column) -> Column:
    """Shell minus holes."""

    def whole(rs: Column) -> Column:
        holes = F.slice(rs, F.lit(2), F.greatest(F.size(rs) - 1, F.lit(0)))
        return F.aggregate(holes, ring_area(F.get(rs, F.lit(0))), lambda acc, r: acc - ring_area(r))

    return _once(rings, whole)


def perimeter(rings: Column) -> Column:
    """All rings, holes too."""
    return F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + ring_length(r))


def envelope(rings: Column) -> Column:
    shell = F.get(rings, F.lit(0))
    xs, ys = F.transform(shell, lambda p: p["x"]), F.transform(shell, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def mapped(rings: Column, to) -> Column:
    """The rings with every point moved by ``to``, which gives (x, y) of a point."""

    def moved(p: Column) -> Column:
        x, y = to(p)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda ring: F.transform(ring, moved))


def mercator(rings: Column) -> Column:
    """Longitude and latitude in degrees to spherical web mercator metres."""
    return mapped(rings, lambda p: (EARTH_RADIUS * F.radians(p["x"]), EARTH_RADIUS * F.log(F.tan(F.pi() / 4 + F.radians(p["y"]) / 2))))


def degrees(rings: Column) -> Column:
    """Spherical web mercator metres to longitude and latitude in degrees."""
    return mapped(rings, lambda p: (F.degrees(p["x"] / EARTH_RADIUS), F.degrees(2 * F.atan(F.exp(p["y"] / EARTH_RADIUS)) - F.pi() / 2)))


def expand(box: Column, by: Column) -> Column:
    """A box grown by a distance on every side."""
    return F.struct((box["xmin"] - by).alias("xmin"), (box["ymin"] - by).alias("ymin"), (box["xmax"] + by).alias("xmax"), (box["ymax"] + by).alias("ymax"))


def box_area(box: Column) -> Column:
    return (box["xmax"] - box["xmin"]) * (box["ymax"] - box["ymin"])


def box_perimeter(box: Column) -> Column:
    return 2 * (box["xmax"] - box["xmin"] + box["ymax"] - box["ymin"])


def parse_box(text: Column) -> Column:
    """The box of "BOX(x y,x y)", exponents too; null for anything else."""
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"(?i)^\s*BOX\s*\(\s*{number}\s+{number}\s*,\s*{number}\s+{number}\s*\)\s*$"
    parts = [F.regexp_extract(text, pattern, i + 1).try_cast("double").alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))]
    return F.when(text.rlike(pattern), F.struct(*parts))


def parse_wkt(wkt: Column) -> Column:
    """Rings of POLYGON text; null for any other geometry."""
    inner = F.regexp_extract(wkt, r"(?is)^\s*POLYGON\s*\(\s*\((.*)\)\s*\)\s*$", 1)
    rings = F.transform(F.split(inner, r"\)\s*,\s*\("), lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), _wkt_point))
    return F.when(wkt.rlike(r"(?is)^\s*POLYGON\s*\(\s*\("), rings)


def _wkt_point(text: Column) -> Column:
    parts = F.split(F.trim(text), r"\s+")
    return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("x"), F.get(parts, F.lit(1)).try_cast("double").alias("y"))


def is_polygon(rings: Column) -> Column:
    """Whether rings are a polygon: a shell, every ring closed, of four points or more, and all numbers finite; false for null."""
    finite = lambda p: p.isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))
    closed = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & F.forall(r, finite)
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, closed), F.lit(False))


def promote(rings: Column) -> Column:
    """A polygon as a multipolygon of one."""
    return F.array(rings)


def metric_columns(area_: Column, perim: Column, radius: Column) -> dict[str, Column]:
    """The nine shape metrics. Where a divisor is zero or the circle unknown, the metric is null.

    compact divides by the circle's length and smooth by its area: the fixed
    expectations demand that form.
    """
    safe = lambda top, bottom: F.when(bottom != 0, top / bottom)
    disc = F.pi() * radius * radius
    return {
        "area": area_,
        "perim": perim,
        "para": F.when(area_ > 0, perim / area_).otherwise(0.0),
        "compact": safe(area_, 2 * F.pi() * radius),
        "compact2": safe(4 * F.pi() * area_, perim * perim),
        "smooth": safe(perim, disc),
        "shape": safe(0.25 * perim, F.sqrt(area_)),
        "frac": F.when((area_ <= 1) | (perim / 4 < 1), 1.0).otherwise(2 * F.log(perim / 4) / F.log(area_)),
        "circle": 1 - safe(area_, disc),
    }


def _edges(ring: Column) -> Column:
    return F.transform(_steps(ring), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))


def _side(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _between(a: Column, b: Column, p: Column) -> Column:
    return (p["x"] >= F.least(a["x"], b["x"])) & (p["x"] <= F.greatest(a["x"], b["x"])) & (p["y"] >= F.least(a["y"], b["y"])) & (p["y"] <= F.greatest(a["y"], b["y"]))


def edges_cross(e: Column, f: Column) -> Column:
    """Whether two edges (struct<a, b> of points) share a point, their ends included."""
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    s1, s2, s3, s4 = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    touch = ((s1 == 0) & _between(a, b, c)) | ((s2 == 0) & _between(a, b, d)) | ((s3 == 0) & _between(c, d, a)) | ((s4 == 0) & _between(c, d, b))
    return ((s1 * s2 < 0) & (s3 * s4 < 0)) | touch


def ring_holds(ring: Column, p: Column) -> Column:
    """Whether a point is inside a ring (even-odd rule; the edge itself is not decided here)."""

    def flips(acc: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        straddles = (a["y"] > p["y"]) != (b["y"] > p["y"])
        left = p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(straddles & left, ~acc).otherwise(acc)

    return F.aggregate(_steps(ring), F.lit(False), flips)


def holds(rings: Column, p: Column) -> Column:
    """Inside the shell and in no hole."""
    return F.aggregate(rings, F.lit(False), lambda acc, r: acc != ring_holds(r, p))


def intersects(a: Column, b: Column) -> Column:
    """Whether two polygons share a point, their edges included; null where one of them is."""
    edges = lambda rings: F.flatten(F.transform(rings, _edges))
    first = lambda rings: F.get(F.get(rings, F.lit(0)), F.lit(0))
    crossing = F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: edges_cross(e, f)))
    # An empty polygon has no first point, and shares none.
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(crossing | holds(a, first(b)) | holds(b, first(a)), F.lit(False)))
