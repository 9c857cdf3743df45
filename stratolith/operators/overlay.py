"""Which polygons of two tables share a point, by edges in grid cells: no polygon is held against all edges of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratolith.functions.geometry import edges_cross, rectangle

from .catalog import cells_between


def _edges(df: DataFrame, key: str, rings: str) -> DataFrame:
    """(key, ax, ay, bx, by) of every edge of every ring; a ring of one point is an edge without length."""
    ring = df.select(F.col(key).alias("key"), F.explode(rings).alias("r")).where(F.size("r") > 0)
    last = F.greatest(F.size("r") - 2, F.lit(0))
    at = lambda i: F.get("r", F.least(i, F.size("r") - 1))
    pairs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b")))
    return ring.select("key", F.explode(pairs).alias("e")).select("key", *[F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])


def _celled(edges: DataFrame, cell: float) -> DataFrame:
    """Each edge in every cell that it passes: row by row, from where it enters the row to where it leaves it."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.withColumn("cy", F.explode(cells_between(low, high, cell)))
    slope = F.try_divide(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    at = lambda y: F.col("ax") + (y - F.col("ay")) * slope
    y0, y1 = F.greatest(low, F.col("cy") * cell), F.least(high, (F.col("cy") + 1) * cell)
    flat = F.col("ay") == F.col("by")
    ends = [F.when(flat, F.col(c)).otherwise(at(y)) for c, y in (("ax", y0), ("bx", y1))]
    # Rounding may put an end into the next cell, so each stretch is a hair longer, more so where the edge is nearly level; within its own span.
    slack = cell * 1e-9 + F.coalesce(F.abs(slope), F.lit(0.0)) * 1e-15 * (F.abs("ay") + F.abs("by"))
    left = F.greatest(F.least(*ends) - slack, F.least("ax", "bx"))
    right = F.least(F.greatest(*ends) + slack, F.greatest("ax", "bx"))
    return rows.withColumn("cx", F.explode(cells_between(left, right, cell)))


def _inside(points: DataFrame, edges: DataFrame, celled: DataFrame, cell: float) -> DataFrame:
    """(key, other): polygons ``other`` (of the edges) in which a point (key, x, y) lies, their edges not decided.

    How many crossings of the lower line of a cell's row lie right of the point
    tells the side of the place below it on that line: those in the cell are
    counted, of the others the cell's corner knows whether they are odd. The
    edges in the cell tell how often the way up from there crosses. Several
    points of one key count one by one.
    """
    line = lambda n: F.col(n) * cell
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    # An edge crosses a line if it begins at or below and ends above it.
    lines = edges.withColumn("cy", F.explode(cells_between(low, high, cell))).where((low <= line("cy")) & (high > line("cy")))
    x = F.col("ax") + F.try_divide((line("cy") - F.col("ay")) * (F.col("bx") - F.col("ax")), F.col("by") - F.col("ay"))
    rows = lines.groupBy(F.col("key").alias("other"), "cy").agg(F.collect_list(x).alias("xs"))
    # Each cell that the outline's row covers knows its own crossings, and whether those right of it are an odd number.
    column = lambda v: F.floor(v / cell)
    corners = rows.withColumn("cx", F.explode(cells_between(F.array_min("xs"), F.array_max("xs"), cell))).select(
        "other", "cy", "cx", F.filter("xs", lambda v: column(v) == F.col("cx")).alias("own"), (F.size(F.filter("xs", lambda v: column(v) > F.col("cx"))) % 2).alias("right")
    )
    spots = points.distinct().withColumns({"cy": column(F.col("y")), "cx": column(F.col("x"))})
    below = spots.join(corners, ["cx", "cy"]).select("key", "x", "y", "other", ((F.size(F.filter("own", lambda v: v > F.col("x"))) + F.col("right")) % 2).alias("odd"))
    # The way from the line up to the point, moved off vertices: an edge counts if it has its left end at or left of it and its right end right of it.
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    near = spots.join(celled.withColumnRenamed("key", "other"), ["cx", "cy"]).where((left <= F.col("x")) & (right > F.col("x")))
    y = F.col("ay") + F.try_divide((F.col("x") - F.col("ax")) * (F.col("by") - F.col("ay")), F.col("bx") - F.col("ax"))
    # On the line itself an edge counts if it rises to the right, as the place below counts as right of it.
    rises = (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")) > 0
    up = near.where(((y > line("cy")) | ((y == line("cy")) & rises)) & (y <= F.col("y"))).select("key", "x", "y", "other", F.lit(1).alias("odd"))
    return below.unionByName(up).groupBy("key", "x", "y", "other").agg((F.sum("odd") % 2).alias("odd")).where("odd = 1").select("key", "other")


def shared(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, rings: str = "rings") -> DataFrame:
    """(a_key, b_key) of every two polygons that share a point, edges included, once each.

    Polygons meet if two of their edges do, which share a cell then, or if one
    holds the other, and so the first point of each of its rings. Everything
    is an equi-join on cells or rows of cells: a county of many vertices is
    compared, cell by cell, with what lies there. Null and empty polygons meet
    nothing.
    """
    ea, eb = _edges(a, a_key, rings), _edges(b, b_key, rings)
    ca, cb = _celled(ea, cell), _celled(eb, cell)
    there = cb.select("cx", "cy", F.col("key").alias("other"), *[F.col(c).alias(f"o{c}") for c in ("ax", "ay", "bx", "by")])
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    edge = lambda o: F.struct(point(f"{o}ax", f"{o}ay").alias("a"), point(f"{o}bx", f"{o}by").alias("b"))
    crossing = ca.join(there, ["cx", "cy"]).where(edges_cross(edge(""), edge("o"))).select("key", "other")
    first = lambda df, k: df.select(F.col(k).alias("key"), F.explode(rings).alias("r")).select("key", F.get("r", F.lit(0)).alias("p")).where("p is not null").select("key", "p.*")
    a_in_b = _inside(first(a, a_key), eb, cb, cell)
    b_in_a = _inside(first(b, b_key), ea, ca, cell).select(F.col("other").alias("key"), F.col("key").alias("other"))
    return crossing.unionByName(a_in_b).unionByName(b_in_a).distinct().select(F.col("key").alias(a_key), F.col("other").alias(b_key))


def outline_of(df: DataFrame) -> Column:
    """The rings of a row's shape: ``geom``'s parts together, ``rings``, or its box."""
    if "geom" in df.columns:
        return F.flatten(df["geom"])
    return df["rings"] if "rings" in df.columns else F.array(rectangle(*[df[c] for c in ("xmin", "ymin", "xmax", "ymax")]))
