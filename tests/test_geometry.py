import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratolith.functions import geometry as g
from stratolith.functions import circle
from stratolith.functions.circle import minimum_circle
from stratolith.operators import catalog
from stratolith.operators.metrics import METRICS, with_metrics

SQUARE = "POLYGON ((0 0,1 0,1 1,0 1,0 0))"
HOLED = "POLYGON ((0 0,3 0,3 3,0 3,0 0), (1 1,2 1,2 2,1 2,1 1))"
EXPECTED = {
    SQUARE: (1.0, 4.0, 4.0, 0.22507907903927651, 0.78539816339744828, 2.54647908947032464, 1.0, 1.0, 0.36338022763241884),
    HOLED: (8.0, 16.0, 2.0, 0.60021087743807078, 0.39269908169872414, 1.13176848420903386, 1.41421356237309492, 1.33333333333333348, 0.43411575789548307),
}


def test_metric_fixtures(spark):
    df = spark.createDataFrame([(w,) for w in EXPECTED], "wkt string").withColumn("rings", g.parse_wkt(F.col("wkt")))
    for row in with_metrics(df).collect():
        assert [row[m] for m in METRICS] == pytest.approx(EXPECTED[row["wkt"]], abs=1e-8)


def test_other_geometries_and_degenerate_ones_give_nulls(spark):
    df = spark.createDataFrame([("POINT (1 1)",), (None,), ("POLYGON ((1 1,1 1,1 1,1 1))",)], "wkt string").withColumn("rings", g.parse_wkt(F.col("wkt")))
    rows = with_metrics(df).collect()
    assert rows[0]["rings"] is None and rows[1]["area"] is None
    assert rows[2]["area"] == 0 and rows[2]["shape"] is None and rows[2]["compact"] is None and rows[2]["para"] == 0


def test_intersects(spark):
    cases = [(SQUARE, "POLYGON ((1 1,2 1,2 2,1 2,1 1))", True), (SQUARE, "POLYGON ((2 2,3 2,3 3,2 3,2 2))", False), (HOLED, "POLYGON ((1.2 1.2,1.4 1.2,1.4 1.4,1.2 1.4,1.2 1.2))", False), (HOLED, "POLYGON ((0.2 0.2,0.4 0.2,0.4 0.4,0.2 0.4,0.2 0.2))", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    for row in df.select("want", g.intersects(g.parse_wkt(F.col("a")), g.parse_wkt(F.col("b"))).alias("got")).collect():
        assert row["want"] == row["got"]


@pytest.mark.parametrize("points,want", [([], None), ([(1, 2)], (1, 2, 0)), ([(0, 0), (2, 0)], (1, 0, 1)), ([(0, 0), (1, 0), (4, 0)], (2, 0, 2)), ([(1, 0), (2, 1), (1, 2), (0, 1), (0.5, 1.5), (1, 0)], (1, 1, 1))])
def test_circle_cases(points, want):
    got = minimum_circle([{"x": x, "y": y} for x, y in points])
    assert got is None if want is None else got == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=14))
def test_circle_is_least(points):
    cx, cy, r = minimum_circle([{"x": x, "y": y} for x, y in points])
    assert all(math.hypot(x - cx, y - cy) <= r + 1e-6 for x, y in points)
    rng = random.Random(1)
    for _ in range(40):  # no moved centre does with less
        a, b = cx + rng.gauss(0, 0.5), cy + rng.gauss(0, 0.5)
        assert max(math.hypot(x - a, y - b) for x, y in points) >= r - 1e-6


def test_polygons_without_edges(spark):
    shapes = "array<array<struct<x:double,y:double>>>"
    one, square = [[{"x": 0.5, "y": 0.5}]], [[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]]
    rows = [(square, square, True), (square, one, True), (one, one, False), (square, [], False), (square, [[]], False), (square, None, None)]
    df = spark.createDataFrame(rows, f"a {shapes}, b {shapes}, want boolean")
    for row in df.select("want", g.intersects(F.col("a"), F.col("b")).alias("ab"), g.intersects(F.col("b"), F.col("a")).alias("ba"), g.area(F.col("b")).alias("area")).collect():
        assert row.want == row.ab == row.ba


def test_grid_join_is_the_nested_loop(spark):
    rng = random.Random(3)
    box = lambda: (x := rng.uniform(-9, 9), y := rng.uniform(-9, 9), x + rng.choice([0, 1, 7.0]), y + rng.uniform(0, 5))
    a, b = [(i, *box()) for i in range(40)], [(i, *box()) for i in range(30)]
    names = "{} int, xmin double, ymin double, xmax double, ymax double"
    got = catalog.grid_join(spark.createDataFrame(a, names.format("i")), spark.createDataFrame(b, names.format("j")), 2.0).select("i", "j").collect()
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_areas():
    assert catalog.parse_area("06").kind == "state" and catalog.parse_area("", "0603791400").kind == "cousub"
    assert catalog.parse_area("3,4,1,2").value == (1, 2, 3, 4) and catalog.parse_area([1, 2, 3, 4]).kind == "bbox"
    for bad in ("123", "1,2,3", "a", "1, 2,3,4"):
        with pytest.raises(ValueError):
            catalog.parse_area(bad)


def test_other_column_functions(spark):
    texts = ["BOX(1 -2.5,3e1 4)", "box(0 0,1 1)", "POINT(1 1)", None]
    got = [r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select(g.parse_box(F.col("t")).alias("b")).collect()]
    assert tuple(got[0]) == (1.0, -2.5, 30.0, 4.0) and tuple(got[1]) == (0, 0, 1, 1) and got[2:] == [None, None]
    df = spark.createDataFrame([(SQUARE,), (HOLED,), ("POLYGON ((0 0,1 1,0 0))",), ("POLYGON ((0 0,1 0,1 1,0 1))",), ("POLYGON ((0 0,1 x,1 1,0 0))",), ("LINESTRING (0 0,1 1)",)], "w string").withColumn("r", g.parse_wkt(F.col("w")))
    assert [r[0] for r in df.select(g.is_polygon(F.col("r"))).collect()] == [True, True, False, False, False, False]
    box = g.expand(g.envelope(F.col("r")), F.lit(0.5))
    row = df.where("w like '%1 0,1 1,0 1,0 0))'").select(box.alias("b"), g.box_area(box).alias("a"), g.box_perimeter(box).alias("p")).first()
    assert tuple(row.b) == (-0.5, -0.5, 1.5, 1.5) and (row.a, row.p) == (4, 8)
    there = df.where("w like '%3 3%'").select(g.degrees(g.mercator(F.col("r"))).alias("r")).first().r
    assert there[1][2].x == pytest.approx(2) and there[1][2].y == pytest.approx(2)


def test_hulls_and_groups(spark):
    assert circle.hull([(0, 0), (2, 0), (1, 0), (2, 2), (0, 2), (1, 1), (0, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert circle.hull([(1, 1)]) == [(1, 1)] and circle.hull([(0, 0), (1, 1), (2, 2)]) == [(0, 0), (2, 2)]
    rng = random.Random(4)
    rows = [(i % 3, rng.gauss(0, 5), rng.gauss(0, 5)) for i in range(300)] + [(7, 1.0, 1.0), (8, 0.0, 0.0), (8, 4.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    for together in (10_000, 9):
        for r in circle.group_circles(df, "k", together).collect():
            want = minimum_circle([{"x": x, "y": y} for k, x, y in rows if k == r.k])
            assert (r.cx, r.cy, r.r) == pytest.approx(want, abs=1e-6)
    assert circle.group_circles(df.limit(0), "k").count() == 0
    lists = [[(0, 0), (4, 0)], [(0, 0), (4, 0), (2, 5)], [(1, 1)] * 5, [], None, [(0, 0), None, (2, 0)], [(float(i), i % 7.0) for i in range(20)]]
    shape = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(i, None if v is None else [None if p is None else {"x": float(p[0]), "y": float(p[1])} for p in v]) for i, v in enumerate(lists)], f"i int, p {shape}")
    for r in df.select("i", circle.bounding_circle("p").alias("c"), circle.convex_hull("p").alias("h")).collect():
        points = [{"x": p[0], "y": p[1]} for p in lists[r.i] or [] if p is not None]
        want = minimum_circle(points)
        assert (r.c.r is None) if want is None else tuple(r.c) == pytest.approx(want)
        assert r.h is None if lists[r.i] is None else [tuple(p) for p in r.h] == circle.hull([(p["x"], p["y"]) for p in points])
