import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratolith import commands
from stratolith.functions import geometry as g
from stratolith.operators import outlines, overlay, params, raster, segment, virtual

RINGS = "array<array<struct<x:double,y:double>>>"


def polygons(spark, named, key):
    rows = [(k, r if r is None else [[{"x": float(a), "y": float(b)} for a, b in q] for q in r]) for k, r in named.items()]
    return spark.createDataFrame(rows, f"{key} int, rings {RINGS}")


def star(dice, x, y, size, n):
    angles = sorted(dice.uniform(0, 2 * np.pi) for _ in range(n))
    ring = [(x + size * dice.uniform(0.3, 1) * np.cos(a), y + size * dice.uniform(0.3, 1) * np.sin(a)) for a in angles]
    return [*ring, ring[0]]


def square(x, y, d):
    return [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]


@pytest.mark.parametrize("cell", [0.7, 4.0, 50.0])
def test_polygons_that_share_a_point(spark, cell):
    """Against all edges of each pair; whole numbers make touches, edges on cells' lines and corners on edges."""
    dice = random.Random(8)
    a = {i: [star(dice, dice.uniform(-9, 9), dice.uniform(-9, 9), dice.uniform(0.1, 3), dice.randint(3, 9))] for i in range(25)}
    b = {i: [star(dice, dice.uniform(-9, 9), dice.uniform(-9, 9), dice.uniform(0.1, 8), dice.randint(3, 30))] for i in range(25)}
    for i in range(25, 50):
        a[i] = [square(dice.randint(-8, 8), dice.randint(-8, 8), dice.randint(1, 3))]
        b[i] = [square(dice.randint(-8, 8), dice.randint(-8, 8), 6), square(0, 0, 1)] if i % 3 else [[(p, q), (p + 4, q), (p, q + 4), (p, q)] for p, q in [(dice.randint(-8, 4), dice.randint(-8, 4))]]
    b[50], b[51], a[50] = None, [], []
    b[52] = [square(-20, -20, 40), square(-5, -5, 10)]  # a frame around most
    fa, fb = polygons(spark, a, "i"), polygons(spark, b, "j")
    got = sorted(map(tuple, overlay.shared(fa, fb, "i", "j", cell).collect()))
    want = fa.crossJoin(fb.withColumnRenamed("rings", "other")).where(g.intersects(F.col("rings"), F.col("other"))).select("i", "j").collect()
    assert got == sorted(map(tuple, want)) and len(got) > 300


def test_a_county_of_many_vertices(spark):
    angle = np.linspace(0, 2 * np.pi, 3001)
    reach = 40 + 3 * np.sin(37 * angle)
    shore = list(zip((50 + reach * np.cos(angle)).tolist(), (50 + reach * np.sin(angle)).tolist(), strict=True))
    county = polygons(spark, {1: [[*shore[:-1], shore[0]]]}, "region")
    tiles = {i: [square(i % 100, i // 100, 0.5)] for i in range(0, 10_000, 7)}
    got = {r.i for r in overlay.shared(polygons(spark, tiles, "i"), county, "i", "region", 2.0).collect()}
    far = lambda p: np.hypot(p[0] - 50, p[1] - 50)
    for i, (ring,) in tiles.items():
        if min(map(far, ring)) < 36.9:
            assert i in got
        if min(map(far, ring)) > 44:
            assert i not in got
    assert "Cartesian" not in (plan := overlay.shared(polygons(spark, tiles, "i"), county, "i", "region", 2.0)._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def test_tilted_tiles_are_judged_by_their_outline(spark):
    d = (100 / 2 + 100) * commands.DEGREES_PER_PIXEL
    tilted = [(1, [[(0.0, 0.0), (10 * d, 0.0), (0.0, 10 * d), (0.0, 0.0)]]), (2, [square(5.9 * d, 5.9 * d, d)]), (3, [square(50 * d, 0, d)])]
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings], *[float(f(p[k] for p in rings[0])) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1))]) for i, rings in tilted]
    tiles = spark.createDataFrame(rows, f"gid int, rings {RINGS}, xmin double, ymin double, xmax double, ymax double")
    assert [r.gid for r in commands.tiles_around(tiles, 6.9 * d, 6.9 * d, 100).collect()] == [2]
    assert sorted(r.gid for r in commands.tiles_around(tiles.drop("rings"), 6.9 * d, 6.9 * d, 100).collect()) == [1, 2]


def frame(spark, values):
    return spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(values)], "band int, y int, x int, dn int")


def test_outlines_do_not_depend_on_tiles(spark):
    """Regions with holes, pinched corners and sides along tiles' edges."""
    values = np.random.default_rng(9).integers(0, 2, (14, 17)) * 40
    values[2:12, 4:13] = 80
    values[4:9, 6:9] = 0
    labels = segment.connected_labels(frame(spark, values), 16).withColumn("y", F.col("y") - 6)
    found = {t: {r.label: r.rings for r in segment.vectorise(labels, t).collect()} for t in (3, 4, 100)}
    size = {t: {k: (len(v), [(p.x, p.y) for p in v[0]]) for k, v in f.items()} for t, f in found.items()}
    assert size[3] == size[4] == size[100]
    rings = {t: {k: sorted([(p.x, p.y) for p in r] for r in v) for k, v in f.items()} for t, f in found.items()}
    assert rings[3] == rings[4] == rings[100]
    area = {r.label: r.a for r in segment.vectorise(labels, 3).select("label", g.area(F.col("rings")).alias("a")).collect()}
    assert area == {r.label: float(r["count"]) for r in labels.groupBy("label").count().collect()}


def test_ranks_along_long_rings(spark):
    n = 700
    order = random.Random(1).sample(range(n), n)
    links = [(order[i], order[(i + 1) % n]) for i in range(n)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    rows = outlines.ranked(spark.createDataFrame(links, "way long, next long")).collect()
    ring = sorted((r["rank"], r.way) for r in rows if r.ring == 0)
    start = order.index(0)
    assert [w for _, w in ring] == [order[(start + i) % n] for i in range(n)]
    assert {r.ring for r in rows} == {0, 5000, 6000}


def test_curve_is_a_bijection_of_near_cells(spark):
    cells = spark.range(4096).selectExpr("cast(id % 64 - 32 as int) x", "cast(id div 64 - 32 as int) y")
    rows = cells.select("x", "y", virtual.curve(F.col("x"), F.col("y")).alias("z")).collect()
    assert len({r.z for r in rows}) == 4096
    block = sorted(r.z for r in rows if 0 <= r.x < 8 and 0 <= r.y < 8)
    assert block[-1] - block[0] == 63


def test_a_window_reads_its_tiles(spark):
    path = "file://" + tempfile.mkdtemp(prefix="spark-")
    values = np.arange(60 * 50).reshape(60, 50)
    images = frame(spark, values).withColumn("image", F.lit(3)).unionByName(frame(spark, -values[:10]).withColumn("image", F.lit(4)))
    places = spark.createDataFrame([(3, -7, 5, 1), (4, -7, 40, 2)], "image int, dx int, dy int, priority int")
    index = virtual.write_index(raster.to_tiles(images, 8), places, path)
    part = virtual.window(index, -3, 30, 20, 15)
    got = {(r.y, r.x): r.dn for r in part.collect()}
    want = {(y, x): int(-values[y + 30 - 40, x + 4] if y + 30 >= 40 else values[y + 30 - 5, x + 4]) for y in range(15) for x in range(20)}
    assert got == want
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    pushed = virtual.window(index, -3, 30, 20, 15)._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f"{c}," in pushed for c in ("left", "right", "top", "bottom"))


def test_arguments_are_checked_before_anything_is_read():
    nothing = [None] * 5
    base = dict(area="06", states={}, path="p", year=2014, job="a", index="i")
    for bad in ({"optimal": "most"}, {"spatial": 0}, {"spectral": 0.0}, {"least": -1}, {"iterations": 0}, {"threshold": -1.0}, {"ramp": -0.1}, {"side": 0}, {"tile": 0}, {"job": ""}, {"bands": []}, {"bands": [-1]}):
        with pytest.raises(ValueError):
            commands.segment_of_area(*nothing, **{**base, **bad})
    for bad in ({"side": 0}, {"lat": 3.0}):
        with pytest.raises(ValueError):
            commands.optimal_parameters_of_area(*nothing, area="06", states={}, index="i", **bad)


def test_from_an_area_to_parameters_and_segments(spark):
    values = np.kron(np.random.default_rng(3).integers(0, 4, (8, 8)) * 50, np.ones((8, 8), int))
    images = frame(spark, values).withColumn("image", F.lit(1)).unionByName(frame(spark, values + 3).withColumn("image", F.lit(2)))
    rasters = spark.createDataFrame([(1, 64, 64, -117.0, 1e-4, 33.0, -1e-4, "EPSG:4326"), (2, 64, 64, -117.0 + 64e-4, 1e-4, 33.0, -1e-4, "EPSG:4326")], "image int, width int, height int, x0 double, dx double, y0 double, dy double, srs string")
    tiles = spark.createDataFrame([(g_, "ca", -117.0 + 64e-4 * (g_ - 1), 32.99, -117.0 + 64e-4 * g_, 33.0) for g_ in (1, 2, 3)], "gid int, st string, xmin double, ymin double, xmax double, ymax double")
    log = spark.createDataFrame([(1, True), (2, True)], "gid int, processed boolean")
    none = spark.createDataFrame([], "geoid string, xmin double, ymin double, xmax double, ymax double")
    new = lambda: "file://" + tempfile.mkdtemp(prefix="spark-")
    best = commands.optimal_parameters_of_area(images, rasters, tiles, none, log, "06", {"06": "CA"}, new(), side=48).first()
    assert best.hs_min >= 2 and best.m_avg == best.hs_avg**2 // 2
    with pytest.raises(ValueError):
        commands.optimal_parameters_of_area(images, rasters, tiles, none, log, "06", {"06": "CA"}, new(), lat=60.0, lon=-117.0)
    with pytest.raises(ValueError):
        commands.optimal_parameters_of_area(images, rasters, tiles, none, log.limit(0), "06", {"06": "CA"}, new())
    made = commands.segment_of_area(images, rasters, tiles, none, log, "06", {"06": "CA"}, new(), 2014, "a", new(), 2, 20.0, 5, iterations=3, tile=64).toPandas()
    assert made.nbpixels.sum() == 2 * 64 * 64 and (made.area > 90 * made.nbpixels).all() and set(made.year) == {2014}


def test_no_parameters_of_too_few_pixels(spark):
    two = frame(spark, np.array([[5, 6]]))
    assert params.optimal_parameters(two).collect() == []
    with pytest.raises(ValueError, match="too few pixels"):
        commands.segment_optimal(two)
