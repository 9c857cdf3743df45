import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratolith.functions import geometry as g
from stratolith.functions import projections as p
from stratolith.functions.shapes import areas, measured
from stratolith.operators import metrics, params, raster, segment, warp
from stratolith.sources import shapefile

UTM11 = 'PROJCS["NAD_1983_UTM_Zone_11N",GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-117.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'


def test_published_places():
    """A textbook example on the Clarke 1866 ellipsoid (40.5 N, 73.5 W, zone 18), and a tower in zone 17."""
    clarke = p.Srs("transverse", -75.0, 0.0, 0.9996, 0.0, 0.0, 6378206.4, 294.978698)
    x, y = p.forward(np.float64(-73.5), np.float64(40.5), clarke, p.ARRAYS)
    assert (round(float(x), 1), round(float(y), 1)) == (127106.5, 4484124.4)
    x, y = p.forward(np.float64(-79.387139), np.float64(43.642567), p.parse("EPSG:32617"), p.ARRAYS)
    assert (round(float(x)), round(float(y))) == (630084, 4833439)


def test_all_systems_both_ways():
    dice = np.random.default_rng(1)
    for name in ("EPSG:4326", "EPSG:3857", "EPSG:32611", "EPSG:32733", "EPSG:26911", UTM11):
        srs = p.parse(name)
        lon = (srs.lon0 if srs.kind == "transverse" else 0) + dice.uniform(-4, 4, 1000)
        lat = dice.uniform(-80, 0, 1000) if name == "EPSG:32733" else dice.uniform(0, 80, 1000)
        back = p.inverse(*p.forward(lon, lat, srs, p.ARRAYS), srs, p.ARRAYS)
        assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9
    assert p.parse(UTM11) == p.utm(11) and p.parse("epsg:32733").north == 1e7
    other = p.Srs("transverse", -75.0, 38.0, 0.99998, 2e5, 1e5)
    at = p.forward(np.float64(-75.0), np.float64(38.0), other, p.ARRAYS)
    assert np.allclose(at, (2e5, 1e5))
    for bad in ("EPSG:2227", 'PROJCS["x",PROJECTION["Lambert_Conformal_Conic"],UNIT["Meter",1.0]]', UTM11.replace('UNIT["Meter",1.0]', 'UNIT["Foot_US",0.3048006096]'), "nothing"):
        with pytest.raises(ValueError):
            p.parse(bad)


def ring(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def frame(spark, polygons):
    rows = [(i, r if r is None else [[{"x": float(a), "y": float(b)} for a, b in q] for q in r]) for i, r in enumerate(polygons)]
    return spark.createDataFrame(rows, "id int, rings array<array<struct<x:double,y:double>>>")


def test_congruent_polygons_far_from_the_origin(spark):
    far = [[[(x + dx, y + dy) for x, y in [(0.1, 0.2), (1.3, 0.2), (1.3, 1.7), (0.1, 0.2)]]] for dx, dy in ((0, 0), (-13_000_000, 4_000_000), (-13_000_000.5, 4_000_007))]
    rows = metrics.with_metrics(frame(spark, far)).orderBy("id").collect()
    plain = frame(spark, far).select("id", g.area(F.col("rings")).alias("a")).orderBy("id").collect()
    for r, q in zip(rows, plain, strict=True):
        assert r.area == pytest.approx(0.9, rel=1e-7) and q.a == pytest.approx(0.9, rel=1e-7) and r.circle == pytest.approx(rows[0].circle, rel=1e-5)
    # Coordinates that doubles hold exactly give the same bits.
    exact = [[[(x + d, y) for x, y in ring(0, 0, 3.5)], [(x + d, y) for x, y in ring(1, 1, 0.25)]] for d in (0.0, -13_000_000.0)]
    a, b = metrics.with_metrics(frame(spark, exact)).orderBy("id").collect()
    assert [a[m] for m in metrics.METRICS] == [b[m] for m in metrics.METRICS] and a.area == 3.5**2 - 0.25**2


def test_metrics_of_odd_polygons(spark):
    rows = metrics.with_metrics(frame(spark, [None, [], [[]], [[(1, 1)]], [ring(0, 0, 2)]])).orderBy("id").collect()
    assert rows[0].area is None and rows[0].perim is None and rows[1].area is None
    assert (rows[2].area, rows[2].perim, rows[3].area) == (0, 0, 0) and (rows[4].area, rows[4].perim) == (4, 8)


def test_metrics_of_degrees_are_those_of_mercator(spark):
    lon, lat, d = -117.0, 33.0, 1e-5
    rings = [[[(lon, lat), (lon + 2 * d, lat), (lon + 2 * d, lat + 3 * d), (lon, lat + 3 * d), (lon, lat)]]]
    row = metrics.with_metrics(frame(spark, rings), srs="EPSG:4326").first()
    up = lambda v: 6378137 * math.log(math.tan(math.pi / 4 + math.radians(v) / 2))
    w, h = 6378137 * math.radians(2 * d), up(lat + 3 * d) - up(lat)
    assert row.area == pytest.approx(w * h, rel=1e-6) and row.perim == pytest.approx(2 * (w + h), rel=1e-6) and row.area > 8
    assert row.frac == pytest.approx(2 * math.log(row.perim / 4) / math.log(row.area)) and row.rings[0][0]["x"] == lon
    utm = p.forward(np.array([x for x, _ in rings[0][0]]), np.array([y for _, y in rings[0][0]]), p.utm(11), p.ARRAYS)
    same = metrics.with_metrics(frame(spark, [[list(zip(*map(list, utm), strict=True))]]), srs="EPSG:26911").first()
    assert same.area == pytest.approx(row.area, rel=1e-6)


def test_packages_in_utm_are_read_as_degrees(monkeypatch):
    monkeypatch.setitem(shapefile.SYSTEMS, 3857, UTM11)
    shape = [[[{"x": 500000.0 + a, "y": 3700000.0 + b} for a, b in ring(0, 0, 100)]]]
    ((attributes, parts),) = shapefile._rows(shapefile._package(["gid"], [pa.array([1])], [shape], 3857))
    lon, lat = p.inverse(np.float64(500000.0), np.float64(3700000.0), p.utm(11), p.ARRAYS)
    assert attributes == {"gid": 1} and any(abs(x - lon) < 1e-9 and abs(y - lat) < 1e-9 for x, y in parts[0][0])
    monkeypatch.setitem(shapefile.SYSTEMS, 3857, 'PROJCS["x",PROJECTION["Lambert_Conformal_Conic"],UNIT["Meter",1.0]]')
    ((_, parts),) = shapefile._rows(shapefile._package(["gid"], [pa.array([1])], [shape], 3857))
    assert parts[0][0][0] == (500000.0, 3700000.0)


def image(spark, values, band=0):
    return spark.createDataFrame([(band, y, x, None if v is None else int(v)) for (y, x), v in np.ndenumerate(values)], "band int, y int, x int, dn int")


def test_windows_over_missing_pixels(spark):
    flat = np.full((9, 8), 7, object)
    flat[3, 3] = flat[0, 0] = None
    for mode in ("float", "int"):
        for n in (1, 3, 4, 20):
            found = params.local_variance(image(spark, flat), n, mode, tile=4).collect()
            assert len(found) == 70 and all(r.lv == 0 for r in found)
    dice = np.random.default_rng(2)
    values = dice.integers(0, 50, (7, 9)).astype(object)
    values[2, 2] = values[6, 8] = None
    gone = image(spark, values).where("not (y = 3 and x = 3)")
    there = {(y, x): int(v) for (y, x), v in np.ndenumerate(values) if v is not None and (y, x) != (3, 3)}

    def mirrored(i, n):
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i

    for n in (3, 6, 17):
        for r in params.local_variance(gone, n, tile=4).collect():
            seen = [there[q] for a in range(-(n // 2), n - n // 2) for b in range(-(n // 2), n - n // 2) if (q := (mirrored(r.y + a, 7), mirrored(r.x + b, 9))) in there]
            assert r.lv == pytest.approx(np.var(seen), abs=1e-9), (n, r)


def test_semivariogram_does_not_depend_on_tiles(spark):
    pixels = image(spark, np.random.default_rng(3).integers(0, 99, (23, 31)))
    rows = lambda t: sorted(map(tuple, params.semivariogram(pixels, (1, 2, 5, 9, 22), tile=t).collect()))
    assert rows(4) == rows(7) == rows(256)


def test_pixels_that_move_far_cross_tiles(spark):
    """One colour, the denser the farther right: pixels climb over several tiles in a hundred steps."""
    wedge = spark.createDataFrame([(0, y, x, 7) for x in range(40) for y in range(1 + x // 3)], "band int, y int, x int, dn int")
    got = [sorted((r.y, r.x, *r.colour, r.my, r.mx) for r in segment.mean_shift(wedge, 4, 8.0, 100, 0.001, tile=t).collect()) for t in (6, 64)]
    assert len(got[0]) == wedge.count() and np.allclose(got[0], got[1])
    assert max(abs(r[1] - r[-1]) for r in got[0]) > 6
    values = (np.arange(40)[None, :] // 2 + np.zeros((5, 1), int)).astype(object)
    ramp = segment.mean_shift(image(spark, values), 2, 0.5, 5, tile=64, ramp=0.5)
    assert ramp.count() == 200 and ramp.collect() != segment.mean_shift(image(spark, values), 2, 0.5, 5, tile=64).collect()


def test_masked_pixels_hide_nothing(spark):
    rows = [(1, 0, 0, 0, 7), (2, 0, 0, 0, None), (1, 0, 0, 1, None)]
    places = spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 2)], "image int, dx int, dy int, priority int")
    assert [tuple(r) for r in raster.mosaic(spark.createDataFrame(rows, "image int, band int, y int, x int, dn int"), places).collect()] == [(0, 0, 0, 7)]


def test_grids_in_degrees_and_many_images_in_one_plan(spark):
    rasters = spark.createDataFrame([(i, 30, 20, 500000.0 + 300 * i, 10.0, 3700000.0, -10.0, f"EPSG:269{10 + i % 2}") for i in range(40)], "image int, width int, height int, x0 double, dx double, y0 double, dy double, srs string")
    grids = warp.degrees_grids(rasters)
    one = grids.where("image = 0").first()
    diagonal = math.hypot(one.ow, one.oh)
    assert abs(diagonal - math.hypot(30, 20)) < 2 and -123.001 < one.ox0 <= -123.0
    pixels = spark.range(40 * 600).selectExpr("cast(id div 600 as int) image", "0 band", "cast(id % 600 div 30 as int) y", "cast(id % 30 as int) x", "cast(id % 200 + 1 as int) dn")
    tiles = warp.normalised(raster.to_tiles(pixels, 16), grids, 16)
    back = raster.from_tiles(tiles).groupBy("image").agg(F.count_if(F.col("band") == 0).alias("red"), F.count_if(F.col("band") == 3).alias("alpha")).collect()
    assert len(back) == 40 and all(r.red == r.alpha and 500 < r.red < 700 for r in back)
    few = warp.normalised(raster.to_tiles(pixels.where("image < 2"), 16), grids.where("image < 2"), 16)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(tiles) == size(few) or abs(size(tiles) - size(few)) < 5
    same = rasters.limit(1).withColumn("srs", F.lit("EPSG:4326")).withColumns({"x0": F.lit(-117.0), "y0": F.lit(33.0), "dx": F.lit(1e-4), "dy": F.lit(-1e-4)})
    plain = warp.degrees_grids(same).first()
    assert (plain.ow, plain.oh) == (30, 20) and plain.odx == pytest.approx(1e-4)


def test_measured_takes_slices():
    points = [[[{"x": float(a), "y": float(b)} for a, b in ring(i, i, i + 1)]] for i in range(5)]
    whole = pa.array([None, *points], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    area, perim, r = measured(whole.slice(2, 3))
    assert area.tolist() == [4, 9, 16] and perim.tolist() == [8, 12, 16] and np.allclose(r, np.sqrt(2) * np.array([1, 1.5, 2]))


def test_areas_alone_are_those_of_columns_and_measures(spark):
    shape = "array<array<struct<x:double,y:double>>>"
    at = lambda points: [{"x": float(a), "y": float(b)} for a, b in points]
    rows = [([at(ring(i % 9, i % 7, 5 + i % 9)), at(ring(i % 9 + 1, i % 7 + 1, i % 9 + 2)), at(ring(i % 9 + 3, i % 7 + 3, i % 9 + 4))][: 1 + i % 3],) for i in range(60)] + [(None,), ([],), ([[]],)]
    df = spark.createDataFrame(rows, f"r {shape}").coalesce(1)
    r = F.col("r")
    found = df.select(areas()(r).alias("flat"), g.area(r).alias("column"), areas("EPSG:4326")(r).alias("metres"), g.area(g.mercator(r)).alias("column_metres")).collect()
    for row in found[:60]:
        assert row.flat == row.column and row.metres == pytest.approx(row.column_metres, rel=1e-12)
    assert [tuple(row[c] for c in ("flat", "metres")) for row in found[60:]] == [(None, None), (None, None), (0, 0)]
    whole = pa.array([x for x, in rows], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    assert [row.flat for row in found[:60]] == measured(whole)[0][:60].tolist()


def test_an_area_works_its_rings_out_once(spark):
    """Mapped rings were worked out again for every corner of every edge: 170 us a rectangle."""
    df = spark.range(1).select(F.array(g.rectangle(*[F.col("id") + k for k in (0, 1, 2, 3)])).alias("r"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan(df.select(g.area(g.mercator(F.col("r"))).alias("a"))).count("tan(") == 1
