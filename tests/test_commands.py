import os
import tempfile

import pytest
from pyspark.sql import functions as F

from stratolith import commands
from stratolith.operators import catalog, params, raster
from stratolith.sources import shapefile, tables
from stratolith.sources.states import FIPS
from stratolith.streaming import incremental


@pytest.fixture(scope="module")
def log(spark):
    tables.init_namespaces(spark)
    tables.init_namespaces(spark)
    tables.ensure_log(spark, "naip.fetched2014")
    return "naip.fetched2014"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_log(spark, log):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "gid long")
    tables.record_fetched(spark, log, ids(1, 2, 2, None))
    tables.record_fetched(spark, log, ids(2, 3))
    assert rows(spark.table(log)) == [(1, None), (2, None), (3, None)]
    tables.record_processed(spark, log, ids(2, 9))
    assert rows(spark.table(log)) == [(1, None), (2, True), (3, None)]
    tables.record_fetched(spark, log, ids())
    folder, checkpoint = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    for part in (ids(3, 4), ids(4, 5)):
        part.write.mode("append").parquet(folder)
        incremental.log_arrivals(incremental.arrivals(spark, folder, "gid long"), log, checkpoint).awaitTermination()
    assert [r[0] for r in rows(spark.table(log))] == [1, 2, 3, 4, 5]


def test_segments_replace_their_job_only(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/segments"
    part = lambda *x: spark.createDataFrame([(i,) for i in x], "area int")
    tables.load_segments(part(1, 2), path, 2014, "a")
    tables.load_segments(part(7), path, 2014, "b")
    assert [r.area for r in tables.load_segments(part(5), path, 2014, "a").collect()] == [5]
    assert sorted(r.area for r in spark.read.parquet(path).collect()) == [5, 7]


def test_plan_and_report(spark):
    tiles = spark.createDataFrame([(i, "CA" if i < 3 else "NV", f"m_{i}.shp", float(i), 0.0, i + 1.0, 1.0) for i in range(5)], "gid long, st string, filename string, xmin double, ymin double, xmax double, ymax double")
    regions = spark.createDataFrame([("06001", 1.2, 0.1, 3.5, 0.5)], "geoid string, xmin double, ymin double, xmax double, ymax double")
    states = {"06": "CA"}
    log = spark.createDataFrame([(2, None), (3, True)], "gid long, processed boolean")
    plan = lambda area: [r.gid for r in commands.plan_fetch(tiles, regions, log, area, states).orderBy("gid").collect()]
    assert plan("06") == [0, 1] and plan("06001") == [1] and plan("3.5,0,4.5,1") == [4] and plan("99") == []
    assert [(r.gid, r.worker) for r in commands.plan_process(tiles, log, 2).collect()] == [(2, 0)]
    assert [r.line for r in commands.status_report(tiles).collect()] == ["CA                  3", "NV                  2"]
    with pytest.raises(ValueError):
        plan("123")
    shown = {r.key: r.value for r in commands.describe_config(spark, {"dbpass": "abc", "dbname": "x"}).collect()}
    assert shown == {"dbpass": "***", "dbname": "x"}
    assert FIPS["64"] == "fm" and FIPS["03"] == FIPS["60"] == "as" and len(FIPS) == 58


def test_regions_and_windows(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (2, 0), (2, 3), (0, 0))]
    shapefile.write_zipped(spark.createDataFrame([("06001", [[ring]]), ("32001", None)], f"geoid string, geom {shapefile.GEOMETRY}"), folder).collect()
    got = commands.ingest_regions(spark, folder, ["06"]).collect()
    assert [(r.geoid, r.xmin, r.ymax) for r in got] == [("06001", 0.0, 3.0)]
    pixels = spark.createDataFrame([(0, y, x, x * 10 + y) for x in range(6) for y in range(6)], "band int, y int, x int, dn int")
    cut = commands.extract_image(pixels, (100.0, 50.0), (1.0, -1.0), (103.0, 47.0), 2, 2).collect()
    assert sorted((r.x, r.y, r.dn) for r in cut) == [(0, 0, 22), (0, 1, 23), (1, 0, 32), (1, 1, 33)]


def test_tiles_of_a_bent_county(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0))]
    regions = spark.createDataFrame([("06001", [[ring]], 0.0, 0.0, 4.0, 4.0)], f"geoid string, geom {shapefile.GEOMETRY}, xmin double, ymin double, xmax double, ymax double")
    tiles = spark.createDataFrame([(1, "ca", 0.2, 0.2), (2, "ca", 2.5, 2.5), (3, "ca", 3.5, 0.5), (4, "ca", 9.0, 9.0)], "gid long, st string, xmin double, ymin double")
    tiles = tiles.selectExpr("*", "xmin + 0.4 xmax", "ymin + 0.4 ymax", "'x' filename", "'y' outline", "'z' region")
    got = commands.tiles_of_area(tiles, regions, "06001", {})
    assert sorted(r.gid for r in got.collect()) == [1, 3] and got.columns == tiles.columns
    assert commands.tiles_of_area(tiles, regions, "06", {"06": "ca"}).count() == 4
    assert [r.gid for r in commands.tiles_around(tiles, 9.0, 9.0, 400).collect()] == [4]


def test_census_and_catalogue(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    ring = lambda x: [{"x": float(a), "y": float(b)} for a, b in ((x, 0), (x, 1), (x + 1, 1), (x + 1, 0), (x, 0))]

    def put(name, rows):
        made = tempfile.mkdtemp(prefix="spark-")
        shapefile.write_zipped(spark.createDataFrame([(a, b, [[ring(x)]]) for a, b, x in rows], f"statefp string, geoid string, geom {shapefile.GEOMETRY}").coalesce(1), "file://" + made).collect()
        os.rename(next(f"{made}/{f}" for f in os.listdir(made) if f.endswith(".zip")), f"{folder}/{name}.zip")

    put("tl_2016_us_county", [("06", "06001", 0), ("06", "06003", 5), ("32", "32001", 9)])
    put("tl_2016_06_cousub", [("06", "0600190000", 0)])
    put("tl_2016_32_cousub", [("32", "3200190000", 9)])
    for code in ("06001", "06003", "32001"):
        put(f"tl_2016_{code}_roads", [(code[:2], code, 0)])
    ids = lambda area: {k: sorted(r.geoid for r in df.collect()) for k, df in commands.ingest_census(spark, "file://" + folder, area).items()}
    counties = ["06001", "06003", "32001"]
    assert ids("06") == {"county": counties, "cousub": ["0600190000"], "roads": ["06001", "06003"]}
    assert ids("0600190000") == {"county": counties, "cousub": ["0600190000"], "roads": ["06001"]}
    assert ids([4, 0, 9.5, 1]) == {"county": counties, "cousub": ["0600190000", "3200190000"], "roads": ["06003", "32001"]}
    with pytest.raises(ValueError):
        commands.ingest_census(spark, "file://" + folder, [90, 90, 91, 91])
    urls = commands.catalogue_sources(spark, "https://x/{0}/{1}_naip{2}qq.zip?a=%20", "2014", ["CA", "nv"]).collect()
    assert [r.url for r in urls] == ["https://x/2014/ca_naip14qq.zip?a=%20", "https://x/2014/nv_naip14qq.zip?a=%20"]
    assert commands.catalogue_sources(spark, "{1}", "2014").count() == 57


def test_reports_and_lists(spark):
    segments = spark.createDataFrame([(1, 2.0), (3, 4.0)], "nbpixels int, area double")
    lines = [r.line for r in commands.profile_report(segments).collect()]
    assert len(lines) == 2 and lines[0].startswith(" nbpixels | 1.000000 | 3.000000 | 2.000000 |") and "area" in lines[1]
    names = [f"{a}_{b}" for a in ("hs", "hr", "m") for b in ("min", "max", "avg")]
    best = spark.createDataFrame([tuple(range(1, 10))], ", ".join(f"{n} int" for n in names))
    assert [r.line for r in commands.parameter_report(best).collect()] == ["min |   1  |   4  |    7", "max |   2  |   5  |    8", "avg |   3  |   6  |    9"]
    assert catalog.parse_list("0,1, 2,4") == [0, 1, 2, 4] and catalog.parse_list("") == [] and catalog.parse_flag("yes") and not catalog.parse_flag("0")
    tiles = spark.createDataFrame([(1, "m_123.shp"), (2, "m_124.shp"), (3, "m_1234567_ne_11_1_20140601_20141101.shp")], "gid long, filename string")
    find = lambda *names: sorted(r.gid for r in catalog.find_by_name(tiles, spark.createDataFrame([(n,) for n in names], "file string"), "file").collect())
    assert find("/d/m_12.tif") == [1, 2, 3] and find("m_123.tif", "m_1234567_ne_11_1_20140601_2.tif") == [1, 3] and find("none.tif") == [] == find("/d/.tif")
    assert find("/d/m_1234567_ne_11_1_20140601_20141101.tif") == [3]


def test_images_by_place(spark):
    rows = [(i, b, y, x, 1000 * i + 100 * b + 10 * y + x) for i in (0, 1) for b in (0, 1) for y in range(6) for x in range(6)]
    images = spark.createDataFrame(rows, "image int, band int, y int, x int, dn int")
    grids = spark.createDataFrame([(0, 100.0, 1.0, 50.0, -1.0, "EPSG:4326"), (1, 104.0, 1.0, 50.0, -1.0, "EPSG:4326")], "image int, x0 double, dx double, y0 double, dy double, srs string")
    rasters = raster.metadata(images, grids)
    assert [(r.width, r.height, r.bands, r.kind) for r in rasters.orderBy("image").collect()] == [(6, 6, [0, 1], "byte"), (6, 6, [0, 1], "uint16")]
    path = tempfile.mkdtemp(prefix="spark-") + "/crop"
    got = raster.from_tiles(commands.extract_place(images, rasters, 47.0, 104.0, 2, 2, path, [1])).collect()
    assert sorted((r.band, r.y, r.x, r.dn) for r in got) == [(0, 0, 0, 123), (0, 0, 1, 1120), (0, 1, 0, 133), (0, 1, 1, 1130)]
    best = commands.optimal_parameters_of(images, rasters, 47.0, 105.0, 512, [0, 1]).first()
    assert best.hs_avg >= 2 and best.m_avg == best.hs_avg**2 // 4
    with pytest.raises(ValueError):
        raster.mosaic_of(images, rasters.withColumn("dx", F.col("image") + 1.0))
    grid = (6, 6, (100.0, 1.0, 50.0, -1.0), (100.0, 1.0, 50.0, -1.0))
    four = images.where("image = 0").unionByName(images.where("image = 0").withColumn("band", F.col("band") + 2))
    done = raster.from_tiles(commands.process_tiles(four, tempfile.mkdtemp(prefix="spark-") + "/t", {0: grid}))
    assert {(r.band): r["count"] for r in done.groupBy("band").count().collect()} == {b: 36 for b in range(5)}
    part = commands.segment_area(images.where("image = 0"), tempfile.mkdtemp(prefix="spark-") + "/s", 2014, "a", 1, 500.0, 2)
    assert part.agg(F.sum("nbpixels")).first()[0] == 36 and part.where("nbpixels < 2").count() == 0
    with pytest.raises(ValueError):
        commands.segment_area(images, "x", 2014, "", 1, 5.0, 2)
    fit = params.variance_fit(four.drop("image"), 3).collect()
    assert len(fit) == 4 and all(r.sigma >= 0 for r in fit)
    assert params.variance_series(four.drop("image"), 3, 5).groupBy("band").agg(F.sum("pixels").alias("n")).where("n <> 36").count() == 0
