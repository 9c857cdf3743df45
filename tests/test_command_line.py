import glob
import tempfile

import pytest
from pyspark.sql import functions as F

from stratolith.__main__ import run
from stratolith.sources import shapefile

DX = 1e-4


@pytest.fixture(scope="module")
def data(spark):
    """Packages of two states' counties and tiles; images of 12 pixels square for the three tiles of the first."""
    folder = tempfile.mkdtemp(prefix="spark-")
    box = lambda x, w: [[[{"x": a, "y": b} for a, b in ((x, 30.0), (x + w, 30.0), (x + w, 30 + w), (x, 30 + w), (x, 30.0))]]]
    census = [("06", "06001", box(-117.0, 1.0), "tl_2016_us_county"), ("32", "32001", box(-110.0, 1.0), "tl_2016_us_county")]
    census += [("06", "0600190000", box(-117.0, 1.0), "tl_2016_06_cousub"), ("06", "06001", box(-117.0, 0.5), "tl_2016_06001_roads"), ("32", "32001", box(-110.0, 0.5), "tl_2016_32001_roads")]
    ddl = f"geom {shapefile.GEOMETRY}, package string"
    shapefile.write_zipped(spark.createDataFrame(census, "statefp string, geoid string, " + ddl), folder + "/source", named="package").collect()
    named = "m_{0:07d}_ne_11_1_20140601_20141101.shp".format
    tiles = [(i, "CA", named(i), box(-117.0 + (i - 1) * 12 * DX, 12 * DX), "ca_naip14qq") for i in (1, 2, 3)] + [(9, "NV", named(9), box(-110.0, DX), "nv_naip14qq")]
    shapefile.write_zipped(spark.createDataFrame(tiles, "gid long, st string, filename string, " + ddl), folder + "/source", named="package").collect()
    pixels = [(i, b, y, x, 10 * b + (100 if x + 12 * i > 20 else 0) + (y * x) % 5) for i in (1, 2) for b in range(4) for y in range(12) for x in range(12)]
    spark.createDataFrame(pixels, "image int, band int, y int, x int, dn int").write.parquet(folder + "/images")
    rasters = [(i, 12, 12, -117.0 + (i - 1) * 12 * DX, DX, 30 + 12 * DX, -DX, "EPSG:4326") for i in (1, 2)]
    spark.createDataFrame(rasters, "image int, width int, height int, x0 double, dx double, y0 double, dy double, srs string").write.parquet(folder + "/rasters")
    return folder


def test_from_packages_to_segments(spark, data):
    def call(*words):
        got = run(spark, ["--data", data, *words])
        return None if got is None else [tuple(r) for r in got.collect()]

    source = ["--source", data + "/source"]
    assert ("default-area", "") in call("info")
    assert call("init-db") is None and call("census-fetch", "-a", "06", *source) is None
    assert {r.geoid for r in spark.read.parquet(data + "/roads").collect()} == {"06001"} and spark.read.parquet(data + "/county").count() == 2
    assert sorted(r[0] for r in call("naip-fetch", "-a", "06001", *source)) == [1, 2, 3]
    assert {r.gid for r in spark.read.parquet(data + "/tiles").collect()} == {1, 2, 3}
    assert call("naip-fetch", "-a", "-110.5,29,-109,31", "--no-naip", *source) is None and {r.gid for r in spark.read.parquet(data + "/tiles").collect()} == {9}
    call("naip-fetch", "--all-states", "--no-naip", *source)
    spark.createDataFrame([(1, None), (2, None)], "gid long, processed boolean").write.mode("append").insertInto("naip.fetched2014")
    assert [r[0] for r in call("naip-fetch", "-a", "0600190000", "--no-shp")] == [3]
    assert [r[0].split() for r in call("naip-fetch", "--all-states", "--no-shp", "--status")] == [["CA", "3"], ["NV", "1"], ["CA", "2"]]

    assert call("segment", "-a", "06", "-j", "one", "-b", "0,1", "-s", "1", "-r", "40", "-m", "2", "-i", "5") is None
    found = spark.read.parquet(data + "/segments")
    assert found.agg(F.sum("nbpixels")).first()[0] == 288 and found.count() >= 2 and {(r.year, r.job) for r in found.select("year", "job").distinct().collect()} == {(2014, "one")}
    assert any(line.startswith(" nbpixels") for (line,) in call("polygon-stats", "-j", "one")) and call("polygon-stats", "-j", "two") is not None
    assert [line[:3] for (line,) in call("optimal-params", "-a", "06", "-b", "0,1", "-s", "12")] == ["min", "max", "avg"]
    call("extract-image", "-l", f"{30 + 6 * DX},{-117 + 12 * DX}", "-s", "4,2", "-b", "0", "--to", data + "/cut")
    assert spark.read.parquet(data + "/cut").count() >= 1

    assert call("naip-process", "-n", "2", "-l", "1") is None
    assert {(r.gid, r.processed) for r in spark.table("naip.fetched2014").collect()} == {(1, True), (2, True)}
    assert len(glob.glob(data + "/runs/*/tiled")) == 1 == len(glob.glob(data + "/runs/*/tiled_overviews"))


@pytest.mark.parametrize("words", [[], ["fly"], ["segment"], ["naip-process", "-n", "x"], ["segment", "-j", "a", "-o", "best"]])
def test_bad_arguments(spark, data, words):
    with pytest.raises(SystemExit):
        run(spark, ["--data", data, *words])
    with pytest.raises(ValueError):
        run(spark, ["--data", data, "segment", "-j", "a", "-a", "123"])
