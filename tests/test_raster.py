import numpy as np
import pytest
from pyspark.sql import functions as F

from stratolith import commands
from stratolith.functions import geometry as g
from stratolith.operators import params, raster, segment


def frame(spark, image, band=0):
    return spark.createDataFrame([(band, y, x, int(v)) for (y, x), v in np.ndenumerate(image)], "band int, y int, x int, dn int")


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(5).integers(0, 60, (13, 11))


def test_semivariogram(spark, image):
    h, w = image.shape
    for row in params.semivariogram(frame(spark, image), (2, 4, 10, 12, 40)).collect():
        k = row["lag"]
        a, d, r = image[: h - k, : w - k], image[k:, : w - k], image[: h - k, k:]
        assert row["sv_row"] == pytest.approx(((d - a) ** 2).sum() / (2 * (w - k) * (h - k)))
        assert row["sv_col"] == pytest.approx(((r - a) ** 2).sum() / (2 * (w - k) * (h - k)))
        assert k < min(h, w)


@pytest.mark.parametrize("n", [1, 3, 4])
def test_local_variance(spark, image, n):
    padded = np.pad(image, ((n // 2, n - n // 2 - 1),) * 2, mode="symmetric").astype(float)
    want = np.array([[padded[y : y + n, x : x + n].var() for x in range(image.shape[1])] for y in range(image.shape[0])])
    for row in params.local_variance(frame(spark, image), n).collect():
        assert row["lv"] == pytest.approx(want[row["y"], row["x"]], abs=1e-9)


def labels_of(image, step):
    out = np.full(image.shape, -1)
    for start in np.ndindex(image.shape):
        if out[start] < 0:
            todo = [start]
            out[start] = start[0] * image.shape[1] + start[1]
            while todo:
                y, x = todo.pop()
                for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= p[0] < image.shape[0] and 0 <= p[1] < image.shape[1] and out[p] < 0 and image[p] // step == image[y, x] // step:
                        out[p] = out[start]
                        todo.append(p)
    return out


@pytest.mark.parametrize("tile", [4, 64])
def test_labels_do_not_depend_on_tiles(spark, image, tile):
    want = labels_of(image, 30)
    for row in segment.connected_labels(frame(spark, image), 30, tile).collect():
        flat = want[row["y"], row["x"]]
        assert row["label"] == flat // image.shape[1] * 2**31 + flat % image.shape[1]


def test_polygons_keep_areas_and_small_regions_merge(spark, image):
    pixels = frame(spark, image)
    labels = segment.connected_labels(pixels, 30, 4)
    areas = {r["label"]: r["a"] for r in segment.vectorise(labels).select("label", g.area(F.col("rings")).alias("a")).collect()}
    assert areas == {r["label"]: float(r["count"]) for r in labels.groupBy("label").count().collect()}
    merged = segment.merge_small(labels, pixels, 5)
    assert min(r["count"] for r in merged.groupBy("label").count().collect()) >= 5 and merged.count() == image.size


def test_smoothing_keeps_flat_areas_and_ignores_tiles(spark):
    image = np.where(np.arange(12) < 6, 10, 200) + np.zeros((8, 1), int)
    got = {(r["y"], r["x"]): r["colour"] for r in segment.mean_shift(frame(spark, image), 2, 20.0, 3).collect()}
    assert all(v == [image[p]] for p, v in got.items()) and len(got) == image.size
    noisy = image + np.random.default_rng(1).integers(-5, 5, image.shape)
    moved = frame(spark, noisy).withColumn("y", F.col("y") - 5).withColumn("x", F.col("x") - 20)
    flat = lambda df, dy=0, dx=0: sorted((r.y + dy, r.x + dx, r.colour[0], r.my + dy, r.mx + dx) for r in df.collect())
    a, b = (flat(segment.mean_shift(frame(spark, noisy), 1, 20.0, 2, tile=t)) for t in (3, 64))
    c = flat(segment.mean_shift(moved, 1, 20.0, 2, tile=4), 5, 20)  # negative places too
    assert len(a) == len(b) == len(c) == image.size and np.allclose(a, b) and np.allclose(a, c)


@pytest.fixture(scope="module")
def holed(spark):
    """Two bands in which places lack a pixel, one band of it, or its value."""
    rng = np.random.default_rng(11)
    base = np.kron(rng.integers(0, 4, (6, 6)) * 60, np.ones((4, 4), int))
    rows = []
    for band in (0, 1):
        for (y, x), v in np.ndenumerate(base + rng.integers(0, 9, base.shape)):
            if (y * 5 + x * 7) % 13 and (y, x) != (10, 10 + band):
                rows.append((band, y, x, None if (y, x, band) == (3, 3, 1) else int(v)))
    return spark.createDataFrame(rows, "band int, y int, x int, dn int")


@pytest.mark.parametrize("delete", [True, False])
def test_segments_of_images_with_holes(spark, holed, delete):
    got = segment.segment(holed, 2, 25.0, 5, delete, iterations=2, tile=7).toPandas()
    places = holed.where("dn is not null").groupBy("y", "x").count().where("count = 2").count()
    assert (got.area == got.nbpixels).all() and {"meanb0", "varb0", "meanb1", "varb1", "circle", "frac"} <= set(got.columns)
    assert got.nbpixels.sum() == places if not delete else (got.nbpixels.min() >= 5 and got.nbpixels.sum() <= places)
    again = segment.segment(holed, 2, 25.0, 5, delete, iterations=2, tile=64).toPandas()
    names = ["label", "nbpixels", "area", "perim"]
    assert got[names].sort_values("label").values.tolist() == again[names].sort_values("label").values.tolist()
    world = segment.segment(holed, 2, 25.0, 5, delete, iterations=2, transform=(100.0, 2.0, 50.0, -2.0)).toPandas()
    assert world.area.sum() == 4 * got.area.sum()


def test_segments_of_nothing_and_of_flat_images(spark, holed):
    assert segment.segment(holed.limit(0), 2, 25.0, 5).count() == 0
    flat = frame(spark, np.full((9, 9), 7))
    one = segment.segment(flat, 2, 5.0, 5).collect()
    assert len(one) == 1 and one[0].nbpixels == 81 and one[0].perim == 36 and one[0].meanb0 == 7 and one[0].varb0 == 0
    best = commands.segment_optimal(holed.where("band = 0"), "min", side=16).collect()
    assert best and all(r.area == r.nbpixels for r in best)
    with pytest.raises(ValueError):
        commands.segment_optimal(flat, "most")


def test_regions_apart_are_no_neighbours(spark):
    rows = [(0, 0, 1), (0, 2, 2), (0, 3, 3), (1, 0, 1)]
    labels = spark.createDataFrame(rows, "y int, x int, label long")
    assert {tuple(r) for r in segment.neighbours(labels).collect()} == {(2, 3), (3, 2)}
    shapes = {r.label: r for r in segment.vectorise(labels).select("label", g.area(F.col("rings")).alias("a"), g.perimeter(F.col("rings")).alias("p")).collect()}
    assert (shapes[1].a, shapes[1].p, shapes[2].a) == (2, 6, 1)


def test_semivariogram_with_a_missing_pixel(spark, image):
    gone = frame(spark, image).where("not (y = 4 and x = 4)").union(spark.createDataFrame([(0, 0, 20, None)], "band int, y int, x int, dn int"))
    at = {k: int(v) for k, v in np.ndenumerate(image) if k != (4, 4)}
    for row in params.semivariogram(gone, (1, 3)).collect():
        k = row["lag"]
        both = [(v, at[y + k, x], at[y, x + k]) for (y, x), v in at.items() if (y + k, x) in at and (y, x + k) in at]
        assert row["sv_row"] == pytest.approx(sum((d - v) ** 2 for v, d, _ in both) / (2 * len(both)))
        assert row["sv_col"] == pytest.approx(sum((r - v) ** 2 for v, _, r in both) / (2 * len(both)))


def test_warp_crop_and_mosaic(spark, image):
    pixels = frame(spark, image)
    same = raster.resample(pixels, 11, 13, (0, 1, 0, 1), (0, 1, 0, 1))
    assert same.where("band = 1 and dn = 255").count() == image.size
    assert {(r.y, r.x): r.dn for r in same.where("band = 0").collect()} == {k: v for k, v in np.ndenumerate(image)}
    cut = {(r.y, r.x): r.dn for r in raster.crop(pixels, 2, 3, 4, 5).collect()}
    assert cut == {k: v for k, v in np.ndenumerate(image[3:8, 2:6])}
    two = spark.createDataFrame([(1, 0, 0, 0, 5), (2, 0, 0, 0, 7)], "image int, band int, y int, x int, dn int")
    places = spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 2)], "image int, dx int, dy int, priority int")
    assert [r.dn for r in raster.mosaic(two, places).collect()] == [7]
