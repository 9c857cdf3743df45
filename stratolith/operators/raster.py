"""Raster operators on pixels (band, y, x, dn), and on images (image, band, y, x, dn)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratolith.functions.geometry import EARTH_RADIUS, METRES_PER_DEGREE

#: 0-based band of each role in a processed tile and in a mosaic.
TILE_ROLES = {"red": 0, "green": 1, "blue": 2, "alpha": 3, "ir": 4}
MOSAIC_ROLES = {"red": 0, "green": 1, "blue": 2, "ir": 3}
OVERVIEWS = (2, 4, 8, 16, 32, 64, 128)
#: Pixels of a tile's side that one task holds, about and at most.
SIDE, MOST_SIDE = 256, 4096


def band_stats(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("band").agg(F.min("dn").alias("min_dn"), F.max("dn").alias("max_dn"), F.avg("dn").alias("avg_dn"), F.stddev_pop("dn").alias("std_dn"))


def size(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("band").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def select_bands(pixels: DataFrame, bands: list[int]) -> DataFrame:
    """The bands in a new order, numbered from 0; those that don't exist are skipped."""
    order = F.create_map(*[F.lit(v) for i, b in enumerate(bands) for v in (b, i)])
    return pixels.where(F.col("band").isin(bands)).withColumn("band", order[F.col("band")])


def masked(pixels: DataFrame, alpha_band: int) -> DataFrame:
    """All other bands, with dn null where alpha is zero or missing. One shuffle by place, no self-join."""
    place = Window.partitionBy("y", "x")
    alpha = F.max(F.when(F.col("band") == alpha_band, F.col("dn"))).over(place)
    return pixels.withColumn("dn", F.when(alpha > 0, F.col("dn"))).where(F.col("band") != alpha_band)


def crop(pixels: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    inside = F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1)
    return pixels.where(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def centre_crop(pixels: DataFrame, side: int) -> DataFrame:
    """The middle square of each band, no larger than the band."""
    sized = pixels.join(F.broadcast(size(pixels)), "band").withColumn("s", F.least(F.lit(side), "w", "h"))
    half = F.floor(F.col("s") / 2)
    moved = sized.withColumns({"x": (F.col("x") - F.floor(F.col("w") / 2) + half).cast("int"), "y": (F.col("y") - F.floor(F.col("h") / 2) + half).cast("int")})
    return moved.where((F.col("x") >= 0) & (F.col("x") < F.col("s")) & (F.col("y") >= 0) & (F.col("y") < F.col("s"))).select("band", "y", "x", "dn")


def overviews(pixels: DataFrame, factors: tuple[int, ...] = OVERVIEWS) -> DataFrame:
    """(band, factor, y, x, avg_dn): block averages at each factor; blocks without a value are left out.

    Pixels go once to tiles whose side all factors divide, so no block lies in
    two. There, sums and counts of a level come from those of the greatest
    level before whose factor divides its own, which rounds nothing.
    """
    side = math.lcm(*factors)
    if side > MOST_SIDE:
        raise ValueError(f"the factors' common multiple {side} is beyond {MOST_SIDE}")
    side *= max(1, SIDE // side)
    tile = lambda c: F.floor(F.col(c) / side).cast("int").alias(f"t{c}")

    def levels(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        band, ty, tx = map(int, key)
        there = rows["dn"].notna().to_numpy()
        y, x, dn = (rows[c].to_numpy()[there] for c in ("y", "x", "dn"))
        flat = (y - ty * side) * side + (x - tx * side)
        of = {1: tuple(np.bincount(flat.astype(np.int64), w, side * side).reshape(side, side) for w in (dn.astype(float), None))}
        out = []
        for f in sorted(factors):
            under = max(g for g in of if f % g == 0)
            step = f // under
            if f not in of:
                of[f] = tuple(v.reshape(v.shape[0] // step, step, v.shape[1] // step, step).sum(axis=(1, 3)) for v in of[under])
            total, n = of[f]
            at = np.nonzero(n)
            out.append(pd.DataFrame({"band": band, "factor": f, "y": at[0] + ty * (side // f), "x": at[1] + tx * (side // f), "avg_dn": total[at] / n[at]}))
        return pd.concat(out)

    tiled = pixels.select("band", "y", "x", "dn", tile("y"), tile("x"))
    return tiled.groupBy("band", "ty", "tx").applyInPandas(levels, "band int, factor int, y int, x int, avg_dn double")


def mosaic(images: DataFrame, places: DataFrame) -> DataFrame:
    """One image of many: (image, band, y, x, dn) shifted by (image, dx, dy, priority); the highest priority wins.

    A masked pixel (null dn) hides nothing: the next image's value shows. Where
    all are masked there is no pixel.
    """
    moved = images.where("dn is not null").join(places, "image").select("band", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "dn", "priority")
    return moved.groupBy("band", "y", "x").agg(F.max_by("dn", "priority").alias("dn"))


def resample(pixels: DataFrame, out_w: int, out_h: int, transform: tuple[float, ...], inverse: tuple[float, ...], project=None) -> DataFrame:
    """Nearest-neighbour warp onto a new grid, with an alpha band behind the last.

    Both transforms are (x0, dx, y0, dy): output pixel centres go to the world
    by ``transform``, from there to the source's world by ``project`` (which gives
    (x, y) columns of two; none where both are the same), and to source pixels
    by ``inverse``.
    """
    spark = pixels.sparkSession
    grid = spark.range(out_w * out_h).select((F.col("id") % out_w).cast("int").alias("ox"), F.floor(F.col("id") / out_w).cast("int").alias("oy"))
    x0, dx, y0, dy = transform
    u0, du, v0, dv = inverse
    east, north = x0 + (F.col("ox") + 0.5) * dx, y0 + (F.col("oy") + 0.5) * dy
    east, north = project(east, north) if project else (east, north)
    sources = grid.select("ox", "oy", F.floor((east - u0) / du).cast("int").alias("x"), F.floor((north - v0) / dv).cast("int").alias("y"))
    hit = pixels.join(sources, ["y", "x"]).select("band", F.col("oy").alias("y"), F.col("ox").alias("x"), "dn")
    alpha = hit.groupBy("y", "x").agg((F.max("band") + 1).alias("band")).select("band", "y", "x", F.lit(255).alias("dn"))
    return hit.unionByName(alpha)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to spherical web mercator metres, as ``project`` of ``resample``."""
    return EARTH_RADIUS * F.radians(lon), EARTH_RADIUS * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))


def normalise(pixels: DataFrame, out_w: int, out_h: int, transform: tuple[float, ...], inverse: tuple[float, ...], project=None) -> DataFrame:
    """A delivered tile (R, G, B, IR) as a processed one: warped, with bands R, G, B, alpha, IR, and dn null in the others where alpha is 0.

    Output pixels that no source pixel is under have no rows at all.
    """
    warped = select_bands(resample(pixels, out_w, out_h, transform, inverse, project), [0, 1, 2, 4, 3])
    alpha = TILE_ROLES["alpha"]
    return masked(warped, alpha).unionByName(warped.where(F.col("band") == alpha))


def to_tiles(images: DataFrame, side: int = SIDE) -> DataFrame:
    """Pixels (image, band, y, x, dn) as rows (image, band, ty, tx, w, h, data, side): one for each tile, its values line by line, null where there is none."""
    kind = images.schema["image"].dataType.simpleString()
    keys = ["image", "band", "ty", "tx"]

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, x = (rows[c].to_numpy() for c in ("y", "x"))
        w, h = int(x.max()) + 1, int(y.max()) + 1
        data = np.full(w * h, None, object)
        data[y * w + x] = [None if v != v or v is None else int(v) for v in rows["dn"].tolist()]
        return pd.DataFrame([(*key, w, h, data.tolist(), side)], columns=[*keys, "w", "h", "data", "side"])

    part = lambda c: (F.floor(F.col(c) / side).cast("int").alias(f"t{c}"), F.pmod(F.col(c), F.lit(side)).cast("int").alias(c))
    rows = images.select("image", F.col("band").cast("int").alias("band"), *part("y"), *part("x"), F.col("dn").cast("double").alias("dn"))
    return rows.groupBy(*keys).applyInPandas(tile, f"image {kind}, band int, ty int, tx int, w int, h int, data array<int>, side int")


def from_tiles(tiles: DataFrame) -> DataFrame:
    """The pixels of a tile table; places without a value have none."""
    each = tiles.select("image", "band", "ty", "tx", "w", "side", F.posexplode("data").alias("i", "dn")).where("dn is not null")
    return each.select("image", "band", (F.col("ty") * F.col("side") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), (F.col("tx") * F.col("side") + F.col("i") % F.col("w")).cast("int").alias("x"), "dn")


def metadata(images: DataFrame, transforms: DataFrame) -> DataFrame:
    """One row for each image: its size, its bands and their kind, with (x0, dx, y0, dy, srs) of ``transforms`` (null where it has none)."""
    kind = F.when((F.min("dn") >= 0) & (F.max("dn") <= 255), "byte").when((F.min("dn") >= 0) & (F.max("dn") <= 65535), "uint16").otherwise("int32")
    sizes = images.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.array_sort(F.collect_set("band")).alias("bands"), kind.alias("kind"))
    return sizes.join(transforms.select("image", "x0", "dx", "y0", "dy", "srs"), "image", "left")


def mosaic_of(images: DataFrame, rasters: DataFrame) -> tuple[DataFrame, tuple[float, float, float, float]]:
    """(one image of all, its transform): images laid by their ``metadata`` onto the grid of the westernmost and northernmost; higher numbers win.

    All must have one pixel size; only that and the corner come to the driver.
    """
    grid = rasters.agg(F.min("x0").alias("x0"), F.first("dx").alias("dx"), F.max("y0").alias("y0"), F.first("dy").alias("dy"), F.count_distinct("dx", "dy").alias("n")).first()
    if grid["n"] != 1:
        raise ValueError(f"{grid['n']} pixel sizes among the images")
    shift = lambda c, d: F.round((F.col(c) - grid[c]) / grid[d]).cast("int")
    places = rasters.select("image", shift("x0", "dx").alias("dx"), shift("y0", "dy").alias("dy"), F.col("image").alias("priority"))
    return mosaic(images, places), (grid["x0"], grid["dx"], grid["y0"], grid["dy"])


def box_around(lat: Column, lon: Column, metres: float) -> Column:
    """Box of struct<xmin, ymin, xmax, ymax> around a point; six decimals."""
    d = metres / METRES_PER_DEGREE
    return F.struct(F.round(lon - d, 6).alias("xmin"), F.round(lat - d, 6).alias("ymin"), F.round(lon + d, 6).alias("xmax"), F.round(lat + d, 6).alias("ymax"))


def world_to_pixel(at: Column, origin: Column, step: Column, side: int) -> Column:
    """Upper left pixel of a window of ``side`` around a place; truncated towards zero."""
    return ((at - origin) / step - side // 2).cast("int")
