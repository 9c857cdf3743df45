"""Images onto other grids in other coordinate systems: all images in one plan, as tables of tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratolith.functions.projections import ARRAYS, DEGREES, Srs, between, inverse, parse

from .raster import OVERVIEWS, SIDE, TILE_ROLES

#: Coordinate systems that one table of images may have; their names alone come to the driver.
MOST_SYSTEMS = 500
_GRID = ["x0", "dx", "y0", "dy", "srs", "ox0", "odx", "oy0", "ody", "ow", "oh"]
_TILE = "image int, band int, ty int, tx int, w int, h int, data array<int>, side int"


def degrees_grids(rasters: DataFrame) -> DataFrame:
    """``rasters`` (image, width, height, x0, dx, y0, dy, srs) with the grid in degrees that holds each image: ox0, odx, oy0, ody, ow, oh.

    Corners and the middles of edges bound it; its pixels are square, and the
    diagonal keeps its number of pixels.
    """
    names = [r["srs"] for r in rasters.select("srs").distinct().limit(MOST_SYSTEMS + 1).collect()]
    if len(names) > MOST_SYSTEMS:
        raise ValueError(f"more than {MOST_SYSTEMS} coordinate systems")
    spots = [(a, b) for a in (0.0, 0.5, 1.0) for b in (0.0, 0.5, 1.0)]

    def places(srs: Srs) -> Column:
        each = [inverse(F.col("x0") + F.col("dx") * F.col("width") * a, F.col("y0") + F.col("dy") * F.col("height") * b, srs) for a, b in spots]
        return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in each])

    at = F.lit(None).cast("array<struct<x:double,y:double>>")
    for name in names:
        at = F.when(F.col("srs") == name, places(parse(name))).otherwise(at)
    found = rasters.withColumn("at", at)
    edge = lambda f, c: f(F.transform("at", lambda p: p[c]))
    found = found.withColumns({"ox0": edge(F.array_min, "x"), "oy0": edge(F.array_max, "y"), "across": edge(F.array_max, "x") - edge(F.array_min, "x"), "high": edge(F.array_max, "y") - edge(F.array_min, "y")})
    step = F.sqrt(F.col("across") ** 2 + F.col("high") ** 2) / F.sqrt(F.col("width").cast("double") ** 2 + F.col("height").cast("double") ** 2)
    found = found.withColumns({"odx": step, "ody": -step})
    # A hair less, so that an image that fits exactly gets no more pixels.
    count = lambda c: F.ceil(F.col(c) / F.col("odx") - 1e-6).cast("int")
    return found.withColumns({"ow": count("across"), "oh": count("high")}).drop("at", "across", "high")


def _sources(row: dict, oty: int, otx: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of the source pixel under the centre of each pixel of an output tile."""
    h, w = min(side, int(row["oh"]) - oty * side), min(side, int(row["ow"]) - otx * side)
    lon = row["ox0"] + (otx * side + np.arange(w) + 0.5) * row["odx"]
    lat = row["oy0"] + (oty * side + np.arange(h) + 0.5) * row["ody"]
    east, north = between(*np.meshgrid(lon, lat), DEGREES, parse(row["srs"]), ARRAYS)
    return np.floor((north - row["y0"]) / row["dy"]).astype(np.int64), np.floor((east - row["x0"]) / row["dx"]).astype(np.int64)


def warp(tiles: DataFrame, grids: DataFrame, side: int = SIDE, roles: dict[int, int] | None = None) -> DataFrame:
    """A table of tiles of the images on their new grids in degrees, nearest neighbour, with an alpha band.

    ``tiles`` is as ``raster.to_tiles`` gives it with the same ``side``, ``grids``
    as ``degrees_grids`` (or with any other output grid). Bands are numbered
    anew by ``roles``; alpha (255 where a source pixel is, in any band) gets
    number -1 before that. Each output tile asks for the source tiles that lie
    under it, so tiles, not pixels, are shuffled, and the plan is the same for
    one image and for a million.
    """
    keys = ["image", *_GRID]
    last = lambda n: F.floor((F.col(n) - 1) / side).cast("int")
    out = grids.select(*keys).where("ow > 0 and oh > 0").withColumn("oty", F.explode(F.sequence(F.lit(0), last("oh")))).withColumn("otx", F.explode(F.sequence(F.lit(0), last("ow"))))

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                y, x = _sources(row, int(row["oty"]), int(row["otx"]), side)
                pairs = np.unique(np.stack([(y // side).ravel(), (x // side).ravel()], axis=1), axis=0)
                pairs = pairs[(pairs >= 0).all(axis=1)]
                if len(pairs):
                    yield pd.DataFrame({**{k: [row[k]] * len(pairs) for k in (*keys, "oty", "otx")}, "ty": pairs[:, 0], "tx": pairs[:, 1]})

    grid_types = "image int, x0 double, dx double, y0 double, dy double, srs string, ox0 double, odx double, oy0 double, ody double, ow int, oh int, oty int, otx int"
    cast = [F.col(c).cast(t).alias(c) for c, t in (x.split() for x in grid_types.split(", "))]
    # Tiles of one image are many rows of one key; spread them before they are looked at.
    wanted = out.select(*cast).repartition("image", "oty", "otx").mapInPandas(needed, f"{grid_types}, ty int, tx int")
    both = wanted.join(tiles.select(F.col("image").cast("int").alias("image"), "band", "ty", "tx", F.col("w").alias("sw"), "data"), ["image", "ty", "tx"])

    def sample(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image, oty, otx = map(int, key)
        y, x = _sources(rows.iloc[0].to_dict(), oty, otx, side)
        h, w = y.shape
        bands: dict[int, np.ndarray] = {}
        for band, ty, tx, sw, data in zip(rows["band"], rows["ty"], rows["tx"], rows["sw"], rows["data"], strict=True):
            value = np.asarray(data, float)
            ly, lx = y - ty * side, x - tx * side
            here = (ly >= 0) & (ly < len(value) // sw) & (lx >= 0) & (lx < sw)
            square = bands.setdefault(int(band), np.full((h, w), np.nan))
            square[here] = value[ly[here] * sw + lx[here]]
        hit = np.zeros((h, w), bool)
        for square in bands.values():
            hit |= ~np.isnan(square)
        if not hit.any():
            return pd.DataFrame(columns=["image", "band", "ty", "tx", "w", "h", "data", "side"])
        bands[-1] = np.where(hit, 255.0, np.nan)
        lists = {(roles or {}).get(b, b): [None if v != v else int(v) for v in square.ravel().tolist()] for b, square in bands.items()}
        return pd.DataFrame({"image": image, "band": list(lists), "ty": oty, "tx": otx, "w": w, "h": h, "data": list(lists.values()), "side": side})

    return both.groupBy("image", "oty", "otx").applyInPandas(sample, _TILE)


def normalised(tiles: DataFrame, grids: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of delivered images (R, G, B, IR) as processed ones: in degrees, with bands R, G, B, alpha, IR."""
    r = TILE_ROLES
    return warp(tiles, grids, side, {0: r["red"], 1: r["green"], 2: r["blue"], 3: r["ir"], -1: r["alpha"]})


def pyramid(tiles: DataFrame, factors: tuple[int, ...] = OVERVIEWS) -> DataFrame:
    """(image, band, factor, ty, tx, w, h, data): each tile's block averages at each factor, null where a block has no value.

    The tiles' side must be a multiple of each factor, so that every block lies
    in one tile and nothing is shuffled. Sums and counts are halved level by
    level.
    """

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                if any(row["side"] % f for f in factors):
                    raise ValueError("a tile's side must be a multiple of each factor")
                value = np.asarray(row["data"], float).reshape(row["h"], row["w"])
                of, out = {1: (np.nan_to_num(value), (~np.isnan(value)).astype(np.int64))}, []
                for f in sorted(factors):
                    under = max(g for g in of if f % g == 0)
                    of[f] = tuple(_blocks(v, f // under) for v in of[under]) if f not in of else of[f]
                    total, n = of[f]
                    data = [s / k if k else None for s, k in zip(total.ravel().tolist(), n.ravel().tolist(), strict=True)]
                    out.append((row["image"], row["band"], f, row["ty"], row["tx"], total.shape[1], total.shape[0], data))
                yield pd.DataFrame(out, columns=["image", "band", "factor", "ty", "tx", "w", "h", "data"])

    return tiles.select("image", "band", "ty", "tx", "w", "h", "data", "side").mapInPandas(levels, "image int, band int, factor int, ty int, tx int, w int, h int, data array<double>")


def _blocks(v: np.ndarray, step: int) -> np.ndarray:
    """Sums of blocks of ``step`` by ``step``, the last ones cut off by the edge."""
    for axis in (0, 1):
        v = np.add.reduceat(v, np.arange(0, v.shape[axis], step), axis=axis)
    return v
