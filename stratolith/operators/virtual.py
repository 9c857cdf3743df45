"""A mosaic that is only an index: tiles of many images along a space-filling curve, of which a window reads what it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Added to a tile's number on each axis, so that those left of and above the origin have a place on the curve too.
_MIDDLE = 1 << 30


def _spread_bits(v: Column) -> Column:
    """The lower 31 bits of a long, with a zero between every two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def curve(x: Column, y: Column) -> Column:
    """The place of a cell on the Z-order curve: near cells have near numbers."""
    at = lambda c: _spread_bits((c + _MIDDLE).cast("long"))
    return at(x).bitwiseOR(F.shiftleft(at(y), 1))


def write_index(tiles: DataFrame, places: DataFrame, path: str) -> DataFrame:
    """Write tiles (as ``raster.to_tiles`` gives them) at their places in the mosaic, and read them back.

    ``places`` has (image, dx, dy, priority): where the image's first pixel
    lies, and which image is on top. Each tile gets its box in the mosaic
    (left, top, right, bottom; the last two beyond it). Rows are written in
    ranges of the curve, so a file and each group of its rows covers a small
    area, which its statistics tell.
    """
    at = tiles.join(places.select("image", "dx", "dy", "priority"), "image")
    left, top = F.col("tx") * F.col("side") + F.col("dx"), F.col("ty") * F.col("side") + F.col("dy")
    boxed = at.withColumns({"left": left.cast("int"), "top": top.cast("int"), "right": (left + F.col("w")).cast("int"), "bottom": (top + F.col("h")).cast("int")}).drop("dx", "dy")
    order = ["z", "image", "ty", "tx", "band"]
    placed = boxed.withColumn("z", curve(F.floor(F.col("left") / F.col("side")), F.floor(F.col("top") / F.col("side"))))
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return open_index(tiles.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def window(index: DataFrame, x0: int, y0: int, w: int, h: int, bands: list[int] | None = None) -> DataFrame:
    """(band, y, x, dn) of a window of the mosaic, from its upper left pixel on.

    Only tiles whose boxes meet the window are read: the comparisons are
    pushed to the files. Where images overlap, that of the highest priority
    counts; its masked and missing pixels let the next one show. Bands keep
    their numbers. Places where no image has a value have no pixel.
    """
    near = index.where((F.col("left") < x0 + w) & (F.col("right") > x0) & (F.col("top") < y0 + h) & (F.col("bottom") > y0))
    if bands is not None:
        near = near.where(F.col("band").isin(bands))
    each = near.select("image", "band", "priority", "left", "top", "w", F.posexplode("data").alias("i", "dn")).where("dn is not null")
    x, y = F.col("left") + F.col("i") % F.col("w") - x0, F.col("top") + F.floor(F.col("i") / F.col("w")) - y0
    pixels = each.select("band", y.cast("int").alias("y"), x.cast("int").alias("x"), "dn", F.struct("priority", "image").alias("above")).where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    return pixels.groupBy("band", "y", "x").agg(F.max_by("dn", "above").alias("dn"))
