"""Segmentation: mean-shift smoothing, labels, merging of small regions, polygons.

The algorithms are the published ones (Comaniciu and Meer 2002; Michel,
Youssefi and Grizonnet 2015); no equality with any other implementation's
pixels is claimed. Images may have holes: a place without a pixel, or without
one of the bands, is outside of every region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratolith.functions import geometry as g
from stratolith.storage import cut, cut_at, remove, spread

from . import outlines
from .components import connected_components
from .metrics import with_metrics

#: Pixels of a tile's side; a task holds one tile and its halo.
TILE = 256


def _band() -> Column:
    """The band's number above the place's, which tells labels of different bands apart."""
    return F.shiftleft(F.col("band").cast("long"), 56)


def bands_of(pixels: DataFrame) -> list[int]:
    """The numbers of the bands, ascending: a handful; [0] for an image without pixels."""
    return sorted(r["band"] for r in pixels.select("band").distinct().collect()) or [0]


def colours(pixels: DataFrame, bands: list[int]) -> DataFrame:
    """y, x, colour: the bands' values of each place as doubles; places that lack one, or where one is null, are left out."""
    rows = pixels.where(F.col("band").isin(bands) & F.col("dn").isNotNull()).groupBy("y", "x")
    values = rows.agg(*[F.max(F.when(F.col("band") == b, F.col("dn").cast("double"))).alias(f"c{i}") for i, b in enumerate(bands)])
    return values.na.drop().select("y", "x", F.array(*[f"c{i}" for i in range(len(bands))]).alias("colour"))


def _packed(colour: DataFrame, reach: int, tile: int, bands: int) -> DataFrame:
    """ty, tx, y0, x0, h, w, data: each tile with ``reach`` pixels around it as one array (float64, not a number where no pixel is)."""
    around = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    dealt = colour.withColumn("ty", F.explode(around("y"))).withColumn("tx", F.explode(around("x")))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ty, tx = map(int, key)
        if not ((rows["y"] // tile == ty) & (rows["x"] // tile == tx)).any():
            return pd.DataFrame(columns=["ty", "tx", "y0", "x0", "h", "w", "data"])
        y0, x0 = int(rows["y"].min()), int(rows["x"].min())
        h, w = int(rows["y"].max()) - y0 + 1, int(rows["x"].max()) - x0 + 1
        image = np.full((h, w, bands), np.nan)
        image[rows["y"] - y0, rows["x"] - x0] = np.stack(rows["colour"].to_list())
        return pd.DataFrame([(ty, tx, y0, x0, h, w, image.tobytes())], columns=["ty", "tx", "y0", "x0", "h", "w", "data"])

    return dealt.groupBy("ty", "tx").applyInPandas(pack, "ty long, tx long, y0 int, x0 int, h int, w int, data binary")


class _Shift:
    """The steps of mean shift on one tile, for pixels that are inside of it."""

    def __init__(self, row: dict, tile: int, spatial: int, spectral: float, ramp: float, iterations: int, threshold: float) -> None:
        self.image = np.frombuffer(row["data"]).reshape(row["h"], row["w"], -1)
        self.y0, self.x0, self.ty, self.tx, self.tile = int(row["y0"]), int(row["x0"]), int(row["ty"]), int(row["tx"]), tile
        self.spectral, self.ramp, self.iterations, self.threshold = spectral, ramp, iterations, threshold
        reach = range(-spatial, spatial + 1)
        self.steps = [(a, b) for a in reach for b in reach if a * a + b * b <= spatial * spatial]

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """(y, x) of the tile's own pixels."""
        y, x = np.nonzero(~np.isnan(self.image[:, :, 0]))
        y, x = y + self.y0, x + self.x0
        mine = self.inside(y, x)
        return y[mine], x[mine]

    def inside(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (np.floor_divide(np.rint(y).astype(np.int64), self.tile) == self.ty) & (np.floor_divide(np.rint(x).astype(np.int64), self.tile) == self.tx)

    def run(self, value: np.ndarray, py: np.ndarray, px: np.ndarray, done: np.ndarray) -> np.ndarray:
        """Move pixels in place until each has come to rest, has made all its steps or has left the tile; True where it goes on elsewhere."""
        image, (h, w) = self.image, self.image.shape[:2]
        goes = np.zeros(len(py), bool)
        moving = np.flatnonzero(done < self.iterations)
        while len(moving):
            cy, cx = np.rint(py[moving]).astype(int) - self.y0, np.rint(px[moving]).astype(int) - self.x0
            here = value[moving]
            width = self.spectral + self.ramp * np.abs(here)
            sums, ys, xs, n = np.zeros_like(here), np.zeros(len(moving)), np.zeros(len(moving)), np.zeros(len(moving))
            for a, b in self.steps:
                qy, qx = cy + a, cx + b
                there = (qy >= 0) & (qy < h) & (qx >= 0) & (qx < w)
                colour = image[np.clip(qy, 0, h - 1), np.clip(qx, 0, w - 1)]
                apart = (colour - here) ** 2
                near = there & ((apart / (width * width)).sum(axis=1) <= 1 if self.ramp else apart.sum(axis=1) <= self.spectral * self.spectral)
                sums[near] += colour[near]
                ys, xs, n = ys + near * (qy + self.y0), xs + near * (qx + self.x0), n + near
            has = n > 0
            n = np.maximum(n, 1)
            new, ny, nx = np.where(has[:, None], sums / n[:, None], here), np.where(has, ys / n, py[moving]), np.where(has, xs / n, px[moving])
            moved = np.sqrt(((new - here) ** 2).sum(axis=1) + (ny - py[moving]) ** 2 + (nx - px[moving]) ** 2)
            value[moving], py[moving], px[moving] = new, ny, nx
            done[moving] += 1
            more = (moved > self.threshold) & (done[moving] < self.iterations)
            stays = self.inside(ny, nx)
            goes[moving[more & ~stays]] = True
            moving = moving[more & stays]
        return goes


def mean_shift(
    pixels: DataFrame, spatial: int, spectral: float, iterations: int = 100, threshold: float = 0.1, tile: int = TILE, bands: list[int] | None = None, ramp: float = 0.0
) -> DataFrame:
    """y, x, colour, my, mx: each place moved to the mode of its neighbourhood in place and colour (all bands together).

    colour is the mode's, (my, mx) where it lies. The range radius of a band is
    ``spectral`` plus ``ramp`` times the pixel's value there. Tiles carry a halo
    of one radius. A task moves the pixels of its tile while they stay in it;
    those that leave go, as rows of their own, to the tile that they have come
    to, in as many rounds as pixels cross edges. So what is exchanged is what
    moves far, whatever the iterations, and the result doesn't depend on the
    tiles.
    """
    spark = pixels.sparkSession
    bands = bands or bands_of(pixels)
    tiles = cut(_packed(colours(pixels, bands), spatial + 1, tile, len(bands)), "tiles")
    names = ["y", "x", "colour", "my", "mx", "done", "goes"]
    schema = "y int, x int, colour array<double>, my double, mx double, done int, goes boolean"
    step = lambda row: _Shift(row, tile, spatial, spectral, ramp, iterations, threshold)

    def frame(y, x, value, py, px, done, goes) -> pd.DataFrame:
        return pd.DataFrame({"y": y, "x": x, "colour": list(value), "my": py, "mx": px, "done": done, "goes": goes})[names]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                one = step(row)
                y, x = one.own()
                value, py, px, done = one.image[y - one.y0, x - one.x0].copy(), y.astype(float), x.astype(float), np.zeros(len(y), np.int64)
                yield frame(y, x, value, py, px, done, one.run(value, py, px, done))

    def go_on(rows: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return frame(*[[]] * 7)
        value, py, px = np.stack(rows["colour"].to_list()), rows["my"].to_numpy(float).copy(), rows["mx"].to_numpy(float).copy()
        done = rows["done"].to_numpy(np.int64).copy()
        # Where a pixel has come to there is no tile without pixels: at least those that pulled it lie around.
        goes = np.zeros(len(rows), bool) if there.empty else step(there.iloc[0].to_dict()).run(value, py, px, done)
        return frame(rows["y"], rows["x"], value, py, px, done, goes)

    found, finished = cut(tiles.repartition(spread(tiles), "ty", "tx").mapInPandas(begin, schema), "shift"), []
    while True:
        finished.append(found.where("not goes"))
        moving = found.where("goes")
        if moving.isEmpty():
            break
        at = lambda c: F.floor(F.rint(f"m{c}") / tile).alias(f"t{c}")
        moving = moving.withColumns({"ty": at("y"), "tx": at("x")})
        # Many may have come to one tile; they are dealt to several tasks, each with the tile.
        parts = cut(moving.groupBy("ty", "tx").agg(F.ceil(F.count("*") / (tile * tile)).cast("int").alias("parts")), "parts")
        some = moving.join(parts, ["ty", "tx"]).withColumn("part", F.pmod(F.xxhash64("y", "x"), F.col("parts"))).drop("parts")
        dealt = parts.select("ty", "tx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
        theirs = tiles.join(dealt, ["ty", "tx"])
        found = cut(some.groupBy("ty", "tx", "part").cogroup(theirs.groupBy("ty", "tx", "part")).applyInPandas(go_on, schema), "shift")
    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    return done.select("y", "x", "colour", "my", "mx")


def _tile_labels(down: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least flat index of each area that hangs together by links to the pixel below and to the right, by repeated minima along runs."""
    h, w = down.shape[0] + 1, right.shape[1] + 1
    labels = np.arange(h * w).reshape(h, w)
    while True:
        before = labels.copy()
        for lines, links in ((labels, down), (labels.T, right.T)):
            for i in range(1, len(lines)):
                lines[i] = np.where(links[i - 1], np.minimum(lines[i], lines[i - 1]), lines[i])
            for i in range(len(lines) - 2, -1, -1):
                lines[i] = np.where(links[i], np.minimum(lines[i], lines[i + 1]), lines[i])
        if (labels == before).all():
            return labels


def _numbered(rows: pd.DataFrame, fields: list[np.ndarray], linked) -> np.ndarray:
    """The label of each row of one tile: the least pixel number (y * 2**31 + x) of its area. ``linked`` compares fields of neighbours."""
    y0, x0 = int(rows["y"].min()), int(rows["x"].min())
    y, x = (rows["y"] - y0).to_numpy(), (rows["x"] - x0).to_numpy()
    shape = (int(y.max()) + 1, int(x.max()) + 1)
    there, grids = np.zeros(shape, dtype=bool), []
    there[y, x] = True
    for field in fields:
        grid = np.zeros((*shape, *field.shape[1:]), field.dtype)
        grid[y, x] = field
        grids.append(grid)
    down = there[1:] & there[:-1] & linked([v[1:] for v in grids], [v[:-1] for v in grids])
    right = there[:, 1:] & there[:, :-1] & linked([v[:, 1:] for v in grids], [v[:, :-1] for v in grids])
    found = _tile_labels(down, right)[y, x]
    return (found // shape[1] + y0).astype(np.int64) * 2**31 + found % shape[1] + x0


def _across(local: DataFrame, keys: list[str], near: Column, tile: int) -> DataFrame:
    """(node, component) of the labels ``node`` that go on in other tiles.

    ``near`` compares a pixel's columns with those of its neighbour, named
    other_*. Only pixels at tiles' edges meet, and the graph is as large as
    the edges, not as the image.
    """
    edge = local.where((F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1))
    there = edge.select(*keys, "y", "x", *[F.col(c).alias(f"other_{c}") for c in edge.columns if c not in (*keys, "y", "x")])
    links = None
    for dy, dx, c in ((1, 0, "y"), (0, 1, "x")):
        here = edge.where(F.pmod(c, F.lit(tile)) == tile - 1).withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx})
        some = here.join(there, [*keys, "y", "x"]).where(near).select("node", "other_node").distinct()
        links = some if links is None else links.union(some)
    return connected_components(links, "node", "other_node")


def connected_labels(pixels: DataFrame, step: int = 16, tile: int = TILE) -> DataFrame:
    """band, y, x, class, label: 4-connected regions of equal ``dn div step``, each band on its own.

    The label is the region's least pixel number (y * 2**31 + x). Tiles are
    labelled on their own, and then joined where labels touch across an edge.
    """
    rows = pixels.withColumn("class", F.floor(F.col("dn") / step).cast("int")).withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        label = _numbered(rows, [rows["class"].to_numpy()], lambda a, b: a[0] == b[0])
        return pd.DataFrame({"band": rows["band"], "y": rows["y"], "x": rows["x"], "class": rows["class"], "local": label})

    local = cut(rows.groupBy("band", "ty", "tx").applyInPandas(one, "band int, y int, x int, class int, local long").withColumn("node", _band() + F.col("local")), "labels")
    found = _across(local.select("band", "class", "y", "x", "node"), ["band", "class"], F.lit(True), tile).withColumnRenamed("node", "n")
    return local.join(found, local.node == found.n, "left").select("band", "y", "x", "class", (F.coalesce("component", "node") - _band()).alias("label"))


def linked_labels(smooth: DataFrame, spatial: int, spectral: float, tile: int = TILE) -> DataFrame:
    """y, x, label: 4-neighbours of a smoothed image (as ``mean_shift`` gives it) are in one region if their modes are closer than ``spectral`` in
    colour, over all bands, and closer than ``spatial`` in place."""
    rows = smooth.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        fields = [np.stack(rows["colour"].to_list()), rows[["my", "mx"]].to_numpy(float)]
        apart = lambda a, b: ((a - b) ** 2).sum(axis=-1)
        label = _numbered(rows, fields, lambda a, b: (apart(a[0], b[0]) < spectral * spectral) & (apart(a[1], b[1]) < spatial * spatial))
        return rows[["y", "x", "colour", "my", "mx"]].assign(node=label)

    local = cut(rows.groupBy("ty", "tx").applyInPandas(one, "y int, x int, colour array<double>, my double, mx double, node long"), "labels")
    square = lambda c: (F.col(c) - F.col(f"other_{c}")) * (F.col(c) - F.col(f"other_{c}"))
    colour = F.aggregate(F.zip_with("colour", "other_colour", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = (colour < spectral * spectral) & (square("my") + square("mx") < spatial * spatial)
    found = _across(local, [], near, tile).withColumnRenamed("node", "n")
    return local.join(found, local.node == found.n, "left").select("y", "x", F.coalesce("component", "node").alias("label"))


def _keys(labels: DataFrame) -> list[str]:
    return [c for c in ("band",) if c in labels.columns]


def zonal_stats(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    """band, label, nbpixels, mean and population variance of dn."""
    both = labels.join(pixels.select("band", "y", "x", F.col("dn").cast("long").alias("dn")), ["band", "y", "x"])
    n, s, q = F.count("*"), F.sum("dn"), F.sum(F.col("dn") * F.col("dn"))
    return both.groupBy("band", "label").agg(n.alias("nbpixels"), (s / n).alias("mean_dn"), ((n * q - s * s) / (n * n)).alias("var_dn"))


def wide_stats(labels: DataFrame, image: DataFrame, bands: int) -> DataFrame:
    """label, nbpixels, meanb0.., varb0..: mean and population variance of each band, as columns, from (y, x, label) and (y, x, colour)."""
    values = [F.get("colour", F.lit(i)) for i in range(bands)]
    stats = [f(v).alias(f"{name}b{i}") for name, f in (("mean", F.avg), ("var", F.var_pop)) for i, v in enumerate(values)]
    return labels.join(image, ["y", "x"], "left").groupBy("label").agg(F.count("*").alias("nbpixels"), *stats)


def _beside(labels: DataFrame, axis: str, shift: int) -> Column:
    """The label of the pixel that lies ``shift`` (1 or -1) further along an axis; null where there is none, also in the middle of an image."""
    other = "x" if axis == "y" else "y"
    line = Window.partitionBy(*_keys(labels), other).orderBy(axis)
    return F.when(F.lead(axis, shift).over(line) == F.col(axis) + shift, F.lead("label", shift).over(line))


def neighbours(labels: DataFrame) -> DataFrame:
    """label and other (and band, where labels have one): regions that share a side, in both directions."""
    keys = _keys(labels)
    beside = labels.select(*keys, "label", F.array(_beside(labels, "y", 1), _beside(labels, "x", 1)).alias("others"))
    pairs = beside.select(*keys, "label", F.explode("others").alias("other")).where("other <> label").distinct()
    return pairs.union(pairs.select(*keys, F.col("other").alias("label"), F.col("label").alias("other"))).distinct()


def merge_regions(regions: DataFrame, edges: DataFrame, sums: list[str], least: int) -> DataFrame:
    """(label, whole): into which region each one goes, so that none under ``least`` pixels with a neighbour is left.

    ``regions`` has label, n (pixels) and the ``sums`` of each band; ``edges``
    has (label, other) in both directions. By increasing size, all regions of
    the least size join the neighbour of nearest mean colour (the smaller label
    on a tie; distances count to six decimals), and the graph shrinks: pixels
    aren't touched. A region's label is the least of its members'. A round
    writes only what small regions border on, so less and less. What joined
    what is only logged, and resolved once at the end: a region's label is the
    least that its log leads to.
    """
    spark = regions.sparkSession
    labels = cut(regions, "regions")

    def written(regions: DataFrame, edges: DataFrame) -> tuple[tuple[DataFrame, str], tuple[DataFrame, str]]:
        """The borders with a small region on either side, and the regions beside them: all that later rounds may need."""
        tiny = regions.where(F.col("n") < least).select("label")
        sides = edges.join(tiny.withColumn("here", F.lit(True)), "label", "left").join(tiny.select(F.col("label").alias("other"), F.lit(True).alias("there")), "other", "left")
        kept = cut_at(sides.where("here or there").select("label", "other"), "beside")
        return cut_at(regions.join(kept[0].select("label").distinct(), "label", "left_semi"), "regions"), kept

    ((now, a), (links, b)), log = written(labels, edges), []
    while True:
        small = now.where(F.col("n") < least).join(links.select("label").distinct(), "label", "left_semi").agg(F.min("n")).first()[0]
        if small is None:
            break
        mine = now.where(F.col("n") == small).select("label", *[(F.col(s) / F.col("n")).alias(f"a_{s}") for s in sums])
        theirs = now.select(F.col("label").alias("other"), *[(F.col(s) / F.col("n")).alias(f"b_{s}") for s in sums])
        apart = sum(((F.col(f"a_{s}") - F.col(f"b_{s}")) * (F.col(f"a_{s}") - F.col(f"b_{s}")) for s in sums), F.lit(0.0))
        picked = links.join(mine, "label").join(theirs, "other").groupBy("label").agg(F.min_by("other", F.struct(F.round(apart, 6), "other")).alias("other"))
        groups = cut(connected_components(picked, "label", "other").select(F.col("node").alias("label"), "component"), "groups")
        log.append(groups.where("label <> component"))
        to = F.coalesce("component", "label")
        new = now.join(groups, "label", "left").groupBy(to.alias("label")).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
        ends = links.join(groups, "label", "left").select(to.alias("label"), "other").join(groups.select(F.col("label").alias("other"), F.col("component").alias("there")), "other", "left")
        joined = ends.select("label", F.coalesce("there", "other").alias("other")).where("label <> other").distinct()
        old = (a, b)
        (now, a), (links, b) = written(new, joined)
        remove(spark, *old)
    labels = labels.select("label")
    if not log:
        return labels.withColumn("whole", F.col("label"))
    every = log[0]
    for more in log[1:]:
        every = every.unionByName(more)
    found = connected_components(every, "label", "component")
    return labels.join(found, labels.label == found.node, "left").select("label", F.coalesce("component", "label").alias("whole"))


def merge_small(labels: DataFrame, image: DataFrame, least: int, bands: int | None = None) -> DataFrame:
    """The labels (y, x, label; or band, y, x, label) with no region under ``least`` pixels that has a neighbour (see ``merge_regions``).

    ``image`` is (y, x, colour) with that number of ``bands``; for labels of each
    band on its own it is (band, y, x, dn).
    """
    if "band" in labels.columns:
        label = (F.col("label") + _band()).alias("label")
        stats = labels.join(image, ["band", "y", "x"]).groupBy(label).agg(F.count("*").alias("n"), F.sum("dn").alias("s0"))
        edges = neighbours(labels).select(label, (F.col("other") + _band()).alias("other"))
        moved = merge_regions(stats, edges, ["s0"], least)
        return labels.withColumn("node", label).join(moved.withColumnRenamed("label", "node"), "node").select("band", "y", "x", (F.col("whole") - _band()).alias("label"))
    sums = [f"s{i}" for i in range(bands)]
    stats = labels.join(image, ["y", "x"]).groupBy("label").agg(F.count("*").alias("n"), *[F.sum(F.get("colour", F.lit(i))).alias(s) for i, s in enumerate(sums)])
    return labels.join(merge_regions(stats, neighbours(labels), sums, least), "label").select("y", "x", F.col("whole").alias("label"))


def boundaries(labels: DataFrame) -> DataFrame:
    """label, x0, y0, x1, y1 (and band, where labels have one): the pixel sides between a region and what isn't it, inside on the left of the way."""
    keys = _keys(labels)
    differs = lambda axis, shift: F.coalesce(_beside(labels, axis, shift) != F.col("label"), F.lit(True))
    x, y = F.col("x"), F.col("y")
    side = lambda on, a, b, c, d: F.when(F.col(on), F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))
    sides = F.array(
        side("up", x, y, x + 1, y),
        side("after", x + 1, y, x + 1, y + 1),
        side("below", x + 1, y + 1, x, y + 1),
        side("before", x, y + 1, x, y),
    )
    marked = labels.withColumns({"up": differs("y", -1), "below": differs("y", 1), "before": differs("x", -1), "after": differs("x", 1)})
    return marked.select(*keys, "label", F.explode(sides).alias("s")).where("s is not null").select(*keys, "label", "s.*")


def vectorise(labels: DataFrame, tile: int = TILE) -> DataFrame:
    """label, rings (and band, where labels have one): the polygon of every region, shell first.

    Tasks assemble ways within tiles, which are then put in order across tiles
    (see ``outlines``); a region's row is no larger than its polygon.
    """
    keys = [*_keys(labels), "label"]
    # A side is its pixel's: the one on whose left the inside lies.
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    px, py = F.least("x0", "x1") - F.when(dy > 0, 1).otherwise(0), F.least("y0", "y1") - F.when(dx < 0, 1).otherwise(0)
    sides = boundaries(labels).withColumns({"tx": F.floor(px / tile).cast("int"), "ty": F.floor(py / tile).cast("int")})
    whole = [F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return outlines.assembled(sides.select(*keys, *whole, "ty", "tx"), keys, tile)


def segment(
    pixels: DataFrame,
    spatial: int,
    spectral: float,
    least: int,
    delete: bool = False,
    iterations: int = 100,
    threshold: float = 0.1,
    tile: int = TILE,
    transform: tuple[float, float, float, float] | None = None,
    srs: str | None = None,
    ramp: float = 0.0,
) -> DataFrame:
    """label, nbpixels, meanb*, varb*, rings and the nine shape metrics of every segment of an image (band, y, x, dn).

    The image is smoothed by mean shift over all its bands; neighbours whose
    modes lie within both radii make one region. Regions under ``least`` pixels
    are left out (``delete``), or merged by increasing size into the neighbour of
    nearest mean. Statistics are those of the smoothed image. Rings are in
    pixels, or in the world's units by ``transform`` (x0, dx, y0, dy); where the
    world's system ``srs`` is given, metrics are taken in web mercator.
    """
    bands = bands_of(pixels)
    smooth = cut(mean_shift(pixels, spatial, spectral, iterations, threshold, tile, bands, ramp), "smooth")
    image = smooth.select("y", "x", "colour")
    labels = linked_labels(smooth, spatial, spectral, tile)
    if delete:
        big = labels.groupBy("label").count().where(F.col("count") >= least).select("label")
        labels = labels.join(big, "label", "left_semi")
    else:
        labels = merge_small(cut(labels, "linked"), image, least, len(bands))
    labels = cut(labels.select("y", "x", "label"), "segments")
    shapes = vectorise(labels, tile)
    if transform:
        x0, dx, y0, dy = transform
        shapes = shapes.withColumn("rings", g.mapped(F.col("rings"), lambda p: (x0 + p["x"] * dx, y0 + p["y"] * dy)))
    return with_metrics(wide_stats(labels, image, len(bands)).join(shapes, "label"), srs=srs if transform else None)
