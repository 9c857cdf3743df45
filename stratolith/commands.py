"""One function for each command of the workflow; all return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from stratolith.functions import geometry
from stratolith.operators import catalog, overlay, params, raster, segment, virtual, warp
from stratolith.operators.metrics import METRICS
from stratolith.sources import shapefile, tables
from stratolith.sources.states import FIPS
from stratolith.storage import unused

#: Degrees of a pixel at zoom 1, and the fields that a profile of segments has.
DEGREES_PER_PIXEL = 0.000005836467370
#: The end of a package's name: one package, or parts as ``shapefile.write_zipped`` names them.
_PART = r"(_[0-9a-f]{32})?\.zip$"
PROFILED = ["nbpixels", *[f"{m}b{k}" for m in ("mean", "var") for k in range(6)], *METRICS]


class NoImage(ValueError):
    """None of an area's tiles has an image."""


def describe_config(spark: SparkSession, config: dict[str, str]) -> DataFrame:
    """key and value of every setting; passwords are shown as stars."""
    shown = [(k, "*" * max(len(str(v)), 1) if k.endswith("pass") else str(v)) for k, v in sorted(config.items())]
    return spark.createDataFrame(shown, "key string, value string")


def _boxed(regions: DataFrame) -> DataFrame:
    points = F.flatten(F.flatten("geom"))
    at = lambda c: F.transform(points, lambda p: p[c])
    return regions.withColumns({"xmin": F.array_min(at("x")), "ymin": F.array_min(at("y")), "xmax": F.array_max(at("x")), "ymax": F.array_max(at("y"))})


def ingest_regions(spark: SparkSession, folder: str, states: list[str] | None = None, pattern: str = r"\.zip$") -> DataFrame:
    """Region shapefiles of the given two-digit states (all without): one table, with a box for every row."""
    regions = shapefile.read_zipped(spark, folder, pattern)
    if states is not None and len(regions.columns) > 1:
        code = "statefp" if "statefp" in regions.columns else "geoid"
        regions = regions.where(F.substring(code, 1, 2).isin(states))
    return _boxed(regions)


def ingest_census(spark: SparkSession, folder: str, area: str | list, year: str = "2016") -> dict[str, DataFrame]:
    """The tables county, cousub and roads of the packages under ``folder``: all counties, the subdivisions of the area's states, its counties' roads.

    A box asks the counties which states and counties it overlaps; a state's
    roads are those of all its counties.
    """
    wanted = catalog.parse_area(area)
    county = ingest_regions(spark, folder, pattern=rf"^tl_{year}_us_county{_PART}")
    if wanted.kind == "bbox":
        states, counties = catalog.region_lists(county, wanted.value)
    else:
        states, counties = [wanted.value[:2]], [wanted.value[:5] if len(wanted.value) >= 5 else wanted.value + "[0-9]*"]
    if not states:
        raise ValueError("the area overlaps no county")
    named = lambda codes, kind: rf"^tl_{year}_({'|'.join(codes)})_{kind}{_PART}"
    return {"county": county, "cousub": ingest_regions(spark, folder, pattern=named(states, "cousub")), "roads": ingest_regions(spark, folder, pattern=named(counties, "roads"))}


def catalogue_sources(spark: SparkSession, template: str, year: str, states: list[str] | None = None) -> DataFrame:
    """st and url of the catalogue's packages, for some or for all states; the template has {0} for the year, {1} for the state, {2} for its two digits."""
    rows = sorted(set(states if states is not None else FIPS.values()))
    form = template.replace("%", "%%").replace("{0}", "%1$s").replace("{1}", "%2$s").replace("{2}", "%3$s")
    found = spark.createDataFrame([(s,) for s in rows], "st string")
    return found.select("st", F.format_string(form, F.lit(year), F.lower("st"), F.right(F.lit(year), F.lit(2))).alias("url"))


def load_catalogue(spark: SparkSession, folder: str, year: str) -> DataFrame:
    """The year's tile catalogue from its packages under ``folder``, with a box for every tile."""
    return _boxed(shapefile.read_zipped(spark, folder, rf"_naip{year[-2:]}qq{_PART}"))


def tiles_of_area(tiles: DataFrame, regions: DataFrame, area: str, states: dict[str, str], default: str = "", cell: float = 1.0) -> DataFrame:
    """The tiles of a state, county, subdivision or box; ``states`` maps two-digit codes to the tiles' abbreviations, in either case.

    A region's tiles are those whose outline shares a point with its polygon.
    Either side may have its shape as ``geom`` (parts) or ``rings``; without one
    its box is its shape.
    """
    wanted = catalog.parse_area(area, default)
    if wanted.kind == "bbox":
        return tiles.where(catalog.in_box(wanted.value))
    if wanted.kind == "state":
        return tiles.where(F.upper("st") == F.lit(states.get(wanted.value, "").upper()))

    region = regions.where(F.col("geoid") == wanted.value)
    outline, key = unused(tiles, "rings"), unused(tiles, "region")
    boxes = region.select("xmin", "ymin", "xmax", "ymax", F.monotonically_increasing_id().alias(key))
    # Boxes first: only tiles near the region send their edges.
    near = catalog.grid_join(tiles.select("gid", "xmin", "ymin", "xmax", "ymax", overlay.outline_of(tiles).alias(outline)), boxes, cell).dropDuplicates(["gid"]).select("gid", F.col(outline).alias("rings"))
    theirs = region.select(F.lit(0).alias("region"), overlay.outline_of(region).alias("rings"))
    return tiles.join(overlay.shared(near, theirs, "gid", "region", cell).select("gid").distinct(), "gid", "left_semi").select(*tiles.columns)


def tiles_around(tiles: DataFrame, lat: float, lon: float, pixels: int, zoom: float = 1.0) -> DataFrame:
    """The tiles that an image of that many pixels around a place needs, with a margin of 100 pixels.

    Tiles with an outline (``geom`` or ``rings``) are judged by it, as a tilted
    one's box reaches farther than the tile; others by their boxes.
    """
    d = (pixels / 2 + 100) * DEGREES_PER_PIXEL * zoom
    near = tiles.where(catalog.in_box((lon - d, lat - d, lon + d, lat + d)))
    if "geom" not in tiles.columns and "rings" not in tiles.columns:
        return near
    box = F.array(geometry.rectangle(*[F.lit(v) for v in (lon - d, lat - d, lon + d, lat + d)]))
    shapes = near["geom"] if "geom" in tiles.columns else F.array(near["rings"])
    return near.where(F.exists(shapes, lambda rings: F.coalesce(geometry.intersects(rings, box), F.lit(False))))


def plan_fetch(tiles: DataFrame, regions: DataFrame, log: DataFrame, area: str, states: dict[str, str], default: str = "") -> DataFrame:
    """gid and filename of the area's tiles that aren't here yet."""
    return catalog.to_fetch(tiles_of_area(tiles, regions, area, states, default), log).select("gid", "filename")


def plan_process(tiles: DataFrame, log: DataFrame, workers: int, limit: int = 0, files: DataFrame | None = None) -> DataFrame:
    """Tiles that are here and unprocessed, dealt to workers; or those of a list of files (column ``file``)."""
    chosen = catalog.find_by_name(tiles, files, "file") if files is not None else catalog.pending(tiles, log)
    return catalog.per_worker(chosen, workers, limit)


def status_report(tiles: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Tiles by state as aligned text lines: all, or those that the log has."""
    found = catalog.status(catalog.here(tiles, log) if log is not None else tiles)
    return found.select("st", F.format_string("%-8s %12s", "st", F.format_number("tiles", 0)).alias("line"))


def profile_report(segments: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Least, greatest, mean and deviation of each field as aligned text lines, in the fields' order; fields that aren't there are left out."""
    fields = fields or PROFILED
    order = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    return catalog.profile(segments, fields).orderBy(order).select("field", F.format_string(" %-8s | %8f | %8f | %8f | %8f |", "field", "min", "max", "avg", "std").alias("line"))


def parameter_report(best: DataFrame) -> DataFrame:
    """The nine parameters as three aligned text lines."""
    line = lambda k: F.struct(F.lit(k).alias("which"), F.format_string(f"{k} |  %2d  |  %2d  | %4d", *[f"{p}_{k}" for p in ("hs", "hr", "m")]).alias("line"))
    return best.select(F.inline(F.array(*map(line, ("min", "max", "avg")))))


def optimal_parameters_at(pixels: DataFrame, x0: int, y0: int, side: int, bands: list[int], boxy: bool = False) -> DataFrame:
    """The nine segmentation parameters of a window of the chosen bands."""
    return params.optimal_parameters(raster.crop(raster.select_bands(pixels, bands), x0, y0, side, side), boxy)


def optimal_parameters_of(images: DataFrame, rasters: DataFrame, lat: float, lon: float, side: int, bands: list[int], boxy: bool = False) -> DataFrame:
    """The nine parameters of a window of ``side`` pixels around a place, on the mosaic of the images (with their ``raster.metadata``).

    A window that is larger than the mosaic is all of it.
    """
    whole, (x0, dx, y0, dy) = raster.mosaic_of(images, rasters)
    size = raster.size(whole).agg(F.max("w").alias("w"), F.max("h").alias("h")).first()
    side = min(side, size["w"], size["h"])
    left, top = int((lon - x0) / dx - side // 2), int((lat - y0) / dy - side // 2)
    return optimal_parameters_at(whole, left, top, side, bands, boxy)


def segment_area(
    pixels: DataFrame, path: str, year: int, job: str, spatial: int = 16, spectral: float = 16.0, least: int = 100, delete: bool = False, transform: tuple[float, float, float, float] | None = None,
    srs: str | None = "EPSG:4326", iterations: int = 100, threshold: float = 0.1, ramp: float = 0.0, tile: int = segment.TILE,
) -> DataFrame:
    """Segment an image and load the result as that year's and job's part of the table at ``path``.

    With a ``transform`` rings are in the world's units, and metrics in web
    mercator; with ``srs`` None they are in the rings' units.
    """
    if spatial < 1 or spectral <= 0 or least < 0 or iterations < 1 or threshold < 0 or ramp < 0 or tile < 1 or not job:
        raise ValueError("radii, sizes and iterations must be positive, the least size, threshold and ramp not negative, and the job named")
    return tables.load_segments(segment.segment(pixels, spatial, spectral, least, delete, iterations, threshold, tile, transform, srs, ramp), path, year, job)


def _known(best: DataFrame) -> Row:
    """The row of nine parameters; an error where there is none."""
    row = best.first()
    if row is None:
        raise ValueError("the middle has too few pixels for parameters")
    return row


def index_of_area(images: DataFrame, rasters: DataFrame, tiles: DataFrame, path: str, side: int = raster.SIDE) -> tuple[DataFrame, tuple[float, float, float, float], tuple[int, int], str]:
    """(index of the mosaic of the chosen tiles' images, its transform, its width and height, its coordinate system).

    ``images`` and their ``rasters`` are numbered by the catalogue's gid; all
    must have one pixel size and one system. The index is written at ``path``
    (see ``virtual.write_index``); later gids lie on top. Only the grid's few
    numbers come to the driver.
    """
    gids = tiles.select(F.col("gid").alias("image"))
    some = rasters.join(gids, "image", "left_semi")
    grid = some.agg(F.min("x0").alias("x0"), F.first("dx").alias("dx"), F.max("y0").alias("y0"), F.first("dy").alias("dy"), F.count_distinct("dx", "dy", "srs").alias("n"), F.first("srs").alias("srs")).first()
    if not grid["n"]:
        raise NoImage("the area has no image")
    if grid["n"] != 1:
        raise ValueError(f"{grid['n']} pixel sizes or systems among the images")
    shift = lambda c, d: F.round((F.col(c) - grid[c]) / grid[d]).cast("int")
    places = some.select("image", shift("x0", "dx").alias("dx"), shift("y0", "dy").alias("dy"), F.col("image").alias("priority"), "width", "height")
    size = places.agg(F.max(F.col("dx") + F.col("width")).alias("w"), F.max(F.col("dy") + F.col("height")).alias("h")).first()
    index = virtual.write_index(raster.to_tiles(images.join(gids, "image", "left_semi"), side), places, path)
    return index, (grid["x0"], grid["dx"], grid["y0"], grid["dy"]), (int(size["w"]), int(size["h"])), grid["srs"]


def segment_of_area(
    images: DataFrame, rasters: DataFrame, tiles: DataFrame, regions: DataFrame, log: DataFrame, area: str, states: dict[str, str], path: str, year: int, job: str, index: str,
    spatial: int = 16, spectral: float = 16.0, least: int = 100, delete: bool = False, bands: list[int] | None = None, optimal: str | None = None, side: int = 1024,
    iterations: int = 100, threshold: float = 0.1, ramp: float = 0.0, tile: int = segment.TILE, boxy: bool = True, default: str = "", cell: float = 1.0,
) -> DataFrame:
    """An area's segments, loaded as that year's and job's part of the table at ``path``.

    The area's tiles that are here are laid into one mosaic (its index goes to
    ``index``), which is segmented; metrics are taken in web mercator. With
    ``optimal`` (min, max or avg) radii and least size come from the mosaic's
    middle, ``side`` pixels square at most. Arguments are checked before
    anything is read.
    """
    if optimal not in (None, "min", "max", "avg"):
        raise ValueError(f"not a choice: {optimal}")
    if spatial < 1 or spectral <= 0 or least < 0 or iterations < 1 or threshold < 0 or ramp < 0 or side < 1 or tile < 1 or not job:
        raise ValueError("radii, sizes and iterations must be positive, the least size, threshold and ramp not negative, and the job named")
    if bands is not None and (not bands or min(bands) < 0):
        raise ValueError("bands are numbers from 0 on")
    chosen = catalog.here(tiles_of_area(tiles, regions, area, states, default, cell), log)
    found, transform, (w, h), srs = index_of_area(images, rasters, chosen, index)
    whole = lambda x0, y0, a, b: raster.select_bands(virtual.window(found, x0, y0, a, b, bands), bands) if bands else virtual.window(found, x0, y0, a, b)
    if optimal:
        side = min(side, w, h)
        best = _known(params.optimal_parameters(whole(w // 2 - side // 2, h // 2 - side // 2, side, side), boxy))
        spatial, spectral, least = best[f"hs_{optimal}"], float(best[f"hr_{optimal}"]), best[f"m_{optimal}"]
    made = segment.segment(whole(0, 0, w, h), spatial, spectral, least, delete, iterations, threshold, tile, transform, srs, ramp)
    return tables.load_segments(made, path, year, job)


def optimal_parameters_of_area(
    images: DataFrame, rasters: DataFrame, tiles: DataFrame, regions: DataFrame, log: DataFrame, area: str, states: dict[str, str], index: str, lat: float | None = None, lon: float | None = None,
    side: int = 512, bands: list[int] | None = None, boxy: bool = True, default: str = "", cell: float = 1.0,
) -> DataFrame:
    """The nine parameters of ``side`` pixels square around a place (without one the middle) of the mosaic of an area's tiles that are here; no row where too few pixels are there."""
    if side < 1 or (lat is None) != (lon is None):
        raise ValueError("the side must be positive, and a place has both lat and lon")
    chosen = catalog.here(tiles_of_area(tiles, regions, area, states, default, cell), log)
    found, (x0, dx, y0, dy), (w, h), _ = index_of_area(images, rasters, chosen, index)
    side = min(side, w, h)
    left, top = (w // 2 - side // 2, h // 2 - side // 2) if lat is None else (int((lon - x0) / dx - side // 2), int((lat - y0) / dy - side // 2))
    if left >= w or top >= h or left + side <= 0 or top + side <= 0:
        raise ValueError("the place lies outside of the mosaic")
    pixels = virtual.window(found, left, top, side, side, bands)
    return params.optimal_parameters(raster.select_bands(pixels, bands) if bands else pixels, boxy)


def segment_optimal(pixels: DataFrame, which: str = "avg", side: int = 1024, delete: bool = False, boxy: bool = False) -> DataFrame:
    """Segments with the parameters (min, max or avg) that the image's middle suggests."""
    if which not in ("min", "max", "avg"):
        raise ValueError(f"not a choice: {which}")
    best = _known(params.optimal_parameters(raster.centre_crop(pixels, side), boxy))
    return segment.segment(pixels, best[f"hs_{which}"], float(best[f"hr_{which}"]), best[f"m_{which}"], delete)


def process_tiles(images: DataFrame, path: str, grids: dict[int, tuple]) -> DataFrame:
    """Normalise delivered images and write them as a table of tiles at ``path``; ``grids`` has the other arguments of ``raster.normalise`` by image.

    Grids become a table, and the plan is the same for any number of them. A
    projection is none or ``raster.to_mercator``; ``normalise_images`` takes
    images of any known system.
    """
    if not grids:
        raise ValueError("no image")
    if any(len(g) > 4 and g[4] not in (None, raster.to_mercator) for g in grids.values()):
        raise ValueError("not a known projection")
    rows = [(n, *map(float, g[3]), "EPSG:3857" if len(g) > 4 and g[4] else "EPSG:4326", *map(float, g[2]), g[0], g[1]) for n, g in sorted(grids.items())]
    schema = "image int, x0 double, dx double, y0 double, dy double, srs string, ox0 double, odx double, oy0 double, ody double, ow int, oh int"
    table = images.sparkSession.createDataFrame(rows, schema)
    return tables.write_tiles(warp.normalised(raster.to_tiles(images), table), path)


def normalise_images(images: DataFrame, grids: DataFrame, path: str, side: int = raster.SIDE, factors: tuple[int, ...] = raster.OVERVIEWS, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tiles, overviews): all delivered images (image, band, y, x, dn) normalised in one plan, and written at ``path`` and beside it.

    ``grids`` are as ``warp.degrees_grids`` makes them of the images' metadata.
    With a ``log`` table, the images, whose numbers are then the catalogue's
    gids, are marked as processed once both are written.
    """
    tiles = tables.write_tiles(warp.normalised(raster.to_tiles(images, side), grids, side), path)
    beside = f"{path.rstrip('/')}_overviews"
    tables.write_tiles(warp.pyramid(tiles, factors), beside)
    if log:
        tables.record_processed(images.sparkSession, log, tiles.select(F.col("image").cast("long").alias("gid")).distinct())
    return tiles, images.sparkSession.read.parquet(beside)


def extract_image(pixels: DataFrame, origin: tuple[float, float], step: tuple[float, float], at: tuple[float, float], w: int, h: int) -> DataFrame:
    """A window of w by h pixels around the world's place ``at`` (x, y); only what lies on the image."""
    x0, y0 = (int((p - o) / s - n // 2) for p, o, s, n in zip(at, origin, step, (w, h), strict=True))
    return raster.crop(pixels, x0, y0, w, h)


def extract_place(images: DataFrame, rasters: DataFrame, lat: float, lon: float, w: int, h: int, path: str, bands: list[int] | None = None) -> DataFrame:
    """Cut w by h pixels around a place out of the mosaic of the images, and write them as a table of tiles at ``path``."""
    whole, (x0, dx, y0, dy) = raster.mosaic_of(images, rasters)
    chosen = raster.select_bands(whole, bands) if bands else whole
    return tables.write_images(extract_image(chosen, (x0, y0), (dx, dy), (lon, lat), w, h).withColumn("image", F.lit(0)), path)
