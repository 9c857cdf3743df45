"""Registered queries of the workflow's commands and managed tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratolith import commands
from stratolith.functions import geometry as g
from stratolith.operators import catalog, params, raster
from stratolith.plans.queries import _FETCHED, _HS, _SIZE, _SV_GAPS, _holed, _lv, _sql, query
from stratolith.sources import adapters as ad
from stratolith.sources import shapefile, tables
from stratolith.storage import cut, new_path

_BOX = ("xmin", "ymin", "xmax", "ymax")
_OVERLAP = "c.xmin <= r.xmax and c.xmax >= r.xmin and c.ymin <= r.ymax and c.ymax >= r.ymin"


def _together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _outline() -> Column:
    """The row's box as a shape."""
    return F.array(F.array(g.rectangle(*[F.col(c) for c in _BOX])))


@query(_sql("select gid, st, filename, xmin, ymin, xmax, ymax from catalogue", "catalogue"))
def catalogue_loaded(spark, sf_dir):
    """A year's catalogue from every state's packages; another year's packages lie beside them."""
    folder, tiles = new_path(spark, "catalogue"), ad.catalogue(spark, sf_dir).withColumn("geom", _outline())
    year = lambda df, yy: df.select("gid", "st", "filename", "geom", F.concat(F.lower("st"), F.lit(f"_naip{yy}qq")).alias("package"))
    cut(shapefile.write_zipped(_together(year(tiles, "14"), year(tiles.withColumn("gid", -F.col("gid")), "12")), folder, named="package"), "packages")
    return commands.load_catalogue(spark, folder, "2014").select("gid", "st", "filename", *_BOX)


@query(
    _sql(
        """select 'county' kind, * from counties union all select 'cousub', geoid || '00001', * exclude geoid from counties where substr(geoid, 1, 2) in (select substr(geoid, 1, 2) from near)
        union all select 'roads', * from counties semi join near using (geoid)""",
        "regions", "counties as (select lpad((geoid::int * 37 % 100000)::varchar, 5, '0') geoid, xmin, ymin, xmax, ymax from regions)",
        "near as (select geoid from counties where xmin <= 30 and xmax >= 4 and ymin <= 22 and ymax >= 3)",
    )
)
def census_ingested(spark, sf_dir):
    """The three tables that a box needs: all counties, its states' subdivisions, its counties' roads."""
    folder = new_path(spark, "census")
    code = F.lpad((F.col("geoid").cast("int") * 37 % 100000).cast("string"), 5, "0")
    counties = ad.regions(spark, sf_dir).withColumn("geoid", code).select(F.substring("geoid", 1, 2).alias("statefp"), "geoid", _outline().alias("geom"))
    packages = _together(
        counties.withColumn("package", F.lit("tl_2016_us_county")),
        counties.withColumns({"geoid": F.concat("geoid", F.lit("00001")), "package": F.format_string("tl_2016_%s_cousub", "statefp")}),
        counties.withColumn("package", F.format_string("tl_2016_%s_roads", "geoid")),
    )
    cut(shapefile.write_zipped(packages, folder, named="package"), "packages")
    found = commands.ingest_census(spark, folder, [4, 3, 30, 22])
    return _together(*[df.select(F.lit(kind).alias("kind"), "geoid", *_BOX) for kind, df in found.items()])


@query(
    _sql(
        f"""select 'default' kind, gid from catalogue where st = 'Brand#13' union all select 'county', gid from catalogue c join regions r on {_OVERLAP} where geoid = '00002'
        union all select 'cousub', gid from catalogue c join regions r on {_OVERLAP} where geoid = '00003' union all select 'bbox', gid from catalogue where xmin <= 12.5 and xmax >= 3.25 and ymin <= 9 and ymax >= 2""",
        "catalogue", "regions",
    )
)
def areas_dispatched(spark, sf_dir):
    """Each kind of area in the same words: none given (the default, a state), a county, a subdivision, a box."""
    tiles, counties = ad.catalogue(spark, sf_dir), ad.regions(spark, sf_dir)
    regions = counties.unionByName(counties.withColumn("geoid", F.concat("geoid", F.lit("00001"))))
    areas = {"default": "", "county": "00002", "cousub": "0000300001", "bbox": "12.5,2,3.25,9"}
    return _together(*[commands.tiles_of_area(tiles, regions, area, {"06": "brand#13"}, "06").select(F.lit(kind).alias("kind"), "gid") for kind, area in areas.items()])


@query(_sql("select st, min(gid) gid from catalogue group by 1", "catalogue"))
def states_first_seen(spark, sf_dir):
    return catalog.first_seen(ad.catalogue(spark, sf_dir), "st", "gid")


@query(_sql("select gid, processed from log", "log"))
def log_kept(spark, sf_dir):
    """A log table: what is here is recorded twice, what is done once, with gids that it doesn't know."""
    fetched, name = ad.fetched(spark, sf_dir), f"naip.{new_path(spark, 'log').rsplit('/', 1)[1].replace('-', '_')}"
    tables.init_namespaces(spark)
    tables.ensure_log(spark, name)
    for _ in range(2):
        tables.record_fetched(spark, name, fetched.select("gid").union(fetched.select("gid")))
    done = fetched.where("processed").select("gid")
    tables.record_processed(spark, name, done.union(done.select(-F.col("gid"))))
    kept = cut(spark.table(name), "log")
    spark.sql(f"drop table {name}")
    return kept


@query(_sql("select st, printf('%-8s %12s', st, format('{:,}', count(*))) line from catalogue semi join log using (gid) group by 1", "catalogue", "log"))
def status_lines(spark, sf_dir):
    return commands.status_report(ad.catalogue(spark, sf_dir), ad.fetched(spark, sf_dir))


@query(_sql("select field, printf(' %-8s | %8f | %8f | %8f | %8f |', field, min(v), max(v), avg(v), stddev_samp(v)) line from (unpivot (select area, perim from shapes) on area, perim into name field value v) group by 1", "rects"))
def profile_lines(spark, sf_dir):
    """The report of segments that have two of the profile's fields."""
    rings = ad.segments(spark, sf_dir).select(g.area(F.col("rings")).alias("area"), g.perimeter(F.col("rings")).alias("perim"))
    return commands.profile_report(rings)


@query(
    _sql(
        "select segment, line, line < 7 polygon, case when line < 7 then w * h - hole end area, case when line < 7 then (w + 1) * (h + 1) end wider, case when line < 7 then 1 end::int parts from rects",
        "rects",
    )
)
def wkt_polygons(spark, sf_dir):
    """Shapes as text and back: only polygons are read, measured and promoted; a seventh line's text is a point."""
    spelt = lambda ring: F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"], p["y"])), ", "), F.lit(")"))
    text = F.concat(F.lit("POLYGON ("), F.array_join(F.transform("rings", spelt), ", "), F.lit(")"))
    read = ad.segments(spark, sf_dir).select("segment", "line", g.parse_wkt(F.when(F.col("line") < 7, text).otherwise("POINT (1 2)")).alias("rings"))
    rings = F.col("rings")
    kept = lambda c: F.when(g.is_polygon(rings), c)
    return read.select("segment", "line", g.is_polygon(rings).alias("polygon"), kept(g.area(rings)).alias("area"), kept(g.box_area(g.expand(g.envelope(rings), F.lit(0.5)))).alias("wider"), kept(F.size(g.promote(rings))).alias("parts"))


@query(_sql("select band, (y - 3)::int y, (x - 5)::int x, dn::int dn from pixels where x between 5 and 21 and y between 3 and 11", "pixels"))
def crop_pixels(spark, sf_dir):
    return raster.crop(ad.pixels(spark, sf_dir), 5, 3, 17, 9)


@query(_sql("select band, (y - 7)::int y, (x - 51)::int x, dn::int dn from pixels where x between 51 and 70 and y between 7 and 14", "pixels"))
def crop_world(spark, sf_dir):
    """A window around a place of the world that reaches beyond the image."""
    return commands.extract_image(ad.pixels(spark, sf_dir), (100.0, 50.0), (0.5, -0.25), (130.5, 47.25), 20, 8)


@query(_sql("select band, round(avg(lv), 6) mean, round(stddev_pop(lv), 6) sigma from lv group by 1", "pixels", _SIZE, _lv("select 8 n")))
def variance_fit(spark, sf_dir):
    return params.variance_fit(ad.pixels(spark, sf_dir), 8).select("band", *[F.round(c, 6).alias(c) for c in ("mean", "sigma")])


@query(_sql("select band, round(bin * top / 50 + 1e-9, 6) low, count(*) pixels from (select band, top, least(floor(lv / top * 50), 49) bin from lv join (select band, max(lv) top from lv group by 1) using (band)) group by band, bin, top", "pixels", _SIZE, _lv("select 8 n")))
def variance_series(spark, sf_dir):
    """The histogram behind the plot of local variances."""
    return params.variance_series(ad.pixels(spark, sf_dir), 8).withColumn("low", F.round(F.col("low") + 1e-9, 6))


_STRIPS = 20


@query(
    _sql(
        """select hs_min, hs_max, hs_avg, round(min(hr))::int hr_min, round(max(hr))::int hr_max, round(avg(hr))::int hr_avg, (hs_min * hs_min // 2)::int m_min, (hs_max * hs_max // 2)::int m_max, (hs_avg * hs_avg // 2)::int m_avg
        from hr, (select min(hs)::int hs_min, max(hs)::int hs_max, (sum(hs) // count(*))::int hs_avg from hs) group by all""",
        *_FETCHED[:-1], _FETCHED[-1].replace("pixels as", "whole as", 1),
        f"extent as (select least(64, h) side, h from (select {_STRIPS} * (max(gid) - min(gid) + 1) h from chosen))",
        """pixels as (select band, (y - (h // 2 - side // 2))::int y, (x - (32 - side // 2))::int x, dn from whole, extent
        where y - (h // 2 - side // 2) between 0 and side - 1 and x - (32 - side // 2) between 0 and side - 1)""",
        _SIZE, *_SV_GAPS, _HS, _lv("select (sum(hs) // count(*))::bigint n from hs"),
    )
)
def optimal_params_of_area(spark, sf_dir):
    """From an area to the nine parameters: the middle of the mosaic of its tiles that are here. No row where nothing is there."""
    images = _holed(spark, sf_dir).select((F.floor(F.col("y") / _STRIPS) + 1).cast("int").alias("image"), "band", (F.col("y") % _STRIPS).alias("y"), "x", "dn")
    step = 1e-4
    rasters = images.select("image").distinct().select("image", F.lit(64).alias("width"), F.lit(_STRIPS).alias("height"), F.lit(-117.0).alias("x0"), F.lit(step).alias("dx"), (33.5 - (F.col("image") - 1) * _STRIPS * step).alias("y0"), F.lit(-step).alias("dy"), F.lit("EPSG:4326").alias("srs"))
    tiles = ad.catalogue(spark, sf_dir).join(rasters.select(F.col("image").alias("gid")), "gid", "left_semi")
    try:
        return commands.optimal_parameters_of_area(images, rasters, tiles, ad.regions(spark, sf_dir), ad.fetched(spark, sf_dir), "0.5,0.2,39.5,0.8", {}, new_path(spark, "index"))
    except commands.NoImage:
        return spark.createDataFrame([], ", ".join(f"{a}_{b} int" for a in ("hs", "hr", "m") for b in ("min", "max", "avg")))
