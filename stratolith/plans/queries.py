"""Registered queries of the catalogue, vector and raster operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolith import commands
from stratolith.functions import geometry as g
from stratolith.functions.circle import convex_hull, group_circles
from stratolith.functions.projections import forward, inverse, utm
from stratolith.functions.shapes import areas
from stratolith.operators import catalog, overlay, params, raster, segment, virtual
from stratolith.operators.metrics import METRICS, with_metrics
from stratolith.sources import adapters as ad
from stratolith.sources import shapefile, tables
from stratolith.sources.states import FIPS
from stratolith.storage import cut, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The model's tables in SQL, for the oracles.
_CTE = {
    "catalogue": """catalogue as (select p_partkey gid, p_brand st, 'm_' || lpad(p_partkey::varchar, 7, '0') || '_ne_11_1_20140601_20141101.shp' filename,
        (p_partkey % 50)::double xmin, floor(p_partkey / 50)::double ymin, (p_partkey % 50 + 1)::double xmax, (floor(p_partkey / 50) + 1)::double ymax from part)""",
    "regions": """regions as (select lpad(s_suppkey::varchar, 5, '0') geoid, substr(lpad(s_suppkey::varchar, 5, '0'), 1, 2) statefp, (s_suppkey % 10 * 5 + 0.5)::double xmin, (floor(s_suppkey / 10) * 4 + 0.5)::double ymin,
        (s_suppkey % 10 * 5 + 2.0)::double xmax, (floor(s_suppkey / 10) * 4 + 3.0)::double ymax from supplier)""",
    "log": "log as (select l_partkey gid, case when bool_or(l_linestatus = 'O') then true end processed from lineitem where l_quantity = 50 group by 1)",
    "rects": """rects as (select l_orderkey segment, l_linenumber line, l_quantity w, l_linenumber::double h, case when l_quantity >= 3 and l_linenumber >= 3 then 1.0::double else 0.0::double end hole from lineitem),
        shapes as (select segment, line, w * h - hole area, 2 * (w + h) + 4 * hole perim, sqrt(w * w + h * h) / 2 r from rects)""",
    "pixels": """pixels as (select (vec_id % 5)::int band, (vec_id // 5)::int y, (i - 1)::int x, floor((embedding[i]::double + 1) * 127.5)::bigint dn from embeddings, lateral (select unnest(range(1, len(embedding) + 1)) i))""",
}
_METRICS = """area, perim, case when area > 0 then perim / area else 0.0 end para, area / (2 * pi() * r) compact, 4 * pi() * area / (perim * perim) compact2, perim / (pi() * r * r) smooth,
    0.25 * perim / sqrt(area) shape, case when area <= 1 or perim / 4 < 1 then 1.0 else 2 * ln(perim / 4) / ln(area) end frac, 1 - area / (pi() * r * r) circle"""


def _sql(body: str, *ctes: str, recursive: bool = False) -> str:
    heads = [_CTE.get(c, c) for c in ctes]
    return ("with " + "recursive " * recursive + ",\n".join(heads) + "\n" if heads else "") + body


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(names, places: int = 6):
    return [F.round(n, places).alias(n) for n in names]


@query(_sql("select field, round(min(v), 6) min, round(max(v), 6) max, round(avg(v), 6) avg, round(stddev_samp(v), 6) std from (unpivot (select " + _METRICS + " from shapes) on columns(*) into name field value v) group by 1", "rects"))
def profile_segments(spark, sf_dir):
    found = catalog.profile(with_metrics(ad.segments(spark, sf_dir)), [*METRICS, "nbpixels"])
    return found.select("field", *_rounded(["min", "max", "avg", "std"]))


@query(_sql("select st, count(*) tiles from catalogue group by 1", "catalogue"))
def status_by_state(spark, sf_dir):
    return catalog.status(ad.catalogue(spark, sf_dir))


@query(_sql("select st, count(*) tiles from catalogue semi join log using (gid) group by 1", "catalogue", "log"))
def status_fetched_by_state(spark, sf_dir):
    return catalog.status(catalog.here(ad.catalogue(spark, sf_dir), ad.fetched(spark, sf_dir)))


@query(_sql("select gid, filename from catalogue anti join log using (gid)", "catalogue", "log"))
def tiles_to_fetch(spark, sf_dir):
    return catalog.to_fetch(ad.catalogue(spark, sf_dir), ad.fetched(spark, sf_dir)).select("gid", "filename")


@query(_sql("select count(*) tiles from catalogue anti join log using (gid)", "catalogue", "log"))
def tiles_to_fetch_count(spark, sf_dir):
    return tiles_to_fetch(spark, sf_dir).agg(F.count("*").alias("tiles"))


@query(_sql("select gid, filename from catalogue semi join (select gid from log where processed is null) using (gid)", "catalogue", "log"))
def tiles_pending(spark, sf_dir):
    return catalog.pending(ad.catalogue(spark, sf_dir), ad.fetched(spark, sf_dir)).select("gid", "filename").orderBy("gid")


@query(_sql("select gid, filename, (gid % 4)::int worker from catalogue semi join (select gid from log where processed is null) using (gid) qualify row_number() over (partition by gid % 4 order by gid) <= 5", "catalogue", "log"))
def tiles_pending_limit_per_worker(spark, sf_dir):
    return catalog.per_worker(tiles_pending(spark, sf_dir), 4, 5)


@query(_sql("select gid, filename from catalogue where st = 'Brand#13'", "catalogue"))
def aoi_state(spark, sf_dir):
    return ad.catalogue(spark, sf_dir).where(F.col("st") == "Brand#13").select("gid", "filename")


@query(_sql("select c.gid, filename from catalogue c join regions r on c.xmin <= r.xmax and c.xmax >= r.xmin and c.ymin <= r.ymax and c.ymax >= r.ymin where r.geoid = '00002'", "catalogue", "regions"))
def aoi_county(spark, sf_dir):
    area = catalog.parse_area("00002")
    county = ad.regions(spark, sf_dir).where(F.col("geoid") == area.value)
    return catalog.grid_join(ad.catalogue(spark, sf_dir), county, 4.0).select("gid", "filename")


@query(_sql("select gid, filename from catalogue where xmin <= 12.5 and xmax >= 3.25 and ymin <= 9 and ymax >= 2", "catalogue"))
def aoi_bbox(spark, sf_dir):
    area = catalog.parse_area("12.5,2,3.25,9")
    return ad.catalogue(spark, sf_dir).where(catalog.in_box(area.value)).select("gid", "filename")


@query(_sql("select statefp, geoid from regions where xmin <= 30 and xmax >= 4 and ymin <= 22 and ymax >= 3", "regions"))
def region_lists_from_bbox(spark, sf_dir):
    return ad.regions(spark, sf_dir).where(catalog.in_box((4.0, 3.0, 30.0, 22.0))).select("statefp", "geoid").distinct()


@query(_sql("select gid, st, filename, xmin, ymin, xmax, ymax, 1.0::double area from catalogue", "catalogue"))
def shapefile_round_trip(spark, sf_dir):
    """All tiles written as zipped shapefiles to the shared folder and read back."""
    folder = new_path(spark, "shapes")
    shell = g.rectangle(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    cut(shapefile.write_zipped(ad.catalogue(spark, sf_dir).select("gid", "st", "filename", F.array(F.array(shell)).alias("geom")), folder), "packages")
    back = shapefile.read_zipped(spark, folder)
    return back.select("gid", "st", "filename", g.envelope(F.get("geom", F.lit(0))).alias("box"), g.area(F.get("geom", F.lit(0))).alias("area")).select("gid", "st", "filename", "box.*", "area")


@query(
    _sql(
        """select gid, filename from catalogue c join regions r on c.xmin <= r.xmax and c.xmax >= r.xmin and c.ymin <= r.ymax and c.ymax >= r.ymin
        where r.geoid = '00002' and (greatest(c.xmin, r.xmin) - r.xmin) / (r.xmax - r.xmin) + (greatest(c.ymin, r.ymin) - r.ymin) / (r.ymax - r.ymin) <= 1""",
        "catalogue", "regions",
    )
)
def aoi_polygon(spark, sf_dir):
    """The tiles of a county that is the lower left half of its box: some that touch the box don't touch the county."""
    at = lambda x, y: g.point(F.col(x), F.col(y))
    counties = ad.regions(spark, sf_dir).withColumn("rings", F.array(F.array(at("xmin", "ymin"), at("xmax", "ymin"), at("xmin", "ymax"), at("xmin", "ymin"))))
    return commands.tiles_of_area(ad.catalogue(spark, sf_dir), counties, "00002", {}, cell=4.0).select("gid", "filename")


@query(_sql("select min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax from regions where statefp = '00'", "regions"))
def region_extent(spark, sf_dir):
    return catalog.extent(ad.regions(spark, sf_dir).where("statefp = '00'"))


@query(_sql("select gid, '/data/' || substr(filename, 3, 5) || '/' || substr(filename, 1, 26) || '.tif' path from catalogue", "catalogue"))
def tile_paths(spark, sf_dir):
    return ad.catalogue(spark, sf_dir).select("gid", catalog.tile_path("/data", F.col("filename")).alias("path"))


@query(_sql("select gid, upper('x' || right('2014', 2)) || '/' || substr(filename, 3, 5) || '/' || substr(filename, 1, 26) || '.tif' url from catalogue", "catalogue"))
def tile_urls(spark, sf_dir):
    name = F.col("filename")
    return ad.catalogue(spark, sf_dir).select("gid", F.format_string("%s/%s/%s", F.upper(F.concat(F.lit("x"), F.right(F.lit("2014"), F.lit(2)))), catalog.sub_directory(name), catalog.key_name(name)).alias("url"))


@query(_sql("select gid, c.filename from catalogue c semi join log using (gid)", "catalogue", "log"))
def name_prefix_lookup(spark, sf_dir):
    tiles = ad.catalogue(spark, sf_dir)
    files = catalog.here(tiles, ad.fetched(spark, sf_dir)).select(catalog.tile_path("/data", F.col("filename")).alias("file"))
    return catalog.find_by_name(tiles, files, "file").select("gid", "filename")


@query(_sql("select gid, processed from log union all select gid, null from (select distinct p_partkey gid from part) anti join log using (gid)", "log"))
def log_insert_ignore(spark, sf_dir):
    return catalog.insert_ignore(ad.fetched(spark, sf_dir), ad.catalogue(spark, sf_dir).select("gid"))


@query(_sql("select gid, case when gid % 3 = 0 then true else processed end processed from log", "log"))
def log_mark_processed(spark, sf_dir):
    return catalog.mark_processed(ad.fetched(spark, sf_dir), ad.catalogue(spark, sf_dir).where("gid % 3 = 0").select("gid"))


@query("with fips as (select unnest(map_entries(map {" + ", ".join(f"'{k}': '{v}'" for k, v in FIPS.items()) + "})) e) select s_suppkey, lpad((s_suppkey % 80)::varchar, 2, '0') fips, upper(e.value) state from supplier left join fips on e.key = lpad((s_suppkey % 80)::varchar, 2, '0')")
def fips_lookup(spark, sf_dir):
    lookup = F.broadcast(spark.createDataFrame(list(FIPS.items()), "fips string, name string"))
    codes = ad._read(spark, sf_dir, "supplier").select("s_suppkey", F.lpad((F.col("s_suppkey") % 80).cast("string"), 2, "0").alias("fips"))
    return codes.join(lookup, "fips", "left").select("s_suppkey", "fips", F.upper("name").alias("state"))


@query(_sql("select geoid, xmin, ymin, xmax, ymax from regions", "regions"))
def bbox_parse(spark, sf_dir):
    texts = ad.regions(spark, sf_dir).select("geoid", F.format_string("BOX(%s %s,%s %s)", "xmin", "ymin", "xmax", "ymax").alias("box"))
    return texts.select("geoid", g.parse_box(F.col("box")).alias("b")).select("geoid", "b.*")


@query(_sql("select geoid, printf('POLYGON((%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f))', xmin, ymin, xmin, ymax, xmax, ymax, xmax, ymin, xmin, ymin) wkt from regions", "regions"))
def bbox_to_wkt(spark, sf_dir):
    corners = ("xmin", "ymin", "xmin", "ymax", "xmax", "ymax", "xmax", "ymin", "xmin", "ymin")
    return ad.regions(spark, sf_dir).select("geoid", F.format_string("POLYGON((" + ",".join(["%.6f %.6f"] * 5) + "))", *corners).alias("wkt"))


@query(
    """select s_suppkey, round(s_suppkey::double * 0.25 - d, 6) xmin, round(s_suppkey::double * 0.125 - d, 6) ymin, round(s_suppkey::double * 0.25 + d, 6) xmax, round(s_suppkey::double * 0.125 + d, 6) ymax
    from supplier, (select 500 / 111120.0::double d)"""
)
def latlon_to_bbox(spark, sf_dir):
    k = F.col("s_suppkey")
    return ad._read(spark, sf_dir, "supplier").select("s_suppkey", raster.box_around(k * 0.125, k * 0.25, 500.0).alias("b")).select("s_suppkey", "b.*")


@query(_sql("select gid, trunc((xmin + 0.3 - -10.0) / 0.7 - 32)::int px, trunc((ymin + 0.3 - 50.0) / -0.7 - 32)::int py from catalogue", "catalogue"))
def world_to_pixel(spark, sf_dir):
    at = lambda c, origin, step: raster.world_to_pixel(F.col(c) + 0.3, F.lit(origin), F.lit(step), 64)
    return ad.catalogue(spark, sf_dir).select("gid", at("xmin", -10.0, 0.7).alias("px"), at("ymin", 50.0, -0.7).alias("py"))


_SIZE = "size as (select band, max(x) + 1 w, max(y) + 1 h from pixels group by 1)"


@query(_sql("select band, (y - h // 2 + s // 2)::int y, (x - w // 2 + s // 2)::int x, dn::int dn from (select *, least(32, w, h) s from pixels join size using (band)) where y - h // 2 + s // 2 between 0 and s - 1 and x - w // 2 + s // 2 between 0 and s - 1", "pixels", _SIZE))
def centre_crop(spark, sf_dir):
    return raster.centre_crop(ad.pixels(spark, sf_dir), 32)


@query(_sql("select gid, geoid from catalogue c join regions r on c.xmin <= r.xmax and c.xmax >= r.xmin and c.ymin <= r.ymax and c.ymax >= r.ymin", "catalogue", "regions"))
def spatial_join_grid(spark, sf_dir):
    tiles, counties = ad.catalogue(spark, sf_dir), ad.regions(spark, sf_dir)
    boxed = lambda df: df.withColumn("rings", F.array(g.rectangle(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))))
    both = catalog.grid_join(boxed(tiles).withColumnRenamed("rings", "tile"), boxed(counties), 4.0)
    return both.where(g.intersects(F.col("tile"), F.col("rings"))).select("gid", "geoid")


@query(_sql("select gid, filename from catalogue where xmin <= 20.4 + 1.5 and xmax >= 20.4 - 1.5 and ymin <= 11.2 + 1.5 and ymax >= 11.2 - 1.5", "catalogue"))
def point_expand_tiles(spark, sf_dir):
    return ad.catalogue(spark, sf_dir).where(catalog.in_box((20.4 - 1.5, 11.2 - 1.5, 20.4 + 1.5, 11.2 + 1.5))).select("gid", "filename")


@query(_sql("select gid, filename from catalogue where xmin <= 21.9 and xmax >= 18.9 and ymin <= 12.7 and ymax >= 9.7 and greatest(18.9 - xmin, 0) + greatest(9.7 - ymin, 0) <= 1", "catalogue"))
def point_expand_polygon(spark, sf_dir):
    """Tiles whose outline is the lower left half of their box, around a place: some boxes reach it where the tile doesn't."""
    at = lambda x, y: g.point(F.col(x), F.col(y))
    tiles = ad.catalogue(spark, sf_dir).withColumn("rings", F.array(F.array(at("xmin", "ymin"), at("xmax", "ymin"), at("xmin", "ymax"), at("xmin", "ymin"))))
    # 1.5 degrees on every side of (20.4, 11.2).
    pixels = 2 * (1.5 / commands.DEGREES_PER_PIXEL - 100)
    return commands.tiles_around(tiles, 11.2, 20.4, pixels).select("gid", "filename")


@query(
    _sql(
        """select gid, geoid from catalogue c join regions r on c.xmin <= r.xmax and c.xmax >= r.xmin and c.ymin <= r.ymax and c.ymax >= r.ymin
        where (greatest(c.xmin, r.xmin) - r.xmin) / (r.xmax - r.xmin) + (greatest(c.ymin, r.ymin) - r.ymin) / (r.ymax - r.ymin) <= 1""",
        "catalogue", "regions",
    )
)
def spatial_join_edges(spark, sf_dir):
    """All tiles with all counties, triangles here, by the edges in shared cells."""
    at = lambda x, y: g.point(F.col(x), F.col(y))
    counties = ad.regions(spark, sf_dir).withColumn("rings", F.array(F.array(at("xmin", "ymin"), at("xmax", "ymin"), at("xmin", "ymax"), at("xmin", "ymin"))))
    tiles = ad.catalogue(spark, sf_dir)
    return overlay.shared(tiles.select("gid", overlay.outline_of(tiles).alias("rings")), counties.select("geoid", "rings"), "gid", "geoid", 0.75)


@query(_sql("select segment, line, area, perim from shapes", "rects"))
def polygon_area_perim(spark, sf_dir):
    return ad.segments(spark, sf_dir).select("segment", "line", g.area(F.col("rings")).alias("area"), g.perimeter(F.col("rings")).alias("perim"))


@query(_sql("select segment, line, " + ", ".join(f"round({m}, 6) {m}" for m in METRICS) + " from (select segment, line, " + _METRICS + " from shapes)", "rects"))
def polygon_metrics(spark, sf_dir):
    return with_metrics(ad.segments(spark, sf_dir)).select("segment", "line", *_rounded(METRICS))


@query(
    _sql(
        """select segment, line, round((metre * w * r * ln(tan(pi() / 4 + radians(h) / 2)) - hole * metre * r * (ln(tan(pi() / 4 + radians(2.0) / 2)) - ln(tan(pi() / 4 + radians(1.0) / 2)))) / 1e6, 3) km2
        from rects, (select 6378137.0::double r, 6378137.0::double * pi() / 180 metre)""",
        "rects",
    )
)
def mercator_area(spark, sf_dir):
    return ad.segments(spark, sf_dir).select("segment", "line", F.round(areas("EPSG:4326")(F.col("rings")) / 1e6, 3).alias("km2"))


#: The least circle of a set is the greatest of its triples' least circles; of an obtuse triple that is its longest side's.
_CIRCLES = """p as (select distinct user_id grp, round((user_id + event_id % 97)::double, 6) x, round(value, 6) y from events),
    t as (select a.grp, a.x ax, a.y ay, b.x bx, b.y by_, c.x cx, c.y cy, (b.x - a.x) ^ 2 + (b.y - a.y) ^ 2 ab, (c.x - a.x) ^ 2 + (c.y - a.y) ^ 2 ac, (c.x - b.x) ^ 2 + (c.y - b.y) ^ 2 bc
        from p a join p b on a.grp = b.grp and (a.x, a.y) <= (b.x, b.y) join p c on a.grp = c.grp and (b.x, b.y) <= (c.x, c.y)),
    d as (select *, 2 * ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) d, greatest(ab, ac, bc) far from t),
    o as (select grp, case when 2 * far >= ab + ac + bc then case far when ab then (ax + bx) / 2 when ac then (ax + cx) / 2 else (bx + cx) / 2 end else ax + ((cy - ay) * ab - (by_ - ay) * ac) / d end cx,
        case when 2 * far >= ab + ac + bc then case far when ab then (ay + by_) / 2 when ac then (ay + cy) / 2 else (by_ + cy) / 2 end else ay + ((bx - ax) * ac - (cx - ax) * ab) / d end cy,
        case when 2 * far >= ab + ac + bc then sqrt(far) / 2 else sqrt(ab) * sqrt(ac) * sqrt(bc) / abs(d) end r from d)"""


@query(_sql("select grp, round(arg_max(cx, r), 6) cx, round(arg_max(cy, r), 6) cy, round(max(r), 6) r from o group by grp", _CIRCLES))
def min_bounding_circle(spark, sf_dir):
    return group_circles(ad.points(spark, sf_dir), "grp").select("grp", *_rounded(["cx", "cy", "r"]))


@query(
    _sql(
        """select a.grp, a.x, a.y from p a where not exists (
            select 1 from p b join p c on b.grp = c.grp where b.grp = a.grp and (b.x, b.y) <> (a.x, a.y) and (c.x, c.y) <> (a.x, a.y) and (b.x, b.y) < (c.x, c.y)
            and (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) and (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) <= 0)
        and exists (select 1 from p b where b.grp = a.grp and (b.x, b.y) <> (a.x, a.y) and not exists (
            select 1 from p c where c.grp = a.grp and (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))""",
        "p as (select distinct l_orderkey // 8 grp, l_linenumber::double x, l_quantity y from lineitem)",
    )
)
def convex_hulls(spark, sf_dir):
    """The corners of each group's hull; points on its sides aren't corners."""
    points = ad._read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("grp"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y"))
    return points.groupBy("grp").agg(convex_hull(F.collect_set(g.point("x", "y"))).alias("h")).select("grp", F.inline("h"))


@query(_sql("select band, min(dn)::int min_dn, max(dn)::int max_dn, round(avg(dn), 6) avg_dn, round(stddev_pop(dn), 6) std_dn from pixels group by 1", "pixels"))
def band_stats(spark, sf_dir):
    return raster.band_stats(ad.pixels(spark, sf_dir)).select("band", "min_dn", "max_dn", *_rounded(["avg_dn", "std_dn"]))


@query(_sql("select case band when 4 then 3 else band end::int band, y, x, case when alpha > 125 then dn end::int dn from (select *, max(dn) filter (band = 3) over (partition by y, x) alpha from pixels) where band <> 3", "pixels"))
def band_remap_mask(spark, sf_dir):
    pixels = ad.pixels(spark, sf_dir)
    alpha = pixels.withColumn("dn", F.when((F.col("band") == 3) & (F.col("dn") <= 125), 0).otherwise(F.col("dn")))
    return raster.select_bands(raster.masked(alpha, 3), [0, 1, 2, 4])


@query(_sql("select band, factor, (y // factor)::int y, (x // factor)::int x, avg(dn) avg_dn from pixels, (select unnest([2, 4, 8, 16, 32, 64, 128]) factor) group by all", "pixels"))
def overview_avg(spark, sf_dir):
    return raster.overviews(ad.pixels(spark, sf_dir))


_LAGS = tuple(range(2, 64, 2))
_SV = (
    _SIZE,
    """sums as (select p.band, lag, sum((d.dn - p.dn) * (d.dn - p.dn))::bigint s_row, sum((r.dn - p.dn) * (r.dn - p.dn))::bigint s_col
    from pixels p, (select unnest(range(2, 64, 2)) lag) l join pixels d on d.band = p.band and d.x = p.x and d.y = p.y + lag join pixels r on r.band = p.band and r.y = p.y and r.x = p.x + lag group by 1, 2),
    sv as (select band, lag::int lag, s_row::double / (2 * (w - lag) * (h - lag)) sv_row, s_col::double / (2 * (w - lag) * (h - lag)) sv_col, (s_row + s_col)::double / (4 * (w - lag) * (h - lag)) sv_avg from sums join size using (band) where lag < w and lag < h)""",
)


@query(_sql("select * from sv", "pixels", *_SV))
def semivariogram(spark, sf_dir):
    return params.semivariogram(ad.pixels(spark, sf_dir), _LAGS)


_HS = "steps as (select band, lag, sv_avg - lag(sv_avg) over (partition by band order by lag) d from sv), hs as (select band, coalesce(min(lag) filter (d <= 0), arg_min(lag, d)) hs from steps where d is not null group by 1)"


@query(_sql("select band, hs from hs", "pixels", *_SV, _HS))
def optimal_hs(spark, sf_dir):
    return params.optimal_hs(ad.pixels(spark, sf_dir), _LAGS)


def _lv(window: str) -> str:
    """Local variance straight from the definition: every pixel of every reflected window."""
    return f"""win as ({window}), tall as (select band, y, x, dn from pixels union all select band, -y - 1, x, dn from pixels, win where y < n // 2
        union all select band, 2 * h - 1 - y, x, dn from pixels join size using (band), win where y >= h - (n - n // 2 - 1)),
        wide as (select band, y, x, dn from tall union all select band, y, -x - 1, dn from tall, win where x < n // 2
        union all select t.band, y, 2 * w - 1 - x, dn from tall t join size using (band), win where x >= w - (n - n // 2 - 1)),
        k as (select unnest(range(0, n)) - n // 2 o, n from win),
        cols as (select wide.band, y - o y, x, sum(dn) s1, sum(dn * dn) s2, count(*) c1 from wide, k group by all),
        lv as (select p.band, p.y, p.x, ((sum(c.c1) * sum(c.s2) - sum(c.s1) * sum(c.s1))::double / (sum(c.c1) * sum(c.c1))) lv from pixels p, k join cols c on c.band = p.band and c.y = p.y and c.x = p.x + o group by p.band, p.y, p.x, n),
        hr as (select band, sqrt(avg(lv)) hr from lv group by 1)"""


@query(_sql("select band, y, x, round(lv, 6) lv from lv", "pixels", _SIZE, _lv("select 8 n")))
def local_variance(spark, sf_dir):
    return params.local_variance(ad.pixels(spark, sf_dir), 8).withColumn("lv", F.round("lv", 6))


@query(_sql("select band, round(hr, 6) hr from hr", "pixels", _SIZE, _lv("select 8 n")))
def optimal_hr(spark, sf_dir):
    return params.optimal_hr(ad.pixels(spark, sf_dir), 8).withColumn("hr", F.round("hr", 6))


@query(
    _sql(
        "select band, round(sqrt(greatest(avg(lv), 0)), 6) hr from ints group by 1", "pixels", _SIZE, _lv("select 7 n"),
        "lines as (select wide.band, y - o y, x, sum(dn) // 7 s1, sum(dn * dn) // 7 s2 from wide, k group by all)",
        "ints as (select p.band, p.y, p.x, sum(c.s2) // 7 - (sum(c.s1) // 7) * (sum(c.s1) // 7) lv from pixels p, k join lines c on c.band = p.band and c.y = p.y and c.x = p.x + o group by p.band, p.y, p.x)",
    )
)
def optimal_hr_int(spark, sf_dir):
    """The range radius with both passes of the moving mean truncated to integers."""
    return params.optimal_hr(ad.pixels(spark, sf_dir), 7, "int").withColumn("hr", F.round("hr", 6))


@query(
    _sql(
        """select hs_min, hs_max, hs_avg, round(min(hr))::int hr_min, round(max(hr))::int hr_max, round(avg(hr))::int hr_avg, (hs_min * hs_min // 4)::int m_min, (hs_max * hs_max // 4)::int m_max, (hs_avg * hs_avg // 4)::int m_avg
        from hr, (select min(hs)::int hs_min, max(hs)::int hs_max, (sum(hs) // count(*))::int hs_avg from hs) group by all""",
        "pixels", *_SV, _HS, _lv("select (sum(hs) // count(*))::bigint n from hs"),
    )
)
def optimal_params(spark, sf_dir):
    return params.optimal_parameters(ad.pixels(spark, sf_dir), lags=_LAGS)


@query(_sql("select 0 band, y, x, arg_max(dn, image)::int dn from (select band image, y, (x + 40 * band)::int x, dn from pixels) group by y, x", "pixels"))
def mosaic_latest_wins(spark, sf_dir):
    """Each band as an image of its own, 40 pixels farther right than the one before; later ones win."""
    images = ad.pixels(spark, sf_dir).select(F.col("band").alias("image"), F.lit(0).alias("band"), "y", "x", "dn")
    places = spark.range(5).select(F.col("id").cast("int").alias("image"), (F.col("id") * 40).cast("int").alias("dx"), F.lit(0).alias("dy"), F.col("id").alias("priority"))
    return raster.mosaic(images, F.broadcast(places))


@query(_sql("select 0 image, band, y, x, dn::int dn from pixels where (y * 7 + x * 3) % 11 <> 0", "pixels"))
def tile_table_round_trip(spark, sf_dir):
    """An image with holes written as a table of tiles and read back."""
    images = ad.pixels(spark, sf_dir).where("(y * 7 + x * 3) % 11 <> 0").withColumn("image", F.lit(0))
    return raster.from_tiles(tables.write_images(images, new_path(spark, "tiles"), 48))


@query(
    _sql(
        """select case band when 3 then 4 else band end::int band, oy::int y, ox::int x, dn::int dn from hit union all select 3, oy::int, ox::int, 255 from hit group by ox, oy""",
        "pixels",
        """hit as (select ox, oy, band, dn from (select unnest(range(90)) ox), (select unnest(range(70)) oy) join pixels on band < 4
        and x = floor((10.0::double + (ox + 0.5) * 0.75 - 10.5) / 1.0) and y = floor((50.0::double + (oy + 0.5) * -0.75 - 49.5) / -1.0))""",
    )
)
def normalise_tile(spark, sf_dir):
    """A delivered tile warped onto a finer grid that reaches over its edges, with bands and mask as processed."""
    delivered = ad.pixels(spark, sf_dir).where("band < 4")
    return raster.normalise(delivered, 90, 70, (10.0, 0.75, 50.0, -0.75), (10.5, 1.0, 49.5, -1.0))


@query(_sql("select band image, (max(x) + 1)::int width, (max(y) + 1)::int height, '0' bands, 'byte' kind, (100.0 + 10 * band)::double x0, 'EPSG:4326' srs from pixels group by band", "pixels"))
def raster_metadata(spark, sf_dir):
    images = ad.pixels(spark, sf_dir).withColumn("image", F.col("band")).withColumn("band", F.lit(0))
    grids = spark.range(5).select(F.col("id").cast("int").alias("image"), (100.0 + 10 * F.col("id")).alias("x0"), F.lit(1.0).alias("dx"), F.lit(9.0).alias("y0"), F.lit(-1.0).alias("dy"), F.lit("EPSG:4326").alias("srs"))
    found = raster.metadata(images, grids)
    return found.select("image", "width", "height", F.array_join(F.col("bands").cast("array<string>"), ",").alias("bands"), "kind", "x0", "srs")


@query(
    _sql(
        """select band, (y - 3)::int y, (x - 25)::int x, arg_max(dn, image)::int dn from (select (band // 2)::int image, (band % 2)::int band, y + 2 * (band // 2) y, x + 30 * (band // 2) x, dn from pixels where band < 4 and (y * 7 + x * 3) % 11 <> 0 and dn % 3 <> 0)
        where y between 3 and 11 and x between 25 and 84 group by band, y, x""",
        "pixels",
    )
)
def mosaic_window(spark, sf_dir):
    """A window over two images of two bands that overlap, with holes and masked pixels, read from the mosaic's index."""
    image, dn = F.floor(F.col("band") / 2).cast("int"), F.when(F.col("dn") % 3 != 0, F.col("dn"))
    images = _holed(spark, sf_dir).where("band < 4").select(image.alias("image"), (F.col("band") % 2).alias("band"), "y", "x", dn.alias("dn"))
    places = spark.range(2).select(F.col("id").cast("int").alias("image"), (F.col("id") * 30).cast("int").alias("dx"), (F.col("id") * 2).cast("int").alias("dy"), F.col("id").alias("priority"))
    index = virtual.write_index(raster.to_tiles(images, 16), F.broadcast(places), new_path(spark, "mosaic"))
    return virtual.window(index, 25, 3, 60, 9)


#: Krueger's series for the metres east of the central meridian and north of the equator, from lon and lat and the zone; in SQL of its own.
_ELLIPSOID = """ell as (select n, 2 * sqrt(n) / (1 + n) e, 0.9996 * 6378137.0::double / (1 + n) * (1 + n * n / 4 + n ** 4 / 64) r,
    n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 a2, 61 * n ** 3 / 240 - 103 * n ** 4 / 140 a3, 49561 * n ** 4 / 161280 a4
    from (select 1 / (2 * 298.257222101::double - 1) n))"""
_UTM = """select g.*, 500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)) east,
    r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)) north
    from (select g.*, atan2(t, cos(l)) xi, atanh(sin(l) / sqrt(1 + t * t)) eta, r, a1, a2, a3, a4
        from (select g.*, radians(lon - (zone * 6 - 183)) l, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) t, r, a1, a2, a3, a4 from {source} g, ell) g) g"""


@query(_sql("select gid, zone::int zone, round(east, 3) east, round(north, 3) north, round(lon, 8) lon, round(lat, 8) lat from utm", "catalogue", _ELLIPSOID, "places as (select gid, 10 + gid % 10 zone, (10 + gid % 10) * 6 - 183 + (gid % 61 - 30) * 0.1::double lon, (gid % 797) * 0.1::double lat from catalogue)", f"utm as ({_UTM.format(source='places')})"))
def utm_round_trip(spark, sf_dir):
    """Degrees to each row's UTM zone, to a millimetre, and back, to one too."""
    zone = 10 + F.col("gid") % 10
    places = ad.catalogue(spark, sf_dir).select("gid", zone.cast("int").alias("zone"), (zone * 6 - 183 + (F.col("gid") % 61 - 30) * 0.1).alias("lon"), (F.col("gid") % 797 * 0.1).alias("lat"))
    to = utm(F.col("zone"))
    east, north = forward(F.col("lon"), F.col("lat"), to)
    lon, lat = inverse(F.col("e"), F.col("n"), to)
    back = places.select("gid", "zone", east.alias("e"), north.alias("n")).select("gid", "zone", F.round("e", 3).alias("east"), F.round("n", 3).alias("north"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))
    return back


@query(
    _sql(
        """select case band when 3 then 4 else band end::int band, oy::int y, ox::int x, dn::int dn from hit union all select 3, oy::int, ox::int, 255 from hit group by ox, oy""",
        "pixels", _ELLIPSOID,
        "grid as (select ox, oy, 11 zone, -117.0005::double + (ox + 0.5) * 0.0001 lon, 33.4405::double - (oy + 0.5) * 0.0001 lat from (select unnest(range(90)) ox), (select unnest(range(60)) oy))",
        f"utm as ({_UTM.format(source='grid')})",
        "hit as (select ox, oy, band, dn from utm join pixels on band < 4 and x = floor((east - 500000) / 10) and y = floor((north - 3700000) / -10))",
    )
)
def utm_warp(spark, sf_dir):
    """A delivered tile in UTM zone 11 warped to degrees."""
    delivered = ad.pixels(spark, sf_dir).where("band < 4")
    return raster.normalise(delivered, 90, 60, (-117.0005, 0.0001, 33.4405, -0.0001), (500000.0, 10.0, 3700000.0, -10.0), lambda lon, lat: forward(lon, lat, utm(11)))


def _strips(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The first four bands cut into images of twenty rows, in three UTM zones, and the grids that they go onto."""
    images = ad.pixels(spark, sf_dir).where("band < 4").select(F.floor(F.col("y") / 20).cast("int").alias("image"), "band", (F.col("y") % 20).alias("y"), "x", "dn")
    zone = 10 + F.col("image") % 3
    grids = images.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).select(
        "image", "width", "height", (500000.0 + 1000 * F.col("image")).alias("x0"), F.lit(10.0).alias("dx"), F.lit(3700000.0).alias("y0"), F.lit(-10.0).alias("dy"),
        F.format_string("EPSG:269%d", zone).alias("srs"), (zone * 6 - 183 + F.col("image") * 0.0107 - 0.0005).alias("ox0"), F.lit(0.0001).alias("odx"), F.lit(33.4405).alias("oy0"), F.lit(-0.0001).alias("ody"), F.lit(90).alias("ow"), F.lit(40).alias("oh"),
    )
    return images, grids


_STRIPS = (
    "pixels", _ELLIPSOID,
    "strips as (select (y // 20)::int image, band, (y % 20)::int y, x, dn from pixels where band < 4)",
    "grid as (select image, ox, oy, 10 + image % 3 zone, (10 + image % 3) * 6 - 183 + image * 0.0107::double - 0.0005::double + (ox + 0.5) * 0.0001::double lon, 33.4405::double + (oy + 0.5) * -0.0001::double lat from (select distinct image from strips), (select unnest(range(90)) ox), (select unnest(range(40)) oy))",
    f"utm as ({_UTM.format(source='grid')})",
    "hit as (select u.image, ox, oy, band, dn from utm u join strips s on s.image = u.image and s.x = floor((east - (500000 + 1000 * u.image)) / 10) and s.y = floor((north - 3700000) / -10))",
    "processed as (select image, case band when 3 then 4 else band end band, oy y, ox x, dn from hit union all select image, 3, oy, ox, 255 from hit group by image, ox, oy)",
)


@query(_sql("select image, band::int band, y::int y, x::int x, dn::int dn from processed", *_STRIPS))
def normalise_all(spark, sf_dir):
    """All images normalised in one plan, written as a table of tiles and read back."""
    images, grids = _strips(spark, sf_dir)
    return raster.from_tiles(commands.normalise_images(images, grids, new_path(spark, "tiles"), 32, (2, 4, 8, 16, 32))[0])


@query(_sql("select image, band::int band, factor::int factor, (y // factor)::int y, (x // factor)::int x, round(avg(dn), 6) avg_dn from processed, (select unnest([2, 4, 8, 16, 32]) factor) group by all", *_STRIPS))
def normalise_pyramid(spark, sf_dir):
    """The overviews that are written beside those tiles."""
    images, grids = _strips(spark, sf_dir)
    levels = commands.normalise_images(images, grids, new_path(spark, "tiles"), 32, (2, 4, 8, 16, 32))[1]
    each = levels.select("image", "band", "factor", "ty", "tx", "w", F.posexplode("data").alias("i", "v")).where("v is not null")
    at = lambda t, i: (F.col(t) * F.floor(F.lit(32) / F.col("factor")) + i).cast("int")
    return each.select("image", "band", "factor", at("ty", F.floor(F.col("i") / F.col("w"))).alias("y"), at("tx", F.col("i") % F.col("w")).alias("x"), F.round("v", 6).alias("avg_dn"))


#: Labels by recursion that keeps one row for each pixel and hands smaller labels on.
_LABELS = """places as (select band, y, x, dn, dn // 16 class, band::bigint * 1000000000000 + y * 1000000 + x id from pixels),
    edges as (select a.id, b.id other from places a join places b on a.band = b.band and a.class = b.class and ((b.y = a.y and b.x in (a.x - 1, a.x + 1)) or (b.x = a.x and b.y in (a.y - 1, a.y + 1)))),
    cc(id, label) using key (id) as (select id, id from places union select e.other, min(cc.label) from cc join edges e on e.id = cc.id join recurring.cc old on old.id = e.other where cc.label < old.label group by e.other),
    labels as (select band, y, x, dn, class, (label % 1000000000000 // 1000000) * 2147483648 + label % 1000000 label from places join cc using (id))"""


@query(_sql("select band, y, x, class::int class, label::bigint label from labels", "pixels", _LABELS, recursive=True))
def connected_components(spark, sf_dir):
    return segment.connected_labels(ad.pixels(spark, sf_dir), 16, tile=32)


@query(_sql("select band, label::bigint label, count(*) nbpixels, round(avg(dn), 6) mean_dn, round(var_pop(dn), 6) var_dn from labels group by 1, 2", "pixels", _LABELS, recursive=True))
def zonal_stats(spark, sf_dir):
    found = segment.zonal_stats(connected_components(spark, sf_dir), ad.pixels(spark, sf_dir))
    return found.select("band", "label", "nbpixels", *_rounded(["mean_dn", "var_dn"]))


@query(_sql("select band, label::bigint label, count(*)::double area from labels group by 1, 2", "pixels", _LABELS, recursive=True))
def vectorize_area_conservation(spark, sf_dir):
    return segment.vectorise(connected_components(spark, sf_dir)).select("band", "label", g.area(F.col("rings")).alias("area"))


#: Where the images with holes have none: one place in eleven.
_HOLE = "(y * 7 + x * 3) % 11 = 0"
_HOLED = f"pixels as (select * from all_pixels where not ({_HOLE}))"
_ALL = _CTE["pixels"].replace("pixels as", "all_pixels as", 1)


def _holed(spark, sf_dir) -> DataFrame:
    return ad.pixels(spark, sf_dir).where(f"not ({_HOLE})")


@query(
    _sql(
        """select p.band, lag::int lag, sum((d.dn - p.dn) * (d.dn - p.dn))::double / (2 * count(*)) sv_row, sum((r.dn - p.dn) * (r.dn - p.dn))::double / (2 * count(*)) sv_col,
        (sum((d.dn - p.dn) * (d.dn - p.dn)) + sum((r.dn - p.dn) * (r.dn - p.dn)))::double / (4 * count(*)) sv_avg
        from pixels p, (select unnest(range(1, 12)) lag) l join pixels d on d.band = p.band and d.x = p.x and d.y = p.y + lag join pixels r on r.band = p.band and r.y = p.y and r.x = p.x + lag group by 1, 2""",
        _ALL, _HOLED,
    )
)
def semivariogram_gaps(spark, sf_dir):
    """The semivariogram of bands with holes, at odd lags too."""
    return params.semivariogram(_holed(spark, sf_dir), tuple(range(1, 12)))


@query(
    _sql(
        """select l.band, l.label::bigint label, (count(*) / 4)::double area, count_if(n.label is null or n.label <> l.label)::double perim
        from labels l cross join (select unnest([1, -1, 0, 0]) dy, unnest([0, 0, 1, -1]) dx) left join labels n on n.band = l.band and n.y = l.y + dy and n.x = l.x + dx group by 1, 2""",
        _ALL, _HOLED, _LABELS, recursive=True,
    )
)
def vectorise_gaps(spark, sf_dir):
    """Polygons of an image with holes: each hole is outside, and its sides are theirs."""
    found = segment.vectorise(segment.connected_labels(_holed(spark, sf_dir), 16, tile=32))
    return found.select("band", "label", g.area(F.col("rings")).alias("area"), g.perimeter(F.col("rings")).alias("perim"))


@query(_sql("select band, y, x, round(lv, 6) lv from lv", _ALL, _HOLED, _SIZE, _lv("select 9 n")))
def local_variance_gaps(spark, sf_dir):
    """Windows over bands with holes count the pixels that are there."""
    return params.local_variance(_holed(spark, sf_dir), 9, tile=32).withColumn("lv", F.round("lv", 6))


_SV_GAPS = (
    """sums as (select p.band, lag::int lag, sum((d.dn - p.dn) * (d.dn - p.dn)) sd, sum((r.dn - p.dn) * (r.dn - p.dn)) sr, count(*) n
    from pixels p, (select unnest(range(2, 64, 2)) lag) l join pixels d on d.band = p.band and d.x = p.x and d.y = p.y + lag join pixels r on r.band = p.band and r.y = p.y and r.x = p.x + lag group by 1, 2),
    sv as (select band, lag, (sd + sr)::double / (4 * n) sv_avg from sums)""",
)


@query(
    _sql(
        """select hs_min, hs_max, hs_avg, round(min(hr))::int hr_min, round(max(hr))::int hr_max, round(avg(hr))::int hr_avg, (hs_min * hs_min // 2)::int m_min, (hs_max * hs_max // 2)::int m_max, (hs_avg * hs_avg // 2)::int m_avg
        from hr, (select min(hs)::int hs_min, max(hs)::int hs_max, (sum(hs) // count(*))::int hs_avg from hs) group by all""",
        _ALL, _HOLED, _SIZE, *_SV_GAPS, _HS, _lv("select (sum(hs) // count(*))::bigint n from hs"),
    )
)
def optimal_params_gaps(spark, sf_dir):
    """The nine parameters of bands with holes, for square windows."""
    return params.optimal_parameters(_holed(spark, sf_dir), True, _LAGS)


@query(_sql(f"select 0 band, y, x, arg_max(dn, image)::int dn from (select band image, y, (x + 40 * band)::int x, dn from all_pixels where not ({_HOLE}) and dn % 3 <> 0) group by y, x", _ALL))
def mosaic_masked(spark, sf_dir):
    """Images that overlap, with holes and masked pixels: there the next image shows through."""
    dn = F.when(F.col("dn") % 3 != 0, F.col("dn"))
    images = _holed(spark, sf_dir).select(F.col("band").alias("image"), F.lit(0).alias("band"), "y", "x", dn.alias("dn"))
    places = spark.range(5).select(F.col("id").cast("int").alias("image"), (F.col("id") * 40).cast("int").alias("dx"), F.lit(0).alias("dy"), F.col("id").alias("priority"))
    return raster.mosaic(images, F.broadcast(places))


_BANDS = range(1, 6)
_SPATIAL, _SPECTRAL, _ROUNDS, _LEAST = 2, 30.0, 4, 4
_square = lambda a, b: " + ".join(f"({a}[{k}] - {b}[{k}]) * ({a}[{k}] - {b}[{k}])" for k in _BANDS)


def _mean_shift_sql() -> str:
    """smooth (id, y, x, c, my, mx): every pixel's way to its mode, a round at a time."""
    means = ", ".join(f"sum(o.c[{k}]) / count(o.c)" for k in _BANDS)
    return f"""colours as (select y, x, list(dn order by band)::double[] c from pixels group by y, x having count(*) = 5),
    reach as (select a, b from (select unnest(range(-{_SPATIAL}, {_SPATIAL} + 1)) a), (select unnest(range(-{_SPATIAL}, {_SPATIAL} + 1)) b) where a * a + b * b <= {_SPATIAL * _SPATIAL}),
    way as (select 0 i, y, x, c, y::double my, x::double mx, true moving from colours
        union all
        select i + 1, y, x, case when found then nc else c end, case when found then ny else my end, case when found then nx else mx end,
            found and sqrt({_square("nc", "c")} + (ny - my) * (ny - my) + (nx - mx) * (nx - mx)) > 0.1
        from (
            select w.i, w.y, w.x, w.c, w.my, w.mx, w.moving and count(o.c) > 0 found, [{means}] nc, sum(o.y)::double / count(o.c) ny, sum(o.x)::double / count(o.c) nx
            from way w cross join reach left join colours o on w.moving and o.y = round_even(w.my, 0)::int + a and o.x = round_even(w.mx, 0)::int + b and {_square("o.c", "w.c")} <= {_SPECTRAL * _SPECTRAL}
            where w.i < {_ROUNDS} group by w.i, w.y, w.x, w.c, w.my, w.mx, w.moving
        )),
    smooth as materialized (select y * 1000000 + x id, y, x, c, my, mx from way where i = {_ROUNDS})"""


_LINKED = f"""near as (select a.id, b.id other from smooth a join smooth b on b.id = a.id + 1 or b.id = a.id + 1000000
        where {_square("a.c", "b.c")} < {_SPECTRAL * _SPECTRAL} and (a.my - b.my) * (a.my - b.my) + (a.mx - b.mx) * (a.mx - b.mx) < {_SPATIAL * _SPATIAL}),
    links as (select * from near union all select other, id from near),
    cc0(id, label) using key (id) as (select id, id from smooth union select e.other, min(cc0.label) from cc0 join links e on e.id = cc0.id join recurring.cc0 old on old.id = e.other where cc0.label < old.label group by e.other),
    lab1 as materialized (select id, label from cc0)"""


def _merge_sql(least: int, bands: int) -> str:
    """lab1 to lab<least>: regions of 1, 2, ... pixels join the neighbour of nearest mean; cells has (id, c)."""
    apart = " + ".join(f"(a.s{k} / a.n - b.s{k} / b.n) * (a.s{k} / a.n - b.s{k} / b.n)" for k in range(1, bands + 1))
    return ",\n".join(
        f"""reg{i} as materialized (select label, count(*) n, {", ".join(f"sum(c[{k}]) s{k}" for k in range(1, bands + 1))} from lab{i} join cells using (id) group by label),
        side{i} as (select distinct a.label, b.label other from lab{i} a join lab{i} b on b.id = a.id + 1 where a.label <> b.label union select a.label, b.label from lab{i} a join lab{i} b on b.id = a.id + 1000000 where a.label <> b.label),
        pick{i} as (select a.label, b.label other from (select * from side{i} union select other, label from side{i}) s join reg{i} a on a.label = s.label and a.n = {i} join reg{i} b on b.label = s.other
            qualify row_number() over (partition by a.label order by round({apart}, 6), b.label) = 1),
        ends{i} as materialized (select label x, other y from pick{i} union select other, label from pick{i}),
        cc{i}(id, label) using key (id) as (select distinct x, x from ends{i} union select e.y, min(cc{i}.label) from cc{i} join ends{i} e on e.x = cc{i}.id join recurring.cc{i} old on old.id = e.y where cc{i}.label < old.label group by e.y),
        lab{i + 1} as materialized (select l.id, coalesce(cc{i}.label, l.label) label from lab{i} l left join cc{i} on cc{i}.id = l.label)"""
        for i in range(1, least)
    )


def _segments_sql(labels: str) -> str:
    # Sums differ in their last bits by their order; the nudge keeps exact halves from being rounded either way.
    stats = ", ".join(f"round(avg(c[{k}]) + 1e-9, 6) meanb{k - 1}, round(var_pop(c[{k}]) + 1e-9, 6) varb{k - 1}" for k in _BANDS)
    return f"""select ((label // 1000000) * 2147483648 + label % 1000000)::bigint label, nbpixels, {", ".join(f"meanb{k - 1}, varb{k - 1}" for k in _BANDS)}, area, perim, round(perim / area, 6) para, round(4 * pi() * area / (perim * perim), 6) compact2,
        round(0.25 * perim / sqrt(area), 6) shape, round(case when area <= 1 or perim / 4 < 1 then 1.0 else 2 * ln(perim / 4) / ln(area) end, 6) frac
        from (select label, count(*) nbpixels, count(*)::double area, {stats} from {labels} join smooth using (id) group by label)
        join (select l.label, count_if(n.label is null or n.label <> l.label)::double perim from {labels} l cross join (select unnest([1, -1, 1000000, -1000000]) d) left join {labels} n on n.id = l.id + d group by 1) using (label)"""


_SEGMENT_COLUMNS = ["label", "nbpixels", *[f"{m}b{k}" for k in range(5) for m in ("mean", "var")], "area", "perim", "para", "compact2", "shape", "frac"]


def _segments(spark, sf_dir, delete: bool) -> DataFrame:
    found = segment.segment(_holed(spark, sf_dir), _SPATIAL, _SPECTRAL, _LEAST, delete, _ROUNDS, tile=32)
    rounded = lambda c: F.round(F.col(c) + 1e-9 if c[:4] in ("mean", "varb") else F.col(c), 6).alias(c)
    return found.select(*[c if c in ("label", "nbpixels", "area", "perim") else rounded(c) for c in _SEGMENT_COLUMNS])


@query(_sql("select y, x, k::int band, round(c[k + 1], 6) \"value\", round(my, 6) my, round(mx, 6) mx from smooth, (select unnest(range(5)) k)", _ALL, _HOLED, _mean_shift_sql(), recursive=True))
def meanshift_smooth(spark, sf_dir):
    found = segment.mean_shift(_holed(spark, sf_dir), _SPATIAL, _SPECTRAL, _ROUNDS, tile=32)
    return found.select("y", "x", F.posexplode("colour").alias("band", "value"), *_rounded(["my", "mx"])).withColumn("value", F.round("value", 6))


@query(_sql(_segments_sql("big"), _ALL, _HOLED, _mean_shift_sql(), _LINKED, f"big as (select id, label from lab1 where label in (select label from lab1 group by label having count(*) >= {_LEAST}))", recursive=True))
def segment_delete(spark, sf_dir):
    """Segments of an image with holes: all bands together, small ones left out; statistics and the metrics that SQL can say."""
    return _segments(spark, sf_dir, True)


@query(
    _sql(
        """select ((label // 1000000) * 2147483648 + label % 1000000)::bigint label, round(area, 3) area, round(perim, 4) perim, round(perim / area, 5) para, round(4 * pi() * area / (perim * perim), 5) compact2,
        round(0.25 * perim / sqrt(area), 5) shape, round(case when area <= 1 or perim / 4 < 1 then 1.0 else 2 * ln(perim / 4) / ln(area) end, 5) frac from whole""",
        _ALL, _HOLED, _mean_shift_sql(), _LINKED, f"big as (select id, label from lab1 where label in (select label from lab1 group by label having count(*) >= {_LEAST}))",
        "high as (select id, label, 6378137.0::double * radians(0.0001::double) wide, 6378137.0::double * (ln(tan(pi() / 4 + radians(33.5 - 0.0001::double * (id // 1000000)) / 2)) - ln(tan(pi() / 4 + radians(33.5 - 0.0001::double * (id // 1000000 + 1)) / 2))) high from big)",
        "sides as (select l.label, sum(case when n.label is null or n.label <> l.label then case when abs(d) = 1 then high else wide end else 0 end) perim from high l cross join (select unnest([1, -1, 1000000, -1000000]) d) left join big n on n.id = l.id + d group by 1)",
        "whole as (select label, area, perim from (select label, sum(wide * high) area from high group by label) join sides using (label))", recursive=True,
    )
)
def segment_metrics_mercator(spark, sf_dir):
    """Segments of an image in degrees: their metrics are taken in web mercator."""
    found = segment.segment(_holed(spark, sf_dir), _SPATIAL, _SPECTRAL, _LEAST, True, _ROUNDS, tile=32, transform=(-117.0, 0.0001, 33.5, -0.0001), srs="EPSG:4326")
    return found.select("label", F.round("area", 3).alias("area"), F.round("perim", 4).alias("perim"), *_rounded(["para", "compact2", "shape", "frac"], 5))


@query(_sql(_segments_sql(f"lab{_LEAST}"), _ALL, _HOLED, _mean_shift_sql(), _LINKED, "cells as (select id, c from smooth)", _merge_sql(_LEAST, 5), recursive=True))
def segment_merge(spark, sf_dir):
    """The same with small segments merged."""
    return _segments(spark, sf_dir, False)


@query(
    _sql(
        """select (l.id // 1000000000000)::int band, (l.id // 1000000 % 1000000)::int y, (l.id % 1000000)::int x, ((label % 1000000000000 // 1000000) * 2147483648 + label % 1000000)::bigint label from lab4 l""",
        "pixels", _LABELS,
        "cells as (select id, [dn::double] c from places)", "lab1 as materialized (select id, label from cc)", _merge_sql(4, 1), recursive=True,
    )
)
def merge_small_regions(spark, sf_dir):
    """Each band's regions of fewer than four pixels merged."""
    pixels = ad.pixels(spark, sf_dir)
    return segment.merge_small(segment.connected_labels(pixels, 16), pixels, 4)


#: Strips of twenty rows as images of tiles 1, 2, ..., of which the log has some; the first of those is the mosaic's top.
_FETCHED = (
    _ALL, _CTE["catalogue"], _CTE["log"],
    f"strips as (select (y // 20 + 1)::int gid, band, y, x, dn from all_pixels where not ({_HOLE})), chosen as (select gid from catalogue semi join log using (gid) where gid <= 39 and gid in (select gid from strips))",
    "pixels as (select band, (y - 20 * ((select min(gid) from chosen) - 1))::int y, x, dn from strips semi join chosen using (gid))",
)


@query(
    _sql(
        f"""select ((label // 1000000) * 2147483648 + label % 1000000)::bigint label, count(*) nbpixels, {", ".join(f"round(avg(c[{k}]) + 1e-9, 6) meanb{k - 1}" for k in _BANDS)}, 2014 as year, 'a' job from lab1 join smooth using (id)
        group by label having count(*) >= {_LEAST}""",
        *_FETCHED, _mean_shift_sql(), _LINKED, recursive=True,
    )
)
def segment_of_area(spark, sf_dir):
    """From an area to loaded segments: its tiles that are here, their mosaic, its segments."""
    pixels = _holed(spark, sf_dir)
    images = pixels.select((F.floor(F.col("y") / 20) + 1).cast("int").alias("image"), "band", (F.col("y") % 20).alias("y"), "x", "dn")
    rasters = images.groupBy("image").agg(F.lit(64).alias("width"), F.lit(20).alias("height")).select("image", "width", "height", F.lit(-117.0).alias("x0"), F.lit(1e-4).alias("dx"), (33.5 - (F.col("image") - 1) * 20 * 1e-4).alias("y0"), F.lit(-1e-4).alias("dy"), F.lit("EPSG:4326").alias("srs"))
    tiles = ad.catalogue(spark, sf_dir).join(rasters.select(F.col("image").alias("gid")), "gid", "left_semi")
    found = commands.segment_of_area(
        images, rasters, tiles, ad.regions(spark, sf_dir), ad.fetched(spark, sf_dir), "0.5,0.2,39.5,0.8", {}, new_path(spark, "segments"), 2014, "a", new_path(spark, "index"),
        _SPATIAL, _SPECTRAL, _LEAST, True, iterations=_ROUNDS, tile=32,
    )
    return found.select("label", "nbpixels", *[F.round(F.col(f"meanb{k}") + 1e-9, 6).alias(f"meanb{k}") for k in range(5)], "year", "job")


@query(_sql("select segment, line, area, year, job from shapes, (select unnest([2014, 2015]) as year, unnest(['a', 'b']) job)", "rects"))
def segments_loaded(spark, sf_dir):
    """Two years' segments in one table, the first year's loaded twice: the second load replaces the first, the other year's stay."""
    path, rows = new_path(spark, "segments"), polygon_area_perim(spark, sf_dir).select("segment", "line", "area")
    tables.load_segments(rows.withColumn("area", F.lit(0.0)), path, 2014, "a")
    tables.load_segments(rows, path, 2015, "b")
    tables.load_segments(rows, path, 2014, "a")
    return spark.read.parquet(path)


@query(_sql("select 0 image, 0 band, (y - 5)::int y, (x - 40)::int x, arg_max(dn, image)::int dn from (select band image, y, x + 30 * band x, dn from pixels) s where s.y between 5 and 12 and s.x between 40 and 59 group by s.y, s.x", "pixels"))
def extract_place(spark, sf_dir):
    """A window around a place, cut out of the mosaic of five images and written as a table of tiles."""
    images = ad.pixels(spark, sf_dir).select(F.col("band").alias("image"), F.lit(0).alias("band"), "y", "x", "dn")
    rasters = spark.range(5).select(F.col("id").cast("int").alias("image"), (30.0 * F.col("id")).alias("x0"), F.lit(1.0).alias("dx"), F.lit(100.0).alias("y0"), F.lit(-1.0).alias("dy"), F.lit("EPSG:4326").alias("srs"))
    return raster.from_tiles(commands.extract_place(images, rasters, 90.5, 50.5, 20, 8, new_path(spark, "place")))
