"""The command line: ``python -m stratolith --data FOLDER COMMAND``; see ``--help`` of each command.

Everything lies under the data folder, which all executors share: the tables
``tiles``, ``county``, ``cousub`` and ``roads``, ``log``, the images as they
were delivered (``images``, ``rasters``) and normalised (``runs/*/tiled``, a folder
for each call, with the overviews beside it), and ``segments``.
"""

from __future__ import annotations

import argparse
import re
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolith import commands
from stratolith.operators import catalog, warp
from stratolith.sources import tables
from stratolith.sources.states import FIPS
from stratolith.storage import new_path

#: Lines of a report that are shown; all that is longer is written, not shown.
SHOWN = 10_000


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratolith")
    top.add_argument("--data", required=True, help="folder of all tables")
    top.add_argument("--default-area", default="", help="the area where a command is given none")
    add = top.add_subparsers(dest="command", required=True).add_parser
    new = {name: add(name) for name in ("info", "init-db", "census-fetch", "naip-fetch", "naip-process", "optimal-params", "segment", "polygon-stats", "extract-image")}

    def options(names: str, *flags: str, **kind) -> None:
        for name in names.split():
            new[name].add_argument(*flags, **kind)

    options("naip-fetch naip-process optimal-params segment polygon-stats", "-y", "--year", default="2014")
    options("census-fetch", "-y", "--year", default="2016")
    options("census-fetch naip-fetch", "--source", help="folder of the delivered packages")
    options("census-fetch naip-fetch optimal-params segment", "-a", "--area", default="", help="digits of a state, county or subdivision, or xmin,ymin,xmax,ymax")
    options("naip-fetch", "--no-shp", action="store_true", help="the catalogue is loaded already")
    options("naip-fetch", "--no-naip", action="store_true", help="no list of tiles to fetch")
    options("naip-fetch", "--all-states", action="store_true", help="the catalogue of all states")
    options("naip-fetch", "--status", action="store_true", help="tiles by state: all, and those that are here")
    options("naip-process", "-n", "--nproc", type=int, default=1, help="workers that the tiles are dealt to")
    options("naip-process", "-l", "--limit", type=int, default=0, help="tiles of each worker")
    options("naip-process", "-f", "--files", nargs="+")
    options("optimal-params extract-image", "-l", "--latlon", help="lat,lon of the middle")
    options("optimal-params", "-s", "--size", type=int, default=512)
    options("extract-image", "-s", "--size", default="512,512", help="width,height")
    options("extract-image", "--to", required=True)
    options("optimal-params", "-i", "--isboxy", default="1")
    options("segment", "-x", "--isboxy", default="1")
    options("optimal-params segment extract-image", "-b", "--bands", default="0,1,2,4")
    options("segment", "-o", "--optimal", choices=("min", "max", "avg"))
    options("segment", "-s", "--spatialr", type=int, default=16)
    options("segment", "-r", "--ranger", type=float, default=16.0)
    options("segment", "-m", "--minsize", type=int, default=100)
    options("segment", "-d", "--delete", action="store_true")
    options("segment", "-t", "--thresh", type=float, default=0.1)
    options("segment", "-i", "--max-iter", type=int, default=100)
    options("segment", "-p", "--rangeramp", type=float, default=0.0)
    options("segment", "-T", "--tilesize", type=int, default=1024)
    options("segment polygon-stats", "-j", "--job", required=True)
    return top


def _joined(argv: list[str]) -> list[str]:
    """Values that begin with a minus (western longitudes) joined to their option, as the parser takes them for options of their own."""
    words: list[str] = []
    for word in argv:
        if words and words[-1].startswith("-") and re.match(r"-[0-9.]", word):
            words[-1] += ("=" if words[-1].startswith("--") else "") + word
        else:
            words.append(word)
    return words


def run(spark: SparkSession, argv: list[str]) -> DataFrame | None:
    """What a command has to report, if anything; the rest is in the tables that it wrote. Bad arguments end with SystemExit or ValueError."""
    a = _parser().parse_args(_joined(argv))
    data, year = a.data.rstrip("/"), getattr(a, "year", "2014")
    read = lambda name: spark.read.parquet(f"{data}/{name}")
    keep = lambda df, name: df.write.mode("overwrite").parquet(f"{data}/{name}")
    if a.command == "info":
        return commands.describe_config(spark, {"data": data, "default-area": a.default_area, "checkpoint": spark.conf.get("spark.checkpoint.dir", "")})
    if a.command == "polygon-stats":
        return commands.profile_report(read("segments").where((F.col("year") == int(year)) & (F.col("job") == a.job))).select("line")
    if a.command == "extract-image":
        (lat, lon), (w, h) = map(float, (a.latlon or "").split(",")), map(int, a.size.split(","))
        commands.extract_place(read("images"), read("rasters"), lat, lon, w, h, a.to, catalog.parse_list(a.bands))
        return None

    tables.init_namespaces(spark)
    name = f"naip.fetched{int(year)}"
    spark.sql(f"drop table if exists {name}")  # The session's name for it; its files stay.
    log = tables.ensure_log(spark, name, f"{data}/log/{int(year)}")
    if a.command == "census-fetch":
        for kind, found in commands.ingest_census(spark, a.source, a.area or a.default_area, a.year).items():
            keep(found, kind)
    elif a.command == "naip-fetch":
        states = None if a.all_states else _states(a.area or a.default_area, read)
        if not a.no_shp:
            loaded = commands.load_catalogue(spark, a.source, year)
            keep(loaded if states is None else loaded.where(F.lower("st").isin(states)), "tiles")
        if a.status:
            return commands.status_report(read("tiles")).unionByName(commands.status_report(read("tiles"), log)).select("line")
        if not a.no_naip:
            return commands.plan_fetch(read("tiles"), _regions(read), log, a.area, FIPS, a.default_area).select("gid", catalog.tile_path("", F.col("filename")).alias("path"))
    elif a.command == "naip-process":
        files = spark.createDataFrame([(f,) for f in a.files], "file string") if a.files else None
        chosen = commands.plan_process(read("tiles"), log, a.nproc, a.limit, files).select(F.col("gid").cast("int").alias("image"))
        some = lambda table: read(table).join(chosen, "image", "left_semi")
        commands.normalise_images(some("images"), warp.degrees_grids(some("rasters")), f"{data}/runs/{uuid.uuid4().hex}/tiled", log=name)
    elif a.command == "optimal-params":
        lat, lon = map(float, a.latlon.split(",")) if a.latlon else (None, None)
        best = commands.optimal_parameters_of_area(
            read("images"), read("rasters"), read("tiles"), _regions(read), log, a.area, FIPS, new_path(spark, "index"), lat, lon, a.size, catalog.parse_list(a.bands), catalog.parse_flag(a.isboxy), a.default_area
        )
        return commands.parameter_report(best).select("line")
    elif a.command == "segment":
        commands.segment_of_area(
            read("images"), read("rasters"), read("tiles"), _regions(read), log, a.area, FIPS, f"{data}/segments", int(year), a.job, new_path(spark, "index"), a.spatialr, a.ranger, a.minsize, a.delete,
            catalog.parse_list(a.bands), a.optimal, iterations=a.max_iter, threshold=a.thresh, ramp=a.rangeramp, tile=a.tilesize, boxy=catalog.parse_flag(a.isboxy), default=a.default_area,
        )
    return None


def _regions(read) -> DataFrame:
    """Counties and subdivisions, as areas are named by."""
    shape = ("geoid", "geom", "xmin", "ymin", "xmax", "ymax")
    return read("county").select(*shape).unionByName(read("cousub").select(*shape))


def _states(area: str, read) -> list[str]:
    """The abbreviations of the states that an area lies in."""
    wanted = catalog.parse_area(area)
    codes = catalog.region_lists(read("county"), wanted.value)[0] if wanted.kind == "bbox" else [wanted.value[:2]]
    return [FIPS[c].lower() for c in codes]


def main(argv: list[str] | None = None) -> None:
    report = run(SparkSession.builder.appName("stratolith").getOrCreate(), sys.argv[1:] if argv is None else argv)
    for row in report.limit(SHOWN).collect() if report is not None else ():
        print(*row, sep="\t")


if __name__ == "__main__":
    main()
