"""Catalogue, log and region operators."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Area:
    """An area of interest: a kind (state, county, cousub or bbox) and its value."""

    kind: str
    value: str | tuple[float, float, float, float]


#: A number of a box as the area's text may have it, and the characters of a tile's key name.
_NUMBER = r"-?[0-9]+\.?[0-9]*"
KEY = 26
_BOX = re.compile(rf"^({_NUMBER}),({_NUMBER}),({_NUMBER}),({_NUMBER})$")


def parse_area(text: str | list | tuple, default: str = "") -> Area:
    """FIPS digits (2: state, 5: county, 10: subdivision) or "x1,y1,x2,y2"; an empty text is the default."""
    if isinstance(text, (list, tuple)):
        text = ",".join(map(str, text))
    text = text or default
    if re.fullmatch("[0-9]+", text):
        kinds = {2: "state", 5: "county", 10: "cousub"}
        if len(text) not in kinds:
            raise ValueError(f"not an area: {text}")
        return Area(kinds[len(text)], text)
    found = _BOX.match(text)
    if not found:
        raise ValueError(f"not an area: {text}")
    x1, y1, x2, y2 = map(float, found.groups())
    return Area("bbox", (min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)))


def parse_list(text: str) -> list[int]:
    """"0,1,2" as numbers; blanks around them don't count."""
    return [int(x) for x in text.split(",") if x.strip()]


def parse_flag(text: str) -> bool:
    """Any text but "0" is true."""
    return text != "0"


def in_box(box: tuple[float, float, float, float]) -> Column:
    """Closed overlap of the row's box with a constant one; reaches the scan as plain comparisons."""
    x1, y1, x2, y2 = box
    return (F.col("xmin") <= x2) & (F.col("xmax") >= x1) & (F.col("ymin") <= y2) & (F.col("ymax") >= y1)


def to_fetch(tiles: DataFrame, log: DataFrame) -> DataFrame:
    return tiles.join(log, "gid", "left_anti")


def here(tiles: DataFrame, log: DataFrame) -> DataFrame:
    return tiles.join(log, "gid", "left_semi")


def pending(tiles: DataFrame, log: DataFrame) -> DataFrame:
    return tiles.join(log.where("processed is null"), "gid", "left_semi")


def per_worker(tiles: DataFrame, workers: int, limit: int = 0) -> DataFrame:
    """Each worker's first ``limit`` tiles by gid (0: all); the worker is gid modulo their number."""
    worker = tiles.withColumn("worker", (F.col("gid") % workers).cast("int"))
    if not limit:
        return worker
    order = Window.partitionBy("worker").orderBy("gid")
    return worker.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def status(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("st").agg(F.count("*").alias("tiles")).orderBy("st")


def extent(regions: DataFrame) -> DataFrame:
    return regions.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def insert_ignore(log: DataFrame, gids: DataFrame) -> DataFrame:
    """The log with the new gids, those it has left alone."""
    new = gids.select("gid").dropDuplicates(["gid"]).join(log, "gid", "left_anti")
    return log.unionByName(new.withColumn("processed", F.lit(None).cast("boolean")))


def mark_processed(log: DataFrame, gids: DataFrame) -> DataFrame:
    done = gids.select("gid").distinct().withColumn("done", F.lit(True))
    return log.join(done, "gid", "left").select("gid", F.coalesce("done", "processed").alias("processed"))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct by key that keeps the earliest row, and so an order."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def region_lists(regions: DataFrame, box: tuple[float, float, float, float]) -> tuple[list[str], list[str]]:
    """(states, counties) that a box overlaps, in the order of the counties: as many as the country has at most."""
    found = regions.where(in_box(box)).select("statefp", "geoid")
    states = first_seen(found, "statefp", "geoid").orderBy("geoid").collect()
    return [r["statefp"] for r in states], [r["geoid"] for r in found.distinct().orderBy("geoid").collect()]


def key_name(filename: Column) -> Column:
    return F.concat(F.substring(filename, 1, 26), F.lit(".tif"))


def sub_directory(filename: Column) -> Column:
    return F.substring(filename, 3, 5)


def tile_path(root: str, filename: Column) -> Column:
    return F.concat_ws("/", F.lit(root), sub_directory(filename), key_name(filename))


def stem(path: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def find_by_name(tiles: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Tiles whose file names begin with a given file's stem: an equi-join on the first 26 characters, or on all of a shorter stem."""
    wanted = files.select(stem(F.col(path)).alias("wanted")).where("wanted <> ''").distinct().withColumn("key", F.substring("wanted", 1, KEY))
    # At most KEY numbers.
    lengths = sorted(r[0] for r in wanted.select(F.length("key")).distinct().collect())
    if lengths in ([], [KEY]):
        keyed = tiles.withColumn("key", F.substring("filename", 1, KEY))
        return keyed.join(wanted, (keyed["key"] == wanted["key"]) & keyed["filename"].startswith(wanted["wanted"]), "left_semi").drop("key")
    keyed = tiles.withColumn("key", F.explode(F.array_distinct(F.array(*[F.substring("filename", 1, n) for n in lengths]))))
    return keyed.join(wanted, "key").where(F.col("filename").startswith(F.col("wanted"))).select(*tiles.columns).dropDuplicates(["gid"])


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """min, max, mean and sample deviation of each field that exists, in one scan."""
    there = [f for f in fields if f in df.columns]
    parts = [x for f in there for x in (F.min(f).cast("double").alias(f"min_{f}"), F.max(f).cast("double").alias(f"max_{f}"), F.avg(f).alias(f"avg_{f}"), F.stddev(f).alias(f"std_{f}"))]
    rows = [F.struct(F.lit(f).alias("field"), *[F.col(f"{k}_{f}").alias(k) for k in ("min", "max", "avg", "std")]) for f in there]
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def cells_between(low: Column, high: Column, cell: float) -> Column:
    """The numbers of the grid's cells from one place to another."""
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def grid_join(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """All pairs of rows whose boxes overlap, by an equi-join on grid cells.

    A pair that shares several cells is kept in one: that of the overlap's
    lower left corner. ``a`` keeps its columns, ``b``'s boxes are dropped.
    """
    box = ("xmin", "ymin", "xmax", "ymax")

    def cells(df: DataFrame) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / cell)
        return df.withColumn("cx", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("cy", F.explode(F.sequence(at("ymin"), at("ymax"))))

    other = cells(b.select([c for c in b.columns if c not in box] + [F.col(c).alias(f"b_{c}") for c in box] + list(map(F.col, box)))).drop(*box)
    both = cells(a).join(other, ["cx", "cy"])
    overlap = (F.col("xmin") <= F.col("b_xmax")) & (F.col("xmax") >= F.col("b_xmin")) & (F.col("ymin") <= F.col("b_ymax")) & (F.col("ymax") >= F.col("b_ymin"))
    corner = (F.floor(F.greatest("xmin", "b_xmin") / cell) == F.col("cx")) & (F.floor(F.greatest("ymin", "b_ymin") / cell) == F.col("cy"))
    return both.where(overlap & corner).drop("cx", "cy", *[f"b_{c}" for c in box])
