"""The driver's tables as the engine's model: tiles, regions, log, segments, points, pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolith.functions import geometry as g


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _box(df: DataFrame, x0, y0, x1, y1) -> DataFrame:
    return df.withColumns({"xmin": x0.cast("double"), "ymin": y0.cast("double"), "xmax": x1.cast("double"), "ymax": y1.cast("double")})


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, st, filename and box of every tile; tiles are unit cells, fifty in a row."""
    gid = F.col("gid")
    name = F.concat(F.lit("m_"), F.lpad(gid.cast("string"), 7, "0"), F.lit("_ne_11_1_20140601_20141101.shp"))
    tiles = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gid"), F.col("p_brand").alias("st")).withColumn("filename", name)
    return _box(tiles, gid % 50, F.floor(gid / 50), gid % 50 + 1, F.floor(gid / 50) + 1)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geoid, statefp and box of every county."""
    k = F.col("k")
    named = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).withColumn("geoid", F.lpad(k.cast("string"), 5, "0")).withColumn("statefp", F.substring("geoid", 1, 2))
    return _box(named, k % 10 * 5 + 0.5, F.floor(k / 10) * 4 + 0.5, k % 10 * 5 + 2.0, F.floor(k / 10) * 4 + 3.0).drop("k")


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: gid of every tile that is here; processed is true or null."""
    rows = _read(spark, sf_dir, "lineitem").where("l_quantity = 50")
    return rows.groupBy(F.col("l_partkey").alias("gid")).agg(F.when(F.bool_or(F.col("l_linestatus") == "O"), True).alias("processed"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment, line and rings: rectangles, with a hole where both sides reach three."""
    w, h, one = F.col("l_quantity"), F.col("l_linenumber"), F.lit(1.0)
    shell = g.rectangle(F.lit(0.0), F.lit(0.0), w, h)
    hole = g.rectangle(one, one, one + 1, one + 1)
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("segment"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.when((w >= 3) & (h >= 3), F.array(shell, hole)).otherwise(F.array(shell)).alias("rings")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of points."""
    x = F.col("user_id") + F.col("event_id") % 97
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), "event_id", x.cast("double").alias("x"), F.col("value").alias("y"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """band, y, x, dn of five bands."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return rows.select(
        (F.col("vec_id") % 5).cast("int").alias("band"), F.floor(F.col("vec_id") / 5).cast("int").alias("y"), "x", F.floor((F.col("v").cast("double") + 1) * 127.5).cast("int").alias("dn")
    )
