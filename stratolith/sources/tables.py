"""Managed tables: namespaces, the fetch log, and loaded segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolith.operators import catalog, raster
from stratolith.storage import cut

#: The namespaces of the model.
NAMESPACES = ("census", "data", "segments", "training", "search", "naip")


def init_namespaces(spark: SparkSession, names: tuple[str, ...] = NAMESPACES) -> None:
    """Create what is missing; what exists stays as it is."""
    for name in names:
        spark.sql(f"create database if not exists `{name}`")


def ensure_log(spark: SparkSession, table: str, path: str | None = None) -> DataFrame:
    """The fetch log (gid, processed), created empty where there is none; at ``path`` it outlives a session without a lasting catalogue."""
    at = f" location '{path}'" if path else ""
    spark.sql(f"create table if not exists {table} (gid bigint, processed boolean) using parquet{at}")
    return spark.table(table)


def record_fetched(spark: SparkSession, table: str, gids: DataFrame) -> None:
    """Append the gids that the log lacks. Null gids are left out; repeated ones count once, and a second call adds nothing."""
    new = gids.select(F.col("gid").cast("long").alias("gid")).where("gid is not null").dropDuplicates(["gid"]).join(spark.table(table), "gid", "left_anti")
    cut(new.withColumn("processed", F.lit(None).cast("boolean")), "log").write.insertInto(table)


def record_processed(spark: SparkSession, table: str, gids: DataFrame) -> None:
    """Set processed for the gids that are in the log; the others are ignored.

    The new log is written aside in full before it replaces the old one, so a
    job that fails while computing leaves the log as it was.
    """
    cut(catalog.mark_processed(spark.table(table), gids), "log").write.insertInto(table, overwrite=True)


def load_segments(segments: DataFrame, path: str, year: int, job: str) -> DataFrame:
    """Replace one year's and job's segments in the table of files at ``path``; all others stay. Returns that part."""
    rows = segments.drop("year", "job").withColumns({"year": F.lit(year), "job": F.lit(job)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "job").parquet(path)
    return segments.sparkSession.read.parquet(path).where((F.col("year") == year) & (F.col("job") == job))


def write_images(images: DataFrame, path: str, side: int = 256) -> DataFrame:
    """Write pixels (image, band, y, x, dn) as a table of tiles at ``path``, and read it back: an image's window reads the tiles that it needs."""
    return write_tiles(raster.to_tiles(images, side), path)


def write_tiles(tiles: DataFrame, path: str) -> DataFrame:
    """Write a table of tiles at ``path`` in ranges of (image, ty, tx), so that a large image is written by many tasks, and read it back."""
    order = ["image", "ty", "tx", "band"]
    tiles.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return tiles.sparkSession.read.parquet(path)
