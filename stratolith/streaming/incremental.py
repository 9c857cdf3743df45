"""The fetch log kept up by a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stratolith.sources import tables


def arrivals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the parquet files that come into ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def log_arrivals(stream: DataFrame, table: str, checkpoint: str, processed: bool = False) -> StreamingQuery:
    """Record the gids of a stream as fetched (or processed) until nothing new is left.

    Both kinds of update may run again without harm, so a batch that is
    repeated after a failure changes nothing.
    """
    write = tables.record_processed if processed else tables.record_fetched

    def each(batch: DataFrame, _: int) -> None:
        write(batch.sparkSession, table, batch.select("gid"))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
