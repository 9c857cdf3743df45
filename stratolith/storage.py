"""Storage in the shared folder, and small table helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).

    A folder of our own is set only where the session names none and runs on
    this machine alone, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/stratolith-{what}-{uuid.uuid4().hex}"


def cut_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``cut``, with the path of what was written, for ``remove`` once nothing reads it any more."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage: a lost executor costs the running tasks only, and
    Python stages before the cut don't run twice.
    """
    return cut_at(df, what)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``cut_at`` wrote, by the store's own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, a written table, to be broadcast if it has ``most`` rows at most; joined by shuffle else."""
    return F.broadcast(df) if df.count() <= most else df


def own(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operators use inside.

    Extra columns of the input, whatever their names, can't clash after this.
    """
    return df.select(*[df[column].alias(name) for name, column in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> int:
    """Tasks for work that is heavy for its bytes, which Spark would else put into a few partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
