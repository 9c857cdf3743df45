"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolith.storage import cut_at, remove


def _stars(links: DataFrame) -> tuple[DataFrame, str]:
    """One round, written: every node's larger, then smaller, neighbours hang on its least one."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )
    large, path = cut_at(large, "large")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    found = cut_at(
        large.join(least, "a")
        .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        .where("e.a <> e.b")
        .select("e.a", "e.b")
        .distinct(),
        "edges",
    )
    remove(links.sparkSession, path)
    return found


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Return (node, component) for every node that has a link.

    ``component`` is the smallest node that can be reached. Large-star and
    small-star rounds (Kiveris et al. 2014) work on the links as a table; only
    a count and a sum leave the cluster in each round, and each round's tables
    are deleted once the next one's are written. Links may repeat or run
    in either direction; rows with a null end, and self-links, are ignored.
    """
    edges = (
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where("a <> b")
        .distinct()
    )
    (edges, path), before = cut_at(edges, "edges"), None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == before:
            break
        before, old = now, path
        edges, path = _stars(edges)
        remove(edges.sparkSession, old)
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
