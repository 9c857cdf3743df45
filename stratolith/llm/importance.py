"""Operator 12: importance resampling towards a target's distribution of hashed features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratolith.storage import cut, own
from .tokens import slices

BUCKETS = 10_000
#: Features are runs of this many consecutive words at most.
WORDS = 1
PERCENT, MIN_WORDS, SEED = 10, 20, 2024
#: Distinct features that a task remembers the buckets of.
REMEMBERED = 1_000_000
#: Digits, lower-cased letters and all bytes beyond ASCII; everything else parts words.
_WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_STREAM = "doc_ids array<long>, words array<long>, ends binary, stream binary, crowd binary"


class _Buckets(dict):
    """Feature to bucket; each is hashed once."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def features_of(words: list[bytes], most: int) -> list[bytes]:
    """All runs of 1 to ``most`` words, joined by one space, repeats included."""
    out = list(words)
    for k in range(2, most + 1):
        out += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return out


def _run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, how often) of a stream, by sorting it and measuring its runs."""
    ordered = np.sort(stream)
    begins = np.flatnonzero(np.concatenate([[len(ordered) > 0], ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, bool))
    return ordered[begins], np.diff(np.append(begins, len(ordered)))


def streams(docs: DataFrame, buckets: int = BUCKETS, words: int = WORDS) -> DataFrame:
    """Packed bucket streams: a row for each slice of a task's texts, or one longer text.

    ``stream`` has the unsigned 16-bit buckets of all its documents' features
    in a row, ``ends`` (64-bit) where each document's end, ``words`` how many
    words each has. ``crowd`` is the slice's own count by bucket: the sorted
    stream's runs, as pairs of 64-bit integers.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit 16 bits")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(buckets)
        for batch in batches:
            for part in slices(batch, 1):
                if len(bucket_of) > REMEMBERED:
                    bucket_of.clear()
                rows, counts = [], []
                for text in part.column(1).to_pylist():
                    found = words_of(text)
                    counts.append(len(found))
                    if words > 1:
                        found = features_of(found, words)
                    rows.append(np.fromiter(map(bucket_of.__getitem__, found), "<u2", len(found)))
                stream = np.concatenate(rows)
                ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
                crowd = np.stack(_run_lengths(stream), axis=1).astype("<i8")
                yield pa.RecordBatch.from_pydict({
                    "doc_ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    "words": pa.array([counts], pa.list_(pa.int64())),
                    "ends": [ends.astype("<i8").tobytes()],
                    "stream": [stream.tobytes()],
                    "crowd": [crowd.tobytes()],
                })

    rows = own(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(each, _STREAM)


def counts(packed: DataFrame) -> DataFrame:
    """(bucket, n) over all streams: each task adds up its slices' runs, so it sends a row for a bucket at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for bucket, n in np.frombuffer(data, "<i8").reshape(-1, 2).tolist():
                    total[bucket] = total.get(bucket, 0) + n
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(total.keys(), pa.int64()), "n": pa.array(total.values(), pa.int64())})

    return packed.select("crowd").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), from counts (bucket, n).

    At most ``buckets`` rows come to the driver from each side.
    """
    s, t = (dict(df.select("bucket", "n").collect()) for df in (source, target))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    each = np.array([[t.get(b, 0) + 1.0, s.get(b, 0) + 1.0] for b in range(buckets)])
    return np.floor(1000 * np.log(each[:, 0] * all_s / (each[:, 1] * all_t))).astype(np.int64).tolist()


def weights(packed: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_features, weight, n_words, block, at) of every document: the floored mean of its features' gains."""
    # The gain of each bucket, as a task needs it.
    table = np.array(gain, np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, words, ends, stream, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value, end = table[np.frombuffer(stream, "<u2")], np.frombuffer(ends, "<i8")
                n = np.diff(end, prepend=0)
                some = n > 0  # reduceat gives an empty stretch its first neighbour
                total = np.zeros(len(n), np.int64)
                if some.any():
                    total[some] = np.add.reduceat(value, (end - n)[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1)), pa.array(words, pa.int64()), pa.array(np.full(len(n), block)), pa.array(np.arange(len(n)))],
                    ["doc_id", "n_features", "weight", "n_words", "block", "at"],
                )

    return packed.select("doc_ids", "words", "ends", "stream", "block").mapInArrow(each, "doc_id long, n_features long, weight long, n_words long, block long, at long")


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, words: int = WORDS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn.

    Features are hashed into ``buckets``, a document's weight is the floored
    mean gain of its features, and the score adds Gumbel noise that depends on
    seed and doc_id alone. Of the N documents with ``min_words`` words or more,
    the floor(percent * N / 100) of the highest scores are drawn, ties by
    smaller doc_id.

    Null and empty texts have no features and weight 0. Rows that share a
    doc_id are documents of their own, ranked in the order in which they are
    stored where their scores tie too; a null doc_id has the noise of an empty
    id and comes last in a tie. Without target texts every gain is the source's
    alone. An empty table gives an empty result; extra columns are ignored.
    """
    packed = cut(streams(docs, buckets, words).withColumn("block", F.monotonically_increasing_id()), "streams")
    gain = gains(counts(packed), counts(streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, words)), buckets)
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0)))
    fit = F.col("n_words") >= min_words
    scored = weights(packed, gain).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), fit.alias("fit"), "block", "at")
    # No two rows have the same block and place, so ranges can part rows of one score or one doc_id.
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("block"), F.asc("at")]
    ordered = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ordered = cut(ordered.drop("at", "block").withColumn("row", F.monotonically_increasing_id()), "scores")
    # A row for each task.
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fit").alias("fits"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.floor(F.sum("fits").over(Window.partitionBy()) * percent / 100)
    parts = parts.select("part", before.alias("before"), drawn.alias("drawn"))
    # Rows of a part are numbered in a row, from the part's own first number on.
    place = F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1) + 1
    return ordered.join(F.broadcast(parts), "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (place <= F.col("drawn")), place).alias("rank"))
