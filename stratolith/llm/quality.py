"""Operator 1: quality classifier by compression with trained dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratolith.storage import own

#: Rows of each label that the fit may use, taken in the order of a hash of their ids.
SAMPLE = 1500
#: Bytes of a text that are compressed at once; a whole text is the sum of its pieces.
PIECE = 1024
DICTIONARY_BYTES = 112640
LEVEL = 3
#: A text is kept if its score, the chance of label 1, is at least this.
THRESHOLD = 0.3
HELD_OUT_FOLDS = 5


def held_out(doc_id) -> F.Column:
    """True for the documents that no fit may see: crc32 of the id's text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def _pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the calibration of their difference."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def differences(self, texts: Iterator[str | None]) -> np.ndarray:
        """(bad - good) compressed bytes by bytes of each whole text; 0 for an empty one."""
        args = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        kinds = []
        for raw in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=LEVEL)
            kinds.append(zstandard.ZstdCompressor(dict_data=words, **args).compress)
        good, bad = kinds
        out = []
        for text in texts:
            pieces = _pieces(text)
            g, b = sum(len(good(p)) for p in pieces), sum(len(bad(p)) for p in pieces)
            out.append((b - g) / sum(map(len, pieces)) if pieces else 0.0)
        return np.array(out, dtype=float)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * differences + self.offset, -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's logistic fit by Newton steps, with a small ridge so that it always converges."""
    w = np.zeros(2)
    scale = max(float(np.std(x)), 1e-6)
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-3 * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary; the plain bytes serve where there are too few samples to train on."""
    samples = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\x20" * 8


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CompressionModel:
    """Fit on at most ``sample`` rows of each label that aren't held out, whatever rows share a labelled id.

    Two thirds of each label's sample make its dictionary, the rest (weighted
    back to the labels' true shares) calibrates. Without any labelled row every
    score is 0.5; with one label only, the calibration still runs.
    """
    known = own(labels, doc_id="doc_id", quality="quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for quality in (0, 1):
        part = known.where(F.col("quality") == quality).orderBy(*order).limit(sample)
        picked = part if picked is None else picked.union(part)
    # At most 2 x sample ids: a proven bound for the broadcast. An id may stand on many rows, so the joined rows are counted too.
    joined = own(docs, doc_id="doc_id", text="text").join(F.broadcast(picked.dropDuplicates(["doc_id", "quality"])), "doc_id")
    place = Window.partitionBy("quality").orderBy(*order, F.xxhash64("text"))
    rows = joined.withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample).select("doc_id", "quality", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["text"] or ""))
    texts = {q: [r["text"] or "" for r in rows if r["quality"] == q] for q in (0, 1)}
    if not rows:
        return CompressionModel(b"\x20" * 8, b"\x20" * 8, 0.0, 0.0)
    dictionary = {q: [t for i, t in enumerate(texts[q]) if i % 3 or len(texts[q]) < 3] for q in (0, 1)}
    rest = {q: [t for i, t in enumerate(texts[q]) if i % 3 == 0] for q in (0, 1)}
    model = CompressionModel(_dictionary(dictionary[1]), _dictionary(dictionary[0]), 1.0, 0.0)
    x = np.concatenate([model.differences(iter(rest[q])) for q in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.concatenate([np.full(len(rest[q]), counts.get(q, 0) / max(len(rest[q]), 1)) for q in (0, 1)])
    slope, offset = _calibrate(x, y, weight / max(weight.mean(), 1e-12))
    return CompressionModel(model.good, model.bad, slope, offset)


def score(docs: DataFrame, model: CompressionModel, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of every whole text; a null text counts as empty. All other columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 110 KB at most

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(sent.value.scores(sent.value.differences(iter(part))))

    return docs.withColumn(name, scored(docs[text]))
