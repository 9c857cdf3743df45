"""Operator 13: periodic runs of words, by masking what has no repeated k-gram and searching the rest with Main and Lorentz's method."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolith.storage import unused
from .bpe import others
from .tokens import slices

#: A run has this many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Odd multipliers of the hashes of k-grams; an equal hash of unequal k-grams only leaves more to search.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def overlap(least: int, periods: int) -> int:
    """Words by which the shortest run overlaps itself when it is moved by its period: the k of the k-grams.

    A run of period q has max(least, periods * q) words or more. All but the
    last q of its words begin the same k words as those q further on, and two
    periods or more leave no word of it outside such k-grams.
    """
    if periods < 2:
        raise ValueError("a run has two periods at least")
    return min(max(least, periods * q) - q for q in range(1, least + 1))


def stretches(codes: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(begin, end) of the maximal stretches of words inside k-grams that occur twice or more in their document."""
    n = len(codes) - k + 1
    if n < 2:
        return []
    mixed = (doc[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        mixed = (mixed ^ codes[j : j + n].astype(np.uint64)) * _MIX
        mixed ^= mixed >> np.uint64(29)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    order = np.argsort(mixed[at])
    same = mixed[at[order[1:]]] == mixed[at[order[:-1]]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begins = at[twice]
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + k, -1)
    inside = np.cumsum(change)[:-1] > 0
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    found = []
    for a, b in edge.reshape(-1, 2).tolist():
        # A stretch ends with its document.
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(doc[a:b]))).tolist(), b]
        found += zip(cuts[:-1], cuts[1:], strict=True)
    return found


def _prefixes(s: list[int], n: int) -> list[int]:
    """For each of the first n places of ``s``, how many items from there on equal the beginning of ``s`` (Z function)."""
    size, z, left, right = len(s), [0] * n, 0, 0
    if n:
        z[0] = size
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < size and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _matches(pattern: list[int], z: list[int], text: list[int], n: int) -> list[int]:
    """For each of the first n places of ``text``, how many items from there on equal the beginning of ``pattern``."""
    size, most, out, left, right = len(text), len(pattern), [0] * n, 0, 0
    known = len(z)
    for i in range(n):
        k = min(right - i, z[i - left]) if i < right and i - left < known else 0
        while k < most and i + k < size and pattern[k] == text[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def find_runs(w: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of ``w``, by start and period (Main and Lorentz 1984).

    Halves are searched for the repetitions that cross their middle: those
    with a whole period left of it, and those with one right of it. What a
    neighbouring word outside the half extends crosses a greater half's middle
    and is found there. Of the periods of one stretch the smallest counts.
    """
    best: dict[tuple[int, int], int] = {}
    stack = [(0, len(w))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < max(least, periods):
            continue
        mid = (lo + hi) // 2
        stack += [(lo, mid), (mid, hi)]
        most = (hi - lo) // periods
        u, v = w[lo:mid][::-1], w[mid:hi]
        p_left, p_right = min(most, len(u)), min(most, len(v))
        zu, zv = _prefixes(u, min(len(u), most + 1)), _prefixes(v, min(len(v), most + 1))
        # forward: what follows mid - p equals what follows mid; backward: what precedes mid + p equals what precedes mid.
        forward = _matches(v, zv, w[mid - p_left : hi], p_left)
        backward = _matches(u, zu, w[lo : mid + p_right][::-1], p_right)
        for p in range(1, most + 1):
            found = []
            if p <= p_left:
                found.append((mid - p - (zu[p] if p < len(zu) else 0), mid + forward[p_left - p]))
            if p <= p_right:
                found.append((mid - backward[p_right - p], mid + p + (zv[p] if p < len(zv) else 0)))
            for s, e in found:
                if e - s < least or e - s < periods * p:
                    continue
                if s == lo and lo and w[lo - 1] == w[lo - 1 + p] or e == hi and hi < len(w) and w[hi] == w[hi - p]:
                    continue
                if best.get((s, e), p) >= p:
                    best[s, e] = p
    return sorted((s, e - s, p) for (s, e), p in best.items())


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts in a row, where each text's begin and the last's end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    at = lists.offsets.to_numpy().astype(np.int64)
    flat, at = lists.flatten(), at - at[0]
    some = pc.not_equal(flat, "")
    return flat.filter(some), np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[at]


def find(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """All columns of ``docs`` but its text, and ``n_words``, ``runs`` and ``collapsed`` of each whole text.

    Words are runs without ASCII white space. ``runs`` has (start, length,
    period) of every maximal stretch with a smallest period q and at least
    max(least, periods * q) words, by start, then period. ``collapsed`` has the
    words, joined by one space, that no run contains after its first period.
    Null and empty texts have no words and no runs. Repeated rows stay
    repeated, an empty table gives an empty result, and input columns with the
    names of results give way to them.
    """
    k = overlap(least, periods)
    results = ["n_words", "runs", "collapsed"]
    inner, ddl = others(docs, text, *results)
    names = [c for c in docs.columns if c not in (text, *results)]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                flat, at = _words(part.column(0))
                sizes = np.diff(at)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                codes = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.empty(0, np.int32)
                found: list[list[dict[str, int]]] = [[] for _ in sizes]
                kept = np.ones(len(flat), bool)
                for a, b in stretches(codes, doc, k):
                    if b - a < least:
                        continue
                    row = int(doc[a])
                    for s, length, p in find_runs(codes[a:b].tolist(), least, periods):
                        found[row].append({"start": a + s - int(at[row]), "length": length, "period": p})
                        kept[a + s + p : a + s + length] = False
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[at], pa.int32()), flat.filter(pa.array(kept)))
                out = [pa.array(sizes), pa.array(found, pa.list_(run)), pc.binary_join(words, " ")]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *out], [*names, *results])

    return inner.mapInArrow(each, f"{ddl}n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(runs: F.Column) -> F.Column:
    """The run of the greatest length by period, compared exactly; the first of equal ones."""
    more = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda best, x: F.when(more(x, best), x).otherwise(best))


def lines(runs: F.Column) -> F.Column:
    """``start,length,period`` and a line end for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def with_planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with periodic ends in the texts of one row in ten, as the rule of the query wants them.

    h is the crc32 of the decimal doc_id and g = floor(h / 10). Where h % 10 is
    0 and there are n > 0 words, every word from a = g % n on gives way to word
    a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)). Other rows, and
    those with a null doc_id or text, stay as they are.
    """
    h, words, g = (unused(docs, x) for x in ("h", "words", "g"))
    rows = docs.withColumn(h, F.crc32(F.col(doc_id).cast("string"))).withColumn(g, F.floor(F.col(h) / 10))
    rows = rows.withColumn(words, F.when(F.col(h) % 10 == 0, F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n = F.size(words)
    a = (F.col(g) % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col(g) % 8))).cast("int")
    block = F.slice(words, a + 1, F.least(p, n - a))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return rows.withColumn(text, F.when(F.col(words).isNotNull() & (n > 0), whole).otherwise(F.col(text))).select(*docs.columns)
