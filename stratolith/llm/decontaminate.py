"""Operator 9 [native]: benchmark decontamination by MinHash containment search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratolith.storage import cut, own, small, unused
from .simhash import row_key

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Rows of sketches or candidates up to which they are broadcast (some 50 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Classes of items by size, and least and most places of the filter on hashes (bytes on the driver and in each task).
CLASSES, LEAST_PLACES, MOST_PLACES = 7, 1 << 12, 1 << 20
#: A word: a run of letters, digits and marks; everything else parts words.
_BETWEEN = r"[^\p{L}\p{N}\p{M}]+"


def _shingles(text, words: int, one) -> F.Column:
    """``one`` of the word list of each shingle of a whole text; fewer words than a shingle has make one of all."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")

    def each(ws):
        n = F.size(ws)
        full = F.transform(F.sequence(F.lit(1), n - words + 1), lambda i: one(F.slice(ws, i, F.lit(words))))
        return F.when(n >= words, full).when(n > 0, F.array(one(ws)))

    # The outer array holds the words once, so that each shingle doesn't split the text again.
    return F.flatten(F.filter(F.transform(F.array(parts), each), lambda found: found.isNotNull()))


def _text(ws) -> F.Column:
    return F.concat_ws(" ", ws)


def item_shingles(items: DataFrame, words: int, least: float) -> DataFrame:
    """(item_id, shingle, hash, n, sketch): distinct shingles of every item, those of its sketch marked.

    An item of n distinct shingles keeps n - ceil(least * n) + 1 of them. A
    document that holds at least ``least`` of the item lacks at most
    n - ceil(least * n) of its shingles, so it holds one of any that many: the
    search can't miss. Those that the fewest items have are kept first, so a
    phrase that many items share proposes none of them, and of equally rare
    ones the least hashes.
    """
    each = own(items, item_id="item_id", text="text").where("item_id is not null")
    each = each.select("item_id", F.explode(F.arrays_zip(_shingles(F.col("text"), words, _text).alias("shingle"), _shingles(F.col("text"), words, F.xxhash64).alias("hash"))).alias("s")).select("item_id", "s.*").distinct()
    each = each.join(each.groupBy("shingle").agg(F.count("*").alias("items")), "shingle")
    size = Window.partitionBy("item_id")
    rank = F.row_number().over(size.orderBy("items", "hash", "shingle"))
    kept = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    return each.withColumn("n", F.count("*").over(size)).select("item_id", "shingle", "hash", "n", (rank <= kept).alias("sketch"))


def _class(n) -> F.Column:
    """The size class of an item: items of one class differ in size by less than twice; the last one is open."""
    return F.least(F.floor(F.log2(n.cast("double")) + 1e-12), F.lit(CLASSES - 1)).cast("int")


def _places(rows: int) -> int:
    """Places of the filter for so many hashes: sixteen for each, and a stated number at least and at most."""
    return int(min(max(1 << (16 * rows).bit_length(), LEAST_PLACES), MOST_PLACES))


def looked_up(wanted: DataFrame, words: int, least: float):
    """(the column of those hashes of a text that may be of a sketch, the sketches (hash, item_id, n)).

    Sketches are partitioned by size: each class of items marks the places of
    its hashes in a filter of one byte a place, a bit for each class, which is
    all that comes to the driver. A document asks only the classes whose items
    it has shingles enough to hold. What the filter lets through besides is
    dropped by the join.
    """
    sketch = wanted.where("sketch").select("hash", "item_id", "n")
    places = _places(sketch.count())
    marks = sketch.groupBy(F.pmod("hash", F.lit(places)).alias("at")).agg(F.bit_or(F.pow(F.lit(2), _class(F.col("n"))).cast("int")).alias("bits"))
    table = bytearray(places)
    for r in marks.toLocalIterator():
        table[r["at"]] = r["bits"]
    known = F.lit(table)
    hashes = _shingles(F.col("text"), words, F.xxhash64)

    def asked(found):
        # Items of class c have 2**c shingles at least; repeated ones only make the document look longer.
        enough = F.floor(F.log2((F.size(found) / least).cast("double")) + 1e-9)
        classes = (F.pow(F.lit(2), F.least(enough, F.lit(CLASSES - 1)) + 1) - 1).cast("int")
        mark = lambda h: F.ascii(F.substring(known, (F.pmod(h, F.lit(places)) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.filter(found, lambda h: mark(h).bitwiseAND(classes) > 0)

    return F.flatten(F.transform(F.array(hashes), asked)), sketch


def candidates(texts: DataFrame, wanted: DataFrame, words: int, least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id), once each, of all documents that hold a hash of an item's sketch."""
    hashes, sketch = looked_up(wanted, words, least)
    return texts.select("doc_id", F.explode(hashes).alias("hash")).join(small(sketch, BROADCAST_ROWS), "hash").select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, words: int = SHINGLE_WORDS, least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every item of which a document holds at least ``least``.

    Words are lower-cased runs of letters, digits and marks; documents are
    read whole, so an item inside a long one counts as much as in a short
    one. A pair becomes a candidate by a hash of the item's sketch, found by
    classes of size, and only candidates are verified, by the exact share of
    the item's distinct shingles. Items with fewer words than a shingle match only documents that
    consist of them. Null texts count as empty and hold nothing; rows with a
    null id aren't returned; rows that share a doc_id count as one document,
    and likewise items; extra columns are ignored; an empty table gives an
    empty result.
    """
    wanted = cut(item_shingles(items, words, least), "items")
    texts = own(docs, doc_id="doc_id", text="text").where("doc_id is not null")
    pairs = cut(candidates(texts, wanted, words, least), "candidates")
    # Where candidates are few, the other documents never leave their tasks.
    found = small(cut(pairs.select("doc_id").distinct(), "found"), BROADCAST_ROWS)
    shingles = F.array_distinct(_shingles(F.col("text"), words, _text))
    held = texts.join(found, "doc_id", "left_semi").select("doc_id", F.explode(shingles).alias("shingle"))
    items_of = cut(wanted.select("shingle").distinct(), "shingles")
    if items_of.count() <= BROADCAST_ROWS:
        held = held.join(F.broadcast(items_of), "shingle", "left_semi")
    # Each candidate asks for its own item's shingles in its own document, so a shingle that many of both have meets no others.
    return (
        pairs.join(wanted.select("item_id", "shingle", "n"), "item_id")
        .join(held.distinct(), ["doc_id", "shingle"])
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("shared"), F.max("n").alias("item_shingles"))
        .where(F.col("shared") >= F.ceil(F.lit(least) * F.col("item_shingles") - 1e-9))
        .select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))
    )


def clean(docs: DataFrame, items: DataFrame, words: int = SHINGLE_WORDS, least: float = CONTAINMENT) -> DataFrame:
    """Documents without a contained item, with all their columns.

    Every row is judged by its own text, whether it shares its doc_id or has none.
    """
    key = unused(docs, "key")
    rows = docs.withColumn(key, row_key(docs["doc_id"], docs["text"]))
    found = cut(contained(rows.select(F.col(key).alias("doc_id"), "text"), items, words, least).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return rows.join(small(found, BROADCAST_ROWS), key, "left_anti").select(*docs.columns)


def sketch_size(n: int, least: float = CONTAINMENT) -> int:
    """Hashes that the sketch of an item with ``n`` shingles keeps."""
    return n - math.ceil(least * n - 1e-9) + 1
