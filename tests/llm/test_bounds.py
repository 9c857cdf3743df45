"""What bounds the work of operators 1, 2, 3 and 9 where ids repeat, phrases are shared or fingerprints are many."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratolith import storage
from stratolith.llm import decontaminate, quality, simhash, vectors
from stratolith.storage import table

DATA = "/root/testdata/sf0.001"


def test_a_labelled_id_on_many_rows_gives_no_more_than_the_sample(spark, monkeypatch):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    hot = ids[0]
    rows = [(i, f"text number {i} " * 20) for i in ids] + [(hot, f"another text {k} " * 20) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    seen = []
    real = quality._dictionary
    monkeypatch.setattr(quality, "_dictionary", lambda texts: seen.append(len(texts)) or real(texts))
    quality.fit(docs, labels, sample=40)
    assert len(seen) == 2 and max(seen) <= 40


def test_rows_dealt_for_a_fingerprint_do_not_grow_with_their_number(spark):
    dice = np.random.default_rng(4)
    each = []
    for n in (20_000, 200_000):
        fps = np.unique(dice.integers(-(2**63), 2**63 - 1, n))
        reps = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps)], "fp long, rep long")
        each.append(simhash.dealt(reps, block=8).count() / n)
    assert each[1] < 1.5 * each[0] and each[1] < 200, each


def test_blocks_that_grow_lose_no_link(spark):
    dice = random.Random(5)
    base = [dice.getrandbits(64) for _ in range(300)]
    fps = sorted({f ^ (1 << dice.randrange(64)) ^ (1 << dice.randrange(64)) for f in base for _ in range(4)} | set(base))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    reps = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    want = {frozenset(i for i in range(len(fps)) if root(i) == r) for r in {root(i) for i in range(len(fps))}}
    for block in (4, 2048):
        mine = list(range(len(fps)))

        def top(i):
            while mine[i] != i:
                i = mine[i]
            return i

        for r in simhash.near_links(reps, block=block).collect():
            mine[top(r.a)] = top(r.b)
        assert {frozenset(i for i in range(len(fps)) if top(i) == t) for t in {top(i) for i in range(len(fps))}} == want


def test_an_id_on_two_vectors_joins_neither(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [1.0, 0.01, 0.0]), (9, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 0.0]), (8, None)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id in (5, 7, 9)) == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 1, 5, False)]
    lone = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id in (3, 8, None)}
    assert lone == {3: (0, 3), 8: (0, 8), None: (0, None)}
    # Where the shared id isn't the smallest, the groups are seen to be two.
    rows = [(9, [1.0, 0.0]), (9, [0.0, 1.0]), (4, [1.0, 0.01]), (6, [0.01, 1.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(4, 1, 4), (6, 1, 6), (9, 1, 4), (9, 1, 6)]


def words(dice, n):
    return " ".join("".join(dice.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_a_phrase_that_documents_and_items_share_proposes_little(spark):
    dice = random.Random(6)
    phrase = words(dice, 9)
    items = [(i, f"{words(dice, 10)} {phrase} {words(dice, 12)}") for i in range(120)]
    docs = [(i, f"{words(dice, 40)} {phrase} {words(dice, 40)}" + (f" {items[i][1]}" if i < 20 else "")) for i in range(150)]
    d, b = (spark.createDataFrame(rows, f"{name} long, text string") for name, rows in (("doc_id", docs), ("item_id", items)))
    wanted = decontaminate.item_shingles(b, 5, 0.8)
    found = decontaminate.candidates(d, wanted, 5).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(20)}
    assert {(r.doc_id, r.item_id, r.containment) for r in decontaminate.contained(d, b).collect()} == {(i, i, 1.0) for i in range(20)}


@pytest.mark.parametrize("short", [False, True])
def test_few_hashes_of_documents_are_looked_up(spark, short):
    docs, items = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    if short:
        items = items.union(spark.createDataFrame([(10_000 + i, f"word{i}") for i in range(5)], "item_id long, text string"))
    wanted = decontaminate.item_shingles(items, 5, 0.8).cache()
    hashes, _ = decontaminate.looked_up(wanted, 5, 0.8)
    every = F.array_distinct(decontaminate._shingles(F.col("text"), 5, F.xxhash64))
    n, all_ = docs.select(F.sum(F.size(hashes)), F.sum(F.size(every))).first()
    assert n < 0.2 * all_
    wanted.unpersist()


def test_documents_and_items_of_all_sizes_against_sets(spark):
    dice = random.Random(7)
    vocabulary = [words(dice, 1) for _ in range(40)]
    items = [(i, " ".join(dice.choices(vocabulary, k=dice.choice([1, 3, 5, 6, 9, 20, 90])))) for i in range(60)]
    docs = [(i, " ".join(dice.choices(vocabulary, k=dice.randint(0, 30))) + " " + " ".join(x for _, x in dice.sample(items, dice.randint(0, 3)))) for i in range(60)] + [(100 + i, x) for i, x in items[:20]]

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    want = {(i, j) for i, x in docs for j, y in items if shingles(y) and len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(y)) - 1e-9}
    d, b = (spark.createDataFrame(rows, f"{name} long, text string") for name, rows in (("doc_id", docs), ("item_id", items)))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(d, b).collect()} == want and len(want) > 60


def test_each_vector_is_dealt_once(spark, tmp_path, monkeypatch):
    # Vectors without structure must be held against nearly all lists; what is written for that grows with the vectors alone.
    monkeypatch.setattr(vectors, "remove", lambda *x: None, raising=False)
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x[1500:] = np.where(np.arange(1500)[:, None] < 300, x[7] + rng.normal(scale=0.08, size=(1500, 32)), x[1500:])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, block=700).collect()}
    assert got == {i: n - 1 for i, n in enumerate(near.sum(axis=1).tolist())}
    assert max(got.values()) > 200
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert written < 4 * x.nbytes
