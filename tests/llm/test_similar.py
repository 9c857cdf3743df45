import random

import numpy as np
import pytest

from stratolith.llm import decontaminate, similar, simhash
from stratolith.storage import table
from tests.llm.test_text_operators import ODD, WIDE


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(texts):
    sets, on = {i: shingles(t) for i, t in texts}, {}

    def top(i):
        while on.setdefault(i, i) != i:
            i = on[i]
        return i

    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (a == b or 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                a, b = top(i), top(j)
                on[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def edited(n, seed):
    """Texts of several lengths, each with copies that differ in some words, and chains of copies of copies."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choices("abcdefghij", k=4))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(pick.choice([3, 6, 9, 14, 25, 40, 120, 300]))]
        for _ in range(8):
            texts.append(" ".join(words))
            for _ in range(1 + len(words) // 60):
                words[pick.randrange(len(words))] = word()
            if pick.random() < 0.3:
                words.append(word())
    pick.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block, rows", [(None, 512), (40, 3)])
def test_near_copies_against_all_pairs(spark, monkeypatch, block, rows):
    monkeypatch.setattr(similar, "SET_ROWS", rows)
    texts = edited(80, 5)
    got = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(texts, "doc_id long, text string"), block).collect()}
    want = by_hand(texts)
    assert len(set(want.values())) < 0.9 * len(want)
    assert got == want


def test_near_copies_without_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(similar, "SET_ROWS", 5)
    shared = " ".join(f"every{i}" for i in range(20))
    texts = edited(40, 11) + [(1000 + i, f"{shared} {t} {shared}" if i % 3 else t) for i, t in edited(15, 12)] + [(2000, None), (2001, ""), (2002, "a"), (2003, "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar.near_copies(docs, exact=True).collect()} == by_hand(texts)
    assert similar.near_copies(docs.limit(0), exact=True).count() == 0


def test_sizes_alone_decide_who_is_compared_exactly():
    size = np.array([1, 3, 4, 5, 5, 6, 20, 25, 26], np.int64)
    bits = np.where(np.arange(9) % 2, 0, 2**64 - 1).astype(np.uint64)
    some = similar._Prints(np.arange(9), bits, bits, size)
    got = {(i, int(j)) for i, found in some.sized(some) for j in found}
    assert got == {(i, j) for i in range(9) for j in range(9) if 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])}


def test_near_copies_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in similar.near_copies(docs).collect()} == want
    assert sorted(r.doc_id for r in simhash.one_of_each(docs, similar.near_copies(docs)).collect()) == sorted(set(want.values()))


def test_near_copies_edges(spark):
    odd = spark.createDataFrame([(i, t, "en", "s", 1, 1, "x", "y", "z", 1, "w", 2, "v") for i, t in ODD], WIDE)
    got = sorted(((r.doc_id, r.component_id) for r in similar.near_copies(odd).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (5, 4), (None, 4), (7, 1), (8, 8)], key=str)
    assert similar.near_copies(odd.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    word = lambda seed: " ".join("".join(random.Random(f"{seed} {i}").choices("abcdefgh", k=5)) for i in range(60))
    near = lambda text: text + " once more"
    a, b, c, d, e, item = (word(x) for x in "ABCDEF")
    rows = [(5, a), (5, b), (2, b), (5, c), (5, c), (9, near(c)), (5, d), (None, near(d)), (None, e), (None, e), (7, near(a)), (5, item), (None, item), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = simhash.one_of_each(docs, similar.near_copies(docs))
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(5, a), (2, b), (5, c), (5, d), (None, e), (5, item), (3, "")], key=str)
    apart = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs.where("doc_id = 5")).collect()), key=str)
    assert apart == sorted([(5, a), (5, b), (5, c), (5, d), (5, item)], key=str)
    clean = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.n for r in clean.collect()) == [n for n, (_, t) in enumerate(rows) if t != item]
