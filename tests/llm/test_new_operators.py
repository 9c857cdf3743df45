import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from stratolith.llm import bpe, importance, queries, runs
from stratolith.storage import table

DATA = "/root/testdata/sf0.001"
LONG = "x y " * 6000
ODD = [(1, None), (2, ""), (3, LONG), (4, "same words in here today"), (5, "same words in here today"), (5, "same words in here today"), (None, "same words in here today"), (7, "\n \t"), (8, "Ünï çode <|endoftext|> don't  go\n\n now 123 \U0001f600　x"), (9, "ab" * 5000)]
WIDE = "doc_id long, text string, body string, ids string, decoded string, runs int, collapsed int, n_words string, words string, h int, block int, row int, part int, score string, rank int, `a``b` int"
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "b", "i", "d", 1, 2, "n", "w", 3, 4, 5, 6, "s", 7, 8) for i, t in ODD], WIDE)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query_is_what_the_library_gives(spark, documents):
    plain = library(BPE)
    want = []
    for i, text in documents:
        ids = plain.encode_ordinary(text or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    assert sorted(map(tuple, queries.op11_bpe(spark, DATA).collect())) == sorted(want)


def test_bpe_edges(spark, odd):
    plain = library(BPE)
    coded = bpe.encode(odd, BPE, public_tokenizers.PATTERN)
    rows = bpe.decode(coded, BPE).collect()
    assert len(rows) == len(ODD) and "a`b" in coded.columns
    texts = sorted((t or "" for _, t in ODD))
    assert sorted(bytes(r.decoded).decode() for r in rows) == texts
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(bytes(r.decoded).decode())
    assert bpe.encode(odd.limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_texts_of_white_space_and_marks():
    plain, encoder, dice = library(BPE), bpe.Encoder(BPE, public_tokenizers.PATTERN), random.Random(1)
    alphabet = [" ", "  ", "\n", "\t", "　", "\xa0", "a", "bc", "'s", "don't", "123", "!!", "é", "漢字", "\U0001f600", "<|endoftext|>", "\x1c", "\x00", "\r\n"]
    import pyarrow as pa

    texts = ["".join(dice.choice(alphabet) for _ in range(dice.randint(0, 30))) for _ in range(2000)]
    ids, at = encoder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode_ordinary(text), repr(text)


def test_bpe_where_merges_make_lower_ranks(tmp_path):
    """Vocabularies in no order of merging: what a merge makes may have a rank that has passed."""
    dice, late = random.Random(2), 0
    for trial in range(60):
        pool = list({bytes(dice.choice(b"abc") for _ in range(dice.randint(2, 4))) for _ in range(14)})
        dice.shuffle(pool)
        path = str(tmp_path / f"{trial}.tiktoken")
        with open(path, "wb") as out:
            out.writelines(base64.b64encode(w) + b" %d\n" % i for i, w in enumerate([*(bytes([b]) for b in range(256)), *pool]))
        vocabulary, plain = bpe.Vocabulary(path), library(path)
        strict, calls = vocabulary.strict, []
        vocabulary.strict = lambda word: calls.append(word) or strict(word)
        words = [w for w in {bytes(dice.choice(b"abc") for _ in range(dice.randint(1, 25))) for _ in range(50)} if w not in vocabulary.ranks]
        for word, ids in zip(words, vocabulary.replay(words), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(word.decode()), (trial, word)
        late += len(calls)
    assert late > 0


def plain_resample(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, items)):
        for text in texts:
            for w in words(text):
                counts[bucket(w)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        got = [gain[bucket(w)] for w in words(text)]
        weight = sum(got) // len(got) if got else 0
        h = int(sha(f"2024:{'' if i is None else i}".encode())[:8], 16)
        rows.append([i, len(got), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: 10 * len(fit) // 100])}
    return [(*r, ranks.get(id(r))) for r in rows]


def test_importance_query_against_a_plain_one(spark, documents):
    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    got = sorted(map(tuple, queries.op12_importance(spark, DATA).collect()))
    want = sorted(plain_resample(documents, items))
    assert got == want and sum(r[4] is not None for r in got) == len([r for r in got if r[1] >= 20]) // 10


def test_importance_edges(spark, odd):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], r[4] or 0)
    items = ["same words", None, ""]
    target = spark.createDataFrame([(t, 1) for t in items], "text string, doc_id int")
    got = sorted(map(tuple, importance.resample(odd, target).collect()), key=key)
    assert got == sorted(plain_resample(ODD, items), key=key)
    many = spark.createDataFrame([(i, LONG if i else None) for i in [1] * 30 + [None] * 30], "doc_id long, text string")
    ranks = sorted(r["rank"] for r in importance.resample(many, target).collect() if r["rank"])
    assert ranks == [1, 2, 3]
    assert importance.resample(odd.limit(0), target.limit(0)).count() == 0


def test_importance_of_several_words(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "c")], "doc_id long, text string")
    got = importance.resample(docs, docs, words=2, min_words=1, percent=100).collect()
    assert {r.doc_id: r.n_features for r in got} == {1: 9, 2: 1} and sorted(r["rank"] for r in got) == [1, 2]
    assert importance.features_of([b"a", b"b", b"c"], 3) == [b"a", b"b", b"c", b"a b", b"b c", b"a b c"]


def plain_runs(w, least=6, periods=4):
    best = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            e = i
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            if e + p - i >= max(least, periods * p):
                best.setdefault((i, e + p), p)
            i = e + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def plain_op13(i, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = plain_runs(w)
    dropped = {k for s, length, p in found for k in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    milli = 1000 * best[1] // best[2] if found else None
    return (i, len(found), *best, milli, sha("".join(f"{s},{x},{p}\n" for s, x, p in found).encode()), sha(" ".join(x for k, x in enumerate(w) if k not in dropped).encode()))


def test_runs_query_against_a_plain_search(spark, documents):
    got = sorted(map(tuple, queries.op13_runs(spark, DATA).collect()), key=repr)
    want = sorted((plain_op13(*d) for d in documents), key=repr)
    assert got == want and sum(r[1] > 0 for r in got) > 3


def test_runs_edges(spark, odd):
    found = runs.find(odd)
    assert "a`b" in found.columns
    for r in found.collect():
        text = dict((i, t) for i, t in ODD)[r.doc_id]
        w = (text or "").split(" ") if r.doc_id == 3 else re.findall("[^\x20\x09-\x0d]+", text or "")
        w = [x for x in w if x]
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == plain_runs(w), r.doc_id
        assert r.doc_id != 3 or r.collapsed == "x y"
    assert runs.find(odd.limit(0)).count() == 0


def test_runs_of_small_alphabets():
    """The masked search finds what trying every period finds."""
    dice = random.Random(3)
    for trial in range(400):
        unit = [dice.randint(0, 2) for _ in range(dice.randint(1, 9))]
        docs = [[dice.randint(0, 1 + trial % 4) for _ in range(dice.randint(0, 40))] + unit * dice.randint(0, 9) + [dice.randint(0, 2) for _ in range(dice.randint(0, 12))] for _ in range(3)]
        least, periods = dice.choice([(6, 4), (4, 2), (6, 3), (1, 2), (10, 2)])
        codes, doc = np.array(sum(docs, []), np.int32), np.repeat(np.arange(3), [len(d) for d in docs])
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = [[] for _ in docs]
        for a, b in runs.stretches(codes, doc, runs.overlap(least, periods)):
            got[doc[a]] += [(a + s - int(at[doc[a]]), n, p) for s, n, p in runs.find_runs(codes[a:b].tolist(), least, periods)]
        assert [sorted(g) for g in got] == [plain_runs(d, least, periods) for d in docs], trial


def test_words_outside_repeated_stretches_are_not_searched():
    text = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, *[10, 11] * 5, 12, 13, 14], np.int32)
    assert runs.overlap(6, 4) == 5
    assert runs.stretches(text, np.zeros(len(text), np.int64), 5) == [(9, 19)]
    assert runs.find_runs([10, 11] * 5) == [(0, 10, 2)]
