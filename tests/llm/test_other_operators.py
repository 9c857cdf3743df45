import hashlib
import io
import math
import re
import zipfile

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF

from stratolith.llm import archives, urls, vectors


def test_urls(spark):
    model = urls.fit(urls.labelled_urls(spark))
    rows = [(1, "https://A.Example.ORG/es/1"), (2, "http://example.org/en/12?x"), (3, "http://x.com/fr/"), (4, "http://com/de/7"), (5, None), (6, "no scheme"), (7, "http://www.casino-win.net"), (8, "http://blog.ththan.net/en/5#t"), (9, "http://notexample.org/es/"), (9, "http://notexample.org/es/"), (10, "http://x.org"), (11, "a://b://c/d?e")]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in urls.judge(pages, model).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].path, got[2].rule) == ("/en/12", "example.org/en/1") and got[3].rule == "com/fr/" and got[4].verdict == "block"
    assert (got[5].host, got[5].path, got[5].rule) == ("", "", None) == (got[6].host, got[6].path, got[6].rule)
    assert got[7].verdict == "block" and got[8].verdict == "allow" and got[9].rule == "org/" and got[10].rule is None
    assert (got[11].host, got[11].path) == ("b:", "//c/d")
    assert urls.judge(pages, model).count() == len(rows) and urls.judge(pages.limit(0), model).count() == 0
    labelled = urls.labelled_urls(spark)
    scored = urls.judge(labelled.selectExpr("label page_id", "url"), model, rules=()).collect()
    assert np.mean([(r.verdict == "block") == (r.page_id == 1) for r in scored]) > 0.95


def plain_parts(url):
    """Host, path and rule by the contract's words."""
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    stop = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:stop]), rest[stop:]
    path = rest[: min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))]
    fits = [(r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


def plain_score(host, path, model):
    index = HashingTF(numFeatures=urls.BUCKETS).indexOf
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", "^" + re.sub("[0-9]+", "0", path) + "$")):
        found |= {index(mark + part[i : i + n]) for n in urls.GRAMS for i in range(len(part) - n + 1)}
    weights, offset = urls.weights(model)
    return 1 / (1 + math.exp(-offset - sum(weights[i] for i in found)))


def test_urls_of_all_pages_against_a_plain_version(spark):
    from stratolith.llm import queries

    model = urls.fit(urls.labelled_urls(spark))
    given = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = queries.op5_urls(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(given)
    for r in got:
        host, path, rule, verdict = plain_parts(given[r.page_id])
        score = plain_score(host, path, model)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.block_score == pytest.approx(score, abs=1e-9)
        assert r.verdict == (verdict or ("block" if score > 0.5 else "allow"))


def test_urls_that_no_fit_has_seen(spark):
    """Words under shapes that the labelled table lacks, and plain words that it lacks altogether."""
    model = urls.fit(urls.labelled_urls(spark))
    shapes = ("{}club", "go-{}-now", "the{}", "{}s-24", "new{}")
    rows = [(n, f"http://m.{shapes[(i + n) % 5].format(w)}.example.com/en/{i}") for n, words in ((1, urls._BLOCKED_WORDS), (0, urls._PLAIN_WORDS)) for i, w in enumerate(words)]
    rows += [(0, f"https://{w}.example.net/fr/9") for w in "bakery quilting sailing almanac lighthouse botany carpentry geology astronomy cathedral vineyard hiking knitting folklore parliament reservoir".split()]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), model, rules=()).collect()
    share = lambda n, verdict: np.mean([r.verdict == verdict for r in got if r.page_id == n])
    assert share(1, "block") > 0.9 and share(0, "allow") > 0.97


def test_archives(spark):
    big, tie = "x" * 1500, "ä" * 600
    rows = [(1, "u", big), (2, "u\r\nX: y", big), (9, None, big), (9, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", tie), (8, "u", tie)]
    pages = spark.createDataFrame([(i, u, h, 1, "d") for i, u, h in rows], "page_id long, url string, html string, keeper int, digest string")
    got = archives.round_trip(pages, archive_bytes=500).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = {big: 9, tie: 8}.get(h)
        revisit = to is not None and i != to
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    key = lambda r: (r[0] or 0, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert archives.round_trip(pages.limit(0)).count() == 0


def test_zip_directories():
    out = io.BytesIO()
    package = archives.StoredZip(out)
    package.add("archive/data.warc.gz", b"a" * 70000)
    package.add("indexes/index.cdx", b"one\ntwo\n")
    package.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:  # another reader agrees
        assert z.testzip() is None and z.read("indexes/index.cdx") == b"one\ntwo\n"
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.writestr("indexes/index.cdx", "one\ntwo\n")
        z.comment = b"a comment"
    for data in (out.getvalue(), plain.getvalue()):
        reader = archives.ZipReader(io.BytesIO(data), len(data))
        m = reader.stored(".cdx")
        assert reader.read(m.offset, m.size) == b"one\ntwo\n"
    with pytest.raises(ValueError):
        archives.ZipReader(io.BytesIO(b"junk"), 4).members()


@pytest.mark.parametrize("block", [2048, 9])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 16))
    x = [list(map(float, base[i % 25] + rng.normal(scale=0.12, size=16))) for i in range(150)] + [list(map(float, base[0]))] * 20
    rows = list(enumerate(x)) + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, []), (505, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rep int, links int")
    a = np.array([v for _, v in rows[:170]], dtype=np.float32).astype(float)
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    same = (a[:, None] == a[None]).all(axis=2)
    near |= same
    on = np.arange(170)
    for _ in range(170):
        on = np.array([on[near[i]].min() for i in range(170)])
    got = {r.vec_id: r for r in vectors.near_duplicates(df, block=block).collect()}
    assert len(got) == len(rows)
    for i in range(170):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, on[i], on[i] == i)
    for i in range(500, 506):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(9)
    rows = []
    for d, n in ((16, 150), (24, 100), (3, 40), (1, 2), (2, 1)):
        base = rng.normal(size=(max(n // 6, 1), d))
        rows += [list(map(float, base[i % len(base)] + rng.normal(scale=0.1, size=d))) for i in range(n)]
    rows += rows[150:160]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    unit = [np.array(v) / np.linalg.norm(v) for v in rows]
    near = np.array([[len(a) == len(b) and (a is b or a @ b >= 0.9) for b in unit] for a in unit])
    on = np.arange(len(rows))
    for _ in rows:
        on = np.array([on[x].min() for x in near])
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    for sample in (vectors.SAMPLE, 20):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, sample=sample, block=30).collect()}
        assert got == {i: (near[i].sum() - 1, on[i], on[i] == i) for i in range(len(rows))}
