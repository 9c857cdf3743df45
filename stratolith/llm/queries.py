"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, bpe, decontaminate, importance, licenses, packing, quality, runs, secrets, simhash, urls, vectors, wavelet
from stratolith.storage import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine; every executor has it in the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in base],
        F.sha2(secrets.joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and the model's score."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.fit(urls.labelled_urls(spark)))


def op6_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record."""
    return archives.round_trip(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, word and phrase counts and places, labels and score of every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of every benchmark item in a document."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return wavelet.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    # One Python worker a task does both ways.
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, drawn towards the benchmark's words."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, digests of all runs and of the collapsed text of every document."""
    found = runs.find(runs.with_planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best, every = F.col("best"), runs.lines(F.col("runs"))
    return found.withColumn("best", runs.longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_embeddings": op3_embeddings,
    "op4_secrets": op4_secrets,
    "op5_urls": op5_urls,
    "op6_archives": op6_archives,
    "op7_packing": op7_packing,
    "op8_licenses": op8_licenses,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_ids": op10_token_ids,
    "op11_bpe": op11_bpe,
    "op12_importance": op12_importance,
    "op13_runs": op13_runs,
}

#: What SQL can say: exact links, payloads and containment. The rest rests on models, XXH64 or tokenizers.
ORACLE_SQL: dict[str, str] = {
    "op3_embeddings": """
with recursive usable as (
    select vec_id, embedding::double[] v from embeddings
    where len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0
), links as (
    select a.vec_id a, b.vec_id b from usable a join usable b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.9
), reach as (
    select vec_id a, vec_id b from embeddings
    union
    select r.a, l.b from reach r join links l on r.b = l.a
), least as (select a, min(b) component_id from reach group by a)
select vec_id, (select count(*) from links where a = vec_id)::bigint n_links, component_id, vec_id = component_id kept from embeddings join least on a = vec_id""",
    "op6_archives": """
with payloads as (
    select page_id, coalesce(html, '') html, octet_length(encode(coalesce(html, ''))) n, max(page_id) over (partition by coalesce(html, '')) keeper from pages
)
select page_id, n::bigint payload_bytes, sha1(html) payload_digest, case when n >= 1000 and page_id <> keeper then 'revisit' else 'response' end record_type,
    case when n >= 1000 and page_id <> keeper then keeper end refers_to from payloads""",
    "op9_decontaminate": r"""
with texts as (
    select 'd' kind, doc_id id, text from documents union all select 'i', item_id, text from benchmark
), words as (
    select kind, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), lambda w: w <> '') ws from texts where id is not null
), shingles as (
    select distinct kind, id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) shingle from words
), items as (select id, shingle, count(*) over (partition by id) n from shingles where kind = 'i')
select d.id doc_id, i.id item_id, count(*) shared, max(n) item_shingles, count(*)::double / max(n) containment
from shingles d join items i using (shingle) where d.kind = 'd' group by d.id, i.id having count(*) >= ceil(0.8 * max(n) - 1e-9)""",
}
