"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from pairloom.llm import merkle, sql
from pairloom.llm.conversations import prefix_trie
from pairloom.llm.decontaminate import contamination
from pairloom.llm.language_model import score_texts
from pairloom.llm.licenses import LEAST, PHRASES, TEMPLATES, scan_licenses
from pairloom.llm.minhash import near_duplicates
from pairloom.llm.mixing import plan_mix, taken_words
from pairloom.llm.pii import find_pii, pii_digest
from pairloom.llm.quality import fold, score_documents, train_classifier
from pairloom.llm.suffix_dedup import remove_repeats
from pairloom.llm.token_counts import count_tokens
from pairloom.llm.vector_join import vector_links
from pairloom.llm.warc import read_bundles, write_bundles
from pairloom.session import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(function):
    LLM_QUERIES[function.__name__] = function
    return function


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary, limit=1024)


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(plan_mix(table(spark, sf_dir, "documents")))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = write_bundles(table(spark, sf_dir, "pages"))
    return read_bundles(bundles, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


LLM_ORACLE["op7_warc"] = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS body FROM pages
), hashed AS (
    SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
           sha256(body) AS payload_digest
    FROM payloads
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id
            THEN first_id END AS refers_to
FROM firsts
"""


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_classifier(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    scored = score_documents(docs, model, threshold=0.3, keep=("doc_id",))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, least=0.8).select("doc_id", "class_id", "kept")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs, items, least=0.8)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op8_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"), least=0.98)


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), folds=7, held=2)


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = merkle.tampered_leaf(DOCUMENT, "text", "doc_id", every=3)
    rows = merkle.manifest(docs, DOCUMENT, "doc_id", "lang", {"changed": changed})
    folded = merkle.verified(rows.withColumn("now", F.coalesce("changed", "leaf")), "now")
    return folded.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


LLM_ORACLE["op12_merkle"] = sql.MERKLE


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


LLM_ORACLE["op13_prefix_trie"] = sql.TRIE


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), TEMPLATES, PHRASES, LEAST)


LLM_ORACLE["op11_license_scan"] = sql.licenses(PHRASES, TEMPLATES, LEAST)
