"""The ten operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from redraft.llm import ann, language_id, line_dedup, packing, pii, sentencepiece_bpe, simhash, token_counts, topk, url_filter
from redraft.llm.common import Scratch, table

PIECES, WORDS, BYTES = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"

#: Fixed rules of the URL filter: (verdict, host and path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest by cosine of every 50th vector, among all vectors."""
    return ann.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at 4 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 32k-piece vocabulary."""
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: whether it is kept, and the first line of its component."""
    return line_dedup.duplicates(table(spark, sf_dir, "documents"), size=9, bands=8, rows=3, least=0.8)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; crossing tokens count where they begin."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), rule="first")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), capacity=4096, end_id=1)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, all spans."""
    found = pii.with_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "spans")
    kept = Scratch(spark, "pii").keep(found.select("doc_id", "spans"), "candidates")
    return pii.digest(pii.decided(kept, "spans"), "spans", "doc_id")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest integer inner products of every 50th vector, among all vectors, exactly."""
    return topk.search(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {f.__name__: f for f in (op1_ann, op2_simhash, op3_sentencepiece, op4_line_dedup, op5_token_counts, op6_language_id, op7_best_fit_packing, op8_pii, op9_topk, op10_url_filter)}

#: DuckDB SQL where it can express a query.
ORACLES: dict[str, str] = {
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r, vec_id, score FROM scored
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
    """,
}
