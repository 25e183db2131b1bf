"""A training-data pipeline of five operators over ``documents``; each stage's result is the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redraft.llm import language_id, line_dedup, packing, pii, simhash
from redraft.llm.common import Scratch, as_columns, table

#: A predicted language whose posterior is lower is rejected.
LEAST_POSTERIOR = 0.5
#: Words that a Python worker remembers: fewer than an operator alone may, as its stages' workers and heap stay around.
MEMO = 100_000
#: Rows that go to a Python worker at once.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once; results don't depend on it. ``run`` restores the setting; who calls a stage alone keeps it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with confidence, with that language, learned from all of them; without letters they go."""
    _small_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    languages, pieces = language_id.train(docs, model, memo=MEMO)
    found = language_id.predict(docs, model, languages, pieces, memo=MEMO)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR))
    return as_columns(kept.withColumn("lang", F.col("lang_pred")), docs.columns)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that nearly repeat an earlier one; documents of nothing else go."""
    return line_dedup.deduplicate(docs, size=9, bands=8, rows=3, least=0.8)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal fingerprints."""
    _small_batches(spark)
    return simhash.deduplicate(docs, radius=4)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the kind in place of personal data, and their new lengths; other columns may have any name."""
    nested = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc"), F.col("text"))
    found = Scratch(spark, "pii").keep(pii.with_candidates(nested, "text", "spans"), "candidates")
    out = pii.masked(pii.decided(found, "spans"), "text", "spans")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(n, F.col("doc").getField(n)).alias(n) for n in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of at most 4096 tokens."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, memo=MEMO, slice_bytes=4 << 20)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("simhash", deduplicate_documents),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the stages (models, MinHash, tokenizers); tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    Null and empty texts hold no letter, so they go in the first stage; repeated rows stay until the near-duplicate stage, which keeps
    one of equal texts. An empty table gives an empty result.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    setting, last = "spark.sql.execution.arrow.maxRecordsPerBatch", None
    before = spark.conf.get(setting)
    try:
        for name, stage in STAGES:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
            if last:
                scratch.drop(last)
            last = name
    finally:
        spark.conf.set(setting, before)
    return docs
