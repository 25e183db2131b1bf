"""Document revisions: blocks of the old texts, and new texts by a deterministic mutation of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mutation of a document by its id modulo their number; "wrap" changes the layout alone.
MUTATIONS = ("none", "delete", "insert", "number", "move", "replace", "wrap")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(pair_id, block, raw): the lines of every document."""
    return docs.select(F.col(key).alias("pair_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("block", "raw"))


def mutation(key: str = "doc_id"):
    """Name of a document's mutation."""
    return F.element_at(F.lit(list(MUTATIONS)), (F.pmod(F.col(key), F.lit(len(MUTATIONS))) + 1).cast("int"))


def mutate(docs: DataFrame) -> DataFrame:
    """Adds ``mutation`` and ``revised``, the new text.

    delete: the first paragraph of several goes; insert: a new second paragraph; number: the first run of digits becomes
    777; move: the first of three or more paragraphs goes to the end; replace: the first character becomes "#"; wrap: none.
    """
    parts, n = F.split("text", "\n", -1), F.size(F.split("text", "\n", -1))
    kind = mutation()
    new = (
        F.when((kind == "delete") & (n > 1), F.array_join(F.slice(parts, F.lit(2), n), "\n"))
        .when(kind == "insert", F.concat(parts[0], F.lit("\nInserted paragraph "), F.col("doc_id").cast("string"), F.lit("."), F.substring("text", F.length(parts[0]) + 1, F.length("text"))))
        .when(kind == "number", F.regexp_replace("text", r"^([^0-9]*)[0-9]+([\s\S]*)$", "$1777$2"))
        .when((kind == "move") & (n > 2), F.concat_ws("\n", F.array_join(F.slice(parts, F.lit(2), n), "\n"), parts[0]))
        .when(kind == "replace", F.concat(F.lit("#"), F.substring("text", F.lit(2), F.length("text"))))
        .otherwise(F.col("text"))
    )
    return docs.withColumn("mutation", kind).withColumn("revised", new)


def revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the old and of the new revision: (pair_id, block, raw)."""
    docs = mutate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return blocks_of(docs, "text"), blocks_of(docs, "revised")
