"""Keyed populations, multisets and relations: what is matched, absent, changed or unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_presence(old: DataFrame, new: DataFrame, key: str, complete_old: bool = True, complete_new: bool = True) -> DataFrame:
    """(key, status): Matched, or for a key on one side AbsentInDocument, PresentOnly or Unknown.

    Absence holds only against a complete population with unique names; where both sides have keys of their own a rename is possible,
    and those are PresentOnly.
    """
    a = old.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("a"))
    b = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer")
    facts = both.agg(
        F.coalesce(F.max(F.col("a").isNotNull() & F.col("b").isNull()), F.lit(False)).alias("only_old"),
        F.coalesce(F.max(F.col("b").isNotNull() & F.col("a").isNull()), F.lit(False)).alias("only_new"),
        F.coalesce(F.max((F.col("a") > 1) | (F.col("b") > 1)), F.lit(False)).alias("repeated"),
    )
    closed = F.lit(complete_old and complete_new)
    status = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "Matched").when(F.col("repeated") | ~closed, "Unknown").when(F.col("only_old") & F.col("only_new"), "PresentOnly").otherwise("AbsentInDocument")
    return both.crossJoin(F.broadcast(facts)).select(key, status.alias("status"))  # one row of facts


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value, changed): fields of matched keys; unresolved (null) values are never equal and never changed."""

    def long(rows: DataFrame, value: str) -> DataFrame:
        return rows.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(value)) for f in fields])).alias("x")).select(key, f"x.field", f"x.{value}")

    both = long(old, "old_value").join(long(new, "new_value"), [key, "field"])
    return both.withColumn("changed", F.col("old_value") != F.col("new_value"))


def multiset_cancel(old: DataFrame, new: DataFrame, value: str, slot: str) -> DataFrame:
    """(slot_old, slot_new, value, status) of what equal values on both sides don't cancel.

    The n-th of equal values cancels the n-th; of the rest, a slot left on both sides is Changed, others Removed or Added.
    """
    order = Window.partitionBy(value).orderBy(slot)
    a = old.select(value, slot, F.row_number().over(order).alias("_n"))
    b = new.select(value, slot, F.row_number().over(order).alias("_n"))
    left = a.join(b.select(value, "_n"), [value, "_n"], "left_anti").select(slot, F.col(value).alias("old_value"))
    right = b.join(a.select(value, "_n"), [value, "_n"], "left_anti").select(slot, F.col(value).alias("new_value"))
    both = left.join(right, slot, "full_outer")
    status = F.when(F.col("old_value").isNull(), "Added").when(F.col("new_value").isNull(), "Removed").otherwise("Changed")
    return both.select(slot, "old_value", "new_value", status.alias("status"))


def relations(old: DataFrame, new: DataFrame, accepted: DataFrame) -> DataFrame:
    """(from_key, to_key, status): edges whose both endpoints have counterparts, by their presence on either side.

    ``accepted``: (old, new) pairs of nodes. Edges with an endpoint without counterpart are left out.
    """
    a, b = accepted.select(F.col("old").alias("src"), F.col("new").alias("from_key")), accepted.select(F.col("old").alias("dst"), F.col("new").alias("to_key"))
    mapped = old.select("src", "dst").distinct().join(a, "src").join(b, "dst").select("from_key", "to_key", F.lit(1).alias("_o"))
    ends = accepted.select(F.col("new").alias("k"))
    there = new.select(F.col("src").alias("from_key"), F.col("dst").alias("to_key"), F.lit(1).alias("_n")).distinct()
    there = there.join(ends.withColumnRenamed("k", "from_key"), "from_key", "left_semi").join(ends.withColumnRenamed("k", "to_key"), "to_key", "left_semi")
    both = mapped.join(there, ["from_key", "to_key"], "full_outer")
    return both.select("from_key", "to_key", F.when(F.col("_n").isNull(), "Removed").when(F.col("_o").isNull(), "Added").otherwise("Kept").alias("status"))


def cells(rows: DataFrame, row_key: str, column_key: str, value: str) -> DataFrame:
    """(row_key, column_key, value) of cells whose two keys name exactly one cell."""
    own = rows.groupBy(row_key, column_key).agg(F.count("*").alias("_n"), F.min(value).alias(value))
    return own.where("_n = 1").drop("_n")
