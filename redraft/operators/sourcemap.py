"""Source maps: where a block's canonical text comes from in its raw text, and ranges taken back to the raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redraft.functions import text as tx

_B, _L = tx.BLANKS[1:-2], "".join(tx.LIGATURES)
#: A ligature, a run of blanks, or a run of others: plain classes, which need no stack however long a line is.
_PIECES = rf"[{_L}]|[{_B}]+|[^{_B}{_L}]+"


def events(blocks: DataFrame) -> DataFrame:
    """(pair_id, block, raw_start, raw_end, start, end, kind): pieces of the raw text that the canonical text changes.

    All else stands at its place moved by the lengths that these pieces gained or lost. Blocks without such pieces (null
    and empty ones too) have no rows and take no part in the shuffle.
    """
    cut = blocks.where(F.col("raw") != tx.canonical(F.col("raw")))
    piece = cut.select("pair_id", "block", F.posexplode(F.regexp_extract_all("raw", F.lit(_PIECES), F.lit(0))).alias("_k", "_raw")).withColumn("_to", tx.canonical(F.col("_raw")))
    before = Window.partitionBy("pair_id", "block").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    placed = piece.withColumn("raw_end", F.sum(F.length("_raw")).over(before)).withColumn("end", F.sum(F.length("_to")).over(before))
    kind = F.when(F.col("_raw").rlike(f"^[{_L}]$"), "ligature").otherwise("blank")
    return placed.where("_raw <> _to").select("pair_id", "block", (F.col("raw_end") - F.length("_raw")).alias("raw_start"), "raw_end", (F.col("end") - F.length("_to")).alias("start"), "end", kind.alias("kind"))


def _boundary(at: Column, inside: str) -> tuple[Column, Column]:
    """A canonical boundary's raw place, and whether it lies within one source."""
    moved = F.aggregate(F.filter("_events", lambda e: e["end"] <= at), at.cast("long"), lambda a, e: a + (e["raw_end"] - e["raw_start"]) - (e["end"] - e["start"]))
    held = F.filter("_events", lambda e: (e["start"] < at) & (at < e["end"]))
    return F.when(F.size(held) > 0, F.get(held, F.lit(0))[inside]).otherwise(moved), F.size(held) > 0


def project(ranges: DataFrame, found: DataFrame) -> DataFrame:
    """(pair_id, block, start, end, raw_start, raw_end, precision): canonical ranges as raw ones.

    A boundary inside the letters of one ligature widens to the ligature, with precision ``WithinSource``; all else is
    ``Exact``. A block's pieces are gathered in one row: they are bounded by its text, which is one row already.
    """
    own = found.groupBy("pair_id", "block").agg(F.collect_list(F.struct("raw_start", "raw_end", "start", "end")).alias("_events"))
    none = F.array().cast("array<struct<raw_start:bigint,raw_end:bigint,start:bigint,end:bigint>>")
    both = ranges.join(own, ["pair_id", "block"], "left").withColumn("_events", F.coalesce("_events", none))
    (left, within_left), (right, within_right) = _boundary(F.col("start"), "raw_start"), _boundary(F.col("end"), "raw_end")
    return both.select("pair_id", "block", "start", "end", left.alias("raw_start"), right.alias("raw_end"), F.when(within_left | within_right, "WithinSource").otherwise("Exact").alias("precision"))
