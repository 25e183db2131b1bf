"""Connected components by distributed union-find: alternating large and small stars.

DataFrame operations only. A round links every node's larger neighbours to the least node it
knows (large star), then every node and its smaller neighbours to the least of them (small star);
rounds end when all links are stars. Each step is written to the shared folder, so lineage stays
short and plain joins of written tables remain, whose hot keys (a hub with very many links) Spark
can split. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the least node in reach.

    Links to oneself and with a null end are ignored, repeated links count once. No links: no rows.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    now = scratch.keep(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("hi"), lo.alias("lo")).distinct(), "links-0")
    turn = 0
    while not _stars(now):
        turn += 1
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("least"))
        large = both.where("v > u").join(least, "u").where("v <> least").select(F.col("v").alias("hi"), F.col("least").alias("lo"))
        large = scratch.keep(large.distinct(), f"large-{turn}")
        least_small = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(least_small, "hi").select(F.explode(F.array(F.struct("hi", F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("x"))
        small = scratch.keep(small.select("x.*").where("hi <> lo").distinct(), f"links-{turn}")
        for old in (f"links-{turn - 1}", f"large-{turn}"):
            scratch.drop(old)
        now = small
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every node links to one smaller node at most and those to none: then that one is its component's least."""
    both = links.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = both.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
