"""Coverage, summaries, review cases and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(spans: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., total, resolved, ratio): tokens covered by the union of [start, end) intervals; ratio null without tokens.

    The union comes from islands: an interval that starts beyond all ends before it opens a new one.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.col("start"))), F.lit(0))
    own = spans.where("end > start").withColumn("_add", added).groupBy(*keys).agg(F.sum("_add").alias("resolved"))
    return totals.join(own, keys, "left").select(*keys, "total", F.coalesce("resolved", F.lit(0)).alias("resolved"), F.when(F.col("total") > 0, F.coalesce("resolved", F.lit(0)) / F.col("total")).alias("ratio"))


def outcome(changes: Column, unresolved: Column) -> Column:
    """Detected if anything changed, else NoContentChange if nothing is unresolved, else Indeterminate."""
    return F.when(changes > 0, "Detected").when(unresolved == 0, "NoContentChange").otherwise("Indeterminate")


def exit_status(failed: Column, incomplete: Column, detected: Column) -> Column:
    """2 before 3 before 1 before 0."""
    return F.when(failed, 2).when(incomplete, 3).when(detected, 1).otherwise(0)


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(keys..., n, least, p50, p95, most): percentiles as the element at ceil(n * p / 100), nulls left out."""
    own = rows.where(F.col(value).isNotNull())
    ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    picks = [F.max(F.when(F.col("_r") == F.ceil(F.col("_n") * p / 100), F.col(value))).alias(f"p{p}") for p in percents]
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("least"), *picks, F.max(value).alias("most"))


def precision_recall(actual: DataFrame, expected: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., tp, fp, fn, precision, recall, f1): events matched one to one by equal keys; ratios of sums, null over zero."""
    by = by or []
    order = Window.partitionBy(*keys).orderBy(F.lit(1))
    a = actual.withColumn("_n", F.row_number().over(order)).select(*keys, "_n", F.lit(1).alias("_a"))
    e = expected.withColumn("_n", F.row_number().over(order)).select(*keys, "_n", F.lit(1).alias("_e"))
    both = a.join(e, [*keys, "_n"], "full_outer").groupBy(*by).agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_e").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("_e").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_a").isNull(), 1)).alias("fn"))
    p, r = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    return both.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def cardinality(old: Column, new: Column) -> Column:
    """Class of a review case by the sizes of its sides."""
    return F.when(old == 0, "0:new").when(new == 0, "old:0").when((old == 1) & (new == 1), "1:1").when(old == 1, "1:N").when(new == 1, "N:1").otherwise("N:M")


def pages(rows: DataFrame, group: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Adds ``page``: rows in order, cut into pages whose running size stays in steps of the budget."""
    before = F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("page", F.floor(F.coalesce(before, F.lit(0)) / budget).cast("int"))


def sections(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``section``: the nearest numbered heading (``1.2 Title``, ``A. Title``, ``Appendix B``) at or above a block, null before the first."""
    heading = F.when(F.col(text).rlike(r"^(?:[0-9]+(?:\.[0-9]+)*\.?|[A-Z]\.|Appendix [A-Z0-9]+)[ ]\S") & (F.length(text) <= 120), F.col(text))
    return blocks.withColumn("section", F.last(heading, ignorenulls=True).over(Window.partitionBy("pair_id").orderBy("block")))


def count_witness(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., witnesses): tokens that must stand more often on one side than they can on the other.

    Inputs: (keys..., token, required, possible) counts. A witness proves a change; none proves nothing.
    """
    both = old.select(*keys, "token", F.col("required").alias("ro"), F.col("possible").alias("po")).join(new.select(*keys, "token", F.col("required").alias("rn"), F.col("possible").alias("pn")), [*keys, "token"], "full_outer").na.fill(0)
    return both.where((F.col("ro") > F.col("pn")) | (F.col("rn") > F.col("po"))).groupBy(*keys).agg(F.count("*").alias("witnesses"))


def _sweep(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., a, b, both): tokens in the union of each side's spans, and in both; one sort of all ends instead of a join of spans."""
    sides = [side.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"), F.lit(n).alias("side")) for n, side in enumerate((actual, expected))]
    ends = sides[0].union(sides[1]).groupBy(*keys, F.col("e.at").alias("at")).agg(*[F.sum(F.when(F.col("side") == n, F.col("e.d")).otherwise(0)).alias(f"d{n}") for n in (0, 1)])
    order = Window.partitionBy(*keys).orderBy("at")
    steps = ends.select(*keys, (F.lead("at").over(order) - F.col("at")).alias("n"), *[(F.sum(f"d{n}").over(order) > 0).alias(f"in{n}") for n in (0, 1)])
    return steps.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for name, c in (("a", F.col("in0")), ("b", F.col("in1")), ("both", F.col("in0") & F.col("in1")))])


def span_overlap(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., both, either, iou): tokens in common of two tables of spans [start, end), and in either."""
    out = _sweep(actual, expected, keys)
    either = F.col("a") + F.col("b") - F.col("both")
    return out.select(*keys, "both", either.alias("either"), F.when(either > 0, F.col("both") / either).alias("iou"))


def token_metrics(actual: DataFrame, expected: DataFrame, totals: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by..., tp, fp, fn, precision, recall, f1, unchanged, fp_per_10k): changed tokens reported against those expected.

    Inputs are spans [start, end) by keys, and (keys..., by..., total) tokens. Counts are summed before any ratio; precision and recall over nothing are 1, the rate over nothing 0; f1 is their harmonic mean, 0 where both are.
    """
    met = totals.join(_sweep(actual, expected, keys), keys, "left").na.fill(0, ["a", "b", "both"])
    out = met.groupBy(*by).agg(F.sum("both").alias("tp"), F.sum(F.col("a") - F.col("both")).alias("fp"), F.sum(F.col("b") - F.col("both")).alias("fn"), F.sum(F.col("total") - F.col("b")).alias("unchanged"))

    def share(whole: Column) -> Column:
        return F.when(whole > 0, F.col("tp") / whole).otherwise(1.0)

    rate = F.when(F.col("unchanged") > 0, 10000 * F.col("fp") / F.col("unchanged")).otherwise(0.0)
    p, r = share(F.col("tp") + F.col("fp")), share(F.col("tp") + F.col("fn"))
    return out.select(*by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "unchanged", rate.alias("fp_per_10k"))


def preflight(work: DataFrame, order: list[str], cost: str, budget: int) -> DataFrame:
    """Adds ``spent`` (running cost within a document, this row included) and ``incomplete``: rows at and after the first that goes beyond the budget."""
    w = Window.partitionBy("pair_id").orderBy(*order)
    return work.withColumn("spent", F.sum(cost).over(w)).withColumn("incomplete", F.col("spent") > budget)


def compact(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys..., n, first, last, digest): a list of sources as its count, its ends and a SHA-256 over all of it in order."""
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("l"))
    return listed.select(*keys, F.size("l").alias("n"), F.element_at("l", 1).v.alias("first"), F.element_at("l", -1).v.alias("last"), F.sha2(F.array_join(F.transform("l", lambda x: x.v), "\n"), 256).alias("digest"))


def brackets(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(pair_id, block, before, after): the nearest anchors at or before and at or after each block; null beyond the ends."""
    marked = blocks.select("pair_id", "block").join(anchors.select("pair_id", F.col("old").alias("block"), F.col("old").alias("_a")), ["pair_id", "block"], "left")
    w = Window.partitionBy("pair_id").orderBy("block")
    return marked.select("pair_id", "block", F.last("_a", ignorenulls=True).over(w).alias("before"), F.first("_a", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("after"))


def quality(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., documents, expected, detected, false_alarms, right_kind, recall, kind_accuracy) of rows with the Booleans expected, detected and right_kind; a ratio over nothing is null."""
    hit = F.col("expected") & F.col("detected")
    sums = rows.groupBy(*by).agg(F.count("*").alias("documents"), F.count_if("expected").alias("expected"), F.count_if(hit).alias("detected"), F.count_if(~F.col("expected") & F.col("detected")).alias("false_alarms"), F.count_if(hit & F.col("right_kind")).alias("right_kind"))
    return sums.withColumn("recall", F.when(F.col("expected") > 0, F.col("detected") / F.col("expected"))).withColumn("kind_accuracy", F.when(F.col("detected") > 0, F.col("right_kind") / F.col("detected")))


def retained(rows: DataFrame, text: str, most: int, source: Column) -> DataFrame:
    """Replaces a text by ``kept``, its first ``most`` code points, ``omitted``, the number left out, and ``expand``, the range of ``source`` that holds them (null without any)."""
    n = F.length(text).cast("long")
    expand = F.when(n > most, F.concat(source, F.lit(f"#{most}-"), n))
    return rows.select(*[c for c in rows.columns if c != text], F.substring(text, 1, most).alias("kept"), F.greatest(n - most, F.lit(0)).cast("long").alias("omitted"), expand.alias("expand"))
