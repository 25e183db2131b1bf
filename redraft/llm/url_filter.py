"""URL filter: longest-rule verdicts, else the ratio of two character language models.

Two smoothed variable-order Markov models (interpolated Witten-Bell, contexts of 0 to 3
symbols) are learned from the URLs that rules accept and reject. A URL that no rule fits
is judged by the difference of its two log-likelihoods divided by its length; the cut is
calibrated on labelled URLs that the models haven't seen.

Size: a model is a dense table over a fixed alphabet, ``SIZE ** 4`` cells (8.3 million)
whatever the input; what reaches the driver are its non-zero counts and a score histogram.
All labelled URLs are counted, in one pass with partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm.common import arrow_map, lower_ascii

#: The alphabet of the models (upper case counts as lower); 0 is the start, the last is any other byte.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.:-_?=&%#~+,@"
SIZE, ORDER = len(ALPHABET) + 2, 3
_CODES = np.full(256, SIZE - 1, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _i + 1
#: Scores are calibrated on a histogram of so many bins of this width around 0.
BINS, WIDTH = 2000, 0.01
_MODELS: dict[int, np.ndarray] = {}


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``, literally as the text between the marks; null or no ``://``: both empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    return (
        pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("_host", host)
        .withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0))
        .withColumn("host", lower_ascii(F.col("_host")))
        .drop("_rest", "_host")
    )


def rule_column(rules: Sequence[tuple[str, str]]):
    """The longest rule that fits ``host`` and ``path``, as struct(rule, verdict), or null.

    ``rules``: (verdict, "host/path") pairs; a short list, since it becomes one expression.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _cells(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all (3 before, symbol) cells of the URLs, and where each URL's begin (none for empty ones)."""
    lengths = np.fromiter(map(len, urls), np.int64, len(urls))
    flat = _CODES[np.frombuffer(b"".join(urls), np.uint8)]
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(flat)) - np.repeat(starts, lengths)
    code = flat.copy()
    for back in range(1, ORDER + 1):
        before = np.zeros_like(flat)
        before[back:] = flat[:-back] if back <= len(flat) else 0
        before[place < back] = 0
        code += before * SIZE**back
    return code, starts


def _log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Interpolated Witten-Bell, from the shortest context up: longer ones add as far as they were seen."""
    counts = counts.reshape((SIZE,) * (ORDER + 1)).astype(np.float64)
    p = np.full(SIZE, 1.0 / SIZE)
    for order in range(ORDER + 1):
        n = counts.sum(axis=tuple(range(ORDER - order)))
        kinds = (n > 0).sum(axis=-1, keepdims=True)
        total = n.sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p).astype(np.float32).reshape(-1)


def _utf8(column: pa.Array) -> list[bytes]:
    return [x.encode() if x else b"" for x in column.to_pylist()]


def _score(table: np.ndarray, urls: list[bytes]) -> np.ndarray:
    """Mean log-likelihood difference per symbol, accepted less rejected; 0 for empty URLs."""
    out = np.zeros(len(urls))
    code, starts = _cells(urls)
    full = np.fromiter((len(u) > 0 for u in urls), bool, len(urls))
    if full.any():
        sums = np.add.reduceat(table[code].astype(np.float64), starts[full])
        out[full] = sums / np.fromiter(map(len, urls), np.int64, len(urls))[full]
    return out


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Judge every URL. Returns ``id_col``, host, path, rule, verdict, score.

    ``rule`` is the longest rule that fits (null if none), ``verdict`` is the rule's or, without
    a rule, ``block`` where ``score`` (models' log-likelihood difference per byte) lies under
    the calibrated cut. Null and empty URLs score 0. Where rules leave one class without
    URLs there is nothing to compare: ``default`` holds for all URLs without a rule. Repeated
    rows count and return as often as they stand; other columns are not read.
    """
    spark = pages.sparkSession
    parted = split_url(pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_url")), "_url").withColumn("_fit", rule_column(rules))
    known = parted.where("_fit is not null").select("_url", (F.col("_fit.verdict") == "allow").alias("good"), (F.expr("pmod(crc32(_url), 5)") == 0).alias("apart"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, good = _utf8(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for kind in (True, False):
                code, n = np.unique(_cells([u for u, g in zip(urls, good, strict=True) if g == kind])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.full(len(code), kind)), pa.array(n)], ["code", "good", "n"])

    seen = arrow_map(known.where("not apart").select("_url", "good"), count, "code long, good boolean, n long").groupBy("code", "good").agg(F.sum("n").alias("n")).toPandas()
    cut, table = None, None
    if seen.good.nunique() == 2:
        both = []
        for kind in (True, False):
            counts = np.zeros(SIZE ** (ORDER + 1), np.int64)
            counts[seen.code[seen.good == kind]] = seen.n[seen.good == kind]
            both.append(_log_probabilities(counts))
        table = spark.sparkContext.broadcast(both[0] - both[1])
        cut = _cut(_scored(known.where("apart").select("_url", "good"), table, "good boolean").groupBy(F.expr(f"least(greatest(cast(floor(score / {WIDTH}) as int), {-BINS // 2}), {BINS // 2 - 1})").alias("bin"), "good").count().toPandas())
    rows = parted.select("_url", id_col, "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("by_rule"))
    kind = rows.schema[1].dataType.simpleString()
    if table is None:
        rows = rows.withColumn("score", F.lit(0.0))
        other = F.lit(default)
    else:
        rows = _scored(rows, table, f"`{id_col}` {kind}, host string, path string, rule string, by_rule string")
        other = F.when(F.col("score") < cut, "block").otherwise("allow")
    return rows.select(id_col, "host", "path", "rule", F.coalesce("by_rule", other).alias("verdict"), "score")


def _scored(rows: DataFrame, table, others: str) -> DataFrame:
    """The rows without their first column, the URL, and with its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _score(table.value, _utf8(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*batch.schema.names[1:], "score"])

    return arrow_map(rows, run, f"{others}, score double")


def _cut(histogram) -> float:
    """The cut with the least balanced error on URLs apart; of equal ones the middle; 0 if a class is missing."""
    counts = np.zeros((2, BINS))
    for b, good, n in zip(histogram.bin, histogram.good, histogram["count"], strict=True):
        counts[int(good), int(b) + BINS // 2] += n
    if not counts.sum(axis=1).all():
        return 0.0
    share = np.concatenate([np.zeros((2, 1)), counts.cumsum(axis=1) / counts.sum(axis=1, keepdims=True)], axis=1)
    error = share[1] + 1 - share[0]  # accepted below the cut, rejected from it on
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float((best[len(best) // 2] - BINS // 2) * WIDTH)
