"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and deviation. From those alone, for segments
of length L, an inner product is at most the sum of L * (mean * mean' + deviation * deviation'),
which is the same bound as one on the distance from below. Bounds are taken coarse to fine (few long
segments, then more short ones); what a bound leaves in reach of the query's k-th best
score is compared exactly. The result is exact whatever the bounds prune. That depends on the vectors: where all dimensions
vary alike and apart, as noise does, only segments of a few dimensions tell much, so the last level has many.

All rows are compared with the stated queries in blocks: no task holds more than ``block_rows`` vectors
and ``batch_rows`` queries, and equal vectors are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm.common import Scratch, arrow_map
from redraft.llm.vectors import best, classes, expand, matrix, ranked, valid

#: Share of pairs in reach beyond which a dense product is cheaper than gathering the pairs; both give the same.
DENSE = 0.02
_LONG = 2**63


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of a row's segments, each times the root of the segment's length: 2 * segments columns."""
    bounds = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        rest = part - mean[:, None]
        out += [mean * np.sqrt(b - a), np.sqrt((rest * rest).sum(axis=1))]
    return np.stack(out, axis=1)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of matching rows; beyond the range of long they stay at its ends."""
    if x.shape[1] * max(np.abs(x).max(initial=0), 1) * max(np.abs(q).max(initial=0), 1) < 2**53:
        return (x * q).sum(axis=1).astype(np.int64)
    own = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(x, q, strict=True)]
    return np.asarray([min(max(v, -_LONG), _LONG - 1) for v in own], np.int64)


def reached(x: np.ndarray, q: np.ndarray, least: np.ndarray, levels: tuple[int, ...], known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) with their exact scores, of all that reach the query's least useful score.

    Bounds are tested coarse to fine. While they leave many pairs, those stay a mask and are computed as dense products; few
    pairs are gathered. Both ways give the same.
    """
    mask, rows, cols = np.ones((len(q), len(x)), bool), None, None
    for level in levels:
        a, b = known[level], statistics(q, level)
        slack = 1e-9 * (1 + np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum(axis=1)).max(initial=0))  # rounding
        if rows is None:
            mask &= b @ a.T >= (least - slack)[:, None]
            if np.count_nonzero(mask) <= DENSE * mask.size:
                rows, cols = np.nonzero(mask)
        else:
            left = np.einsum("ij,ij->i", b[rows], a[cols]) >= (least - slack)[rows]
            rows, cols = rows[left], cols[left]
    small = x.shape[1] * max(np.abs(x).max(initial=0), 1) * max(np.abs(q).max(initial=0), 1) < 2**53
    if rows is None and small:  # whole numbers below 2 ** 53: the dense product is exact
        dense = q @ x.T
        rows, cols = np.nonzero(mask & (dense >= least[:, None]))
        return rows, cols, dense[rows, cols].astype(np.int64)
    if rows is None:
        rows, cols = np.nonzero(mask)
    parts = [exact(x[cols[i : i + 65536]], q[rows[i : i + 65536]]) for i in range(0, len(rows), 65536)]
    return rows, cols, np.concatenate(parts) if parts else np.zeros(0, np.int64)


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", levels: tuple[int, ...] = (1, 4, 16, 32), block_rows: int = 16384, batch_rows: int = 8192, seed_rows: int = 8192
) -> DataFrame:
    """Each query's k largest integer inner products; queries are the rows whose id is divisible by ``every``.

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id, score (long), ties to the smaller id. Null ids
    and vectors that are null, of another dimension or hold null or non-finite components take no part; zero vectors do. Rows
    that repeat an id and its vector count once; a query's own id is no candidate. Fewer candidates than k give
    fewer rows, an empty table none. Scores beyond long stay at its ends. About ``seed_rows`` distinct
    vectors, by hash, give each query's first least score (a bound only; it prunes nothing that belongs in the result).
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.keep(valid(vectors, id_col, vec_col, lambda x: np.floor(scale * x)), "rows")
    known = scratch.keep(classes(rows, k), "classes")
    queries = rows.where(F.col("id") % every == 0)
    n = known.count()
    size = min(block_rows, max(256, -(-n // 64)))  # at least 64 blocks where there are rows for them
    blocks = max(1, -(-n // size))
    batches = max(1, -(-queries.select("cls").distinct().count() // batch_rows))
    share = min(1.0, seed_rows / max(n, 1))  # by hash, so the same at any partitioning; twice seed_rows never comes up by chance
    sample = known.where(F.xxhash64("cls") <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))).select("key").limit(2 * seed_rows).toArrow()
    shared = spark.sparkContext.broadcast(matrix(sample.column(0)))

    def bound(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in rows:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                least = np.full(len(part), -np.inf)
                if len(seeds) > k + 1:  # the (k + 2)-th best of distinct vectors: the query's own may be among them
                    scores = matrix(part.column(1)) @ seeds.T
                    least = np.partition(scores, len(seeds) - k - 2, axis=1)[:, len(seeds) - k - 2]
                    least = least - 1e-9 * np.abs(least) - 1e-6
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least)], ["cls", "key", "least"])

    asked = scratch.keep(arrow_map(queries.groupBy("cls").agg(F.first("key").alias("key")), bound, "cls binary, key binary, least double"), "asked")
    salt = F.xxhash64("cls")
    left = known.select("*", F.pmod(salt, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    right = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(salt, F.lit(batches)).cast("int").alias("batch"))

    def compare(near: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = pa.table({"cls": pa.array([], pa.binary()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not near.num_rows or not wanted.num_rows:
            return empty
        x, q, ids = matrix(near["key"]), matrix(wanted["key"]), near["ids"].to_pylist()
        least, first = wanted["least"].to_numpy(), np.fromiter((i[0] for i in ids), np.int64, len(ids))
        stats = {level: statistics(x, level) for level in levels}
        owners, found, scores = [], [], []
        for a in range(0, len(q), 512):
            owner, row, score = reached(x, q[a : a + 512], least[a : a + 512], levels, stats)
            if not len(owner):
                continue
            top = best(first[row], owner, score, k + 1)
            every_id, place = expand(ids, row[top])
            owner, score = owner[top][place], score[top][place]
            top = best(every_id, owner, score, k + 1)
            owners.append(owner[top] + a)
            found.append(every_id[top])
            scores.append(score[top])
        if not owners:
            return empty
        return pa.table({"cls": wanted["cls"].combine_chunks().take(pa.array(np.concatenate(owners))), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    key = ["block", "batch"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "cls binary, vec_id long, score long")
    return ranked(found, queries.select("id", "cls").distinct(), k)
