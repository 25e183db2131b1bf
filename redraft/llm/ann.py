"""Approximate nearest neighbours by adaptive dimension scan within probed lists.

Vectors are scaled to length one, rotated at random and dealt to lists by their nearest centre. A
query reads the lists of its nearest centres. Within a list, vectors lie in column blocks: after each
block of dimensions the partial distance is an estimate of the whole one (the rotation makes
any dimensions a fair sample), and a hypothesis test abandons the candidates whose distance
exceeds the query's k-th best with high confidence. Survivors are compared exactly, in double
precision, on the original vectors.

Every vector is indexed. Centres are fitted on a bounded sample (``fit_rows`` distinct vectors, those
whose hash falls into a share of the range). Lists are read in two turns, so that the threshold of the tests adapts: the nearest ones first,
with a first bound from the sample's vectors in the lists that the query reads; what they give bounds the k-th best distance
for the others. Results come from lists alone, never from the sample. A query whose first turn gives too few reads all its lists without tests.
Long lists are dealt to blocks and many queries of a list to batches, so that no task holds more than
``block_rows`` vectors and queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redraft.llm.common import Scratch, arrow_map
from redraft.llm.vectors import best, classes, expand, matrix, ranked, valid


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # first to a largest component of one: no overflow
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nonzero(x: np.ndarray) -> np.ndarray:
    return np.where(np.any(x != 0, axis=1, keepdims=True), x, np.nan)


def fit(sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, centres of rotated unit vectors): spherical k-means from a seeded start."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    x = _unit(sample) @ rotation
    centres = x[rng.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return rotation, centres


def scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray, columns: int, confidence: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each query row, the rows of ``x`` that the tests leave (squared distances, ``bound`` likewise)."""
    dim = x.shape[1]
    blocks = [slice(c, min(c + columns, dim)) for c in range(0, dim, columns)]
    by_block = [np.ascontiguousarray(x[:, c]) for c in blocks]
    head, first = by_block[0], blocks[0]
    squares = (head * head).sum(axis=1)

    def limit(seen: int) -> np.ndarray | float:
        return (seen / dim) * (1 + confidence / np.sqrt(seen)) ** 2 if seen < dim else 1.0

    for a in range(0, len(q), 256):
        part = q[a : a + 256, first]
        near = (part * part).sum(axis=1)[:, None] + squares - 2 * (part @ head.T)
        keep = near <= bound[a : a + 256, None] * limit(first.stop) + 1e-9
        for i in range(len(part)):
            rows = np.flatnonzero(keep[i])
            partial = near[i, rows]
            for c, columns_of in zip(blocks[1:], by_block[1:], strict=True):
                if not len(rows):
                    break
                gap = columns_of[rows] - q[a + i, c]
                partial = partial + (gap * gap).sum(axis=1)
                left = partial <= bound[a + i] * limit(c.stop) + 1e-9
                rows, partial = rows[left], partial[left]
            yield a + i, rows


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = 16384, probed: float = 0.7, least_probed: int = 24, first_turn: float = 0.2, block_rows: int = 2048, columns: int = 16, confidence: float = 2.1
) -> DataFrame:
    """Each query's k nearest by cosine; queries are the rows whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score (cosine of the original vectors, double), nearest first, ties to the smaller
    id. Null ids and vectors that are null, zero, of another dimension or hold null or non-finite components take no part. Rows that repeat
    an id and its vector count once; a query's own id is no candidate. Fewer candidates than k give fewer rows, an
    empty table none. ``probed`` is the share of lists that a query reads, ``least_probed`` their
    least number, ``first_turn`` the share of these that it reads first.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.keep(valid(vectors, id_col, vec_col, _nonzero), "rows")
    known = scratch.keep(classes(rows, k), "classes")
    n = known.count()
    share = min(1.0, fit_rows / max(n, 1))  # by hash, so the same at any partitioning; twice fit_rows never comes up by chance
    sample = known.where(F.xxhash64("cls") <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))).select("key", "ids").limit(2 * fit_rows).toArrow()
    queries = rows.where(F.col("id") % every == 0)
    if sample.num_rows == 0:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    data = matrix(sample.column(0))
    n_lists = int(min(max(1, 2 * n**0.5), max(1, len(data) // 4)))
    rotation, centres = fit(data, n_lists)
    n_lists = len(centres)
    n_probed = min(n_lists, max(least_probed, round(probed * n_lists)))
    unit = _unit(data)
    n_first = max(1, round(first_turn * n_probed))
    model = spark.sparkContext.broadcast((rotation, centres, unit, np.argmax(unit @ rotation @ centres.T, axis=1)))

    def reach(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists that each query (rotated) reads, nearest first, and which vectors of the sample lie elsewhere."""
        _, middle, _, seed_list = model.value
        lists = np.argsort(-(x @ middle.T), axis=1, kind="stable")[:, :n_probed]
        unread = np.ones((len(x), len(middle)), bool)
        np.put_along_axis(unread, lists, False, axis=1)
        return lists, unread[:, seed_list]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, middle, *_ = model.value
        for batch in batches:
            x = _unit(matrix(batch.column(1))) @ turn if len(batch) else np.zeros((0, len(turn)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.argmax(x @ middle.T, axis=1).astype(np.int32))], ["cls", "key", "ids", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _, seeds, _ = model.value
        seeds = seeds @ turn
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                x = _unit(matrix(part.column(1))) @ turn
                lists, elsewhere = reach(x)
                near = 2 - 2 * (x @ seeds.T)
                near[elsewhere] = 8.0
                # the (k + 2)-th nearest of the sample in these lists: its own class may be among them
                bound = np.partition(near, k + 1, axis=1)[:, k + 1] if near.shape[1] > k + 1 else np.full(len(x), 8.0)
                at = np.repeat(np.arange(len(x)), n_probed)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(lists.reshape(-1).astype(np.int32)), pa.array(np.tile(np.arange(n_probed) < n_first, len(x))), pa.array(bound[at] + 1e-9)], ["cls", "key", "list", "first", "bound"])

    indexed = scratch.keep(arrow_map(known, assign, "cls binary, key binary, ids array<long>, list int"), "indexed")
    asked = queries.groupBy("cls").agg(F.first("key").alias("key"))
    probes = scratch.keep(arrow_map(asked, probe, "cls binary, key binary, list int, first boolean, bound double"), "probes")
    # at most one number per list: how many blocks of vectors and batches of queries it has
    blocks, batches_of = ({r.list: -(-r["count"] // block_rows) for r in x.groupBy("list").count().collect()} for x in (indexed, probes))

    def parts(of: dict[int, int]):
        return F.coalesce(F.element_at(F.lit([of.get(i, 1) for i in range(n_lists)]), F.col("list") + 1), F.lit(1)) if of else F.lit(1)

    salt = F.xxhash64("cls")
    left = indexed.select("*", F.pmod(salt, parts(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), (parts(batches_of) - 1).cast("int"))).alias("batch"))

    def compare(near: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = pa.table({"cls": pa.array([], pa.binary()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not near.num_rows or not wanted.num_rows:
            return empty
        turn = model.value[0]
        key, asked_key = matrix(near["key"]), matrix(wanted["key"])
        unit, asked_unit = _unit(key), _unit(asked_key)
        ids, bound = near["ids"].to_pylist(), wanted["bound"].to_numpy()
        owners, found, scores = [], [], []
        for i, survivors in scan(unit @ turn, asked_unit @ turn, bound, columns, confidence):
            if len(survivors):
                cosine = (unit[survivors] * asked_unit[i]).sum(axis=1)
                every_id, place = expand(ids, survivors)
                top = best(every_id, np.zeros(len(every_id), np.int64), cosine[place], k + 1)
                owners.append(np.full(len(top), i))
                found.append(every_id[top])
                scores.append(cosine[place][top])
        if not owners:
            return empty
        return pa.table({"cls": wanted["cls"].combine_chunks().take(pa.array(np.concatenate(owners))), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    key = ["list", "block", "batch"]

    def read(which: DataFrame, name: str) -> DataFrame:
        right = which.select("*", F.explode(F.sequence(F.lit(0), (parts(blocks) - 1).cast("int"))).alias("block"), F.pmod(salt, parts(batches_of)).cast("int").alias("batch"))
        return scratch.keep(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "cls binary, vec_id long, score double"), name)

    near = read(probes.where("first").drop("first"), "near")
    # one more than k: the query's own id may be among them
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))
    known_best = near.withColumn("_r", place).where(F.col("_r") == k + 1).select("cls", (2 - 2 * F.col("score") + 1e-9).alias("best"))
    later = probes.join(known_best, "cls", "left").where("not first or best is null")
    far = read(later.select("cls", "key", "list", F.when(F.col("best").isNull(), 8.0).otherwise(F.least("bound", "best")).alias("bound")), "far")
    found = near.union(far).groupBy("cls", "vec_id").agg(F.max("score").alias("score"))
    return ranked(found, queries.select("id", "cls").distinct(), k)
