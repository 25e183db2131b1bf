"""What the two vector searches share: valid vectors, classes of equal vectors, final ranks.

Equal vectors are searched once. A class keeps the ``k + 1`` smallest ids of its vector, since a
query takes at most ``k`` of them besides its own; that prunes copies in the tasks that read them
(a partial limit below the shuffle), and stays exact because ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redraft.llm.common import arrow_map


def valid(vectors: DataFrame, id_col: str, vec_col: str, prepare: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, key, cls) of the rows that take part; key holds the bytes of ``prepare``'s row, cls identifies equal keys.

    No part take rows whose id or vector is null, whose vector holds null or non-finite components, whose
    dimension isn't the most frequent one (ties: the smaller), and rows that ``prepare`` makes
    non-finite.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0].dim if sizes else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            flat = pc.list_flatten(vecs).to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            good = np.isfinite(flat).all(axis=1)
            ready = prepare(np.ascontiguousarray(flat[good])) + 0.0
            fine = np.isfinite(ready).all(axis=1)
            ready = np.ascontiguousarray(ready[fine])
            width = ready.shape[1] * 8
            data = ready.tobytes()
            keys = pa.array([data[i : i + width] for i in range(0, len(data), width)] if width else [], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)).filter(pa.array(fine)), keys], ["id", "key"])

    found = arrow_map(rows.where(F.size("vec") == dim), run, "id long, key binary") if dim else rows.select("id", F.lit(None).cast("binary").alias("key")).limit(0)
    return found.withColumn("cls", F.unhex(F.md5("key")))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(cls, key, ids): each distinct vector with its k + 1 smallest ids."""
    first = F.dense_rank().over(Window.partitionBy("cls").orderBy("id"))
    return rows.withColumn("_r", first).where(F.col("_r") <= k + 1).groupBy("cls").agg(F.first("key").alias("key"), F.sort_array(F.collect_set("id")).alias("ids"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of keys as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(n, -1) if n else np.zeros((0, 1))


def best(ids: np.ndarray, owner: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k best (largest score, then smallest id)."""
    order = np.lexsort((ids, -score, owner))
    sorted_owner = owner[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_owner[1:] != sorted_owner[:-1]])) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate([start, [len(order)]])))
    return order[place < k]


def expand(ids: list[list[int]], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the classes at ``rows`` and, for each, its place in ``rows``."""
    lengths = np.fromiter((len(ids[r]) for r in rows), np.int64, len(rows))
    return np.fromiter((x for r in rows for x in ids[r]), np.int64, int(lengths.sum())), np.repeat(np.arange(len(rows)), lengths)


def ranked(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (cls, vec_id, score) of query classes and the queries' (id, cls)."""
    top = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))
    lists = found.withColumn("_r", top).where(F.col("_r") <= k + 1).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("hits"))
    own = queries.join(lists, "cls").select(F.col("id").alias("query_id"), F.expr(f"slice(filter(hits, x -> x.vec_id <> id), 1, {k})").alias("hits"))
    return own.select("query_id", F.posexplode("hits").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", "hit.score")
