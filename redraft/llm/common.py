"""What the operators share: reading, scratch tables in the shared folder, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the session names none, a new local one is made, but only for a local master; elsewhere that is an error, as
    each machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="redraft-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written once to the shared folder and read back, so that their lineage is cut."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, release: bool = False) -> DataFrame:
        """Write ``df`` as Parquet under ``name`` and return the written table.

        ``release`` asks the driver to collect its garbage: Spark deletes the shuffle files of finished jobs only
        when the driver has forgotten them, and large steps in a row would hold all of theirs at once.
        """
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        if release:
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Delete a written table that no returned plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``; the frame must already be narrowed to the columns that ``fn`` reads.

    A task that ends gives back what its worker doesn't use: workers wait for later tasks beside the executor's heap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system, as far as the allocators do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def as_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, whatever characters the names hold."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def lower_ascii(c):
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Memo(dict):
    """A dict that forgets its oldest half when it holds ``limit`` keys: bounded memory, same results."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self) -> None:
        if len(self) >= self.limit:
            for k in list(self)[: len(self) // 2]:
                del self[k]


def remembered(memo: Memo, keys: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """The values of distinct keys; ``learn`` gives those that aren't remembered."""
    memo.room()
    got = list(map(memo.get, keys))
    missing = [i for i, g in enumerate(got) if g is None]
    if missing:
        fresh = [keys[i] for i in missing]
        for i, key, value in zip(missing, fresh, learn(fresh), strict=True):
            got[i] = value
            if len(key) <= 64:
                memo[key] = value
    return got


def gathered(memo: Memo, words: pa.Array, learn: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The uint32 ids of a column of words, one after another, and where each word's ids end.

    Distinct words are looked up once; the column's ids are then gathered by index.
    """
    coded = words.dictionary_encode()
    values = remembered(memo, coded.dictionary.to_pylist(), learn)
    flat = np.frombuffer(b"".join(values), "<u4")
    length = np.fromiter(map(len, values), np.int32, len(values)) // 4
    start = np.cumsum(length, dtype=np.int32) - length
    index = coded.indices.to_numpy()
    each = length[index]
    ends = np.cumsum(each, dtype=np.int32)  # a slice of texts has far fewer than 2 ** 31 ids
    shift = start[index] - (ends - each)
    return flat[np.repeat(shift, each) + np.arange(len(shift) and int(ends[-1]), dtype=np.int32)], ends


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts (no nulls) have about ``most`` bytes together, one row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


_RESIDENT: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one object with its memory at a time, the last asked for."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]
