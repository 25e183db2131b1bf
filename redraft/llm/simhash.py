"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints have 64 bits; two link if at most ``radius`` bits differ. Every bit i gets a nonzero
vector of radius + 1 bits; table v (each nonzero v of radius + 1 bits) masks the bits whose vector has an odd
product with v. The vectors of at most ``radius`` differing bits can't span radius + 1 dimensions, so
some v is orthogonal to all of them: in that table the two fingerprints agree. Every pair within the radius
collides, with certainty.

Equal fingerprints are one node. A table's bucket is compared inside in blocks of bounded size
(a large bucket becomes pairs of its blocks), and gives no more links than join its members; components
come from distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm.common import Scratch, arrow_map
from redraft.llm.components import components

_PART = 65536


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """Majority of the bits of XXH64 over the text's word shingles; 0 for no words.

    A-Z are lower-cased, words part at ASCII white space, fewer than ``size`` words are one shingle; repeated shingles
    count each; a bit is 1 if set in over half of them.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    h = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(found) < size:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    counts = np.zeros(64, np.int64)
    for a in range(0, len(starts), _PART):
        hashes = np.array([h(joined[s:e], seed) for s, e in zip(starts[a : a + _PART].tolist(), ends[a : a + _PART].tolist())], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * c > len(starts) else "0" for c in counts.tolist()), 2)


def masks(radius: int) -> list[int]:
    """The covering masks, as unsigned 64-bit numbers: 2 ** (radius + 1) - 1 of them."""
    kinds = 2 ** (radius + 1) - 1
    vectors = [1 + i % kinds for i in range(64)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, kinds + 1)]


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return x - 2**64 if x >= 2**63 else x


def _joined(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the members of one block as all links within the radius would."""
    bits = members.view(np.uint64)  # counts of signed numbers would be those of their absolute values
    if len(members) == 2:
        return [(int(members[0]), int(members[1]))] if (int(bits[0]) ^ int(bits[1])).bit_count() <= radius else []
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    left, out = set(range(len(members))), []
    while left:
        root = left.pop()
        edge = [root]
        while edge:
            for j in np.flatnonzero(near[edge.pop()]).tolist():
                if j in left:
                    left.discard(j)
                    edge.append(j)
                    out.append((int(members[root]), int(members[j])))
    return out


def links(prints: DataFrame, scratch: Scratch, radius: int = 4, block_rows: int = 512) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``, long), enough to join what is within the radius."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("m")) for i, m in enumerate(masks(radius))])
    buckets = prints.select("fp", F.explode(tables).alias("x")).select("x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    sizes = scratch.keep(buckets.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    last = (F.ceil(F.col("n") / block_rows) - 1).cast("int")
    block = F.pmod(F.xxhash64("fp"), last + 1).cast("int")
    dealt = buckets.join(sizes, ["t", "key"]).select("t", "key", "fp", block.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    blocks = dealt.groupBy("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list("fp").alias("members"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            found: set[tuple[int, int]] = set()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if b - a > 1:
                    found.update(_joined(flat[a:b], radius))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return arrow_map(blocks.select("members"), compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) of every row.

    ``fingerprint``: 16 lowercase hex digits; null and empty texts have fingerprint zero and link like any other.
    ``component_id``: the smallest id reachable over links (null only if no row in reach has an id). Repeated
    rows and null ids stay, each with its component; an empty table gives an empty result; other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signed(fingerprint(t)) for t in batch.column(1).to_pylist()], pa.int64())], [id_col, "fp"])

    prints = scratch.keep(arrow_map(rows, hashed, f"`{id_col}` {kind}, fp long"), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    found = scratch.keep(components(links(distinct.select("fp"), scratch, radius), scratch), "components")
    scratch.drop("bucket-sizes")
    least = found.join(distinct, found.node == distinct.fp).groupBy("component").agg(F.min("first").alias("least"))
    classes = scratch.keep(found.join(least, "component").select(F.col("node").alias("fp"), "least"), "classes")
    ids = scratch.keep(distinct.join(classes, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "ids")
    return prints.join(ids, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all columns: the one with the smallest id.

    Rows that repeat that id are told apart by their texts: of equal texts one row stays, different texts under one
    id all stay, as they can't be told apart by id. Rows without an id stay.
    """
    found = near_duplicates(docs.where(F.col(f"`{id_col}`").isNotNull()), radius, id_col, text_col)
    first = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_keep")).distinct()
    # nested, no name of a column can clash
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_doc"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_h"), F.xxhash64(F.lit(1), F.col(f"`{text_col}`")).alias("_h2"))
    kept = rows.where(F.col("_id").isNotNull()).join(first, F.col("_id") == F.col("_keep"), "left_semi").dropDuplicates(["_id", "_h", "_h2"])
    out = kept.union(rows.where(F.col("_id").isNull()))
    return out.select(*[F.col("_doc").getField(n).alias(n) for n in docs.columns])
