"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A sequence is filled greedily with the longest document that still fits; then its smallest
document is taken out again if two unpacked documents fit the widened gap more tightly.

Only lengths matter, and there are at most ``capacity`` of them. So the plan is made on the
histogram of lengths (one number per length, whatever the input) as *patterns with repeats*: a
pattern is one filled sequence, and it repeats for as long as the same choices would be made
again. Documents then find their place from their rank among equal lengths, which comes
from counts per task, not from gathering a length in one task.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redraft.llm.common import Memo, Scratch, arrow_map, gathered, remembered, resident, slices

#: Words of characters that lower-case and normalise one by one, and how the vocabulary's pre-tokenizer
#: cuts them (a fixed pattern of the vocabulary file, compared with the file when it is loaded).
_PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]+").fullmatch
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRETOKENS = regex.compile(PATTERN).findall


def _parts(word: str) -> list[str] | None:
    """Pre-tokens of a plain word, None for others; letters alone or before one mark need no pattern."""
    if not (word.isascii() and word.isprintable() or _PLAIN(word)) or "<|" in word:
        return None
    if word.isalpha():
        return [word.lower()]
    if word[-1:] in (",", ".") and word[:-1].isalpha():
        return [word[:-1].lower(), word[-1]]
    return _PRETOKENS(word.lower())


class WordIds:
    """Ids of texts by a tokenizer that drops white space: words are encoded once and remembered.

    A word that is new is put together from its pre-tokens (words differ in their punctuation far more than in their letters). Exact for tokenizers whose pre-tokens never hold a blank, tab or line end, which is checked for
    the loaded file by comparing some joined words.
    """

    def __init__(self, path: str, memo: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo, self.small = Memo(memo), Memo(memo // 2)
        split = json.loads(self.library.to_str())["pre_tokenizer"]
        if PATTERN not in str([p.get("pattern", {}).get("Regex") for p in split.get("pretokenizers", [])]).replace("\\\\", "\\"):
            raise ValueError("the tokenizer cuts words by another pattern")
        probe = "It's a Test,\n\n x\t12 ÉTÉ's!?\r\nß …"
        if self.encode_all(pa.array([probe])) != [np.asarray(self.library.encode(probe, add_special_tokens=False).ids, "<u4").tobytes()]:
            raise ValueError("the tokenizer joins words over white space")

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of a column of whole texts (no nulls) as little-endian uint32 bytes."""
        for c in "\n\t\r":
            texts = pc.replace_substring(texts, c, " ")
        words = pc.split_pattern(texts, " ")
        ids, ends = gathered(self.memo, words.flatten(), self._words)
        last = np.cumsum(pc.list_value_length(words).to_numpy())
        bounds = np.concatenate([[0], ends[last - 1]]) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words: those of plain Latin characters by their pre-tokens, others by the library."""
        parts = [_parts(w) for w in words]
        known = [*{x for p in parts if p is not None for x in p}]
        known = dict(zip(known, remembered(self.small, known, self._library), strict=True))
        other = self._library([w for w, p in zip(words, parts, strict=True) if p is None])
        other.reverse()
        return [other.pop() if p is None else known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p]) for p in parts]

    def _library(self, words: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(words, add_special_tokens=False)]


def load(path: str, memo: int = 600_000) -> WordIds:
    """The tokenizer of a file, once per Python worker; it remembers at most ``memo`` words."""
    return resident(("WordIds", path, memo), lambda: WordIds(path, memo))


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-two-fit over ``counts[length]``: [([(length, how many), ...] longest first, repeats), ...]."""
    left = counts.astype(np.int64).copy()
    out = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        used: dict[int, int] = {}
        gap, k = capacity, len(there) - 1
        while k >= 0:
            k = int(np.searchsorted(there[: k + 1], gap, "right")) - 1
            if k < 0:
                break
            size = int(there[k])
            used[size] = min(int(left[size]), gap // size)
            gap -= used[size] * size
            k -= 1
        while gap and sum(used.values()) > 1:
            smallest = min(used)
            pair = _tightest(there, left, used, gap + smallest)
            if pair is None or sum(pair) <= smallest:
                break
            used[smallest] -= 1
            if not used[smallest]:
                del used[smallest]
            for size in pair:
                used[size] = used.get(size, 0) + 1
            gap += smallest - sum(pair)
        repeats = min(int(left[size]) // n for size, n in used.items())
        for size, n in used.items():
            left[size] -= n * repeats
        out.append((sorted(used.items(), reverse=True), repeats))


def _tightest(there: np.ndarray, left: np.ndarray, used: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum within ``room``."""
    free = left[there].copy()
    for size, n in used.items():
        free[np.searchsorted(there, size)] -= n
    sizes, free = there[free > 0], free[free > 0]
    if not len(sizes):
        return None
    second = np.searchsorted(sizes, room - sizes, "right") - 1
    alone = (second >= 0) & (sizes[second] == sizes) & (free[second] < 2)
    second = np.where(alone, second - 1, second)
    sums = np.where(second >= 0, sizes + sizes[second], -1)
    best = int(np.argmax(sums))
    return (int(sizes[best]), int(sizes[second[best]])) if sums[best] > 0 else None


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, memo: int = 1_000_000, slice_bytes: int = 16 << 20
) -> DataFrame:
    """Cut documents longer than ``capacity`` into pieces and pack all pieces.

    Returns per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset; with
    ``keep_ids`` also ids (array<int>). A null text is empty: one piece, the end id. Repeated rows and null ids
    are packed like others. An empty table gives an empty result. Columns other than the two named are not read.
    ``memo``: so many words each Python worker remembers (some 250 bytes each); ``slice_bytes``: text that it cuts into words at once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, task = load(tokenizer_path, memo), np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 1, slice_bytes):
                row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
                for i, coded in enumerate(coder.encode_all(part.column(1))):
                    coded += end
                    for p in range(0, len(coded), 4 * capacity):
                        cut_out = coded[p : p + 4 * capacity]
                        n = len(cut_out) // 4
                        row.append(i)
                        piece.append(p // (4 * capacity))
                        start.append(p // 4)
                        length.append(n)
                        crc.append(zlib.crc32(cut_out))
                        rank.append(seen[n])
                        seen[n] += 1
                        if keep_ids:
                            ids.append(np.frombuffer(cut_out, "<u4"))
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32", "_task", "_rank"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, _task int, _rank long" + ", ids array<int>" * keep_ids
    # Written once: ranks hold for the order in which a task met its rows, so they must not be made anew.
    pieces = Scratch(spark, "packing").keep(arrow_map(rows, cut, schema), "pieces")
    each = pieces.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    bases = each.select("_task", "length", F.coalesce(before, F.lit(0)).alias("_base"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in each.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most one row per length
        counts[r.length] = r.n
    places = _places(plan(counts, capacity))
    ranked = pieces.join(bases, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                own = length == size
                first, sequences, each_bin, offsets = places[int(size)]
                run = np.searchsorted(first, rank[own], "right") - 1
                within = rank[own] - first[run]
                sequence[own] = sequences[run] + within // each_bin[run]
                offset[own] = offsets[run] + within % each_bin[run] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[2:5], batch.column(0), *batch.columns[5:], pa.array(sequence), pa.array(offset)], out)

    out = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset"]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return arrow_map(ranked.select("length", "_rank", id_col, "piece", "start", "ids_crc32", *["ids"] * keep_ids), place, schema)


def _places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, its runs of ranks: first rank, first sequence, documents per sequence, offset of the first."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for used, repeats in patterns:
        offset = 0
        for size, n in used:
            runs.setdefault(size, []).append((given.get(size, 0), sequence, n, offset))
            given[size] = given.get(size, 0) + n * repeats
            offset += n * size
        sequence += repeats
    return {size: tuple(np.asarray(x, np.int64) for x in zip(*found, strict=True)) for size, found in runs.items()}
