"""Token counts of fields and sections by character offsets.

Every document is encoded once, as a whole. Its tokens' character spans are then joined with the
sections' spans as intervals (both sorted, so two binary searches per section). A token that crosses a
section's boundary is allocated by an explicit rule: to the section that holds its first
character ("first"), its last one ("last"), or in parts by characters ("share").
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm.common import Memo, arrow_map, remembered, resident, slices

#: How the vocabulary's pre-tokenizer cuts texts (a fixed pattern of byte-level vocabularies), and the texts of
#: characters on which this module's pattern and the library's certainly agree.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = regex.compile(PATTERN).findall
_PLAIN = r"^[\n\r\t -~\x{a1}-\x{ac}\x{ae}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}]*$"


class SpanCoder:
    """Token spans of whole texts by a byte-level tokenizer; a pre-token's spans are encoded once and remembered."""

    def __init__(self, path: str, memo: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.memo = Memo(memo)
        kind = json.loads(self.library.to_str())
        self.known = kind.get("normalizer") is None and (kind.get("pre_tokenizer") or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

    def _spans(self, texts: list[str]) -> list[bytes]:
        """(start, end) of each token, as int32 pairs."""
        return [np.asarray(x.offsets, "<i4").tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def spans(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text (no nulls) the spans of its tokens, a row for each."""
        plain = pc.match_substring_regex(texts, _PLAIN).to_numpy(zero_copy_only=False) if self.known else np.zeros(len(texts), bool)
        out: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(texts)
        other = np.flatnonzero(~plain).tolist()
        for i, found in zip(other, self._spans([texts[i].as_py() for i in other]), strict=True):
            out[i] = np.frombuffer(found, "<i4").reshape(-1, 2).astype(np.int64)
        own = np.flatnonzero(plain)
        parts = [_PIECES(t) for t in texts.take(pa.array(own)).to_pylist()]
        coded = pa.array([x for p in parts for x in p], pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        values = remembered(self.memo, distinct, self._spans)
        flat = np.frombuffer(b"".join(values), "<i4").reshape(-1, 2)
        tokens = np.fromiter(map(len, values), np.int64, len(values)) // 8
        chars = np.fromiter(map(len, distinct), np.int64, len(distinct))
        first, index = np.cumsum(tokens) - tokens, coded.indices.to_numpy()
        each = tokens[index]
        ends, place = np.cumsum(each), np.cumsum(chars[index]) - chars[index]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        last = np.cumsum(count)
        place = place - np.repeat(np.append(place, 0)[last - count], count)
        found = flat[np.repeat(first[index] - (ends - each), each) + np.arange(each.sum())] + np.repeat(place, each)[:, None]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], last])]
        for i, a, b in zip(own.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            out[i] = found[a:b]
        return out


def load(path: str) -> SpanCoder:
    """The tokenizer of a file, once per Python worker."""
    return resident(("SpanCoder", path), lambda: SpanCoder(path))


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's lines, each with its line end, so that they cover the text."""
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    if len(breaks) and breaks[-1] == len(text):
        breaks = breaks[:-1]
    return np.concatenate([[0], breaks]).astype(np.int64), np.concatenate([breaks, [len(text)]]).astype(np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of the sections [a, b), tokens that cross a section's start or end, and what lies in no section.

    ``starts`` and ``ends`` are the tokens' spans in order. Sections may overlap (each counts its own), be
    empty (0) or lie in any order.
    """
    begun_a, begun_b = np.searchsorted(starts, a), np.searchsorted(starts, b)
    over_a, over_b = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "right")
    real = b > a
    # a token reaches over x if it has begun before x and isn't over at x
    crossing = np.where(real, np.where((begun_a > over_a) & (begun_b > over_b) & (over_a == over_b), begun_a - over_a, (begun_a - over_a) + (begun_b - over_b)), 0)
    if rule == "first":
        low, high = begun_a, begun_b
    elif rule == "last":
        low, high = np.searchsorted(ends - 1, a), np.searchsorted(ends - 1, b)
    else:
        def mass(x: np.ndarray, over: np.ndarray, begun: np.ndarray) -> np.ndarray:
            out = over.astype(float)
            for i in np.flatnonzero(begun > over):
                k = slice(over[i], begun[i])
                out[i] += ((x[i] - starts[k]) / (ends[k] - starts[k])).sum()
            return out

        low, high = mass(a, over_a, begun_a), mass(b, over_b, begun_b)
    got = np.where(real, high - low, 0)
    order = np.argsort(low, kind="stable")
    covered, reach = 0.0, 0.0
    for i in order:
        if real[i]:
            covered += max(0.0, high[i] - max(low[i], reach))
            reach = max(reach, high[i])
    return got, crossing, len(starts) - covered


def count_tokens(
    docs: DataFrame, tokenizer_path: str, rule: str = "first", sections_col: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token counts per section of every document.

    ``sections_col``: array<struct<name string, start int, end int>> in code points (end exclusive, cut to the text); without
    it the sections are the lines, each with its line end, so that counts sum to the document's. Returns ``id_col``, section (from 0),
    name (null for lines), start, end, n_tokens (double for "share", else whole), n_crossing (tokens that cross
    one of its boundaries), doc_tokens. With given sections, a row with section -1 holds what lies in none of them, if anything
    does. Null texts and sections are empty; an empty text has one empty line. Repeated rows are
    counted each; other columns are not read.
    """
    if rule not in ("first", "last", "share"):
        raise ValueError("rule: first, last or share")
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(sections_col).alias("sections")] if sections_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(tokenizer_path)
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                given = part.column(2).to_pylist() if sections_col else None
                out: list[tuple] = []
                for i, (text, spans) in enumerate(zip(texts, coder.spans(part.column(1)), strict=True)):
                    starts, ends = spans[:, 0], spans[:, 1]
                    names = None
                    if given is None:
                        a, b = lines(text)
                    else:
                        found = [s for s in given[i] or [] if s is not None]
                        names = [s["name"] for s in found]
                        a, b = (np.clip(np.asarray([s[k] or 0 for s in found], np.int64), 0, len(text)) for k in ("start", "end"))
                    got, crossing, rest = allocate(starts, ends, a, b, rule)
                    n = len(a)
                    out.append((np.full(n, i), np.arange(n), names or [None] * n, a, b, got, crossing, np.full(n, len(spans))))
                    if given is not None and rest > 1e-9:
                        out.append(([i], [-1], [None], [0], [len(text)], [rest], [0], [len(spans)]))
                parts = [np.concatenate([o[k] for o in out]) for k in (0, 1, 3, 4, 5, 6, 7)]
                counts = parts[4] if rule == "share" else parts[4].astype(np.int64)
                columns = [part.column(0).take(pa.array(parts[0].astype(np.int64))), pa.array(parts[1].astype(np.int32)), pa.array([x for o in out for x in o[2]], pa.string()), *(pa.array(x.astype(np.int64)) for x in parts[2:4]), pa.array(counts), *(pa.array(x.astype(np.int64)) for x in parts[5:])]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    kind = rows.schema[0].dataType.simpleString()
    number = "double" if rule == "share" else "long"
    return arrow_map(rows, run, f"`{id_col}` {kind}, section int, name string, start long, end long, n_tokens {number}, n_crossing long, doc_tokens long")
