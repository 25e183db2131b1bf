"""Language identification by unigram pieces, summed over all segmentations.

Every language has probabilities over the pieces of one fixed public vocabulary. A word is
scored by the forward algorithm: the sum of the products of piece probabilities over *all*
ways to cut the word into pieces, not only the best one. A text's score in a language is the
product over its words; the prediction is the language with the largest posterior under equal
priors.

Words are maximal runs of letters, lower-cased, with the vocabulary's word mark in front; a word's
likelihoods depend on the word alone and are remembered per worker (bounded). Training counts the
pieces of all words of all labelled texts (partial sums in the tasks); what reaches the driver is
one number per language and piece of the vocabulary.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm.common import arrow_map, remembered, resident, slices
from redraft.llm.sentencepiece_bpe import MARK, BpeModel, load

_NUMBER = itertools.count()
#: What a character outside the vocabulary costs in any language.
UNKNOWN = 1e-7


def words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lower-cased maximal runs of letters of a column of texts (no nulls).

    Returns each word's index among the distinct ones, those, and where each text's words end.
    """
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), r"\PL+")
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), before[np.cumsum(pc.list_value_length(parts).to_numpy())]


class Scorer:
    """Log-likelihoods of words in all languages; pieces' probabilities are ``table[piece]``."""

    def __init__(self, pieces: dict[str, int], table: np.ndarray, memo: int = 600_000):
        self.n, self.limit = table.shape[1], memo
        self.trie: dict = {}  # of reversed pieces: what may end at a character
        rows = table.tolist()
        for piece, i in pieces.items():
            if MARK not in piece[1:]:
                node = self.trie
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = rows[i]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, self.n))

    def forward(self, texts: list[str]) -> list[list[float]]:
        """For each marked word, in sorted order: log of the sum over all its segmentations, for each language.

        ``ahead[i]`` sums over the segmentations of the first i characters, so words with a common
        beginning share those. Long words are scaled from time to time; their scales are shared alike.
        """
        trie, n, out = self.trie, self.n, []
        ahead, scales = [[1.0] * n], [[0.0] * n]
        last = ""
        for text in texts:
            same = 0
            for a, b in zip(last, text):
                if a != b:
                    break
                same += 1
            del ahead[same + 1 :], scales[same + 1 :]
            last = text
            for i in range(same + 1, len(text) + 1):
                node, j, total = trie, i, None
                while j and (node := node.get(text[j - 1])) is not None:
                    j -= 1
                    if (p := node.get("")) is not None:
                        here = ahead[j]
                        if scales[j] is not scales[i - 1]:
                            here = [a * math.exp(s - t) for a, s, t in zip(here, scales[j], scales[i - 1])]
                        if total is None:
                            total = [a * b for a, b in zip(here, p)]
                        else:
                            total = [o + a * b for o, a, b in zip(total, here, p)]
                if trie.get(text[i - 1]) is None or "" not in trie[text[i - 1]]:  # no piece by itself
                    alone = [a * UNKNOWN for a in ahead[i - 1]]
                    total = alone if total is None else [a + b for a, b in zip(total, alone)]
                if i % 24:
                    ahead.append(total)
                    scales.append(scales[i - 1])
                else:
                    ahead.append([1.0] * n)
                    scales.append([s + math.log(a) for s, a in zip(scales[i - 1], total)])
            out.append([s + math.log(a) for s, a in zip(scales[-1], ahead[-1])])
        return out

    def learn(self, fresh: set[str]) -> None:
        """Remember the words not met before; forget all others first if there are too many."""
        if len(self.place) + len(fresh) > self.limit:
            self.forget()
        fresh = sorted(fresh)
        base = len(self.place)
        while base + len(fresh) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        if fresh:
            self.rows[base : base + len(fresh)] = self.forward([MARK + w for w in fresh])
            self.place.update(zip(fresh, range(base, base + len(fresh))))

    def table(self, found: list[str]) -> np.ndarray:
        """The words' log-likelihoods, a row for each."""
        place = self.place
        fresh = {w for w in found if w not in place}
        if len(place) + len(fresh) > self.limit:
            fresh = set(found)
        self.learn(fresh)
        return self.rows[list(map(self.place.__getitem__, found))] if found else np.zeros((0, self.n))


def train(docs: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5, memo: int = 600_000):
    """(languages in order, probabilities[piece, language]) from all rows with text and language.

    Piece counts come from the vocabulary's own segmentation of every word; ``smooth`` is added to
    every count. No rows: no languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, memo)
        size = model.library.get_piece_size()
        total: dict[str, np.ndarray] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for lang, counts in total.items():
                ids = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(counts[ids])], ["lang", "piece", "n"])
            total.clear()

        for batch in batches:
            for part in slices(batch, 1):
                index, distinct, ends = words(part.column(1))
                pieces = remembered(model.memo, distinct, model.learn)
                length = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
                flat = np.frombuffer(b"".join(pieces), "<u4")
                langs = part.column(0).dictionary_encode()
                whose = np.repeat(langs.indices.to_numpy(), np.diff(np.concatenate([[0], ends])))
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    seen = np.bincount(index[whose == k], minlength=len(distinct))
                    got = np.bincount(flat, np.repeat(seen, length), size).astype(np.int64)
                    total[lang] = total[lang] + got if lang in total else got
                if len(total) > 64:
                    yield from give()
        yield from give()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    seen = arrow_map(rows, count, "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(seen.lang.unique())
    counts = np.full((load(model_path).library.get_piece_size(), len(languages)), smooth)
    if languages:
        counts[seen.piece, seen.lang.map({x: i for i, x in enumerate(languages)})] += seen.n
    return languages, counts / counts.sum(axis=0)


def predict(docs: DataFrame, model_path: str, languages: list[str], table: np.ndarray, text_col: str = "text", memo: int = 600_000) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (posterior, 0 to 1) to the rows; reads the text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to
    the language first in order. Columns of these two names are replaced.
    ``memo``: so many words each Python worker remembers.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]) + ", lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(table)
    key = f"{next(_NUMBER)}:{shared.id if hasattr(shared, 'id') else 0}:{hash(table.tobytes())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(("Scorer", key), lambda: Scorer(BpeModel(model_path).ids, shared.value, memo))
        for batch in batches:
            for part in slices(batch, 0):
                langs, scores = ["und"] * len(part), [0.0] * len(part)
                index, distinct, ends = words(part.column(0))
                starts = np.concatenate([[0], ends[:-1]])
                some = np.flatnonzero(ends > starts) if languages else np.zeros(0, int)
                if len(some):
                    totals = np.add.reduceat(scorer.table(distinct)[index], starts[some], axis=0)
                    best = totals.argmax(axis=1)
                    sure = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, b, p in zip(some.tolist(), best.tolist(), sure.tolist()):
                        langs[i], scores[i] = languages[b], p
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    return arrow_map(rows, run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves remainder 2 by 4; null ids are held out of nothing."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from rows that aren't held out, predict all. Returns id_col, held_out, lang_pred, score.

    Rows with null text or language teach nothing; every row is predicted, repeated ones alike.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out"))
    languages, table = train(rows.where("not held_out"), model_path)
    return predict(rows.select(id_col, "text", "held_out"), model_path, languages, table).select(id_col, "held_out", "lang_pred", "score")
