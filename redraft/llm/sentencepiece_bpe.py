"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

The encoder keeps a *score-ordered agenda* of adjacent symbol pairs: the pair whose
concatenation has the best score (ties: leftmost) is merged first, its new neighbours
enter the agenda, stale entries are skipped. Symbols that are no piece of the vocabulary
become their UTF-8 byte pieces. Three exact facts keep that fast:

* only adjacent symbols whose concatenation is a piece ever merge, so a text may be cut
  between two characters that are adjacent in no piece: the agendas of the two sides
  never meet;
* in such vocabularies the word mark U+2581 only starts words (or stands in runs), so
  every ``mark + word`` is one chunk, and is cut further by the rule above;
* a chunk's ids depend on the chunk alone, so they are remembered (bounded, per worker).

The sentencepiece library checks the results batch by batch (``verify``): "all" encodes
every whole text again and compares all ids; "chunks" compares every chunk when it is first
met, and holds every whole text against the library's decoding of its ids: a text that doesn't come back
exactly is encoded whole by the library, whose ids must be the same. Its ``decode`` gives the decoded text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm.common import Memo, arrow_map, gathered, remembered, resident, slices

MARK = "▁"
_NEVER = float("inf")
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class BpeModel:
    """A BPE model of the sentencepiece library, encoded by this module's own agenda."""

    def __init__(self, path: str, memo: int = 600_000):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cost: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.cost[piece] = i, -sp.get_score(i)
        if any(self.bytes[b] == 0 for b in range(256)):
            raise ValueError("the model has no byte pieces")
        if sp.normalize("A  aéﬁ\n") != f"{MARK}A{MARK}{MARK}aéﬁ\n":
            raise ValueError("the model normalises texts; only identity models with a leading mark are supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("the model has pieces that cross words")
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.memo, self.small = Memo(memo), Memo(memo // 2)
        self.begin, self.end = sp.bos_id(), sp.eos_id()

    def agenda(self, chunk: str) -> list[int]:
        """Ids of a chunk: best-scored adjacent pair first, then its new neighbours."""
        if len(chunk) <= 24:
            symbols = self.short(chunk)
        else:
            symbols = self.long(chunk)
        out: list[int] = []
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in s.encode("utf-8"))
        return out

    def short(self, chunk: str) -> list[str]:
        """The agenda of a short chunk: a plain list, searched for its best entry."""
        symbols, get = list(chunk), self.cost.get
        agenda = [get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != _NEVER:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], _NEVER)
        return symbols

    def long(self, chunk: str) -> list[str]:
        """The agenda of a long chunk: a heap, whose stale entries are skipped when they come up."""
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        cost, heap = self.cost, []
        for i in range(n - 1):
            s = cost.get(pair := symbols[i] + symbols[i + 1])
            if s is not None:
                heap.append((s, i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != pair:
                continue  # one side has merged otherwise meanwhile
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                s = cost.get(new := pair + symbols[k])
                if s is not None:
                    heapq.heappush(heap, (s, i, new))
            if (h := before[i]) >= 0:
                s = cost.get(new := symbols[h] + pair)
                if s is not None:
                    heapq.heappush(heap, (s, h, new))
        return [s for s in symbols if s is not None]

    def chunk(self, chunk: str) -> bytes:
        """Ids (little-endian uint32) of ``mark + word``: cut where no piece reaches over; parts are remembered."""
        joined, small, parts, start = self.joined, self.small, [], 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in joined:
                part = chunk[start:i]
                found = small.get(part)
                if found is None:
                    found = np.asarray(self.agenda(part), "<u4").tobytes()
                    if len(part) <= 64:
                        small[part] = found
                parts.append(found)
                start = i
        return b"".join(parts)

    def learn(self, words: list[str], check: bool = False) -> list[bytes]:
        """Ids of chunks given without their first mark; with ``check`` the library must give the same.

        A single mark alone can't be checked so: no text of its own gives it.
        """
        self.small.room()
        coded = [self.chunk(MARK + w) for w in words]
        if check:
            for word, own, want in zip(words, coded, self.library.encode([w.replace(MARK, " ") for w in words], num_threads=1), strict=True):
                if word and own != struct.pack(f"<{len(want)}I", *want):
                    _same(np.frombuffer(own, "<u4").tolist(), want)
        return coded

    def encode_all(self, texts: pa.Array, check: bool = False) -> list[bytes]:
        """Ids of a column of whole texts (no nulls) as little-endian uint32 bytes, without begin and end.

        Where single blanks part the words, the blanks are the marks and the whole column is cut at once; other
        texts (runs of blanks, blanks at an end, marks of their own) are cut one by one.
        """
        special = pc.equal(pc.binary_length(texts), 0)
        for found in (pc.match_substring(texts, "  "), pc.match_substring(texts, MARK), pc.starts_with(texts, " "), pc.ends_with(texts, " ")):
            special = pc.or_(special, found)
        special = special.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        learn = partial(self.learn, check=check)
        plain = np.flatnonzero(~special)
        if len(plain):
            words = pc.split_pattern(texts.take(pa.array(plain)), " ")
            ids, ends = gathered(self.memo, words.flatten(), learn)
            bounds = np.concatenate([[0], ends[np.cumsum(pc.list_value_length(words).to_numpy()) - 1]]) * 4
            raw = ids.tobytes()
            for i, a, b in zip(plain.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                out[i] = raw[a:b]
        for i in np.flatnonzero(special).tolist():
            if text := texts[i].as_py():
                chunks = [c[1:] for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]
                distinct = [*dict.fromkeys(chunks)]
                known = dict(zip(distinct, remembered(self.memo, distinct, learn), strict=True))
                out[i] = b"".join([known[c] for c in chunks])
        return out

    def encode(self, text: str, check: bool = False) -> bytes:
        """Ids of one whole text."""
        return self.encode_all(pa.array([text], pa.string()), check)[0]


def load(path: str, memo: int = 600_000) -> BpeModel:
    """The model of a file, once per Python worker; it remembers at most ``memo`` chunks."""
    return resident(("BpeModel", path, memo), lambda: BpeModel(path, memo))


def encode_decode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", verify: str = "chunks", keep: bool = False
) -> DataFrame:
    """Encode every text with begin and end ids and decode the ids again.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and with ``keep``
    also ``ids`` (array<int>) and ``decoded`` (string). A null text is taken as empty: two
    ids, empty decoding. Null ids are kept, repeated rows give repeated results, an empty
    table gives an empty one; columns other than the two named are not read, so their names
    don't matter. Fails if the agenda and the library ever differ. The model file must be
    at ``model_path`` on every executor.
    """
    if verify not in ("all", "chunks", "none"):
        raise ValueError("verify: all, chunks or none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        ends = np.asarray([model.begin], "<u4").tobytes(), np.asarray([model.end], "<u4").tobytes()
        for batch in batches:
            for rows in slices(batch, 1):
                coded = [ends[0] + c + ends[1] for c in model.encode_all(rows.column(1), verify == "chunks")]
                n, text_sha, all_ids, all_texts = [], [], [], []
                for at in range(0, len(coded), 256):
                    ids = [np.frombuffer(c, "<u4").tolist() for c in coded[at : at + 256]]
                    if verify == "all":
                        for own, want in zip(ids, model.library.encode(rows.column(1).slice(at, 256).to_pylist(), num_threads=1), strict=True):
                            _same(own[1:-1], want)
                    decoded = [model.library.decode(x) for x in ids]
                    if verify == "chunks":
                        given = rows.column(1).slice(at, 256).to_pylist()
                        odd = [i for i, (t, d) in enumerate(zip(given, decoded, strict=True)) if t != d]
                        for i, want in zip(odd, model.library.encode([given[i] for i in odd], num_threads=1), strict=True):
                            _same(ids[i][1:-1], want)
                    n.extend(map(len, ids))
                    text_sha.extend(hashlib.sha256(d.encode()).hexdigest() for d in decoded)
                    if keep:
                        all_ids.extend(ids)
                        all_texts.extend(decoded)
                columns = [rows.column(0), pa.array(n, pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array(text_sha, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(rows, run, schema + ", ids array<int>, decoded string" * keep)


def _same(own: list[int], want: list[int]) -> None:
    if own != want:
        at = next((i for i, (a, b) in enumerate(zip(own, want, strict=False)) if a != b), min(len(own), len(want)))
        raise AssertionError(f"the agenda and the library differ from id {at}: {own[at : at + 5]} and {want[at : at + 5]}")
