"""The stages of the pipeline, one after another, each against brute force; and on messy tables."""

import itertools
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from redraft.llm.common import Scratch
from test_operators import BASE, WORDS, good, slow_fingerprint, slow_lines

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    """The tables before the first and after each stage, as lists of rows."""
    scratch, docs = Scratch(spark, "test"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, "/root/testdata/sf0.001"), name)
        found.append(docs.collect())
    return found


def test_language_stage(steps):
    before, after = steps[0], steps[1]
    text = {r.doc_id: r.text for r in before}
    kept = {r.doc_id: r for r in after}
    assert all(text[i] == r.text for i, r in kept.items())
    assert not any(kept[i].text is None or not any(c.isalpha() for c in kept[i].text) for i in kept)
    lettered = {r.doc_id: r.lang for r in before if r.text and len(r.text.split()) > 20 and r.lang}
    assert sum(i in kept and kept[i].lang == lang for i, lang in lettered.items()) >= 0.98 * len(lettered)


def test_line_stage_equals_all_pairs(steps):
    before, after = steps[1], steps[2]
    first = slow_lines([(r.doc_id, r.text) for r in before])
    want = {}
    for r in before:
        lines = r.text.split("\n")
        left = [x for n, x in enumerate(lines) if not x.strip(" ") or first[x] == (r.doc_id, n)]
        if len(left) == len(lines):
            want[r.doc_id] = r.text
        elif any(x.strip(" ") for x in left):
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if r.text != {x.doc_id: x.text for x in before}[r.doc_id])


def test_near_duplicate_stage_equals_all_pairs(steps):
    before, after = steps[2], steps[3]
    prints = {r.doc_id: slow_fingerprint(r.text) for r in before}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(prints, 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in after) == sorted(i for i in prints if root(i) == i)


def test_personal_data_stage(steps):
    before, after = {r.doc_id: r.text for r in steps[3]}, {r.doc_id: r for r in steps[4]}
    assert set(before) == set(after)
    touched = 0
    for i, text in before.items():
        spans = [m for kind, pattern in BASE for m in re.finditer(pattern, text, re.ASCII) if good(kind, m.group())]
        touched += bool(spans)
        for m in spans:
            assert text.count(m.group()) > after[i].text.count(m.group())
        if not re.search("[0-9@]|\\bat\\b", text):
            assert after[i].text == text
        assert after[i].n_chars == len(after[i].text)
    assert touched


def test_packing_stage(steps):
    before, after = {r.doc_id: r.text for r in steps[4]}, steps[5]
    tokenizer = Tokenizer.from_file(WORDS)
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before.items()}
    got, bins = Counter(), defaultdict(list)
    for r in after:
        got[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces[:-1])] and sum(n for _, n in pieces) <= 4096


@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_messy_tables(spark, empty):
    line = "une ligne assez longue pour que ses tranches de caracteres se ressemblent bien"
    rows = [(1, line, "fr", None, 1, "a", "b", "c"), (1, line, "fr", None, 1, "a", "b", "c"), (2, None, None, None, None, None, None, None), (3, "", "en", "", 0, "", "", ""), (None, f"{line}!", None, None, None, None, None, None)]
    rows += [(10 + i, f"plain english words with the number {i} of them, mail joe{i}@example.com", "en", "s", 5, "x", "y", "z") for i in range(6)] + [(50, "word " * 20_000, "en", "s", 1, "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _spans string, _row string, doc string")
    docs = docs.limit(0) if empty else docs
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.keep(stage(spark, docs, ""), name)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        alone = scratch.keep(stage(spark, docs.where(F.col("doc_id").isNull()), ""), f"{name}-alone")
        assert alone.columns == docs.columns
        docs = out
    packed = STAGE["packing"](spark, docs, "")
    assert (packed.count() == 0) == empty
    if not empty:
        assert docs.where(F.col("text").contains("[EMAIL]")).count() and not docs.where(F.col("text").contains("@")).count()
