"""Each operator against brute force on small tables, and on messy ones: nulls, empty and long texts, repeated rows, clashing names, no rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from redraft.llm import ann, components, language_id, line_dedup, packing, pii, sentencepiece_bpe, simhash, token_counts, topk, url_filter
from redraft.llm.common import Scratch

PIECES, WORDS, BYTES = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
LINE = "a line of some length that two documents share, with a few words more in it"
TEXTS = [
    None, "", "   ", "\n\n", "Plain text of a few words, and a few more words.", "Plain text of a few words, and a few more words.", f"{LINE}\nown line one", f"{LINE}!\nown line two",
    "mail joe.doe@example.com or call +1 (017) 555-7713, card 4111 1111 1111 1111 at 10.0.0.1", "日本語 テキスト\U0001f600 é\x00 ▁ x  y", "word " * 30_000, "x", "Été à la plage, où l'on nage.", "a" * 5000,
]
#: Extra columns carry the names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, k int, spans string, _n int, ids string, score string, level string, `text.x` string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "fr" if t and "É" in t else "en", None, len(t or ""), "f", i, "s", 1, "i", "s", "l", "d") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here", None, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 11)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts(docs):
    return Counter((r.doc_id, r.text) for r in docs.collect())


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(docs, none):
    sp = sentencepiece_bpe.load(PIECES).library
    want = Counter()
    for (i, t), n in texts(docs).items():
        ids = [1, *sp.encode(t or ""), 2]
        want[i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += n
    for verify in ("all", "chunks"):
        assert Counter(tuple(r) for r in sentencepiece_bpe.encode_decode(docs, PIECES, verify=verify).collect()) == want
    assert sentencepiece_bpe.encode_decode(none, PIECES, keep=True).count() == 0


def test_agenda_of_any_length_equals_the_library():
    model, rng = sentencepiece_bpe.BpeModel(PIECES, memo=50), np.random.default_rng(5)
    for _ in range(300):
        text = "".join(rng.choice(list("abcdeé  \n▁,.ntih日"), rng.integers(0, 60)))
        assert np.frombuffer(model.encode(text, check=True), "<u4").tolist() == model.library.encode(text), text


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "▁a": 1, "a": 2, "b": 3, "ab": 4, "ba": 5, "▁ab": 6, "aba": 7}
    table = np.random.default_rng(1).dirichlet(np.ones(8), 3).T
    scorer = language_id.Scorer(pieces, table)

    def brute(word):
        total = np.zeros(3)
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate((*cuts, 1), 1):
                if c:
                    parts.append(word[start:i])
                    start = i
            ways = [table[pieces[p]] if p in pieces else np.full(3, language_id.UNKNOWN if len(p) == 1 else 0.0) for p in parts]
            total += np.prod(ways, axis=0)
        return np.log(total)

    found = sorted(["▁", "▁a", "▁aba", "▁abab", "▁bab", "▁zb", "▁" + "ab" * 6])
    assert np.allclose(scorer.forward(found), [brute(w) for w in found])
    a, b, c = (np.array(scorer.forward(["▁" + "ab" * n])[0]) for n in (300, 301, 302))
    assert np.isfinite(c).all() and np.allclose(c - b, b - a, atol=1e-6)


def test_language_id(spark, docs, none):
    rows = language_id.identify(docs, PIECES).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 3))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert language_id.identify(none, PIECES).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}


def test_language_accuracy_on_held_out(spark):
    rng = np.random.default_rng(2)
    kinds = {"en": ["the", "and", "thing", "water", "house"], "de": ["der", "und", "ding", "wasser", "haus"], "fr": ["le", "et", "chose", "eau", "maison"]}
    rows = [(i, " ".join(rng.choice(kinds[lang], 12)), lang) for i, lang in enumerate(rng.choice(list(kinds), 200).tolist())]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in found) and sum(r.held_out for r in found) > 20


def test_pipeline_learns_every_language(spark):
    rare = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2][:5]
    rows = [(i, "le chat et la souris dans la maison", "fr") if i in rare else (i, "the water and the house of a thing", "en") for i in range(60)] + [(i, "le chat et la souris dans la maison", "fr") for i in rare if i >= 60]
    out = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert {r.doc_id: r.lang for r in out.collect()} == {i: lang for i, _, lang in rows}


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_packing(spark, docs, none):
    library = packing.load(WORDS).library
    want = Counter()
    for (i, t), n in texts(docs).items():
        ids = np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p in range(0, len(ids), 64):
            want[i, p // 64, p, len(ids[p : p + 64]), zlib.crc32(ids[p : p + 64].tobytes())] += n
    rows = packing.pack(docs, WORDS, capacity=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == -(-sum(r.length for r in rows) // 64)
    assert packing.pack(none, WORDS).count() == 0


def test_best_two_fit_replaces_the_smallest_by_two():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert packing.plan(counts, 10) == [([(6, 1), (2, 2)], 1), ([(3, 1)], 1)]


@pytest.mark.parametrize("seed", range(5))
def test_patterns_repeat_as_single_steps_would(seed):
    counts = np.random.default_rng(seed).integers(0, 9, 65)
    counts[0] = 0
    single, left = [], counts.copy()
    while left.any():
        used, _ = packing.plan(left, 64)[0]
        single.append(used)
        for size, n in used:
            left[size] -= n
    assert single == [used for used, n in packing.plan(counts, 64) for _ in range(n)]


# --- 5 ---------------------------------------------------------------------------------------------------------------


def brute_counts(spans, a, b):
    first = sum(a <= s < b for s, _ in spans)
    last = sum(a <= e - 1 < b for _, e in spans)
    share = sum(max(0, min(e, b) - max(s, a)) / (e - s) for s, e in spans)
    crossing = sum(a < b and ((s < a < e) or (s < b < e)) for s, e in spans)
    return {"first": first, "last": last, "share": share}, crossing


@pytest.mark.parametrize("rule", ["first", "last", "share"])
def test_token_counts(docs, none, rule):
    coder = token_counts.load(BYTES)
    rows = token_counts.count_tokens(docs, BYTES, rule).collect()
    want = Counter()
    for (i, t), n in texts(docs).items():
        if t and len(t) > 20_000:
            continue
        spans, at = coder.library.encode(t or "", add_special_tokens=False).offsets, 0
        for k, line in enumerate(re.findall(r"[^\n]*\n|[^\n]+", t or "") or [""]):
            got, crossing = brute_counts(spans, at, at + len(line))
            want[i, k, at, at + len(line), round(got[rule], 6), crossing, len(spans)] += n
            at += len(line)
    assert Counter((r.doc_id, r.section, r.start, r.end, round(r.n_tokens, 6), r.n_crossing, r.doc_tokens) for r in rows if r.doc_id != 10) == want
    assert token_counts.count_tokens(none, BYTES).count() == 0


def test_token_counts_of_given_sections(spark):
    rows = [(1, "one two three four", [("a", 0, 5), ("b", 4, 13), None, ("c", 9, 9)]), (2, None, None)]
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>"), BYTES, "first", "parts")
    assert [(r.name, r.n_tokens, r.n_crossing) for r in found.where("doc_id = 1").orderBy("section").collect()] == [(None, 1, 0), ("a", 2, 1), ("b", 1, 1), ("c", 0, 0)]
    assert found.where("doc_id = 2").count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.masks(2)
    assert len(masks) == 7
    for bits in itertools.combinations(range(64), 2):
        assert any(not m & (1 << bits[0] | 1 << bits[1]) for m in masks)
    rng = np.random.default_rng(0)
    for _ in range(2000):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not m & flips for m in simhash.masks(4))


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, none):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text is None or len(r.text) < 20_000]
    for i in range(40):
        base = list(rng.choice(words, 120))
        for j in range(rng.integers(1, 5)):
            other = list(base)
            other[int(rng.integers(0, 120))] = "edit"
            rows.append((100 + 10 * i + j, " ".join(other)))
    prints = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    want = Counter((k, f"{prints[i]:016x}", least.get(root(i))) for i, (k, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    firsts = {v for v in least.values()}
    assert Counter((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == Counter({(k, t) for k, t in rows if k in firsts})  # equal rows once, different texts of one id each
    assert kept.where("doc_id is null").count() == sum(k is None for k, _ in rows)


def test_large_buckets_are_split_exactly(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**62))
    prints = {centre} | {centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(300)}
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    scratch = Scratch(spark, "test")
    found = components.components(simhash.links(df, scratch, 4, block_rows=16), scratch)
    assert found.select("component").distinct().count() == 1 and found.count() == len(prints)


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000 + i) for i in range(50)] + [(1, None), (7, 7)]
    want = {}
    for a, b in edges:
        if b is not None and a != b:
            group = want.get(a, {a}) | want.get(b, {b})
            for x in group:
                want[x] = group
    rows = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r.node: r.component for r in rows} == {x: min(g) for x, g in want.items()} and len(rows) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------


def slow_lines(rows, size=9, least=0.8):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate(t.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (i, n))
    lines = list(first)
    sets = [{x[j : j + size] for j in range(max(1, len(x) - size + 1))} for x in lines]
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(lines)), 2):
        n = len(sets[i] & sets[j])
        if n >= least * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {x: first[lines[root(i)]] for i, x in enumerate(lines)}


def test_line_dedup(spark, docs, none):
    rng = np.random.default_rng(7)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text is not None and len(r.text) < 20_000]
    base = [" ".join(rng.choice([f"word{i}" for i in range(200)], 30)) for _ in range(30)]
    for i in range(120):
        lines = [str(base[int(rng.integers(0, 30))]) for _ in range(3)]
        lines[1] = lines[1][: len(lines[1]) // 2] + "~" + lines[1][len(lines[1]) // 2 :]
        rows.append((1000 + i, "\n".join(lines)))
    want = slow_lines(rows)
    df = spark.createDataFrame([*rows, (9999, None)], "doc_id long, text string").withColumn("_n", F.lit(1))
    text = {(i, n): line for i, t in rows for n, line in enumerate(t.split("\n"))}
    got = line_dedup.duplicates(df).collect()
    assert len(got) == sum(t.count("\n") + 1 for _, t in rows)
    for r in got:
        line = text[r.doc_id, r.line]
        if line.strip(" "):
            assert (r.first_id, r.first_line) == want[line] and r.kept == ((r.doc_id, r.line) == want[line])
        else:
            assert r.kept and r.first_id is None
    assert line_dedup.duplicates(none).count() == 0


def test_line_dedup_joins_chains_in_large_buckets(spark):
    rng = np.random.default_rng(8)
    rows = []
    for family in range(6):
        base = list(map(str, rng.choice([f"word{i}x" for i in range(300)], 24)))
        for i in range(60):  # each a few words away from the one before: neighbours are similar, the ends are not
            if i:
                base[int(rng.integers(0, 24))] = f"{family}w{i}"
            rows.append((family * 1000 + i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members = line_dedup.signatures(df.select(F.col("doc_id").alias("k"), F.col("text").alias("line")), 9, 1, 1)
    met = {}
    for r in members.collect():
        met.setdefault(r.key, []).append(r.k)
    assert max(map(len, met.values())) > 8
    text = dict(rows)
    sets = {i: {t[j : j + 9] for j in range(len(t) - 8)} for i, t in rows}
    parent = {i: i for i in text}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in {p for x in met.values() for p in itertools.combinations(sorted(set(x)), 2)}:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    assert {r.doc_id: r.first_id for r in line_dedup.duplicates(df, bands=1, rows=1).collect()} == {i: root(i) for i in text}


def test_line_dedup_of_repetitive_lines(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(20):
        word, words = f"word{i}q ", [f"{i}w{x}" for x in rng.integers(0, 10_000, 40)]
        passage, other = " ".join(words), " ".join([*words[:20], "changed", *words[21:]])
        rows += [(10 * i, word * 200), (10 * i + 1, word * 230), (10 * i + 2, word * 3), (10 * i + 3, f"{passage} " * 6), (10 * i + 4, f"{other} " * 6), (10 * i + 5, f"{passage} {other} " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_lines(rows)
    assert {r.doc_id: (r.first_id, r.first_line) for r in line_dedup.duplicates(df).collect()} == {i: want[t] for i, t in rows}


def test_line_dedup_of_rulers_and_substituted_families(spark):
    rng = np.random.default_rng(10)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    rows = [(i, x) for i, x in enumerate(["-" * 120, "-" * 121, "=" * 200, "=" * 260, "x" * 12, "x" * 60, "x" * 400, "ab" * 30, "ab" * 500, "\t\t"])]
    for family in range(3):  # large groups where similarity isn't transitive
        base = rng.choice(letters, 240)
        for i in range(150):
            own = base.copy()
            for at in rng.integers(0, 240, int(rng.integers(1, 6))):
                own[at] = rng.choice(letters)
            rows.append((1000 * (family + 1) + i, "|" + "".join(own) + "|"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_lines(rows)
    assert {r.doc_id: (r.first_id, r.first_line) for r in line_dedup.duplicates(df).collect()} == {i: want[t] for i, t in rows}


def test_bit_maps_bound_the_similarity_from_above(spark):
    rng = np.random.default_rng(11)
    base = rng.choice(list("abcdef "), 300)
    rows = []
    for i in range(24):
        own = base.copy()
        own[rng.integers(0, 300, i // 2)] = "#"
        rows.append((i, "".join(own) * (1 + i % 2)))
    lines = spark.createDataFrame(rows, "k long, line string")
    maps = Scratch(spark, "test").keep(line_dedup.bit_maps(lines, 9), "maps")
    pairs = line_dedup.renamed(maps, "a").crossJoin(line_dedup.renamed(maps, "b")).where("a < b")
    sets = {k: {t[j : j + 9] for j in range(len(t) - 8)} for k, t in rows}
    similar = {(a, b) for a, b in itertools.combinations(range(24), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    left = {(r.a, r.b) for r in pairs.where(line_dedup.possible(0.8)).select("a", "b").collect()}
    assert similar <= left and len(left) < 276
    assert {(r.a, r.b) for r in line_dedup.similar(pairs.select("a", "b"), lines, 9, 0.8).collect()} == similar


def test_line_dedup_with_names_of_its_own(spark, none):
    names = ["_row", "_lost", "_left", "_doc", "_r", "_r2", "_new", "_text"]
    df = spark.createDataFrame([(1, f"{LINE}\nmore", 9, *"abcdefgh"), (1, f"{LINE}\nmore", 9, *"abcdefgh"), (2, f"{LINE}.\nother", 9, *"ijklmnop"), (3, LINE, 9, *"qrstuvwx")], ["doc_id", "text", "n_chars", *names])
    out = line_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, f"{LINE}\nmore", 9, *"abcdefgh")] * 2 + [(2, "other", 5, *"ijklmnop")]
    assert line_dedup.deduplicate(none).count() == 0


def test_line_dedup_of_documents(spark, docs):
    out = line_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert got[6].text == f"{LINE}\nown line one" and got[7].text == "own line two" and got[7].n_chars == 12
    assert 5 not in got and got[4].text == TEXTS[4] and got[1].text == "" and got[0].text is None and got[3].text == "\n\n"
    assert out.where("doc_id is null").count() == 2


# --- 8 ---------------------------------------------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def good(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum((int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def test_base_spans(spark):
    rng = np.random.default_rng(8)
    parts = ["a", "b@", "@", "x.y", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "é", "\U0001f600", "%", "a@b.c-%x@d.e.", "1.2.3.4", "+1 (017) 555-7713", "\n", "4111111111111111"]
    rows = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(1500)] + [None, "", "1 " * 5000, "1.2.3.4 " * 300, "a" * 5000 + "@b.c"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in pii.digest(pii.detect(df), "spans", "doc_id").collect()}
    for i, t in enumerate(rows):
        spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, t or "") if good(kind, m.group()))
        joined = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        assert found[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [found[i][f"n_{kind}"] for kind, _ in BASE] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert set(joined.split(",")) <= set(found[i].spans.split(","))


def test_labelers_add_spans_and_leave_clean_texts_alone(spark, docs, none):
    rows = [(1, "Call 415-555-2671 or mail joe (at) example (dot) com. SSN: 123-45-6789, account DE89 3704 0044 0532 0130 00."), (2, "version 1.2.3 of order 2024-10-11, pages 100-200, 3.14159 and 12345678"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.masked(pii.detect(df)).collect()}
    assert out == {1: "Call [PHONE] or mail [EMAIL]. SSN: [SSN], account [IBAN].", 2: rows[1][1], 3: None}
    assert pii.detect(none).count() == 0
    assert pii.detect(docs).count() == docs.count()


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(9)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < q, np.where(truth, 1, -1), np.where(truth, -1, 1)) for q in (0.95, 0.9, 0.85, 0.5)], axis=1)
    post = pii.reliabilities(np.zeros(4000, int), votes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.95


# --- 1 and 9 ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((8, 16))
    rows = [(i, (centres[i % 8] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)] + [(50, rows[50][1]), (3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [1.0] * 5), (None, rows[1][1]), (3200, [None] * 16)]
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, key string, ids string").repartition(5)


def table(vectors):
    rows = {}
    for r in vectors.collect():
        if r.vec_id is not None and r.embedding and len(r.embedding) == 16 and all(x is not None and np.isfinite(x) for x in r.embedding):
            rows[r.vec_id] = r.embedding
    ids = np.array(sorted(rows))
    return ids, np.array([rows[i] for i in ids])


def test_exact_topk(vectors):
    ids, x = table(vectors)
    q = np.floor(256 * x).astype(np.int64)
    want = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = q @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want[int(ids[i])] = [(r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    got = {}
    for r in topk.search(vectors, block_rows=256, batch_rows=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert topk.search(vectors.limit(0)).count() == 0


def test_bounds_never_fall_below_the_score():
    rng = np.random.default_rng(11)
    x, q = rng.standard_normal((200, 23)), rng.standard_normal((50, 23))
    for level in (1, 4, 16, 64):
        assert (topk.statistics(q, level) @ topk.statistics(x, level).T >= q @ x.T - 1e-9).all()


def test_large_scores_stay_exact():
    assert topk.exact(np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0]])).tolist() == [2**60 + 3]
    assert topk.exact(np.array([[2.0**60]]), np.array([[2.0**60]])).tolist() == [2**63 - 1]


def test_neighbours(vectors):
    ids, x = table(vectors)
    keep = np.any(x != 0, axis=1)
    ids, x = ids[keep], x[keep]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.search(vectors, fit_rows=400, block_rows=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.round(u @ u[i], 12)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        mine = sorted(got.pop(int(ids[i])))
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(score - u[i] @ u[list(ids).index(v)]) < 1e-12 for _, v, score in mine)
        hits += len({int(ids[j]) for j in order} & {v for _, v, _ in mine})
        total += 5
    assert not got and hits >= 0.95 * total
    assert ann.search(vectors.limit(0)).count() == 0


def test_neighbours_come_from_the_lists(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((2000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def recall(**how):
        got = {}
        for r in ann.search(df, **how).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert set(got) == set(range(0, 2000, 50)) and all(len(set(v)) == 5 for v in got.values())
        return sum(len(set(np.argsort(-(u @ u[i]), kind="stable")[1:6].tolist()) & set(v)) for i, v in got.items()) / (5 * len(got))

    # few vectors are no reason to compare all: one list has few of the neighbours
    assert recall(probed=0.0, least_probed=1) < 0.5
    # vectors without structure, five times as many as the centres are fitted on
    assert recall(fit_rows=400) >= 0.9


# --- 10 --------------------------------------------------------------------------------------------------------------

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def slow_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for _, r in RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


def test_recall_beyond_the_fitted_sample(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((4000, 24))  # alike in all directions, the hardest case
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u[::50] @ u.T
    near[np.arange(80), np.arange(0, 4000, 50)] = -9
    want = np.argsort(-near, axis=1)[:, :5]
    got = {}
    for r in ann.search(df, fit_rows=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - near[r.query_id // 50, r.vec_id]) < 1e-12
    assert all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[50 * i] & set(w.tolist())) / 5 for i, w in enumerate(want)]) >= 0.9


def test_url_filter(spark):
    rng = np.random.default_rng(12)
    urls = [f"http://{rng.choice(['a', 'b', 'Www'])}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['fr', 'de', 'en', 'es'])}/{i}{rng.choice(['', '?q=1', '#x', '/'])}" for i in range(600)]
    urls += [None, "", "no scheme", "http://org", "http://org/", "://x.org/?", "http://EXAMPLE.ORG/es/", "http://x.org:80/", "http://notorg/", "http://é.com/fr/ü", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(0, urls[0], "h", "p"), (None, urls[1], None, None)], "page_id long, url string, host string, path string")
    rows = url_filter.filter_urls(df, RULES).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        host, path, rule = slow_rule(urls[1] if r.page_id is None else urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == dict((b, a) for a, b in RULES)[rule] if rule else r.verdict in ("allow", "block")
    free = [r for r in rows if r.page_id is not None and r.page_id < 600 and r.rule is None and "/de/" in r.path or r.rule is None and "/fr/" in r.path]
    assert sum((r.verdict == "block") == ("/de/" in r.path) for r in free) > 0.8 * len(free) > 20
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df.where("page_id > 600"), [("allow", "org/")]).collect()} == {"allow"}


def test_witten_bell_probabilities_sum_to_one():
    code = url_filter._cells([b"http://a.org/x", b"http://b.org/y"])[0]
    counts = np.bincount(code, minlength=url_filter.SIZE ** (url_filter.ORDER + 1))
    p = np.exp(url_filter._log_probabilities(counts).reshape(-1, url_filter.SIZE))
    assert np.allclose(p[:: 10_007].sum(axis=1), 1, atol=1e-4)


def test_arrow_words_of_a_column():
    index, distinct, ends = language_id.words(pa.array(["Éa b1c, ", "", "12", "日本 Ab"]))
    assert [distinct[i] for i in index] == ["éa", "b", "c", "日本", "ab"] and ends.tolist() == [3, 3, 3, 5]
