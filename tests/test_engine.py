"""Acceptance cases on text blocks, kernels against brute force, and properties."""

import itertools
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redraft.functions import text as tx
from redraft.functions.ngrams import gram_total, ngrams
from redraft.operators import anchors, candidates, diff, graph, keyed, layout, ordered, scoring, sourcemap
from redraft.options import Options
from redraft.plans import catalog

TEXTS = st.text("abc ", max_size=7)


def blocks(spark, rows):
    return spark.createDataFrame([(p, i, t) for p, i, t in rows], "pair_id long, block int, text string")


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS)
def test_hunks_are_a_shortest_script(a, b):
    found = diff.hunks(a, b, 100)
    out, at = [], 0
    for o0, o1, n0, n1 in found:
        out.append(a[at:o0])
        out.append(b[n0:n1])
        at = o1
    assert "".join(out) + a[at:] == b
    assert sum(o1 - o0 + n1 - n0 for o0, o1, n0, n1 in found) == len(a) + len(b) - 2 * diff.claims(a, b)["common"]


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_claims_hold_for_every_optimum(a, b):
    best, optima = -1, []
    for k in range(min(len(a), len(b)), -1, -1):
        for x in itertools.combinations(range(len(a)), k):
            for y in itertools.combinations(range(len(b)), k):
                if all(a[i] == b[j] for i, j in zip(x, y)):
                    best = k
                    optima.append((set(x), set(y)))
        if best >= 0:
            break
    got = diff.claims(a, b)
    assert got["common"] == best
    assert got["old_mandatory"] == [i for i in range(len(a)) if all(i not in x for x, _ in optima)]
    assert got["new_mandatory"] == [j for j in range(len(b)) if all(j not in y for _, y in optima)]


def test_distance_limit_is_unresolved(spark):
    rows = spark.createDataFrame([(1, 0, 0, "aaaa", "bbbb"), (1, 1, 1, "same", "same")], "pair_id long, old int, new int, old_text string, new_text string")
    assert [(r.old, r.kind) for r in diff.diff(rows, 2).collect()] == [(0, "unresolved")]


def align(spark, old, new):
    a, b = (blocks(spark, [(1, i, t) for i, t in enumerate(x)]).withColumn("window", F.lit(0)) for x in (old, new))
    found = ordered.align(a, b).collect()
    return sorted((r.kind, r.old, r.new) for r in found if not (r.kind == "match" and old[r.old] == new[r.new]))


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        (["one two three", "four five six"], ["one two three", "four five six"], []),
        (["Release 10 of the tool", "end of text"], ["Release 20 of the tool", "end of text"], [("match", 0, 0)]),
        (["first part", "last part here"], ["first part", "a wholly other thing", "last part here"], [("insertion", None, 1)]),
        (["first part", "a wholly other thing", "last part here"], ["first part", "last part here"], [("deletion", 1, None)]),
    ],
)
def test_ordered_alignment(spark, old, new, want):
    assert align(spark, old, new) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5), st.integers(0, 5), st.data())
def test_paths_and_their_margins_equal_a_search_of_all_paths(n, m, data):
    scores = np.array(data.draw(st.lists(st.sampled_from([0.0, 0.2, 0.5, 0.55, 0.8, 1.0]), min_size=n * m, max_size=n * m))).reshape(n, m)
    gap, least = -0.2, 0.5

    def values(i, j):
        """(value, matches) of every set of matches from (i, j) on."""
        yield gap * (n - i + m - j), ()
        for p in range(i, n):
            for q in range(j, m):
                if scores[p, q] >= least:
                    for v, rest in values(p + 1, q + 1):
                        yield gap * (p - i + q - j) + scores[p, q] + v, ((p, q), *rest)

    every = list(values(0, 0))
    path, total, others = ordered.best_path(scores, gap, least)
    assert abs(total - max(v for v, _ in every)) < 1e-9
    assert any(abs(v - total) < 1e-9 and list(s) == path for v, s in every)
    for pair, other in zip(path, others, strict=True):
        assert abs(other - max(v for v, s in every if pair not in s)) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12), st.integers(1, 4))
def test_similarities_are_multiset_dice(a, b, n):
    def grams(t):
        return Counter(t[i : i + n] for i in range(len(t) - n + 1)) if len(t) > n else Counter([t, *(t if len(t) > 1 else "")]) if t else Counter()

    x, y = grams(a), grams(b)
    total = sum(x.values()) + sum(y.values())
    want = 2 * sum((x & y).values()) / total if total else 1.0
    assert abs(ordered.similarities([a, "zz"], [b], n)[0, 0] - want) < 1e-12


def test_ngrams_of_code_points(spark):
    rows = spark.createDataFrame([("",), ("a",), ("ab",), ("abc",), ("a\U0001f600bé",), (None,)], "t string")
    got = [(r.g, r.n) for r in rows.select(ngrams(F.col("t"), 3).alias("g"), gram_total(F.col("t"), 3).alias("n")).collect()]
    assert got == [([], 0), (["a"], 1), (["ab", "a", "b"], 3), (["abc", "a", "b", "c"], 4), (["a\U0001f600b", "\U0001f600bé"], 2), (None, None)]


def test_large_windows_are_unresolved_not_unchanged(spark):
    a = blocks(spark, [(1, i, str(i)) for i in range(5)]).withColumn("window", F.lit(0))
    assert {r.kind for r in ordered.align(a, a, most_cells=10).collect()} == {"unresolved"}


def test_chain_is_longest_and_monotone(spark):
    pairs = [(1, o, n, False) for o, n in enumerate([2, 0, 1, 5, 3, 4])] + [(2, 0, 1, False), (2, 1, 0, True)]
    rows = anchors.chain(spark.createDataFrame(pairs, "pair_id long, old int, new int, label boolean")).collect()
    assert sorted(r.new for r in rows if r.pair_id == 1 and r.in_chain) == [0, 1, 3, 4]
    assert [r.label for r in rows if r.pair_id == 2 and r.in_chain] == [True]


def test_candidates_find_edits_and_bands_agree_with_dice(spark):
    old = blocks(spark, [(1, 0, "the quick brown fox jumps over it"), (1, 1, "nothing in common"), (1, 2, "ab")])
    new = blocks(spark, [(1, 0, "the quick brown fox jumped over it"), (1, 1, "ab")])
    best = candidates.inverted_index(old, new, 3, 1)
    assert {(r.old, r.new) for r in best.where("score > 0.5").collect()} == {(0, 0), (2, 1)}
    assert (0, 0) in {(r.old, r.new) for r in candidates.lsh(old, new, 3, 16, 4).select("old", "new").collect()}
    assert {(r.old, r.new) for r in candidates.exact(old, new).collect()} == {(2, 1)}


def test_normalisation(spark):
    rows = spark.createDataFrame([("eﬃcient 　x", "12 of 3.5 things in a longer text"), ("", "1,000"), (None, None)], "a string, b string")
    got = rows.select(tx.canonical(F.col("a")).alias("a"), tx.matching(F.col("b"), 0.3).alias("b")).collect()
    assert [tuple(r) for r in got] == [("efficient x", "<NUM> of <NUM> things in a longer text"), ("", "1,000"), (None, None)]
    joined = spark.createDataFrame([("well-", "known"), ("a­", "b"), ("1", "2"), ("end", "start"), ("x.", "Y"), ("日", "本")], "a string, b string")
    assert [r[0] for r in joined.select(tx.joined_lines(F.col("a"), F.col("b"))).collect()] == ["well-known", "ab", "1 2", "end start", "x.\nY", "日本"]
    assert spark.createDataFrame([("a\x1b[0m‮b",)], "a string").select(tx.escape(F.col("a"))).first()[0] == "a\\u{1b}[0m\\u{202e}b"
    assert spark.createDataFrame([("é",)], "a string").select(tx.nfc("a")).first()[0] == "é"


def test_keys_absent_only_in_closed_populations(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in (["x", "y"], ["x"]))
    assert dict(keyed.key_presence(a, b, "k").collect()) == {"x": "Matched", "y": "AbsentInDocument"}
    assert dict(keyed.key_presence(a, b, "k", complete_new=False).collect())["y"] == "Unknown"
    c = spark.createDataFrame([("x",), ("z",)], "k string")
    assert dict(keyed.key_presence(a, c, "k").collect())["y"] == "PresentOnly"


def test_coverage_is_a_union(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 4, 4), (1, 10, 12)], "pair_id long, start int, end int")
    totals = spark.createDataFrame([(1, 20), (2, 0)], "pair_id long, total long")
    assert {r.pair_id: (r.resolved, r.ratio) for r in scoring.coverage(spans, totals, ["pair_id"]).collect()} == {1: (10, 0.5), 2: (0, None)}


def test_single_edit(spark):
    rows = spark.createDataFrame([(1, "abc", "abd"), (2, "abc", "abbc"), (3, "abc", "xyc"), (4, "", "a"), (5, "same", "same")], "k long, old_text string, new_text string")
    assert {r.k: (r.at, r.old_token, r.new_token) for r in diff.single_edit(rows, ("k",)).collect()} == {1: (2, "c", "d"), 2: (2, "", "b"), 4: (0, "", "a")}


def test_options_are_checked():
    with pytest.raises(ValueError):
        Options(ngram=0)
    with pytest.raises(ValueError):
        Options(mask_share=2)


def test_registered_oracles_match_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_assignment_is_best(n, m, data):
    w = np.array(data.draw(st.lists(st.lists(st.integers(0, 9), min_size=m, max_size=m), min_size=n, max_size=n)))
    best = 0
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for cols in itertools.permutations(range(m), k):
                best = max(best, int(sum(w[i, j] for i, j in zip(rows, cols))))
    total, pairs = graph.assign(w)
    assert total == best == sum(int(w[p]) for p in pairs)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_ties_are_not_mandatory(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 1, 5), (1, 0, 1, 5), (1, 1, 0, 5), (2, 0, 0, 3), (2, 0, 1, 2)], "pair_id long, old long, new long, weight long")
    found = graph.solve(rows).collect()
    assert {(r.pair_id, r.mandatory) for r in found} == {(1, False), (2, True)}
    assert [r.weight for r in graph.solve(rows, most=1).collect()] == [None, None]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_mandatory_pairs_are_those_of_every_optimum(n, m, data):
    w = np.array(data.draw(st.lists(st.lists(st.integers(0, 4), min_size=m, max_size=m), min_size=n, max_size=n)))
    total, pairs = graph.assign(w)
    found, must = graph.solution(w)
    assert found == pairs
    for p, mandatory in zip(pairs, must, strict=True):
        other = w.copy()
        other[p] = 0
        assert mandatory == (graph.assign(other)[0] < total)


def test_long_documents_are_solved(spark):
    lines = [(1, i, i, 10) for i in range(450)] + [(1, 1000 + i, 1000 + j, 7) for i in range(30) for j in range(30)]
    found = graph.solve(spark.createDataFrame(lines, "pair_id long, old long, new long, weight long")).collect()
    assert {(r.old, r.new) for r in found if r.old < 1000} == {(i, i) for i in range(450)}
    assert len(found) == 480 == len({r.old for r in found}) == len({r.new for r in found})
    assert all(r.mandatory == (r.old < 1000) and r.weight == (10 if r.old < 1000 else 7) for r in found)


def test_blocks_have_the_lines_of_whole_texts(spark, tmp_path):
    text = "short\n" + " " * 950 + "beyond\n" + "x" * 2000
    spark.createDataFrame([(7, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sum(r.lines for r in catalog.glyph_blocks(spark, str(tmp_path)).collect()) == 3


def test_span_overlap(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 8, 10)], "pair_id long, start int, end int")
    b = spark.createDataFrame([(1, 3, 9), (2, 0, 1)], "pair_id long, start int, end int")
    assert {r.pair_id: (r.both, r.either) for r in scoring.span_overlap(a, b, ["pair_id"]).collect()} == {1: (3, 10), 2: (0, 1)}


def test_page_anchors_merge_on_a_diagonal(spark):
    old = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y")], "pair_id long, text string")
    new = spark.createDataFrame([(1, "z a b c d e q f g"), (2, None)], "pair_id long, text string")
    assert [(r.pair_id, r.old_from, r.new_from, r.length) for r in anchors.page_anchors(old, new, 3).collect()] == [(1, 0, 1, 5)]


def test_source_maps_equal_a_walk_over_characters(spark):
    texts = ["a ﬁ  b\t c", "ﬃ", "  ", "plain text here", "", None, "x  ", "a\u3000b ﬀﬂ  ﬅ\U0001f600  z", " ﬁ ﬁ "]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "pair_id long, block int, raw string")
    ranges, want = [], {}
    for i, t in enumerate(texts):
        if t is None:
            continue
        sources = []
        for k, c in enumerate(t):
            blank = c in " \t\u3000"
            if blank and sources and k and t[k - 1] in " \t\u3000":
                sources[-1] = (sources[-1][0], k + 1)
            else:
                sources += [(k, k + 1)] * (1 if blank else len(tx.LIGATURES.get(c, c)))
        for s in range(len(sources)):
            for e in range(s + 1, len(sources) + 1):
                ranges.append((1, i, s, e))
                exact = (s == 0 or sources[s - 1] != sources[s]) and (e == len(sources) or sources[e - 1] != sources[e])
                want[i, s, e] = (sources[s][0], sources[e - 1][1], "Exact" if exact else "WithinSource")
    found = sourcemap.project(spark.createDataFrame(ranges, "pair_id long, block int, start long, end long"), sourcemap.events(rows)).collect()
    assert {(r.block, r.start, r.end): (r.raw_start, r.raw_end, r.precision) for r in found} == want


def test_source_maps_of_very_long_lines(spark):
    rows = spark.createDataFrame([(1, 0, "word " * 100_000 + "ﬁ"), (1, 1, "x" * 500_000 + "  ")], "pair_id long, block int, raw string")
    found = sorted((r.block, r.raw_start, r.raw_end, r.start, r.end, r.kind) for r in sourcemap.events(rows).collect())
    assert found == [(0, 500_000, 500_001, 500_000, 500_002, "ligature"), (1, 500_000, 500_002, 500_000, 500_001, "blank")]


def test_lines_come_from_places_not_from_order(spark):
    rows = [(1, 0, k, c, x, y, 6.0, 10.0) for k, (c, x, y) in enumerate([("c", 72.0, 700.0), ("b", 78.0, 712.5), ("a", 72.0, 712.0), ("d", 90.0, 699.0)])]
    glyphs = spark.createDataFrame(rows, "pair_id long, page int, id long, char string, x double, y double, width double, size double")
    assert sorted((r.line, r.text) for r in layout.lines(layout.baselines(glyphs)).collect()) == [(0, "ab"), (1, "c d")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)).map(sorted), max_size=5), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)).map(sorted), max_size=5))
def test_token_metrics_equal_sets_of_tokens(spark, a, b):
    sides = [spark.createDataFrame([(1, *x) for x in side], "pair_id long, start long, end long") for side in (a, b)]
    x, y = ({t for s, e in side for t in range(s, e)} for side in (a, b))
    totals = spark.createDataFrame([(1, "m", 20)], "pair_id long, kind string, total long")
    r = scoring.token_metrics(*sides, totals, ["pair_id"], ["kind"]).first()
    assert (r.tp, r.fp, r.fn, r.unchanged) == (len(x & y), len(x - y), len(y - x), 20 - len(y))
    assert abs(r.f1 - (2 * r.precision * r.recall / (r.precision + r.recall) if r.precision + r.recall else 0.0)) < 1e-12
    assert r.precision == (len(x & y) / len(x) if x else 1.0) and r.recall == (len(x & y) / len(y) if y else 1.0)


def test_quality_and_retained_texts(spark):
    rows = spark.createDataFrame([("a", True, True, False), ("a", True, False, True), ("b", False, True, None), ("c", True, True, True)], "m string, expected boolean, detected boolean, right_kind boolean")
    found = {r.m: (r.recall, r.kind_accuracy, r.false_alarms) for r in scoring.quality(rows, ["m"]).collect()}
    assert found == {"a": (0.5, 0.0, 0), "b": (None, None, 1), "c": (1.0, 1.0, 0)}
    texts = spark.createDataFrame([(1, "ab\U0001f600d"), (2, ""), (3, None)], "k long, text string")
    assert [tuple(r) for r in scoring.retained(texts, "text", 3, F.lit("t")).orderBy("k").collect()] == [(1, "ab\U0001f600", 1, "t#3-4"), (2, "", 0, None), (3, None, 0, None)]
