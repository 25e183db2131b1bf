"""Fuzzy line dedup by MinHash over character shingles. DataFrame operations only.

1. Equal lines become one node, named by a 64-bit hash.
2. A line's distinct shingles (runs of ``size`` UTF-16 units) are hashed once; the hash picks one of ``bands * rows`` bins
   and each bin keeps its least hash (one-permutation MinHash). Long lines with few repeated shingles leave out, unsorted,
   the hashes that can hardly be a least one; other lines make their set of shingles first, and lines of few distinct
   shingles throw them repeatedly with other hashes until the bins are about as full. Signatures are made where the
   lines are read: no text is shuffled for them.
3. ``rows`` bins make a band; lines that agree in a band share a bucket. At Jaccard 0.8 a pair meets in one of
   8 bands of 3 with probability 0.997.
4. In each bucket some leaders, drawn by hash, are compared with all others. Components of these links come from distributed
   union-find; near copies are mostly joined then, at a few comparisons each.
5. Then all pairs of a bucket that are in two components are compared, large buckets in pairs of blocks. So every pair
   that shares a bucket is either compared or joined already, and the components are those of all pairs' links.
6. A comparison first takes the bit maps of the two sets (3,072 bits): bits of one that the other lacks are shingles that it lacks,
   so they bound the Jaccard similarity from above, never too low. What they leave is compared exactly, as sets of shingles.
7. Components of all links come from distributed union-find too; each keeps its first line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redraft.llm.common import Scratch
from redraft.llm.components import components

#: Hashes per bin that a line throws, on average (a bin then stays empty once in e ** 4 times), and the most repeats of few shingles.
FULL, MOST_REPEATS = 4, 128
#: Shingles of a long line that are looked at to see that few are repeated, and how many must differ: as many as fill the bins by themselves.
LOOKED, DIFFER = 104, 98
#: Shingles beyond which a long line keeps a constant share of its hashes, as far as repeated passages may make up the rest.
REPEATED = 1000
#: Leaders of a bucket (the same one may be drawn repeatedly).
LEADERS = 3
#: Members of a bucket in one block: a task compares two blocks at once.
BLOCK = 256
#: Numbers of 64 bits in a bit map.
WORDS = 48
_LOW, _BODY = 2**40 - 1, 2**61 - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where it stands inside of another lambda."""
    return F.transform(F.array(value), body)[0]


def lines_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents' lines as columns _n (from 0), _line and _k, _k2 (two hashes; null for lines of blanks alone, which are never duplicates)."""
    parts = docs.select("*", F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_n", "_line"))
    filled = F.length(F.trim("_line")) > 0
    return parts.withColumn("_k", F.when(filled, F.xxhash64("_line"))).withColumn("_k2", F.when(filled, F.xxhash64("_line", F.lit(1))))


def _units(lines: DataFrame, size: int) -> DataFrame:
    """(k, u, m): the UTF-16 units of the lines that have a shingle, and how many begin in them."""
    return lines.select("k", F.encode("line", "UTF-16BE").alias("u")).where(F.length("u") >= 2 * size).select("k", "u", (F.expr("length(u) div 2").cast("int") - (size - 1)).alias("m"))


def _hashes(units: Column, starts: Column, size: int) -> Column:
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substr(units, i, F.lit(2 * size)))))


def shingles(line: Column, size: int) -> Column:
    """The set of a line's shingles' hashes."""
    return let(F.encode(line, "UTF-16BE"), lambda u: _hashes(u, F.sequence(F.lit(1), F.greatest(F.length(u) - 2 * size + 1, F.lit(1)), F.lit(2)), size))


def signatures(lines: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(key, k): the buckets of the lines (k, line), which may repeat: what they add up to doesn't depend on it."""
    bins = bands * rows

    def repeats(n: Column) -> Column:  # powers of two, as logarithms; zero for all lines with enough shingles
        return F.least(F.greatest(F.ceil(F.log2(F.lit(float(FULL * bins)) / n)), F.lit(0)), F.lit(MOST_REPEATS.bit_length() - 1)).cast("int")

    def thrown(found: Column) -> Column:
        """All throws of a set. A line near the end of a range of sizes is thrown for the next range too, where its near copies may lie."""
        levels = F.array_distinct(F.array(repeats(F.size(found)), repeats(F.size(found) * 1.25)))
        once = F.filter(found, lambda h: h.bitwiseAND(_LOW) < F.lit(float((_LOW + 1) * FULL * bins)) / F.size(found))  # of more shingles than the bins need

        def level(e: Column) -> Column:
            mark = F.call_function("shiftleft", e.cast("long"), F.lit(61))
            times = F.sequence(F.lit(0), (F.pow(F.lit(2.0), e) - 1).cast("int"))
            return let(mark, lambda x: F.flatten(F.transform(times, lambda r: F.transform(found, lambda h: F.when(r == 0, h).otherwise(F.xxhash64(h, r)).bitwiseAND(_BODY).bitwiseOR(x)))))

        return F.when(F.size(found) > FULL * bins, F.transform(once, lambda h: h.bitwiseAND(_BODY))).otherwise(F.flatten(F.transform(levels, level)))

    units = _units(lines, size)
    step = F.expr(f"m div {LOOKED}")
    looked = let(F.col("u"), lambda u: F.size(_hashes(u, F.sequence(F.lit(1), 2 * step * (LOOKED - 1) + 1, 2 * step), size)))
    # so many different ones among those looked at mean at least as many in all: such a line is in the first range of sizes for certain
    told = units.withColumn("plain", F.when(F.col("m") >= max(2 * FULL * bins, LOOKED), looked >= max(FULL * bins, DIFFER)).otherwise(F.lit(False)))
    every = F.sequence(F.lit(1), 2 * F.col("m") - 1, F.lit(2))
    own = let(F.col("u"), lambda u: let(_hashes(u, every, size), thrown))
    laid = told.select("k", "m", "plain", F.when(F.col("plain"), F.col("u")).alias("u"), F.when(F.col("plain"), F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1)).otherwise(own).alias("all"))
    one = laid.select("k", "m", "plain", "u", F.explode_outer("all").alias("x"))  # outer: else the optimizer computes the arrays once more, for a filter
    here = F.xxhash64(F.substr("u", (2 * F.col("x") + 1).cast("int"), F.lit(2 * size))).bitwiseAND(_BODY)
    hashed = one.select("k", "m", "plain", F.when(F.col("plain"), here).otherwise(F.col("x")).alias("h"))
    low = F.col("h").bitwiseAND(_LOW)
    likely = hashed.where(~F.col("plain") | (low < F.lit(float((_LOW + 1) * FULL * bins)) / F.least("m", F.lit(REPEATED))))
    split = likely.select("k", F.shiftrightunsigned("h", 61).cast("int").alias("level"), F.pmod(F.shiftrightunsigned("h", 40), F.lit(bins)).cast("int").alias("bin"), F.shiftright(low, 9).cast("int").alias("v"))
    least = split.groupBy("k", "level").agg(*[F.min(F.when(F.col("bin") == j, F.col("v"))).alias(f"v{j}") for j in range(bins)])

    def band(b: int) -> Column:
        own = [F.col(f"v{j}") for j in range(b * rows, (b + 1) * rows)]
        return F.when(reduce(Column.__and__, [x.isNotNull() for x in own]), F.xxhash64("level", F.lit(b), *own))

    return least.select("k", F.explode_outer(F.array(*[band(b) for b in range(bands)])).alias("key")).where("key is not null").select("key", "k")


def bit_maps(lines: DataFrame, size: int) -> DataFrame:
    """(k, m, p, b0, ...) of distinct lines (k, line): how many shingles begin in a line, a bit for the hash of each, and how many bits are set."""
    one = _units(lines, size).select("k", "m", "u", F.explode_outer(F.sequence(F.lit(0), F.col("m") - 1)).alias("x"))
    hashed = one.select("k", "m", F.xxhash64(F.substr("u", 2 * F.col("x") + 1, F.lit(2 * size))).alias("h"))
    bits = hashed.select("k", "m", F.pmod(F.shiftrightunsigned("h", 6), F.lit(WORDS)).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int")).alias("bit"))
    maps = bits.groupBy("k").agg(F.max("m").alias("m"), *[F.bit_or(F.when(F.col("word") == j, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"b{j}") for j in range(WORDS)])
    return maps.withColumn("p", reduce(Column.__add__, [F.bit_count(f"b{j}") for j in range(WORDS)]))


def renamed(maps: DataFrame, k: str) -> DataFrame:
    """The bit maps of one side of a pair: columns k, mk, pk, k0, ..."""
    return maps.select(F.col("k").alias(k), F.col("m").alias(f"m{k}"), F.col("p").alias(f"p{k}"), *[F.col(f"b{j}").alias(f"{k}{j}") for j in range(WORDS)])


def possible(least: float) -> Column:
    """Whether the bit maps of a pair (a, b) allow this similarity. They never rule out a pair that has it.

    With c common bits, a has at least x = pa - c shingles that b lacks, b at least y = pb - c, and they have at most
    common = min(ma - x, mb - y) in common, as a line has no more shingles than places where they begin. Asked is
    common >= least * (common + x + y), solved for c: written so, c stands once and the generated code is small enough to be compiled.
    """
    c = reduce(Column.__add__, [F.bit_count(F.col(f"a{j}").bitwiseAND(F.col(f"b{j}"))) for j in range(WORDS)])
    rest = F.least(F.col("ma") - F.col("pa"), F.col("mb") - F.col("pb"))
    return (1 + least) * c >= least * (F.col("pa") + F.col("pb")) - (1 - least) * rest - 1e-9


def similar(pairs: DataFrame, lines: DataFrame, size: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have at least this Jaccard similarity, exactly."""
    known = lines.select("k", "line")
    both = pairs.join(known.select(F.col("k").alias("a"), F.col("line").alias("la")), "a").join(known.select(F.col("k").alias("b"), F.col("line").alias("lb")), "b")
    sets = both.select("a", "b", let(F.struct(shingles(F.col("la"), size).alias("a"), shingles(F.col("lb"), size).alias("b")), lambda s: F.struct(F.size(F.array_intersect(s.a, s.b)).alias("n"), (F.size(s.a) + F.size(s.b)).alias("total"))).alias("s"))
    return sets.where(F.col("s.n") >= least * (F.col("s.total") - F.col("s.n"))).select("a", "b")


def links(lines: DataFrame, scratch: Scratch, size: int, bands: int, rows: int, least: float) -> DataFrame:
    """Verified links (a, b) of the lines (k, line): they join all that share a bucket and are similar."""
    buckets = scratch.keep(signatures(lines, size, bands, rows), "buckets", release=True)
    turns = [F.xxhash64(F.lit(i), "key") for i in range(LEADERS)]  # a leader is the least of its bucket in an order of the bucket's own
    drawn = [F.min(F.col("k").bitwiseXOR(turn)).alias(f"z{i}") for i, turn in enumerate(turns)]
    sizes = scratch.keep(buckets.groupBy("key").agg(F.count("*").alias("n"), *drawn).where("n > 1"), "sizes", release=True)
    leaders = F.array(*[F.col(f"z{i}").bitwiseXOR(turn) for i, turn in enumerate(turns)])
    members = scratch.keep(buckets.join(sizes, "key").select("key", "k", "n", leaders.alias("leads")), "members", release=True)
    scratch.drop("buckets")
    scratch.drop("sizes")
    # Texts are wanted of the members alone. Their hashes' low bits, of which there are at most 2 ** 20 whatever the input,
    # are broadcast and keep most other texts from the shuffle; the join by the whole hash decides.
    names = scratch.keep(members.select("k").distinct(), "names")
    low = F.col("k").bitwiseAND(2**20 - 1)
    likely = lines.withColumn("_low", low).join(F.broadcast(names.select(low.alias("_low")).distinct()), "_low", "left_semi")
    met = scratch.keep(likely.groupBy("k").agg(F.min("line").alias("line")).join(names, "k", "left_semi"), "met", release=True)
    scratch.drop("names")
    maps = scratch.keep(bit_maps(met, size), "maps", release=True)
    led = members.select("k", F.explode(F.array_distinct("leads")).alias("lead")).where("k <> lead")
    first = led.select(F.least("k", "lead").alias("a"), F.greatest("k", "lead").alias("b")).distinct()
    first = first.join(renamed(maps, "a"), "a").join(renamed(maps, "b"), "b").where(possible(least)).select("a", "b")
    near = scratch.keep(similar(scratch.keep(first, "pairs-1", release=True), met, size, least), "near-1", release=True)
    scratch.drop("pairs-1")
    joined = scratch.keep(components(near, scratch), "joined")
    scratch.drop("near-1")
    of = scratch.keep(members.join(joined, members.k == joined.node, "left").select("key", "k", "n", F.array_contains("leads", F.col("k")).alias("head"), F.coalesce("component", "k").alias("c")), "labelled", release=True)
    scratch.drop("members")
    several = of.where(~F.col("head")).groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    last = (F.ceil(F.col("n") / BLOCK) - 1).cast("int")
    # leaders have been compared with everyone; who is joined already needs no comparison
    rest = scratch.keep(of.where(~F.col("head")).join(several, "key"), "rest", release=True)
    scratch.drop("labelled")
    # a pair that shares several buckets is compared in the one of the least key alone
    keys = rest.groupBy("k").agg(F.collect_list("key").alias("keys"))
    known = rest.join(maps, "k").join(keys, "k").withColumn("own", F.pmod(F.xxhash64("k"), last + 1).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = scratch.keep(known.drop("n", "head").withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other"), "dealt", release=True)
    one, two = (dealt.select("key", "lo", "hi", F.col("k").alias(k), F.col("c").alias(f"c{k}"), F.col("own").alias(f"own{k}"), F.col("keys").alias(f"keys{k}"), F.col("m").alias(f"m{k}"), F.col("p").alias(f"p{k}"), *[F.col(f"b{j}").alias(f"{k}{j}") for j in range(WORDS)]) for k in "ab")
    pairs = one.join(two, (one.key == two.key) & (one.lo == two.lo) & (one.hi == two.hi) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ((F.col("owna") != F.col("ownb")) | (one.lo == one.hi)) & possible(least) & (F.array_min(F.array_intersect("keysa", "keysb")) == one.key)).select("a", "b").distinct()
    found = scratch.keep(similar(scratch.keep(pairs, "pairs-2", release=True), met, size, least), "near-2", release=True)
    for done in ("rest", "dealt", "maps", "met", "pairs-2"):
        scratch.drop(done)
    return joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)


def find(docs: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id", size: int = 9, bands: int = 8, rows: int = 3, least: float = 0.8) -> DataFrame:
    """(k, k2, doc, n): for every distinct line its hashes and the place of its component's first line.

    First is the smallest (id, line number), null ids before others.
    """
    place = F.struct(F.col(id_col).alias("doc"), F.col("_n").alias("n"))
    every = lines_of(docs.select(id_col, F.col(text_col).alias("_text")), "_text").where("_k is not null")
    firsts = scratch.keep(every.groupBy(F.col("_k").alias("k")).agg(F.min(F.struct(place.alias("at"), F.col("_k2").alias("k2"))).alias("x")).select("k", "x.k2", "x.at"), "firsts", release=True)
    linked = links(every.select(F.col("_k").alias("k"), F.col("_line").alias("line")), scratch, size, bands, rows, least)
    classes = scratch.keep(components(linked, scratch), "classes")
    first = classes.join(firsts, classes.node == firsts.k).groupBy("component").agg(F.min("at").alias("first"))
    of = scratch.keep(classes.join(scratch.keep(first, "first"), "component").select(F.col("node").alias("k"), "first"), "of")
    out = scratch.keep(firsts.join(of, "k", "left").select("k", "k2", F.coalesce("first", "at").alias("at")).select("k", "k2", "at.doc", "at.n"), "places")
    for done in ("firsts", "joined", "near-2", "classes", "first", "of"):
        scratch.drop(done)
    return out


def marked(docs: DataFrame, scratch: Scratch, text_col: str, id_col: str, **how) -> DataFrame:
    """The documents' lines (as of ``lines_of``) with _keep, and _doc, _at: the place of their component's first line."""
    known = find(docs, scratch, text_col, id_col, **how)
    rows = lines_of(docs, text_col)
    both = rows.join(known.select(F.col("k").alias("_k"), F.col("k2").alias("_first_k2"), F.col("doc").alias("_doc"), F.col("n").alias("_at")), "_k", "left")
    own = F.col("_doc").eqNullSafe(F.col(id_col)) & (F.col("_at") == F.col("_n"))
    return both.withColumn("_keep", F.col("_k").isNull() | own | (F.col("_k2") != F.col("_first_k2")))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Every line: id, line (from 0), kept, first_id, first_line (null for blank lines, which are all kept).

    Of each component of near-equal lines the first is kept. A null text has no lines, an empty one a blank line. Rows that repeat an id hold the same places:
    where such a place is a first one, it is kept in each. Null ids count as one id before all others. Two different lines
    of equal 64-bit hash are both kept. Lines shorter than a shingle are duplicates only if equal; lines of blanks (U+0020) alone count as blank, lines of tabs don't. An empty table gives an
    empty result; only the two named columns are read. ``how``: size (characters a shingle), bands, rows, least (similarity).
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scratch, "text", "doc_id", **how)
    return rows.select(F.col("doc_id").alias(id_col), F.col("_n").alias("line"), F.col("_keep").alias("kept"), F.col("_doc").alias("first_id"), F.col("_at").alias("first_line"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """The documents without the lines that aren't kept; those that lose every line that isn't blank go.

    Other columns stay; ``chars_col``, if there, becomes the new length. Documents without such lines (blank, empty, null) stay as they are. Repeated rows
    are cleaned each; neither ids nor texts need be unique, and other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    known = find(docs, scratch, text_col, id_col, **how)
    # rows of equal id and text lose the same lines, so these two name a row; nested, no name of a column can clash
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    row = [F.xxhash64(F.lit(seed), ident, text).alias(name) for seed, name in ((1, "_r"), (2, "_r2"))]
    rows = lines_of(docs.select(*row, ident.alias("_id"), text.alias("_text")), "_text").where("_k is not null").select("_r", "_r2", "_id", "_n", "_k", "_k2")
    both = rows.join(known.select(F.col("k").alias("_k"), F.col("k2").alias("_first_k2"), "doc", "n"), "_k")
    gone = both.where(~((F.col("doc").eqNullSafe(F.col("_id")) & (F.col("n") == F.col("_n"))) | (F.col("_k2") != F.col("_first_k2"))))
    lost = scratch.keep(gone.groupBy("_r", "_r2").agg(F.collect_set("_n").alias("_lost")), "lost", release=True)
    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_doc"), text.alias("_text"), *row)
    parts = F.split("_text", "\n", -1)
    left = let(F.struct(parts.alias("p"), F.map_from_entries(F.transform("_lost", lambda x: F.struct(x, F.lit(True)))).alias("l")), lambda s: F.filter(s.p, lambda _, i: F.element_at(s.l, i).isNull()))
    out = whole.join(lost, ["_r", "_r2"], "left").withColumn("_left", F.when(F.col("_lost").isNotNull(), left))
    out = out.where(F.col("_left").isNull() | F.exists("_left", lambda x: F.length(F.trim(x)) > 0)).withColumn("_new", F.array_join("_left", "\n"))

    def column(name: str) -> Column:
        old = F.col("_doc").getField(name)
        if name == text_col:
            return F.coalesce("_new", old)
        if name == chars_col:
            return F.when(F.col("_new").isNotNull(), F.length("_new").cast(docs.schema[name].dataType)).otherwise(old)
        return old

    return out.select(*[column(n).alias(n) for n in docs.columns])
