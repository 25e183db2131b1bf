"""Node and edge tables, connected conflicts, and the weighted assignment of counterparts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.operators.pairing import together, whole_keys

#: Tag names and the node kinds they stand for (fixed values); other names are "other".
KINDS = {
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "li": "list_item", "ul": "list", "ol": "list", "table": "table", "tr": "row", "td": "cell", "th": "cell",
    "a": "link", "img": "figure", "figure": "figure", "div": "section", "section": "section", "article": "section", "body": "document", "html": "document",
}


def tags(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, node, tag, kind): opening tags in order, names folded to lower case, with their kinds."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("node", "tag"))
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    lower = F.lower("tag")
    return found.select(key, "node", lower.alias("tag"), F.coalesce(F.element_at(names, lower), F.lit("other")).alias("kind"))


def dangling(nodes: DataFrame, edges: DataFrame, key: str = "pair_id", node: str = "block") -> DataFrame:
    """(key, src, dst): edges with an end that is no node."""
    ends = nodes.select(key, F.col(node).alias("_n"))
    no_src = edges.join(ends.withColumnRenamed("_n", "src"), [key, "src"], "left_anti")
    no_dst = edges.join(ends.withColumnRenamed("_n", "dst"), [key, "dst"], "left_anti")
    return no_src.select(key, "src", "dst").unionByName(no_dst.select(key, "src", "dst")).distinct()


def assign(weights: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Largest total weight (whole numbers) of a one-to-one assignment, zero weights left out."""
    pairs = _pairs(_matched(weights)[0], weights)
    return int(sum(weights[p] for p in pairs)), pairs


def _pairs(match: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
    """The cells of a matching that have weight."""
    return sorted((i, j) for j, i in enumerate(match.tolist()) if i < weights.shape[0] and j < weights.shape[1] and weights[i, j] > 0)


def solution(weights: np.ndarray) -> tuple[list[tuple[int, int]], list[bool]]:
    """The pairs of ``assign``, and for each whether every best assignment has it.

    The best assignments (filled up to a square by zero weights) are those of tight cells alone: one without a pair exists
    if and only if the pair lies on a cycle of pairs and other tight cells.
    """
    match, tight = _matched(weights)
    size = len(match)
    column = np.empty(size, int)
    column[match] = np.arange(size)
    after = tight[:, column]  # from a row to the row that has one of its tight columns
    after[np.arange(size), np.arange(size)] = False
    cycle, pairs = _cycles(after), _pairs(match, weights)
    alone = np.bincount(cycle, minlength=size) == 1
    return pairs, [bool(alone[cycle[i]]) for i, _ in pairs]


def _matched(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each column of the square of zero-filled weights, and its tight cells; shortest augmenting paths with dual prices."""
    n, m = weights.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1), np.int64)
    cost[1 : n + 1, 1 : m + 1] = -weights
    u, v, match = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j = i, 0
        least, way, used = np.full(size + 1, np.iinfo(np.int64).max // 4), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            slack = cost[row] - u[row] - v
            better = ~used & (slack < least)
            better[0] = False
            least[better], way[better] = slack[better], j
            free = np.where(used, np.iinfo(np.int64).max, least)
            free[0] = np.iinfo(np.int64).max
            delta = free.min()
            ties = np.flatnonzero(free == delta)  # among equals a column without a row ends the path
            k = int(ties[np.argmin(match[ties] != 0)])
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    return match[1:] - 1, (cost - u[:, None] - v == 0)[1:, 1:]


def _parts(olds: np.ndarray, news: np.ndarray) -> list[np.ndarray]:
    """The places of the proposals of each connected component; olds and news are numbered from 0."""
    n = int(olds.max()) + 1
    parent = list(range(n + int(news.max()) + 1))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(olds.tolist(), (news + n).tolist()):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    label = np.array([root(i) for i in olds.tolist()])
    order = np.argsort(label, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(label[order])) + 1)


def _cycles(after: np.ndarray) -> np.ndarray:
    """A number for each node of a graph (after[i, j]: an edge from i to j): equal for nodes that reach each other."""
    n = len(after)
    seen, found, at, stack, clock = [-1] * n, np.full(n, -1), [0] * n, [], 0
    low, edges = [0] * n, [np.flatnonzero(row).tolist() for row in after]
    for start in range(n):
        path = [] if seen[start] >= 0 else [start]
        while path:
            i = path[-1]
            if seen[i] < 0:
                seen[i] = low[i] = clock
                clock += 1
                stack.append(i)
            if at[i] < len(edges[i]):
                j = edges[i][at[i]]
                at[i] += 1
                if seen[j] < 0:
                    path.append(j)
                elif found[j] < 0:
                    low[i] = min(low[i], seen[j])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[i])
            if low[i] == seen[i]:
                while found[i] < 0:
                    found[stack.pop()] = i
    return found


def solve(proposals: DataFrame, most: int | None = None) -> DataFrame:
    """(pair_id, old, new, weight, mandatory) of the best assignment of each pair of documents.

    ``proposals``: (pair_id, old, new, weight), whole weights. A pair is mandatory if every optimum has it: without it
    the best total is lower. Each connected component of proposals is solved alone, of whatever size. With ``most``, a component of
    more proposals comes back unsolved, never as matched: one row of its least old and new, weight null, mandatory false.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            pair, old, new, weight = (rows.column(c).to_numpy().astype(np.int64) for c in ("pair_id", "old", "new", "weight"))
            ends = []
            for side in (old, new):  # (pair, side) by numbers
                order = np.lexsort((side, pair))
                fresh = np.concatenate([[True], (np.diff(pair[order]) != 0) | (np.diff(side[order]) != 0)])[: len(order)]
                number = np.empty(len(order), np.int64)
                number[order] = np.cumsum(fresh) - 1
                ends.append(number)
            alone = (np.bincount(ends[0])[ends[0]] == 1) & (np.bincount(ends[1])[ends[1]] == 1) & (most is None or most > 0)
            out = []
            rest = np.flatnonzero(~alone)
            for part in _parts(*(np.unique(e[rest], return_inverse=True)[1] for e in ends)) if len(rest) else ():
                own = rest[part]
                mine, i = np.unique(old[own], return_inverse=True)
                other, j = np.unique(new[own], return_inverse=True)
                key = int(pair[own[0]])
                if most is not None and len(own) > most:
                    out.append((key, int(mine[0]), int(other[0]), None, False))
                    continue
                w = np.zeros((len(mine), len(other)), np.int64)
                np.maximum.at(w, (i, j), weight[own])
                pairs, must = solution(w)
                out += [(key, int(mine[a]), int(other[b]), int(w[a, b]), m) for (a, b), m in zip(pairs, must, strict=True)]
            k = alone & (weight > 0)  # a proposal without a rival is in every optimum
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair[k], old[k], new[k], weight[k], np.ones(int(k.sum()), bool))], names=names)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), [pa.int64()] * 4 + [pa.bool_()], strict=True)], names=names)

    names = ["pair_id", "old", "new", "weight", "mandatory"]
    sized = proposals.select(F.col("pair_id").cast("long").alias("pair_id"), F.lit(32).cast("long").alias("size"), "old", "new", "weight")
    return together(sized).mapInArrow(kernel, "pair_id long, old long, new long, weight long, mandatory boolean")
