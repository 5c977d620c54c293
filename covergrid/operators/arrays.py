"""Graphs of a bounded number of edges, finished in one task by array operations.

Rounds of joins that shrink a graph end here once at most ``EDGES`` edges are
left. Each function follows the same rule as the rounds (the same hashes and
ties), so the results don't depend on where a graph was finished.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Edges that one task takes: about 100 MB of arrays.
EDGES = 1_000_000

#: The five primes of the 64-bit xxHash, in order.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotate(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxhash64(*columns: np.ndarray | int) -> np.ndarray:
    """``functions.xxhash64`` of bigint columns (arrays) and int literals."""
    n = max(len(c) for c in columns if not isinstance(c, int))
    seed = np.full(n, 42, "uint64")
    with np.errstate(over="ignore"):
        for c in columns:
            if isinstance(c, int):
                h = (seed + _P5 + np.uint64(4)) ^ (np.uint64(c & 0xFFFFFFFF) * _P1)
                seed = _mix(_rotate(h, 23) * _P2 + _P3)
            else:
                h = (seed + _P5 + np.uint64(8)) ^ (_rotate(c.astype("int64").view("uint64") * _P2, 31) * _P1)
                seed = _mix(_rotate(h, 27) * _P1 + _P4)
    return seed.view("int64")


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Place of each element in the order of the keys, first key first."""
    out = np.empty(len(keys[0]), "int64")
    out[np.lexsort(keys[::-1])] = np.arange(len(out))
    return out


def components(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(vertex, least vertex of its component), for ids of any type."""
    coded = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), "int64")
    place[order] = np.arange(len(order))
    a, b = np.split(place[coded.indices.to_numpy()], 2)
    parent = np.arange(len(order))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            ids = coded.dictionary.take(pa.array(order))
            return ids, ids.take(pa.array(parent))
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != (up := parent[parent])).any():
            parent = up


def greedy(u: np.ndarray, v: np.ndarray, start: int) -> np.ndarray:
    """Vertices of the greedy cover from round ``start`` on."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(at, 2)
    taken, k = np.zeros(len(ids), bool), start
    while len(a):
        degree = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        rank = ranks(degree, xxhash64(ids, k), ids)
        most = np.full(len(ids), -1)
        np.maximum.at(most, a, rank[b])
        np.maximum.at(most, b, rank[a])
        taken |= (degree > 0) & (rank > most)
        left = ~(taken[a] | taken[b])
        a, b, k = a[left], b[left], k + 1
    return ids[taken]


def matching(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which edges are in the maximal matching."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(at, 2)
    rank = ranks(xxhash64(u, v), u, v)
    inside, left, free = np.zeros(len(a), bool), np.arange(len(a)), np.ones(len(ids), bool)
    while len(left):
        low = np.full(len(ids), len(a))
        np.minimum.at(low, a[left], rank[left])
        np.minimum.at(low, b[left], rank[left])
        won = left[(low[a[left]] == rank[left]) & (low[b[left]] == rank[left])]
        inside[won] = True
        free[a[won]] = free[b[won]] = False
        left = left[free[a[left]] & free[b[left]]]
    return inside


def firsts(u: np.ndarray, v: np.ndarray, cases: np.ndarray, hashes: np.ndarray, steps: int) -> np.ndarray:
    """Which cases are the first, by hash and then id, of all within ``steps``."""
    ids, at = np.unique(np.concatenate([u, v, cases]), return_inverse=True)
    a, b, c = np.split(at, [len(u), 2 * len(u)])
    rank = ranks(hashes, cases)
    near = np.full(len(ids), len(cases))
    np.minimum.at(near, c, rank)
    for _ in range(steps):
        after = near.copy()
        np.minimum.at(after, a, near[b])
        np.minimum.at(after, b, near[a])
        near = after
    return near[c] == rank


class Arcs:
    """A directed graph, or a bipartite one with its left and right vertices
    numbered alike: arcs ``l, r`` by their first end."""

    def __init__(self, l: np.ndarray, r: np.ndarray):
        self.ids, at = np.unique(np.concatenate([l, r]), return_inverse=True)
        a, b = np.split(at, 2)
        self._index(a, b, len(self.ids))

    def _index(self, a: np.ndarray, b: np.ndarray, n: int) -> None:
        self.near = b[np.argsort(a, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
        self.degree = np.diff(self.start)

    def reversed(self) -> Arcs:
        out = Arcs.__new__(Arcs)
        out.ids = self.ids
        out._index(self.near, np.repeat(np.arange(len(self.ids)), self.degree), len(self.ids))
        return out

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both ends of all arcs from the vertices ``at``."""
        n = self.degree[at]
        first = np.cumsum(n) - n
        return np.repeat(at, n), self.near[np.repeat(self.start[at] - first, n) + np.arange(n.sum())]


def _begin(g: Arcs, left: np.ndarray, right: np.ndarray, rounds: int = 64) -> None:
    """A maximal matching, put into the partners ``left`` and ``right`` (-1 for
    none): edges at leaves first, which some maximum matching holds, for so many
    rounds, then any others."""
    back = g.reversed()
    sides = ((g, back, left, right, g.degree.copy()), (back, g, right, left, back.degree.copy()))
    for _ in range(rounds):
        before = (left >= 0).sum()
        for k, (out, into, own, other, degree) in enumerate(sides):
            x, y = out.of(np.flatnonzero((own < 0) & (degree == 1)))
            x, y = x[other[y] < 0], y[other[y] < 0]
            other[y] = x  # of several leaves one stays
            won = other[y] == x
            x, y = x[won], y[won]
            own[x] = y
            degree -= np.bincount(into.of(y)[1], minlength=len(degree))
            sides[1 - k][4][:] -= np.bincount(out.of(x)[1], minlength=len(degree))
        if (left >= 0).sum() == before:
            break
    x, y = g.of(np.flatnonzero(left < 0))
    while True:
        free = (left[x] < 0) & (right[y] < 0)
        x, y = x[free], y[free]
        if not len(x):
            return
        pick = np.full(len(left), -1)
        pick[y] = x
        asked = pick[y] == x
        left[x[asked]] = y[asked]  # a left vertex that several picked takes one of them
        sure = asked & (left[x] == y)
        right[y[sure]] = x[sure]


def partners(g: Arcs) -> tuple[np.ndarray, np.ndarray]:
    """A maximum matching of a bipartite graph: the right vertex of each left
    one and back, -1 for none. Each phase grows a forest of alternating paths
    from all free left vertices, all in step; a right vertex belongs to one
    tree, each tree that meets a free one is augmented once. A phase that meets
    none has seen all that free vertices reach."""
    n = len(g.ids)
    left, right = np.full(n, -1), np.full(n, -1)
    _begin(g, left, right)
    while True:
        layer = np.flatnonzero((left < 0) & (g.degree > 0))
        root, parent, end = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        root[layer] = layer
        while len(layer):
            x, y = g.of(layer)
            new = parent[y] < 0
            x, y = x[new], y[new]
            parent[y] = x  # one of them
            y = y[parent[y] == x]
            after = right[y]
            met = y[after < 0]
            end[root[parent[met]]] = met
            y, layer = y[after >= 0], after[after >= 0]
            root[layer] = root[parent[y]]
            layer = layer[end[root[layer]] < 0]  # a tree that has met a free vertex grows no further
        y = end[end >= 0]
        if not len(y):
            return left, right
        while len(y):
            x = parent[y]
            before = left[x]
            left[x], right[y] = y, x
            y = before[before >= 0]


def double_matching(l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``l, r`` of a maximum matching of a bipartite graph."""
    g = Arcs(l, r)
    left, _ = partners(g)
    at = np.flatnonzero(left >= 0)
    return g.ids[at], g.ids[left[at]]


def halves(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``id, twice`` of ``halfint.half_integral``."""
    g = Arcs(np.concatenate([u, v]), np.concatenate([v, u]))
    left, right = partners(g)
    in_l, in_r = left < 0, np.zeros(len(g.ids), bool)
    layer = np.flatnonzero(in_l)
    while len(layer):
        y = g.of(layer)[1]
        y = np.unique(y[~in_r[y]])
        in_r[y] = True
        layer = right[y]
        layer = layer[layer >= 0]
        layer = layer[~in_l[layer]]
        in_l[layer] = True
    return g.ids, np.where(in_r & ~in_l, 2, np.where(in_l & ~in_r, 0, 1)).astype("int32")


def strong(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``id, part``: the strongly connected parts of arcs ``a, b``, by their
    least vertex. Vertices that nothing leads to, or that lead nowhere, go first;
    then Tarjan's search on an explicit stack."""
    ids = np.unique(np.concatenate([a, b]))
    part = np.arange(len(ids))
    a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
    a, b = a[a != b], b[a != b]
    for _ in range(64):
        into, out = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        into[b] = out[a] = True
        inner = into[a] & out[b]
        if inner.all():
            break
        a, b = a[inner], b[inner]
    if not len(a):
        return ids, ids
    g = Arcs(a, b)
    near, start, place = g.near.tolist(), g.start.tolist(), g.ids
    n = len(place)
    index, low, at, inside, least = [-1] * n, [0] * n, start[:-1], bytearray(n), np.empty(n, "int64")
    seen, stack = 0, []
    for root in range(n):
        if index[root] >= 0:
            continue
        index[root] = low[root] = seen
        seen += 1
        stack.append(root)
        inside[root] = 1
        path = [root]
        while path:
            x = path[-1]
            k = at[x]
            if k < start[x + 1]:
                at[x] = k + 1
                y = near[k]
                if index[y] < 0:
                    index[y] = low[y] = seen
                    seen += 1
                    stack.append(y)
                    inside[y] = 1
                    path.append(y)
                elif inside[y] and index[y] < low[x]:
                    low[x] = index[y]
                continue
            path.pop()
            if path and low[x] < low[path[-1]]:
                low[path[-1]] = low[x]
            if low[x] == index[x]:
                whole = []
                while not whole or whole[-1] != x:
                    whole.append(stack.pop())
                    inside[whole[-1]] = 0
                least[whole] = min(whole)  # numbered in the order of their ids
    part[place] = place[least]
    return ids, ids[part]


def residual(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``id, part`` of ``solve.residual_components``."""
    g = Arcs(np.concatenate([u, v]), np.concatenate([v, u]))
    right = partners(g)[1]
    x, y = g.of(np.arange(len(g.ids)))
    to = right[y]
    own = np.arange(len(g.ids))  # each vertex is in a part
    at, part = strong(np.concatenate([x[to >= 0], own]), np.concatenate([to[to >= 0], own]))
    return g.ids[at], g.ids[part]


def in_one_task(e: DataFrame, f: Callable[..., tuple[list[pa.Array], list[str]]], schema: str) -> DataFrame:
    """``f`` of the columns of all edges ``u, v`` (and what else they have), of
    which there are at most ``EDGES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            arrays, names = f(*(c.chunk(0) for c in t.columns))
            yield from pa.Table.from_arrays(arrays, names).to_batches(max_chunksize=100_000)

    return e.coalesce(1).mapInArrow(run, schema)
