"""Kernels against brute force on random graphs."""

import itertools
import random

import pytest

from covergrid.operators import bits as B
from covergrid.operators import kernels as K

RULES = {**K.RULES, "R2 triangles": lambda g, log: K.rule_degree_two(g, log, False)}
#: Edges of Zachary's karate club, a public graph; optimum 14.
KARATE = (
    "2-1 3-1 3-2 4-1 4-2 4-3 5-1 6-1 7-1 7-5 7-6 8-1 8-2 8-3 8-4 9-1 9-3 10-3 11-1 11-5 11-6 12-1 13-1 13-4 14-1 14-2 14-3 14-4 17-6 17-7 18-1 18-2 "
    "20-1 20-2 22-1 22-2 26-24 26-25 28-3 28-24 28-25 29-3 30-24 30-27 31-2 31-9 32-1 32-25 32-26 32-29 33-3 33-9 33-15 33-16 33-19 33-21 33-23 33-24 "
    "33-30 33-31 33-32 34-9 34-10 34-14 34-15 34-16 34-19 34-20 34-21 34-23 34-24 34-27 34-28 34-29 34-30 34-31 34-32 34-33"
)


def optimum(g):
    vs = sorted(g)
    for k in range(len(vs) + 1):
        for c in itertools.combinations(vs, k):
            if K.is_cover(g, set(c)):
                return k


def graphs(n, seed, sizes=(4, 10)):
    rng = random.Random(seed)
    for _ in range(n):
        k, p = rng.randrange(*sizes), rng.choice([0.2, 0.35, 0.5, 0.65])
        g = K.build((i, j) for i in range(k) for j in range(i) if rng.random() < p)
        if g:
            yield g


@pytest.mark.parametrize("name", RULES)
def test_rule_and_undo_of_every_optimal_cover(name):
    used = 0
    for g in graphs(500, 3):
        h, log = K.copy(g), []
        dec = RULES[name](h, log)
        if dec is None:
            assert h == g and not log
            continue
        used += 1
        best, left = optimum(g), optimum(h)
        assert left + dec == best
        for c in itertools.combinations(sorted(h), left):
            if K.is_cover(h, set(c)):
                back = K.undo(log, set(c))
                assert K.is_cover(g, back) and len(back) == best
    assert used > 10


def test_bounds_heuristics_and_searches():
    for g in graphs(250, 5):
        best = optimum(g)
        for bound in (K.lp_bound, K.clique_bound, K.cycle_bound, K.lower_bound):
            assert bound(g) <= best
        for c in (K.greedy_max(g), K.greedy_max(g, 5), K.greedy_max(g, reduced=True), K.greedy_min(g), K.best_of(g, 4), K.local_search(g, K.greedy_min(g), 60, 1)):
            assert K.is_cover(g, c) and K.is_cover(g, K.prune(g, c))
        c, proven, _ = K.branch_and_bound(g)
        assert proven and len(c) == best and K.is_cover(g, c)
        assert len(K.smallest(g)) == best and K.decide(g, best - 1) is None
        for search in (K.edge_branching, K.vertex_branching, lambda h, k: K.vertex_branching(h, k, False)):
            assert search(g, best - 1) is None and K.is_cover(g, search(g, best))
        parts = K.frontier(g, 4)
        assert min(len(t) + optimum(K.build(e)) for t, e in parts) == best
        h, log = K.copy(g), []
        dec = K.reduce(h, log, growing=True)
        assert optimum(h) + dec == best and len(K.undo(log, K.branch_and_bound(h)[0])) == best


def test_cycle_bound_walks_each_edge_a_few_times(monkeypatch):
    """A star and a long way to many cycles took quadratic time."""
    asked = []
    monkeypatch.setattr(K, "sorted", lambda x, **how: asked.append(len(x)) or sorted(x, **how), raising=False)
    star = K.build([(0, i) for i in range(1, 1001)])
    tail = K.build([(i, i + 1) for i in range(600)] + [(600 + 3 * k, 600 + 3 * k + d) for k in range(100) for d in (1, 2, 3)] + [(601 + 3 * k, 602 + 3 * k) for k in range(100)])
    for g, want in ((star, 1), (tail, 500)):
        asked.clear()
        assert K.cycle_bound(g) == want and sum(asked) <= 8 * K.n_edges(g)


def test_high_degree_and_buss():
    for g in graphs(200, 8):
        best, log = optimum(g), []
        h = K.copy(g)
        dec = K.rule_high_degree(h, best, log) or 0
        assert optimum(h) + dec == best
        k = best - dec
        assert not (h and K.buss_excludes(len(h), K.n_edges(h), max(map(len, h.values())), k))


def test_golden_sizes():
    karate = K.build(tuple(map(int, e.split("-"))) for e in KARATE.split())
    assert (len(karate), K.n_edges(karate)) == (34, 78)
    assert len(K.branch_and_bound(karate)[0]) == 14
    two_triangles = K.build([(1, 2), (2, 3), (1, 3), (3, 4), (3, 5), (4, 5), (3, 6)])
    assert len(K.smallest(two_triangles)) == 3
    assert len(K.branch_and_bound(K.build((0, i) for i in range(1, 5000)))[0]) == 1


def test_long_path_doesnt_recurse_and_budget_is_honest():
    path = K.build((i, i + 1) for i in range(20_000))
    assert len(K.branch_and_bound(path)[0]) == 10_000
    rng = random.Random(1)
    g = K.build((i, j) for i in range(120) for j in range(i) if rng.random() < 0.15)
    c, proven, used = K.branch_and_bound(g, nodes=3)
    assert K.is_cover(g, c) and not proven and used <= 3


def test_empty():
    assert K.branch_and_bound({}) == (set(), True, 1) and K.lp_bound({}) == 0 and K.best_of({}, 2) == set() and K.local_search({}, set(), 5) == set()


def test_residual_components_partition_the_vertices():
    for g in graphs(100, 31):
        parts = K.residual_components(g)
        assert sorted(v for p in parts for v in p) == sorted(g)
        _, right = K.hopcroft_karp(g)
        place = {v: i for i, p in enumerate(parts) for v in p}
        reach = {v: {right[w] for w in g[v] if w in right} for v in g}
        assert all(place[x] <= place[v] for v in g for x in reach[v])  # sinks first
        for p in parts:  # each vertex of a part reaches all of it
            for v in p:
                seen, todo = {v}, [v]
                while todo:
                    for x in reach[todo.pop()]:
                        if x not in seen:
                            seen.add(x)
                            todo.append(x)
                assert set(p) <= seen


def test_named_rules():
    g = K.build([(1, 2), (2, 3), (3, 4), (4, 5), (5, 1)])
    h, log = K.copy(g), []
    assert K.reduce(h, log, rules=["R1"]) == 0 and h == g
    assert K.reduce(h, log, rules=["R1", "R2"]) == 3 and not h and len(K.undo(log, set())) == 3


def test_matrix_search_and_its_open_subproblems():
    rng = random.Random(12)
    for g in graphs(60, 31, (4, 12)):
        ids, rows = B.encode(g)
        stack, limit, best = [B.start(rows)], len(ids) + 1, None
        while stack:  # a node at a time, from what the last call left open
            c, limit, stack, _ = B.search(stack, limit, 1)
            best = c if c is not None else best
        assert len(best) == limit == optimum(g) and K.is_cover(g, {ids[v] for v in best})
    for _ in range(20):
        g = K.build((rng.randrange(45), rng.randrange(45)) for _ in range(rng.randrange(50, 170)))
        ids, rows = B.encode(g)
        assert B.search([B.start(rows)], len(ids) + 1, 10**6)[1] == len(K.branch_and_bound(g)[0])


def test_matching_goes_on_after_deletions():
    for g in graphs(20, 5, (6, 12)):
        before = dict(K.hopcroft_karp(g)[0])
        K.drop(g, min(g))
        left, right = K.hopcroft_karp(g, before)
        assert len(left) == len(K.hopcroft_karp(g)[0]) == len(right) and all(w in g[u] for u, w in left.items())
