import itertools
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from covergrid.operators import arrays as A
from covergrid.operators import graph as G
from covergrid.operators import halfint as H
from covergrid.operators import kernels as K
from covergrid.operators import rules as R
from covergrid.operators import solve as S
from tests.test_kernels import graphs, optimum

EDGES = [(1, 2), (1, 3), (2, 3), (3, 4), (5, 6), (6, 7), (7, 8), (8, 5), (9, 10)]


def frame(spark, edges):
    return spark.createDataFrame([(min(e), max(e)) for e in edges], "u bigint, v bigint")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_building_drops_nulls_loops_and_repeats(spark):
    raw = spark.createDataFrame([(1, 2, "x"), (2, 1, "y"), (1, None, "z"), (3, 3, "w"), (None, None, "v")], "a bigint, b bigint, u string")
    assert G.canonical(raw, "a", "b").collect() == [(1, 2)]
    assert ids(G.loops(raw, "a", "b")) == [3]
    assert G.canonical(raw.limit(0), "a", "b").count() == 0


def test_lookups(spark):
    e = frame(spark, EDGES)
    assert G.top_degrees(e, 1).first().id == 3
    assert G.min_degree_vertex(e).first().id == 4
    assert ids(G.set_neighbourhood(e, spark.createDataFrame([(1,), (2,)], "id bigint"))) == [3]
    assert {r.id: r.nb for r in G.nth_neighbour(e, 1).collect()} == {1: 3, 2: 3, 3: 2, 4: -1, 5: 8, 6: 7, 7: 8, 8: 7, 9: -1, 10: -1}
    asked = spark.createDataFrame([(3, 1), (1, 4)], "a bigint, b bigint")
    assert {(r.a, r.b): r.present for r in G.edges_exist(e, asked).collect()} == {(3, 1): True, (1, 4): False}
    c = G.counts(e).first()
    assert (c.n_vertices, c.n_edges, c.max_deg) == (10, 9, 3)
    c = G.counts(e.limit(0)).first()
    assert (c.n_vertices, c.n_edges, c.max_deg) == (0, 0, -1)
    assert G.random_vertex(e, 1).first() == G.random_vertex(e, 1).first()
    assert G.random_vertex(e, 4, top_bucket=True).first().id == 3


def test_dictionary_follows_first_appearance(spark):
    raw = spark.createDataFrame([(1, "b", "a"), (2, "a", "c"), (3, None, "b"), (4, "d", "d")], "o int, x string, y string")
    got = {r.name: r.id for r in G.dictionary(raw, "o", ["x", "y"], []).collect()}
    assert got == {"b": 0, "a": 1, "c": 2, "d": 3}


def test_consistency(spark):
    bad = spark.createDataFrame([(1, 2), (1, 2), (3, 3), (5, 4), (None, 1)], "u bigint, v bigint")
    assert sorted(r.problem for r in G.consistency(bad).collect()) == ["loop", "null", "order", "repeated"]


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(2)
    perm = list(range(300))
    rng.shuffle(perm)
    edges = {
        "path": [(perm[i], perm[i + 1]) for i in range(299)],
        "star": [(0, i) for i in range(1, 200)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(170)],
        "empty": [],
    }[shape]
    edges = [e for e in edges if e[0] != e[1]]
    want = {}
    for part in K.split(K.build(edges)):
        want.update(dict.fromkeys(part, min(part)))
    e = frame(spark, edges).distinct()
    assert {r.id: r.component for r in G.components(e).collect()} == want


def disjoint(n, seed):
    """Many small random graphs side by side, so that one job tests them all."""
    parts, edges = [], []
    for i, g in enumerate(graphs(n, seed, (4, 9))):
        parts.append(g)
        edges += [(100 * i + u, 100 * i + v) for u, near in g.items() for v in near if u < v]
    return parts, edges


def opt_by_part(edges):
    by = {}
    for u, v in edges:
        by.setdefault(u // 100, []).append((u, v))
    return {k: optimum(K.build(x)) for k, x in by.items()}


@pytest.mark.parametrize("rule", list(R.RULES))
def test_rule_batches_and_undo(spark, rule):
    _, edges = disjoint(25, 11)
    e = frame(spark, edges)
    out, log = R.RULES[rule](e)
    left = [(r.u, r.v) for r in out.collect()]
    assert len(left) == len(set(left)) and all(u < v for u, v in left)
    before, after = opt_by_part(edges), opt_by_part(left)
    dec = R.decrease(log).first().dec
    assert dec + sum(after.values()) == sum(before.values())
    best = [v for g in K.split(K.build(left)) for v in K.branch_and_bound(g)[0]]
    back = set(ids(R.undo_round(log, spark.createDataFrame([(v,) for v in best], "id bigint"))))
    assert K.is_cover(K.build(edges), back) and len(back) == sum(before.values())


def test_high_degree_and_buss_frames(spark):
    e = frame(spark, [(0, i) for i in range(1, 9)] + [(1, 2)])
    assert ids(R.r3_high_degree(e, 2)) == [0]
    assert R.r4_buss(frame(spark, [(i, i + 1) for i in range(0, 60, 2)]), 3).first().excluded
    assert not R.r4_buss(frame(spark, EDGES), 6).first().excluded


def test_dominators_and_common_neighbours(spark):
    rng = random.Random(4)
    edges = sorted({(i, j) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.25})
    g, e = K.build(edges), frame(spark, edges)
    assert {(r.u, r.v): r.common for r in G.common_neighbours(e).collect()} == {(u, v): c for u, v in edges if (c := len(g[u] & g[v]))}
    assert {(r.u, r.v) for r in R.dominators(e).collect()} == {(u, v) for u in g for v in g[u] if g[v] - {u} <= g[u]}


def test_exact_heuristic_and_bounds(spark):
    _, edges = disjoint(15, 17)
    e, best = frame(spark, edges), sum(opt_by_part(edges).values())
    for enough in (0, S.ENOUGH):
        s = S.solve_exact(e, enough=enough)
        assert s.proven and s.size == best and G.uncovered(e, s.cover).count() == 0
    for r in S.bounds(e).collect():
        assert r.value <= best
    for method in ("max", "min", "best", "search"):
        c = S.heuristic(e, method, tries=2)
        assert G.uncovered(e, c).count() == 0 and c.count() >= best
    assert G.uncovered(e, S.greedy_rounds(e)).count() == 0
    m = S.matching(e)
    assert m.count() <= best and G.vertices(m).count() == 2 * m.count() and G.uncovered(e, G.vertices(m)).count() == 0


def test_frontier_and_large_components(spark):
    rng = random.Random(1)
    edges = sorted({(i, j) for i in range(60) for j in range(i) if rng.random() < 0.12})
    e, want = frame(spark, edges), len(K.branch_and_bound(K.build(edges))[0])
    hard = S.solve_exact(e, nodes=1)  # goes on in open subproblems
    assert G.uncovered(e, hard.cover).count() == 0 and hard.size == want and hard.proven
    late = S.solve_exact(e, nodes=1, seconds=0)  # gives the best so far
    assert G.uncovered(e, late.cover).count() == 0 and late.size >= want and not late.proven
    wide = S.solve_exact(e, nodes=1, core=1)
    assert G.uncovered(e, wide.cover).count() == 0 and not wide.proven
    assert S.solve_exact(e, nodes=2000).size == want
    far = S.solve_exact(e, kernel_edges=10)  # never meets a kernel
    assert G.uncovered(e, far.cover).count() == 0 and not far.proven
    two_sided = frame(spark, sorted({(i, 100 + rng.randrange(30)) for i in range(40) for _ in range(4)}))
    solved = S.solve_exact(two_sided, kernel_edges=10, enough=10**6)  # the half-integral rule solves it
    assert solved.proven and solved.size == len(K.branch_and_bound(K.build((r.u, r.v) for r in two_sided.collect()))[0])
    forced = S.solve_exact(frame(spark, [(1, 2), (2, 3)]), loops=spark.createDataFrame([(1,)], "id bigint"))
    assert ids(forced.cover)[0] == 1 and forced.size == 2


def test_empty_graph(spark):
    e = frame(spark, [])
    s = S.solve_exact(e)
    assert s.size == 0 and s.proven
    assert S.bounds(e).count() == 0 and S.greedy_rounds(e).count() == 0 and S.matching(e).count() == 0


def test_losses(spark):
    e = frame(spark, EDGES)
    cover = spark.createDataFrame([(3,), (5,), (7,), (9,)], "id bigint")
    g, c = K.build(EDGES), {3, 5, 7, 9}
    assert {r.id: r.loss for r in G.losses(e, cover).collect()} == {v: len(g[v] - c) for v in c}


def test_selection_is_disjoint(spark):
    _, edges = disjoint(30, 23)
    sel = R.r2_selected(frame(spark, edges)).select(F.explode(F.array("v", "a", "b")).alias("x"))
    assert sel.count() == sel.distinct().count() and list(itertools.islice(sel.toLocalIterator(), 1))


def test_greedy_rounds_cover_long_paths_in_order_of_ids(spark):
    e = frame(spark, [(i, i + 1) for i in range(1, 5001)])
    for edges in (200, 10**6):
        cover = S.greedy_rounds(e, edges)
        assert G.uncovered(e, cover).count() == 0 and cover.count() < 4000
    m = S.matching(e, 200)
    assert G.vertices(m).count() == 2 * m.count() and G.uncovered(e, G.vertices(m)).count() == 0


def test_double_cover_matching_of_large_components(spark):
    edges = [(i, i + 1) for i in range(1, 8)] + [(20, 20 + i) for i in range(1, 9)] + [(30 + i, 30 + (i + 1) % 7) for i in range(7)] + [(30, 37), (37, 38), (40, 41)]
    e, parts = frame(spark, edges), K.split(K.build(edges))
    want = {min(g): len(K.hopcroft_karp(g)[0]) for g in parts}
    assert {r.component: r.matched for r in S.matching_double_cover(e, 5).collect()} == want
    got = {r.bound: r.value for r in S.bounds(e, 5).collect()}
    assert got == {"lp": sum(map(K.lp_bound, parts)), "clique": None, "cycle": None}


def test_kernelize_reaches_a_fixpoint_on_long_chains_in_few_rounds(spark):
    cycle = [(i, i + 1) for i in range(1, 500)] + [(1, 500)]
    k = R.kernelize(frame(spark, cycle + [(1000 + i, 1001 + i) for i in range(400)]))
    assert k.edges.count() == 0 and len(k.rounds) <= 60
    assert R.decrease(k.log()).first().dec == 250 + 200


def test_degree_three_cases_next_to_hubs_are_selected(spark):
    _, edges = disjoint(25, 29)
    edges += [(9000, 9001 + i) for i in range(80)] + [(8000, 9000), (8000, 8001), (8000, 8002), (8001, 8003), (8001, 8004), (8002, 8005), (8002, 8006)]
    e, g = frame(spark, edges), K.build(edges)
    cases = R.deg3_cases(e).where("kind IN ('independent', 'edge')")
    ball = {r.v: {r.v} | g[r.v] | {y for x in g[r.v] for y in g[x]} for r in cases.collect()}
    first = {}
    for v, b in ball.items():
        for x in b:
            first[x] = min(first.get(x, v), v)
    want = sorted(v for v, b in ball.items() if all(first[x] == v for x in b))
    assert 8000 in want and sorted(r.v for r in R.select_ball(e, cases).collect()) == want
    assert sorted(r.v for r in R.select_ball(e, cases, edges=0).collect()) == want
    hashed = [sorted(r.v for r in R.select_ball(e, cases, 5, edges=n).collect()) for n in (0, 10**6)]
    assert hashed[0] == hashed[1] != want


def test_queries_over_whole_tables(spark, data):
    q = entry.queries()
    raw = [(f"{r.file}:{r.vertex0}", f"{r.file}:{r.vertex1}") for r in spark.read.parquet(f"{data}/bucketgraph.parquet").collect() if None not in (r.file, r.vertex0, r.vertex1)]
    g = K.build({(a, b) for a, b in raw if a != b})
    assert {r.id for r in q["leaves_bg"](spark, data).collect()} == {v for v in g if len(g[v]) == 1}
    assert q["double_cover_edges_bg"](spark, data).count() == sum(map(len, g.values()))
    parts = {}
    for r in q["components_bg"](spark, data).collect():
        parts[r.component] = parts.get(r.component, 0) + 1
    assert sorted(parts.values()) == sorted(map(len, K.split(g)))
    assert q["greedy_rounds_bg"](spark, data).first().n_uncovered == 0


def test_rounds_and_one_task_agree(spark):
    rng = random.Random(8)
    edges = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(260)) if a != b}
    edges |= {(300 + i, 301 + i) for i in range(150)} | {(500, 501 + i) for i in range(60)}
    e = frame(spark, sorted(edges))
    some = e.selectExpr("u", "v", "xxhash64(u, 3) AS a", "xxhash64(u, v) AS b").toPandas()
    assert (A.xxhash64(some.u.to_numpy(), 3) == some.a).all() and (A.xxhash64(some.u.to_numpy(), some.v.to_numpy()) == some.b).all()
    for f in (lambda m: {tuple(r) for r in G.components(e, m).collect()}, lambda m: set(ids(S.greedy_rounds(e, m))), lambda m: {tuple(r) for r in S.matching(e, m).collect()}):
        assert f(20) == f(10**6)
    want = {v: min(part) for part in K.split(K.build(edges)) for v in part}
    assert dict(G.components(e, 20).collect()) == want
    named = e.selectExpr("concat('n', u) AS u", "concat('n', v) AS v")
    assert {r.id: r.component for r in G.components(named, 20).collect()} == {f"n{v}": min(f"n{x}" for x in want if want[x] == c) for v, c in want.items()}


def test_unconfined_and_half_integral_against_kernels(spark):
    parts, edges = disjoint(30, 37)
    e, g = frame(spark, edges), K.build(edges)
    assert {r.id for r in R.unconfined(e).collect()} == {v for v in g if K.is_unconfined(g, v)}
    assert any(r.steps > 1 for r in R.unconfined(e).collect())
    for limit in (5, 10**6):
        got = {r.id: r.twice for r in H.half_integral(e, limit).collect()}
        one, zero = K.half_integral(g)
        assert got == {v: 2 if v in one else 0 if v in zero else 1 for v in g}


def test_large_components_are_matched_in_few_steps(spark, monkeypatch):
    """Leaves go by joins and the rest in one task, not by layers of joins; all ways agree."""
    _, edges = disjoint(6, 77)
    edges += [(1000 + i, 1001 + i) for i in range(12)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(3000, 3001 + i) for i in range(9)]
    e, g = frame(spark, edges), K.build(edges)
    made, real = [], H.materialise
    monkeypatch.setattr(H, "materialise", lambda df: made.append(1) or real(df))
    size = len(K.hopcroft_karp(g)[0])
    for most in (10**6, 0):
        made.clear()
        m = [tuple(r) for r in (H.maximum_double_matching(e, most) if most < 10**6 else H.maximum_double_matching(e)).collect()]
        assert len(m) == len({l for l, _ in m}) == len({r for _, r in m}) == size and all(r in g[l] for l, r in m)
        assert most < 10**6 or len(made) <= 3
    assert sum(r.matched for r in S.matching_double_cover(e).collect()) == size
    one, zero = K.half_integral(g)
    assert {r.id: r.twice for r in H.half_integral(e).collect()} == {v: 2 if v in one else 0 if v in zero else 1 for v in g}


def reaching(vs, arcs):
    """Least vertex of the strongly connected part of each."""
    to = {v: {y for x, y in arcs if x == v} for v in vs}
    reach = {}
    for v in vs:
        seen, todo = {v}, [v]
        while todo:
            for y in to[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        reach[v] = seen
    return {v: min(w for w in reach[v] if v in reach[w]) for v in vs}


def test_strong_components_by_joins_and_in_one_task(spark):
    rng = random.Random(21)
    arcs = {(10 * k + rng.randrange(6), 10 * k + rng.randrange(6)) for k in range(12) for _ in range(9)} | {(200 + i, 200 + (i + 1) % 7) for i in range(7)} | {(203, 3), (300, 301)}
    df, want = spark.createDataFrame(sorted(arcs), "a bigint, b bigint"), reaching({x for p in arcs for x in p}, arcs)
    for edges in (0, 30, 10**6):
        got = {r.id: r.part for r in G.strong_components(df, edges).collect()}
        assert {v: got.get(v, v) for v in want} == want and len(got) == G.strong_components(df, edges).count()
    assert G.strong_components(df.limit(0), 0).count() == 0


def test_residual_components_of_large_components(spark):
    """A component too large for one task was refused."""
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), (10, 11), (11, 12), (12, 13), (10, 13), (20, 21), (30, 31), (31, 32)]
    e, g = frame(spark, edges), K.build(edges)
    want = {v: min(p) for p in K.residual_components(g) for v in p}
    for kernel_edges, most in ((3, 0), (3, 10**6), (10**6, 10**6)):
        got = S.residual_components(e, kernel_edges, most).collect()
        part = {r.id: r.part for r in got}
        assert len(got) == len(part) and set(part) == set(g)
        assert {v: p for v, p in part.items() if v < 30} == {v: p for v, p in want.items() if v < 30}  # there the matching is perfect, so it doesn't matter which


def test_two_cliques_are_reduced_and_undone(spark):
    rng = random.Random(6)
    edges = []
    for i in range(30):  # degree four, two cliques, and random edges to others
        b, inner = 100 * i, [(1, 2), (1, 3), (2, 3)] if i % 2 else [(1, 2), (2, 3), (3, 4), (1, 4)]
        edges += [(b, b + k) for k in range(1, 5)] + [(b + x, b + y) for x, y in inner]
        edges += [(b + x, b + y) for x in range(1, 5) for y in range(5, 9) if rng.random() < 0.5] + [(b + 5, b + 6)]
    e = frame(spark, edges)
    out, log = R.apply_r11(e)
    assert {r.kind for r in log.collect()} == {"clique3", "clique4"}
    left = [(r.u, r.v) for r in out.collect()]
    before, after = opt_by_part(edges), opt_by_part(left)
    assert R.decrease(log).first().dec + sum(after.values()) == sum(before.values())
    best = [v for h in K.split(K.build(left)) for v in K.branch_and_bound(h)[0]]
    back = set(ids(R.undo_round(log, spark.createDataFrame([(v,) for v in best], "id bigint"))))
    assert K.is_cover(K.build(edges), back) and len(back) == sum(before.values())


def test_budgets_and_flags(spark):
    star = [(0, i) for i in range(1, 9)] + [(10, i) for i in range(11, 16)] + [(20, 21), (21, 22), (20, 22)]
    e = frame(spark, star)
    out, log, k = R.apply_r3_budget(e, 5)  # 0 first, then 10 at a budget of four
    assert k == 3 and sorted(x for r in log.collect() for x in r.other) == [0, 10] and out.count() == 3
    _, edges = disjoint(12, 41)
    best = sum(opt_by_part(edges).values())
    for order in (R.dynamic(10), ("R1", "R6", "R9", "R10", "R11", "R12") + R.BUDGET):
        kernel = R.kernelize(frame(spark, edges), order, k=best)
        assert kernel.feasible and kernel.k == best - R.decrease(kernel.log()).first().dec
        counted = kernel.counters().collect()
        assert {r.rule for r in counted} <= set(order) and sum(r.decrease for r in counted) == best - kernel.k
        assert kernel.k == sum(opt_by_part([(r.u, r.v) for r in kernel.edges.collect()]).values())
    assert not R.kernelize(frame(spark, edges), ("R1", "R2", "R5"), k=best - 1 - kernel.edges.count()).feasible
    with pytest.raises(ValueError):
        R.kernelize(frame(spark, edges), ("R3",))


def test_activity_paths_and_searches(spark):
    e = frame(spark, EDGES)
    gone = spark.createDataFrame([(3,), (5,)], "id bigint")
    back, still = G.reactivate(e, gone, spark.createDataFrame([(5,), (7,)], "id bigint"))
    assert ids(still) == [3] and {tuple(r) for r in back.collect()} == {x for x in map(lambda p: (min(p), max(p)), EDGES) if 3 not in x}
    assert ids(G.inactive(G.vertices(e), G.vertices(G.delete_vertices(e, gone)))) == [3, 4, 5]
    assert G.first_connected(e).first().id == 1 and G.first_connected(e.limit(0)).count() == 0
    assert not G.finished(e).first().finished and G.finished(e.limit(0)).first().finished
    assert {r.component: r.optimum for r in G.path_cycle_optimum(e).collect()} == {5: 2, 9: 1}
    _, edges = disjoint(12, 51)
    e, best = frame(spark, edges), opt_by_part(edges)
    got = S.searches(e, (*K.SEARCHES, "matrix"), 9).collect()
    want = {}
    for part in K.split(K.build(edges)):
        want[min(part)] = optimum(part)
    assert {(r.component, r.method): r.size for r in got} == {(c, m): n for c, n in want.items() for m in (*K.SEARCHES, "matrix")} and all(r.valid for r in got)
    parts = {}
    for r in S.residual_components(e).collect():
        parts.setdefault(r.part, []).append(r.id)
    assert sorted(x for p in parts.values() for x in p) == sorted(K.build(edges)) and all(min(p) == k for k, p in parts.items())
