"""Covers of whole graphs: bounds, heuristics and exact search.

Rules shrink the graph as DataFrames; components of the rest are independent
and go to sequential kernels, one task each. A kernel needs its component in
one place, so components of more than ``kernel_edges`` edges never meet one:
they get a distributed greedy cover and, as bound, half the maximum matching of
their double cover, found by layered joins.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergrid.operators import arrays as A
from covergrid.operators import bits as B
from covergrid.operators import graph as G
from covergrid.operators import halfint as H
from covergrid.operators import kernels as K
from covergrid.operators import rules as R
from covergrid.operators.halfint import KERNEL_EDGES, matching, maximum_double_matching, split_by_size  # noqa: F401
from covergrid.session import discard, materialise

#: Edges below which rounds over DataFrames cost more than the kernels' own rules.
ENOUGH = 100_000
#: Search nodes of a part, and of each open subproblem, in the first round.
NODES = 1000
#: Vertices of a part that is searched as a matrix: at most 50 MB of bits.
CORE = 20_000


def _parts(e: DataFrame, kernel_edges: int) -> tuple[DataFrame, DataFrame]:
    """Edges with their component of small components, edges of large ones."""
    small, large = split_by_size(e, kernel_edges)
    return small, large.select("u", "v")


def _graph(pdf: pd.DataFrame) -> K.Graph:
    return K.build(zip(pdf["u"].tolist(), pdf["v"].tolist()))


def greedy_rounds(e: DataFrame, edges: int = A.EDGES) -> DataFrame:
    """Distributed greedy cover ``id``: each round takes every vertex whose
    (degree, then hash of id and round) is the greatest in its closed
    neighbourhood, until no edge is left. The greatest of all is always taken,
    so this ends; ties by hash let chains and grids go in few rounds whatever
    the order of their ids. At most ``edges`` edges are finished in one task, by
    the same rule."""
    left, cover, hot = materialise(e.select("u", "v")), [], None
    while left.count() > edges:
        hot = G.hubs_of(left) if hot is None else hot
        d = G.degrees(left).select("id", F.struct("deg", F.xxhash64("id", F.lit(len(cover))).alias("h"), "id").alias("rank"))
        ranked = G.with_ends(left, d, hot)
        lost = ranked.select(F.when(F.col("rank_u") < F.col("rank_v"), F.col("u")).otherwise(F.col("v")).alias("id")).distinct()
        top = materialise(G.vertices(left).join(lost, "id", "left_anti"))
        cover.append(top)
        after = materialise(G.delete_vertices(left, top))
        discard(left)
        left = after
    start = len(cover)
    rest = A.in_one_task(left, lambda u, v: ([pa.array(A.greedy(u.to_numpy(), v.to_numpy(), start))], ["id"]), "id bigint")
    return reduce(DataFrame.unionByName, cover, rest)


# --- bounds ------------------------------------------------------------------

BOUNDS = {"lp": K.lp_bound, "clique": K.clique_bound, "cycle": K.cycle_bound}


def _matched(large: DataFrame) -> DataFrame:
    """``component, matched`` of ``u, v, component``."""
    of = large.select(F.explode(F.array("u", "v")).alias("l"), "component").distinct()
    return of.join(maximum_double_matching(large.select("u", "v")), "l").groupBy("component").agg(F.count(F.lit(1)).alias("matched"))


def bounds(e: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``bound, value``: lower bounds of the whole graph (components add up).
    ``lp`` is the same for components of any size; ``clique`` and ``cycle`` have
    kernels only, and are null if a component is too large for one."""
    small, large = split_by_size(e, kernel_edges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _graph(pdf)
        return pd.DataFrame({"bound": list(BOUNDS), "value": [f(g) for f in BOUNDS.values()]})

    per = small.groupBy("component").applyInPandas(run, "bound string, value bigint")
    if not large.isEmpty():
        half = _matched(large).select(F.lit("lp").alias("bound"), F.expr("(matched + 1) div 2").alias("value"))
        unknown = large.select("component").distinct().select(F.explode(F.array(*[F.lit(b) for b in BOUNDS if b != "lp"])).alias("bound"), F.lit(None).cast("bigint").alias("value"))
        per = per.unionByName(half).unionByName(unknown)
    return per.groupBy("bound").agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum("value")).cast("bigint").alias("value"))


def matching_double_cover(e: DataFrame, kernel_edges: int = A.EDGES) -> DataFrame:
    """``component, matched``: maximum matching of the double cover per
    component, in one task up to ``kernel_edges`` edges and by joins above."""
    small, large = split_by_size(e, kernel_edges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, c = (pdf[x].to_numpy() for x in ("u", "v", "component"))
        ids, first = np.unique(np.concatenate([u, v]), return_index=True)
        left, _ = A.double_matching(np.concatenate([u, v]), np.concatenate([v, u]))
        component, matched = np.unique(np.concatenate([c, c])[first][np.searchsorted(ids, left)], return_counts=True)
        return pd.DataFrame({"component": component, "matched": matched})

    per = H.in_groups(small).groupBy("task").applyInPandas(run, "component bigint, matched bigint")
    return per if large.isEmpty() else per.unionByName(_matched(large))


# --- covers ------------------------------------------------------------------


def heuristic(e: DataFrame, method: str = "best", tries: int = 6, steps: int = 300, seed: int = 0, kernel_edges: int = KERNEL_EDGES, seconds: float | None = None) -> DataFrame:
    """``id`` of a cover. Methods: ``max``, ``min`` (greedy by degree), ``best``
    (of ``tries`` randomised restarts) and ``search`` (local search from that).
    Restarts of one component run as tasks of their own; after ``seconds`` each
    gives its best so far."""
    small, large = _parts(e, kernel_edges)
    one = {"max": lambda g, s: K.greedy_max(g), "min": lambda g, s: K.greedy_min(g), "best": lambda g, s: K.best_of(g, 1, s, seconds), "search": lambda g, s: K.local_search(g, K.best_of(g, 1, s, seconds), steps, s, seconds)}[method]
    runs = small.withColumn("seed", F.explode(F.sequence(F.lit(seed), F.lit(seed + (tries if method in ("best", "search") else 1) - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, s = _graph(pdf), int(pdf["seed"].iloc[0])
        c = K.prune(g, one(g, s))
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "seed": [s], "size": [len(c)], "cover": [sorted(c)]})

    covers = runs.groupBy("component", "seed").applyInPandas(run, "component bigint, seed int, size int, cover array<bigint>")
    best = covers.groupBy("component").agg(F.min_by("cover", F.struct("size", "seed")).alias("cover"))
    out = best.select(F.explode("cover").alias("id"))
    return out if large.isEmpty() else out.unionByName(greedy_rounds(large))


def searches(e: DataFrame, methods: tuple[str, ...], vertices: int) -> DataFrame:
    """``component, method, size, valid`` of each component of at most so many
    vertices by each of ``kernels.SEARCHES`` and ``matrix`` (``bits.search``)."""
    c = G.components(e)
    few = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= vertices).select("component")
    small = e.join(c.join(few, "component", "left_semi").withColumnRenamed("id", "u"), "u")

    def matrix(g: K.Graph) -> set[int]:
        ids, rows = B.encode(g)
        return {ids[v] for v in B.search([B.start(rows)], len(ids), 1 << 60)[0]}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for component, part in pdf.groupby("component"):
            g = _graph(part)
            for m in methods:
                cover = (K.SEARCHES | {"matrix": matrix})[m](g)
                out.append((component, m, len(cover), K.is_cover(g, cover)))
        return pd.DataFrame(out, columns=["component", "method", "size", "valid"])

    return H.in_groups(small).groupBy("task").applyInPandas(run, "component bigint, method string, size bigint, valid boolean")


def residual_components(e: DataFrame, kernel_edges: int = A.EDGES, edges: int = A.EDGES) -> DataFrame:
    """``id, part``: strongly connected components of the residual graph of a
    maximum matching of the double cover, by their least vertex. Components of
    more than ``kernel_edges`` edges are matched and taken apart by joins, until
    at most ``edges`` edges are left for one task."""
    small, large = split_by_size(e, kernel_edges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, part = A.residual(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        return pd.DataFrame({"id": ids, "part": part})

    out = H.in_groups(small).groupBy("task").applyInPandas(run, "id bigint, part bigint")
    if large.isEmpty():
        return out
    s = materialise(G.double_cover(large))
    to = maximum_double_matching(large.select("u", "v"), edges).select("r", F.col("l").alias("b"))
    parts = G.strong_components(s.join(to, "r").select(F.col("l").alias("a"), "b"), 2 * edges)
    every = s.select(F.col("l").alias("id")).distinct()
    return out.unionByName(every.join(parts, "id", "left").select("id", F.coalesce("part", "id").alias("part")))


class Solution:
    """``cover`` (ids), ``size``, whether it is ``proven`` smallest, and the
    number of search ``nodes``."""

    def __init__(self, cover: DataFrame, proven: bool, nodes: int):
        self.cover, self.proven, self.nodes = cover, proven, nodes
        self.size = cover.count()

    def statistics(self) -> DataFrame:
        """``name, value`` rows: steps of the search, size, and whether proven."""
        rows = [("recursive steps", self.nodes), ("vc size", self.size), ("proven", int(self.proven))]
        return self.cover.sparkSession.createDataFrame(rows, "name string, value bigint")


FOUND = "component bigint, part int, size int, cover array<bigint>, open array<binary>, proven boolean, nodes bigint, log binary"


def _first(nodes: int, seconds: float | None, core: int):
    """Reduces a component and searches each part of its core: a row per part,
    and one (part -1) with the undo log."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        deadline = None if seconds is None else time.monotonic() + seconds
        component, g, log = pdf["component"].iloc[0], _graph(pdf), []
        K.reduce(g, log)
        rows = [(component, -1, 0, [], [], True, 0, pickle.dumps(log))]
        for k, part in enumerate(K.split(g)):
            known = K.local_search(part, K.best_of(part, 3, seconds=seconds), min(2000, 2_000_000 // len(part)), seconds=seconds)
            if len(part) > core:
                c, ok, n = K.branch_and_bound(part, known, nodes, None if deadline is None else max(0.0, deadline - time.monotonic()))
                rows.append((component, k, len(c), sorted(c), [], ok, n, None))
                continue
            names, matrix = B.encode(part)
            c, _, left, n = B.search([B.start(matrix)], len(known), nodes, deadline)
            best = sorted(known if c is None else [names[i] for i in c])
            rows.append((component, k, len(best), best, [pickle.dumps((names, s)) for s in left], True, n, None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _more(nodes: int, seconds: float | None):
    """Searches open subproblems on; better covers found in a task serve the
    next subproblem of the same part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        deadline = None if seconds is None else time.monotonic() + seconds
        limits: dict[tuple[int, int], int] = {}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                names, state = pickle.loads(r.state)
                at = (r.component, r.part)
                c, size, left, n = B.search([state], min(r.size, limits.get(at, r.size)), nodes, deadline)
                limits[at] = size
                cover = None if c is None else sorted(names[i] for i in c)
                rows.append((r.component, r.part, size if c else r.size, cover, [pickle.dumps((names, s)) for s in left], True, n, None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])

    return run


def solve_exact(e: DataFrame, nodes: int = NODES, kernel_edges: int = KERNEL_EDGES, loops: DataFrame | None = None, enough: int = ENOUGH, seconds: float | None = None, core: int = CORE) -> Solution:
    """Minimum cover: reduce (down to ``enough`` edges at least), split into
    components, reduce and search each. What a search leaves open after
    ``nodes`` nodes is a set of subproblems; all of them are searched on in
    parallel, with the best covers known and twice the nodes a round, until none
    is open. After ``seconds``, or if interrupted, the best covers so far are the result (not
    ``proven``). ``loops`` are vertices that any cover must hold. Components of
    more than ``kernel_edges`` edges meet the half-integral rule first; those that
    are still as large, and parts of more than ``core`` vertices
    that aren't solved within their nodes, are covered but not proven."""
    began = time.monotonic()
    rest = lambda: None if seconds is None else max(0.0, seconds - (time.monotonic() - began))
    if loops is not None:
        e = G.delete_vertices(e, loops)
    kernel = R.kernelize(e, enough=min(enough, kernel_edges))
    small, large = _parts(kernel.edges, kernel_edges)
    if not large.isEmpty():  # a cover in halves decides or cuts what no task may hold
        more = R.kernelize(large, ("R7", "R1", "R2", "R5"))
        kernel = R.Kernel(small.select("u", "v").unionByName(more.edges), kernel.rounds + more.rounds, kernel.names + more.names)
        small, large = _parts(kernel.edges, kernel_edges)
    first = materialise(small.groupBy("component").applyInPandas(_first(nodes, rest(), core), FOUND))
    best = first.where("part >= 0").select("component", "part", "size", "cover")
    states = lambda df: df.select("component", "part", F.explode("open").alias("state"))
    used, proven, found, rounds = [first], True, first, 0
    while True:
        left = states(found)
        waiting = left.count()
        if not waiting:
            break
        if seconds is not None and not rest():
            proven = False
            break
        rounds += 1
        tasks = min(waiting, 4 * e.sparkSession.sparkContext.defaultParallelism)
        asked = left.join(best.select("component", "part", "size"), ["component", "part"]).repartition(tasks)
        try:
            found = materialise(asked.mapInPandas(_more(nodes << rounds, rest()), FOUND))
        except KeyboardInterrupt:  # the best covers of the rounds before are the result
            e.sparkSession.sparkContext.cancelAllJobs()
            proven = False
            break
        used.append(found)
        better = best.unionByName(found.where("cover IS NOT NULL").select("component", "part", "size", "cover"))
        best = materialise(better.groupBy("component", "part").agg(F.min_by(F.struct("size", "cover"), F.struct("size", "cover")).alias("b")).select("component", "part", "b.size", "b.cover"))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        log = next(pickle.loads(x) for x in pdf["log"] if x is not None)
        return pd.DataFrame({"id": sorted(K.undo(log, {v for c in pdf["cover"] for v in c}))}, dtype="int64")

    logs = first.where("part < 0").select("component", "cover", "log")
    cover = best.select("component", "cover", F.lit(None).cast("binary").alias("log")).unionByName(logs).groupBy("component").applyInPandas(whole, "id bigint")
    steps = reduce(DataFrame.unionByName, [f.select("nodes", "proven") for f in used]).agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("n"), F.coalesce(F.min("proven"), F.lit(True)).alias("p")).first()
    proven = proven and steps.p
    if not large.isEmpty():
        cover, proven = cover.unionByName(greedy_rounds(large)), False
    cover = kernel.undo(cover)
    if loops is not None:
        cover = cover.unionByName(loops.select("id")).distinct()
    return Solution(materialise(cover), bool(proven), int(steps.n))
