"""Reduction rules as set operations on an edge DataFrame, with exact undo.

Rules that are safe for a whole batch (leaves, high degree, domination) take
everything at once. Rules that rewrite the graph need candidates that don't
touch: each candidate claims a set of vertices, every vertex keeps the smallest
claimant, and a candidate is selected if it keeps all its vertices. Disjoint
closed neighbourhoods are enough for degree two; the rules that connect
neighbours' neighbours claim the ball of radius two.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covergrid.operators import arrays as A
from covergrid.operators import graph as G
from covergrid.operators.halfint import half_integral
from covergrid.operators.salting import skew_join
from covergrid.session import discard, materialise

#: Undo log of one round: what was taken, or what decides between two takings.
LOG = "round int, kind string, v bigint, watch array<bigint>, other array<bigint>"
#: Cap on a case's neighbours' degrees in the SQL of r8_r9_selected only; the
#: operator has none, so they differ where a case lies next to a hub.
BALL = 64


def leaves(e: DataFrame) -> DataFrame:
    return G.of_degree(e, 1)


def r1_batch(e: DataFrame) -> DataFrame:
    """``id`` to take: neighbours of leaves; of two joined leaves the smaller.
    Leaves are combined by their neighbour before it is looked up, so a hub with
    many leaves is one row."""
    own = leaves(e)
    at = G.symmetric(e).join(own.withColumnRenamed("id", "u"), "u", "left_semi").groupBy(F.col("v").alias("id")).agg(F.min("u").alias("leaf"))
    both = at.join(own.withColumn("also", F.lit(True)), "id", "left")
    return both.select(F.when(F.col("also"), F.least("id", "leaf")).otherwise(F.col("id")).alias("id")).distinct()


def ego(e: DataFrame, d: int) -> DataFrame:
    """``v, near``: sorted neighbours of the vertices of degree ``d`` (so the
    arrays have ``d`` elements)."""
    s = G.symmetric(e)
    return s.join(G.of_degree(e, d).withColumnRenamed("id", "u"), "u", "left_semi").groupBy(F.col("u").alias("v")).agg(F.sort_array(F.collect_list("v")).alias("near"))


def ego_edges(e: DataFrame, d: int) -> DataFrame:
    """``v, near, inner``: and the edges among the neighbours, sorted."""
    egos = ego(e, d)
    pairs = [F.struct(F.get("near", i).alias("u"), F.get("near", j).alias("v")) for i in range(d) for j in range(i + 1, d)]
    asked = egos.select(F.col("v").alias("c"), F.inline(F.array(*pairs))).join(e, ["u", "v"], "left_semi")
    inner = asked.groupBy(F.col("c").alias("v")).agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("inner"))
    return egos.join(inner, "v", "left").withColumn("inner", F.coalesce("inner", F.array().cast("array<struct<u:bigint,v:bigint>>")))


def deg2(e: DataFrame) -> DataFrame:
    """``v, a, b, triangle`` of each vertex of degree two."""
    x = ego_edges(e, 2)
    return x.select("v", F.get("near", 0).alias("a"), F.get("near", 1).alias("b"), (F.size("inner") == 1).alias("triangle"))


def select_free(candidates: DataFrame, claims: DataFrame, seed: int | None = None) -> DataFrame:
    """Candidates ``v`` that are the first claimant of all they claim
    (``claims``: ``v, x``): the smallest, or with a ``seed`` that of the least
    hash, so that chains in order of ids go in parallel."""
    first = F.min("v") if seed is None else F.min_by("v", F.struct(F.xxhash64("v", F.lit(seed)), F.col("v")))
    least = claims.groupBy("x").agg(first.alias("first"))
    lost = claims.join(least, "x").where("v <> first").select("v").distinct()
    return candidates.join(lost, "v", "left_anti")


def r2_selected(e: DataFrame, seed: int | None = None) -> DataFrame:
    c = deg2(e)
    return select_free(c, c.select("v", F.explode(F.array("v", "a", "b")).alias("x")), seed)


def r3_high_degree(e: DataFrame, k: int) -> DataFrame:
    return G.degrees(e).where(F.col("deg") > k).select("id")


def r4_buss(e: DataFrame, k: int) -> DataFrame:
    """``n_vertices, n_edges, max_deg, excluded``: no cover of size ``k``."""
    over = (F.col("n_vertices") > k * k + k) | (F.col("n_edges") > k * k)
    return G.counts(e).select("n_vertices", "n_edges", "max_deg", ((F.col("max_deg") <= k) & over).alias("excluded"))


def dominators(e: DataFrame) -> DataFrame:
    """``u, v``: adjacent, and all other neighbours of v are neighbours of u.

    A vertex with a neighbour outside N(u) is ruled out by a single witness
    first (the neighbour of least degree), so wedges are made for survivors
    only, and only towards vertices of at least the same degree.
    """
    d = materialise(G.degrees(e))
    hot = G.hubs(d)
    both = G.with_ends(e, d, hot)
    s = materialise(both.select(F.inline(F.array(F.struct("u", "v", F.col("deg_u").alias("du"), F.col("deg_v").alias("dv")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("deg_v").alias("du"), F.col("deg_u").alias("dv"))))))
    # two neighbours of least degree of each v: at least one of them isn't u
    least = materialise(s.groupBy(F.col("u").alias("v")).agg(F.min(F.struct("dv", F.col("v").alias("w"))).alias("w1")))
    second = skew_join(s.select(F.col("u").alias("v"), F.col("v").alias("w"), "dv"), least, ["v"], F.col("w"), heavy=hot)
    second = second.where("w <> w1.w").groupBy("v").agg(F.min(F.struct("dv", "w")).alias("w2"))
    wit = least.select("v", F.col("w1.w").alias("w1")).join(second.select("v", F.col("w2.w").alias("w2")), "v", "left")
    cand = skew_join(s.where("dv <= du").select("u", "v", "dv"), wit, ["v"], F.col("u"), heavy=hot).withColumn("w", F.when(F.col("w1") != F.col("u"), F.col("w1")).otherwise(F.col("w2")))
    plain = s.select(F.col("u").alias("x"), F.col("v").alias("w"))
    passed = cand.where("w IS NOT NULL").join(plain.withColumnRenamed("x", "u"), ["u", "w"], "left_semi").select("u", "v", "dv").unionByName(cand.where("w IS NULL").select("u", "v", "dv"))
    passed = materialise(passed)
    # only vertices of at least v's degree are beside a hub v here, so its rows are few to copy
    wedge = skew_join(plain.withColumnRenamed("x", "v"), passed, ["v"], F.col("w"), heavy=hot).where("w <> u")
    common = wedge.join(plain.withColumnRenamed("x", "u"), ["u", "w"], "left_semi").groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))
    return passed.join(common, ["u", "v"], "left").where(F.coalesce("c", F.lit(0)) == F.col("dv") - 1).select("u", "v")


def r5_batch(e: DataFrame) -> DataFrame:
    """``id`` to take by domination, all at once: the least of each chain of
    dominators stays; of twins the smaller id."""
    p = dominators(e)
    back = p.select(F.col("u").alias("v"), F.col("v").alias("u"), F.lit(True).alias("twin"))
    return p.join(back, ["u", "v"], "left").where("twin IS NULL OR u > v").select(F.col("u").alias("id")).distinct()


def deg3_cases(e: DataFrame) -> DataFrame:
    """``v, kind, a, b, c``: ``independent`` (a, b, c in order), ``edge`` (a, b
    joined, c single), ``path`` (c is the centre) or ``triangle``."""
    x = ego_edges(e, 3)
    n = F.size("inner")
    a, b, c = (F.get("near", i) for i in range(3))
    p, q = F.get("inner", 0), F.get("inner", 1)
    single = F.filter("near", lambda y: (y != p["u"]) & (y != p["v"]))
    centre = F.filter("near", lambda y: ((y == p["u"]) | (y == p["v"])) & ((y == q["u"]) | (y == q["v"])))
    ends = F.filter("near", lambda y: ~(((y == p["u"]) | (y == p["v"])) & ((y == q["u"]) | (y == q["v"]))))
    kind = F.when(n == 0, "independent").when(n == 1, "edge").when(n == 2, "path").otherwise("triangle")
    return x.select(
        "v", kind.alias("kind"),
        F.when(n == 1, p["u"]).when(n == 2, F.get(ends, 0)).otherwise(a).alias("a"),
        F.when(n == 1, p["v"]).when(n == 2, F.get(ends, 1)).otherwise(b).alias("b"),
        F.when(n == 1, F.get(single, 0)).when(n == 2, F.get(centre, 0)).otherwise(c).alias("c"),
    )


def deg4_patterns(e: DataFrame) -> DataFrame:
    """``v, near, inner, n_inner, max_inner, min_inner, per``: edges among the
    four neighbours, and how many of them each neighbour (``per``) has."""
    x = ego_edges(e, 4)
    per = F.transform("near", lambda y: F.size(F.filter("inner", lambda p: (p["u"] == y) | (p["v"] == y))))
    return x.select("v", "near", "inner", F.size("inner").alias("n_inner"), F.array_max(per).alias("max_inner"), F.array_min(per).alias("min_inner"), per.alias("per"))


def deg4_cliques(e: DataFrame) -> DataFrame:
    """``v, kind, first, second``: neighbours that are two cliques. ``triangle``:
    three and a single; ``cycle``: of a 4-cycle a, b and then c, d, where a isn't
    next to c and b isn't next to d."""
    x = deg4_patterns(e)
    kind = F.when((F.col("n_inner") == 3) & (F.col("min_inner") == 0) & (F.col("max_inner") == 2), "triangle").when((F.col("n_inner") == 4) & (F.col("max_inner") == 2), "cycle")
    x = x.withColumn("kind", kind).where("kind IS NOT NULL")
    single = F.get("near", F.array_position("per", F.lit(0)).cast("int") - 1)
    a = F.get("near", 0)
    beside = F.array_sort(F.transform(F.filter("inner", lambda p: (p["u"] == a) | (p["v"] == a)), lambda p: F.when(p["u"] == a, p["v"]).otherwise(p["u"])))
    b, d = F.get(beside, F.lit(0)), F.get(beside, F.lit(1))
    c = F.get(F.array_except("near", F.array(a, b, d)), F.lit(0))
    three = F.col("kind") == "triangle"
    return x.select("v", "kind", F.when(three, F.array_except("near", F.array(single))).otherwise(F.array(a, b)).alias("first"), F.when(three, F.array(single)).otherwise(F.array(c, d)).alias("second"))


def deg4_clique_cases(e: DataFrame) -> DataFrame:
    """``v, kind``: ``triangle`` and a single, or ``cycle`` of four."""
    return deg4_cliques(e).select("v", "kind")


def r12_dominators(e: DataFrame) -> DataFrame:
    """``v, u``: neighbours of a vertex of degree four next to the other three."""
    return deg4_patterns(e).select("v", F.inline(F.arrays_zip(F.col("near").alias("u"), F.col("per").alias("k")))).where("k = 3").select("v", "u")


def added_edges(e: DataFrame, cases: DataFrame) -> DataFrame:
    """``c, u, v``: edges that the rule adds at each case of ``deg3_cases``
    (kinds independent and edge)."""
    s = G.symmetric(e)
    ind, edge = cases.where("kind = 'independent'"), cases.where("kind = 'edge'")
    to_far = lambda df, x, of: df.select(F.col("v").alias("c"), F.col(x).alias("u"), F.col(of).alias("o")).join(s.select(F.col("u").alias("o"), F.col("v").alias("y")), "o").where("y <> c AND y <> u").select("c", "u", F.col("y").alias("v"))
    own = ind.select(F.col("v").alias("c"), F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")))))
    parts = [own, to_far(ind, "a", "b"), to_far(ind, "b", "c"), to_far(ind, "c", "a"), to_far(edge, "a", "c"), to_far(edge, "b", "c")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("c", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def select_ball(e: DataFrame, cases: DataFrame, seed: int | None = None, steps: int = 4, edges: int = A.EDGES) -> DataFrame:
    """Cases whose balls of radius two don't meet: those that are the first (as
    in ``select_free``) of all cases within four (or so many) steps.

    The first case travels along edges, one row per vertex, so a ball is never
    listed, whatever hubs it holds; rows of hubs are salted. Of at most
    ``edges`` edges and cases it travels in one task.
    """
    h = F.lit(0).cast("bigint") if seed is None else F.xxhash64("v", F.lit(seed))
    own = materialise(cases.select(F.col("v").alias("id"), F.struct(h.alias("h"), F.col("v").alias("c")).alias("first")))
    if e.count() + own.count() <= edges:
        none = F.lit(None).cast("bigint")
        rows = e.select("u", "v", none.alias("h")).unionByName(own.select(F.col("id").alias("u"), none.alias("v"), F.col("first.h").alias("h")))

        def first(u: pa.Array, v: pa.Array, h: pa.Array) -> tuple[list[pa.Array], list[str]]:
            case = v.is_null()
            edge = pc.invert(case)
            ids = u.filter(case)
            return [ids.filter(pa.array(A.firsts(u.filter(edge).to_numpy(), v.filter(edge).to_numpy(), ids.to_numpy(), h.filter(case).to_numpy(), steps)))], ["v"]

        return cases.join(materialise(A.in_one_task(rows, first, "v bigint")), "v", "left_semi")
    s, heavy, near = materialise(G.symmetric(e)), G.hubs_of(e), own
    for _ in range(steps):
        seen = skew_join(s, near.select(F.col("id").alias("v"), "first"), ["v"], F.col("u"), heavy=heavy)
        after = materialise(seen.select(F.col("u").alias("id"), "first").unionByName(near).groupBy("id").agg(F.min("first").alias("first")))
        discard(near)
        near = after
    return cases.join(near.where(F.col("first.c") == F.col("id")).select(F.col("id").alias("v")), "v", "left_semi")


def unconfined(e: DataFrame) -> DataFrame:
    """``id, steps``: unconfined vertices, each by itself in the whole graph, and
    the size of the set S that showed it.

    S starts as the vertex. Of the vertices next to S that see one vertex of it,
    one with the fewest neighbours outside S and its neighbours counts: with none
    the vertex is unconfined, with one that neighbour joins S, else it isn't.
    The first step counts common neighbours of edges; later steps list the
    surroundings of the vertices that are still open only.
    """
    s = materialise(G.symmetric(e))
    d, common = materialise(G.degrees(e)), materialise(G.common_neighbours(e))
    hot = G.hubs(d)
    known = G.with_ends(e, d, hot).join(common, ["u", "v"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    way = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"), (F.col(f"deg_{u}") - 1 - F.col("common")).alias("rest"))
    rest = known.select(F.inline(F.array(way("u", "v"), way("v", "u")))).where("rest < 2")
    low = materialise(rest.groupBy("v").agg(F.min(F.struct("rest", "u")).alias("m")).select("v", "m.rest", "m.u"))
    out = [low.where("rest = 0").select(F.col("v").alias("id"), F.lit(1).alias("steps"))]
    # (v, x) of each S so far, and the one that joins
    grown = skew_join(s.select(F.col("u").alias("x"), F.col("v").alias("w")), low.where("rest = 1").select("v", F.col("u").alias("x")), ["x"], F.col("w"), heavy=hot)
    w = grown.where("w <> v").join(s.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"], "left_anti").select("v", F.col("w").alias("x"))
    inside = materialise(w.unionByName(low.where("rest = 1").select("v", F.col("v").alias("x"))))
    steps = 2
    while not inside.isEmpty():
        near = materialise(skew_join(s.select(F.col("u").alias("x"), F.col("v").alias("y")), inside, ["x"], F.col("y"), heavy=hot).groupBy("v", "y").agg(F.count(F.lit(1)).alias("n")))
        closed = near.select("v", "y").unionByName(inside.select("v", F.col("x").alias("y"))).distinct()
        border = near.where("n = 1").select("v", F.col("y").alias("x")).join(inside, ["v", "x"], "left_anti")
        far = skew_join(s.select(F.col("u").alias("x"), F.col("v").alias("y")), border, ["x"], F.col("y"), heavy=hot).select("v", "x", "y").join(closed, ["v", "y"], "left_anti")
        counts = far.groupBy("v", "x").agg(F.count(F.lit(1)).alias("rest"), F.min("y").alias("y"))
        low = border.join(counts, ["v", "x"], "left").groupBy("v").agg(F.min(F.struct(F.coalesce("rest", F.lit(0)).alias("rest"), "x", "y")).alias("m"))
        low = materialise(low.select("v", "m.rest", "m.y").where("rest < 2"))
        out.append(low.where("rest = 0").select(F.col("v").alias("id"), F.lit(steps).alias("steps")))
        one = low.where("rest = 1").select("v", F.col("y").alias("x"))
        after = materialise(inside.join(one.select("v"), "v", "left_semi").unionByName(one))
        discard(inside, near)
        inside, steps = after, steps + 1
    return reduce(DataFrame.unionByName, out)


# --- rounds with a log -------------------------------------------------------


def _entry(df: DataFrame, kind: str, v: Column, watch: list[Column], other: list[Column]) -> DataFrame:
    big = lambda xs: F.array(*xs).cast("array<bigint>")
    return df.select(F.lit(kind).alias("kind"), v.cast("bigint").alias("v"), big(watch).alias("watch"), big(other).alias("other"))


def take(e: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return G.delete_vertices(e, ids), _entry(ids, "take", F.col("id"), [], [F.col("id")])


def apply_r1(e: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    return take(e, r1_batch(e))


def apply_r3(e: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    return take(e, r3_high_degree(e, k))


def apply_r5(e: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    return take(e, r5_batch(e))


def apply_r2(e: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    sel = materialise(r2_selected(e, seed))
    tri, fold = sel.where("triangle"), sel.where("NOT triangle")
    out = G.delete_vertices(e, tri.select(F.explode(F.array("v", "a", "b")).alias("id")))
    out = G.relabel(out, fold.select(F.explode(F.array("a", "b")).alias("id"), F.col("v").alias("rep")))
    log = _entry(tri, "take", F.col("v"), [], [F.col("a"), F.col("b")]).unionByName(_entry(fold, "fold", F.col("v"), [F.col("v")], [F.col("a"), F.col("b")]))
    return out, log


def apply_deg3(e: DataFrame, seed: int | None = None, kinds: tuple[str, ...] = ("independent", "edge")) -> tuple[DataFrame, DataFrame]:
    """Independent neighbours and edge-and-single, on cases far apart."""
    sel = materialise(select_ball(e, deg3_cases(e).where(F.col("kind").isin(*kinds)), seed))
    gone = sel.select(F.explode(F.when(F.col("kind") == "edge", F.array("v", "c")).otherwise(F.array("v"))).alias("id"))
    more = added_edges(e, sel).select("u", "v")
    out = G.add_edges(G.delete_vertices(e, gone), G.delete_vertices(more, gone))
    log = _entry(sel.where("kind = 'edge'"), "pair", F.col("v"), [F.col("a"), F.col("b")], [F.col("c")]).unionByName(
        _entry(sel.where("kind = 'independent'"), "three", F.col("v"), [F.col("a"), F.col("b"), F.col("c")], [])
    )
    return out, log


def apply_r2a(e: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Degree two, triangles only: both neighbours are taken."""
    c = deg2(e).where("triangle")
    sel = materialise(select_free(c, c.select("v", F.explode(F.array("v", "a", "b")).alias("x")), seed))
    return take(e, sel.select(F.explode(F.array("a", "b")).alias("id")))


def apply_r3_budget(e: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """All vertices of degree above the budget ``k``, which falls by each taken,
    again and again; also the budget left (negative: no cover of size ``k``)."""
    e, log = materialise(e), None
    while k >= 0:
        took = materialise(r3_high_degree(e, k))
        n = took.count()
        if not n:
            break
        after, own = take(e, took)
        after = materialise(after)
        discard(e)
        e, k, log = after, k - n, own if log is None else log.unionByName(own)
    return e, log if log is not None else e.sparkSession.createDataFrame([], LOG).drop("round"), k


def apply_r6(e: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Unconfined vertices so far apart that none was looked at when another
    was tested: a test with a set of s vertices sees no further than 2s steps."""
    found = materialise(unconfined(e))
    most = found.agg(F.max("steps")).first()[0]
    if most is None:
        return take(e, found.select("id"))
    sel = select_ball(e, found.select(F.col("id").alias("v")), seed, 2 * most)
    return take(e, materialise(sel.select(F.col("v").alias("id"))))


def apply_r7(e: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices of value one in a smallest cover in halves, all at once."""
    return take(e, materialise(half_integral(e).where("twice = 2").select("id")))


def _dominating(e: DataFrame, pairs: DataFrame, degree: int) -> DataFrame:
    """``id`` of vertices ``u`` of ``pairs(v, u)`` that dominate a ``v`` of the
    given degree; of twins (which have that degree too) the smaller id stays."""
    p = pairs.join(G.degrees(e).withColumnRenamed("id", "u"), "u")
    return p.where((F.col("deg") > degree) | (F.col("u") > F.col("v"))).select(F.col("u").alias("id")).distinct()


def r10_dominators(e: DataFrame) -> DataFrame:
    """``v, u``: neighbours of a vertex of degree three next to the other two."""
    c = deg3_cases(e).where("kind IN ('path', 'triangle')")
    return c.select("v", F.explode(F.when(F.col("kind") == "path", F.array("c")).otherwise(F.array("a", "b", "c"))).alias("u"))


def apply_r10(e: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    return take(e, materialise(_dominating(e, r10_dominators(e), 3)))


def apply_r12(e: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    return take(e, materialise(_dominating(e, r12_dominators(e), 4)))


def apply_r11(e: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two cliques around a vertex of degree four, on cases far apart: the second
    goes, and each vertex of the first takes over the neighbours of those of the
    second that it isn't next to."""
    sel = materialise(select_ball(e, deg4_cliques(e), seed))
    gone = sel.select(F.explode(F.concat(F.array("v"), "second")).alias("id"))
    same = F.transform("first", lambda x: F.struct(x.alias("x"), F.get("second", F.lit(0)).alias("o")))
    pairs = sel.select("v", F.inline(F.when(F.col("kind") == "triangle", same).otherwise(F.arrays_zip(F.col("first").alias("x"), F.col("second").alias("o")))))
    s = G.symmetric(e).select(F.col("u").alias("o"), F.col("v").alias("y"))
    more = pairs.join(s, "o").where("y <> v AND y <> x").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    out = G.add_edges(G.delete_vertices(e, gone), G.delete_vertices(more, gone))
    log = sel.select(F.when(F.col("kind") == "triangle", "clique3").otherwise("clique4").alias("kind"), F.col("v").cast("bigint").alias("v"), F.col("first").cast("array<bigint>").alias("watch"), F.col("second").cast("array<bigint>").alias("other"))
    return out, log


def decrease(log: DataFrame) -> DataFrame:
    """``dec``: how much the optimum fell over a log."""
    d = F.when(F.col("kind").isin("take", "clique3", "clique4"), F.size("other")).when(F.col("kind").isin("fold", "pair"), 1).otherwise(0)
    return log.agg(F.coalesce(F.sum(d), F.lit(0)).cast("bigint").alias("dec"))


def undo_round(log: DataFrame, cover: DataFrame) -> DataFrame:
    """Cover before one round, from a cover after it. Entries of a round don't
    touch, so their order doesn't matter."""
    asked = log.select("v", "kind", "watch", "other", F.explode_outer("watch").alias("x"))
    have = asked.join(cover.select(F.col("id").alias("x"), F.lit(True).alias("in_")), "x", "left").groupBy("v", "kind", "watch", "other").agg(F.sort_array(F.collect_set(F.when(F.col("in_"), F.col("x")))).alias("have"))  # at most three
    n = F.size("have")
    a, b, c = (F.get("watch", i) for i in range(3))
    has = lambda x: F.array_contains("have", x)
    none = F.array().cast("array<bigint>")
    plus = (
        F.when(F.col("kind") == "take", F.col("other"))
        .when(F.col("kind") == "fold", F.when(n == 1, F.col("other")).otherwise(F.array("v")))
        .when(F.col("kind") == "pair", F.when(n == 2, F.col("other")).otherwise(F.array("v")))
        .when((F.col("kind") == "three") & (n < 3), F.array("v"))
        .when(F.col("kind") == "clique3", F.when(n == 3, F.col("other")).otherwise(F.array("v")))
        .when(F.col("kind") == "clique4", F.when(n == 2, F.col("other")).when(has(a), F.array(F.col("v"), F.get("other", 0))).otherwise(F.array(F.col("v"), F.get("other", 1))))
        .otherwise(none)
    )
    minus = (
        F.when((F.col("kind") == "fold") & (n == 1), F.array("v"))
        .when((F.col("kind") == "three") & (n == 2), F.array(F.when(~has(c), a).when(~has(a), b).otherwise(c)))
        .when((F.col("kind") == "three") & (n == 1), F.col("have"))
        .otherwise(none)
    )
    step = materialise(have.select(plus.alias("plus"), minus.alias("minus")))
    kept = cover.select("id").join(step.select(F.explode("minus").alias("id")), "id", "left_anti")
    return kept.unionByName(step.select(F.explode("plus").alias("id"))).distinct()


class Kernel:
    """A reduced graph ``edges`` and the log of the rounds that led to it; with a
    budget, what is left of it (``k``) and whether it may still do
    (``feasible``)."""

    def __init__(self, edges: DataFrame, rounds: list[DataFrame], names: list[str], k: int | None = None, feasible: bool = True):
        self.edges, self.rounds, self.names, self.k, self.feasible = edges, rounds, names, k, feasible

    def log(self) -> DataFrame:
        empty = self.edges.sparkSession.createDataFrame([], LOG)
        for i, r in enumerate(self.rounds):
            empty = empty.unionByName(r.withColumn("round", F.lit(i)))
        return empty

    def counters(self) -> DataFrame:
        """``rule, rounds, applied, decrease``: how often each rule that applied
        did, and how much the optimum fell by it."""
        spark = self.edges.sparkSession
        named = spark.createDataFrame(list(enumerate(self.names)), "round int, rule string")
        each = self.log().withColumn("dec", F.when(F.col("kind").isin("take", "clique3", "clique4"), F.size("other")).when(F.col("kind").isin("fold", "pair"), 1).otherwise(0))
        return each.join(F.broadcast(named), "round").groupBy("rule").agg(F.countDistinct("round").alias("rounds"), F.count(F.lit(1)).alias("applied"), F.sum("dec").alias("decrease"))

    def decided(self) -> DataFrame:
        """``id`` of cover vertices that the log alone decides (``take``)."""
        return self.log().where("kind = 'take'").select(F.explode("other").alias("id"))

    def undo(self, cover: DataFrame) -> DataFrame:
        out = cover.select("id")
        for r in reversed(self.rounds):
            out = materialise(undo_round(r, out))
        return out


RULES = {
    "R1": apply_r1, "R2": apply_r2, "R2a": apply_r2a, "R5": apply_r5, "R6": apply_r6, "R7": apply_r7, "R8_R9": apply_deg3,
    "R8": lambda e, seed=None: apply_deg3(e, seed, ("independent",)), "R9": lambda e, seed=None: apply_deg3(e, seed, ("edge",)),
    "R10": apply_r10, "R11": apply_r11, "R12": apply_r12,
}
#: Rules that need a budget.
BUDGET = ("R3", "R4")
#: What is applied before a pseudo-Boolean solver: no rule that folds.
BEFORE_SOLVER = ("R1", "R2a", "R5", "R6", "R7")


def dynamic(depth: int) -> tuple[str, ...]:
    """Rules at a depth of a search with a budget: the dear ones now and then."""
    return ("R1", "R2", "R3", "R4") + (("R6", "R7") if depth % 10 == 0 else ())


def kernelize(e: DataFrame, order: tuple[str, ...] = ("R1", "R2", "R5"), enough: int = 0, k: int | None = None) -> Kernel:
    """Rules to a fixpoint: each pass applies the rules in turn, until none of
    them applies. Every rule that applies removes a vertex, so this ends; folds
    are chosen by hash, and R1 takes turns with R2, so paths and trees shrink by
    a share of themselves in a pass. Only at ``enough`` edges it stops early.

    With a budget ``k`` the rules R3 and R4 may be named too; the kernel says
    what is left of it, and isn't ``feasible`` once no cover of size ``k`` can
    exist.
    """
    if k is None and set(order) & set(BUDGET):
        raise ValueError("R3 and R4 need a budget")
    e, rounds, names, idle, feasible = materialise(e), [], [], 0, True
    left = e.count()
    while feasible and left > enough and idle < len(order):
        for rule in order:
            if rule == "R4":
                log, feasible = None, not r4_buss(e, k).first().excluded
            elif rule == "R3":
                out, log, budget = apply_r3_budget(e, k)
            else:
                out, log = RULES[rule](e, len(rounds))
            log = None if log is None else materialise(log)
            if log is None or log.isEmpty():
                idle += 1
                discard(log)
            else:
                idle = 0
                rounds.append(log)
                names.append(rule)
                after = materialise(out)
                discard(e)
                e = after
                left = e.count()
                if k is not None:
                    k = budget if rule == "R3" else k - decrease(log).first().dec
                    feasible = k >= 0
            if not feasible or left <= enough or idle == len(order):
                break
    return Kernel(e, rounds, names, k, feasible and (k is None or k > 0 or not left))
