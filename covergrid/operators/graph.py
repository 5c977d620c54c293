"""Undirected graphs as DataFrames: builders, lookups, counts, mutations.

A graph is a DataFrame ``u, v`` of distinct edges with ``u < v``; the symmetric
view holds both directions. A vertex exists only as an end of an edge. Vertex
ids may be of any orderable type. Rows with a null end are no edges; a self-loop
forces its vertex into every cover, so builders keep loops apart. All functions
return new DataFrames; nothing is collected unless said.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covergrid.operators import arrays as A
from covergrid.operators.salting import HEAVY_ROWS, HEAVY_SHARE, skew_join
from covergrid.session import discard, materialise


def canonical(raw: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges ``u < v`` of a multiset of pairs, loops left out."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    return raw.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct()


def loops(raw: DataFrame, a: str, b: str) -> DataFrame:
    """``id`` of vertices with a self-loop."""
    return raw.where(F.col(f"`{a}`") == F.col(f"`{b}`")).select(F.col(f"`{a}`").alias("id")).distinct()


def symmetric(e: DataFrame) -> DataFrame:
    """Both directions of each edge, in one pass over ``e``."""
    both = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return e.select(F.inline(both))


def degrees(e: DataFrame) -> DataFrame:
    return symmetric(e).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("deg"))


def vertices(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def dictionary(raw: DataFrame, order: str, names: list[str], scope: list[str]) -> DataFrame:
    """``scope..., name, id``: dense ids from 0 in order of first appearance
    (by ``order``, then by field). A range sort and one offset per partition;
    no single-partition window."""
    cells = F.array(*[F.struct(F.col(f"`{n}`").alias("name"), F.struct(F.col(f"`{order}`").alias("o"), F.lit(i).alias("p")).alias("at")) for i, n in enumerate(names)])
    first = raw.select(*scope, F.inline(cells)).where("name IS NOT NULL").groupBy(*scope, "name").agg(F.min("at").alias("at"))
    placed = materialise(first.orderBy("at", *scope, "name").withColumn("mid", F.monotonically_increasing_id()))
    part, pos = F.shiftright("mid", 33), F.col("mid").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c"))  # a row per partition
    offset = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("offset"))
    return placed.withColumn("part", part).join(F.broadcast(offset), "part").select(*scope, "name", (F.col("offset") + pos).alias("id"))


# --- lookups -----------------------------------------------------------------


def neighbours(e: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, nb`` of each vertex of ``ids(id)``."""
    return symmetric(e).join(ids.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("u").alias("id"), F.col("v").alias("nb"))


def set_neighbourhood(e: DataFrame, ids: DataFrame) -> DataFrame:
    """``id`` of vertices next to the set but not in it."""
    return neighbours(e, ids).select(F.col("nb").alias("id")).distinct().join(ids, "id", "left_anti")


def nth_neighbour(e: DataFrame, n: int) -> DataFrame:
    """``id, nb``: the n-th (from 0) neighbour in order of ids; -1 if there is
    none (numeric ids). Ranks by a window, which spills; no array of a hub."""
    w = Window.partitionBy("u").orderBy("v")
    ranked = symmetric(e).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n + 1)
    return ranked.groupBy(F.col("u").alias("id")).agg(F.coalesce(F.max(F.when(F.col("k") == n + 1, F.col("v"))), F.lit(-1)).alias("nb"))


def first_two_neighbours(e: DataFrame) -> DataFrame:
    """``id, nb1, nb2`` (null if there is no second): two smallest neighbours,
    by a rank that Spark cuts off per group before and after the shuffle."""
    w = Window.partitionBy("u").orderBy("v")
    ranked = symmetric(e).withColumn("k", F.row_number().over(w)).where("k <= 2")  # limited per group before the shuffle
    return ranked.groupBy(F.col("u").alias("id")).agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("nb1"), F.max(F.when(F.col("k") == 2, F.col("v"))).alias("nb2"))


def edges_exist(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, present`` for asked pairs ``a, b`` in either order."""
    asked = pairs.withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b"))
    return asked.join(e.withColumn("hit", F.lit(True)), ["u", "v"], "left").select("a", "b", F.coalesce("hit", F.lit(False)).alias("present"))


def of_degree(e: DataFrame, d: int) -> DataFrame:
    return degrees(e).where(F.col("deg") == d).select("id")


def first_of_degree(e: DataFrame, d: int) -> DataFrame:
    return of_degree(e, d).orderBy("id").limit(1)


def sorted_by_degree(e: DataFrame) -> DataFrame:
    return degrees(e).orderBy("deg", "id")


def names_of(ids: DataFrame, names: DataFrame) -> DataFrame:
    """``id, name`` by a dictionary ``names(id, name)``."""
    return ids.select("id").join(names.select("id", "name"), "id")


def first_edge(e: DataFrame) -> DataFrame:
    return e.orderBy("u", "v").limit(1)


def first_connected(e: DataFrame) -> DataFrame:
    """``id`` of one vertex that has an edge: the smallest."""
    return e.agg(F.least(F.min("u"), F.min("v")).alias("id")).where("id IS NOT NULL")


def finished(e: DataFrame) -> DataFrame:
    """``finished``: whether no edge is left (one row)."""
    return e.limit(1).agg((F.count(F.lit(1)) == 0).alias("finished"))


def inactive(all_ids: DataFrame, active: DataFrame) -> DataFrame:
    """``id`` of vertices that aren't active: the cover so far."""
    return all_ids.select("id").distinct().join(active.select("id"), "id", "left_anti")


# --- choices (ties: the smallest id) -----------------------------------------


def top_degrees(e: DataFrame, k: int) -> DataFrame:
    return degrees(e).orderBy(F.desc("deg"), "id").limit(k)


def max_degree_vertex(e: DataFrame, among: DataFrame | None = None) -> DataFrame:
    d = degrees(e)
    return (d.join(among, "id", "left_semi") if among is not None else d).orderBy(F.desc("deg"), "id").limit(1)


def min_degree_vertex(e: DataFrame) -> DataFrame:
    return degrees(e).orderBy("deg", "id").limit(1)


def max_degree_min_neighbour_sum(e: DataFrame) -> DataFrame:
    """Among vertices of maximum degree, that whose neighbours' degrees sum to
    the least: ``id, deg, nbsum``."""
    d = materialise(degrees(e))
    top = d.join(F.broadcast(d.agg(F.max("deg").alias("deg"))), "deg")
    s, hot = symmetric(e), hubs(d)
    s = skew_join(s, top.withColumnRenamed("id", "u"), ["u"], F.col("v"), heavy=hot)
    return skew_join(s, d.select(F.col("id").alias("v"), F.col("deg").alias("nd")), ["v"], F.col("u"), heavy=hot).groupBy(F.col("u").alias("id"), "deg").agg(F.sum("nd").alias("nbsum")).orderBy("nbsum", "id").limit(1)


def random_vertex(e: DataFrame, seed: int, top_bucket: bool = False) -> DataFrame:
    """One connected vertex: a degree by hash among the degrees present (or the
    largest), then a vertex of that degree by hash; the same for one seed."""
    d = degrees(e)
    if top_bucket:
        pick = d.agg(F.max("deg").alias("deg"))
    else:
        pick = d.select("deg").distinct().orderBy(F.xxhash64(F.lit(seed), F.col("deg")), "deg").limit(1)
    return d.join(F.broadcast(pick), "deg").orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(1).select("id", "deg")


def histogram(e: DataFrame) -> DataFrame:
    return degrees(e).groupBy("deg").agg(F.count(F.lit(1)).alias("n"))


def counts(e: DataFrame) -> DataFrame:
    """``n_vertices, n_edges, max_deg, sum_deg``; zeros (max -1) if empty."""
    return degrees(e).agg(F.count(F.lit(1)).alias("n_vertices"), (F.coalesce(F.sum("deg"), F.lit(0)) / 2).cast("bigint").alias("n_edges"), F.coalesce(F.max("deg"), F.lit(-1)).alias("max_deg"), F.coalesce(F.sum("deg"), F.lit(0)).alias("sum_deg"))


# --- mutations ---------------------------------------------------------------


def delete_vertices(e: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id")
    return e.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v")


def reactivate(original: DataFrame, gone: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after vertices ``ids`` of those deleted from ``original`` have
    come back, and what is still gone."""
    still = gone.select("id").join(ids.select("id"), "id", "left_anti")
    return delete_vertices(original, still), still


def induced(e: DataFrame, ids: DataFrame) -> DataFrame:
    return e.join(ids.select(F.col("id").alias("u")), "u", "left_semi").join(ids.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")


def isolated_after(e: DataFrame, ids: DataFrame) -> DataFrame:
    """``id`` of other vertices that lose all edges when ``ids`` go."""
    return vertices(e).join(ids, "id", "left_anti").join(vertices(delete_vertices(e, ids)), "id", "left_anti")


def add_edges(e: DataFrame, more: DataFrame) -> DataFrame:
    return canonical(e.unionByName(more.select("u", "v")), "u", "v")


def remove_edges(e: DataFrame, less: DataFrame) -> DataFrame:
    return e.join(canonical(less, "u", "v"), ["u", "v"], "left_anti")


def relabel(e: DataFrame, to: DataFrame) -> DataFrame:
    """Replace ids by ``to(id, rep)``; loops and parallel edges vanish."""
    m = to.select("id", "rep")
    x = e.join(m.withColumnRenamed("id", "u").withColumnRenamed("rep", "ru"), "u", "left").join(m.withColumnRenamed("id", "v").withColumnRenamed("rep", "rv"), "v", "left")
    return canonical(x.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")), "u", "v")


# --- triangles, components, verification ------------------------------------


def hubs(d: DataFrame) -> list[tuple]:
    """Vertices of ``degrees`` that hold so many edge ends that joins on them
    are salted: at most ``1 / HEAVY_SHARE``, as key tuples."""
    ends = d.agg(F.sum("deg")).first()[0] or 0
    if ends < HEAVY_ROWS:
        return []
    least = max(HEAVY_ROWS, ends * HEAVY_SHARE)
    return [(r.id,) for r in d.where(F.col("deg") >= least).select("id").collect()]


def hubs_of(e: DataFrame) -> list[tuple]:
    d = materialise(degrees(e))
    hot = hubs(d)
    discard(d)
    return hot


def with_ends(e: DataFrame, of: DataFrame, hot: list[tuple]) -> DataFrame:
    """Edges with the columns of ``of(id, ...)`` for each end, named ``..._u``
    and ``..._v``; hubs are salted."""
    for end, other in (("u", "v"), ("v", "u")):
        own = of.select(F.col("id").alias(end), *[F.col(f"`{c}`").alias(f"{c}_{end}") for c in of.columns if c != "id"])
        e = skew_join(e, own, [end], F.col(other), heavy=hot)
    return e


def common_neighbours(e: DataFrame) -> DataFrame:
    """``u, v, common`` for edges with at least one common neighbour. Edges
    point from the lower to the higher degree, so wedges are O(m**1.5) even
    around hubs; each triangle is found once."""
    d = materialise(degrees(e))
    x = with_ends(e, d, hubs(d))
    up = (F.col("deg_u") < F.col("deg_v")) | ((F.col("deg_u") == F.col("deg_v")) & (F.col("u") < F.col("v")))
    o = materialise(x.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("t")))
    wedge = o.join(o.withColumnRenamed("t", "t2"), "s").where("t < t2").select("s", F.col("t").alias("u"), F.col("t2").alias("v"))
    tri = wedge.join(e, ["u", "v"])
    sides = F.array(*[F.struct(F.least(F.col(a), F.col(b)).alias("u"), F.greatest(F.col(a), F.col(b)).alias("v")) for a, b in (("s", "u"), ("s", "v"), ("u", "v"))])
    return tri.select(F.inline(sides)).groupBy("u", "v").agg(F.count(F.lit(1)).alias("common"))


def components(e: DataFrame, edges: int = A.EDGES) -> DataFrame:
    """``id, component``: the smallest vertex id of each component.

    While there are more than ``edges`` edges, every vertex hooks onto the vertex
    of least hash among itself and its neighbours, and edges are carried over to
    what was hooked onto; about half of the vertices of a path go in a round,
    more elsewhere, so rounds are few and their sizes add up to a multiple of
    the input. The rest is finished in one task. Labels come back round by
    round. Hubs are salted; every round is written, so a lost executor costs a
    round at most.
    """
    left, hooks = materialise(e.select("u", "v")), []
    while left.count() > edges:
        least = lambda c: F.struct(F.xxhash64(c, F.lit(len(hooks))).alias("h"), F.col(c).alias("id"))
        near = symmetric(left).groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.min(least("v")).alias("low"))
        hook = materialise(near.select(F.col("u").alias("id"), "deg", F.least("low", least("u"))["id"].alias("rep")))
        moved = with_ends(left, hook.select("id", "rep"), hubs(hook))
        after = materialise(canonical(moved.select("rep_u", "rep_v"), "rep_u", "rep_v"))
        discard(left)
        left = after
        hooks.append(hook.select("id", "rep"))
    kind = e.schema["u"].dataType.simpleString()
    label = A.in_one_task(left, lambda u, v: (list(A.components(u, v)), ["id", "component"]), f"id {kind}, component {kind}")
    if not hooks:
        return materialise(label)
    for hook in reversed(hooks):
        up = skew_join(hook, label.select(F.col("id").alias("rep"), "component"), ["rep"], F.col("id"), "left")
        label = materialise(up.select("id", F.coalesce("component", "rep").alias("component")))
    names = label.groupBy("component").agg(F.min("id").alias("name"))
    return materialise(skew_join(label, names, ["component"], F.col("id")).select("id", F.col("name").alias("component")))


def strong_components(arcs: DataFrame, edges: int = 2 * A.EDGES) -> DataFrame:
    """``id, part``: the strongly connected parts of arcs ``a, b``, by their
    least vertex; parts of one vertex may be missing.

    While there are more than ``edges`` arcs, vertices that nothing leads to, or
    that lead nowhere, go. When those are few, the greatest vertex that reaches
    it becomes the colour of each vertex; what reaches the vertex that gave the
    colour within it is one part. The rest is finished in one task. Colours go
    one arc a round, so long ways take long.
    """
    left, found = materialise(arcs.where("a <> b").select("a", "b").distinct()), []
    n = left.count()
    while n > edges:
        inner = materialise(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        discard(left)
        left, before = inner, n
        n = left.count()
        if not n or n < 0.9 * before:
            continue
        colour = held = materialise(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("colour")))
        while True:
            most = left.join(colour.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.max("colour").alias("most"))
            after = materialise(colour.join(most, "id", "left").select("id", F.greatest("colour", "most").alias("colour"), (F.col("most") > F.col("colour")).alias("new")))
            discard(held)
            colour, held = after.select("id", "colour"), after
            if after.where("new").isEmpty():
                break
        ends = {c: colour.select(F.col("id").alias(c), F.col("colour").alias(f"colour_{c}")) for c in "ab"}
        own = materialise(left.join(ends["a"], "a").join(ends["b"], "b").where("colour_a = colour_b").select("a", "b"))
        new = reached = materialise(colour.where("id = colour").select("id"))
        while not new.isEmpty():
            near = own.join(new.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
            new = materialise(near.join(reached, "id", "left_anti"))
            reached = reached.unionByName(new)
        whole = colour.join(reached, "id", "left_semi")
        found.append(materialise(whole.join(whole.groupBy("colour").agg(F.min("id").alias("part")), "colour").select("id", "part")))
        gone = found[-1].select("id")
        after = materialise(own.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
        discard(left, own, held)
        left, n = after, after.count()
    rest = A.in_one_task(left, lambda a, b: ([pa.array(x) for x in A.strong(a.to_numpy(), b.to_numpy())], ["id", "part"]), "id bigint, part bigint")
    return reduce(DataFrame.unionByName, found, rest)


def path_cycle_optimum(e: DataFrame) -> DataFrame:
    """``component, n_vertices, n_edges, optimum`` of a graph of degree at most
    two: half the vertices of a path, of a cycle rounded up. Components with a
    vertex of higher degree are left out."""
    c = components(e)
    per = degrees(e).join(c, "id").groupBy("component").agg(F.count(F.lit(1)).alias("n_vertices"), (F.sum("deg") / 2).cast("bigint").alias("n_edges"), F.max("deg").alias("most"))
    return per.where("most <= 2").select("component", "n_vertices", "n_edges", F.expr("(n_vertices + CASE WHEN n_edges = n_vertices THEN 1 ELSE 0 END) div 2").alias("optimum"))


def reached(e: DataFrame, ids: DataFrame) -> DataFrame:
    """``id`` of all vertices in the components of ``ids(id)``."""
    c = components(e)
    own = c.join(ids.select("id"), "id", "left_semi").select("component").distinct()
    return c.join(own, "component", "left_semi").select("id")


def uncovered(e: DataFrame, cover: DataFrame) -> DataFrame:
    """Edges with no end in ``cover(id)``."""
    return delete_vertices(e, cover)


def losses(e: DataFrame, cover: DataFrame) -> DataFrame:
    """``id, loss`` of cover vertices: edges that only this vertex covers."""
    own = symmetric(e).join(cover.select(F.col("id").alias("u")), "u", "left_semi")
    alone = own.join(cover.select(F.col("id").alias("v")), "v", "left_anti").groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("loss"))
    return cover.select("id").join(alone, "id", "left").select("id", F.coalesce("loss", F.lit(0)).alias("loss"))


def double_cover(e: DataFrame) -> DataFrame:
    """Edges ``l, r`` of the bipartite double cover."""
    return symmetric(e).select(F.col("u").alias("l"), F.col("v").alias("r"))


def consistency(e: DataFrame) -> DataFrame:
    """Edges that break the data model: ``u, v, problem``."""
    dup = e.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))
    problem = F.when(F.col("u").isNull() | F.col("v").isNull(), "null").when(F.col("u") == F.col("v"), "loop").when(F.col("u") > F.col("v"), "order").when(F.col("c") > 1, "repeated")
    return dup.withColumn("problem", problem).where("problem IS NOT NULL").select("u", "v", "problem")
