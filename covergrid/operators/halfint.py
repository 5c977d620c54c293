"""Matchings and half-integral covers of whole graphs.

The bipartite double cover has a left and a right copy of each vertex. A maximum
matching of it gives a cover in halves: a vertex of value one is in some
smallest cover, of value zero in none with it. Components of at most
``arrays.EDGES`` edges are matched in one task, many of them together; larger
ones lose their leaves by joins and, if they are still as large, are matched by
layered joins.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergrid.operators import arrays as A
from covergrid.operators import graph as G
from covergrid.session import discard, materialise

#: Edges of a component that one task may hold.
KERNEL_EDGES = 500_000


def _with_component(e: DataFrame) -> DataFrame:
    return materialise(e.join(G.components(e).withColumnRenamed("id", "u"), "u"))


def split_by_size(e: DataFrame, kernel_edges: int) -> tuple[DataFrame, DataFrame]:
    """``u, v, component``: of small and of large components."""
    c = _with_component(e)
    large = c.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > kernel_edges).select("component")
    return c.join(large, "component", "left_anti"), materialise(c.join(large, "component", "left_semi")).select("u", "v", "component")


def matching(e: DataFrame, edges: int = A.EDGES) -> DataFrame:
    """A maximal matching ``u, v`` by rounds: an edge enters if its hash is the
    least at both ends. Its size is a lower bound, its ends a cover of at most
    twice the optimum. At most ``edges`` edges are finished in one task, by the
    same rule."""
    left, out, hot = materialise(e.select("u", "v")), [], None
    while left.count() > edges:  # the least hash of all always enters
        hot = G.hubs_of(left) if hot is None else hot
        key = left.withColumn("h", F.struct(F.xxhash64("u", "v"), "u", "v"))
        low = key.select(F.explode(F.array("u", "v")).alias("id"), "h").groupBy("id").agg(F.min("h").alias("low"))
        won = materialise(G.with_ends(key, low, hot).where("h = low_u AND h = low_v").select("u", "v"))
        out.append(won)
        after = materialise(G.delete_vertices(left, G.vertices(won)))
        discard(left)
        left = after
    rest = A.in_one_task(left, lambda u, v: ([x.filter(pa.array(A.matching(u.to_numpy(), v.to_numpy()))) for x in (u, v)], ["u", "v"]), "u bigint, v bigint")
    return reduce(DataFrame.unionByName, out, rest)


def _without_leaves(s: DataFrame, edges: int) -> tuple[DataFrame, list[DataFrame]]:
    """A bipartite graph ``l, r`` without what its leaves decide, and the edges
    at leaves of a maximum matching: any leaf may take its only neighbour. It
    goes on while there are more than ``edges`` edges and a tenth goes a round;
    a long path would go on for long."""
    sure, n, before = [], s.count(), None
    while n > edges and (before is None or n < 0.9 * before):
        for own, other in (("l", "r"), ("r", "l")):
            leaf = s.groupBy(own).agg(F.min(other).alias(other), F.count(F.lit(1)).alias("n")).where("n = 1")
            won = materialise(leaf.groupBy(other).agg(F.min(own).alias(own)).select("l", "r"))
            after = materialise(s.join(won.select("l"), "l", "left_anti").join(won.select("r"), "r", "left_anti").select("l", "r"))
            discard(s)
            s = after
            sure.append(won)
        before, n = n, s.count()
    return s, sure


def maximum_double_matching(e: DataFrame, edges: int = A.EDGES) -> DataFrame:
    """``l, r``: a maximum matching of the bipartite double cover. A graph of
    more than ``edges`` edges loses its leaves first; what is left then is
    finished in one task, or by joins if it has more edges still."""
    s, sure = _without_leaves(materialise(G.double_cover(e)), 2 * edges)
    if s.count() <= 2 * edges:
        rest = materialise(A.in_one_task(s, lambda l, r: ([pa.array(x) for x in A.double_matching(l.to_numpy(), r.to_numpy())], ["l", "r"]), "l bigint, r bigint"))
    else:
        rest = _phases(s)
    return reduce(DataFrame.unionByName, sure, rest)


def _phases(s: DataFrame) -> DataFrame:
    """A maximum matching of a bipartite graph ``l, r``, by joins.

    Each phase grows a forest of alternating paths by layers from all free left
    vertices; a right vertex belongs to the first layer and there to one parent
    (by hash), so the trees are disjoint, and each tree that meets a free right
    vertex is augmented once. A phase that finds none has seen all that free
    vertices reach, so the matching is maximum.
    """
    mate = materialise(s.limit(0))
    phase = 0
    while True:
        layer = s.select("l").distinct().join(mate, "l", "left_anti").select("l", F.col("l").alias("root"))
        back = mate.select("r", F.col("l").alias("next"))
        seen = ends = None
        while True:
            reach = s.join(layer, "l")
            if seen is not None:
                reach = reach.join(seen.select("r"), "r", "left_anti")
            parent = F.min(F.struct(F.xxhash64("l", "r", F.lit(phase)).alias("h"), "l", "root")).alias("p")
            new = materialise(reach.groupBy("r").agg(parent).select("r", "p.l", "p.root").join(back, "r", "left"))
            if new.isEmpty():
                break
            seen = new if seen is None else seen.unionByName(new)
            won = new.where("next IS NULL").groupBy("root").agg(F.min("r").alias("r"))
            ends = won if ends is None else ends.unionByName(won)
            # a tree that has met a free vertex grows no further
            layer = new.where("next IS NOT NULL").join(won.select("root"), "root", "left_anti").select(F.col("next").alias("l"), "root")
        if ends is None or ends.isEmpty():
            return mate
        at = ends.select("r")
        steps, flipped = seen.select("r", "l"), None
        while True:
            step = materialise(at.join(steps, "r").select("l", "r"))
            if step.isEmpty():
                break
            flipped = step if flipped is None else flipped.unionByName(step)
            at = step.select("l").join(mate, "l").select("r")
        mate = materialise(mate.join(flipped.select("l"), "l", "left_anti").unionByName(flipped))
        phase += 1


def in_groups(small: DataFrame, edges: int = KERNEL_EDGES) -> DataFrame:
    """Components with a column ``task`` that brings many small ones together,
    about as many edges as a kernel may hold."""
    n = small.count() // max(edges, 1) + 1
    return small.withColumn("task", F.pmod(F.xxhash64("component"), F.lit(n * 8)).cast("int"))


def half_integral(e: DataFrame, kernel_edges: int = A.EDGES) -> DataFrame:
    """``id, twice``: twice the value (0, 1 or 2) of each vertex in the smallest
    cover in halves that alternating paths from the free left vertices give."""
    small, large = split_by_size(e, kernel_edges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, twice = A.halves(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        return pd.DataFrame({"id": ids, "twice": twice})

    out = in_groups(small).groupBy("task").applyInPandas(run, "id bigint, twice int")
    return out if large.isEmpty() else out.unionByName(_by_joins(large.select("u", "v")))


def _by_joins(e: DataFrame) -> DataFrame:
    s = materialise(G.symmetric(e).select(F.col("u").alias("l"), F.col("v").alias("r")))
    mate = maximum_double_matching(e)
    layer = materialise(s.select("l").distinct().join(mate, "l", "left_anti"))
    left, right = layer, None
    while not layer.isEmpty():
        new = s.join(layer, "l", "left_semi").select("r").distinct()
        new = materialise(new if right is None else new.join(right, "r", "left_anti"))
        right = new if right is None else right.unionByName(new)
        layer = materialise(mate.join(new, "r", "left_semi").select("l").join(left, "l", "left_anti"))
        left = left.unionByName(layer)
    if right is None:
        return s.select(F.col("l").alias("id"), F.lit(1).alias("twice")).distinct()
    every = s.select(F.col("l").alias("id")).distinct()
    flagged = every.join(left.select(F.col("l").alias("id"), F.lit(True).alias("in_l")), "id", "left").join(right.select(F.col("r").alias("id"), F.lit(True).alias("in_r")), "id", "left")
    return flagged.select("id", F.when(F.col("in_r") & F.col("in_l").isNull(), 2).when(F.col("in_l") & F.col("in_r").isNull(), 0).otherwise(1).alias("twice"))
