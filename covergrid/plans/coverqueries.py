"""Queries of the graph operators and of the result pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergrid.operators import graph as G
from covergrid.operators import halfint as H
from covergrid.operators import kernels as K
from covergrid.operators import resultcsv as C
from covergrid.operators import rules as R
from covergrid.operators import solve as S
from covergrid.plans import graphs as P
from covergrid.plans.graphs import sql
from covergrid.session import materialise, table
from covergrid.sources import edges as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql_text: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql_text is not None:
            SQL[name or f.__name__] = sql_text
        return f

    return add


def _top(e: DataFrame, least: int) -> DataFrame:
    """Vertices of at least that degree."""
    return G.degrees(e).where(F.col("deg") >= least).select("id")


# --- building and counting ---------------------------------------------------


@query(sql("bg") + "SELECT u, v FROM e")
def edges_canonical(spark, d):
    return P.bg(spark, d)


@query(f"SELECT count(*) AS n_records, count(*) FILTER (a IS NULL OR b IS NULL) AS n_rejected, count(*) FILTER (a = b) AS n_loops FROM ({P.BG_RAW})")
def edges_raw_count(spark, d):
    r = P.bg_raw(spark, d)
    return r.agg(F.count(F.lit(1)).alias("n_records"), F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("n_rejected"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("n_loops"))


@query(f"SELECT DISTINCT a AS id FROM ({P.BG_RAW}) WHERE a = b")
def forced_by_loops(spark, d):
    return G.loops(P.bg_raw(spark, d), "a", "b")


@query(sql("sp") + "SELECT u, v FROM s")
def edges_symmetric(spark, d):
    return G.symmetric(P.sp(spark, d))


@query(
    """WITH c AS (SELECT file, vertex0 AS name, edge_id AS o, 0 AS p FROM bucketgraph WHERE vertex0 IS NOT NULL UNION ALL SELECT file, vertex1, edge_id, 1 FROM bucketgraph WHERE vertex1 IS NOT NULL),
f AS (SELECT file, name, min(o * 2 + p) AS place FROM c GROUP BY file, name) SELECT file, name, row_number() OVER (ORDER BY place, file, name) - 1 AS id FROM f"""
)
def vertex_dictionary(spark, d):
    return G.dictionary(table(spark, d, "bucketgraph"), "edge_id", ["vertex0", "vertex1"], ["file"])


@query(sql("bg") + "SELECT id, deg FROM d")
def degree(spark, d):
    return G.degrees(P.bg(spark, d))


@query(sql("sp") + "SELECT deg, count(*) AS n FROM d GROUP BY deg")
def degree_histogram(spark, d):
    return G.histogram(P.sp(spark, d))


@query(sql("bg") + "SELECT id, deg FROM d ORDER BY deg DESC, id LIMIT 20")
def degree_topk(spark, d):
    return G.top_degrees(P.bg(spark, d), 20)


@query(sql("bg") + "SELECT id, deg FROM d ORDER BY deg DESC, id LIMIT 1")
def max_degree_vertex(spark, d):
    return G.max_degree_vertex(P.bg(spark, d))


@query(sql("co") + "SELECT id, deg FROM d WHERE id IN (SELECT id FROM d WHERE deg <= 3) ORDER BY deg DESC, id LIMIT 1")
def max_degree_vertex_among(spark, d):
    e = P.co(spark, d)
    return G.max_degree_vertex(e, G.degrees(e).where("deg <= 3").select("id"))


@query(sql("sp") + "SELECT id, deg FROM d ORDER BY deg, id LIMIT 1")
def min_degree_vertex(spark, d):
    return G.min_degree_vertex(P.sp(spark, d))


@query(
    sql("co", "t AS (SELECT id, deg FROM d WHERE deg = (SELECT max(deg) FROM d))")
    + "SELECT t.id, t.deg, CAST(sum(d.deg) AS BIGINT) AS nbsum FROM t JOIN s ON s.u = t.id JOIN d ON d.id = s.v GROUP BY t.id, t.deg ORDER BY nbsum, t.id LIMIT 1"
)
def max_degree_min_nbsum(spark, d):
    return G.max_degree_min_neighbour_sum(P.co(spark, d))


@query(sql("sp") + "SELECT count(*) AS n_vertices, CAST(sum(deg) / 2 AS BIGINT) AS n_edges, max(deg) AS max_deg, CAST(sum(deg) AS BIGINT) AS sum_deg FROM d")
def graph_counts(spark, d):
    return G.counts(P.sp(spark, d))


@query(sql("bg") + "SELECT count(*) AS n FROM d")
def connected_vertex_count(spark, d):
    return G.vertices(P.bg(spark, d)).agg(F.count(F.lit(1)).alias("n"))


def _as_chosen(e: DataFrame, pick: DataFrame) -> DataFrame:
    """``chosen, valid``: how many vertices were chosen, and whether each has
    the degree it was chosen with."""
    true = pick.join(G.degrees(e).withColumnRenamed("deg", "really"), "id", "left")
    return true.agg(F.count(F.lit(1)).alias("chosen"), F.min(F.col("deg").eqNullSafe(F.col("really"))).alias("valid"), F.max("deg").alias("deg"))


@query(sql("sp") + "SELECT CAST(1 AS BIGINT) AS chosen, true AS valid")
def random_vertex(spark, d):
    e = materialise(P.sp(spark, d))
    return _as_chosen(e, G.random_vertex(e, seed=11)).drop("deg")


@query(sql("sp") + "SELECT CAST(1 AS BIGINT) AS chosen, true AS valid, max(deg) AS deg FROM d")
def random_max_degree_vertex(spark, d):
    e = materialise(P.sp(spark, d))
    return _as_chosen(e, G.random_vertex(e, seed=11, top_bucket=True))


@query(sql("sp") + "SELECT min(id) AS id FROM d")
def first_connected_vertex(spark, d):
    return G.first_connected(P.sp(spark, d))


# --- lookups -----------------------------------------------------------------

_DEG3 = "(SELECT id FROM d WHERE deg = 3)"


@query(sql("sp") + "SELECT u AS id, v AS nb FROM s WHERE u IN (SELECT id FROM d ORDER BY deg DESC, id LIMIT 5)")
def neighbours_of(spark, d):
    e = P.sp(spark, d)
    return G.neighbours(e, G.top_degrees(e, 5))


@query(sql("co", "r AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY v) AS k FROM s)") + "SELECT d.id, coalesce(max(r.v), -1) AS nb FROM d LEFT JOIN r ON r.u = d.id AND r.k = 3 GROUP BY d.id")
def nth_neighbour(spark, d):
    return G.nth_neighbour(P.co(spark, d), 2)


@query(sql("sp", "r AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY v) AS k FROM s)") + "SELECT u AS id, max(v) FILTER (k = 1) AS nb1, max(v) FILTER (k = 2) AS nb2 FROM r WHERE k <= 2 GROUP BY u")
def first_two_neighbours(spark, d):
    return G.first_two_neighbours(P.sp(spark, d))


@query(sql("co") + f"SELECT DISTINCT v AS id FROM s WHERE u IN {_DEG3} AND v NOT IN {_DEG3}")
def set_neighbourhood(spark, d):
    e = P.co(spark, d)
    return G.set_neighbourhood(e, G.of_degree(e, 3))


@query(sql("co", "a AS (SELECT DISTINCT u AS a, v + 1 AS b FROM e UNION SELECT v, u FROM e)") + "SELECT a, b, e.u IS NOT NULL AS present FROM a LEFT JOIN e ON e.u = least(a, b) AND e.v = greatest(a, b)")
def edge_exists(spark, d):
    e = P.co(spark, d)
    return G.edges_exist(e, e.selectExpr("u AS a", "v + 1 AS b").union(e.selectExpr("v", "u")).distinct())


@query(sql("co") + "SELECT id FROM d WHERE deg = 2")
def vertices_of_degree(spark, d):
    return G.of_degree(P.co(spark, d), 2)


@query(sql("co") + "SELECT u, v FROM e ORDER BY u, v LIMIT 1")
def first_valid_edge(spark, d):
    return G.first_edge(P.co(spark, d))


@query(sql("co") + "SELECT id FROM d WHERE deg = 4 ORDER BY id LIMIT 1")
def first_vertex_of_degree(spark, d):
    return G.first_of_degree(P.co(spark, d), 4)


@query(sql("spq") + "SELECT id, deg FROM d")
def vertices_by_degree(spark, d):
    return G.sorted_by_degree(P.spq(spark, d))


@query("SELECT CAST(n_nationkey AS BIGINT) * 2 + 1 AS id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def cover_names(spark, d):
    """Names of a cover of the star graph."""
    names = table(spark, d, "nation").select((F.col("n_nationkey").cast("bigint") * 2 + 1).alias("id"), F.col("n_name").alias("name"))
    return G.names_of(R.r1_batch(P.star(spark, d)), names)


# --- mutations ---------------------------------------------------------------

_S4 = "(SELECT id FROM d WHERE deg >= 4)"


@query(sql("co") + "SELECT id FROM d WHERE deg >= 4")
def inactive_vertices(spark, d):
    e = materialise(P.co(spark, d))
    return G.inactive(G.vertices(e), G.degrees(e).where("deg < 4").select("id"))


@query(sql("co") + "SELECT u, v FROM e WHERE u NOT IN (SELECT id FROM d WHERE deg >= 5) AND v NOT IN (SELECT id FROM d WHERE deg >= 5)")
def reactivated_edges(spark, d):
    """Vertices of degree four and more go, those of degree four come back."""
    e = materialise(P.co(spark, d))
    return G.reactivate(e, _top(e, 4), G.of_degree(e, 4))[0]


@query(sql("co") + f"SELECT 'cut' AS graph, count(*) = 0 AS finished FROM e WHERE u NOT IN {_S4} AND v NOT IN {_S4} UNION ALL SELECT 'all', true UNION ALL SELECT 'none', count(*) = 0 FROM e")
def graph_finished(spark, d):
    e = materialise(P.co(spark, d))
    states = {"none": e, "cut": G.delete_vertices(e, _top(e, 4)), "all": G.delete_vertices(e, G.vertices(e))}
    return reduce(DataFrame.unionByName, [G.finished(x).select(F.lit(k).alias("graph"), "finished") for k, x in states.items()])


@query("SELECT vertex0 || ' ' || vertex1 AS line FROM bucketgraph WHERE vertex0 IS NOT NULL AND vertex1 IS NOT NULL")
def original_edges(spark, d):
    return X.original_edges(table(spark, d, "bucketgraph"))


@query(sql("co") + f"SELECT u, v FROM e WHERE u NOT IN {_S4} AND v NOT IN {_S4}")
def delete_vertices(spark, d):
    e = P.co(spark, d)
    return G.delete_vertices(e, _top(e, 4))


@query(sql("co") + f"SELECT u, v FROM e WHERE u IN {_S4} AND v IN {_S4}")
def active_edges(spark, d):
    e = P.co(spark, d)
    return G.induced(e, _top(e, 4))


@query(
    sql("bg", "on_ AS (SELECT id FROM d WHERE deg >= 2)")
    + f"SELECT least(a, b) AS u, greatest(a, b) AS v FROM ({P.BG_RAW}) WHERE a <> b AND a IN (SELECT id FROM on_) AND b IN (SELECT id FROM on_)"
)
def preprocessed_edge_pairs(spark, d):
    """Raw records with both ends active, repeats kept."""
    raw = P.bg_raw(spark, d).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return G.induced(raw, _top(P.bg(spark, d), 2))


@query(sql("spq") + f"SELECT id FROM d WHERE deg < 4 AND id NOT IN (SELECT u FROM s WHERE u NOT IN {_S4} AND v NOT IN {_S4})")
def isolated_after_delete(spark, d):
    e = P.spq(spark, d)
    return G.isolated_after(e, _top(e, 4))


@query(sql("coq", "m AS (SELECT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT u AS a, v + 1 AS b FROM e) WHERE a <> b)") + "SELECT u, v FROM e UNION SELECT u, v FROM m")
def add_edges(spark, d):
    e = P.coq(spark, d)
    return G.add_edges(e, e.selectExpr("u", "v + 1 AS v"))


@query(sql("coq", "m AS (SELECT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT u AS a, v + 1 AS b FROM e))") + "SELECT u, v FROM e EXCEPT SELECT u, v FROM m")
def remove_edges(spark, d):
    e = P.coq(spark, d)
    return G.remove_edges(e, e.selectExpr("u", "v + 1 AS v"))


# --- rules -------------------------------------------------------------------

_R1 = "p AS (SELECT DISTINCT CASE WHEN dv.deg = 1 THEN least(s.u, s.v) ELSE s.v END AS id FROM s JOIN d du ON du.id = s.u JOIN d dv ON dv.id = s.v WHERE du.deg = 1)"


@query(sql("spq") + "SELECT id FROM d WHERE deg = 1")
def leaves(spark, d):
    return R.leaves(P.spq(spark, d))


@query(sql("spq", _R1) + "SELECT id FROM p")
def r1_batch(spark, d):
    return R.r1_batch(P.spq(spark, d))


@query(sql("spq", _R1) + "SELECT u, v FROM e WHERE u NOT IN (SELECT id FROM p) AND v NOT IN (SELECT id FROM p)")
def r1_remaining_edges(spark, d):
    return R.apply_r1(P.spq(spark, d))[0]


_DEG2 = (
    "c0 AS (SELECT u AS v, min(v) AS a, max(v) AS b FROM s WHERE u IN (SELECT id FROM d WHERE deg = 2) GROUP BY u), "
    "c AS (SELECT c0.v, a, b, e.u IS NOT NULL AS triangle FROM c0 LEFT JOIN e ON e.u = a AND e.v = b)"
)
_SEL2 = _DEG2 + (
    ", cl AS (SELECT v, v AS x FROM c UNION ALL SELECT v, a FROM c UNION ALL SELECT v, b FROM c), f AS (SELECT x, min(v) AS w FROM cl GROUP BY x), "
    "sel AS (SELECT * FROM c WHERE v NOT IN (SELECT cl.v FROM cl JOIN f ON f.x = cl.x WHERE cl.v <> f.w))"
)


@query(sql("co", _DEG2) + "SELECT v, a, b FROM c WHERE triangle")
def deg2_triangle(spark, d):
    return R.deg2(P.co(spark, d)).where("triangle").select("v", "a", "b")


@query(sql("co", _DEG2) + "SELECT v, a, b FROM c WHERE NOT triangle")
def deg2_fold_candidates(spark, d):
    return R.deg2(P.co(spark, d)).where("NOT triangle").select("v", "a", "b")


@query(sql("co", _SEL2) + "SELECT v, a, b, triangle FROM sel")
def r2_selected(spark, d):
    return R.r2_selected(P.co(spark, d))


@query(
    sql(
        "co",
        _SEL2
        + ", gone AS (SELECT v AS x FROM sel WHERE triangle UNION SELECT a FROM sel WHERE triangle UNION SELECT b FROM sel WHERE triangle), "
        "map AS (SELECT a AS x, v AS r FROM sel WHERE NOT triangle UNION ALL SELECT b, v FROM sel WHERE NOT triangle), "
        "k AS (SELECT coalesce(m.r, e.u) AS a, coalesce(n.r, e.v) AS b FROM e LEFT JOIN map m ON m.x = e.u LEFT JOIN map n ON n.x = e.v WHERE e.u NOT IN (SELECT x FROM gone) AND e.v NOT IN (SELECT x FROM gone))",
    )
    + "SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM k WHERE a <> b"
)
def fold_vertices(spark, d):
    return R.apply_r2(P.co(spark, d))[0]


@query(sql("sp") + "SELECT id FROM d WHERE deg > 30")
def r3_high_degree(spark, d):
    return R.r3_high_degree(P.sp(spark, d), 30)


@query(
    sql("coq", "c AS (SELECT count(*) AS n_vertices, CAST(sum(deg) / 2 AS BIGINT) AS n_edges, max(deg) AS max_deg FROM d)")
    + "SELECT *, max_deg <= 20 AND (n_vertices > 420 OR n_edges > 400) AS excluded FROM c"
)
def r4_buss(spark, d):
    return R.r4_buss(P.coq(spark, d), 20)


@query(sql("co") + "SELECT e.u, e.v, count(*) AS common FROM e JOIN s a ON a.u = e.u JOIN s b ON b.u = e.v AND b.v = a.v GROUP BY e.u, e.v")
def common_neighbours(spark, d):
    return G.common_neighbours(P.co(spark, d))


@query(sql("ss") + "SELECT e.u, e.v, count(*) AS common FROM e JOIN s a ON a.u = e.u JOIN s b ON b.u = e.v AND b.v = a.v GROUP BY e.u, e.v")
def common_neighbours_dense(spark, d):
    return G.common_neighbours(P.ss(spark, d))


_DOM = "cn AS (SELECT e.u, e.v, count(*) AS c FROM e JOIN s a ON a.u = e.u JOIN s b ON b.u = e.v AND b.v = a.v GROUP BY e.u, e.v), dm AS (SELECT s.u, s.v FROM s JOIN d ON d.id = s.v LEFT JOIN cn ON cn.u = least(s.u, s.v) AND cn.v = greatest(s.u, s.v) WHERE coalesce(cn.c, 0) = d.deg - 1)"


@query(sql("co", _DOM) + "SELECT u, v FROM dm")
def dominators(spark, d):
    return R.dominators(P.co(spark, d))


@query(sql("co", _DOM) + "SELECT DISTINCT a.u AS id FROM dm a LEFT JOIN dm b ON b.u = a.v AND b.v = a.u WHERE b.u IS NULL OR a.u > a.v")
def r5_domination_batch(spark, d):
    return R.r5_batch(P.co(spark, d))


_NEAR3 = (
    "n3 AS (SELECT u AS v, list_sort(list(v)) AS n FROM s WHERE u IN (SELECT id FROM d WHERE deg = 3) GROUP BY u), "
    "x3 AS (SELECT n3.v, n[1] AS a, n[2] AS b, n[3] AS c, p.u IS NOT NULL AS ab, q.u IS NOT NULL AS ac, r.u IS NOT NULL AS bc FROM n3 "
    "LEFT JOIN e p ON p.u = n[1] AND p.v = n[2] LEFT JOIN e q ON q.u = n[1] AND q.v = n[3] LEFT JOIN e r ON r.u = n[2] AND r.v = n[3]), "
    "k3 AS (SELECT v, CAST(ab AS INT) + CAST(ac AS INT) + CAST(bc AS INT) AS k, * EXCLUDE (v) FROM x3), "
    "c3 AS (SELECT v, 'independent' AS kind, a, b, c FROM k3 WHERE k = 0 UNION ALL "
    "SELECT v, 'edge', CASE WHEN bc THEN b ELSE a END, CASE WHEN ab THEN b ELSE c END, CASE WHEN ab THEN c WHEN ac THEN b ELSE a END FROM k3 WHERE k = 1 UNION ALL "
    "SELECT v, 'path', CASE WHEN NOT bc THEN b ELSE a END, CASE WHEN NOT ab THEN b ELSE c END, CASE WHEN NOT ab THEN c WHEN NOT ac THEN b ELSE a END FROM k3 WHERE k = 2 UNION ALL "
    "SELECT v, 'triangle', a, b, c FROM k3 WHERE k = 3)"
)


def _deg3(kind: str):
    def run(spark, d):
        return R.deg3_cases(P.co(spark, d)).where(F.col("kind") == kind).select("v", "a", "b", "c")

    return run


for _kind in ("independent", "edge", "triangle", "path"):
    query(sql("co", _NEAR3) + f"SELECT v, a, b, c FROM c3 WHERE kind = '{_kind}'", f"deg3_{_kind}")(_deg3(_kind))

_NEAR4 = (
    "n4 AS (SELECT u AS c, v FROM s WHERE u IN (SELECT id FROM d WHERE deg = 4)), "
    "i4 AS (SELECT a.c, a.v, count(x.u) AS k FROM n4 a JOIN n4 b ON b.c = a.c AND b.v <> a.v LEFT JOIN s x ON x.u = a.v AND x.v = b.v GROUP BY a.c, a.v), "
    "p4 AS (SELECT c AS v, CAST(sum(k) / 2 AS INT) AS n_inner, CAST(max(k) AS INT) AS max_inner, min(k) AS min_inner FROM i4 GROUP BY c)"
)


@query(sql("co", _NEAR4) + "SELECT n_inner, max_inner, count(*) AS n FROM p4 GROUP BY n_inner, max_inner")
def deg4_pattern_counts(spark, d):
    return R.deg4_patterns(P.co(spark, d)).groupBy("n_inner", "max_inner").agg(F.count(F.lit(1)).alias("n"))


@query(sql("ss", _NEAR4) + "SELECT v, CASE WHEN n_inner = 3 THEN 'triangle' ELSE 'cycle' END AS kind FROM p4 WHERE (n_inner = 3 AND min_inner = 0 AND max_inner = 2) OR (n_inner = 4 AND max_inner = 2)")
def deg4_two_cliques(spark, d):
    return R.deg4_clique_cases(P.ss(spark, d))


@query(sql("co", _NEAR4) + "SELECT v, CASE WHEN n_inner = 3 THEN 'triangle' ELSE 'cycle' END AS kind FROM p4 WHERE (n_inner = 3 AND min_inner = 0 AND max_inner = 2) OR (n_inner = 4 AND max_inner = 2)")
def deg4_two_cliques_co(spark, d):
    return R.deg4_clique_cases(P.co(spark, d))


@query(sql("co", _NEAR4) + "SELECT c AS v, v AS u FROM i4 WHERE k = 3")
def r12_dominators(spark, d):
    return R.r12_dominators(P.co(spark, d))


_FAR = "SELECT {0}.v AS c, {0}.{1} AS x, s.v AS y FROM c3 {0} JOIN s ON s.u = {0}.{2} WHERE {0}.kind = '{3}' AND s.v <> {0}.v AND s.v <> {0}.{1}"


@query(
    sql("co", _NEAR3 + ", ad AS (SELECT v AS c, a AS x, b AS y FROM c3 WHERE kind = 'independent' UNION ALL SELECT v, b, c FROM c3 WHERE kind = 'independent' UNION ALL " + " UNION ALL ".join(_FAR.format("z", p, q, "independent") for p, q in ("ab", "bc", "ca")) + ")")
    + "SELECT DISTINCT c, least(x, y) AS u, greatest(x, y) AS v FROM ad"
)
def r8_added_edges(spark, d):
    e = P.co(spark, d)
    return R.added_edges(e, R.deg3_cases(e).where("kind = 'independent'"))


@query(sql("co", _NEAR3 + ", ad AS (" + " UNION ALL ".join(_FAR.format("z", p, "c", "edge") for p in "ab") + ")") + "SELECT DISTINCT c, least(x, y) AS u, greatest(x, y) AS v FROM ad")
def r9_added_edges(spark, d):
    e = P.co(spark, d)
    return R.added_edges(e, R.deg3_cases(e).where("kind = 'edge'"))


@query(
    sql(
        "co",
        _NEAR3
        + ", q3 AS (SELECT * FROM c3 WHERE kind IN ('independent', 'edge')), nr AS (SELECT v, a AS x FROM q3 UNION ALL SELECT v, b FROM q3 UNION ALL SELECT v, c FROM q3), "
        f"lt AS (SELECT nr.v FROM nr JOIN d ON d.id = nr.x GROUP BY nr.v HAVING sum(d.deg) <= {R.BALL}), "
        "cl AS (SELECT v, x FROM nr WHERE v IN (SELECT v FROM lt) UNION SELECT nr.v, s.v FROM nr JOIN s ON s.u = nr.x WHERE nr.v IN (SELECT v FROM lt) UNION SELECT v, v FROM lt), "
        "f AS (SELECT x, min(v) AS w FROM cl GROUP BY x)",
    )
    + "SELECT v, kind, a, b, c FROM q3 WHERE v IN (SELECT v FROM lt) AND v NOT IN (SELECT cl.v FROM cl JOIN f ON f.x = cl.x WHERE cl.v <> f.w)"
)
def r8_r9_selected(spark, d):
    e = P.co(spark, d)
    return R.select_ball(e, R.deg3_cases(e).where("kind IN ('independent', 'edge')"))


# --- components, verification ------------------------------------------------

_COMP = "r(id, c) AS (SELECT id, id FROM d UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.id WHERE r.c < s.v), cc AS (SELECT id, min(c) AS component FROM r GROUP BY id)"


@query(sql("coq", _COMP, True) + "SELECT id, component FROM cc")
def components(spark, d):
    return G.components(P.coq(spark, d))


@query(sql("coq", _COMP, True) + "SELECT id FROM cc WHERE component IN (SELECT cc.component FROM cc JOIN d ON d.id = cc.id WHERE d.deg = 1)")
def component_reach(spark, d):
    e = P.coq(spark, d)
    return G.reached(e, G.of_degree(e, 1))


@query(sql("bg", _COMP, True) + "SELECT component, count(*) AS n FROM cc GROUP BY component")
def component_sizes(spark, d):
    return G.components(P.bg(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


_COVER = "cv AS (SELECT id FROM d WHERE deg >= 3)"


@query(sql("coq", _COVER) + "SELECT u, v FROM e WHERE u NOT IN (SELECT id FROM cv) AND v NOT IN (SELECT id FROM cv)")
def uncovered_edges(spark, d):
    e = P.coq(spark, d)
    return G.uncovered(e, _top(e, 3))


@query(
    sql("star", _R1 + ", bad AS (SELECT u FROM e WHERE u NOT IN (SELECT id FROM p) AND v NOT IN (SELECT id FROM p))")
    + "SELECT count(*) = 0 AS valid, CAST(count(*) AS INT) AS n_uncovered FROM bad"
)
def cover_valid(spark, d):
    """The rule of leaves covers the star graph."""
    e = P.star(spark, d)
    bad = G.uncovered(e, R.r1_batch(e))
    return bad.agg((F.count(F.lit(1)) == 0).alias("valid"), F.count(F.lit(1)).cast("int").alias("n_uncovered"))


_LOSS = _COVER + ", ls AS (SELECT cv.id, count(s.v) FILTER (s.v NOT IN (SELECT id FROM cv)) AS loss FROM cv JOIN s ON s.u = cv.id GROUP BY cv.id)"


@query(sql("coq", _LOSS) + "SELECT id, loss FROM ls")
def loss_init(spark, d):
    e = P.coq(spark, d)
    return G.losses(e, _top(e, 3))


@query(sql("coq", _LOSS) + "SELECT id, loss FROM ls ORDER BY loss, id LIMIT 1")
def min_loss_vertex(spark, d):
    e = P.coq(spark, d)
    return G.losses(e, _top(e, 3)).orderBy("loss", "id").limit(1)


@query(sql("spq") + "SELECT u AS l, v AS r FROM s")
def double_cover_edges(spark, d):
    return G.double_cover(P.spq(spark, d))


_BROKEN = "SELECT u, v FROM e UNION ALL SELECT v, u FROM e WHERE u % 7 = 0 UNION ALL SELECT u, v FROM e WHERE u % 5 = 0 UNION ALL SELECT u, u FROM e WHERE u % 3 = 0 UNION ALL SELECT NULL, v FROM e WHERE v % 11 = 0"


@query(
    sql("coq", f"x AS ({_BROKEN}), g AS (SELECT u, v, count(*) AS c FROM x GROUP BY u, v)")
    + "SELECT coalesce(u, -1) AS u, coalesce(v, -1) AS v, CASE WHEN u IS NULL OR v IS NULL THEN 'null' WHEN u = v THEN 'loop' WHEN u > v THEN 'order' ELSE 'repeated' END AS problem FROM g WHERE u IS NULL OR v IS NULL OR u >= v OR c > 1"
)
def structure_check(spark, d):
    """Of edges with reversed, repeated, looped and null ones among them."""
    e = materialise(P.coq(spark, d))
    parts = [e, e.where("u % 7 = 0").selectExpr("v AS u", "u AS v"), e.where("u % 5 = 0"), e.where("u % 3 = 0").selectExpr("u", "u AS v"), e.where("v % 11 = 0").selectExpr("CAST(NULL AS bigint) AS u", "v")]
    return G.consistency(reduce(DataFrame.unionByName, parts)).select(F.coalesce("u", F.lit(-1)).alias("u"), F.coalesce("v", F.lit(-1)).alias("v"), "problem")


@query(sql("sp") + "SELECT u, v, 'x' AS problem FROM e WHERE u >= v OR u IS NULL OR v IS NULL")
def structure_check_sp(spark, d):
    return G.consistency(P.sp(spark, d))


# --- reduction, bounds, covers -----------------------------------------------


# What a search gives can't be written as SQL, but what makes it right can: these
# queries give certificates. ``n_uncovered`` counts edges outside the cover,
# ``bounded`` says that the size lies between a lower bound and all vertices,
# ``balanced`` that undoing a reduction added what the log says.


def _n(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def _row(spark: SparkSession, **cells) -> DataFrame:
    kind = {bool: "boolean", int: "bigint", str: "string"}
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {kind[type(v)]}" for k, v in cells.items()))


def _covered(e: DataFrame, cover: DataFrame, **more) -> DataFrame:
    """Certificate of a cover: no better than a maximal matching allows."""
    cover = materialise(cover.select("id").distinct())
    size = _n(cover)
    return _row(e.sparkSession, n_edges=_n(e), n_uncovered=_n(G.uncovered(e, cover)), bounded=_n(S.matching(e)) <= size <= _n(G.vertices(e)), **more)


def _covered_sql(graph: str, more: str = "") -> str:
    return sql(graph) + f"SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_uncovered, true AS bounded{more} FROM e"


def _undone(e: DataFrame, k: R.Kernel, **more) -> DataFrame:
    """Certificate of a reduction: a cover of what is left, undone, covers all
    and grew by what the log says."""
    before = materialise(S.greedy_rounds(k.edges))
    after = materialise(k.undo(before))
    balanced = _n(after) == _n(before) + R.decrease(k.log()).first().dec
    return _row(e.sparkSession, n_edges=_n(e), n_uncovered=_n(G.uncovered(e, after)), balanced=balanced, **more)


_UNDONE = "SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_uncovered, true AS balanced"


@query(sql("spq") + _UNDONE + ", true AS settled FROM e")
def kernel_fixpoint_size(spark, d):
    """``settled``: no rule applies any more."""
    e = materialise(P.spq(spark, d))
    k = R.kernelize(e)
    settled = G.of_degree(k.edges, 1).isEmpty() and G.of_degree(k.edges, 2).isEmpty() and R.r5_batch(k.edges).isEmpty()
    return _undone(e, k, settled=settled)


@query(sql("star") + "SELECT DISTINCT CASE WHEN u % 2 = 1 THEN u ELSE v END AS id FROM e")
def cover_from_log(spark, d):
    """Cover vertices that the undo log decides without the graph."""
    return R.kernelize(P.star(spark, d)).decided()


@query(sql("coq") + _UNDONE + " FROM e")
def kernel_log(spark, d):
    e = materialise(P.coq(spark, d))
    return _undone(e, R.kernelize(e, ("R1", "R2", "R5", "R8_R9")))


@query(sql("star") + "SELECT 'R1' AS rule, CAST(1 AS BIGINT) AS rounds, count(DISTINCT c_nationkey) AS applied, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS decrease FROM customer")
def rule_counters(spark, d):
    return R.kernelize(P.star(spark, d)).counters()


@query("SELECT 'vc size' AS name, count(DISTINCT c_nationkey) AS value FROM customer UNION ALL SELECT 'proven', 1 UNION ALL SELECT 'recursive steps', 0")
def solve_statistics(spark, d):
    """The star graph is solved by rules alone, so the search takes no step."""
    return S.solve_exact(P.star(spark, d)).statistics()


_RULES = [r for r in R.RULES if r != "R8_R9"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r}', true, true)" for r in _RULES) + ") AS x(rule, covered, balanced)")
def rules_undone(spark, d):
    """One round of each rule on the graph of blocks, undone again."""
    e = materialise(P.blocks(spark, d))
    rows = None
    for r in _RULES:
        out, log = R.RULES[r](e, 3)
        k = R.Kernel(materialise(out), [materialise(log)], [r])
        own = _undone(e, k).select(F.lit(r).alias("rule"), (F.col("n_uncovered") == 0).alias("covered"), "balanced")
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query(sql("co") + _UNDONE + ", true AS feasible FROM e")
def preprocess_with_flags(spark, d):
    """All rules by name, with a budget of a cover that is known."""
    e = materialise(P.co(spark, d))
    k = R.kernelize(e, tuple(_RULES) + R.BUDGET, k=_n(S.greedy_rounds(e)))
    return _undone(e, k, feasible=k.feasible)


@query(sql("co") + _UNDONE + " FROM e")
def preprocess_before_solver(spark, d):
    e = materialise(P.co(spark, d))
    return _undone(e, R.kernelize(e, R.BEFORE_SOLVER))


@query(sql("spq") + _UNDONE + ", true AS feasible FROM e")
def preprocess_dynamic(spark, d):
    """The rules of every tenth depth; the budget is the number of vertices."""
    e = materialise(P.spq(spark, d))
    k = R.kernelize(e, R.dynamic(10), k=_n(G.vertices(e)))
    return _undone(e, k, feasible=k.feasible)


_R3 = "x0 AS (SELECT id FROM d WHERE deg > {k}), k1 AS (SELECT {k} - count(*) AS k FROM x0)"
_R3_STEP = (
    ", s{i} AS (SELECT u, v FROM {s} WHERE u NOT IN (SELECT id FROM {x}) AND v NOT IN (SELECT id FROM {x})), "
    "n{i} AS (SELECT u AS id FROM s{i} GROUP BY u HAVING count(*) > (SELECT k FROM k{i})), x{i} AS (SELECT id FROM {x} UNION ALL SELECT id FROM n{i}), k{j} AS (SELECT k - (SELECT count(*) FROM n{i}) AS k FROM k{i})"
)
#: Rounds of the SQL of r3_budget; its last finds nothing more at the driver's scales.
_R3_ROUNDS = 12


@query(sql("ss", _R3.format(k=60) + "".join(_R3_STEP.format(i=i, j=i + 1, s="s" if i == 1 else f"s{i - 1}", x=f"x{i - 1}") for i in range(1, _R3_ROUNDS))) + f"SELECT id FROM x{_R3_ROUNDS - 1}")
def r3_budget(spark, d):
    """Vertices that a cover of 60 must hold, the budget falling with each."""
    _, log, _ = R.apply_r3_budget(P.ss(spark, d), 60)
    return log.select(F.explode("other").alias("id"))


@query(sql("co", _DOM) + "SELECT DISTINCT u AS id FROM dm")
def r6_first_step(spark, d):
    """Unconfined vertices that a set of one shows: the dominating ones."""
    return R.unconfined(P.co(spark, d)).where("steps = 1").select("id")


@query(sql("co") + "SELECT true AS confirmed, true AS more")
def r6_unconfined(spark, d):
    """Whether the kernel calls the same vertices unconfined, and whether some
    need a set of more than one."""
    e = materialise(P.co(spark, d))
    found = materialise(R.unconfined(e))

    def check(pdf):
        g = K.build(zip(pdf["u"].tolist(), pdf["v"].tolist()))
        return pd.DataFrame({"id": [v for v in sorted(g) if K.is_unconfined(g, v)]}, dtype="int64")

    c = G.components(e).withColumnRenamed("id", "u")
    want = materialise(e.join(c, "u").groupBy("component").applyInPandas(check, "id bigint"))
    same = _n(found) == _n(want) == _n(found.join(want, "id"))
    return _row(spark, confirmed=same, more=not found.where("steps > 1").isEmpty())


@query(sql("star") + "SELECT DISTINCT u AS id, CASE WHEN deg = 1 THEN 1 WHEN u % 2 = 1 THEN 2 ELSE 0 END AS twice FROM (SELECT s.u, CASE WHEN s.u % 2 = 1 THEN a.deg ELSE b.deg END AS deg FROM s JOIN d a ON a.id = s.u JOIN d b ON b.id = s.v)")
def r7_values(spark, d):
    """Nations of several customers have value one, their customers zero."""
    return H.half_integral(P.star(spark, d))


@query(sql("co", _NEAR3) + "SELECT v, c AS u FROM c3 WHERE kind = 'path' UNION ALL SELECT v, unnest([a, b, c]) FROM c3 WHERE kind = 'triangle'")
def r10_dominators(spark, d):
    return R.r10_dominators(P.co(spark, d))


_NARROW = "SELECT DISTINCT p.u AS id FROM p JOIN d ON d.id = p.u WHERE d.deg > {0} OR p.u > p.v"


@query(sql("blocks", _NEAR3 + ", p AS (SELECT v, c AS u FROM c3 WHERE kind = 'path' UNION ALL SELECT v, unnest([a, b, c]) FROM c3 WHERE kind = 'triangle')") + _NARROW.format(3))
def r10_taken(spark, d):
    return R.apply_r10(P.blocks(spark, d))[1].select(F.explode("other").alias("id"))


@query(sql("co", _NEAR4 + ", p AS (SELECT c AS v, v AS u FROM i4 WHERE k = 3)") + _NARROW.format(4))
def r12_taken(spark, d):
    return R.apply_r12(P.co(spark, d))[1].select(F.explode("other").alias("id"))


@query(sql("blocks", _NEAR3) + "SELECT v, a, b, c FROM c3 WHERE kind = 'path'")
def deg3_path_blocks(spark, d):
    return R.deg3_cases(P.blocks(spark, d)).where("kind = 'path'").select("v", "a", "b", "c")


@query(sql("blocks", _NEAR4) + "SELECT v, CASE WHEN n_inner = 3 THEN 'triangle' ELSE 'cycle' END AS kind FROM p4 WHERE (n_inner = 3 AND min_inner = 0 AND max_inner = 2) OR (n_inner = 4 AND max_inner = 2)")
def deg4_two_cliques_blocks(spark, d):
    return R.deg4_clique_cases(P.blocks(spark, d))


@query(sql("blocks", _DEG2 + ", " + _R1) + "SELECT u, v FROM e WHERE u NOT IN (SELECT id FROM p) AND v NOT IN (SELECT id FROM p)")
def r1_remaining_edges_blocks(spark, d):
    return R.apply_r1(P.blocks(spark, d))[0]


query("SELECT 'lp' AS bound, count(DISTINCT c_nationkey) AS value FROM customer", "lp_bound_star")(lambda spark, d: S.bounds(P.star(spark, d)).where("bound = 'lp'"))


def _bounds(graph):
    def run(spark, d):
        e = materialise(graph(spark, d))
        size = S.solve_exact(e).size
        return S.bounds(e).select("bound", F.col("value").between(1, size).alias("below"))

    return run


query("SELECT * FROM (VALUES ('lp', true), ('clique', true), ('cycle', true)) AS x(bound, below)", "bounds_spq")(_bounds(P.spq))
query("SELECT * FROM (VALUES ('lp', true), ('clique', true), ('cycle', true)) AS x(bound, below)", "bounds_coq")(_bounds(P.coq))


def _matched(e: DataFrame) -> DataFrame:
    """A matching is maximum if a cover in halves has the same weight:
    ``n_broken`` edges have less than one at their ends, ``gap`` is between."""
    half = materialise(H.half_integral(e))
    broken = G.with_ends(e, half, G.hubs_of(e)).where("twice_u + twice_v < 2")
    matched = S.matching_double_cover(e).agg(F.coalesce(F.sum("matched"), F.lit(0))).first()[0]
    return _row(e.sparkSession, n_edges=_n(e), n_broken=_n(broken), gap=half.agg(F.coalesce(F.sum("twice"), F.lit(0))).first()[0] - matched)


@query(sql("coq") + "SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_broken, CAST(0 AS BIGINT) AS gap FROM e")
def double_cover_matching(spark, d):
    return _matched(materialise(P.coq(spark, d)))


def _maximal(e: DataFrame) -> DataFrame:
    """Certificate of a maximal matching: ``n_foreign`` pairs that are no edges,
    ``n_shared`` vertices in two pairs, ``n_addable`` edges that would fit."""
    e = materialise(e)
    m = materialise(S.matching(e))
    ends = materialise(m.select(F.explode(F.array("u", "v")).alias("id")))
    return _row(e.sparkSession, n_edges=_n(e), n_foreign=_n(m.join(e, ["u", "v"], "left_anti")), n_shared=_n(ends) - _n(ends.distinct()), n_addable=_n(G.delete_vertices(e, ends.distinct())))


_MAXIMAL = "SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_foreign, CAST(0 AS BIGINT) AS n_shared, CAST(0 AS BIGINT) AS n_addable FROM e"
query(sql("coq") + _MAXIMAL, "maximal_matching")(lambda spark, d: _maximal(P.coq(spark, d)))

for _name, _method in (("greedy_max_cover", "max"), ("greedy_min_cover", "min"), ("best_of_n", "best"), ("local_search", "search")):

    def _run(spark, d, method=_method):
        e = materialise(P.coq(spark, d))
        return _covered(e, S.heuristic(e, method))

    query(_covered_sql("coq"), _name)(_run)


@query(_covered_sql("sp"))
def greedy_rounds(spark, d):
    e = materialise(P.sp(spark, d))
    return _covered(e, S.greedy_rounds(e))


def _size(e: DataFrame, cover: DataFrame) -> DataFrame:
    cover = materialise(cover)
    left = G.uncovered(e, cover).agg(F.count(F.lit(1)).alias("n_uncovered"))
    return cover.agg(F.countDistinct("id").alias("size")).crossJoin(left)  # one row each


@query("SELECT count(DISTINCT c_nationkey) AS size, 0 AS n_uncovered, true AS proven FROM customer")
def exact_cover_size_star(spark, d):
    e = materialise(P.star(spark, d))
    s = S.solve_exact(e)
    return _size(e, s.cover).select("size", F.col("n_uncovered").cast("int").alias("n_uncovered"), F.lit(s.proven).alias("proven"))


for _name, _graph in (("spq", P.spq), ("coq", P.coq), ("co", P.co), ("blocks", P.blocks)):

    def _exact(spark, d, graph=_graph):
        e = materialise(graph(spark, d))
        s = S.solve_exact(e)
        return _covered(e, s.cover, proven=s.proven)

    query(_covered_sql(_name, ", true AS proven"), f"exact_cover_size_{_name}")(_exact)

_PC = _COMP + ", pc AS (SELECT cc.component, count(*) AS n_vertices, CAST(sum(d.deg) // 2 AS BIGINT) AS n_edges FROM cc JOIN d ON d.id = cc.id GROUP BY cc.component HAVING max(d.deg) <= 2)"


@query(sql("coq", _PC, True) + "SELECT component, n_vertices, n_edges, (n_vertices + CASE WHEN n_edges = n_vertices THEN 1 ELSE 0 END) // 2 AS optimum FROM pc")
def path_cycle_optimum(spark, d):
    return G.path_cycle_optimum(P.coq(spark, d))


_METHODS = (*K.SEARCHES, "matrix")


@query(sql("coq", _COMP + ", few AS (SELECT component FROM cc GROUP BY component HAVING count(*) <= 10)", True) + "SELECT m.method, count(*) AS n_components, count(*) AS n_agree FROM few, (VALUES " + ", ".join(f"('{m}')" for m in _METHODS) + ") AS m(method) GROUP BY m.method")
def searches_agree(spark, d):
    """Of components of at most ten vertices, all methods find covers of one size."""
    found = materialise(S.searches(P.coq(spark, d), _METHODS, 10))
    least = found.where("valid").groupBy("component").agg(F.min("size").alias("least"))
    return found.join(least, "component").groupBy("method").agg(F.count(F.lit(1)).alias("n_components"), F.count(F.when(F.col("valid") & (F.col("size") == F.col("least")), 1)).alias("n_agree"))


@query(sql("coq") + "SELECT count(*) AS n_vertices, count(*) AS n_placed FROM d")
def residual_components(spark, d):
    """Every vertex is in one strongly connected part, named by its least vertex."""
    e = materialise(P.coq(spark, d))
    parts = materialise(S.residual_components(e))
    placed = parts.join(parts.groupBy("part").agg(F.min("id").alias("least")), "part").where("part = least").select("id").distinct()
    return _row(spark, n_vertices=_n(G.vertices(e)), n_placed=_n(placed))


# --- instances and answers of solvers ----------------------------------------


@query(sql("spq") + "SELECT '+1*x' || u || ' +1*x' || v || ' >= +1;' AS line FROM e")
def opb_constraints(spark, d):
    return X.opb_constraints(P.spq(spark, d))


@query(sql("spq") + "SELECT '+1*x' || id AS term FROM d")
def opb_objective(spark, d):
    return X.opb_terms(G.vertices(P.spq(spark, d)))


@query(sql("spq", _R1) + "SELECT CAST(id AS VARCHAR) AS name FROM p")
def decode_literals(spark, d):
    """Round trip of a cover through answer lines."""
    e = P.spq(spark, d)
    taken = R.r1_batch(e).withColumn("t", F.lit(True))
    lines = G.vertices(e).join(taken, "id", "left").select(F.concat(F.lit("v "), F.when(F.col("t"), "x").otherwise("-x"), F.col("id").cast("string")).alias("value"))
    return X.decode_literals(lines)


@query(sql("spq") + "SELECT CAST(u AS VARCHAR) AS vertex0, CAST(v AS VARCHAR) AS vertex1 FROM e")
def opb_scan(spark, d):
    """Edges back from the lines of an instance, its objective among them."""
    e = materialise(P.spq(spark, d))
    lines = X.opb_constraints(e).unionByName(X.opb_objective(G.vertices(e)).select(F.col("text").alias("line")))
    return X.opb_edges(lines, "line")


@query(sql("spq") + "SELECT 0 AS place, '' AS id, 'min:' AS text UNION ALL SELECT 1, CAST(id AS VARCHAR), '+1*x' || id FROM d UNION ALL SELECT 2, '', ';' || chr(10)")
def opb_objective_pieces(spark, d):
    return X.opb_objective(G.vertices(P.spq(spark, d)))


@query("SELECT 'n' || n_nationkey AS name FROM nation WHERE n_nationkey % 3 = 0 AND (SELECT count(*) FROM nation) > 0")
def last_answer(spark, d):
    """The last of several answers counts: one literal list a line."""
    n = table(spark, d, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))  # 25 of them
    literals = lambda sign: F.concat(F.lit("v "), F.array_join(F.transform("k", lambda x: F.concat(sign(x), F.lit("xn"), x.cast("string"))), " "))
    rows = [(1, F.lit("o 7")), (2, literals(lambda x: F.lit(""))), (3, F.lit("c better")), (4, literals(lambda x: F.when(x % 3 == 0, "").otherwise("-"))), (5, F.lit("s SATISFIABLE"))]
    return X.last_answer(n.select(F.inline(F.array(*[F.struct(F.lit(i).alias("at"), v.alias("value")) for i, v in rows]))), "at")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def cover_file_lines(spark, d):
    names = table(spark, d, "nation").select((F.col("n_nationkey").cast("bigint") * 2 + 1).alias("id"), F.col("n_name").alias("name"))
    return X.cover_lines(S.solve_exact(P.star(spark, d)).cover, names)


# --- result pipeline ---------------------------------------------------------

DOM, DEG = "buss_then_deg1_then_domination", "buss_then_deg1"
_SEC = r"""CASE WHEN regexp_full_match("time", '[ ]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ ]*') THEN TRY_CAST(trim("time") AS DOUBLE) END"""
_VALID = f"v AS (SELECT *, {_SEC} AS seconds FROM (SELECT DISTINCT * FROM {DOM}))"


def _results(spark, d, name=DOM):
    return table(spark, d, name).distinct()


@query(f"WITH {_VALID} SELECT run_id, file, seconds FROM v WHERE seconds IS NOT NULL")
def csv_filter(spark, d):
    return C.valid(_results(spark, d)).select("run_id", "file", "seconds")


@query(f"WITH {_VALID} SELECT run_id, seconds FROM v WHERE seconds IS NOT NULL ORDER BY seconds, run_id")
def csv_sort(spark, d):
    return C.sort_by_time(_results(spark, d), "run_id").select("run_id", "seconds")


@query(f"WITH {_VALID} SELECT load_id, run_id, round(sum(seconds) OVER (PARTITION BY load_id ORDER BY run_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM v WHERE seconds IS NOT NULL")
def csv_running_total(spark, d):
    return C.running_total(_results(spark, d), "load_id", ["run_id"]).select("load_id", "run_id", F.round("total", 4).alias("total"))


@query(f"WITH {_VALID} SELECT run_id, CASE WHEN seconds IS NULL OR recsteps IS NULL OR recsteps = 0 THEN 0.0 ELSE seconds / recsteps END AS per_step FROM v")
def csv_time_per_step(spark, d):
    return C.time_per_step(_results(spark, d)).select("run_id", "per_step")


_BEST = f"(SELECT file, min(s) AS t FROM (SELECT file, {_SEC} AS s FROM {{0}}) WHERE s > 0 AND file IS NOT NULL GROUP BY file)"


@query(
    "SELECT a.file, a.t AS time1, b.t AS time2, c.t AS time3, d.t AS time4 FROM "
    + f"{_BEST.format(DOM)} a JOIN {_BEST.format(DEG)} b ON a.file = b.file JOIN {_BEST.format(f'results_mirror WHERE config = {chr(39)}{DOM}{chr(39)}')} c ON a.file = c.file JOIN {_BEST.format(f'results_mirror WHERE config = {chr(39)}{DEG}{chr(39)}')} d ON a.file = d.file"
)
def csv_intersect4(spark, d):
    m = table(spark, d, "results_mirror")
    return C.intersect([table(spark, d, DOM), table(spark, d, DEG), m.where(F.col("config") == DOM), m.where(F.col("config") == DEG)])


# --- the same operators over whole tables: all of lineitem, all of bucketgraph --


def _whole(name: str, f: Callable[[DataFrame], DataFrame], more: str | None = None, select: str | None = None, numbered: bool = False, recursive: bool = False) -> None:
    """``name_sp`` and ``name_bg``. ``numbered``: names of bucketgraph become
    dense ids first."""
    graphs = {"sp": (P.sp, "sp"), "bg": (P.bg_numbered, "bg_numbered") if numbered else (P.bg, "bg")}
    for g, (build, own) in graphs.items():
        query(sql(own, more or "", recursive) + select if select else None, f"{name}_{g}")(lambda spark, d, build=build: f(build(spark, d)))


_whole("leaves", R.leaves, None, "SELECT id FROM d WHERE deg = 1")
_whole("r1_batch", R.r1_batch, _R1, "SELECT id FROM p")
_whole("r1_remaining_edges", lambda e: G.delete_vertices(e, R.r1_batch(e)), _R1, "SELECT u, v FROM e WHERE u NOT IN (SELECT id FROM p) AND v NOT IN (SELECT id FROM p)")
_whole("isolated_after_delete", lambda e: G.isolated_after(e, _top(e, 4)), None, f"SELECT id FROM d WHERE deg < 4 AND id NOT IN (SELECT u FROM s WHERE u NOT IN {_S4} AND v NOT IN {_S4})")
_whole("double_cover_edges", G.double_cover, None, "SELECT u AS l, v AS r FROM s")
_whole("opb_constraints", X.opb_constraints, None, "SELECT '+1*x' || u || ' +1*x' || v || ' >= +1;' AS line FROM e")
_whole("opb_objective", lambda e: X.opb_terms(G.vertices(e)), None, "SELECT '+1*x' || id AS term FROM d")
_whole("components", G.components, _COMP, "SELECT id, component FROM cc", numbered=True, recursive=True)
_whole("common_neighbours", G.common_neighbours, None, "SELECT e.u, e.v, count(*) AS common FROM e JOIN s a ON a.u = e.u JOIN s b ON b.u = e.v AND b.v = a.v GROUP BY e.u, e.v", numbered=True)
_whole("dominators", R.dominators, _DOM, "SELECT u, v FROM dm", numbered=True)
_whole("r2_selected", R.r2_selected, _SEL2, "SELECT v, a, b, triangle FROM sel", numbered=True)
_whole("r8_r9_selected", lambda e: R.select_ball(e, R.deg3_cases(e).where("kind IN ('independent', 'edge')")), numbered=True)
_whole("maximal_matching", _maximal, None, _MAXIMAL, numbered=True)


def _greedy(e: DataFrame) -> DataFrame:
    e = materialise(e)
    return _covered(e, S.greedy_rounds(e))


_whole("greedy_rounds", _greedy, None, "SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_uncovered, true AS bounded FROM e", numbered=True)


def _on(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda e: f(materialise(e))


def _solved(e: DataFrame) -> DataFrame:
    s = S.solve_exact(e)
    return _covered(e, s.cover, proven=s.proven)


_whole("exact_cover_size", _on(_solved), None, "SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_uncovered, true AS bounded, true AS proven FROM e", numbered=True)
_whole("local_search", _on(lambda e: _covered(e, S.heuristic(e, "search", tries=2))), None, "SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_uncovered, true AS bounded FROM e", numbered=True)
_whole("kernel_undone", _on(lambda e: _undone(e, R.kernelize(e))), None, _UNDONE + " FROM e", numbered=True)
_whole("double_cover_matching", _on(_matched), None, "SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_broken, CAST(0 AS BIGINT) AS gap FROM e", numbered=True)
