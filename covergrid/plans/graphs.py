"""Graphs over the driver tables, each as a Spark plan and as SQL ``e(u, v)``.

Ids are the tables' own keys, doubled to keep two kinds of vertices apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergrid.operators import graph as G
from covergrid.session import materialise, table


def _pairs(df: DataFrame, a, b) -> DataFrame:
    return G.canonical(df.select(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), "a", "b")


def star(spark: SparkSession, d: str) -> DataFrame:
    """Customers and their nations."""
    return _pairs(table(spark, d, "customer"), F.col("c_custkey") * 2, F.col("c_nationkey").cast("bigint") * 2 + 1)


def sp(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and the parts they deliver."""
    return _pairs(table(spark, d, "lineitem"), F.col("l_partkey") * 2, F.col("l_suppkey") * 2 + 1)


def spq(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts delivered in great quantity."""
    return _pairs(table(spark, d, "lineitem").where("l_quantity >= 49"), F.col("l_partkey") * 2, F.col("l_suppkey") * 2 + 1)


def _together(spark: SparkSession, d: str, key: str, condition: str) -> DataFrame:
    items = table(spark, d, "lineitem").where(condition).select("l_orderkey", F.col(key).alias("k")).distinct()
    return _pairs(items.join(items.withColumnRenamed("k", "k2"), "l_orderkey").where("k < k2"), F.col("k"), F.col("k2"))


def co(spark: SparkSession, d: str) -> DataFrame:
    """Parts in one order, both at a high discount."""
    return _together(spark, d, "l_partkey", "l_discount >= 0.09")


def coq(spark: SparkSession, d: str) -> DataFrame:
    """Parts in one order, both in great quantity."""
    return _together(spark, d, "l_partkey", "l_quantity >= 45")


def ss(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in one order, both returned."""
    return _together(spark, d, "l_suppkey", "l_returnflag = 'R'")


#: Edges of a block of 17 parts: neighbours of a vertex that form a path, a
#: triangle beside a single, and a 4-cycle; and links, the last to the next block.
BLOCK = (
    (0, 1), (0, 2), (0, 3), (1, 2), (2, 3), (1, 4), (3, 4), (5, 6), (5, 7), (5, 8), (5, 9), (6, 7), (6, 8), (7, 8), (9, 10), (6, 10),
    (11, 12), (11, 13), (11, 14), (11, 15), (12, 13), (13, 14), (14, 15), (12, 15), (15, 16), (10, 16), (4, 16), (4, 12), (16, 18),
)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """A block of edges for each seventeenth part, one linked to the next."""
    base = table(spark, d, "part").where("p_partkey % 17 = 0").select(F.col("p_partkey").cast("bigint").alias("b"))
    return base.select(F.inline(F.array(*[F.struct((F.col("b") + x).alias("u"), (F.col("b") + y).alias("v")) for x, y in BLOCK])))


def bg_raw(spark: SparkSession, d: str) -> DataFrame:
    """Recorded edges; a vertex name belongs to its file."""
    name = lambda c: F.concat("file", F.lit(":"), c)
    return table(spark, d, "bucketgraph").select(name("vertex0").alias("a"), name("vertex1").alias("b"))


def bg(spark: SparkSession, d: str) -> DataFrame:
    return G.canonical(bg_raw(spark, d), "a", "b")


def bg_numbered(spark: SparkSession, d: str) -> DataFrame:
    """``bg`` with dense ids in order of names, for operators that need numbers."""
    e = materialise(bg(spark, d).withColumn("at", F.lit(0)))
    ids = materialise(G.dictionary(e, "at", ["u", "v"], []))
    a, b = (ids.select(F.col("name").alias(c), F.col("id").alias(i)) for c, i in zip("uv", "ab"))
    return G.canonical(e.join(a, "u").join(b, "v").select("a", "b"), "a", "b")


_TWO = "SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM ({}) WHERE a <> b"
_PART_SUPP = "SELECT CAST(l_partkey AS BIGINT) * 2 AS a, CAST(l_suppkey AS BIGINT) * 2 + 1 AS b FROM lineitem"
_BOTH = "SELECT DISTINCT x.{0} AS u, y.{0} AS v FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.{0} < y.{0} WHERE x.{1} AND y.{1}"
BG_RAW = "SELECT file || ':' || vertex0 AS a, file || ':' || vertex1 AS b FROM bucketgraph"

EDGES = {
    "star": _TWO.format("SELECT CAST(c_custkey AS BIGINT) * 2 AS a, CAST(c_nationkey AS BIGINT) * 2 + 1 AS b FROM customer"),
    "sp": _TWO.format(_PART_SUPP),
    "spq": _TWO.format(_PART_SUPP + " WHERE l_quantity >= 49"),
    "co": _BOTH.format("l_partkey", "l_discount >= 0.09"),
    "coq": _BOTH.format("l_partkey", "l_quantity >= 45"),
    "ss": _BOTH.format("l_suppkey", "l_returnflag = 'R'"),
    "bg": _TWO.format(BG_RAW),
    "bg_numbered": f"""WITH e0 AS ({_TWO.format(BG_RAW)}), nm AS (SELECT name, row_number() OVER (ORDER BY min(p), name) - 1 AS id FROM (SELECT u AS name, 0 AS p FROM e0 UNION ALL SELECT v, 1 FROM e0) GROUP BY name)
 SELECT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v FROM e0 JOIN nm a ON a.name = e0.u JOIN nm b ON b.name = e0.v""",
    "blocks": "SELECT b + x AS u, b + y AS v FROM (SELECT CAST(p_partkey AS BIGINT) AS b FROM part WHERE p_partkey % 17 = 0), (VALUES " + ", ".join(map(str, BLOCK)) + ") AS o(x, y)",
}


def sql(graph: str, more: str = "", recursive: bool = False) -> str:
    """``WITH`` clause of a graph: edges e, both directions s, degrees d."""
    return (
        f"WITH {'RECURSIVE ' if recursive else ''}e AS ({EDGES[graph]}), s AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), "
        f"d AS (SELECT u AS id, count(*) AS deg FROM s GROUP BY u){', ' + more if more else ''} "
    )
