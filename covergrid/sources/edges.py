"""Sources and sinks: edge lists, pseudo-Boolean instances, solver answers,
result files, covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergrid.operators import linecheck
from covergrid.operators.drift import FIXED

ENDS = ["vertex0", "vertex1"]


def read_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges ``vertex0, vertex1`` (a multiset) and rejected lines ``value,
    reason`` of edge-list text, one edge per line, ``#`` comments."""
    lines = spark.read.text(path)
    return linecheck.edges(lines, ENDS), linecheck.rejects(lines, ENDS, keep=("value",)).select("value", "reason")


def write_edges(e: DataFrame, path: str) -> None:
    """Each edge once, ``u v`` per line."""
    e.select(F.concat_ws(" ", "u", "v")).write.text(path)


def original_edges(raw: DataFrame, ends: list[str] = ENDS) -> DataFrame:
    """``line`` of each edge as it was read, repeats kept; records with a null
    end aren't edges."""
    a, b = (F.col(f"`{c}`") for c in ends)
    return raw.where(a.isNotNull() & b.isNotNull()).select(F.concat_ws(" ", a, b).alias("line"))


def cover_lines(cover: DataFrame, names: DataFrame) -> DataFrame:
    """``name`` of each cover vertex, by a dictionary ``names(id, name)``."""
    return cover.select("id").join(names.select("id", "name"), "id").select("name")


def write_cover(cover: DataFrame, path: str, names: DataFrame | None = None) -> None:
    """A cover, one vertex per line: by name, or by id without a dictionary."""
    lines = cover.select(F.col("id").alias("name")) if names is None else cover_lines(cover, names)
    lines.select(F.col("name").cast("string")).write.text(path)


def opb_constraints(e: DataFrame) -> DataFrame:
    """``line`` of each edge in a pseudo-Boolean instance."""
    return e.select(F.format_string("+1*x%s +1*x%s >= +1;", F.col("u").cast("string"), F.col("v").cast("string")).alias("line"))


def opb_terms(ids: DataFrame) -> DataFrame:
    """``term`` of each vertex in the objective."""
    return ids.select(F.format_string("+1*x%s", F.col("id").cast("string")).alias("term"))


def opb_objective(ids: DataFrame) -> DataFrame:
    """``place, id, text``: pieces of the objective, which is one line of the
    file: in order of place and id, with a space after each."""
    terms = ids.select(F.lit(1).alias("place"), F.col("id").cast("string").alias("id"), F.format_string("+1*x%s", F.col("id").cast("string")).alias("text"))
    ends = ids.sparkSession.createDataFrame([(0, "", "min:"), (2, "", ";\n")], "place int, id string, text string")
    return ends.unionByName(terms)


def write_opb(e: DataFrame, ids: DataFrame, path: str) -> None:
    """An instance as folders of parts in order: the objective, then the
    constraints. Its file is all parts one after another; the parts of the
    objective are written without line ends, as the format wants it on one line,
    so no task ever holds all of it."""
    opb_objective(ids).orderBy("place", "id").select("text").write.option("lineSep", " ").text(f"{path}/0_objective")
    opb_constraints(e).write.text(f"{path}/1_constraints")


def opb_edges(lines: DataFrame, value: str = "value") -> DataFrame:
    """Names ``vertex0, vertex1`` of the two-term constraints of an instance."""
    pattern = r"^\+1\*x([A-Za-z0-9_]+) \+1\*x([A-Za-z0-9_]+) >= \+?1 *;\s*$"
    t = lines.where(F.col(value).rlike(pattern))
    return t.select(*[F.regexp_extract(value, pattern, i + 1).alias(c) for i, c in enumerate(ENDS)])


def read_opb(spark: SparkSession, path: str) -> DataFrame:
    return opb_edges(spark.read.text(path))


def decode_literals(lines: DataFrame, value: str = "value") -> DataFrame:
    """``name`` of each positive literal of ``v`` lines."""
    lit = lines.where(F.col(value).rlike(r"^v(\s|$)")).select(F.explode(F.split(F.expr(f"substring(`{value}`, 2)"), r"\s+")).alias("x"))
    return lit.where(F.col("x").rlike("^x")).select(F.expr("substring(x, 2)").alias("name"))


def last_answer(lines: DataFrame, order: str, value: str = "value") -> DataFrame:
    """``name`` of each positive literal of the last ``v`` line by ``order``;
    none if the solver was interrupted."""
    v = F.col(value)
    state = lines.agg(F.max(F.when(v.rlike(r"^v(\s|$)"), F.col(order))).alias("last"), F.coalesce(F.max(v.contains("*** Interrupted ***")), F.lit(False)).alias("stopped"))
    at = lines.join(F.broadcast(state), F.col(order) == F.col("last")).where("NOT stopped")  # one row
    return decode_literals(at.select(v.alias("value")))


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    """Names of a solver's answer in one file; empty if it was interrupted."""
    return last_answer(spark.read.text(path).coalesce(1).withColumn("at", F.monotonically_increasing_id()), "at")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files as text columns, whichever header they have."""
    df = spark.read.option("sep", ";").option("header", True).csv(path)
    names = {"last-k-diff-to-opttime": "last-k-diff-to-opt"}
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(names.get(c.strip(), c.strip())) for c in df.columns if c.strip() in FIXED or c.strip() in names])


def write_results(df: DataFrame, path: str) -> None:
    df.write.option("sep", ";").option("header", True).csv(path)
