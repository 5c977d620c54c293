"""Queries of the operators for language-model data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covergrid.llm import bpe, pieces
from covergrid.llm.formatdups import FormatDuplicates
from covergrid.llm.leaks import LeakFinder
from covergrid.session import table


def _edges(spark: SparkSession, d: str) -> FormatDuplicates:
    return FormatDuplicates(table(spark, d, "bucketgraph"), "edge_id", ["file"], ["vertex0", "vertex1"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).copies()


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).collapsed()


def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).rejected()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> tuple[LeakFinder, DataFrame]:
    return LeakFinder(table(spark, d, "benchmark"), "item_id", "text"), table(spark, d, "documents")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    finder, docs = _leaks(spark, d)
    return finder.leaks(docs, "doc_id", "text")


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    finder, docs = _leaks(spark, d)
    return finder.report(docs, "doc_id", "text")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).where("piece = 0").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_collapsed, p1_rejected, p7_ids, p8_found, p8_templates, p9_found, p9_pieces)}

_CANON = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_SETS = f"""WITH c AS (SELECT edge_id, file, {_CANON.format('vertex0')} AS a, {_CANON.format('vertex1')} AS b FROM bucketgraph WHERE vertex0 IS NOT NULL AND vertex1 IS NOT NULL),
t AS (SELECT edge_id, file, least(a, b) AS lo, greatest(a, b) AS hi FROM c WHERE a <> '' AND b <> '')"""

SQL = {
    "p1_found": _SETS + """, m AS (SELECT *, min(edge_id) OVER (PARTITION BY file, lo, hi) AS first_id FROM t)
SELECT first_id, edge_id AS copy_id FROM m WHERE edge_id <> first_id""",
    "p1_collapsed": _SETS + " SELECT min(edge_id) AS first_id, count(*) AS n_copies FROM t GROUP BY file, lo, hi",
    "p1_rejected": f"SELECT edge_id AS first_id, CAST(1 AS BIGINT) AS n_copies FROM (SELECT edge_id, {_CANON.format('vertex0')} AS a, {_CANON.format('vertex1')} AS b FROM bucketgraph) WHERE coalesce(a, '') = '' OR coalesce(b, '') = ''",
    "p8_found": r"""WITH iw AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM benchmark),
ix AS (SELECT item_id, unnest(range(1, len(w) - 10)) AS i, w FROM iw WHERE len(w) >= 12),
iwin AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS win FROM ix),
dw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM documents WHERE text IS NOT NULL),
dx AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS i, w FROM dw WHERE len(w) >= 12),
dwin AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS win FROM dx)
SELECT DISTINCT doc_id, item_id FROM dwin JOIN iwin ON dwin.win = iwin.win""",
}
