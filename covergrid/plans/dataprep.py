"""Queries of the data-preparation operators (problems 2 to 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergrid.operators import compare, linecheck, profile, salting
from covergrid.operators.drift import ALIASES, FIXED, DriftReader
from covergrid.session import table

DOM = "buss_then_deg1_then_domination"
DEG = "buss_then_deg1"
ENDS = ["vertex0", "vertex1"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return DriftReader(table(spark, d, "result_lines")).changes()


def p2_statistics(spark: SparkSession, d: str) -> DataFrame:
    return DriftReader(table(spark, d, "result_lines")).statistics().select("load_id", "path", "n", "filled", "whole", "decimal", "bool", "text", "kind")


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    """The typed table, whole numbers as double here as they may be null; other
    fields as sorted texts ``name=value``."""
    typed, _ = DriftReader(table(spark, d, "result_lines")).project()
    text = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"]))), "|")
    return typed.withColumns({c: text(c) for c in ("extra", "overflow")} | {f: F.col(f"`{f}`").cast("double") for f, t in FIXED.items() if t != "string"})


def p2_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    _, failed = DriftReader(table(spark, d, "result_lines")).project()
    return failed


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cols = ["config", "run_id", "file", "time", "solsize"]
    results = None
    for name in (DOM, DEG):
        own = table(spark, d, name).withColumn("config", F.lit(name)).select(*cols)
        results = own if results is None else results.unionByName(own)
    mirror = table(spark, d, "results_mirror").where(F.col("config").isin(DOM, DEG)).select(*cols)
    both = lambda e: (e, e)
    fields = {"file": both(compare.exact(F.col("file"))), "time": both(compare.plain_number(F.col("time"))), "solsize": both(compare.exact(F.col("solsize")))}
    out = compare.differences(results, mirror, ["config", "run_id"], fields)
    names = F.when(F.col("difference") == "missing_in_right", "missing_in_mirror").when(F.col("difference") == "missing_in_left", "missing_in_results").otherwise(F.col("difference"))
    return out.withColumn("difference", names)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linecheck.rejects(table(spark, d, "edge_lines"), ENDS, keep=("line_id",)).select("line_id", "reason")


def p4_edges(spark: SparkSession, d: str) -> DataFrame:
    return linecheck.edges(table(spark, d, "edge_lines"), ENDS, keep=("line_id", "file"))


def p4_broken_fields(spark: SparkSession, d: str) -> DataFrame:
    return linecheck.rejects(table(spark, d, "edge_lines"), ENDS).groupBy("reason", "broken_field").agg(F.count(F.lit(1)).alias("n_lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.findings(table(spark, d, DOM))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(table(spark, d, DOM)).withColumnRenamed("load", "load_id")


def p5_drift(spark: SparkSession, d: str) -> DataFrame:
    return profile.drift(table(spark, d, DOM))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return salting.frequent_values(table(spark, d, "bucketgraph"), ENDS, F.col("edge_id"), 50).select("field", F.col("value").alias("vertex"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return salting.salted_counts(table(spark, d, "bucketgraph"), ENDS, F.col("edge_id")).select("field", F.col("value").alias("vertex"), F.col("n").alias("n_rows"))


def p6_degrees(spark: SparkSession, d: str) -> DataFrame:
    return salting.salted_degrees(table(spark, d, "bucketgraph"), "file", ("vertex0", "vertex1"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_statistics, p2_table, p2_failed_casts, p3_found, p4_found, p4_edges, p4_broken_fields, p5_found, p5_profile, p5_drift, p6_found, p6_counts, p6_degrees)
}

# --- the same in SQL ---------------------------------------------------------

_TRIM = r"regexp_replace({}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_CELLS = "list_transform(string_split(value, ';'), lambda c: " + _TRIM.format("c") + ")"
_KIND = r"""CASE WHEN v = '' THEN NULL WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'whole'
 WHEN regexp_full_match(v, '[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?[0-9]+[eE][+-]?[0-9]+') THEN 'decimal'
 WHEN lower(v) IN ('true', 'false') THEN 'bool' ELSE 'text' END"""
_DRIFT = rf"""
WITH heads AS (SELECT load_id, min({_CELLS}) AS names FROM result_lines WHERE line_no = 1 GROUP BY load_id),
loads AS (SELECT load_id, lag(load_id) OVER (PARTITION BY campaign ORDER BY written_at, load_id) AS prev_id
 FROM (SELECT load_id, min(campaign) AS campaign, min(written_at) AS written_at FROM result_lines GROUP BY load_id)),
body AS (SELECT r.load_id, r.line_no, {_CELLS} AS cells, h.names FROM result_lines r JOIN heads h USING (load_id) WHERE r.line_no > 1),
cellat AS (SELECT load_id, line_no, cells, names, unnest(range(1, len(names) + 1)) AS i FROM body),
vals AS (SELECT load_id, line_no, cells[1] AS graph, names[i] AS path, coalesce(cells[i], '') AS v FROM cellat WHERE names[i] <> '' AND list_position(names, names[i]) = i),
flds AS (SELECT DISTINCT load_id, path FROM (SELECT load_id, unnest(names) AS path FROM heads) WHERE path <> ''),
kinds AS (SELECT load_id, path, v, {_KIND} AS kind FROM vals),
st AS (SELECT load_id, path, count(*) AS n, count(kind) AS filled, count(*) FILTER (kind = 'whole') AS whole, count(*) FILTER (kind = 'decimal') AS "decimal",
 count(*) FILTER (kind = 'bool') AS "bool", count(*) FILTER (kind = 'text') AS "text" FROM kinds GROUP BY load_id, path),
stats AS (SELECT f.load_id, f.path, n, filled, whole, "decimal", "bool", "text", CASE WHEN 2 * whole > filled THEN 'whole' WHEN 2 * "decimal" > filled THEN 'decimal'
 WHEN 2 * "bool" > filled THEN 'bool' WHEN 2 * "text" > filled THEN 'text' END AS kind FROM flds f LEFT JOIN st ON f.load_id = st.load_id AND f.path = st.path)
"""
_P2 = (
    _DRIFT
    + """,
pairs AS (SELECT load_id, prev_id FROM loads WHERE prev_id IS NOT NULL),
gone AS (SELECT p.load_id, p.prev_id, s.path FROM pairs p JOIN stats s ON s.load_id = p.prev_id WHERE NOT EXISTS (SELECT 1 FROM flds f WHERE f.load_id = p.load_id AND f.path = s.path)),
fresh AS (SELECT p.load_id, p.prev_id, s.path FROM pairs p JOIN stats s ON s.load_id = p.load_id WHERE NOT EXISTS (SELECT 1 FROM flds f WHERE f.load_id = p.prev_id AND f.path = s.path)),
had AS (SELECT DISTINCT g.load_id, g.path AS old_name, v.graph, v.v FROM gone g JOIN vals v ON v.load_id = g.prev_id AND v.path = g.path),
has AS (SELECT DISTINCT g.load_id, g.path AS new_name, v.graph, v.v FROM fresh g JOIN vals v ON v.load_id = g.load_id AND v.path = g.path),
common AS (SELECT DISTINCT a.load_id, a.graph FROM had a JOIN has b ON a.load_id = b.load_id AND a.graph = b.graph),
had2 AS (SELECT h.* FROM had h JOIN common c ON h.load_id = c.load_id AND h.graph = c.graph),
has2 AS (SELECT h.* FROM has h JOIN common c ON h.load_id = c.load_id AND h.graph = c.graph),
same AS (SELECT a.load_id, old_name, new_name, count(*) AS n FROM had2 a JOIN has2 b ON a.load_id = b.load_id AND a.graph = b.graph AND a.v = b.v GROUP BY ALL),
fits AS (SELECT s.load_id, s.old_name, s.new_name FROM same s
 JOIN (SELECT load_id, old_name, count(*) AS n FROM had2 GROUP BY ALL) o ON o.load_id = s.load_id AND o.old_name = s.old_name AND o.n = s.n
 JOIN (SELECT load_id, new_name, count(*) AS n FROM has2 GROUP BY ALL) w ON w.load_id = s.load_id AND w.new_name = s.new_name AND w.n = s.n),
near AS (SELECT *, row_number() OVER (PARTITION BY load_id, old_name ORDER BY levenshtein(lower(old_name), lower(new_name)), old_name, new_name) AS a,
 row_number() OVER (PARTITION BY load_id, new_name ORDER BY levenshtein(lower(old_name), lower(new_name)), old_name, new_name) AS b FROM fits),
renamed AS (SELECT load_id, old_name, new_name FROM near WHERE a = 1 AND b = 1)
SELECT load_id, 'renamed' AS change, old_name, new_name FROM renamed
UNION ALL SELECT g.load_id, 'removed', g.path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.load_id = g.load_id AND r.old_name = g.path)
UNION ALL SELECT g.load_id, 'added', '', g.path FROM fresh g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.load_id = g.load_id AND r.new_name = g.path)
UNION ALL SELECT p.load_id, 'retyped', a.path, a.path FROM pairs p JOIN stats a ON a.load_id = p.load_id JOIN stats b ON b.load_id = p.prev_id AND b.path = a.path WHERE a.kind <> b.kind
"""
)

def _typed(name: str, kind: str) -> str:
    digits = r"[+-]?[0-9]+" if kind != "double" else r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i)[+-]?(nan|inf|infinity)"
    v = f"max(v) FILTER (target = '{name}' AND v <> '')"
    return v if kind == "string" else f"CASE WHEN regexp_full_match({v}, '{digits}') THEN TRY_CAST({v} AS {kind}) END"


_TARGETS = "CASE WHEN position = 1 THEN 'file' " + " ".join(f"WHEN regexp_replace(lower(root), '[^a-z0-9]', '', 'g') = '{''.join(c for c in name.lower() if c.isalnum())}' THEN '{to}'" for name, to in [*ALIASES.items(), *((x, x) for x in FIXED)]) + " END"
#: Each cell under its fixed field (target) or its own name.
_PROJECTED = (
    _P2.split("SELECT load_id, 'renamed' AS change")[0].replace("WITH heads", "WITH RECURSIVE heads")
    + f""", place AS (SELECT f.load_id, f.path, list_position(h.names, f.path) AS position FROM flds f JOIN heads h ON h.load_id = f.load_id),
step AS (SELECT f.load_id, f.path, p.load_id AS p_load, p.path AS p_path FROM flds f JOIN loads l ON l.load_id = f.load_id LEFT JOIN renamed r ON r.load_id = f.load_id AND r.new_name = f.path
 LEFT JOIN flds p ON p.load_id = l.prev_id AND p.path = coalesce(r.old_name, f.path)),
lin AS (SELECT load_id, path, path AS root FROM step WHERE p_load IS NULL UNION ALL SELECT s.load_id, s.path, lin.root FROM step s JOIN lin ON lin.load_id = s.p_load AND lin.path = s.p_path),
named AS (SELECT lin.load_id, lin.path, position, {_TARGETS} AS target FROM lin JOIN place USING (load_id, path)),
fixed AS (SELECT load_id, path, position, CASE WHEN row_number() OVER (PARTITION BY load_id, target ORDER BY position) = 1 THEN target END AS target FROM named),
lines AS (SELECT r.load_id, r.line_no, {_CELLS} AS cells, coalesce(len(h.names), 0) AS width FROM result_lines r LEFT JOIN heads h ON h.load_id = r.load_id WHERE r.line_no > 1 AND value IS NOT NULL),
numbered AS (SELECT *, row_number() OVER () AS k FROM lines),
cell AS (SELECT n.k, n.load_id, n.line_no, f.path, f.target, coalesce(n.cells[f.position], '') AS v FROM numbered n JOIN fixed f ON f.load_id = n.load_id)
"""
)
_P2_TABLE = (
    _PROJECTED
    + ", wide AS (SELECT k, "
    + ", ".join(f'{_typed(f, t)} AS "{f}"' if t == "string" else f'CAST({_typed(f, t)} AS DOUBLE) AS "{f}"' for f, t in FIXED.items())
    + ", string_agg(path || '=' || v, '|' ORDER BY path || '=' || v) FILTER (target IS NULL) AS extra FROM cell GROUP BY k), "
    + "over_ AS (SELECT k, string_agg(x, '|' ORDER BY x) AS overflow FROM (SELECT k, i || '=' || cells[i] AS x FROM (SELECT k, cells, unnest(range(width + 1, len(cells) + 1)) AS i FROM numbered)) GROUP BY k) "
    + "SELECT n.load_id, n.line_no, "
    + ", ".join(f'"{f}"' for f in FIXED)
    + ", coalesce(extra, '') AS extra, coalesce(overflow, '') AS overflow FROM numbered n LEFT JOIN wide ON wide.k = n.k LEFT JOIN over_ ON over_.k = n.k"
)
_P2_FAILED = _PROJECTED + " UNION ALL ".join(
    f"SELECT load_id, line_no, '{f}' AS field, max(v) AS value FROM cell WHERE target = '{f}' AND v <> '' GROUP BY k, load_id, line_no HAVING ({_typed(f, t)}) IS NULL" for f, t in FIXED.items() if t != "string"
)

_NUM = r"""CASE WHEN regexp_full_match(coalesce("time", ''), '[0-9]+(\.[0-9]+)?') THEN
 regexp_replace(CASE WHEN strpos("time", '.') > 0 THEN regexp_replace("time", '\.?0+$', '') ELSE "time" END, '^0+([0-9])', '\1') ELSE coalesce("time", '') END"""
_P3 = f"""
WITH r AS (SELECT DISTINCT config, run_id, file, t, solsize FROM (
 SELECT '{DOM}' AS config, run_id, file, {_NUM} AS t, solsize FROM {DOM} UNION ALL SELECT '{DEG}', run_id, file, {_NUM}, solsize FROM {DEG})),
m AS (SELECT DISTINCT config, run_id, file, {_NUM} AS t, solsize FROM results_mirror WHERE config IN ('{DOM}', '{DEG}')),
j AS (SELECT coalesce(r.config, m.config) AS config, coalesce(r.run_id, m.run_id) AS run_id, r.run_id AS a, m.run_id AS b,
 r.file IS DISTINCT FROM m.file AS f, r.t IS DISTINCT FROM m.t AS t, r.solsize IS DISTINCT FROM m.solsize AS s
 FROM r FULL JOIN m ON r.config = m.config AND r.run_id = m.run_id)
SELECT config, run_id, 'missing_in_mirror' AS difference FROM j WHERE b IS NULL
UNION ALL SELECT config, run_id, 'missing_in_results' FROM j WHERE a IS NULL
UNION ALL SELECT config, run_id, 'file' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND f
UNION ALL SELECT config, run_id, 'time' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND t
UNION ALL SELECT config, run_id, 'solsize' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND s
"""

_LINES = r"""
WITH padded AS (SELECT line_id, file, regexp_replace(value, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line FROM edge_lines WHERE value IS NOT NULL),
recs AS (SELECT line_id, file, regexp_replace(line, '[ \t]*#(.|\n)*$', '') AS t FROM padded WHERE line <> '' AND NOT regexp_matches(line, '^[^ ]*#')),
judged AS (SELECT *, CASE WHEN regexp_full_match(t, '(?:[A-Za-z0-9_]+|"[A-Za-z0-9_]+") (?:[A-Za-z0-9_]+|"[A-Za-z0-9_]+")') THEN NULL
 WHEN NOT regexp_full_match(t, '(?:[^" ]*|"[^"]*")(?: (?:[^" ]*|"[^"]*"))*') THEN 'quoting'
 WHEN NOT regexp_full_match(t, '(?:[^" ]*|"[^"]*") (?:[^" ]*|"[^"]*")') THEN 'columns' ELSE 'value' END AS reason FROM recs)
"""
_GOOD = '(?:[A-Za-z0-9_]+|"[A-Za-z0-9_]+")'

_P5_ROWS = rf"""
WITH once AS (SELECT DISTINCT * FROM {DOM}),
f AS (SELECT load_id, campaign, run_id, TRY_CAST("time" AS DECIMAL(38,10)) AS num,
 "time" IS NULL OR "time" = '' AS n0, finished IS NULL AS n1, "VC-check" IS NULL OR "VC-check" = '' AS n2, "diff-to-opt" IS NULL AS n3,
 NOT regexp_full_match("time", '[0-9]+(\.[0-9]+)?') AS b0, finished NOT IN (0, 1) AS b1,
 NOT regexp_full_match("VC-check", 'OK|Not a VC:|Not a VC: Uncovered edge: [A-Za-z0-9_]+ [A-Za-z0-9_]+') AS b2,
 "diff-to-opt" < 0 OR coalesce("diff-to-opt" > solsize, false) AS b3,
 finished = 1 AS h1, "VC-check" = 'OK' AS h2, "diff-to-opt" = 0 AS h3 FROM once),
base AS (SELECT campaign, load_id, count(*) AS rows_, {", ".join(f"count(*) FILTER (n{i}) AS null{i}, count(*) FILTER (NOT n{i} AND NOT b{i}) AS valid{i}" for i in range(4))},
 {", ".join(f"count(*) FILTER (NOT n{i} AND NOT b{i} AND h{i}) AS hits{i}" for i in (1, 2, 3))} FROM f GROUP BY campaign, load_id),
ranked AS (SELECT load_id, num, row_number() OVER (PARTITION BY load_id ORDER BY num) AS rk, count(*) OVER (PARTITION BY load_id) AS c FROM f WHERE NOT n0 AND NOT b0),
med AS (SELECT load_id, max(num) FILTER (rk = (c + 1) // 2) + max(num) FILTER (rk = c // 2 + 1) AS med2 FROM ranked GROUP BY load_id),
l AS (SELECT b.*, m.med2 FROM base b LEFT JOIN med m ON b.load_id = m.load_id),
o AS (SELECT *, lag(load_id) OVER (PARTITION BY campaign ORDER BY load_id) AS prev_id FROM l),
p AS (SELECT o.*, q.rows_ AS prows, q.med2 AS pmed2, {", ".join(f"q.null{i} AS pnull{i}, q.valid{i} AS pvalid{i}" for i in range(4))}, {", ".join(f"q.hits{i} AS phits{i}" for i in (1, 2, 3))} FROM o JOIN l q ON q.load_id = o.prev_id)
"""
_P5 = (
    _P5_ROWS
    + " UNION ALL ".join(
        [f"SELECT load_id, '{n}' AS field, 'violation' AS finding, run_id FROM f WHERE NOT n{i} AND b{i}" for i, n in enumerate(profile.FIELDS)]
        + [f"SELECT load_id, '{n}', 'null_shift', 0 FROM p WHERE 4 * abs(null{i} * prows - pnull{i} * rows_) >= rows_ * prows" for i, n in enumerate(profile.FIELDS)]
        + ["SELECT load_id, 'time', 'value_shift', 0 FROM p WHERE med2 >= 3 * pmed2 OR 3 * med2 <= pmed2"]
        + [f"SELECT load_id, '{n}', 'value_shift', 0 FROM p WHERE valid{i} > 0 AND pvalid{i} > 0 AND 4 * abs(hits{i} * pvalid{i} - phits{i} * valid{i}) >= valid{i} * pvalid{i}" for i, n in enumerate(profile.FIELDS) if i]
    )
)
_PROFILE_COLS = ["run_id", "campaign", "loaded_at", "file", "time", "n", "m", "solsize", "recsteps", "finished", "VC-check", "size-check", "diff-to-opt", "last-k-diff-to-opt"]
_P5_PROFILE = (
    f"WITH once AS (SELECT DISTINCT * FROM {DOM}), c AS ("
    + " UNION ALL ".join(
        "SELECT load_id, '{0}' AS field, nullif({1}, '') AS v FROM once".format(
            c, f'CAST("{c}" AS VARCHAR)' if c != "loaded_at" else "regexp_replace(strftime(loaded_at, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '')"
        )
        for c in _PROFILE_COLS
    )
    + r"""), k AS (SELECT *, CASE WHEN regexp_full_match(v, '-?[0-9]+(\.[0-9]+)?') THEN TRY_CAST(v AS DOUBLE) END AS num FROM c)
SELECT load_id, field, count(*) AS n_rows, count(*) - count(v) AS nulls, count(DISTINCT v) AS n_distinct, min(v) AS min_text, max(v) AS max_text, min(num) AS min_number, max(num) AS max_number FROM k GROUP BY load_id, field"""
)
_BOTH = "SELECT 'vertex0' AS field, vertex0 AS vertex FROM bucketgraph UNION ALL SELECT 'vertex1', vertex1 FROM bucketgraph"

SQL = {
    "p2_found": _P2,
    "p2_statistics": _DRIFT + 'SELECT load_id, path, n, filled, whole, "decimal", "bool", "text", kind FROM stats',
    "p2_table": _P2_TABLE,
    "p2_failed_casts": _P2_FAILED,
    "p3_found": _P3,
    "p4_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_edges": _LINES + "SELECT line_id, file, replace(split_part(t, ' ', 1), '\"', '') AS vertex0, replace(split_part(t, ' ', 2), '\"', '') AS vertex1 FROM judged WHERE reason IS NULL",
    "p4_broken_fields": _LINES + rf"SELECT reason, CASE WHEN NOT regexp_matches(t, '^{_GOOD}(?: |$)') THEN 'vertex0' WHEN NOT regexp_matches(t, '^{_GOOD} {_GOOD}(?: |$)') THEN 'vertex1' END AS broken_field, count(*) AS n_lines FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": _P5,
    "p5_profile": _P5_PROFILE,
    "p6_found": f"SELECT field, vertex FROM ({_BOTH}) WHERE vertex IS NOT NULL GROUP BY field, vertex HAVING count(*) * 50 >= (SELECT count(*) FROM bucketgraph)",
    "p6_counts": f"SELECT field, vertex, count(*) AS n_rows FROM ({_BOTH}) GROUP BY field, vertex",
    "p6_degrees": """WITH e AS (SELECT file, vertex0 AS vertex, vertex1 AS other FROM bucketgraph WHERE vertex0 IS NOT NULL AND vertex1 IS NOT NULL
UNION ALL SELECT file, vertex1, vertex0 FROM bucketgraph WHERE vertex0 IS NOT NULL AND vertex1 IS NOT NULL AND vertex0 <> vertex1)
SELECT file, vertex, count(*) AS n_records, count(DISTINCT other) AS n_neighbours FROM e GROUP BY file, vertex""",
}
