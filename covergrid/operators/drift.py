"""Schemas that drift between files: one typed table and a report of changes.

Raw lines become path-value pairs with their raw kind, statistics are
aggregated per file and path, consecutive files of a campaign are compared, and
typed columns are projected along the renames, with every failed cast reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covergrid.functions.text import kind_of
from covergrid.operators.salting import skew_join
from covergrid.session import materialise

PAD = " \t\r\n"
#: The fixed fields of the table, with their types.
FIXED = {
    "file": "string", "time": "double", "n": "int", "m": "int", "solsize": "int", "recsteps": "bigint", "finished": "int",
    "VC-check": "string", "size-check": "string", "diff-to-opt": "int", "last-k-diff-to-opt": "int",
}
#: Other names of a fixed field; the header of one configuration has a name of its own.
ALIASES = {"last-k-diff-to-opttime": "last-k-diff-to-opt"}
KINDS = ("whole", "decimal", "bool", "text")


def _order():
    """Loads of a campaign in order (a row per load); those without one are
    each alone."""
    return Window.partitionBy("campaign", F.when(F.col("campaign").isNull(), F.col("load_id"))).orderBy("written_at", "load_id")


def _cells(value):
    return F.transform(F.split(value, ";"), lambda c: F.btrim(c, F.lit(PAD)))


class DriftReader:
    """Lines ``(load_id, campaign, written_at, line_no, value)`` of CSV files.

    Line 1 of a load is its header; a load without one has no fields. Null
    lines are skipped. A cell beyond the header is no field (``table`` keeps it
    under its position); a missing cell is empty. If a header repeats a name, the
    first counts. Loads of one campaign are ordered by ``written_at``, then by
    ``load_id``; loads without a campaign are compared with nothing. Repeated
    lines count as often as they stand there. Further columns are ignored.

    Cells are aggregated by load and position, and only the aggregates meet the
    names of the header, so no line is joined to be counted.
    """

    def __init__(self, lines: DataFrame):
        base = lines.select("load_id", "campaign", "written_at", F.col("line_no").cast("bigint").alias("line_no"), "value").where("value IS NOT NULL AND load_id IS NOT NULL")
        self.body = base.where("line_no > 1").select("load_id", "line_no", "value")
        # a few rows a load: combined before the shuffle
        seen = base.select("load_id", "campaign", "written_at", F.when(F.col("line_no") == 1, F.col("value")).alias("head")).distinct()
        loads = seen.groupBy("load_id").agg(F.min("campaign").alias("campaign"), F.min("written_at").alias("written_at"), F.min(F.when(F.col("head").isNotNull(), _cells(F.col("head")))).alias("names"))
        once = F.transform("names", lambda x, i: F.when(F.array_position(F.col("names"), x) == i + 1, x).otherwise(F.lit("")))
        self.loads = materialise(loads.select("load_id", "campaign", F.lag("load_id").over(_order()).alias("prev_id"), "written_at", F.coalesce(once, F.array().cast("array<string>")).alias("names")).withColumn("prev_id", F.when(F.col("campaign").isNotNull(), F.col("prev_id"))))

    def fields(self) -> DataFrame:
        """``load_id, path, position`` of each header, empty names left out."""
        return self.loads.select("load_id", F.posexplode("names").alias("position", "path")).where("path <> ''")

    def _counted(self) -> DataFrame:
        """``loads`` with ``fields``: an array of (path, position, n, filled, whole,
        decimal, bool, text, kind) for each named field of its header."""
        width = self.loads.agg(F.coalesce(F.max(F.size("names")), F.lit(0))).first()[0]  # cells beyond any header aren't counted
        v = self.body.select("load_id", F.posexplode(F.slice(_cells(F.col("value")), 1, width)).alias("position", "value")).select("load_id", "position", F.when(F.col("value") != "", kind_of(F.col("value"))).alias("kind"))
        s = v.groupBy("load_id", "position").agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("filled"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS])
        per = s.groupBy("load_id").agg(F.collect_list(F.struct("position", "n", "filled", *KINDS)).alias("cells"))  # a header's length at most
        at = lambda i: F.get(F.filter("cells", lambda x: x["position"] == i), F.lit(0))
        lines = F.get(F.filter("cells", lambda x: x["position"] == 0), F.lit(0))["n"]  # each line has a first cell
        counted = lambda c: F.when(F.col("lines").isNotNull(), F.coalesce(c, F.lit(0)))
        both = self.loads.join(per, "load_id", "left").withColumn("lines", lines)
        fields = F.transform("names", lambda x, i: F.struct(x.alias("path"), i.alias("position"), F.col("lines").alias("n"), *[counted(at(i)[k]).alias(k) for k in ("filled", *KINDS)]))
        both = both.withColumn("fields", F.filter(fields, lambda f: f["path"] != ""))

        def kind(f):
            out = F.lit(None).cast("string")
            for k in KINDS:
                out = F.when(f[k] * 2 > f["filled"], F.lit(k)).otherwise(out)
            return out

        return both.withColumn("fields", F.transform("fields", lambda f: f.withField("kind", kind(f)))).drop("cells", "lines")

    def statistics(self) -> DataFrame:
        """Counts of each kind by load and path, and the kind that more than
        half of the filled values have (null if none)."""
        return self._counted().select("load_id", F.inline("fields"))

    def _pairs(self) -> DataFrame:
        """``load_id, prev_id, gone, new, retyped`` of each load and the one
        before: arrays of (path, position, kind), no longer than a header."""
        both = self._counted().withColumn("now", F.transform("fields", lambda f: F.struct(f["path"].alias("path"), f["position"].alias("position"), f["kind"].alias("kind"))))
        both = both.withColumn("was", F.lag("now").over(_order())).where("prev_id IS NOT NULL")
        there = lambda xs, x: F.exists(xs, lambda y: y["path"] == x["path"])
        other = lambda xs, x: F.exists(xs, lambda y: (y["path"] == x["path"]) & (y["kind"] != x["kind"]))
        return both.select("load_id", "prev_id", F.filter("was", lambda x: ~there("now", x)).alias("gone"), F.filter("now", lambda x: ~there("was", x)).alias("new"), F.filter("now", lambda x: F.coalesce(other("was", x), F.lit(False))).alias("retyped"))

    def _same(self, pairs: DataFrame) -> DataFrame:
        """``load_id, fits``: (position before, position now) of gone and new
        fields that hold the same set of values for each graph in both loads.
        A set of values is compared by its size and 128 bits of hash."""
        asked = pairs.where("size(gone) > 0 AND size(new) > 0")
        sides = F.array(*[F.struct(F.col(i).alias("load_id"), F.lit(k).alias("side"), F.col(c)["position"].alias("wanted")) for k, i, c in ((0, "prev_id", "gone"), (1, "load_id", "new"))])
        wanted = asked.select(F.col("load_id").alias("pair"), F.inline(sides))
        rows = skew_join(self.body, wanted, ["load_id"], F.col("line_no")).select("pair", "side", "wanted", _cells(F.col("value")).alias("cells"))
        cells = rows.select("pair", "side", F.get("cells", 0).alias("graph"), F.inline(F.transform("wanted", lambda p: F.struct(p.alias("position"), F.coalesce(F.get("cells", p), F.lit("")).alias("value")))))
        digest = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("value")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "value")).alias("y"))
        sets = cells.distinct().groupBy("pair", "graph", "side", "position").agg(digest.alias("h"))
        side = lambda k: F.collect_list(F.when(F.col("side") == k, F.struct("position", "h")))
        met = sets.groupBy("pair", "graph").agg(side(0).alias("old"), side(1).alias("new")).where("size(old) > 0 AND size(new) > 0")
        each = met.select("pair", F.explode("old").alias("o"), "new").select("pair", "o", F.explode("new").alias("n"))
        equal = each.groupBy("pair", F.col("o.position").alias("before"), F.col("n.position").alias("now")).agg(F.min(F.col("o.h") == F.col("n.h")).alias("equal"))
        return equal.where("equal").groupBy(F.col("pair").alias("load_id")).agg(F.collect_list(F.struct("before", "now")).alias("fits"))

    def changes(self) -> DataFrame:
        """``load_id, change, old_name, new_name`` against the load before.

        A gone and a new name are a rename if, for the graphs in both loads (at
        least one), they hold the same set of values for each. If several fit,
        the closest spelling wins, each name once.
        """
        pairs = materialise(self._pairs())
        found = pairs.join(self._same(pairs), "load_id", "left")
        name = lambda xs, p: F.get(F.filter(xs, lambda x: x["position"] == p), F.lit(0))["path"]
        named = F.transform(F.coalesce("fits", F.array().cast("array<struct<before:int,now:int>>")), lambda f: F.struct(name("gone", f["before"]).alias("old_name"), name("new", f["now"]).alias("new_name")))
        ranked = F.transform(named, lambda f: F.struct(F.levenshtein(F.lower(f["old_name"]), F.lower(f["new_name"])).alias("d"), f["old_name"].alias("old_name"), f["new_name"].alias("new_name")))
        found = found.select("load_id", "gone", "new", "retyped", ranked.alias("fits"))
        beaten = lambda f, c: F.exists("fits", lambda g: (g[c] == f[c]) & (g < f))
        found = found.select("load_id", "gone", "new", "retyped", F.filter("fits", lambda f: ~beaten(f, "old_name") & ~beaten(f, "new_name")).alias("renamed"))
        row = lambda change, old, new: F.struct(F.lit(change).alias("change"), old.alias("old_name"), new.alias("new_name"))
        none = F.lit("")
        left = lambda xs, c: F.filter(xs, lambda x: ~F.exists("renamed", lambda r: r[c] == x["path"]))
        report = F.concat(
            F.transform("renamed", lambda r: row("renamed", r["old_name"], r["new_name"])),
            F.transform(left("gone", "old_name"), lambda x: row("removed", x["path"], none)),
            F.transform(left("new", "new_name"), lambda x: row("added", none, x["path"])),
            F.transform("retyped", lambda x: row("retyped", x["path"], x["path"])),
        )
        return found.select("load_id", F.inline(report))

    def lineage(self) -> DataFrame:
        """``load_id, path, root``: the name under which a field first stood in
        its campaign, following renames; by pointer doubling, so a chain of k
        loads takes log2(k) joins."""
        fields = self.fields().join(self.loads.select("load_id", "prev_id"), "load_id")
        renamed = self.changes().where("change = 'renamed'").select("load_id", F.col("new_name").alias("path"), "old_name")
        before = self.fields().select(F.col("load_id").alias("prev_id"), F.col("path").alias("old"))
        step = fields.join(renamed, ["load_id", "path"], "left").withColumn("old", F.coalesce("old_name", "path")).join(before.withColumn("there", F.lit(True)), ["prev_id", "old"], "left")
        node = materialise(step.select("load_id", "path", F.when(F.col("there"), F.col("prev_id")).alias("p_load"), F.when(F.col("there"), F.col("old")).alias("p_path"), F.col("path").alias("root")))
        # root: the name at the end of the pointer followed so far
        node = node.withColumn("root", F.coalesce("p_path", "path"))
        while not node.where("p_load IS NOT NULL").isEmpty():
            nxt = node.select(F.col("load_id").alias("p_load"), F.col("path").alias("p_path"), F.col("p_load").alias("q_load"), F.col("p_path").alias("q_path"), F.col("root").alias("q_root"))
            node = materialise(node.join(nxt, ["p_load", "p_path"], "left").select("load_id", "path", F.col("q_load").alias("p_load"), F.col("q_path").alias("p_path"), F.coalesce("q_root", "root").alias("root")))
        return node.select("load_id", "path", "root")

    def table(self) -> DataFrame:
        """All rows under the fixed fields, as text; further fields in the map
        ``extra`` by name, cells beyond the header in the map ``overflow`` by
        position (from 1). ``project`` types them."""
        plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
        names = [(x, x) for x in FIXED] + list(ALIASES.items())
        target = F.lit(None).cast("string")
        for name, to in names:
            target = F.when(plain(F.col("root")) == "".join(ch for ch in name.lower() if ch.isalnum()), to).otherwise(target)
        # the first field is the graph file, whatever its name
        named = self.lineage().join(self.fields(), ["load_id", "path"]).withColumn("target", F.when(F.col("position") == 0, "file").otherwise(target))
        once = Window.partitionBy("load_id", "target").orderBy("position")  # a header's names
        named = named.withColumn("fixed", F.col("target").isNotNull() & (F.row_number().over(once) == 1))
        cell = F.struct(F.when(F.col("fixed"), F.col("target")).otherwise(F.col("path")).alias("name"), "position")
        kept = lambda fixed: F.collect_list(F.when(F.col("fixed") == fixed, cell))
        per_load = self.loads.select("load_id", F.size("names").alias("width")).join(named.groupBy("load_id").agg(kept(True).alias("fixed"), kept(False).alias("more")), "load_id", "left")
        rows = skew_join(self.body, per_load, ["load_id"], F.col("line_no")).withColumn("cells", _cells(F.col("value")))
        none = F.array().cast("array<struct<name:string,position:int>>")
        filled = lambda xs: F.map_from_entries(F.transform(F.coalesce(xs, none), lambda x: F.struct(x["name"], F.coalesce(F.get("cells", x["position"]), F.lit("")))))
        beyond = F.slice("cells", F.col("width") + 1, F.greatest(F.size("cells") - F.col("width"), F.lit(0)))
        over = F.map_from_entries(F.transform(beyond, lambda c, i: F.struct(i + F.col("width") + 1, c)))
        flat = rows.select("load_id", "line_no", filled("fixed").alias("kv"), filled("more").alias("extra"), over.alias("overflow"))
        return flat.select("load_id", "line_no", *[F.nullif(F.element_at("kv", F.lit(f)), F.lit("")).alias(f) for f in FIXED], "extra", "overflow")

    def project(self) -> tuple[DataFrame, DataFrame]:
        """The typed table, and ``load_id, line_no, field, value`` of each value
        that its field's type can't hold (null in the table)."""
        raw = self.table()
        typed = raw.select("load_id", "line_no", *[F.col(f"`{f}`").try_cast(t).alias(f) for f, t in FIXED.items()], "extra", "overflow")
        cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value"), F.col(f"`{f}`").try_cast(t).isNull().alias("bad")) for f, t in FIXED.items() if t != "string"])
        failed = raw.select("load_id", "line_no", F.inline(cells)).where("bad AND value IS NOT NULL").drop("bad")
        return typed, failed
