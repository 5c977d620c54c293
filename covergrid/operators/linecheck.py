"""Rows that fail to parse: valid edges of edge-list lines, and why others fail.

One anchored pattern generated from the schema accepts whole rows. Only rows
that fail it meet the prefix patterns, which grow by one field each and so tell
the first broken field; the reason is read from what follows the good prefix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "[A-Za-z0-9_]+"
#: A field as it should be, and one that is only bare or wrapped whole in quotes.
GOOD = f'(?:{NAME}|"{NAME}")'
LOOSE = '(?:[^" ]*|"[^"]*")'
PAD = " \t\r"


def record_text(value: Column) -> Column:
    """The part of a line that holds its record: padding and comment dropped,
    null if it holds none. Spaces, tabs and carriage returns at both ends don't
    count; a ``#`` before the first space (or without any space) voids the line;
    a later one starts a comment."""
    line = F.btrim(value, F.lit(PAD))
    mark, space = F.instr(line, "#"), F.instr(line, " ")
    void = (line == "") | ((mark > 0) & ((space == 0) | (mark < space)))
    return F.when(~void, F.when(mark > 0, F.rtrim(F.substring_index(line, "#", 1), F.lit(" \t"))).otherwise(line))


def row_pattern(fields: list[str], field: str = GOOD) -> str:
    return "^" + " ".join(f"({field})" for _ in fields) + r"\z"


def prefix_patterns(fields: list[str]) -> list[str]:
    """Pattern k takes the first k + 1 fields, all good, each after a space."""
    return ["^" + f" {GOOD}" * k + r"(?= |\z)" for k in range(1, len(fields) + 1)]


def _fence(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, whatever filters follow: the
    optimiser copies no expression through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def records(df: DataFrame, fields: list[str], value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``k0..., text, whole`` of each line that holds a record."""
    kept = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)]
    held = df.select(*kept, F.explode(F.filter(F.array(record_text(F.col(f"`{value}`"))), lambda t: t.isNotNull())).alias("text"))
    return _fence(held, F.col("text").rlike(row_pattern(fields)).alias("whole"))


def failures(held: DataFrame, fields: list[str]) -> DataFrame:
    """``k0..., text, broken_field, reason`` of the failing ``records``.

    The prefix patterns tell how many leading fields are good, which names the
    broken one (null if all are good and more columns follow). What follows the
    good prefix gives the reason: ``quoting`` if it isn't a row of bare and
    quoted columns, else ``columns`` if their number is wrong, else ``value``.
    """
    bad = held.where("NOT whole").drop("whole")
    n = len(fields)
    line = F.concat(F.lit(" "), F.col("text"))
    steps = [line.rlike(p) for p in prefix_patterns(fields)]
    good = reduce(lambda k, i: F.when(~steps[i], i).otherwise(k), reversed(range(n)), F.lit(n))
    bad = _fence(bad, good.cast("int").alias("good"))
    rest = reduce(lambda r, k: F.when(F.col("good") == k, F.regexp_replace(line, prefix_patterns(fields)[k - 1], "")).otherwise(r), range(1, n + 1), line)
    bad = _fence(bad, rest.alias("rest"))
    columns = reduce(lambda c, k: F.when(F.col("good") == k, F.col("rest").rlike("^" + f" {LOOSE}" * (n - k) + r"\z")).otherwise(c), range(n + 1), F.lit(False))
    reason = F.when(~F.col("rest").rlike(f"^(?: {LOOSE})*" + r"\z"), "quoting").when(~columns, "columns").otherwise("value")
    broken = F.get(F.array(*[F.lit(f) for f in fields]), F.col("good"))
    return _fence(bad, broken.alias("broken_field"), reason.alias("reason")).drop("good", "rest")


def valid(held: DataFrame, fields: list[str]) -> DataFrame:
    """``k0..., fields...`` of the valid ``records``, without their quotes."""
    kept = [c for c in held.columns if c not in ("text", "whole")]
    # null for other lines: the optimiser may look at later casts before the filter
    cells = F.split(F.when(F.col("whole"), F.translate("text", '"', "")), " ")
    return held.where("whole").select(*kept, *[F.get(cells, i).alias(f) for i, f in enumerate(fields)])


def parse(df: DataFrame, fields: list[str], value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds nothing to the columns ``keep``; returns them with the parsed
    ``fields``, ``reason`` and ``broken_field``.

    A valid line has ``reason`` null. A failing line has null fields, a reason
    (``quoting`` before ``columns`` before ``value``) and the name of the first
    field that breaks the schema (null if all named fields are good and further
    columns follow). Null, blank and comment lines hold no record and don't come
    out. Repeated lines come out each time. Only ``value`` and ``keep`` are read,
    so other columns may have any name.
    """
    held = records(df, fields, value, keep)
    names = {f"k{i}": k for i, k in enumerate(keep)}
    none = F.lit(None).cast("string")
    good = valid(held, fields).select(*[F.col(k).alias(names[k]) for k in names], *fields, none.alias("reason"), none.alias("broken_field"))
    bad = failures(held, fields).select(*[F.col(k).alias(names[k]) for k in names], *[none.alias(f) for f in fields], "reason", "broken_field")
    return good.unionByName(bad)


def rejects(df: DataFrame, fields: list[str], value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The failing lines of ``parse`` alone: ``keep``, ``reason``, ``broken_field``."""
    bad = failures(records(df, fields, value, keep), fields)
    return bad.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "reason", "broken_field")


def edges(df: DataFrame, fields: list[str], value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The valid lines of ``parse`` alone: ``keep`` and ``fields``."""
    good = valid(records(df, fields, value, keep), fields)
    return good.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *fields)
