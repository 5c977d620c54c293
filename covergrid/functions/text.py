"""Column functions over dirty text: normal forms, numbers and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_number(c: Column) -> Column:
    """Text of a time in a form that is equal exactly for equal times: null and
    empty are one value; digits with at most one point between them lose zeros
    that don't count, of any length; all else stays as it is."""
    text = F.coalesce(c, F.lit(""))
    whole = F.regexp_replace(F.regexp_extract(text, r"^0*([0-9]+?)(?:\.([0-9]*?)0*)?\z", 1), r"^\z", "0")
    part = F.regexp_extract(text, r"^0*([0-9]+?)(?:\.([0-9]*?)0*)?\z", 2)
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?\z"), F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))).otherwise(text)


def exact(c: Column) -> Column:
    """Text that tells null from every value."""
    return F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c.cast("string")))


def seconds(time: Column) -> Column:
    """A time as a number; null if it is blank or text (crash messages, nan)."""
    return F.when(time.rlike(r"^[ ]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ ]*\z"), F.trim(time).try_cast("double"))


def kind_of(v: Column) -> Column:
    """Kind of a value that isn't empty: whole, decimal, bool or text."""
    return (
        F.when(v.rlike(r"^[+-]?[0-9]+\z"), "whole")
        .when(v.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z|^[+-]?[0-9]+[eE][+-]?[0-9]+\z"), "decimal")
        .when(F.lower(v).isin("true", "false"), "bool")
        .otherwise("text")
    )
