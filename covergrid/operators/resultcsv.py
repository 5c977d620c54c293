"""Pipeline for benchmark results: filter, sort, running total, time per step,
and the common rows of several configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covergrid.functions.text import seconds
from covergrid.session import materialise


def valid(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn("seconds", seconds(F.col(f"`{time}`"))).where("seconds IS NOT NULL")


def sort_by_time(df: DataFrame, tie: str) -> DataFrame:
    return valid(df).orderBy("seconds", tie)


def running_total(df: DataFrame, file: str, order: list[str]) -> DataFrame:
    """``total``: running sum of the valid times within each result file.

    A file may be of any size: rows are range-partitioned by file and order, each
    partition sums its own part of a file, and adds what the partitions before
    it hold of that file (a row per file and partition). ``order`` should be
    unique within a file; ties come in no fixed order.
    """
    keys = [file, *order]
    placed = materialise(valid(df).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(file, "_part").agg(F.sum("seconds").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(file).orderBy("_part")) - F.col("_sum")).drop("_sum")
    here = F.sum("seconds").over(Window.partitionBy(file, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.col(f"l.{file}").eqNullSafe(F.col(f"r.{file}")) & (F.col("l._part") == F.col("r._part"))
    joined = placed.withColumn("_here", here).alias("l").join(before.alias("r"), own)
    return joined.select("l.*", (F.col("_here") + F.col("_before")).alias("total")).drop("_part", "_here")


def time_per_step(df: DataFrame) -> DataFrame:
    """``per_step``: time by steps; 0 where the time isn't valid or there are
    no steps."""
    return df.withColumn("per_step", F.coalesce(F.try_divide(seconds(F.col("time")), F.col("recsteps")), F.lit(0.0)))


def intersect(configs: list[DataFrame], key: str = "file") -> DataFrame:
    """Best positive time of each configuration, for keys that all have:
    ``key, time1, time2, ...``."""
    best = [valid(c).where("seconds > 0").groupBy(key).agg(F.min("seconds").alias(f"time{i + 1}")) for i, c in enumerate(configs)]
    return reduce(lambda a, b: a.join(b, key), best)
