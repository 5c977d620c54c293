"""Edge lines as a stream: folders of text files that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from covergrid.operators import linecheck

ENDS = ["vertex0", "vertex1"]


def read_lines(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)


def edges(lines: DataFrame) -> DataFrame:
    """Canonical edges ``u, v`` of a stream of lines, loops left out, repeats kept."""
    p = linecheck.edges(lines, ENDS).where("vertex0 <> vertex1")
    return p.select(F.least(*ENDS).alias("u"), F.greatest(*ENDS).alias("v"))


def degrees(lines: DataFrame) -> DataFrame:
    """Running degree of each vertex, each distinct edge counted once. State is
    one row per edge and vertex, kept by key over all executors."""
    e = edges(lines).dropDuplicates(["u", "v"])
    return e.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))


def to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
