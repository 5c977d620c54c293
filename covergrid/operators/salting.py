"""Per-key results when a few keys hold most rows.

Heavy keys are split by a salt, partial results are computed per salt and
merged by the original key. The salt is a hash of the row, not ``rand()``: a
lost task that is run again must send every row to the same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows looked at to find out which keys are heavy. It only decides how rows
#: are laid out; a key that the sample misses is merely not split.
SAMPLE_ROWS = 200_000
#: A key is heavy from this share of the rows on; so there are at most 500.
HEAVY_SHARE = 0.002
#: Keys of fewer rows are never split: they can't hold a task up.
HEAVY_ROWS = 10_000
SALTS = 64


def stack_fields(df: DataFrame, fields: list[str], *keep: Column) -> DataFrame:
    """One row (field, value, kept columns) per row and field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])
    return df.select(*keep, F.inline(pairs))


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE, rows: int | None = None) -> DataFrame:
    """Keys that hold at least ``share`` of a sample of the rows (at most
    ``1/share`` keys, which bounds any broadcast of them), and ``rows`` rows."""
    rows = HEAVY_ROWS if rows is None else rows
    n = df.count()
    if n < rows:
        return df.select(*keys).limit(0)
    part = df.select(*keys) if n <= SAMPLE_ROWS else df.select(*keys).sample(SAMPLE_ROWS / n, seed=7)
    least = max(2.0, min(n, SAMPLE_ROWS) * max(share, rows / n))
    return part.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*keys)


def salted_counts(df: DataFrame, fields: list[str], row_key: Column, salts: int = SALTS, share: float = HEAVY_SHARE) -> DataFrame:
    """Rows per (field, value), each field by itself.

    Returns ``field, value, n``. Null values give a row of their own with a
    null ``value``; an empty text is a value. Repeated rows count each time. An
    empty table gives an empty result. Other columns of ``df`` don't matter,
    whatever their names; ``row_key`` only spreads the rows of a heavy value.
    """
    heavy = heavy_keys(stack_fields(df, fields), ["field", "value"], share)
    seen = [(r.field, r.value) for r in heavy.collect()]  # at most 1/share keys
    rows = stack_fields(df, fields, row_key.alias("row_key"))
    light = rows
    if seen:
        is_heavy = F.lit(False)
        for f in fields:
            own = [v for g, v in seen if g == f]
            if own:
                is_heavy = is_heavy | ((F.col("field") == f) & F.col("value").isin(own))
        is_heavy = F.coalesce(is_heavy, F.lit(False))
        light = rows.where(~is_heavy)
        part = (
            rows.where(is_heavy)
            .withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(salts)))
            .groupBy("field", "value", "salt")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        merged = part.groupBy("field", "value").agg(F.sum("n").alias("n"))
        return light.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).unionByName(merged)
    return light.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def frequent_values(df: DataFrame, fields: list[str], row_key: Column, one_in: int) -> DataFrame:
    """``field, value, n`` of values that stand in at least one in ``one_in``
    rows; nulls aren't values."""
    total = df.count()
    return salted_counts(df, fields, row_key).where(F.col("value").isNotNull() & (F.col("n") * one_in >= total))


def salted_degrees(df: DataFrame, scope: str, ends: tuple[str, str], salts: int = SALTS) -> DataFrame:
    """Records and distinct neighbours of each vertex of a scope (graph file).

    ``scope, vertex, n_records, n_neighbours``. A record whose two ends are the
    same counts once; records with a null end don't count; an empty text is a
    vertex. Stage one is salted by the neighbour for every vertex in the heavy
    set, so that the distinct neighbours of two salts can't overlap and stage
    two only adds up.
    """
    a, b = (F.col(f"`{x}`") for x in ends)
    rows = df.select(F.col(f"`{scope}`").alias("scope"), a.alias("a"), b.alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("vertex"), F.col("b").alias("other")))).otherwise(
        F.array(F.struct(F.col("a").alias("vertex"), F.col("b").alias("other")), F.struct(F.col("b").alias("vertex"), F.col("a").alias("other")))
    )
    ends_ = rows.select("scope", F.inline(both))
    hot = [r.vertex for r in heavy_keys(ends_, ["vertex"]).collect()]  # at most 1/share keys
    salt = F.when(F.col("vertex").isin(hot), F.pmod(F.xxhash64("other"), F.lit(salts))).otherwise(F.lit(0)) if hot else F.lit(0)
    # one row per distinct pair first (combined before the shuffle), then per salt, then per vertex
    pairs = ends_.groupBy("scope", "vertex", "other").agg(F.count(F.lit(1)).alias("n"))
    part = pairs.withColumn("salt", salt.cast("int")).groupBy("scope", "vertex", "salt").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_neighbours"))
    return part.groupBy("scope", "vertex").agg(F.sum("n_records").alias("n_records"), F.sum("n_neighbours").alias("n_neighbours")).withColumnRenamed("scope", scope)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], row_key: Column, how: str = "inner", salts: int = SALTS, heavy: list | None = None) -> DataFrame:
    """Equi-join of many rows (left) with few rows a key (right).

    Rows of a heavy left key are spread over ``salts`` partitions, to each of
    which the key's right rows are copied; other keys join as usual. Heavy keys
    (at most ``1/share``) are found by a bounded sample unless given as a list
    of key tuples. Null keys match nothing, as in any equi-join. ``how`` is
    ``inner`` or ``left``.
    """
    if heavy is None:
        heavy = [tuple(r) for r in heavy_keys(left, keys).collect()]
    if not heavy:
        return left.join(right, keys, how)
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    kinds = dict(left.select(*keys).dtypes)
    known = [F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, t)]) for t in heavy]
    hot = F.coalesce(key.isin(*known), F.lit(False))
    many = left.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(row_key), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    few = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return many.join(few, [*keys, "_salt"], how).drop("_salt")
