"""Differences between two copies of a dataset.

Both copies go through one range partitioning (shared split points), each
partition is sorted by key and side, and a merge reads the two interleaved
sides once, batch by batch, keeping only the last key between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covergrid.functions.text import exact, plain_number  # noqa: F401  (normal forms for ``fields``)


def _merge(names: list[str], n_keys: int) -> "callable":
    """A streaming merge of rows sorted by key and side (0 before 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # a last row whose partner may be in the next batch
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            t = pa.concat_tables([held, t]) if held is not None else t
            paired = t.num_rows > 1 and all(_equal(t.slice(t.num_rows - 2)[c].combine_chunks(), 2)[0] for c in t.column_names[:n_keys])
            held = None if paired else t.slice(t.num_rows - 1)
            yield from emit(t, last=paired)
        if held is not None:
            yield from emit(held, last=True)

    def emit(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        side = t["side"].to_numpy()
        same = np.ones(max(n - 1, 0), bool)  # row i and i + 1 have one key
        cols = [t[c].combine_chunks() for c in t.column_names]
        for c in cols[:n_keys]:
            same &= _equal(c, n)
        starts = np.ones(n, bool)
        starts[1:] = ~same
        ends = np.ones(n, bool)
        ends[:-1] = ~same
        if not last:
            ends[-1] = False  # its partner may be in the next batch
        alone = starts & ends
        take, what = [np.flatnonzero(alone)], [np.where(side[alone] == 0, 0, 1)]
        for k, c in enumerate(cols[n_keys + 1 :]):
            differ = np.flatnonzero(same & ~_equal(c, n))
            take.append(differ)
            what.append(np.full(len(differ), 2 + k))
        at, kinds = np.concatenate(take), np.concatenate(what)
        if len(at):
            labels = np.array(["missing_in_right", "missing_in_left", *names], object)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in cols[:n_keys]] + [pa.array(labels[kinds], pa.string())], [*t.column_names[:n_keys], "difference"])

    def _equal(c: pa.Array, n: int) -> np.ndarray:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return codes[1:] == codes[:-1] if n > 1 else np.ones(0, bool)

    return run


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, tuple[Column, Column]], parts: int | None = None) -> DataFrame:
    """``keys..., difference`` for two copies: ``missing_in_right``,
    ``missing_in_left`` or the name of each unequal field.

    ``fields`` maps a name to its normalised, never null expression on either
    side. Rows repeated exactly count once; if rows of one key differ on one
    side, each field stands for its least and greatest value there. Null keys
    are a key like any other. Copies of a key are combined before the shuffle,
    so a key of any weight sends a few rows. Empty tables give the other side's
    keys as missing. Extra columns are never read.
    """
    names = list(fields)

    def one(df: DataFrame, side: int) -> DataFrame:
        picked = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], *[fields[f][side].alias(f"f{i}") for i, f in enumerate(names)])
        return picked.select(*[f"k{i}" for i in range(len(keys))], F.lit(side).alias("side"), *[f"f{i}" for i in range(len(names))])

    ks = [f"k{i}" for i in range(len(keys))]
    rows = one(left, 0).unionByName(one(right, 1))
    folded = rows.groupBy(*ks, "side").agg(*[F.min(f"f{i}").alias(f"l{i}") for i in range(len(names))], *[F.max(f"f{i}").alias(f"h{i}") for i in range(len(names))])
    flat = folded.select(*ks, "side", *[F.struct(f"l{i}", f"h{i}").alias(f"f{i}") for i in range(len(names))])
    # one value as it is, else both, told apart by the first sign
    spell = lambda l, h: F.when(l == h, F.concat(F.lit("="), l)).otherwise(F.concat(F.length(l).cast("string"), F.lit(":"), l, h))
    flat = flat.select(*ks, "side", *[spell(F.col(f"f{i}.l{i}"), F.col(f"f{i}.h{i}")).alias(f"f{i}") for i in range(len(names))])
    ranged = (flat.repartitionByRange(parts, *ks) if parts else flat.repartitionByRange(*ks)).sortWithinPartitions(*ks, "side")
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
    out = ranged.mapInArrow(_merge(names, len(keys)), ", ".join(f"{k} {kinds[k]}" for k in ks) + ", difference string")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "difference")
