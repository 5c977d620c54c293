"""Duplicates hidden by formatting differences.

Columns are dictionary-encoded: a task canonicalises each distinct value once
and gives it an integer identifier, records become sorted tuples of integers,
and the tuples are grouped. All is encoded in one pass, which writes the tuples
and, beside them, the dictionary with the number of records of each form.

The identifier of a canonical form is the same in every task without any
exchange between tasks: it is a 64-bit hash of the form. The dictionary over all
data proves it injective; forms that share a hash (none, as a rule) get reserved
numbers instead and the records are encoded again. So no record is shuffled to
be looked up, however heavy a value is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covergrid.operators.salting import heavy_keys
from covergrid.session import materialise

#: Identifiers below this are kept for forms whose hash isn't theirs alone. With
#: n forms about n * n / 2**65 need one: 3 of 10**10 forms, 30,000 of 10**12.
RESERVED = 1 << 20
#: A tuple with so many records, and a share of all (see ``heavy_keys``), is
#: aggregated before the shuffle instead of sorted with the others.
HEAVY_RECORDS = 50_000
#: Distinct values, and characters of them, that a task remembers at a time.
MEMORY, MEMORY_CHARS = 400_000, 32_000_000


def canonical(values: pa.Array) -> pa.Array:
    """Lower case, and letters and digits only; null where nothing is left."""
    form = pc.replace_substring_regex(pc.utf8_lower(values), r"[^\p{L}\p{N}]+", "")
    return pc.if_else(pc.equal(form, ""), pa.scalar(None, form.type), form)


def identifiers(forms: list, domain: int, reserved: dict[tuple[int, str], int]) -> np.ndarray:
    """Integer identifier of each canonical form (0 stands for null)."""
    out = np.zeros(len(forms), "int64")
    hashed = xxhash.xxh3_64_intdigest
    for i, form in enumerate(forms):
        if form is not None:
            h = hashed(form.encode(), domain)
            h -= (h >> 63) << 64
            out[i] = h + RESERVED * 2 if -RESERVED < h < RESERVED else h
    if reserved:
        for i, form in enumerate(forms):
            out[i] = reserved.get((domain, form), out[i])
    return out


class _Dictionary:
    """What a task knows of one domain: identifiers by value, and the number of
    records by canonical form."""

    def __init__(self, domain: int, exact: bool, reserved: dict):
        self.domain, self.exact, self.reserved = domain, exact, reserved
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str | None, int] = {None: 0}
        self.forms: dict[str, list[int]] = {}  # form: identifier, records
        self.form_of: dict[str, str] = {}
        self.chars = 0

    def encode(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        distinct, at = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        values = distinct.to_pylist()
        unknown = [k for k, v in enumerate(values) if v not in self.ids]
        if unknown:
            fresh = distinct.take(pa.array(unknown))
            forms = (fresh if self.exact else canonical(fresh)).to_pylist()
            for k, form, i in zip(unknown, forms, identifiers(forms, self.domain, self.reserved).tolist()):
                self.ids[values[k]] = i
                self.chars += len(values[k])
                if form is not None:
                    self.forms.setdefault(form, [i, 0])
                    self.form_of[values[k]] = form
        for v, n in zip(values, np.bincount(at + 1, minlength=len(values) + 1)[1:].tolist()):
            form = self.form_of.get(v)
            if form is not None:
                self.forms[form][1] += n
        return np.array([*[self.ids[v] for v in values], 0], "int64")[at]  # index -1 is the 0 at the end

    def full(self) -> bool:
        return len(self.ids) > MEMORY or self.chars > MEMORY_CHARS


#: Kinds of rows that encoding writes.
RECORD, REJECTED, FORM = 0, 1, 2


def _encoder(exact: int, fields: int, reserved: dict):
    """Rows ``kind, id, x..., t..., domain, form, n``: tuples of records (null
    fields make them rejected), and forms with their identifier in ``t0``. The
    exact columns stay as written; each is a domain of its own, the others share
    one."""
    numbers = [f"x{i}" for i in range(exact)] + [f"t{i}" for i in range(fields)]
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), *[(c, pa.int64()) for c in numbers], ("domain", pa.int32()), ("form", pa.string()), ("n", pa.int64())])

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_Dictionary(k, k < exact, reserved) for k in range(exact + 1)]

        def spell(d: _Dictionary) -> pa.RecordBatch:
            ids, counts = zip(*d.forms.values())
            m = len(ids)
            return batch(m, kind=pa.array(np.full(m, FORM, "int32")), domain=pa.array(np.full(m, d.domain, "int32")), t0=pa.array(ids, pa.int64()), form=pa.array(list(d.forms), pa.string()), n=pa.array(counts, pa.int64()))

        for b in batches:
            cols = [known[min(k, exact)].encode(c) for k, c in enumerate(b.columns[1:])]
            body = np.stack(cols[exact:], 1)
            kind = np.where((body != 0).all(1), RECORD, REJECTED).astype("int32")
            body = np.sort(body, 1)
            made = {f"x{i}": pa.array(c) for i, c in enumerate(cols[:exact])} | {f"t{i}": pa.array(np.ascontiguousarray(body[:, i])) for i in range(fields)}
            yield batch(b.num_rows, kind=pa.array(kind), id=b.column(0), **made)
            for d in known:
                if d.full():
                    if d.forms:
                        yield spell(d)
                    d.forget()
        for d in known:
            if d.forms:
                yield spell(d)

    return run, numbers, "kind int, id bigint, " + ", ".join(f"{c} bigint" for c in numbers) + ", domain int, form string, n bigint"


class FormatDuplicates:
    """Sets of records that are equal in their ``exact`` columns as written and
    in their ``fields`` up to case, punctuation, white space and field order.

    A record with a field that is null or has no letter or digit is a copy of
    nothing; a null in an exact column equals null. ``id`` names a record;
    records repeated exactly are copies like others (with the same ``id`` they
    are one copy). Other columns of ``df`` aren't read. An empty table gives
    empty results.
    """

    def __init__(self, df: DataFrame, id: str, exact: list[str], fields: list[str]):
        self.exact, self.fields = exact, fields
        q = lambda c: F.col(f"`{c}`")
        self.rows = df.select(q(id).cast("bigint").alias("id"), *[q(c).cast("string").alias(f"e{i}") for i, c in enumerate(exact)], *[q(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])

        self._written: DataFrame | None = None

    def _encode(self, reserved: dict) -> DataFrame:
        run, self.names, schema = _encoder(len(self.exact), len(self.fields), reserved)
        return materialise(self.rows.mapInArrow(run, schema))

    def encoded(self) -> DataFrame:
        """Tuples and dictionary, encoded once; again only if forms share a hash."""
        if self._written is None:
            self._written = self._encode({})
            taken = self.reserved()
            if taken:
                self._written = self._encode(taken)
        return self._written

    def dictionary(self) -> DataFrame:
        """``domain, id, form, n`` of each distinct canonical form of all data,
        with the number of records that hold it."""
        return self.encoded().where(F.col("kind") == FORM).groupBy("domain", F.col("t0").alias("id"), "form").agg(F.sum("n").alias("n"))

    def reserved(self) -> dict[tuple[int, str], int]:
        """Forms that share a hash, with their own numbers. What is collected
        is bounded by the chance of collisions, see RESERVED."""
        forms = self.encoded().where(F.col("kind") == FORM).select("domain", F.col("t0").alias("id"), "form").distinct()
        shared = forms.groupBy("domain", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("domain", "id").collect()
        if not shared:
            return {}
        found = forms.join(F.broadcast(self.rows.sparkSession.createDataFrame(shared, "domain int, id bigint")), ["domain", "id"]).select("domain", "form").distinct().orderBy("domain", "form").collect()
        if len(found) >= RESERVED:
            raise ValueError("more forms share a hash than identifiers are kept for them")
        return {(r.domain, r.form): i + 1 for i, r in enumerate(found)}

    def tuples(self) -> tuple[DataFrame, list[str]]:
        """``id`` and the integers of each record that can have copies."""
        written = self.encoded()
        return written.where(F.col("kind") == RECORD).select("id", *self.names), self.names

    def collapsed(self) -> DataFrame:
        """``first_id, n_copies`` of each distinct record, single ones too. The
        records that are a copy of nothing aren't here but in ``rejected``, so
        both together hold each record once. Counts are combined before the
        shuffle, so a tuple of any weight is a few rows there."""
        tuples, names = self.tuples()
        return tuples.groupBy(*names).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")).select("first_id", "n_copies")

    def rejected(self) -> DataFrame:
        """``first_id, n_copies`` (1) of each record with a field that is null
        or has no letter or digit; a row each, repeated ones too."""
        return self.encoded().where(F.col("kind") == REJECTED).select(F.col("id").alias("first_id"), F.lit(1).cast("bigint").alias("n_copies"))

    def copies(self) -> DataFrame:
        """``first_id, copy_id``: the smallest ``id`` of each set, and one row
        for each other ``id`` of it. Sets that hold a great part of all records
        are reduced to their smallest ``id`` before the shuffle and their records
        stay where they are; all others are brought together once."""
        tuples, names = self.tuples()
        heavy = [tuple(r) for r in heavy_keys(tuples, names, rows=HEAVY_RECORDS).collect()]  # at most 500
        key = F.struct(*names)
        hot = key.isin(*[F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(names, t)]) for t in heavy]) if heavy else F.lit(False)
        light = tuples.where(~hot).withColumn("first_id", F.min("id").over(Window.partitionBy(*names)))
        out = light.select("first_id", "id")
        if heavy:
            rows = tuples.where(hot)
            least = rows.groupBy(*names).agg(F.min("id").alias("first_id"))
            out = out.unionByName(rows.join(F.broadcast(least), names).select("first_id", "id"))
        return out.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
