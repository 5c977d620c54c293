"""Column-level quality profile, and changes of distribution between loads.

Exact base aggregates per load and field; rule violations; and a classifier
two-sample test: logistic regressions are trained to tell a load from the one
before. ``findings`` trains one on each field alone (all other columns ablated):
its discrimination proposes the changes, exact aggregates confirm them. ``drift``
trains one on all fields; its cross-fitted discrimination (area under the ROC
curve) says whether two loads differ, and the drop when a column is neutralised
says where.

The regressions are trained on counted cells: rows with equal features are one
weighted cell, combined before the shuffle, so a load of any size is a bounded
number of cells and all models of a load are trained where its cells lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covergrid.session import materialise

NAME = "[A-Za-z0-9_]+"
FIELDS = ("time", "finished", "VC-check", "diff-to-opt")


def checked(df: DataFrame) -> DataFrame:
    """Rows once each, with null and violation flags of the four fields:
    ``load_id, campaign, run_id, time, num, n{i}, bad{i}, hit{i}``. ``hit`` is
    the event whose share is watched (for ``time`` none)."""
    once = df.select("run_id", "campaign", "load_id", "loaded_at", "file", "time", "n", "m", "solsize", "recsteps", "finished", "`VC-check`", "`size-check`", "`diff-to-opt`", "`last-k-diff-to-opt`").distinct()
    t, fin, vc, diff, sol = (F.col(f"`{c}`") for c in (*FIELDS, "solsize"))
    null = [t.isNull() | (t == ""), fin.isNull(), vc.isNull() | (vc == ""), diff.isNull()]
    bad = [
        ~t.rlike(r"^[0-9]+(\.[0-9]+)?\z"),
        ~fin.isin(0, 1),
        ~vc.rlike(rf"^(OK|Not a VC:|Not a VC: Uncovered edge: {NAME} {NAME})\z"),
        (diff < 0) | F.coalesce(diff > sol, F.lit(False)),
    ]
    hit = [F.lit(False), fin == 1, vc == "OK", diff == 0]
    top = F.lit("9" * 27).cast("decimal(38,10)")  # times beyond that count as that
    return once.select(
        "load_id", "campaign", "run_id", F.coalesce(t.try_cast("decimal(38,10)"), top).alias("num"),
        *[x.alias(f"n{i}") for i, x in enumerate(null)],
        *[F.when(null[i], False).otherwise(x).alias(f"bad{i}") for i, x in enumerate(bad)],
        *[F.coalesce(x, F.lit(False)).alias(f"hit{i}") for i, x in enumerate(hit)],
    )


def violations(rows: DataFrame) -> DataFrame:
    flags = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"bad{i}").alias("bad")) for i, f in enumerate(FIELDS)])
    return rows.select("load_id", "run_id", F.inline(flags)).where("bad").select("load_id", "field", F.lit("violation").alias("finding"), "run_id")


#: Time buckets of the classifiers, per factor e; at most 500, as times are capped.
CELLS_PER_E = 8
NEWTON = 12
#: A classifier this far below the threshold still proposes a change: its score
#: is a float, the exact aggregates that confirm it aren't.
SLACK = 1e-9


def time_cell(num: Column) -> Column:
    return F.floor(F.log1p(num.cast("double")) * CELLS_PER_E).cast("int")


def counted(rows: DataFrame) -> DataFrame:
    """``campaign, load_id, cell, rows`` and, per field i, nulls, valid rows and
    hits: exact counts of each load by cell of its valid times (null: none)."""
    counts = []
    for i in range(len(FIELDS)):
        ok = ~F.col(f"n{i}") & ~F.col(f"bad{i}")
        counts += [F.count(F.when(F.col(f"n{i}"), 1)).alias(f"null{i}"), F.count(F.when(ok, 1)).alias(f"valid{i}"), F.count(F.when(ok & F.col(f"hit{i}"), 1)).alias(f"hits{i}")]
    named = rows.where("load_id IS NOT NULL AND campaign IS NOT NULL").withColumn("cell", F.when(~F.col("n0") & ~F.col("bad0"), time_cell(F.col("num"))))
    return named.groupBy("campaign", "load_id", "cell").agg(F.count(F.lit(1)).alias("rows"), *counts)


def medians(rows: DataFrame, by_cell: DataFrame) -> DataFrame:
    """``campaign, load_id, median2``: twice the exact median of the valid times.
    The cumulative count over the cells finds those of the middle ranks, and
    only their values are counted and ranked; no load is ever sorted whole."""
    w = Window.partitionBy("campaign", "load_id")  # at most 500 cells
    b = by_cell.where("cell IS NOT NULL").select("campaign", "load_id", "cell", "rows", F.sum("rows").over(w.orderBy("cell")).alias("upto"), F.sum("rows").over(w).alias("total"))
    lo, hi = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    mid = b.where((F.col("upto") >= lo) & (F.col("upto") - F.col("rows") < hi)).select("campaign", "load_id", "cell", (F.col("upto") - F.col("rows")).alias("below"), "total")
    v = rows.where("NOT n0 AND NOT bad0 AND load_id IS NOT NULL AND campaign IS NOT NULL").groupBy("campaign", "load_id", time_cell(F.col("num")).alias("cell"), "num").agg(F.count(F.lit(1)).alias("c"))
    r = v.join(mid, ["campaign", "load_id", "cell"]).withColumn("upto", F.col("below") + F.sum("c").over(Window.partitionBy("campaign", "load_id", "cell").orderBy("num")))
    at = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank), F.col("num")))
    return r.groupBy("campaign", "load_id").agg((at(lo) + at(hi)).alias("median2"))


def load_profile(rows: DataFrame) -> DataFrame:
    """Exact base aggregates of each load and the load before: ``load_id`` and,
    per field i, nulls, valid rows and hits of both, twice the medians, and
    ``times``, the valid times counted by cell. One row per load."""
    by_cell = materialise(counted(rows))
    names = ["rows", *[f"{c}{i}" for i in range(len(FIELDS)) for c in ("null", "valid", "hits")]]
    times = F.sort_array(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "rows")))).alias("times")  # at most 500
    base = by_cell.groupBy("campaign", "load_id").agg(times, *[F.sum(c).alias(c) for c in names]).join(medians(rows, by_cell), ["campaign", "load_id"], "left")
    w = Window.partitionBy("campaign").orderBy("load_id")  # a row per load
    own = [*names, "times", "median2"]
    return base.select("load_id", F.lag("load_id").over(w).alias("prev_id"), *own, *[F.lag(c).over(w).alias(f"p_{c}") for c in own]).where("prev_id IS NOT NULL")


def discrimination(now: np.ndarray, before: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` groups: how well a logistic regression, trained on the
    group's categories (one weight each, both loads of equal total weight),
    tells the two loads apart: the mean share of rows it puts on the right side.

    Newton's steps run for all categories of all groups together, as the weights
    of one-hot categories don't meet in the Hessian. From zero the first step
    has the sign of the difference of the two shares and no later one loses it,
    so the result is 1/2 plus half the total variation of the two loads, and
    1/2 plus half the difference of shares if there are two categories. 1/2 if
    a load has no rows.
    """
    total = np.stack([np.bincount(group, x, n) for x in (now, before)])
    a, b = (x / np.where(t[group] > 0, t[group], 1) for x, t in zip((now, before), total))
    beta = np.zeros(len(group))
    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-beta))
        pull = 1e-3
        step = (a * (1 - p) - b * p - pull * beta) / ((a + b) * p * (1 - p) + pull)
        beta += np.clip(step, -2, 2)
    right = np.where(beta > 0, a, 0) + np.where(beta > 0, 0, b)
    known = (total > 0).all(0)
    return np.where(known, np.bincount(group, right, n) / 2, 0.5)


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each load the discriminations of the classifiers on one field
    alone: ``null{i}`` on whether it is null, ``value{i}`` on its valid values."""
    for b in batches:
        n, col = b.num_rows, lambda c: b.column(c).to_numpy(zero_copy_only=False).astype("float64")  # noqa: B023
        two = np.arange(2 * n) % max(n, 1)
        pair = lambda hit, of: np.concatenate([hit, of - hit])
        out = []
        for i in range(len(FIELDS)):
            sides = [(col(f"{s}null{i}"), col(f"{s}rows"), col(f"{s}hits{i}"), col(f"{s}valid{i}")) for s in ("", "p_")]
            out.append(discrimination(*[pair(x[0], x[1]) for x in sides], two, n))
            if i:
                out.append(discrimination(*[pair(x[2], x[3]) for x in sides], two, n))
                continue
            at, cell, weight = [], [], []
            for side, c in enumerate(("times", "p_times")):
                lists = b.column(c)
                flat = lists.flatten()
                at.append(np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())))
                cell.append(flat.field(0).to_numpy(zero_copy_only=False))
                weight.append(np.stack([flat.field(1).to_numpy(zero_copy_only=False) * (side == k) for k in (0, 1)]))
            key = np.concatenate(at) * 1024 + np.concatenate(cell)
            each, inv = np.unique(key, return_inverse=True)
            w = np.concatenate(weight, 1).astype("float64")
            out.append(discrimination(np.bincount(inv, w[0], len(each)), np.bincount(inv, w[1], len(each)), each // 1024, n))
        made = [x for i in range(len(FIELDS)) for x in (f"d_null{i}", f"d_value{i}")]
        kept = [c for c in b.schema.names if not c.endswith("times")]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(x) for x in out], [*kept, *made])


def classified(profile: DataFrame) -> DataFrame:
    """``load_profile`` without its times, with the discriminations ``d_null{i}``
    and ``d_value{i}``."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in profile.schema.fields if not f.name.endswith("times")]
    made = [f"d_{k}{i} double" for i in range(len(FIELDS)) for k in ("null", "value")]
    return profile.mapInArrow(_classify, ", ".join(kept + made))


def shifts(profile: DataFrame) -> DataFrame:
    """Changes that a classifier proposes and exact aggregates confirm.

    Shares that differ by 0.25 are discriminated by 0.625, so that is asked of
    the classifiers on null flags and on events. Medians that differ mean that
    the distributions do, so the classifier on times must do better than 1/2;
    it can't say more, as a factor of three between medians may come with any
    discrimination above that.
    """

    def apart(a: str, n: str, b: str, m: str) -> F.Column:  # |a/n - b/m| >= 1/4
        big = lambda c: F.col(c).cast("decimal(19)")
        return (F.col(n) > 0) & (F.col(m) > 0) & (F.abs(big(a) * big(m) - big(b) * big(n)) * 4 >= big(n) * big(m))

    found = []
    for i, f in enumerate(FIELDS):
        proposed = lambda k, least: F.col(f"d_{k}{i}") >= least - SLACK  # noqa: B023, E731
        nulls = proposed("null", 0.625) & apart(f"null{i}", "rows", f"p_null{i}", "p_rows")
        if i:
            moved = proposed("value", 0.625) & apart(f"hits{i}", f"valid{i}", f"p_hits{i}", f"p_valid{i}")
        else:
            moved = (F.col("d_value0") > 0.5 + SLACK) & F.expr("median2 >= 3 * p_median2 OR 3 * median2 <= p_median2")
        found += [F.struct(F.lit(f).alias("field"), F.lit(k).alias("finding"), F.coalesce(x, F.lit(False)).alias("yes")) for k, x in (("null_shift", nulls), ("value_shift", moved))]
    return classified(profile).select("load_id", F.inline(F.array(*found))).where("yes").select("load_id", "field", "finding", F.lit(0).cast("bigint").alias("run_id"))


def findings(df: DataFrame) -> DataFrame:
    """``load_id, field, finding, run_id``: violations of each row and shifts
    of each load against the load before in its campaign.

    Rows repeated exactly count once; null and empty are null. A row without a
    load or campaign can violate but isn't part of a comparison. A share of an
    empty set is compared with nothing. An empty table gives no findings.
    """
    rows = materialise(checked(df))
    return violations(rows).unionByName(shifts(load_profile(rows)))


def column_profile(df: DataFrame, by: str = "load_id") -> DataFrame:
    """Exact profile of every column, per load: ``load, field, n_rows, nulls,
    n_distinct, min_text, max_text, min_number, max_number``. Null and empty
    are null; rows repeated exactly count once. Values are counted per load,
    field and value before they are counted per load and field."""
    rows = df.distinct()
    fields = [c for c in df.columns if c != by]
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for c in fields])
    per = rows.select(F.col(f"`{by}`").alias("load"), F.inline(cells)).groupBy("load", "field", "value").agg(F.count(F.lit(1)).alias("c"))
    num = F.when(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), F.col("value").try_cast("double"))
    return per.groupBy("load", "field").agg(
        F.sum("c").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("nulls"), F.count("value").alias("n_distinct"),
        F.min("value").alias("min_text"), F.max("value").alias("max_text"), F.min(num).alias("min_number"), F.max(num).alias("max_number"),
    )


# --- classifier two-sample test on all fields --------------------------------

#: Columns of the design matrix: constant, then a null flag and a value per field.
OWNER = np.array([-1, 0, 0, 1, 1, 2, 2, 3, 3])
D = len(OWNER)
RIDGE = 1.0
#: Newton's steps end at a change below this, which takes about six.
SETTLED = 1e-8


def cells(rows: DataFrame) -> DataFrame:
    """``load_id, prev_id, own, other``: rows with equal features counted, of
    each load and of the load before it. A time is its cell's middle; violations
    count as nulls. At most 2 * 500 * 3 ** 3 cells a load."""
    gone = [F.col(f"n{i}") | F.col(f"bad{i}") for i in range(len(FIELDS))]
    value = [F.when(g, -1).otherwise(F.col(f"hit{i}").cast("int") if i else time_cell(F.col("num"))).alias(f"c{i}") for i, g in enumerate(gone)]
    fold = F.pmod(F.xxhash64("run_id", "load_id"), F.lit(2)).cast("int").alias("fold")
    named = rows.where("load_id IS NOT NULL AND campaign IS NOT NULL").select("campaign", "load_id", fold, *value)
    keys = ["fold", *[f"c{i}" for i in range(len(FIELDS))]]
    one = named.groupBy("campaign", "load_id", *keys).agg(F.count(F.lit(1)).alias("w"))
    per = one.groupBy("campaign", "load_id").agg(F.collect_list(F.array(*keys, F.col("w"))).alias("own"))
    w = Window.partitionBy("campaign").orderBy("load_id")  # a row per load
    return per.select("load_id", F.lag("load_id").over(w).alias("prev_id"), "own", F.lag("own").over(w).alias("other")).where("prev_id IS NOT NULL")


def _design(c: np.ndarray) -> np.ndarray:
    x = np.zeros((len(c), D))
    x[:, 0] = 1
    for i in range(len(FIELDS)):
        gone = c[:, 1 + i] < 0
        x[:, 1 + 2 * i] = gone
        x[:, 2 + 2 * i] = np.where(gone, 0, c[:, 1 + i] if i else (c[:, 1] + 0.5) / CELLS_PER_E - 2)
    return x


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's steps, halved where
    they overshoot."""
    pull = np.full(D, RIDGE)
    pull[0] = 1e-6
    loss = lambda b: (w * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ b))).sum() + (pull * b * b).sum() / 2
    beta = np.zeros(D)
    now = loss(beta)
    while True:
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (w * (y - p)) - pull * beta)
        while (then := loss(beta + step)) > now and np.abs(step).max() > SETTLED:
            step = step / 2
        if np.abs(step).max() <= SETTLED:
            return beta
        beta, now = beta + step, then


def _auc(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Area under the ROC curve of weighted scores; ties count half."""
    _, at = np.unique(z.round(9), return_inverse=True)
    pos, neg = np.bincount(at, w * y), np.bincount(at, w * (1 - y))
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))


def _two_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drops = ["drop_" + f.replace("-", "_").lower() for f in FIELDS]
    for b in batches:
        rows = []
        for load, own, other in zip(b.column("load_id").to_pylist(), b.column("own"), b.column("other")):
            c = np.concatenate([np.array(s.as_py(), "int64") for s in (own, other)])
            y = np.repeat([1.0, 0.0], [len(own), len(other)])
            x, w, fold = _design(c), c[:, -1].astype("float64"), c[:, 0]
            terms = np.zeros((len(c), D))
            for f in (0, 1):  # each fold is scored by the model of the other
                terms[fold == f] = x[fold == f] * _fit(x[fold != f], y[fold != f], w[fold != f])
            full = _auc(terms.sum(1), y, w)
            rows.append([load, int((w * y).sum()), int((w * (1 - y)).sum()), full, *[full - _auc(terms[:, OWNER != i].sum(1), y, w) for i in range(len(FIELDS))]])
        names = ["load_id", "n_now", "n_before", "auc", *drops]
        kinds = [b.schema.field("load_id").type, pa.int64(), pa.int64()] + [pa.float64()] * (1 + len(drops))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def drift(df: DataFrame) -> DataFrame:
    """Classifier two-sample test of each load against the one before:
    ``load_id, n_now, n_before, auc`` and ``drop_<field>``, the discrimination
    lost when the field is neutralised.

    Two folds: each row is scored by the model of the other fold. Rows meet as
    counted cells, combined before the shuffle, so a load of any size is a
    bounded number of cells; the scores of cells are compared exactly.
    """
    pairs = cells(checked(df))
    drops = ", ".join("drop_" + f.replace("-", "_").lower() + " double" for f in FIELDS)
    kind = pairs.schema["load_id"].dataType.simpleString()
    return pairs.select("load_id", "own", "other").mapInArrow(_two_sample, f"load_id {kind}, n_now bigint, n_before bigint, auc double, {drops}")
