import re
from collections import defaultdict

import numpy as np

from covergrid.llm import formatdups
from covergrid.llm.formatdups import FormatDuplicates, identifiers

SCHEMA = "edge_id bigint, file string, vertex0 string, vertex1 string, id string, f0 string"


def rows(*xs):
    return [(*x, "clash", "clash") for x in xs]


def brute(data):
    sets = defaultdict(set)
    for i, f, a, b, *_ in data:
        if a is None or b is None:
            continue
        ca, cb = (re.sub(r"[\W_]+", "", x.lower()) for x in (a, b))
        if ca and cb:
            sets[(f, *sorted((ca, cb)))].add(i)
    return sorted((min(s), x) for s in sets.values() for x in s if x != min(s))


DATA = rows(
    (1, "f", "v_1", "hub"), (2, "f", "HUB ", "V-1"), (3, "g", "v_1", "hub"), (4, "f", None, "hub"), (5, "f", "", "hub"), (6, "f", "__", "hub"),
    (7, "f", "v1", "v1"), (8, "f", "V_1", "v 1"), (9, None, "a", "b"), (10, None, "B", "A"), (11, "f", "v_1", "hub"), (12, "f", "v_2", "hub"),
    (13, "f", "Ä", "ß"), (14, "f", "ä!", "ß"), (15, "f", "x" * 100_000, "y"), (16, "f", "Y", "X" * 100_000),
)


def edges(df):
    return FormatDuplicates(df, "edge_id", ["file"], ["vertex0", "vertex1"])


def test_copies_against_brute_force(spark):
    got = sorted((r.first_id, r.copy_id) for r in edges(spark.createDataFrame(DATA, SCHEMA)).copies().collect())
    assert got == brute(DATA)
    counts = sorted(r.n_copies for r in edges(spark.createDataFrame(DATA, SCHEMA)).collapsed().collect())
    assert counts == [1, 1, 2, 2, 2, 2, 3]


def test_empty_table(spark):
    assert edges(spark.createDataFrame([], SCHEMA)).copies().count() == 0


def test_hot_set_is_salted_and_whole(spark, monkeypatch):
    monkeypatch.setattr(formatdups, "HEAVY_RECORDS", 50)
    data = [(i, "f", "Hub" if i % 2 else "hub", "Core" if i % 3 else "co-re", "", "") for i in range(400)] + [(1000 + i, "f", f"v{i}", "core", "", "") for i in range(50)]
    got = sorted((r.first_id, r.copy_id) for r in edges(spark.createDataFrame(data, SCHEMA)).copies().collect())
    assert got == brute(data)


def test_forms_that_share_a_hash_stay_apart(spark, monkeypatch):
    real = formatdups.xxhash.xxh3_64_intdigest

    class Weak:
        @staticmethod
        def xxh3_64_intdigest(b, seed):
            return 77 + (1 << 40) if b in (b"aa", b"bb") else real(b, seed)

    f = edges(spark.createDataFrame(rows((1, "f", "aa", "c"), (2, "f", "bb", "c"), (3, "f", "AA", "C")), SCHEMA))
    monkeypatch.setattr(formatdups, "xxhash", Weak)
    ids = identifiers(["aa", "bb", None, "c"], 1, {(1, "aa"): 1, (1, "bb"): 2})
    assert ids[0] == 1 and ids[1] == 2 and ids[2] == 0 and ids[3] not in (0, 1, 2)
    assert len(np.unique(identifiers(["aa", "bb"], 1, {}))) == 1
    assert f.reserved() == {}


def test_table(spark, data):
    df = spark.read.parquet(f"{data}/bucketgraph.parquet")
    got = sorted((r.first_id, r.copy_id) for r in edges(df).copies().collect())
    assert got == brute([(r.edge_id, r.file, r.vertex0, r.vertex1) for r in df.collect()])


def test_collapsed_and_rejected_hold_every_record(spark, data):
    df = spark.read.parquet(f"{data}/bucketgraph.parquet")
    f = FormatDuplicates(df, "edge_id", ["file"], ["vertex0", "vertex1"])
    one = sum(r.n_copies for r in f.collapsed().collect())
    more = spark.createDataFrame([(1, "f", None, "a"), (2, "f", "!", "a"), (3, "f", "", "a"), (4, "f", "b", "a"), (1, "f", None, "a")], "edge_id bigint, file string, vertex0 string, vertex1 string")
    assert one + f.rejected().count() == df.count()
    g = FormatDuplicates(more, "edge_id", ["file"], ["vertex0", "vertex1"])
    assert sorted((r.first_id, r.n_copies) for r in g.rejected().collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_dictionary_counts_records_and_tasks_may_forget(spark, monkeypatch):
    f = edges(spark.createDataFrame(DATA, SCHEMA))
    got = {(r.domain, r.form): r.n for r in f.dictionary().collect()}
    assert got[(1, "hub")] == 8 and got[(1, "v1")] == 8 and got[(0, "f")] == 13
    assert len({r.id for r in f.dictionary().collect() if r.domain == 1}) == sum(k[0] == 1 for k in got)
    run, names, _ = formatdups._encoder(1, 2, {})
    batch = spark.createDataFrame(DATA, SCHEMA).select("edge_id", "file", "vertex0", "vertex1").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(formatdups, "MEMORY", 0)
    parts = [x for b in run(batch.slice(i, 1) for i in range(len(DATA))) for x in b.to_pylist()]
    whole = [x for b in run([batch]) for x in b.to_pylist()]
    assert [x for x in parts if x["kind"] != 2] == [x for x in whole if x["kind"] != 2]
    assert sum(x["n"] for x in parts if x["kind"] == 2) == sum(x["n"] for x in whole if x["kind"] == 2)
