"""Drift, comparison, parsing, profile and salting against brute force."""

import datetime as dt
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from covergrid.operators import compare, linecheck, profile, salting
from covergrid.operators.drift import DriftReader

# --- drift -------------------------------------------------------------------

T0 = dt.datetime(2024, 1, 1)
LINES = "load_id bigint, campaign string, config string, written_at timestamp, loaded_at timestamp, line_no bigint, value string, path string"


def files(*loads):
    out = []
    for k, (campaign, day, lines) in enumerate(loads, 1):
        out += [(k, campaign, "c", T0 + dt.timedelta(days=day), T0, i, x, "clash") for i, x in enumerate(lines, 1)]
    return out


DRIFT = files(
    ("a", 1, ["file;time;n;note", "g1;1.5;3;x", "g2;2.5;4;y"]),
    ("a", 3, [" file ; seconds;note ; n\r", "g1; 1.5;x;a\r", "g2;2.5;y;b", "g3;9.9;z;c", "g3;9.9;z;c"]),
    ("a", 2, ["file;time;n;note;extra", "g1;1.5;3;x;", "g2;2.5;4;y;", "g3;9.9;;z;;over", "g4"]),
    ("b", 1, ["file;time", "g1;1"]),
    ("b", 2, ["instance;flag", "g1;true"]),
    (None, 1, ["file;time", "g1;1"]),
    ("c", 1, []),
    ("c", 2, ["file;file;time", "g1;x;oops"]),
)


def test_changes(spark):
    df = spark.createDataFrame(DRIFT, LINES)
    got = {tuple(r) for r in DriftReader(df).changes().collect()}
    assert got == {
        (3, "added", "", "extra"),
        (2, "removed", "extra", ""),
        (2, "renamed", "time", "seconds"),
        (2, "retyped", "n", "n"),
        (5, "renamed", "file", "instance"),
        (5, "removed", "time", ""),
        (5, "added", "", "flag"),
    }


def test_one_table_with_fixed_fields(spark):
    typed, failed = DriftReader(spark.createDataFrame(DRIFT, LINES)).project()
    rows = {(r.load_id, r.line_no): r for r in typed.collect()}
    assert len(rows) == sum(r[5] > 1 for r in DRIFT)
    assert rows[2, 2].time == 1.5 and rows[2, 2].n is None and rows[2, 2].file == "g1" and rows[2, 2].extra == {"note": "x"}
    assert rows[5, 2].file == "g1" and rows[5, 2].extra == {"flag": "true"}
    assert rows[3, 4].extra == {"note": "z", "extra": ""} and rows[3, 4].overflow == {6: "over"} and rows[3, 4].n is None
    assert rows[3, 5].file == "g4" and rows[3, 5].time is None
    assert {(r.load_id, r.line_no, r.field, r.value) for r in failed.collect()} == {(2, 2, "n", "a"), (2, 3, "n", "b"), (2, 4, "n", "c"), (2, 5, "n", "c"), (8, 2, "time", "oops")}


def test_names_that_look_like_positions_and_very_long_names(spark):
    long = "x" * 20_000
    lines = files(("a", 1, [f"file;time;#5;{long}", f"g1;1;2;3;4;5", "g2", "g3;;;;;"]), ("b", 1, ["a;b"]), (None, 1, ["only", "g;h"]))
    rows = {(r.load_id, r.line_no): r for r in DriftReader(spark.createDataFrame(lines, LINES)).project()[0].collect()}
    assert rows[1, 2].extra == {"#5": "2", long: "3"} and rows[1, 2].overflow == {5: "4", 6: "5"}
    assert rows[1, 3].extra == {"#5": "", long: ""} and rows[1, 3].overflow == {}
    assert rows[1, 4].overflow == {5: "", 6: ""} and rows[3, 2].overflow == {2: "h"}


def test_empty_lines_table(spark):
    r = DriftReader(spark.createDataFrame([], LINES))
    assert r.changes().count() == 0 and r.project()[0].count() == 0


# --- comparison --------------------------------------------------------------


def key_differences(left, right):
    out = set()
    a, b = defaultdict(set), defaultdict(set)
    for side, rows in ((a, left), (b, right)):
        for k, x, y in rows:
            side[k].add((x, y))
    for k in a.keys() | b.keys():
        if k not in b:
            out.add((k, "missing_in_right"))
        elif k not in a:
            out.add((k, "missing_in_left"))
        else:
            for i, f in enumerate("xy"):
                ends = [tuple(sorted((str(r[i] is not None), str(r[i])) for r in s)[j] for j in (0, -1)) for s in (a[k], b[k])]
                if ends[0] != ends[1]:
                    out.add((k, f))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_differences(spark, parts):
    rng = random.Random(3)
    left = [(k, rng.choice(["p", "q", None]), rng.choice(["1", "2"])) for k in range(3000) if rng.random() < 0.9]
    right = [(k, x if rng.random() < 0.9 else "r", y) for k, x, y in left if rng.random() < 0.9] + [(k, "n", "n") for k in range(5000, 5100)]
    left += left[:50] + [(7777, "hot", "1")] * 3000 + [(None, "a", "b")]
    right += right[:70] + [(7777, "hot", "2")]
    schema = "k int, x string, y string"
    a, b = spark.createDataFrame(left, schema).withColumn("side", F.lit("clash")), spark.createDataFrame(right, schema)
    both = lambda c: (compare.exact(F.col(c)), compare.exact(F.col(c)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = compare.differences(a, b, ["k"], {"x": both("x"), "y": both("y")}, parts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and {(r.k, r.difference) for r in got} == key_differences(left, right)


def test_differences_of_empty_tables(spark):
    a = spark.createDataFrame([(1, "x")], "k int, x string")
    f = {"x": (compare.exact(F.col("x")), compare.exact(F.col("x")))}
    assert [r.difference for r in compare.differences(a, a.limit(0), ["k"], f).collect()] == ["missing_in_right"]
    assert compare.differences(a.limit(0), a.limit(0), ["k"], f).count() == 0


def test_plain_number(spark):
    cases = {"3.90": "3.9", "003.9": "3.9", "0": "0", "00.00": "0", "10": "10", "100.0": "100", "0.5": "0.5", "1.2.3": "1.2.3", "": "", None: "", " 1": " 1", "5.": "5.", ".5": ".5", "-1.0": "-1.0", "9" * 60 + ".50": "9" * 60 + ".5"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string")
    assert df.where(compare.plain_number(F.col("a")) != F.col("b")).collect() == []


# --- parsing -----------------------------------------------------------------

NAME = re.compile(r"[A-Za-z0-9_]+")


def judge(line):
    """None: no record; else (reason or '', fields)."""
    if line is None:
        return None
    line = line.strip(" \t\r")
    if not line:
        return None
    h, s = line.find("#"), line.find(" ")
    if h >= 0 and (s < 0 or h < s):
        return None
    if h >= 0:
        line = line[:h].rstrip(" \t")
    cols, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j = line.find('"', i + 1)
            if j < 0 or line[j + 1 : j + 2] not in ("", " "):
                return "quoting", None
            cols.append(line[i + 1 : j])
            j += 1
        else:
            j = line.find(" ", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return "quoting", None
            cols.append(line[i:j])
        if j >= len(line):
            break
        i = j + 1
    if len(cols) != 2:
        return "columns", None
    return ("", cols) if all(NAME.fullmatch(c) for c in cols) else ("value", None)


def test_lines_against_a_scanner(spark):
    rng = random.Random(6)
    fixed = [None, "", "  \t\r", "#", "# a b", "a#b c", "a #b", "a b#c", "a b # c\r", "a  b", "a\tb", "a", "a b c", '"a" b', '"a b" c', 'a" b', '"a"b c', '"" a', "ä b", " a b ", "a b\r\n", "x" * 100_000 + " y", '"a #b" c', "a -b", "a \t", 'a "b', "a b ", "a b c"]
    lines = fixed + ["".join(rng.choice('ab_1 "#\t\r-') for _ in range(rng.randrange(9))) for _ in range(4000)]
    df = spark.createDataFrame([(i, x, "f", 1) for i, x in enumerate(lines)], "line_id int, value string, text string, k0 int")
    got = {r.line_id: r for r in linecheck.parse(df, ["vertex0", "vertex1"], keep=("line_id",)).collect()}
    for i, x in enumerate(lines):
        want = judge(x)
        if want is None:
            assert i not in got, x
        else:
            assert (got[i].reason or "") == want[0], (x, got[i])
            if not want[0]:
                assert [got[i].vertex0, got[i].vertex1] == want[1] and got[i].broken_field is None


def test_first_broken_field(spark):
    df = spark.createDataFrame([("-a b",), ("a -b",), ("a",), ("a b c",)], "value string")
    got = {r.value: r.broken_field for r in linecheck.parse(df, ["vertex0", "vertex1"], keep=("value",)).collect()}
    assert got == {"-a b": "vertex0", "a -b": "vertex1", "a": "vertex1", "a b c": None}


# --- profile -----------------------------------------------------------------

RUNS = "run_id bigint, campaign string, load_id bigint, loaded_at timestamp, file string, time string, n int, m int, solsize int, recsteps bigint, finished int, `VC-check` string, `size-check` string, `diff-to-opt` int, `last-k-diff-to-opt` int"


def run_row(i, load, time="1.0", finished=1, vc="OK", diff=0, campaign="a", sol=10):
    return (i, campaign, load, T0, "f", time, 1, 1, sol, 1, finished, vc, None, diff, None)


def test_findings(spark):
    rows = [run_row(i, 1, time=str(i)) for i in range(1, 9)]
    rows += [run_row(10 + i, 2, time=None if i < 2 else str(3 * (i + 1)) + ".0", finished=i % 2, vc="OK" if i else "Not a VC: Uncovered edge: a b", diff=None) for i in range(8)]
    rows += [run_row(20, 2, "1.2.3", 7, "OK ", -1), run_row(21, 2, "inf", 1, "", 11), run_row(22, None, "x"), run_row(23, 5, "bad", campaign=None)]
    rows += rows[:3] + [run_row(30, 9, campaign="z", sol=None, diff=5, time="9" * 60)]
    got = {tuple(r) for r in profile.findings(spark.createDataFrame(rows, RUNS)).collect()}
    assert {g for g in got if g[2] == "violation"} == {
        (2, "time", "violation", 20), (2, "finished", "violation", 20), (2, "VC-check", "violation", 20), (2, "diff-to-opt", "violation", 20),
        (2, "time", "violation", 21), (2, "diff-to-opt", "violation", 21), (None, "time", "violation", 22), (5, "time", "violation", 23),
    }
    # load 1: median 4.5; load 2: valid times 9 12 15 18 21 24, median 16.5, of ten rows two null
    assert {g for g in got if g[2] != "violation"} == {(2, "time", "value_shift", 0), (2, "finished", "value_shift", 0), (2, "diff-to-opt", "null_shift", 0)}


def test_medians_are_exact(spark):
    rng = random.Random(2)
    rows = [run_row(i, i % 7, time=f"{rng.choice([rng.random(), rng.random() * 1000, 5]):.2f}") for i in range(700 - 3)]
    df = profile.checked(spark.createDataFrame(rows, RUNS))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(round(float(r[5]) * 100))
    want = {k: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) for k, v in by.items()}
    assert {r.load_id: round(float(r.median2) * 100) for r in profile.medians(df, profile.counted(df)).collect()} == want


def test_drift_classifier_finds_the_column(spark):
    rng = random.Random(1)
    rows = [run_row(i, 1 + i // 200, time=f"{rng.random() * 9:.2f}", finished=int(rng.random() < (0.1 if 400 <= i < 600 else 0.9)), diff=rng.choice([0, 1])) for i in range(600)]
    got = {r.load_id: r for r in profile.drift(spark.createDataFrame(rows, RUNS)).collect()}
    assert set(got) == {2, 3}
    assert got[2].auc < 0.62 and got[3].auc > 0.85
    assert got[3].drop_finished > 0.3 and abs(got[3].drop_time) < 0.1


def test_profile_of_empty_and_null_tables(spark):
    df = spark.createDataFrame([], RUNS)
    assert profile.findings(df).count() == 0 and profile.column_profile(df).count() == 0
    p = {r.field: r for r in profile.column_profile(spark.createDataFrame([run_row(1, 1, time=""), run_row(1, 1, time=""), run_row(2, 1, "10")], RUNS)).collect()}
    assert (p["time"].n_rows, p["time"].nulls, p["time"].n_distinct, p["time"].min_number) == (2, 1, 1, 10.0)


# --- salting -----------------------------------------------------------------

PAIRS = [(i, "f", "hub" if i % 3 else f"v{i}", None if i % 50 == 0 else "" if i % 7 == 0 else f"w{i % 5}") for i in range(2000)]


def test_salted_counts_and_degrees(spark, monkeypatch):
    monkeypatch.setattr(salting, "HEAVY_ROWS", 100)
    df = spark.createDataFrame(PAIRS, "id int, file string, a string, b string").withColumn("value", F.lit(1)).withColumn("n", F.lit(1))
    want = Counter([("a", r[2]) for r in PAIRS] + [("b", r[3]) for r in PAIRS])
    got = {(r.field, r.value): r.n for r in salting.salted_counts(df, ["a", "b"], F.col("id")).collect()}
    assert got == dict(want)
    assert {(r.field, r.value) for r in salting.frequent_values(df, ["a", "b"], F.col("id"), 50).collect()} == {k for k, n in want.items() if k[1] is not None and n * 50 >= len(PAIRS)}
    near, n = defaultdict(set), Counter()
    for _, f, a, b in PAIRS:
        if a is not None and b is not None:
            for x, y in {(a, b), (b, a)}:
                near[f, x].add(y)
                n[f, x] += 1
    assert {(r.file, r.vertex): (r.n_records, r.n_neighbours) for r in salting.salted_degrees(df, "file", ("a", "b")).collect()} == {k: (n[k], len(s)) for k, s in near.items()}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join(spark, monkeypatch, how):
    monkeypatch.setattr(salting, "HEAVY_ROWS", 100)
    left = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i % 9}") for i in range(1000)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, x int")
    assert sorted(map(str, salting.skew_join(left, right, ["k"], F.col("id"), how).select("id", "k", "x").collect())) == sorted(map(str, left.join(right, "k", how).select("id", "k", "x").collect()))


def test_salting_of_empty_tables(spark):
    df = spark.createDataFrame([], "id int, file string, a string, b string")
    assert salting.salted_counts(df, ["a", "b"], F.col("id")).count() == 0
    assert salting.salted_degrees(df, "file", ("a", "b")).count() == 0
