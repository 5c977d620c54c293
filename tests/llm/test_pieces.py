import pytest

from covergrid.llm import bpe, pieces

DIFF = "commit 1\n\n    Message here\n\n" + "".join(
    f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n" + "".join(f"@@ -{h},3 +{h},4 @@\n" + "".join(f"+    int value{h} = {k} * level;\n" for k in range(9)) for h in range(6)) for i in range(7)
)


def check(spark, docs, limit, overlap):
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id int, words string, piece int")
    ids = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "words").collect()}
    out = {}
    for r in pieces.split(df, "doc_id", "words", limit, overlap).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert set(out) == {i for i, t in ids.items() if len(t) > limit}
    for i, ps in out.items():
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        whole = []
        for k, p in enumerate(ps):
            assert 0 < len(p.ids) <= limit and p.ids == ids[i][p.token_from : p.token_to]
            if k:
                assert p.ids[:overlap] == ps[k - 1].ids[len(ps[k - 1].ids) - overlap :]
            whole += p.ids[overlap if k else 0 :]
        assert whole == ids[i]  # exact round trip
    return out


def test_round_trip_of_odd_texts(spark):
    docs = [(1, DIFF), (2, None), (3, ""), (4, "short"), (5, "x" * 50_000), (6, "日本" * 3000), (7, "\n" * 5000), (8, " ".join("word" for _ in range(4000))), (9, DIFF * 20), (10, "a\r\n" * 3000), (11, "🙂" * 2000)]
    for limit, overlap in ((1024, 64), (100, 50), (64, 0)):
        check(spark, docs, limit, overlap)


def test_cuts_are_natural(spark):
    out = check(spark, [(1, DIFF)], 1024, 64)
    assert {p.cut for p in out[1][1:]} <= {"file", "hunk"}
    assert out[1][0].cut == "start"
    line_text = "".join(f"some plain line number {i} without hunks\n" for i in range(900))
    assert {p.cut for p in check(spark, [(1, line_text)], 1024, 64)[1][1:]} == {"line"}
    assert {p.cut for p in check(spark, [(1, "word " * 3000)], 1024, 64)[1][1:]} == {"word"}


def test_table_and_exact_limit(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    n = {r.doc_id: len(r.ids) for r in bpe.encode(df, "doc_id", "text").collect()}
    got = {r.doc_id for r in pieces.split(df, "doc_id", "text").collect()}
    assert got == {i for i, k in n.items() if k > 1024}


def test_empty_table_and_bad_overlap(spark):
    df = spark.createDataFrame([], "i int, t string")
    assert pieces.split(df, "i", "t").count() == 0
    with pytest.raises(ValueError):
        pieces.split(df, "i", "t", 100, 60)
