from pyspark.sql import functions as F

from covergrid.operators import graph as G
from covergrid.operators import resultcsv as C
from covergrid.operators import solve as S
from covergrid.sources import edges as X
from covergrid.streaming import edges as stream

STAR = "\n  1 2\n# 12 10\n1 3 # tail\r\n1 4\n 1 5\n1 6\n1 7\n1 8\n1 9\n1 10\n11 12\nbad  line\nx\n"


def test_edge_text_round_trip_and_solve(spark, tmp_path):
    (tmp_path / "in.txt").write_text(STAR)
    e, rejects = X.read_edges(spark, f"file://{tmp_path}/in.txt")
    assert e.count() == 10 and sorted(r.reason for r in rejects.collect()) == ["columns", "columns"]
    ids = G.canonical(e.select(*[F.col(c).cast("bigint").alias(c) for c in X.ENDS]), *X.ENDS)
    s = S.solve_exact(ids)
    assert s.size == 2 and s.proven
    X.write_edges(ids, f"file://{tmp_path}/out")
    X.write_cover(s.cover, f"file://{tmp_path}/cover")
    assert X.read_edges(spark, f"file://{tmp_path}/out")[0].count() == 10
    assert spark.read.text(f"file://{tmp_path}/cover").count() == 2
    names = G.vertices(ids).select("id", F.concat(F.lit("n"), "id").alias("name"))
    X.write_cover(s.cover, f"file://{tmp_path}/named", names)
    assert {r.value for r in spark.read.text(f"file://{tmp_path}/named").collect()} == {f"n{r.id}" for r in s.cover.collect()}
    assert {r.name: r.value for r in s.statistics().collect()} == {"recursive steps": s.nodes, "vc size": 2, "proven": 1}


def test_opb_and_answers(spark, tmp_path):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "u string, v string")
    X.write_opb(e, G.vertices(e), f"file://{tmp_path}/opb")
    assert (tmp_path / "opb/0_objective").exists()
    whole = "".join(p.read_text() for folder in ("0_objective", "1_constraints") for p in sorted((tmp_path / "opb" / folder).glob("part-*")))
    head, *lines = whole.split("\n")
    assert head == "min: +1*xa +1*xb +1*xc ;" and sorted(x.strip() for x in lines if x.strip()) == ["+1*xa +1*xb >= +1;", "+1*xb +1*xc >= +1;"]
    back = X.read_opb(spark, f"file://{tmp_path}/opb/*")
    assert sorted(map(tuple, back.collect())) == [("a", "b"), ("b", "c")]
    (tmp_path / "ok.txt").write_text("c hello\no 1\ns SATISFIABLE\nv xa xb xc\nc better\nv -xa xb -xc\n")
    (tmp_path / "cut.txt").write_text("c *** Interrupted ***\nv xa xb\n")
    assert [r.name for r in X.read_answer(spark, f"file://{tmp_path}/ok.txt").collect()] == ["b"]
    assert X.read_answer(spark, f"file://{tmp_path}/cut.txt").count() == 0


def test_result_pipeline(spark, tmp_path):
    head = "file;time;n;m;solsize;recsteps;finished;VC-check;size-check;diff-to-opt;last-k-diff-to-opttime\n"
    rows = ["g1;2.5;1;1;1;5;1;OK;OK;0;", "g2;;1;1;0;7;0;;;;", "g3;Command terminated by signal 11 14.67;1;1;1;1;0;;;;", "g4;1.5;1;1;1;0;1;OK;OK;0;", "g5;0;1;1;1;2;1;OK;OK;0;"]
    (tmp_path / "r.csv").write_text(head + "\n".join(rows) + "\n")
    df = X.read_results(spark, f"file://{tmp_path}/r.csv")
    assert df.columns[-1] == "last-k-diff-to-opt"
    assert [r.file for r in C.sort_by_time(df, "file").collect()] == ["g5", "g4", "g1"]
    assert [r.total for r in C.running_total(df, "finished", ["file"]).orderBy("file").collect()] == [2.5, 4.0, 4.0]
    assert {r.file: r.per_step for r in C.time_per_step(df).collect()} == {"g1": 0.5, "g2": 0.0, "g3": 0.0, "g4": 0.0, "g5": 0.0}
    assert sorted(r.file for r in C.intersect([df, df, df, df.where("file <> 'g4'")]).collect()) == ["g1"]
    X.write_results(C.valid(df), f"file://{tmp_path}/out")
    assert X.read_results(spark, f"file://{tmp_path}/out").count() == 3


def test_stream_of_edge_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("a b\nb a\n# x\nc c\nbad\n")
    for i, want in enumerate(({"a": 1, "b": 1}, {"a": 2, "b": 1, "d": 1})):
        q = stream.to_memory(stream.degrees(stream.read_lines(spark, f"file://{folder}")), f"deg{i}", f"file://{tmp_path}/cp{i}")
        q.awaitTermination(120)
        assert {r.id: r.deg for r in spark.table(f"deg{i}").collect()} == want
        (folder / "2.txt").write_text("d a\na b\n")


def test_command_line(spark, tmp_path, capsys):
    from covergrid import cli

    path = tmp_path / "g.txt"
    path.write_text("b a\na c\nb c\nc d\ne f\nf g\ng h\nh e\nz z\nbad\n")
    url = f"file://{path}"
    cli.main(["exact", url], spark)
    out = capsys.readouterr().out.split("\n")
    assert "#vc size: 5" in out and "#rejected lines: 1" in out and "z" in out
    cli.main(["heuristic", url, "--method", "max"], spark)
    assert "#vc size: 5" in capsys.readouterr().out
    cli.main(["kernel", url], spark)
    assert "#difference: 5" in capsys.readouterr().out
    cli.main(["bounds", url], spark)
    assert "#clique bound:" in capsys.readouterr().out
    cli.main(["kernel", url, "--rules", "R1,R2,R6,R7"], spark)
    assert "#difference: 5" in capsys.readouterr().out
    for k, want in ((4, "no"), (5, "yes")):
        cli.main(["decide", url, "--k", str(k)], spark)
        assert f"#cover: {want}" in capsys.readouterr().out
    (tmp_path / "answer.txt").write_text("v xq -xr\n")
    cli.main(["answer", f"file://{tmp_path}/answer.txt"], spark)
    assert capsys.readouterr().out.split() == ["q"]
    cli.main(["opb", url, "--out", f"file://{tmp_path}/opb"], spark)
    assert X.read_opb(spark, f"file://{tmp_path}/opb/*").count() == 8


def test_running_total_over_many_partitions(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), i, rng.choice([str(rng.randrange(100)), "", None, "killed"])) for i in range(3000)]
    rng.shuffle(rows)
    want, sums = {}, {}
    for f, i, t in sorted(rows, key=lambda r: r[1]):
        if t and t != "killed":
            sums[f] = sums.get(f, 0) + float(t)
            want[i] = sums[f]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.i: r.total for r in C.running_total(spark.createDataFrame(rows, "file string, i int, time string"), "file", ["i"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got == want
