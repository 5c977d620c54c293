"""Command line: solve, bound or reduce an edge list.

    python -m covergrid.cli exact graph.txt
    python -m covergrid.cli heuristic graph.txt --method search
    python -m covergrid.cli kernel graph.txt        # reduced edges and #difference
    python -m covergrid.cli bounds graph.txt
    python -m covergrid.cli opb graph.txt --out folder
    python -m covergrid.cli answer solver.txt       # names of a solver's answer
    python -m covergrid.cli decide graph.txt --k 20 # a cover of at most k, if any

Cover vertices come out one per line, statistics as lines that start with #.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergrid.operators import graph as G
from covergrid.operators import rules as R
from covergrid.operators import solve as S
from covergrid.session import materialise, ship
from covergrid.sources import edges as X


def _numbered(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by id, and the dictionary ``name, id`` (a range sort, no order kept)."""
    seen = raw.withColumn("line", F.monotonically_increasing_id())
    names = materialise(G.dictionary(seen, "line", X.ENDS, []))
    a, b = (names.select(F.col("name").alias(c), F.col("id").alias(i)) for c, i in zip(X.ENDS, "ab"))
    return raw.join(a, X.ENDS[0]).join(b, X.ENDS[1]).select("a", "b"), names


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("mode", choices=["exact", "heuristic", "kernel", "bounds", "opb", "answer", "decide"])
    p.add_argument("path")
    p.add_argument("--method", default="best", choices=["max", "min", "best", "search"])
    p.add_argument("--nodes", type=int, default=S.NODES)
    p.add_argument("--k", type=int, help="budget of decide")
    p.add_argument("--rules", default="R1,R2,R5", help="rules of kernel, by name")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--seconds", type=float, help="after these, give the best cover so far")
    p.add_argument("--out", help="folder for the result instead of the screen")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    if args.mode == "answer":
        for r in X.read_answer(spark, args.path).toLocalIterator():
            print(r.name)
        return
    raw, rejects = X.read_edges(spark, args.path)
    bad = rejects.count()
    if bad:
        print(f"#rejected lines: {bad}")
    pairs, names = _numbered(materialise(raw))
    pairs = materialise(pairs)
    e, forced = materialise(G.canonical(pairs, "a", "b")), G.loops(pairs, "a", "b")

    def show(ids: DataFrame) -> None:
        named = G.names_of(ids, names)
        if args.out:
            named.select("name").write.text(args.out)
        else:
            for r in named.orderBy("id").toLocalIterator():
                print(r.name)

    if args.mode == "exact":
        s = S.solve_exact(e, nodes=args.nodes, loops=forced, seconds=args.seconds)
        show(s.cover)
        for r in s.statistics().collect():
            print(f"#{r.name}: {r.value}")
    elif args.mode == "heuristic":
        c = materialise(S.heuristic(G.delete_vertices(e, forced), args.method, seed=args.seed, seconds=args.seconds).unionByName(forced))
        show(c)
        print(f"#vc size: {c.count()}")
    elif args.mode == "kernel":
        k = R.kernelize(G.delete_vertices(e, forced), tuple(args.rules.split(",")), k=args.k)
        by = lambda c: names.select(F.col("id").alias(c), F.col("name").alias(f"n{c}"))
        lines = k.edges.join(by("u"), "u").join(by("v"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
        if args.out:
            X.write_edges(lines, args.out)
        else:
            for r in lines.orderBy("u", "v").toLocalIterator():
                print(r.u, r.v)
        for r in k.counters().orderBy("rule").collect():
            print(f"#{r.rule}: {r.rounds} rounds, {r.applied} applied, decrease {r.decrease}")
        print(f"#difference: {R.decrease(k.log()).first().dec + forced.count()}")
    elif args.mode == "decide":
        if args.k is None:
            p.error("decide needs --k")
        n = forced.count()
        k = R.kernelize(G.delete_vertices(e, forced), ("R1", "R2", "R5", "R3", "R4"), k=args.k - n)
        s = S.solve_exact(k.edges, nodes=args.nodes, seconds=args.seconds) if k.feasible else None
        if s is not None and s.size <= k.k:
            show(k.undo(s.cover).unionByName(forced))
        print("#cover: " + ("yes" if s is not None and s.size <= k.k else "unknown" if s is not None and not s.proven else "no"))
    elif args.mode == "bounds":
        for r in S.bounds(G.delete_vertices(e, forced)).orderBy("bound").collect():
            print(f"#{r.bound} bound: {r.value}")
    else:
        if not args.out:
            p.error("opb needs --out")
        X.write_opb(e, G.vertices(e), args.out)


if __name__ == "__main__":
    main()
