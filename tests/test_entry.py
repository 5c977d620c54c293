import __spark_entry__ as entry


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert {"p2_found", "p3_found", "p4_found", "p5_found", "p6_found"} <= set(q)


def test_flagship(spark, data):
    r = entry.entry(spark).first()
    assert (r.size, r.n_uncovered, r.proven) == (25, 0, True)


def test_every_found_query_runs_on_the_smallest_tables(spark, data):
    q = entry.queries()
    for name in ("p2_found", "p3_found", "p4_found", "p5_found", "p6_found"):
        assert q[name](spark, data).count() > 0
