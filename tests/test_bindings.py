import duckdb

from fieldloom.plans import bindings

SF = "/root/testdata/sf0.001"


def test_edges_are_counted_in_parts_of_few_lines(spark, monkeypatch):
    """One part held a share of all pairs that grew with the table."""
    monkeypatch.setattr(bindings, "PART_LINES", 500)
    frames = type(spark.range(1))
    dealt, own = [], frames.repartition
    monkeypatch.setattr(frames, "repartition", lambda df, n, *c: (dealt.append(n), own(df, n, *c))[1])
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    lines = con.execute("select count(*) from lineitem").fetchall()[0][0]
    got = bindings.Tables(spark, SF).edges().collect()
    assert len(dealt) == 2 and all(lines / n <= 500 for n in dealt)
    want = con.execute(bindings.with_tables("edges") + " select u, v, length, lanes from edges").fetchall()
    assert sorted((r.u, r.v, round(r.length, 6), r.lanes) for r in got) == sorted((u, v, round(x, 6), n) for u, v, x, n in want)
