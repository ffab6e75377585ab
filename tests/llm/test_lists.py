"""Index lists of the Jaccard join: what an entry learns of its list, with one move of all entries."""

from demandlens.llm import jaccard


def test_first_lists_move_entries_once(spark):
    rows = [(1, 10, 5, 0, 3), (1, 20, 6, 1, 2), (1, 30, 7, 0, 4), (2, 10, 5, 1, 3), (3, 20, 6, 0, 2), (3, 40, 6, 0, 9)]
    entries = spark.createDataFrame(rows, "t long, c long, n long, pos long, u int")
    out = jaccard.with_lists(entries)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.t, r.c): (r.root, r.m, r.main, r.most, r.first) for r in out.collect()}
    assert got == {(1, c): (c, 3, 30, 1, 20) for c in (10, 20, 30)} | {(3, c): (c, 2, 40, 1, 20) for c in (20, 40)}
