"""Chunked ranks and running totals equal plain windows, with one group holding most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandlens.operators import ordering


def test_rank_and_running(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.8 else rng.randrange(2, 6), n, rng.randrange(5), rng.randrange(100)) for n in range(3000)]
    df = spark.createDataFrame(rows, "g long, seq long, score int, v long")
    order = [F.col("score").desc(), F.col("seq").asc()]
    w = Window.partitionBy("g")
    want = df.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "size": F.count("*").over(w)})
    got = ordering.global_rank(df, ["g"], order, "rank", "size")
    assert {(r.seq, r.rank, r["size"]) for r in got.collect()} == {(r.seq, r.rank, r["size"]) for r in want.collect()}

    upto = w.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("v").over(upto), "hi": F.max("v").over(upto), "lo": F.min("v").over(upto)})
    totals = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}
    got = ordering.running(df, ["g"], "seq", totals, chunk=64)
    assert {(r.seq, r.s, r.hi, r.lo) for r in got.collect()} == {(r.seq, r.s, r.hi, r.lo) for r in want.collect()}


def test_hot_group_is_split(spark):
    """All rows of one group do not meet in one partition, and a top-k is pruned before its shuffle."""
    df = spark.range(20000).selectExpr("id div 100000 as g", "id", "id % 7 as score")
    ranked = ordering.global_rank(df, ["g"], [F.col("score").desc(), F.col("id")])
    parts = ranked.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 20000
    plan = ordering.top_per_group(df, ["g"], [F.col("id")], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
