"""First-come matching of two kinds of keys, in rounds whose number grows with the logarithm of the longest chain of waiting rows.

Rows (t, p, w) come in the order of ``t``; a row is taken if neither of its keys was taken before.  So a row is taken exactly if no
earlier row that shares a key is.  Each round takes every row that is first in line at both keys and lets all other rows of the keys go.
Rows that wait for exactly one other row know that they are taken if that one is not.  They keep a reference to it, and whether they are
equal or opposite to it; references to rows that refer on are replaced by theirs (pointer doubling), so 2^k rows that wait for one
another in a chain are settled after about k rounds, not 2^k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.session import pin

#: Rounds before references are passed on: most rows are settled by then.
EARLY = 3


def _first_two(rows: DataFrame, key: str) -> DataFrame:
    """(key, key1, key2): the first two times of each key.  Spark keeps two rows a key and partition before it shuffles."""
    order = Window.partitionBy(key).orderBy("t")
    two = rows.select(key, "t").withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
    return two.groupBy(key).agg(F.min("t").alias(f"{key}1"), F.max(F.when(F.col("_n") == 2, F.col("t"))).alias(f"{key}2"))


def first_come(rows: DataFrame) -> DataFrame:
    """(t, p, w) of the rows that are taken.  ``t`` is unique; no key is NULL."""
    t, none = F.col("t"), F.lit(None)
    active = pin(rows.select("t", "p", "w", none.cast("long").alias("ref"), F.lit(False).alias("opposite")))
    taken, before, done = rows.select("t", "p", "w").limit(0), None, 0
    while not active.isEmpty():
        at = active.join(_first_two(active, "p"), "p").join(_first_two(active, "w"), "w")
        first_p, first_w = t == F.col("p1"), t == F.col("w1")
        second_p, second_w = t == F.col("p2"), t == F.col("w2")
        waits_for = F.when(first_p & second_w, F.col("w1")).when(first_w & second_p, F.col("p1"))
        waits_for = waits_for.when(second_p & second_w & (F.col("p1") == F.col("w1")), F.col("p1"))
        seen = at.select("t", "p", "w", (first_p & first_w).alias("ready"), F.coalesce("ref", waits_for).alias("ref"), F.when(F.col("ref").isNull(), waits_for.isNotNull()).otherwise(F.col("opposite")).alias("opposite"))
        told = seen.select(t.alias("r_t"), F.col("ready").alias("r_taken"))
        if before is not None:
            told = told.unionByName(before.select(t.alias("r_t"), F.lit(True).alias("r_taken")))
        # a row that is neither active nor was taken in the round before has been let go
        known = F.when(F.col("r_t").isNull(), F.col("opposite")).when(F.col("r_taken"), ~F.col("opposite"))
        settled = pin(
            seen.join(told, F.col("ref") == F.col("r_t"), "left").select(
                "t", "p", "w", "ref", "opposite", F.when(F.col("ready"), True).when(F.col("ref").isNotNull(), known).alias("taken")
            )
        )
        done += 1
        stepped = settled if done <= EARLY else _passed_on(settled)
        before = stepped.filter("taken").select("t", "p", "w")
        taken = taken.unionByName(before)
        left = stepped.filter("taken IS NULL").drop("taken")
        active = pin(left.join(before.select("p"), "p", "left_anti").join(before.select("w"), "w", "left_anti").select("t", "p", "w", "ref", "opposite"))
    return taken


def _passed_on(settled: DataFrame) -> DataFrame:
    """Rows take over what is known of the row they refer to, or the reference it has itself."""
    further = settled.select(F.col("t").alias("r_t"), F.col("taken").alias("r_taken"), F.col("ref").alias("r_ref"), F.col("opposite").alias("r_opposite"))
    jumped = F.col("r_ref").isNotNull()
    return pin(
        settled.join(further, F.col("ref") == F.col("r_t"), "left").select(
            "t",
            "p",
            "w",
            F.coalesce("taken", F.col("r_taken") != F.col("opposite")).alias("taken"),
            F.when(jumped, F.col("r_ref")).otherwise(F.col("ref")).alias("ref"),
            F.when(jumped, F.col("opposite") != F.col("r_opposite")).otherwise(F.col("opposite")).alias("opposite"),
        )
    )
