"""Ranks and running totals over groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  The helpers here cut every group into chunks that fit a
task, work inside the chunks, and add what the earlier chunks of the group contribute.  Only per-chunk summaries ever meet in
one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.session import pin

GROUP_LIMIT = 1000  # Spark prunes row_number() <= k before the shuffle up to this k


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, NULL meeting NULL; the keys of ``left`` are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def chunked(df: DataFrame, keys: list[str], seq: str, chunk: int | None = None) -> DataFrame:
    """``df`` in range partitions of (keys, seq), pinned, with the partition as ``_chunk``; sparse numbers make no small chunks.

    Partitions hold about ``chunk`` rows, or what Spark makes of the size of the input.
    """
    parts = [] if chunk is None else [max(1, -(-df.count() // chunk))]
    return pin(df.repartitionByRange(*parts, *keys, seq).withColumn("_chunk", F.spark_partition_id()))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt into partitions of about ``rows`` rows, for steps that make many rows of each: small files would put them all into one task."""
    return df.repartition(max(1, -(-df.count() // rows)))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank.

    For k up to GROUP_LIMIT Spark keeps at most k rows of a group per input partition before it shuffles (WindowGroupLimit), so
    a hot group costs no more than a cold one; larger k goes through ``global_rank``.
    """
    if k > GROUP_LIMIT:
        return global_rank(df, keys, order, rank_col).filter(F.col(rank_col) <= k)
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def global_rank(
    df: DataFrame, keys: list[str], order: list[Column], rank_col: str = "rank", size_col: str | None = None
) -> DataFrame:
    """Exact 1-based rank inside each group, and optionally the group size, without a per-group task.

    The rows are range-partitioned on (keys, order), so a group may span any number of tasks.  ``order`` must be total within
    a group: equal rows could otherwise not be split.  The sorted rows are pinned, each partition counts its rows per group,
    and the running sum of those counts (one row per partition and group in it) turns local positions into ranks.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(k) for k in keys] + order
    placed = pin(
        df.repartitionByRange(partitions, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    per_part = placed.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *keys,
        "_pid",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_n").over(group).alias("_size"),
    )
    # one row per partition and group in it; Spark broadcasts it where its size in bytes allows
    out = same_keys(placed, offsets, [*keys, "_pid"]).withColumn(rank_col, F.col("_pos") + F.col("_shift"))
    if size_col:
        out = out.withColumn(size_col, F.col("_size"))
    return out.drop("_pid", "_pos", "_shift", "_size")


def running(
    df: DataFrame, keys: list[str], seq: str, totals: dict[str, tuple[str, Column]], inclusive: bool = True, chunk: int | None = None
) -> DataFrame:
    """Running sum / max / min per group in the order of ``seq``, which is unique within a group and may be sparse.

    ``totals`` maps a new column to ("sum" | "max" | "min", expression).  Rows are range-partitioned on (keys, seq), see ``chunked``; a
    chunk is what one group has in one partition, however hot the group.  With ``inclusive=False`` the row itself is left out.
    """
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    base = chunked(df, keys, seq, chunk)
    for name, (_, expr) in totals.items():
        base = base.withColumn(f"_v_{name}", expr)
    summary = base.groupBy(*keys, "_chunk").agg(*[kinds[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in totals.items()])
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, "_chunk", *[kinds[k](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in totals.items()]
    )
    local = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    local = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = same_keys(base, carry, [*keys, "_chunk"])
    for name, (kind, _) in totals.items():
        inside, before = kinds[kind](f"_v_{name}").over(local), F.col(f"_c_{name}")
        if kind == "sum":
            value = F.coalesce(inside, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif kind == "max":
            value = F.greatest(inside, before)
        else:
            value = F.least(inside, before)
        out = out.withColumn(name, value)
    return out.drop("_chunk", *[f"_v_{n}" for n in totals], *[f"_c_{n}" for n in totals])
