"""Funnel, conversion, daily activity and reply rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text
from demandlens.operators import ordering


def funnel(leads: DataFrame, activities: DataFrame) -> DataFrame:
    """One row: found, reachable, contacted, replied, pilot, won.

    One pass over the leads; the replied leads are first made distinct by a shuffle on lead_id, so the count never gathers them.
    """
    answered = (F.col("type") == "replied") | ((F.col("type") == "called") & (F.col("body") == "interested"))
    replied = activities.filter(answered).select("lead_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return leads.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("phone_type") != "invalid").alias("reachable"),
        F.count_if(F.col("touches") > 0).alias("contacted"),
        F.count_if(F.col("pilot_start").isNotNull()).alias("pilot"),
        F.count_if(F.col("stage") == "won").alias("won"),
    ).select("found", "reachable", "contacted", replied.alias("replied"), "pilot", "won")


def funnel_conversion(funnel_row: DataFrame) -> DataFrame:
    """Six rows: stage, n, n of the stage before, ratio and rounded percent (NULL where the stage before is empty)."""
    steps = ("found", "reachable", "contacted", "replied", "pilot", "won")
    entries = [
        F.struct(
            F.lit(i).alias("i"), F.lit(label).alias("stage"), F.col(c).alias("n"),
            (F.col(steps[i - 1]) if i else F.lit(None).cast("long")).alias("prev"),
            F.lit(fixed.FUNNEL_STAGES[i - 1] if i else None).alias("prev_stage"),
        )
        for i, (c, label) in enumerate(zip(steps, fixed.FUNNEL_STAGES))
    ]
    ratio = F.when(F.col("prev") > 0, F.col("n") / F.col("prev"))
    return (
        funnel_row.select(F.inline(F.array(*entries)))
        .withColumn("ratio", ratio)
        .withColumn("percent", text.js_round(F.col("ratio") * 100).cast("int"))
    )


def weakest_step(conversion: DataFrame, least: int = 5) -> DataFrame:
    """The step with the lowest ratio among those whose stage before holds at least ``least``; the first of equals."""
    judged = conversion.filter(F.col("prev") >= least)
    return judged.agg(
        F.min_by(F.struct("prev_stage", "stage", "percent"), F.struct("ratio", "i")).alias("w")
    ).select(F.col("w.prev_stage").alias("from_stage"), F.col("w.stage").alias("to_stage"), F.col("w.percent").alias("percent"))


def daily_activity(activities: DataFrame, now, days: int = 14) -> DataFrame:
    """One row per day, oldest first, today last: sent and replied activities, zero-filled.

    The range filter on ``at`` reaches the scan.  Days are those of the session zone.
    """
    today = F.to_date(F.lit(now))
    spine = activities.sparkSession.range(days).select(F.date_sub(today, (F.lit(days - 1) - F.col("id")).cast("int")).alias("day"))
    start = F.date_trunc("day", F.lit(now)) - F.expr(f"INTERVAL {days - 1} DAYS")
    recent = activities.filter((F.col("at") >= start) & (F.col("at") < start + F.expr(f"INTERVAL {days} DAYS")))
    counts = (
        recent.filter(F.col("type").isin("sent", "replied"))
        .groupBy(F.to_date("at").alias("day"))
        .agg(F.count_if(F.col("type") == "sent").alias("sent"), F.count_if(F.col("type") == "replied").alias("replied"))
    )
    return spine.join(F.broadcast(counts), "day", "left").select(  # at most ``days`` rows
        "day", F.coalesce("sent", F.lit(0)).alias("sent"), F.coalesce("replied", F.lit(0)).alias("replied")
    )


def activity_totals(daily: DataFrame) -> DataFrame:
    return daily.agg(F.sum("sent").alias("sent"), F.sum("replied").alias("replied"))


def reply_rate(leads: DataFrame, dims: tuple[str, ...] = ("lang", "query"), top: int = 12) -> DataFrame:
    """(dim, k, contacted, replied, rate) for the ``top`` values of each dimension among touched leads; one pass for all."""
    keys = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), text.or_blank(F.col(d)).alias("k")) for d in dims]))
    won_over = F.col("stage").isin("replied", "pilot", "won") | F.col("pilot_start").isNotNull()
    counts = (
        leads.filter(F.col("touches") > 0)
        .select(won_over.alias("r"), keys.alias("v"))
        .filter(F.col("v.k") != "")
        .groupBy("v.dim", "v.k")
        .agg(F.count(F.lit(1)).alias("contacted"), F.count_if("r").alias("replied"))
    )
    ranked = ordering.top_per_group(counts, ["dim"], [F.col("contacted").desc(), F.col("k").asc()], top)
    return ranked.withColumn("rate", text.js_round(F.col("replied") / F.col("contacted") * 100).cast("int"))


def stage_counts(leads: DataFrame) -> DataFrame:
    return leads.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
