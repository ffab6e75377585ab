"""Outcomes of suggestion requests: classification, the per-source breaker, scan summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text
from demandlens.operators import ordering
from demandlens.session import pin

MAX_STRIKES = 4
MAX_ERRORS = 25


def outcome(status: Column, has_list: Column) -> Column:
    """rate / err / ok from an HTTP status (NULL = the request failed) and whether the body held a list."""
    return (
        F.when(status.isin(429, 403, 503) | ((status >= 300) & (status < 400)), "rate")
        .when(status.isNull() | (status < 200) | (status >= 300) | ~F.coalesce(has_list, F.lit(False)), "err")
        .otherwise("ok")
    )


def classify_attempts(tries: DataFrame, keys: tuple[str, ...] = ("search_id", "source", "seq")) -> DataFrame:
    """``tries(..., try_no, status, has_list)`` -> one row per task: the last outcome and the number of requests made."""
    with_outcome = tries.withColumn("outcome", outcome(F.col("status"), F.col("has_list")))
    return with_outcome.groupBy(*keys).agg(
        F.max_by("outcome", "try_no").alias("outcome"), F.count(F.lit(1)).alias("requests")
    )


def breaker(
    attempts: DataFrame, keys: tuple[str, ...] = ("search_id", "source"), chunk: int | None = None, start: DataFrame | None = None
) -> DataFrame:
    """Running strikes and errors of every source since its last ok, when it is switched off, and what is skipped after that.

    ``attempts(keys..., seq, outcome)``: ``seq`` is an integer, unique per source; a cached answer has outcome ``cached`` and
    touches no counter.  Adds ``strikes``, ``errs`` (after the attempt), ``off_at`` (seq of the attempt that switches the source
    off) and ``skipped``.  The order of attempts is that of ``seq``.  A source may hold any share of the rows: counts run inside
    range partitions (about ``chunk`` rows each, if set), and only one summary row per partition meets the others of its source.

    ``start(keys..., strikes0, errs0, off0, reason0)``: counts of sources that had attempts before these, and where they were switched off.
    """
    keys = list(keys)
    ok, rate, err = F.col("outcome") == "ok", F.col("outcome") == "rate", F.col("outcome") == "err"
    inside = Window.partitionBy(*keys, "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = ordering.chunked(attempts, keys, "seq", chunk).withColumns(
        {"_r": F.count_if(rate).over(inside), "_e": F.count_if(err).over(inside)}
    )
    # counts never fall, so their value at the last ok is their largest value at any ok so far
    local = pin(
        counted.withColumns(
            {"_r_ok": F.max(F.when(ok, F.col("_r"))).over(inside), "_e_ok": F.max(F.when(ok, F.col("_e"))).over(inside)}
        )
    )
    per_chunk = local.groupBy(*keys, "_chunk").agg(*[F.max(c).alias(c) for c in ("_r", "_e", "_r_ok", "_e_ok")])
    until = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = per_chunk.withColumns({f"_b{c}": F.coalesce(F.sum(c).over(until), F.lit(0)) for c in ("_r", "_e")})
    carry = totals.select(
        *keys, "_chunk", "_b_r", "_b_e",
        *[F.max(F.col(f"_b{c}") + F.col(f"{c}_ok")).over(until).alias(f"_base{c}") for c in ("_r", "_e")],
    )
    none = {"strikes0": "long", "errs0": "long", "off0": "long", "reason0": "string"}
    if start is not None:
        carry = ordering.same_keys(carry, start.select(*keys, *none), keys, "left")
    else:
        carry = carry.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()})
    # before the first ok of all, the counts go on from those at the start
    for c, n in (("_r", "strikes0"), ("_e", "errs0")):
        carry = carry.withColumn(f"_base{c}", F.coalesce(f"_base{c}", -F.col(n), F.lit(0)))
    joined = ordering.same_keys(local, carry, [*keys, "_chunk"])

    def since_ok(c: str) -> Column:
        return F.col(c) - F.coalesce(F.col(f"{c}_ok"), F.col(f"_base{c}") - F.col(f"_b{c}"))

    since = joined.withColumns({"strikes": since_ok("_r"), "errs": since_ok("_e")}).select(*attempts.columns, "strikes", "errs", "off0", "reason0")
    trips = ((F.col("outcome") == "rate") & (F.col("strikes") >= MAX_STRIKES)) | (
        (F.col("outcome") == "err") & (F.col("errs") >= MAX_ERRORS)
    )
    off = since.filter(trips).groupBy(*keys).agg(F.min("seq").alias("off_at"), F.min_by("outcome", "seq").alias("off_reason"))
    out = ordering.same_keys(since, off, keys, "left").withColumns({"off_at": F.coalesce("off0", "off_at"), "off_reason": F.coalesce("reason0", "off_reason")})
    return out.drop("off0", "reason0").withColumn("skipped", F.coalesce(F.col("seq") > F.col("off_at"), F.lit(False)))


def switched_off(breaker_rows: DataFrame) -> DataFrame:
    return breaker_rows.filter(F.col("seq") == F.col("off_at")).select("search_id", "source", "off_at", "off_reason")


def scan_summary(breaker_rows: DataFrame, phrases: DataFrame, stopped: DataFrame | None = None, planned: DataFrame | None = None) -> DataFrame:
    """Per scan: done, total, requests, cached, distinct phrases, status and the sentences about switched-off sources.

    ``breaker_rows`` needs ``requests``; ``phrases(search_id, phrase)`` holds distinct phrases; ``stopped(search_id)`` lists
    scans the user ended.  ``planned(search_id, total)`` holds how many tasks were planned, of which ``done`` were taken up; without it all were.
    """
    kept = ~F.col("skipped")
    per_scan = breaker_rows.groupBy("search_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.lit(1)).alias("done"),
        F.coalesce(F.sum(F.when(kept & (F.col("outcome") != "cached"), F.col("requests"))), F.lit(0)).alias("requests"),
        F.count_if(kept & (F.col("outcome") == "cached")).alias("cached"),
    )
    label = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for name, shown, _ in fixed.SOURCES for x in (name, shown)]), F.col("source")),
        F.col("source"),
    )
    sentence = F.when(F.col("off_reason") == "rate", text.filled(fixed.OFF_SENTENCES["rate"], label)).otherwise(text.filled(fixed.OFF_SENTENCES["err"], label))
    # at most one row per source of a scan
    notes = (
        switched_off(breaker_rows)
        .groupBy("search_id")
        .agg(F.array_sort(F.collect_list(F.struct("off_at", "source", sentence.alias("s")))).alias("n"))
        .select("search_id", F.array_join(F.transform("n", lambda x: x["s"]), " ").alias("note"))
    )
    found = phrases.groupBy("search_id").agg(F.count(F.lit(1)).alias("phrases"))
    if planned is not None:
        known = planned.groupBy("search_id").agg(F.max("total").alias("_planned"))
        per_scan = per_scan.join(known, "search_id", "left").withColumn("total", F.coalesce("_planned", "total")).drop("_planned")
    out = per_scan.join(notes, "search_id", "left").join(found, "search_id", "left")
    aborted = F.lit(False)
    if stopped is not None:
        out = out.join(stopped.select("search_id", F.lit(True).alias("_stopped")).distinct(), "search_id", "left")
        aborted = F.coalesce("_stopped", F.lit(False))
    return out.select(
        "search_id", "done", "total", "requests", "cached",
        F.coalesce("phrases", F.lit(0)).alias("phrases"),
        F.when(aborted, "stopped").when(F.col("note").isNotNull(), "partial").otherwise("done").alias("status"),
        F.coalesce("note", F.lit("")).alias("note"),
    )
