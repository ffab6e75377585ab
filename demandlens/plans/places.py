"""Place searches: plan, cost, budget, pages, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions import text
from demandlens.operators import ordering
from demandlens.plans.grid import cover_grid

MAX_QUERIES = 12
MAX_LOCALITIES = 80
PAGE_SIZE = 20
#: Requests that one task plans, into MAX_QUERIES * MAX_LOCALITIES searches each at most, or as many circles.
REQUESTS_A_TASK = 10_000


def _distinct_trimmed(items: Column, most: int) -> Column:
    cleaned = F.transform(F.coalesce(items, F.array().cast("array<string>")), text.js_trim)
    return F.slice(F.array_distinct(F.filter(cleaned, lambda s: s != "")), 1, most)


def clamp_pages(pages: Column) -> Column:
    wanted = F.when(F.coalesce(pages, F.lit(0)) == 0, 3).otherwise(pages)
    return F.least(F.lit(3), F.greatest(F.lit(1), wanted))


def plan_searches(requests: DataFrame, cover_km: float = 12, step_km: float = 4) -> DataFrame:
    """``requests(plan_id, queries, city, mode, localities, pages, lat, lng)`` -> one row per search.

    Modes: ``localities`` (query in locality, city), ``grid`` (city search biased to each circle of the lattice), anything else
    one city-wide search per query.  ``bias`` is a nullable struct(lat, lng, radius).  Requests are dealt out before they are planned.
    """
    city = text.js_trim(text.or_blank(F.col("city")))
    base = ordering.spread(requests, REQUESTS_A_TASK).select(
        "plan_id",
        city.alias("city"),
        F.coalesce("mode", F.lit("city")).alias("mode"),
        clamp_pages(F.col("pages")).alias("pages"),
        _distinct_trimmed(F.col("localities"), MAX_LOCALITIES).alias("localities"),
        "lat",
        "lng",
        F.posexplode(_distinct_trimmed(F.col("queries"), MAX_QUERIES)).alias("q_no", "query"),
    )
    no_bias = F.lit(None).cast("struct<lat:double,lng:double,radius:int>")
    plain_text = F.when(F.col("city") != "", F.concat("query", F.lit(" in "), "city")).otherwise(F.col("query"))
    at_locality = F.concat("query", F.lit(" in "), "locality", F.when(F.col("city") != "", F.concat(F.lit(", "), "city")).otherwise(""))
    by_locality = (
        base.filter(F.col("mode") == "localities")
        .select("*", F.posexplode("localities").alias("sub_no", "locality"))
        .select("plan_id", "pages", "q_no", "sub_no", "query", at_locality.alias("text"), no_bias.alias("bias"))
    )
    circles = cover_grid(base.filter((F.col("mode") == "grid") & F.col("lat").isNotNull()), cover_km, step_km)
    by_circle = circles.select(
        "plan_id", "pages", "q_no", F.col("point_no").alias("sub_no"), "query", plain_text.alias("text"),
        F.struct(F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng"), "radius").alias("bias"),
    )
    by_city = base.filter(~F.col("mode").isin("localities", "grid")).select(
        "plan_id", "pages", "q_no", F.lit(0).alias("sub_no"), "query", plain_text.alias("text"), no_bias.alias("bias")
    )
    return by_locality.unionByName(by_circle).unionByName(by_city)


def plan_estimate(searches: DataFrame, used_today: DataFrame, cap: int = 200, usd_per_request: float = 0.035) -> DataFrame:
    """Per plan: searches, worst-case requests, requests left today, estimated cost and three sample texts.

    ``used_today(n)`` is summed to one value by a scalar subquery.  The samples are cut to three before they are collected.
    """
    sized = searches.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("searches"), F.sum("pages").cast("long").alias("worst_requests")
    )
    first = ordering.top_per_group(searches.select("plan_id", "q_no", "sub_no", "text"), ["plan_id"], [F.col("q_no"), F.col("sub_no")], 3)
    samples = first.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("s"))
    used = used_today.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    return (
        sized.join(samples, "plan_id")
        .select(
            "plan_id",
            "searches",
            "worst_requests",
            F.greatest(F.lit(0), F.lit(cap or 200) - used).alias("room_today"),
            text.to_fixed(F.col("worst_requests") * F.lit(usd_per_request), 2).alias("est_usd"),
            F.transform("s", lambda x: x["text"]).alias("sample"),
        )
    )


#: Answers that say the key or the request itself is refused.
STOPS = (400, 401, 403)


def request_budget(room: Column, asked: Column, worst: Column) -> Column:
    """Requests a run may make: what was asked for, or else what the plan needs at worst, at least 1, and no more than is left today."""
    wanted = F.when(F.coalesce(asked, F.lit(0)) == 0, worst).otherwise(asked)
    return F.least(room, F.greatest(F.lit(1), wanted))


def admit_tasks(
    tasks: DataFrame, budget: Column | int, keys: tuple[str, ...] = ("plan_id",), chunk: int | None = None
) -> DataFrame:
    """Admit searches in the order of ``ord`` until the request budget is spent.

    ``tasks(keys..., ord, pages, needed, failed)``: ``needed`` is what the search would really use (at most ``pages``).  A search
    may use what is left, gives back what it does not need, and is not started at all once nothing is left.  A failed search
    keeps its whole reservation and meters nothing; one that failed with a ``status`` (if there is that column) of STOPS ends the plan, and nothing after it is started.
    Adds ``allowed``, ``used``, ``admitted``.  Running totals are cut into
    range partitions of ``ord``; searches take their turn one after the other, which fixes one order of the concurrent original.
    """
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    takes = F.when(F.col("failed"), F.col("pages")).otherwise(F.least("needed", "pages"))
    prior = ordering.running(tasks, list(keys), "ord", {"_prior": ("sum", takes)}, inclusive=False, chunk=chunk)
    allowed = F.least(F.col("pages"), F.greatest(F.lit(0), budget - F.col("_prior")))
    if "status" in tasks.columns:
        refused = prior.filter(F.col("failed") & F.col("status").isin(*STOPS) & (allowed > 0))
        first = refused.groupBy(*keys).agg(F.min("ord").alias("_stop"))  # one row a plan
        prior = ordering.same_keys(prior, first, list(keys), "left")
        allowed = F.when(F.coalesce(F.col("ord") > F.col("_stop"), F.lit(False)), 0).otherwise(allowed)
    return (
        prior.withColumn("allowed", allowed)
        .withColumn("used", F.when(F.col("failed"), F.lit(0)).otherwise(F.least("needed", "allowed")))
        .withColumn("admitted", F.col("allowed") > 0)
        .drop("_prior", "_stop")
    )


def utc_day(at: Column) -> Column:
    """The UTC date of a moment, whatever the zone of the session."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(at.cast("timestamp")) / 86_400_000_000).cast("int"))


def usage_daily(log: DataFrame) -> DataFrame:
    """``log(at, api, n)`` -> requests per UTC day and api; the session zone must be UTC."""
    return log.groupBy(utc_day(F.col("at")).alias("day"), "api").agg(F.sum("n").cast("long").alias("n"))


def used_on(usage: DataFrame, api: str, day) -> DataFrame:
    """One row: requests of one api on one day, 0 if there were none."""
    return usage.filter((F.col("api") == api) & (F.col("day") == F.lit(day))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def follow_pages(pages: DataFrame, keys: tuple[str, ...] = ("search_no",), most: int = 3) -> DataFrame:
    """Pages of a search up to and with the first that has no next token or fewer than 20 results, at most ``most``.

    ``pages(keys..., page, results, token)``.
    """
    candidates = pages.filter(F.col("page") <= most)
    last = F.col("token").isNull() | (F.col("token") == "") | (F.col("results") < PAGE_SIZE)
    stop = candidates.filter(last).groupBy(*keys).agg(F.min("page").alias("_stop"))
    return candidates.join(stop, list(keys), "left").filter(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop"))).drop("_stop")


def prefill_queries(keywords: DataFrame, scans: DataFrame, loaded: int = 100, most: int = 2) -> DataFrame:
    """Queries to start a place search with: the first local phrases of a scan without a place, else "<first seed> classes".

    ``keywords`` carries ``rank``; as in an interactive list only the first ``loaded`` rows of a scan are looked at.
    """
    fits = (
        (F.col("rank") <= loaded)
        & (F.col("intent") == "local")
        & (F.col("place") == "")
        & (F.size(F.split("phrase", " ")) <= 3)
        & ~F.col("phrase").rlike("near me|online|free")
    )
    chosen = ordering.top_per_group(keywords.filter(fits).select("search_id", "phrase", "rank"), ["search_id"], [F.col("rank")], most, "n")
    listed = chosen.groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("l"))
    first_seed = F.trim(F.get(F.split("seed", ","), F.lit(0)))
    fallback = F.when(first_seed != "", F.array(F.concat(first_seed, F.lit(" classes")))).otherwise(
        F.array().cast("array<string>")
    )
    return scans.join(listed, "search_id", "left").select(
        "search_id", F.coalesce(F.transform("l", lambda x: x["phrase"]), fallback).alias("queries")
    )
