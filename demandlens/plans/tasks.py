"""Search tasks: seeds, expansion levels, de-duplication, cache lookup."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text
from demandlens.operators import ordering


def seed_list(raw: Column, limit: int = 3) -> Column:
    """The first three non-empty normalised seeds of a comma list."""
    return F.slice(F.filter(F.transform(F.split(raw, ","), text.norm), lambda s: s != ""), 1, limit)


def seeds(scans: DataFrame) -> DataFrame:
    return scans.select("search_id", F.posexplode(seed_list(F.col("seed"))).alias("seed_no", "seed"))


def depth_profiles(spark: SparkSession) -> DataFrame:
    """(depth, wide, l2, l2_sources): three rows."""
    rows = [(k, wide, l2, list(src)) for k, (wide, l2, src) in fixed.DEPTHS.items()]
    return spark.createDataFrame(rows, "depth string, wide boolean, l2 int, l2_sources array<string>")


def known_depth(depth: Column) -> Column:
    return F.when(depth.isin(*fixed.DEPTHS), depth).otherwise("quick")


def with_profile(scans: DataFrame) -> DataFrame:
    """Scans with their depth profile; an unknown depth is quick.  The profile table has three rows."""
    profile = F.broadcast(depth_profiles(scans.sparkSession))
    return scans.withColumn("depth", known_depth(F.col("depth"))).join(profile, "depth")


def _templates(suffixes, prefixes) -> list[tuple[str, str, float]]:
    """(condition, format, weight) in generation order; {s} is the seed, {c} the city."""
    out = [("always", "{s}", 1.0)]
    out += [("always", "{s} " + m, 1.0) for m in suffixes]
    out += [("always", m + " {s}", 0.9) for m in prefixes]
    out += [("always", "{s} " + x, 0.8) for x in fixed.LETTERS]
    out += [("wide", "{s} " + x, 0.8) for x in fixed.DIGITS]
    out += [("wide", x + " {s}", 0.6) for x in fixed.LETTERS]
    out += [("city", f, w) for f, w in fixed.CITY_TEMPLATES]
    return out


def _fill(fmt: str) -> list[tuple[str, str]]:
    """Split a template into ("text", ...), ("seed", ""), ("city", "") pieces."""
    pieces, rest = [], fmt
    while rest:
        at = min((i for i in (rest.find("{s}"), rest.find("{c}")) if i >= 0), default=-1)
        if at < 0:
            pieces.append(("text", rest))
            break
        if at:
            pieces.append(("text", rest[:at]))
        pieces.append(("seed" if rest[at + 1] == "s" else "city", ""))
        rest = rest[at + 3 :]
    return pieces


#: Scans that one task expands, into about a thousand tasks each at most.
SCANS_A_TASK = 500


def expand_level1(scans: DataFrame, suffixes=fixed.SUFFIXES, prefixes=fixed.PREFIXES) -> DataFrame:
    """(search_id, source, q, w, ord) for every source, seed and template of every scan, first weight of a repeat kept.

    The templates are a literal array exploded next to the scan (no join); the scans are dealt out before, and the de-duplication shuffles.
    """
    templates = _templates(suffixes, prefixes)
    before, after = [], []  # text around the seed; city templates go through their own branch
    for _, fmt, _ in templates:
        pieces = _fill(fmt)
        i = pieces.index(("seed", ""))
        before.append("".join(t for _, t in pieces[:i]))
        after.append("".join("\u0000" if k == "city" else t for k, t in pieces[i + 1 :]))
    entries = [{"b": b, "a": a, "w": w, "c": c, "i": i} for i, ((c, _, w), b, a) in enumerate(zip(templates, before, after))]
    # one constant in the plan
    literal = F.from_json(F.lit(json.dumps(entries)), "array<struct<b:string,a:string,w:double,c:string,i:int>>")
    base = with_profile(ordering.spread(scans, SCANS_A_TASK)).withColumn("city", F.coalesce("city", F.lit("")))
    wanted = (
        (F.col("t.c") == "always") | ((F.col("t.c") == "wide") & F.col("wide")) | ((F.col("t.c") == "city") & (F.col("city") != ""))
    )
    per_source = base.select(
        "search_id", "city", "wide", seed_list(F.col("seed")).alias("seeds"), F.posexplode("sources").alias("s_no", "source")
    )
    per_seed = per_source.select("search_id", "city", "wide", "s_no", "source", F.posexplode("seeds").alias("seed_no", "seed"))
    per_task = per_seed.withColumn("t", F.explode(literal)).filter(wanted)
    number = (F.col("s_no") * 3 + F.col("seed_no")) * len(templates) + F.col("t.i")
    q = F.concat("t.b", "seed", F.replace(F.col("t.a"), F.lit("\u0000"), F.col("city")))
    return dedupe_tasks(per_task.select("search_id", "source", q.alias("q"), F.col("t.w").alias("w"), number.alias("ord")))


def dedupe_tasks(tasks: DataFrame) -> DataFrame:
    """Keep the first task of each (scan, source, query) in generation order, with its weight."""
    return tasks.groupBy("search_id", "source", "q").agg(F.min_by("w", "ord").alias("w"), F.min("ord").alias("ord"))


def expand_level2(ranked: DataFrame, scans: DataFrame, switched_off: DataFrame | None = None) -> DataFrame:
    """The strongest phrases of at most four words with every letter appended, on the level-2 sources still in use.

    ``switched_off(search_id, source)`` lists sources the breaker has taken out.
    """
    most = max(n for _, n, _ in fixed.DEPTHS.values())
    short = ranked.filter(F.size(F.split("phrase", " ")) <= 4).select("search_id", "phrase", "score")
    top = ordering.top_per_group(short, ["search_id"], [F.col("score").desc(), F.col("phrase").asc()], most, "pos")
    chosen = with_profile(scans).select(
        "search_id", "l2", F.posexplode(F.filter("l2_sources", lambda s: F.array_contains("sources", s))).alias("s_no", "source")
    )
    if switched_off is not None:
        chosen = chosen.join(switched_off.select("search_id", "source").distinct(), ["search_id", "source"], "left_anti")
    letters = F.posexplode(F.array(*[F.lit(x) for x in fixed.LETTERS])).alias("l_no", "letter")
    tasks = top.join(chosen, "search_id").filter(F.col("pos") <= F.col("l2"))
    tasks = tasks.select("search_id", "source", "phrase", "pos", "s_no", letters)
    return dedupe_tasks(
        tasks.select(
            "search_id",
            "source",
            F.concat_ws(" ", "phrase", "letter").alias("q"),
            F.lit(0.6).alias("w"),
            ((F.col("s_no") * most + F.col("pos") - 1) * 26 + F.col("l_no")).alias("ord"),
        )
    )


def cache_key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *parts)


def suggestion_key(source: Column, lang: Column, country: Column, q: Column) -> Column:
    return cache_key("sg", source, lang, F.lower(country), text.norm(q))


def latest_entries(cache: DataFrame) -> DataFrame:
    """``cache(k, v, exp, written)``: the newest write of every key wins."""
    newest = F.max_by(F.struct("v", "exp"), F.struct("written", "exp", "v"))
    return cache.groupBy("k").agg(newest.alias("e"), F.max("written").alias("written")).select("k", "e.v", "e.exp", "written")


def upsert_cache(cache: DataFrame, writes: DataFrame) -> DataFrame:
    return latest_entries(cache.unionByName(writes))


def cache_lookup(tasks: DataFrame, cache: DataFrame, now) -> DataFrame:
    """``tasks(k, ...)`` with ``v`` and ``hit``: a hit has a value and ``exp >= now``.

    Expired entries are dropped after the newest write is known and before the join, so only live keys are joined.
    """
    live = latest_entries(cache).filter((F.col("exp") >= F.lit(now)) & F.col("v").isNotNull()).select("k", "v")
    return tasks.join(live, "k", "left").withColumn("hit", F.col("v").isNotNull())
