"""URL filters: rules first, then an empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host.  Each level's rate is a beta-binomial posterior whose prior is the posterior of
the level above without the member itself: all pages, then public suffix, registered domain, host.  The weight of the prior is fitted per level from how far the rates of its
members scatter (method of moments).  A page is blocked when the posterior says with the asked certainty that its host's rate of good
pages is below the limit, and allowed otherwise.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the rate of the
empty host's outcomes; a host without outcomes has its domain's posterior, a domain without any its suffix's; without any label all is
allowed; rows that repeat are judged each for itself; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import LOWER, UPPER, Shelf

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Suffixes of more than one label under which domains are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.in", "com.br", "co.nz", "co.za")
#: Least acceptable rate of good pages, and how many standard deviations below the mean the bound lies.
LEAST_RATE, DEVIATIONS = 0.6, 1.28
#: Blocked hosts (of 253 characters at most) that are broadcast.
MOST_BROADCAST = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (F.coalesce(F.translate(F.regexp_extract(url, shape, g), UPPER, LOWER) if g == 1 else F.regexp_extract(url, shape, g), F.lit("")) for g in (1, 2))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<verdict, rule> of the longest rule that fits, else null; ties go to the rule listed first."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.element_at(parts, -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more; the host itself where there is none."""
    parts = F.split(host, r"\.")
    keep = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - keep + 1, F.lit(1)), keep), ".")


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good, n): labelled outcomes per host.  A page's outcome is the quality label of the document that its path's last number names."""
    host, path = host_and_path(F.col("url"))
    named = pages.select(host.alias("host"), F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1).try_cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    judged = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # hosts are counted per document first, so that what is joined and shuffled is counts
    per_doc = named.groupBy("doc_id", "host").agg(F.count("*").alias("n"))
    return per_doc.join(judged, "doc_id").groupBy("host").agg(F.sum(F.col("quality") * F.col("n")).alias("good"), F.sum("n").alias("n"))


def posteriors(counts: DataFrame, shelf: Shelf) -> dict[str, DataFrame]:
    """level -> (key, alpha, beta): from the hosts' counts, each level shrunk to the one above."""
    named = counts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "good", "n")
    levels = {
        "suffix": named.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("above", F.lit("")),
        "domain": named.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumnRenamed("suffix", "above"),
        "host": named.select("host", F.col("domain").alias("above"), "good", "n"),
    }
    good, bad = F.col("good"), F.col("n") - F.col("good")
    none = F.lit(0)
    prior = counts.agg(F.sum(good).alias("good"), F.sum("n").alias("n")).select(F.lit("").alias("above"), (F.coalesce(good, none) + 1.0).alias("a"), (F.coalesce(bad, none) + 1.0).alias("b"))
    out = {}
    for level, table in levels.items():
        linked = table.join(F.broadcast(prior) if level == "suffix" else prior, "above")
        # a member is not its own witness: the level above counts without it, and weighs no more than what it has seen
        linked = linked.withColumns({"a": F.greatest(F.col("a") - good, F.lit(1e-3)), "b": F.greatest(F.col("b") - bad, F.lit(1e-3))})
        linked = shelf.put(linked.withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))))
        weight = F.least(F.lit(prior_strength(linked).first().m), F.col("a") + F.col("b"))
        judged = linked.select(F.col(level).alias("key"), (F.col("mean") * weight + good).alias("alpha"), ((1 - F.col("mean")) * weight + bad).alias("beta"))
        out[level] = judged
        prior = judged.select(F.col("key").alias("above"), F.col("alpha").alias("a"), F.col("beta").alias("b"))
    return out


def prior_strength(linked: DataFrame) -> DataFrame:
    """(m): one row, the prior's weight in pages: within-binomial scatter against the scatter seen, between 1 and 1000."""
    rate, mean, n = F.col("good") / F.col("n"), F.col("mean"), F.col("n")
    seen = F.sum(n * (rate - mean) * (rate - mean))
    chance = F.sum(mean * (1 - mean))
    room = F.sum(n * mean * (1 - mean)) - chance
    between = F.greatest((seen - chance) / F.when(room > 0, room), F.lit(1e-3))  # intra-class correlation
    return linked.agg(F.least(F.greatest(F.coalesce(1 / between - 1, F.lit(1000.0)), F.lit(1.0)), F.lit(1000.0)).alias("m"))


def reputations(pages: DataFrame, labels: DataFrame, least: float = LEAST_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, alpha, beta, bound, verdict) of every host that a page has.

    The bound is the posterior mean plus ``deviations`` standard deviations: a host is blocked only if even that is below ``least``.
    """
    shelf = Shelf(pages.sparkSession)
    found = posteriors(shelf.put(outcomes(pages, labels)), shelf)
    host, _ = host_and_path(F.col("url"))
    hosts = pages.select(host.alias("host")).distinct().withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    for level in ("host", "domain", "suffix"):
        table = found[level].select(F.col("key").alias(level), F.struct("alpha", "beta").alias(f"at_{level}"))
        hosts = hosts.join(table, level, "left")
    judged = hosts.select("host", F.coalesce("at_host", "at_domain", "at_suffix", F.struct(F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"))).alias("p")).select("host", "p.alpha", "p.beta")
    a, b = F.col("alpha"), F.col("beta")
    bound = a / (a + b) + deviations * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return judged.withColumn("bound", bound).withColumn("verdict", F.when(F.col("bound") < least, "block").otherwise("allow"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # only blocked hosts are joined: the rest is allowed.  Beyond so many of them Spark joins by shuffle
    blocked = Shelf(pages.sparkSession).put(reputations(pages, labels).filter(F.col("verdict") == "block").select("host", F.lit("block").alias("by_host")))
    ruled = urls.join(F.broadcast(blocked) if blocked.count() <= MOST_BROADCAST else blocked, "host", "left").withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "by_host", F.lit("allow")).alias("verdict"))
