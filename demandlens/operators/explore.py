"""Filters, self-excluding facets, sorting and paging over keyword tables of many scans at once."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions import text
from demandlens.operators import ordering
from demandlens.operators.intents import intent_label


def _norm(s: str) -> str:
    return re.sub(r"\s+", " ", s.lower()).strip()


@dataclass(frozen=True)
class KeywordQuery:
    """What a user of the phrase table may ask for; empty fields do not filter."""

    q: str = ""
    exclude: str = ""
    min_sources: int = 1
    hide_fringe: bool = False
    band: str = ""
    source: str = ""
    intent: str = ""
    place: str = ""
    term: str = ""
    sort: str = "score"
    offset: int = 0
    limit: int = 100

    @property
    def terms(self) -> list[str]:
        return [t for t in (_norm(x) for x in self.term.split("|")) if t]


def all_words(q: str) -> list[Column]:
    return [F.contains("phrase", F.lit(w)) for w in _norm(q).split(" ") if w]


def without_words(exclude: str) -> list[Column]:
    words = [w for w in (_norm(x) for x in exclude.split(",")) if w]
    return [~F.col("phrase").rlike(rf"(^|\s){re.escape(w)}(\s|$)") for w in words]


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def predicates(q: KeywordQuery) -> dict[str, Column]:
    """One boolean per dimension that has facets, and ``base`` for everything else."""
    base = all_words(q.q) + without_words(q.exclude)
    if q.min_sources > 1:
        base.append(F.size("sources") >= q.min_sources)
    if q.hide_fringe:
        base.append(~F.col("fringe"))
    if q.band:
        base.append(F.col("band") == q.band)
    if q.source:
        base.append(F.array_contains("sources", q.source))
    return {
        "base": _all(base),
        "intent": F.col("intent") == q.intent if q.intent else F.lit(True),
        "place": F.col("place") == q.place if q.place else F.lit(True),
        "term": _all([F.array_contains("terms", t) for t in q.terms]),
    }


def filter_keywords(keywords: DataFrame, q: KeywordQuery) -> DataFrame:
    return keywords.filter(_all(list(predicates(q).values())))


def facets(keywords: DataFrame, q: KeywordQuery, top_places: int = 40, top_terms: int = 48) -> DataFrame:
    """(search_id, dim, k, label, n, rank): counts per facet value, each under all filters except its own.

    One pass: every row is exploded into the values it counts for, so the shuffle carries partial counts per value and not
    rows.  The term threshold depends on how many rows the full filter keeps; that total rides along as one more value.
    """
    p = predicates(q)
    base, intent, place, term = p["base"], p["intent"], p["place"], p["term"]

    def value(dim: str, key: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), key.alias("k"))

    none = F.array().cast("array<struct<dim:string,k:string>>")
    pieces = [
        F.when(intent & place & term, F.array(value("total", F.lit("")))).otherwise(none),
        F.when(place & term, F.array(value("intent", F.col("intent")))).otherwise(none),
        F.when(intent & term & (F.col("place") != ""), F.array(value("place", F.col("place")))).otherwise(none),
        F.when(intent & place, F.transform("terms", lambda t: value("term", t))).otherwise(none),
    ]
    counted = (
        keywords.filter(base)
        .select("search_id", F.explode(F.concat(*pieces)).alias("v"))
        .groupBy("search_id", "v.dim", "v.k")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Counts fall along the ranking, so the threshold on n only cuts the end of a top list: rank first, where Spark prunes before
    # the shuffle, and apply the threshold to the few rows left.  Selected terms come first, so none is lost to the pruning.
    selected = (F.col("dim") == "term") & F.col("k").isin(*q.terms)
    by_count = [F.col("n").desc(), F.col("k").asc()]
    most = max(top_places, top_terms) + len(q.terms)
    own = F.when(~F.col("dim").isin("place", "term"), F.col("k"))  # all intents are listed: each is a group of its own
    few = ordering.top_per_group(counted.withColumns({"_sel": selected, "_own": own}), ["search_id", "dim", "_own"], [F.col("_sel").desc(), *by_count], most)
    total = F.max(F.when(F.col("dim") == "total", F.col("n"))).over(Window.partitionBy("search_id"))
    least = F.when(F.coalesce("_total", F.lit(0)) > 400, 4).otherwise(2)
    wanted = few.withColumn("_total", total).filter((F.col("dim") != "total") & ((F.col("dim") != "term") | (F.col("n") >= least) | F.col("_sel")))
    ranked = wanted.withColumn("rank", F.row_number().over(Window.partitionBy("search_id", "dim").orderBy(*by_count)))
    keep = F.when(F.col("dim") == "place", top_places).when(F.col("dim") == "term", top_terms)
    label = F.when(F.col("dim") == "intent", intent_label(F.col("k"))).otherwise(F.col("k"))
    return ranked.filter((F.col("dim") == "intent") | (F.col("rank") <= keep)).select("search_id", "dim", "k", label.alias("label"), "n", "rank")


def sort_columns(sort: str) -> list[Column]:
    by_score = [F.col("score").desc(), F.col("phrase").asc()]
    if sort == "alpha":
        return [F.col("phrase").asc()]
    if sort == "short":
        return [F.length("phrase").asc(), *by_score]
    return by_score


def page(keywords: DataFrame, q: KeywordQuery, most: int | None = 500) -> DataFrame:
    """Rows offset .. offset+limit of every scan, with their position; at most ``most`` a page (None: no limit)."""
    offset, limit = max(0, q.offset), min(q.limit or 100, most or q.limit or 100)
    kept = filter_keywords(keywords, q)
    if "rank" in kept.columns:
        kept = kept.drop("rank")
    top = ordering.top_per_group(kept, ["search_id"], sort_columns(q.sort), offset + limit, "position")
    return top.filter(F.col("position") > offset)


def totals(keywords: DataFrame, q: KeywordQuery) -> DataFrame:
    """Rows under the filter, all rows and fringe rows per scan."""
    return keywords.groupBy("search_id").agg(
        F.count_if(_all(list(predicates(q).values()))).alias("total"),
        F.count(F.lit(1)).alias("all"),
        F.count_if(F.col("fringe")).alias("fringe"),
    )


def export_keywords(keywords: DataFrame, q: KeywordQuery) -> DataFrame:
    """The seven export columns, spreadsheet-safe, under all filters; write with ``sources.csv_out.write_csv``."""
    cells = {
        "phrase": F.col("phrase"),
        "score": F.col("score"),
        "strength": F.col("band"),
        "intent": F.col("intent"),
        "place": F.col("place"),
        "sources": F.array_join("sources", "+"),
        "possibly_other_meaning": F.when(F.col("fringe"), "yes").otherwise(""),
    }
    return filter_keywords(keywords, q).select("search_id", *[text.csv_safe(c).alias(n) for n, c in cells.items()])


def brief(keywords: DataFrame, scans: DataFrame, phrases: int = 150, places: int = 15) -> DataFrame:
    """One row per scan for a written summary: totals, intents by label, top places, top phrases; fringe rows are left out.

    Every list is cut to its top k before it is collected, so a row stays small whatever the size of the scan.
    """
    q = KeywordQuery(hide_fringe=True)
    f = facets(keywords, q).filter((F.col("dim") == "intent") | ((F.col("dim") == "place") & (F.col("rank") <= places)))
    entry = F.struct("rank", F.col("label").alias("k"), "n")

    def entries(dim):
        rows = F.array_sort(F.collect_list(F.when(F.col("dim") == dim, entry)))
        return F.to_json(F.transform(rows, lambda r: F.struct(r["k"].alias("k"), r["n"].alias("n"))))

    lists = f.groupBy("search_id").agg(entries("intent").alias("intents"), entries("place").alias("places"))
    top = page(keywords, replace(q, limit=phrases))
    item = F.struct("position", "score", "intent", "phrase")
    listed = top.groupBy("search_id").agg(
        F.to_json(
            F.transform(
                F.array_sort(F.collect_list(item)),
                lambda r: F.struct(r["score"].alias("score"), r["intent"].alias("intent"), r["phrase"].alias("phrase")),
            )
        ).alias("top")
    )
    total = totals(keywords, q).select("search_id", "total")
    return scans.select("search_id", "seed", "city").join(total, "search_id").join(lists, "search_id", "left").join(
        listed, "search_id", "left"
    )


def app_market(apps: DataFrame) -> DataFrame:
    """Per search term: apps, total ratings of rated apps, the most rated one, and how crowded the field is.

    ``apps(term, name, rating, ratings)``.  Fixed-size buffers only, so one huge term still combines before the shuffle.
    """
    rated = F.col("ratings") > 0
    strongest_first = F.struct((-F.col("ratings")).alias("r"), F.col("name"))
    return (
        apps.groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.coalesce(F.sum(F.when(rated, F.col("ratings"))), F.lit(0)).alias("total_ratings"),
            F.min_by(F.when(rated, F.col("name")), F.when(rated, strongest_first)).alias("strongest"),
        )
        .withColumn(
            "crowd",
            F.when(F.col("count") < 8, "open").when(F.col("total_ratings") > 20000, "crowded").otherwise("moderate"),
        )
    )
