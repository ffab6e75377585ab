"""Phrase aggregation, ranking and classification over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.checks import phrase_views as v
from demandlens.checks.registry import check, table
from demandlens.operators import intents, phrases
from demandlens.functions import text


@check(
    "phrase_agg",
    "SELECT search_id, phrase, array_to_string(sources, '|') AS sources, occ, best FROM v_agg",
    ("v_agg",),
)
def phrase_agg(spark, d):
    return v.aggregated(spark, d).select("search_id", "phrase", F.array_join("sources", "|").alias("sources"), "occ", "best")


@check("phrase_score", "SELECT search_id, phrase, occ, score FROM v_scored", ("v_scored",))
def phrase_score(spark, d):
    return v.scored(spark, d).select("search_id", "phrase", "occ", "score")


@check("phrase_rank_band", "SELECT search_id, phrase, score, rank, band FROM v_ranked", ("v_ranked",))
def phrase_rank_band(spark, d):
    return phrases.rank_and_band(v.scored(spark, d)).select("search_id", "phrase", "score", "rank", "band")


_SEED_WORDS = ("the", "la", "der")


@check(
    "topic_terms",
    f"""SELECT doc_id, len(terms) AS n_terms, array_to_string(list_sort(terms), '|') AS terms FROM (
  SELECT doc_id, {v.terms_sql('words', 'seeds')} AS terms FROM (
    SELECT doc_id, {v.words_sql(v.NORM.format('text'))} AS words, {v._list(_SEED_WORDS)} AS seeds, {v.STOP} AS stop_words FROM documents))""",
)
def topic_terms(spark, d):
    """Terms of every whole document."""
    docs = table(spark, d, "documents").select(
        "doc_id", text.norm(F.col("text")).alias("phrase"), F.array(*[F.lit(s) for s in _SEED_WORDS]).alias("seeds")
    )
    out = phrases.topic_terms(docs, "seeds")
    return out.select("doc_id", F.size("terms").cast("long").alias("n_terms"), v.joined("terms").alias("terms"))


@check("core_terms", "SELECT search_id, term, n FROM v_core", ("v_core",))
def core_terms(spark, d):
    return phrases.core_terms(v.scored(spark, d), phrases.scan_dimension(v.scans(spark, d))).select("search_id", "term", "n")


@check(
    "keyword_table",
    """SELECT search_id, rank, phrase, array_to_string(sources, '+') AS sources, occ, score, band, intent, place,
  CAST(fringe AS INT) AS fringe, array_to_string(list_sort(terms), '|') AS terms FROM v_keywords""",
    ("v_keywords",),
)
def keyword_table(spark, d):
    return v.keywords(spark, d).select(
        "search_id", "rank", "phrase", F.array_join("sources", "+").alias("sources"), "occ", "score", "band", "intent", "place",
        F.col("fringe").cast("int").alias("fringe"), v.joined("terms").alias("terms"),
    )


@check(
    "fringe_flag",
    "SELECT search_id, phrase FROM v_keywords WHERE fringe",
    ("v_keywords",),
)
def fringe_flag(spark, d):
    return v.keywords(spark, d).filter("fringe").select("search_id", "phrase")


@check(
    "intent_counts",
    f"""SELECT search_id, intent, count(*) AS n FROM (SELECT search_id, {v.INTENT_SQL} AS intent FROM v_agg) GROUP BY ALL""",
    ("v_agg",),
)
def intent_counts(spark, d):
    agg = v.aggregated(spark, d)
    return intents.classify_intent(agg).groupBy("search_id", "intent").agg(F.count(F.lit(1)).alias("n"))


_GENERIC = v.INTENT_SQL.replace("phrase", v.NORM.format("text"))


@check("intent_documents", f"SELECT lang, {_GENERIC} AS intent, count(*) AS n FROM documents GROUP BY ALL")
def intent_documents(spark, d):
    """The rules over whole document texts."""
    docs = table(spark, d, "documents").select("lang", text.norm(F.col("text")).alias("phrase"))
    return intents.classify_intent(docs).groupBy("lang", "intent").agg(F.count(F.lit(1)).alias("n"))


@check(
    "place_candidates",
    "SELECT search_id, place, count(*) AS n FROM v_place0 GROUP BY ALL",
    ("v_place0",),
)
def place_candidates(spark, d):
    agg = v.aggregated(spark, d)
    return (
        agg.withColumn("place", intents.place_candidate(F.col("phrase")))
        .groupBy("search_id", "place")
        .agg(F.count(F.lit(1)).alias("n"))
    )
