"""Suggestion observations -> ranked, classified phrase table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text
from demandlens.operators import ordering
from demandlens.operators.intents import intent_of, place_candidate
from demandlens.plans.tasks import seed_list
from demandlens.session import pin

MAX_PHRASE = 90
SOURCE_IDS = tuple(name for name, _, _ in fixed.SOURCES)


def scan_dimension(scans: DataFrame) -> DataFrame:
    """``scans(search_id, seed, sources array)`` -> one row per scan with its seeds, token lists and requested sources.

    Spark broadcasts it into the joins with observations and phrases where its size in bytes allows.
    """
    seeds = seed_list(F.col("seed"))
    token_lists = F.transform(seeds, lambda s: F.split(s, " "))
    return scans.select(
        "search_id",
        seeds.alias("seeds"),
        token_lists.alias("seed_token_lists"),
        F.array_distinct(F.flatten(token_lists)).alias("seed_tokens"),
        F.size("sources").alias("n_requested"),
    )


def relevant(obs: DataFrame, dim: DataFrame, longest: int | None = MAX_PHRASE) -> DataFrame:
    """Normalise, then drop phrases that are empty, too long, a seed itself, or without all words of at least one seed.

    ``dim`` is ``scan_dimension``; ``longest`` is the most characters of a phrase (None: no limit).
    """
    phrase = F.col("phrase")
    on_topic = F.exists("seed_token_lists", lambda words: F.forall(words, lambda w: F.contains(phrase, w)))
    return (
        text.computed_once(obs, "phrase", text.norm(phrase))
        .filter((phrase != "") & (F.length(phrase) <= longest if longest else F.lit(True)))
        .join(dim.select("search_id", "seeds", "seed_token_lists"), "search_id")
        .filter(~F.array_contains("seeds", phrase) & on_topic)
        .drop("seeds", "seed_token_lists")
    )


def of_sources(obs: DataFrame, sources: tuple[str, ...] | None) -> DataFrame:
    """Observations of the known ``sources`` only; None keeps all."""
    return obs if sources is None else obs.filter(F.col("source").isin(*sources))


def best_weight() -> Column:
    """The best position weight of a group of observations."""
    return F.max(F.col("w") * (1 - F.least(F.col("pos"), F.lit(9)) / F.lit(10.0)))


def aggregate_phrases(obs: DataFrame) -> DataFrame:
    """One row per scan and phrase: sorted distinct sources, times seen, best position weight.

    Any sources may occur.  The first aggregate, per source too, has fixed-size buffers: it is code-generated, combines before the
    shuffle, and a phrase seen a billion times arrives as one row per task and source.  Only its few rows meet in the second.
    """
    by_source = obs.groupBy("search_id", "phrase", "source").agg(F.count(F.lit(1)).alias("_n"), best_weight().alias("_best"))
    return by_source.groupBy("search_id", "phrase").agg(
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.sum("_n").alias("occ"),
        F.greatest(F.max("_best"), F.lit(0.0)).alias("best"),
    )


def demand_score(best: Column, n_sources: Column, n_requested: Column, occ: Column) -> Column:
    agreement = F.coalesce(n_sources / F.nullif(n_requested, F.lit(0)), F.lit(0.0))  # no source asked for: no agreement
    seen = F.least(F.lit(1.0), F.log(1 + occ) / F.log(F.lit(11.0)))
    return text.js_round((0.5 * best + 0.3 * agreement + 0.2 * seen) * 100).cast("int")


def score_phrases(phrases: DataFrame, dim: DataFrame) -> DataFrame:
    """Demand score 0-100; source agreement is measured against the *requested* sources of the scan."""
    return (
        phrases.join(dim.select("search_id", "n_requested"), "search_id")
        .withColumn("score", demand_score(F.col("best"), F.size("sources"), F.col("n_requested"), F.col("occ")))
        .drop("best", "n_requested")
    )


def rank_order() -> list[Column]:
    return [F.col("score").desc(), F.col("phrase").asc()]


def rank_and_band(scored: DataFrame) -> DataFrame:
    """Rank by score, then phrase, and the strength band of that rank."""
    i, n = F.col("rank") - 1, F.col("n_phrases")
    ranked = ordering.global_rank(scored, ["search_id"], rank_order(), "rank", "n_phrases")
    return ranked.withColumn("band", F.when(i < n * 0.15, "high").when(i < n * 0.5, "medium").otherwise("low"))


def topic_terms(df: DataFrame, seed_tokens_col: str, stop_words=fixed.STOP_WORDS, out: str = "terms") -> DataFrame:
    """Words and neighbouring word pairs of ``phrase`` that say something beyond the seed, in order of first appearance.

    A pair never spans a seed word.  Words need three characters and must not be stop words; a pair may hold one stop word,
    and "near me" is kept although both are.
    """
    words = F.col("_words")

    def terms_at(word, i):
        following = F.get(words, i + 1)
        is_seed = F.array_contains(seed_tokens_col, word)
        stop, next_stop = word.isin(*stop_words), following.isin(*stop_words)
        single = F.when(~is_seed & (F.length(word) >= 3) & ~stop, word)
        both_free = ~is_seed & following.isNotNull() & ~F.array_contains(seed_tokens_col, following)
        pair_ok = ~(stop & next_stop) | ((word == "near") & (following == "me"))
        pair = F.when(both_free & pair_ok, F.concat_ws(" ", word, following))
        return F.array(single, pair)

    return (
        df.withColumn("_words", text.tokens(F.col("phrase")))
        .withColumn(out, F.array_distinct(F.array_compact(F.flatten(F.transform(words, terms_at)))))
        .drop("_words")
    )


def core_terms(scored: DataFrame, dim: DataFrame, top: int = 100, least: int = 3) -> DataFrame:
    """Terms that occur in at least ``least`` of the ``top`` strongest phrases of a scan: (search_id, term, n).

    ``scored`` may already carry a ``rank``.
    """
    if "rank" in scored.columns:
        best = scored.filter(F.col("rank") <= top).select("search_id", "phrase")
    else:
        best = ordering.top_per_group(scored.select("search_id", "phrase", "score"), ["search_id"], rank_order(), top)
    with_terms = topic_terms(best.join(dim.select("search_id", "seed_tokens"), "search_id"), "seed_tokens")
    counted = with_terms.select("search_id", F.explode("terms").alias("term")).groupBy("search_id", "term").count()
    return counted.filter(F.col("count") >= least).withColumnRenamed("count", "n")


def core_arrays(core: DataFrame) -> DataFrame:
    """One array per scan; its length is bounded by what ``top`` phrases of 90 characters can hold."""
    return core.groupBy("search_id").agg(F.collect_set("term").alias("core"))


def flag_fringe(df: DataFrame, core: DataFrame) -> DataFrame:
    """"Probably another meaning": weakly supported, no intent, and no core term.  Needs sources, occ, intent, terms.

    The core arrays, one row per scan, are written once: the join then knows their real size, and broadcasts them if it is small.
    """
    weak = F.when(F.col("n_requested") >= 2, F.size("sources") < 2).otherwise(F.col("occ") < 2)
    shares = F.coalesce(F.arrays_overlap("terms", "core"), F.lit(False))
    return (
        df.join(pin(core_arrays(core)), "search_id", "left")
        .withColumn("fringe", weak & (F.col("intent") == "other") & ~shares)
        .drop("core")
    )


def classify_scored(scored: DataFrame, dim: DataFrame, rules=fixed.INTENT_RULES, stop_words=fixed.STOP_WORDS) -> DataFrame:
    """Scored phrases -> ranked keywords with band, intent, place, fringe flag and terms.

    The scored phrases are sorted and written once (see ``global_rank``); the core vocabulary is read back from that copy.
    """
    ranked = rank_and_band(scored)
    core = core_terms(ranked, dim)
    words = topic_terms(ranked.join(dim.select("search_id", "seed_tokens", "n_requested"), "search_id"), "seed_tokens", stop_words)
    classified = words.withColumn("intent", intent_of(F.col("phrase"), rules)).withColumn("place", place_candidate(F.col("phrase")))
    return flag_fringe(classified, core).select(
        "search_id", "rank", "phrase", "sources", "occ", "score", "band", "intent", "place", "fringe", "terms"
    )


def keyword_table(
    obs: DataFrame, scans: DataFrame, sources: tuple[str, ...] | None = SOURCE_IDS, rules=fixed.INTENT_RULES, stop_words=fixed.STOP_WORDS
) -> DataFrame:
    """The whole path from observations to the classified keyword table."""
    dim = scan_dimension(scans)
    return classify_scored(score_phrases(aggregate_phrases(relevant(of_sources(obs, sources), dim)), dim), dim, rules, stop_words)
