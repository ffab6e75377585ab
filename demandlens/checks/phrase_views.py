"""Suggestion observations derived from the provided tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.checks.registry import table, view
from demandlens.functions import text
from demandlens.operators import phrases

TAILS = (
    "near me", "classes in salem", "in salem", "price", "for kids", "worksheet pdf", "jobs", "franchise cost", "teacher training",
    "app download", "best", "vs", "online", "how to use", "in tamil", "level 2 exam", "coaching anna nagar", "near adyar",
    "in delhi road", "in home", "", "in old town fees", "class adyar", "around lake view", "reviews", "kit", "what is it",
    "valve", "of the deep", "insurance", "in kovai", "academy madurai north", "near t nagar", "videos", "buy", "for my",
    "centre salem", "and", "institute of x", "starting a",
)
SEEDS = ("ring, Gear", "bolt,plate , rod", "widget", "small ring,gizmo, anvil,plate", "anvil")
SOURCES = (("A", "N", "R"), ("A", "N", "R"), ("A", "N", "R", "X"), ("A", "N", "R"), ("A",))
CITIES = ("Salem", "", "Kovai", "Anna Nagar", "")
DEPTHS = ("quick", "deep", "max", "unknown", "deep")


def _list(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"

view(
    "v_scans",
    f"""SELECT r_regionkey::BIGINT AS search_id, {_list(SEEDS)}[r_regionkey + 1] AS seed,
  {'[' + ','.join(_list(s) for s in SOURCES) + ']'}[r_regionkey + 1] AS sources,
  {_list(CITIES)}[r_regionkey + 1] AS city, {_list(DEPTHS)}[r_regionkey + 1] AS depth FROM region""",
)
view(
    "v_dim",
    f"""SELECT search_id, seeds, len(sources) AS n_requested, list_distinct(flatten([string_split(s, ' ') for s in seeds])) AS seed_tokens
  FROM (SELECT search_id, sources, [x for x in [{NORM.format('y')} for y in string_split(seed, ',')] if x <> ''][1:3] AS seeds FROM v_scans)""",
    ("v_scans",),
)
view(
    "v_obs",
    f"""SELECT search_id, CASE WHEN search_id = 4 THEN 'A' ELSE l_returnflag END AS source, pos, w, phrase FROM (
  SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) % 5 AS search_id, l_returnflag, CAST(l_suppkey % 12 AS INT) AS pos,
    CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS w,
    p_name || '  ' || p_type || ' ' || {_list(TAILS)}[CAST(l_quantity * l_linenumber AS INT) % {len(TAILS)} + 1] AS phrase
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
)
view(
    "v_rel",
    f"""SELECT * FROM (SELECT o.search_id, source, pos, w, {NORM.format('phrase')} AS phrase FROM v_obs o) o
  JOIN v_dim USING (search_id)
  WHERE phrase <> '' AND length(phrase) <= 90 AND NOT list_contains(seeds, phrase)
    AND len([s for s in seeds if len([t for t in string_split(s, ' ') if NOT contains(phrase, t)]) = 0]) > 0""",
    ("v_obs", "v_dim"),
)
view(
    "v_agg",
    """SELECT search_id, phrase, list_sort(list(DISTINCT source)) AS sources, count(*) AS occ,
    greatest(max(w * (1 - least(pos, 9) / 10.0::DOUBLE)), 0.0) AS best, any_value(n_requested) AS n_requested,
    any_value(seed_tokens) AS seed_tokens FROM v_rel GROUP BY search_id, phrase""",
    ("v_rel",),
)
view(
    "v_scored",
    """SELECT *, CAST(floor((0.5::DOUBLE * best + 0.3::DOUBLE * (len(sources)::DOUBLE / n_requested)
    + 0.2::DOUBLE * least(1.0::DOUBLE, ln(1 + occ) / ln(11.0::DOUBLE))) * 100 + 0.5::DOUBLE) AS INT) AS score FROM v_agg""",
    ("v_agg",),
)
view(
    "v_ranked",
    """SELECT *, CASE WHEN rank - 1 < n * 0.15::DOUBLE THEN 'high' WHEN rank - 1 < n * 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS band
  FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, phrase ASC) AS rank,
    count(*) OVER (PARTITION BY search_id) AS n FROM v_scored)""",
    ("v_scored",),
)

STOP = _list(fixed.STOP_WORDS)


def terms_sql(words: str, seeds: str) -> str:
    """A list of topic terms (unordered) from the word list column ``words`` and the seed word list ``seeds``."""
    seed, following = f"list_contains({seeds}, {words}[i])", f"{words}[i + 1]"
    stop, next_stop = f"list_contains(stop_words, {words}[i])", f"list_contains(stop_words, {following})"
    single = f"CASE WHEN NOT {seed} AND length({words}[i]) >= 3 AND NOT {stop} THEN {words}[i] END"
    pair = (
        f"CASE WHEN i < len({words}) AND NOT {seed} AND NOT list_contains({seeds}, {following}) AND (NOT ({stop} AND {next_stop}) "
        f"OR ({words}[i] = 'near' AND {following} = 'me')) THEN {words}[i] || ' ' || {following} END"
    )
    return f"list_distinct([x for x in flatten([[{single}, {pair}] for i in range(1, len({words}) + 1)]) if x IS NOT NULL])"


def words_sql(phrase: str) -> str:
    return f"[t for t in regexp_split_to_array({phrase}, '[^a-z0-9\\x{{0B80}}-\\x{{0BFF}}\\x{{0900}}-\\x{{097F}}]+') if t <> '']"


INTENT_SQL = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(phrase, '\\b({p})\\b') THEN '{n}'" for n, p in fixed.INTENT_RULES)
    + " ELSE 'other' END"
)
_ANCHOR = (f"\\b{fixed.PLACE_AFTER_PREPOSITION}$|\\b{fixed.PLACE_AFTER_PROVIDER}$").replace("'", "''")
NOT_PLACE = _list(fixed.NOT_PLACE_WORDS)
view(
    "v_terms",
    f"""SELECT * EXCLUDE (words, stop_words), {terms_sql('words', 'seed_tokens')} AS terms
  FROM (SELECT *, {words_sql('phrase')} AS words, {STOP} AS stop_words FROM v_ranked)""",
    ("v_ranked",),
)
view(
    "v_core",
    """SELECT search_id, term, count(*) AS n FROM (SELECT search_id, unnest(terms) AS term FROM v_terms WHERE rank <= 100)
  GROUP BY search_id, term HAVING count(*) >= 3""",
    ("v_terms",),
)
view(
    "v_place0",
    f"""SELECT * EXCLUDE (found, words, cut, not_places), CASE WHEN length(kept) >= 3 THEN kept ELSE '' END AS place FROM (
    SELECT *, array_to_string(CASE WHEN cut > 0 THEN words[1:cut - 1] ELSE words END, ' ') AS kept FROM (
    SELECT *, coalesce(list_position([list_contains(not_places, x) for x in words], true), 0) AS cut FROM (
    SELECT *, string_split(found, ' ') AS words, {NOT_PLACE} AS not_places FROM (
    SELECT *, trim(coalesce(nullif(regexp_extract(phrase, '{_ANCHOR}', 1), ''), regexp_extract(phrase, '{_ANCHOR}', 2), '')) AS found
    FROM v_terms))))""",
    ("v_terms",),
)
view(
    "v_keywords",
    f"""SELECT k.search_id, rank, phrase, sources, occ, score, band, intent, place, terms,
    (CASE WHEN n_requested >= 2 THEN len(sources) < 2 ELSE occ < 2 END) AND intent = 'other'
      AND NOT coalesce(list_has_any(terms, core), false) AS fringe
  FROM (SELECT *, {INTENT_SQL} AS intent FROM v_place0) k
  LEFT JOIN (SELECT search_id, list(term) AS core FROM v_core GROUP BY search_id) c ON k.search_id = c.search_id""",
    ("v_place0", "v_core"),
)


def scans(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("r_regionkey")
    arrays = F.array(*[F.array(*[F.lit(x) for x in s]) for s in SOURCES])
    return table(spark, d, "region").select(
        key.cast("long").alias("search_id"),
        _pick(SEEDS, key).alias("seed"),
        F.element_at(arrays, (key + 1).cast("int")).alias("sources"),
        _pick(CITIES, key).alias("city"),
        _pick(DEPTHS, key).alias("depth"),
    )


def observations(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """``lines`` may be a stream of lineitem rows."""
    part = table(spark, d, "part").select(
        "p_partkey", "p_name", "p_type", (F.regexp_extract("p_brand", "[0-9]+", 0).cast("long") % 5).alias("search_id")
    )
    tail = _pick(TAILS, (F.col("l_quantity") * F.col("l_linenumber")).cast("int") % len(TAILS))
    return (
        (table(spark, d, "lineitem") if lines is None else lines)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "search_id",
            F.when(F.col("search_id") == 4, "A").otherwise(F.col("l_returnflag")).alias("source"),
            (F.col("l_suppkey") % 12).cast("int").alias("pos"),
            F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.8).alias("w"),
            F.concat("p_name", F.lit("  "), "p_type", F.lit(" "), tail).alias("phrase"),
        )
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    return phrases.score_phrases(aggregated(spark, d), phrases.scan_dimension(scans(spark, d)))


def aggregated(spark: SparkSession, d: str) -> DataFrame:
    dim = phrases.scan_dimension(scans(spark, d))
    return phrases.aggregate_phrases(phrases.relevant(observations(spark, d), dim))


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return phrases.keyword_table(observations(spark, d), scans(spark, d), None)


def joined(c: str, sep: str = "|"):
    return F.array_join(F.array_sort(c), sep)
