"""Filters, facets, sorting, paging and export over the keyword table."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.checks import phrase_views as v
from demandlens.checks.registry import check, table
from demandlens.operators import explore, intents
from demandlens.operators.explore import KeywordQuery
from demandlens.session import pin

_BASE = r"""contains(phrase, 'e') AND contains(phrase, 'in') AND NOT regexp_matches(phrase, '(^|\s)franchise cost(\s|$)')
  AND NOT regexp_matches(phrase, '(^|\s)kit(\s|$)')"""
_Q = {"q": " E  in", "exclude": "Franchise cost, kit"}
_SELECT = """SELECT search_id, phrase, array_to_string(sources, '+') AS sources, occ, score, band, intent, place FROM v_keywords"""


def _columns(df):
    return df.select("search_id", "phrase", F.array_join("sources", "+").alias("sources"), "occ", "score", "band", "intent", "place")


@check("kw_filter_words", f"{_SELECT} WHERE {_BASE}", ("v_keywords",))
def kw_filter_words(spark, d):
    return _columns(explore.filter_keywords(v.keywords(spark, d), KeywordQuery(**_Q)))


@check(
    "kw_filter_all",
    f"""{_SELECT} WHERE {_BASE} AND len(sources) >= 2 AND NOT fringe AND band = 'medium' AND list_contains(sources, 'R')
  AND intent = 'local' AND place = 'salem' AND list_contains(terms, 'salem') AND list_contains(terms, 'in salem')""",
    ("v_keywords",),
)
def kw_filter_all(spark, d):
    q = KeywordQuery(
        **_Q, min_sources=2, hide_fringe=True, band="medium", source="R", intent="local", place="salem", term="Salem|in  salem"
    )
    return _columns(explore.filter_keywords(v.keywords(spark, d), q))


_LABELS = "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in fixed.INTENT_LABELS.items()) + "}"


def _facet_sql(base: str, intent: str, place: str, term: str, chosen: str) -> str:
    return f"""SELECT search_id, dim, k, CASE WHEN dim = 'intent' THEN ({_LABELS})[k] ELSE k END AS label, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id, dim ORDER BY n DESC, k ASC) AS rank FROM (
    SELECT search_id, 'intent' AS dim, intent AS k, count(*) AS n FROM v_keywords WHERE {base} AND {place} AND {term} GROUP BY ALL
    UNION ALL
    SELECT search_id, 'place', place, count(*) FROM v_keywords WHERE {base} AND {intent} AND {term} AND place <> '' GROUP BY ALL
    UNION ALL
    SELECT c.search_id, 'term', t, n FROM (
      SELECT search_id, t, count(*) AS n FROM (SELECT search_id, unnest(terms) AS t FROM v_keywords WHERE {base} AND {intent} AND {place})
      GROUP BY ALL) c
    LEFT JOIN (SELECT search_id, count(*) AS total FROM v_keywords WHERE {base} AND {intent} AND {place} AND {term} GROUP BY ALL) s
      ON s.search_id = c.search_id
    WHERE n >= CASE WHEN coalesce(total, 0) > 400 THEN 4 ELSE 2 END OR {chosen}))
  WHERE rank <= CASE dim WHEN 'place' THEN 40 WHEN 'term' THEN 48 ELSE 1000 END"""


@check("kw_facets", _facet_sql("true", "true", "true", "true", "false"), ("v_keywords",))
def kw_facets(spark, d):
    return explore.facets(v.keywords(spark, d), KeywordQuery())


@check(
    "kw_facets_selected",
    _facet_sql(
        "NOT fringe", "intent = 'local'", "place = 'salem'", "list_contains(terms, 'in salem')", "t = 'in salem'"
    ),
    ("v_keywords",),
)
def kw_facets_selected(spark, d):
    q = KeywordQuery(hide_fringe=True, intent="local", place="salem", term="in salem")
    return explore.facets(v.keywords(spark, d), q)


def _page_sql(order: str, offset: int, limit: int) -> str:
    return f"""SELECT search_id, phrase, score, position FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY {order}) AS position
  FROM v_keywords WHERE NOT fringe) WHERE position > {offset} AND position <= {offset + limit}"""


@check("kw_page_alpha", _page_sql("phrase", 20, 50), ("v_keywords",))
def kw_page_alpha(spark, d):
    q = KeywordQuery(hide_fringe=True, sort="alpha", offset=20, limit=50)
    return explore.page(v.keywords(spark, d), q).select("search_id", "phrase", "score", "position")


@check("kw_page_short", _page_sql("length(phrase), score DESC, phrase", 0, 100), ("v_keywords",))
def kw_page_short(spark, d):
    q = KeywordQuery(hide_fringe=True, sort="short")
    return explore.page(v.keywords(spark, d), q).select("search_id", "phrase", "score", "position")


@check("kw_page_deep", _page_sql("score DESC, phrase", 900, 500), ("v_keywords",))
def kw_page_deep(spark, d):
    """A page beyond the window-group-limit, through the range-partitioned rank."""
    q = KeywordQuery(hide_fringe=True, offset=900, limit=500)
    return explore.page(v.keywords(spark, d), q).select("search_id", "phrase", "score", "position")


@check(
    "kw_totals",
    f"""SELECT search_id, count(*) FILTER ({_BASE}) AS total, count(*) AS "all", count(*) FILTER (fringe) AS fringe
  FROM v_keywords GROUP BY search_id""",
    ("v_keywords",),
)
def kw_totals(spark, d):
    return explore.totals(v.keywords(spark, d), KeywordQuery(**_Q))


@check(
    "kw_export",
    """SELECT search_id, phrase, CAST(score AS VARCHAR) AS score, band AS strength, intent, place,
  array_to_string(sources, '+') AS sources, CASE WHEN fringe THEN 'yes' ELSE '' END AS possibly_other_meaning FROM v_keywords""",
    ("v_keywords",),
)
def kw_export(spark, d):
    return explore.export_keywords(v.keywords(spark, d), KeywordQuery())


@check(
    "kw_brief",
    f"""WITH k AS (SELECT * FROM v_keywords WHERE NOT fringe),
  i AS (SELECT search_id, ({_LABELS})[intent] AS k, intent, count(*) AS n FROM k GROUP BY ALL),
  il AS (SELECT search_id, CAST(to_json(list({{'k': k, 'n': n}} ORDER BY n DESC, intent)) AS VARCHAR) AS intents FROM i GROUP BY ALL),
  p AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY n DESC, k) AS r
    FROM (SELECT search_id, place AS k, count(*) AS n FROM k WHERE place <> '' GROUP BY ALL)),
  pl AS (SELECT search_id, CAST(to_json(list({{'k': k, 'n': n}} ORDER BY r)) AS VARCHAR) AS places FROM p WHERE r <= 15 GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, phrase) AS r FROM k),
  tl AS (SELECT search_id, CAST(to_json(list({{'score': score, 'intent': intent, 'phrase': phrase}} ORDER BY r)) AS VARCHAR) AS top
    FROM t WHERE r <= 150 GROUP BY ALL)
SELECT s.search_id, seed, city, (SELECT count(*) FROM k WHERE k.search_id = s.search_id) AS total, intents, coalesce(places, '[]') AS places, top
FROM v_scans s JOIN il USING (search_id) LEFT JOIN pl USING (search_id) LEFT JOIN tl USING (search_id)""",
    ("v_keywords",),
)
def kw_brief(spark, d):
    return explore.brief(v.keywords(spark, d), v.scans(spark, d))


@check(
    "place_validate",
    """WITH counts AS (SELECT search_id, place, count(*) AS n FROM v_place0 WHERE place <> '' GROUP BY ALL),
  first AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY n DESC, place) AS r FROM counts),
  remaining AS (SELECT * FROM first WHERE NOT (r <= 6 AND length(place) % 3 = 0)),
  kept AS (SELECT search_id, place FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY n DESC, place) AS r2 FROM remaining) WHERE r2 <= 6)
SELECT p.search_id, p.phrase, coalesce(k.place, '') AS place FROM v_place0 p
LEFT JOIN kept k ON p.search_id = k.search_id AND p.place = k.place""",
    ("v_place0",),
)
def place_validate(spark, d):
    """Verdicts derived from the candidate itself: a length divisible by 3 is no place, one of 4 was not looked up."""
    kw = pin(v.aggregated(spark, d).withColumn("place", intents.place_candidate(F.col("phrase"))))
    names = kw.filter("place <> ''").select("place").distinct()
    gazetteer = names.filter(F.length("place") % 3 != 1).withColumns(
        {
            "category": F.when(F.length("place") % 3 == 2, "place"),
            "type": F.when(F.length("place") % 3 == 2, "suburb"),
        }
    )
    verdicts = intents.gazetteer_verdict(gazetteer).select("place", "verdict")
    return intents.validate_places(kw, verdicts, top=6).select("search_id", "phrase", "place")


@check(
    "intent_dim",
    f"""SELECT intent, ({_LABELS})[intent] AS label, count(*) AS n FROM v_keywords GROUP BY ALL""",
    ("v_keywords",),
)
def intent_dim(spark, d):
    dim = intents.intent_dim(spark).select("intent", "label")
    counts = v.keywords(spark, d).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(dim), "intent", "left")


@check(
    "app_market",
    """SELECT term, count(*) AS count, CAST(coalesce(sum(ratings), 0) AS BIGINT) AS total_ratings,
  arg_min(name, {'r': -ratings, 'name': name}) FILTER (ratings > 0) AS strongest,
  CASE WHEN count(*) < 8 THEN 'open' WHEN sum(ratings) > 20000 THEN 'crowded' ELSE 'moderate' END AS crowd
FROM (SELECT p_brand || '/' || (p_size % 7) AS term, p_name || ' ' || p_partkey AS name, CASE WHEN p_size < 10 THEN 0 ELSE p_size * 45 END AS ratings FROM part)
GROUP BY term""",
)
def app_market(spark, d):
    apps = table(spark, d, "part").select(
        F.concat("p_brand", F.lit("/"), (F.col("p_size") % 7).cast("string")).alias("term"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") < 10, 0).otherwise(F.col("p_size") * 45).alias("ratings"),
    )
    return explore.app_market(apps)
