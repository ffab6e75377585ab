"""Lead scoring, listing, patching and resolution over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.checks import lead_views as v
from demandlens.checks.registry import check, table
from demandlens.functions.phone import norm_phone
from demandlens.functions.text import csv_safe
from demandlens.operators import leads as L
from demandlens.operators.resolve import match_leads, resolve_leads
from demandlens.sources import tables

_V = ("v_leads",)


@check("phone_norm", "SELECT id, phone, wa, phone_type FROM v_leads", _V)
def phone_norm(spark, d):
    phones = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"), v.phone_text(F.col("c_custkey")).alias("phone"))
    parsed = norm_phone(F.col("phone"))
    return phones.select("id", "phone", parsed["wa"].alias("wa"), parsed["type"].alias("phone_type"))


@check("lead_score", "SELECT id, score, signals FROM v_leads", _V)
def lead_score(spark, d):
    return v.leads(spark, d).select("id", "score", v.signal_text().alias("signals"))


@check("area_guess", "SELECT id, address, area FROM v_leads", _V)
def area_guess(spark, d):
    return v.leads(spark, d).select("id", "address", "area")


@check(
    "lead_prepare",
    """SELECT o_orderkey AS seq, 'import' AS source, 'abacus' AS seed, 'csv import' AS query, CASE WHEN o_orderkey % 2 = 0 THEN 'Given' WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Lake View' END AS area,
  CASE WHEN o_orderkey % 89 = 0 THEN 'closed' WHEN o_orderkey % 97 = 0 THEN 'no name' END AS skip_reason FROM orders""",
)
def lead_prepare(spark, d):
    """Import stamps, guessed areas and the reasons to leave a row out."""
    o = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        o.alias("seq"),
        F.when(o % 97 == 0, "").otherwise("Shop").alias("name"),
        F.when(o % 89 == 0, "Closed_Permanently").otherwise("").alias("status"),
        F.when(o % 2 == 0, "Given").otherwise("").alias("area"),
        F.concat(o.cast("string"), F.when(o % 3 == 0, " Main Road, ").otherwise(" Main Road, Lake View, "), F.lit("Salem 636")).alias("address"),
        F.lit("salem").alias("city"),
    )
    out = L.guard_leads(L.prepare_leads(rows, "import", "abacus", "csv import"))
    return out.select("seq", "source", "seed", "query", "area", "skip_reason")


@check(
    "lead_rescore",
    f"SELECT id, CASE WHEN stage = 'new' THEN {v.score_sql()} ELSE 0 END AS score FROM v_leads1",
    ("v_leads1",),
)
def lead_rescore(spark, d):
    zeroed = v.leads(spark, d).withColumn("score", F.lit(0))
    return L.rescore(zeroed, v.SETTINGS, v.now(), F.col("stage") == "new").select("id", "score")


def _list_sql(where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"SELECT id, name, score, stage FROM v_leads WHERE {where} ORDER BY {order}, id DESC LIMIT {limit} OFFSET {offset}"


@check(
    "lead_list_score",
    _list_sql(
        "score >= 40 AND phone_type <> 'invalid' AND coalesce(has_app, '') <> 'yes' AND signals NOT LIKE '%franchise or chain%'",
        "score DESC", 300, 50,
    ),
    _V,
)
def lead_list_score(spark, d):
    q = L.LeadQuery(min_score=40, has_phone=True, hide_app=True, hide_chains=True, limit=400, offset=50)
    return L.list_leads(v.leads(spark, d), q).select("id", "name", "score", "stage")


@check(
    "lead_list_name",
    _list_sql("stage = 'new' AND (name ILIKE '%kidz c%n%' OR area ILIKE '%kidz c%n%' OR phone ILIKE '%kidz c%n%')", "lower(name)", 100),
    _V,
)
def lead_list_name(spark, d):
    q = L.LeadQuery(stage="new", q="KIDZ c%N", sort="name")
    return L.list_leads(v.leads(spark, d), q).select("id", "name", "score", "stage")


@check("lead_list_follow", _list_sql("query = 'MACHINERY'", "next_followup ASC NULLS FIRST", 100, 150), _V)
def lead_list_follow(spark, d):
    q = L.LeadQuery(query="MACHINERY", sort="follow", offset=150)
    return L.list_leads(v.leads(spark, d), q).select("id", "name", "score", "stage")


@check("lead_list_new", _list_sql("true", "created DESC", 100), _V)
def lead_list_new(spark, d):
    return L.list_leads(v.leads(spark, d), L.LeadQuery(sort="new")).select("id", "name", "score", "stage")


@check(
    "lead_facets",
    """SELECT 'stage' AS dim, stage AS k, count(*) AS n FROM v_leads GROUP BY ALL
UNION ALL SELECT 'query', query, count(*) FROM v_leads WHERE query <> '' GROUP BY ALL
UNION ALL SELECT 'total', '', count(*) FROM v_leads WHERE score >= 50""",
    _V,
)
def lead_facets(spark, d):
    return L.lead_facets(v.leads(spark, d), L.LeadQuery(min_score=50))


@check(
    "timeline",
    f"""SELECT l.id, pos, a.id AS activity_id, type, {v.stamp_sql('"at"')} AS "at" FROM v_leads l LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY "at" DESC, id DESC) AS pos FROM v_act QUALIFY pos <= 40) a ON a.lead_id = l.id""",
    ("v_leads", "v_act"),
)
def timeline(spark, d):
    out = L.timeline(v.leads(spark, d), v.activities(spark, d), latest=40)
    return out.select("id", "pos", "activity_id", "type", v.stamp("at").alias("at"))


@check(
    "lead_patch",
    """SELECT id, CASE WHEN k % 3 = 0 THEN 'New ' || k ELSE name END AS name, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'won' ELSE stage END AS stage,
  CASE WHEN k % 3 = 0 AND k % 4 = 0 THEN 'ta' ELSE lang END AS lang, CASE WHEN k % 3 = 0 THEN '91' || CAST(9000000000 + k AS VARCHAR) ELSE wa END AS wa,
  CASE WHEN k % 3 = 0 THEN 'mobile' ELSE phone_type END AS phone_type, CASE WHEN k % 3 = 0 THEN repeat('n', 2000) ELSE '' END AS notes FROM v_leads""",
    _V,
)
def lead_patch(spark, d):
    k = F.col("c_custkey")
    patches = table(spark, d, "customer").filter(k % 3 == 0).select(
        (k + 1).alias("id"),
        F.create_map(
            F.lit("name"), F.concat(F.lit("New "), k.cast("string")),
            F.lit("stage"), F.when(k % 2 == 0, "won").otherwise("nonsense"),
            F.lit("lang"), F.when(k % 4 == 0, "ta").otherwise("xx"),
            F.lit("phone"), F.concat(F.lit("0"), (F.lit(9000000000) + k).cast("string")),
            F.lit("notes"), F.repeat(F.lit("n"), F.lit(2500)),
            F.lit("score"), F.lit("100"),
        ).alias("set"),
    )
    out = L.apply_patches(v.leads(spark, d), patches, v.SETTINGS, v.now())
    return out.select("id", "name", "stage", "lang", "wa", "phone_type", "notes")


@check(
    "lead_export",
    f"""SELECT name, area, city, CASE WHEN regexp_matches(phone, '^[+][^0-9 (]') THEN '''' || phone ELSE phone END AS phone, wa AS whatsapp, website,
  coalesce(regexp_replace(CAST(rating AS VARCHAR), '\\.0$', ''), '') AS rating, coalesce(CAST(reviews AS VARCHAR), '') AS reviews, CAST(score AS VARCHAR) AS score, stage,
  CAST(touches AS VARCHAR) AS touches, coalesce(next_action, '') AS next_action,
  coalesce(strftime(next_followup, '%Y-%m-%dT%H:%M:%S.000Z'), '') AS next_followup, coalesce(has_app, '') AS has_app FROM v_leads""",
    _V,
)
def lead_export(spark, d):
    return L.export_leads(v.leads(spark, d)).select(
        "name", "area", "city", "phone", "whatsapp", "website", "rating", "reviews", "score", "stage", "touches", "next_action", "next_followup", "has_app"
    )


_EXPORTED = "['=1+1', '@note', '+plus', '-minus', 'plain', '+91 1'][id % 6 + 1]"


@check(
    "lead_export_all",
    f"""SELECT name, area, city, CASE WHEN regexp_matches(phone, '^[+][^0-9 (]') THEN '''' || phone ELSE phone END AS phone, wa AS whatsapp, website,
  'a' || id || '@x.example' AS email, coalesce(regexp_replace(CAST(rating AS VARCHAR), '\\.0$', ''), '') AS rating, coalesce(CAST(reviews AS VARCHAR), '') AS reviews,
  CAST(score AS VARCHAR) AS score, stage, CAST(touches AS VARCHAR) AS touches, coalesce(next_action, '') AS next_action,
  coalesce(strftime(next_followup, '%Y-%m-%dT%H:%M:%S.000Z'), '') AS next_followup, strftime(created + INTERVAL 1 HOUR * (id % 50), '%Y-%m-%dT%H:%M:%S.000Z') AS last_contacted,
  coalesce(has_app, '') AS has_app, CASE WHEN id % 6 < 4 THEN '''' ELSE '' END || {_EXPORTED} AS notes, 'https://maps.example/' || id AS maps_url FROM v_leads""",
    _V,
)
def lead_export_all(spark, d):
    """All 18 columns, with notes that a spreadsheet would take for formulas."""
    i = F.col("id")
    notes = F.get(F.array(*[F.lit(x) for x in ("=1+1", "@note", "+plus", "-minus", "plain", "+91 1")]), (i % 6).cast("int"))
    rows = v.leads(spark, d).withColumns(
        {
            "email": F.concat(F.lit("a"), i.cast("string"), F.lit("@x.example")), "notes": notes, "maps_url": F.concat(F.lit("https://maps.example/"), i.cast("string")),
            "last_contacted": F.col("created") + F.make_dt_interval(hours=(i % 50).cast("int")),
        }
    )
    return L.export_leads(rows).drop("id", "_score")


@check(
    "csv_safe",
    r"""SELECT o_orderkey, CASE WHEN regexp_matches(cell, '^(=|@|[+-][^0-9\s(])') THEN '''' || cell ELSE cell END AS cell FROM (
  SELECT o_orderkey, ['=1+', '@x', '-x', '+91 ', '+(44)', '-4', 'plain', '- ', '+'][CAST(o_orderkey % 9 AS INT) + 1] || o_orderpriority AS cell FROM orders)""",
)
def csv_cells(spark, d):
    from demandlens.checks.phrase_views import _pick

    heads = ("=1+", "@x", "-x", "+91 ", "+(44)", "-4", "plain", "- ", "+")
    cell = F.concat(_pick(heads, F.col("o_orderkey") % 9), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", csv_safe(cell).alias("cell"))


@check(
    "enrich_candidates",
    """SELECT id, website FROM v_leads WHERE website <> '' AND NOT enriched AND stage NOT IN ('won', 'lost', 'invalid')
ORDER BY score DESC, id LIMIT 100""",
    _V,
)
def enrich_candidates(spark, d):
    return L.enrich_candidates(v.leads(spark, d), most=100).select("id", "website")


@check("enrich_given", "SELECT id, website FROM v_leads WHERE website <> '' AND id % 4 = 1", _V)
def enrich_given(spark, d):
    rows = v.leads(spark, d)
    return L.enrich_candidates(rows, ids=rows.filter("id % 4 = 1").select("id").unionAll(rows.filter("id % 8 = 1").select("id"))).select("id", "website")


@check(
    "drop_leads",
    """SELECT a.id FROM v_act a WHERE a.lead_id NOT IN (SELECT id FROM v_leads WHERE score < 40)""",
    ("v_act", "v_leads"),
)
def drop_leads(spark, d):
    rows = v.leads(spark, d)
    _, acts = tables.drop_leads(rows, v.activities(spark, d), rows.filter("score < 40").select("id"))
    return acts.select("id")


# --- resolve ------------------------------------------------------------------------------------------------------------


def batch(spark, d, place, phone):
    """One business record per order."""
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        o.alias("seq"),
        place.alias("place_id"),
        F.when(o % 97 == 0, "").otherwise(F.concat(F.lit("Shop "), o.cast("string"))).alias("name"),
        F.when(o % 3 == 0, "").otherwise(F.concat(F.lit("Street "), o.cast("string"))).alias("address"),
        F.lit("").alias("area"),
        F.lit("Salem").alias("city"),
        phone.alias("phone"),
        F.lit("").alias("intl_phone"),
        F.lit("").alias("website"),
        F.when(o % 4 != 0, (o % 50) / 10.0).alias("rating"),
        F.when(o % 5 != 0, (o % 800).cast("int")).alias("reviews"),
        F.lit("").alias("maps_url"),
        F.when(o % 89 == 0, "CLOSED_TEMPORARILY").otherwise("OPERATIONAL").alias("status"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lng"),
    )


def own_keys(c):
    """A place id for even customers, a number of its own for the others."""
    return F.when(c % 2 == 0, F.concat(F.lit("p"), c.cast("string"))).otherwise(""), F.when(
        (c % 2 == 1) | (c % 6 == 0), (F.lit(9100000000) + c).cast("string")
    ).otherwise("")


_BATCH = """SELECT o_orderkey AS seq, o_custkey AS c, 'Shop ' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Street ' || o_orderkey END AS address,
  CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 50) / 10.0::DOUBLE END AS rating, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 800 AS INT) END AS reviews
  FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0"""
_KEYS = """CASE WHEN c % 2 = 0 THEN 'p' || c END AS place_id, CASE WHEN c % 2 = 1 OR c % 6 = 0 THEN '91' || (9100000000 + c) ELSE '' END AS wa"""


@check(
    "lead_resolve",
    f"""WITH b AS ({_BATCH}),
  f AS (SELECT c, min(seq) AS first_seq, arg_min(name, seq) AS first_name, arg_max(address, seq) FILTER (address <> '') AS address,
    arg_max(rating, seq) FILTER (rating IS NOT NULL) AS rating, arg_max(reviews, seq) FILTER (reviews IS NOT NULL) AS reviews FROM b GROUP BY c),
  e AS (SELECT c_custkey AS c, c_custkey + 1 AS id, c_name AS name FROM customer WHERE c_custkey % 4 < 2),
  m AS (SELECT max(id) AS top FROM e),
  n AS (SELECT c, (SELECT top FROM m) + row_number() OVER (ORDER BY first_seq) AS id FROM f WHERE c % 4 >= 2)
SELECT coalesce(e.id, n.id) AS id, {_KEYS}, coalesce(e.name, f.first_name) AS name, coalesce(f.address, '') AS address, f.rating, f.reviews,
  CAST(30 + CASE WHEN rating >= 4.5 THEN 15 WHEN rating >= 4 THEN 10 WHEN rating < 3.5 THEN -5 ELSE 0 END
    + CASE WHEN reviews BETWEEN 5 AND 150 THEN 15 WHEN reviews BETWEEN 151 AND 500 THEN 8 WHEN reviews < 5 THEN 3 ELSE 0 END
    + CASE WHEN c % 2 = 1 OR c % 6 = 0 THEN 15 ELSE -20 END AS INT) AS score
FROM f FULL JOIN e USING (c) LEFT JOIN n USING (c)
WHERE f.c IS NOT NULL""",
)
def lead_resolve(spark, d):
    place, phone = own_keys(F.col("o_custkey"))
    k = F.col("c_custkey")
    p, ph = own_keys(k)
    old = table(spark, d, "customer").filter(k % 4 < 2)
    existing = _existing(old, (k + 1).alias("id"), p, ph, F.col("c_name"))
    leads, _ = resolve_leads(existing, batch(spark, d, place, phone), v.SETTINGS, v.now())
    touched = leads.filter(F.col("updated") == v.now())
    return touched.select("id", "place_id", "wa", "name", "address", "rating", "reviews", "score")


def _existing(rows, key, place, phone, name):
    parsed = norm_phone(phone)
    none = F.lit(None)
    base = rows.select(
        key, F.nullif(place, F.lit("")).alias("place_id"), name.alias("name"), phone.alias("phone"), parsed["wa"].alias("wa"), parsed["type"].alias("phone_type"),
        *[F.lit("").alias(c) for c in ("address", "area", "city", "website", "email", "instagram", "facebook", "maps_url", "source", "query", "seed", "notes", "contact_name")],
        *[none.cast("double").alias(c) for c in ("rating", "lat", "lng")], none.cast("int").alias("reviews"), none.cast(L.EXTRA_TYPE).alias("extra"),
        F.lit("new").alias("stage"), F.lit("en").alias("lang"), F.lit(0).alias("touches"), none.cast("timestamp").alias("enriched"),
        F.lit("2023-01-01").cast("timestamp").alias("created"), F.lit("2023-01-01").cast("timestamp").alias("updated"),
    )
    return L.score_leads(base, v.SETTINGS)


@check(
    "import_report",
    f"""WITH b AS ({_BATCH}) SELECT count(*) FILTER (c % 4 >= 2 AND first) AS inserted, count(*) FILTER (NOT (c % 4 >= 2 AND first)) AS updated,
  (SELECT count(*) FROM orders) - count(*) AS skipped FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY seq) = 1 AS first FROM b)""",
)
def import_report(spark, d):
    place, phone = own_keys(F.col("o_custkey"))
    k = F.col("c_custkey")
    p, ph = own_keys(k)
    existing = _existing(table(spark, d, "customer").filter(k % 4 < 2), (k + 1).alias("id"), p, ph, F.col("c_name"))
    _, outcomes = resolve_leads(existing, batch(spark, d, place, phone), v.SETTINGS, v.now())
    return L.import_report(outcomes)


def _put(values: str, at: str, new: str, when: str) -> str:
    """The list a.values, with ``new`` at place b.at where the condition holds."""
    return f"CASE WHEN b.{at} IS NOT NULL AND ({when}) THEN list_concat(a.{values}[1:b.{at} - 1], [{new}], a.{values}[b.{at} + 1:]) ELSE a.{values} END"


_X, _Y = "a.ol[b.p]", "a.hl[b.w]"
_TAKES_NUMBER = f"{_X} IS NOT NULL AND b.w IS NOT NULL AND NOT a.ow[b.p]"
_TAKES_PLACE = f"{_X} IS NULL AND {_Y} IS NOT NULL AND b.p IS NOT NULL AND NOT a.hp[b.w]"
_NEW = f"{_X} IS NULL AND {_Y} IS NULL"
_TYPES = "NULL::INTEGER[] AS ol, NULL::BOOLEAN[] AS ow, NULL::INTEGER[] AS hl, NULL::BOOLEAN[] AS hp, NULL::STRUCT(seq INTEGER, lid INTEGER)[] AS done"
# a fold over the rows of the batch, one after the other: who owns each place id (ol) and whether that lead has a number (ow), the oldest lead of
# each number (hl) and whether it has a place id (hp)
_CHAINED = f"""WITH r AS (SELECT o_orderkey::INTEGER AS seq, (CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 701 + 1 END)::INTEGER AS p,
    (CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey * 7919) % 907 + 1 END)::INTEGER AS w, {_TYPES} FROM orders WHERE o_orderkey % 12 <> 0),
  e AS (SELECT (c_custkey + 1 - 2000000000)::INTEGER AS lid, CASE WHEN c_custkey < 701 AND c_custkey % 3 <> 0 THEN c_custkey + 1 END AS p, (c_custkey * 7919) % 907 + 1 AS w FROM customer),
  start AS (SELECT 0::INTEGER AS seq, NULL::INTEGER AS p, NULL::INTEGER AS w,
      (SELECT list(lid ORDER BY i) FROM range(1, 702) t(i) LEFT JOIN e ON e.p = i) AS ol, (SELECT list(lid IS NOT NULL ORDER BY i) FROM range(1, 702) t(i) LEFT JOIN e ON e.p = i) AS ow,
      (SELECT list(lid ORDER BY i) FROM range(1, 908) t(i) LEFT JOIN (SELECT w, min(lid) AS lid FROM e GROUP BY w) ON w = i) AS hl,
      (SELECT list(coalesce(placed, false) ORDER BY i) FROM range(1, 908) t(i) LEFT JOIN (SELECT w, arg_min(p IS NOT NULL, lid) AS placed FROM e GROUP BY w) ON w = i) AS hp,
      []::STRUCT(seq INTEGER, lid INTEGER)[] AS done),
  folded AS (SELECT list_reduce((SELECT list(r ORDER BY seq) FROM r), lambda a, b: {{'seq': b.seq, 'p': b.p, 'w': b.w,
      'ol': {_put("ol", "p", f"coalesce({_Y}, b.seq)", f"{_NEW} OR {_TAKES_PLACE}")},
      'ow': {_put("ow", "p", "b.w IS NOT NULL", f"{_NEW} OR {_TAKES_PLACE} OR {_TAKES_NUMBER}")},
      'hl': {_put("hl", "w", f"coalesce(least({_X}, {_Y}), b.seq)", f"{_NEW} OR {_TAKES_NUMBER}")},
      'hp': {_put("hp", "w", f"b.p IS NOT NULL AND ({_Y} IS NULL OR {_X} IS NULL OR {_X} < {_Y} OR a.hp[b.w])", f"{_NEW} OR {_TAKES_PLACE} OR {_TAKES_NUMBER}")},
      'done': list_append(a.done, {{'seq': b.seq, 'lid': coalesce({_X}, {_Y}, b.seq)}})}}, (SELECT start FROM start)) AS f)
SELECT seq::BIGINT AS seq, CASE WHEN lid < 0 THEN lid::BIGINT + 2000000000 - 9007199254740992 ELSE lid END AS lid FROM (SELECT unnest(f.done, recursive := true) FROM folded)
UNION ALL SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 12 = 0"""


@check("lead_resolve_chained", _CHAINED)
def lead_resolve_chained(spark, d):
    """Place ids and numbers that overlap at random, so that most matches depend on the rows before.

    All customers are leads that exist already: place ids are theirs alone, numbers are shared.
    """
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        o.alias("seq"),
        F.when(o % 3 == 0, "").otherwise(F.concat(F.lit("p"), (c % 701).cast("string"))).alias("p"),
        F.when(o % 4 == 0, "").otherwise(F.concat(F.lit("9"), ((o * 7919) % 907).cast("string"))).alias("w"),
    )
    k = F.col("c_custkey")
    existing = table(spark, d, "customer").select(
        (k + 1).alias("id"),
        F.when((k < 701) & (k % 3 != 0), F.concat(F.lit("p"), k.cast("string"))).otherwise("").alias("place_id"),
        F.concat(F.lit("9"), ((k * 7919) % 907).cast("string")).alias("wa"),
    )
    return match_leads(existing, rows).select("seq", "lid")
