"""Leads, activities and pages derived from the provided tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.checks.phrase_views import _list, _pick
from demandlens.checks.registry import table, view
from demandlens.functions.phone import norm_phone
from demandlens.functions.text import computed_once
from demandlens.operators import leads as L
from demandlens.settings import Settings

NOW = "2024-01-15 12:00:00"
CHAINS = "segment9, Kidz Chain , c++ club"
SETTINGS = Settings(chain_words=CHAINS)
STAGES10 = ("new", "new", "new", "contacted", "replied", "pilot", "won", "lost", "invalid", "new")
ACTIONS10 = (None, None, None, "followup1", "send_details", "checkin3", None, None, None, None)
NAME_TAILS = ("", " Kidz  Chain", " Kidz Chain", " my kidz chain.", " C++ Club x", " Kidz Chains", "")

# phone texts by key % 7
PHONES = (
    ("'0' || '9' || lpad({k}, 9, '0')", lambda k: F.concat(F.lit("09"), F.lpad(k, 9, "0"))),
    ("'+91 98' || lpad({k}, 8, '0')", lambda k: F.concat(F.lit("+91 98"), F.lpad(k, 8, "0"))),
    ("'044-2' || lpad({k}, 7, '0')", lambda k: F.concat(F.lit("044-2"), F.lpad(k, 7, "0"))),
    ("lpad({k}, 8, '2')", lambda k: F.lpad(k, 8, "2")),
    ("'+65 6' || lpad({k}, 7, '0')", lambda k: F.concat(F.lit("+65 6"), F.lpad(k, 7, "0"))),
    ("'0091 70' || lpad({k}, 8, '0')", lambda k: F.concat(F.lit("0091 70"), F.lpad(k, 8, "0"))),
    ("''", lambda k: F.lit("")),
)


def phone_sql(key: str) -> str:
    text = f"CAST({key} AS VARCHAR)"
    return f"CASE {key} % 7 " + " ".join(f"WHEN {i} THEN {s.format(k=text)}" for i, (s, _) in enumerate(PHONES)) + " END"


def phone_text(key):
    out = F.when(F.lit(False), "")
    for i, (_, f) in enumerate(PHONES):
        out = out.when(key % 7 == i, f(key.cast("string")))
    return out


def norm_phone_sql(raw: str) -> str:
    """wa || '/' || type for country code 91, written independently of the column expression."""
    d = f"regexp_replace({raw}, '[^0-9]', '', 'g')"

    def national(n: str) -> str:
        return f"CASE WHEN length({n}) <> 10 THEN '/invalid' WHEN substr({n}, 1, 1) >= '6' THEN '91' || {n} || '/mobile' ELSE '91' || {n} || '/landline' END"

    return f"""CASE WHEN {d} = '' THEN '/invalid'
    WHEN {d} LIKE '0091%' THEN {national(f'substr({d}, 5)')} WHEN {d} LIKE '00%' THEN substr({d}, 3) || '/unknown'
    WHEN {raw} LIKE '+%' AND {d} LIKE '91%' THEN {national(f'substr({d}, 3)')} WHEN {raw} LIKE '+%' THEN {d} || '/unknown'
    WHEN {d} LIKE '91%' AND length({d}) = 12 THEN {national(f'substr({d}, 3)')} ELSE {national(f"ltrim({d}, '0')")} END"""


view("v_n_orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
view(
    "v_leads0",
    f"""SELECT c_custkey + 1 AS id, c_custkey AS k, c_name || {_list(NAME_TAILS)}[c_custkey % 7 + 1] AS name,
  CAST(c_custkey % 50 AS VARCHAR) || ' Gandhi St, Area ' || lower(c_mktsegment) || CASE WHEN c_custkey % 4 = 0 THEN ', 2nd Floor' ELSE '' END
    || ', ' || n_name || ' 600020, India' AS address, n_name AS city, {phone_sql('c_custkey')} AS phone,
  CASE WHEN c_custkey % 3 = 0 THEN 'www.shop' || c_custkey || '.example' ELSE '' END AS website,
  CASE WHEN c_custkey % 13 <> 0 THEN 3.0::DOUBLE + (c_custkey % 21) / 10.0::DOUBLE END AS rating,
  CASE WHEN c_custkey % 11 <> 0 THEN CAST((coalesce(n, 0) * 13) % 700 AS INT) END AS reviews,
  CASE c_custkey % 9 WHEN 0 THEN 'yes' WHEN 1 THEN 'maybe' WHEN 2 THEN 'no' END AS has_app, c_custkey % 9 <= 2 AS enriched,
  {_list(STAGES10)}[c_custkey % 10 + 1] AS stage,
  {'[' + ','.join('NULL' if a is None else f"'{a}'" for a in ACTIONS10) + ']'}[c_custkey % 10 + 1] AS next_action,
  CASE WHEN c_custkey % 10 BETWEEN 3 AND 5 THEN TIMESTAMP '2024-01-01 11:00:00' + INTERVAL 1 DAY * CAST(c_custkey % 29 AS INT) END AS next_followup,
  CASE WHEN c_custkey % 10 BETWEEN 3 AND 8 THEN CAST(1 + c_custkey % 3 AS INT) ELSE 0 END AS touches,
  CASE WHEN c_custkey % 10 IN (5, 6) THEN TIMESTAMP '2023-12-20 09:30:00' + INTERVAL 1 DAY * CAST(c_custkey % 11 AS INT) END AS pilot_start,
  CASE WHEN c_custkey % 4 = 1 THEN 'ta' ELSE 'en' END AS lang, CASE WHEN c_custkey % 8 = 0 THEN '' ELSE c_mktsegment END AS query,
  CASE WHEN c_custkey % 6 = 0 THEN 'Owner ' || c_custkey ELSE '' END AS contact_name,
  TIMESTAMP '2023-11-01 00:00:00' + INTERVAL 1 MINUTE * CAST((c_custkey * 7919) % 40000 AS INT) AS created
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN v_n_orders ON o_custkey = c_custkey""",
    ("v_n_orders",),
)
view(
    "v_leads1",
    f"""SELECT *, split_part(ph, '/', 1) AS wa, split_part(ph, '/', 2) AS phone_type,
  CASE WHEN k % 5 = 0 THEN '' ELSE 'Area ' || lower(split_part(split_part(address, 'Area ', 2), ',', 1)) END AS area
  FROM (SELECT *, {norm_phone_sql('phone')} AS ph FROM v_leads0)""",
    ("v_leads0",),
)
_NUM = "regexp_replace(CAST(rating AS VARCHAR), '\\.0$', '')"
_CHAIN = r"regexp_matches(name, '(?i)\b(segment9|kidz chain)\b') OR regexp_matches(name, '(?i)\bc\+\+\b club\b')"
SCORE_RULES = (
    ("rating >= 4.5", f"'Rated ' || {_NUM}", 15),
    ("rating >= 4.0 AND rating < 4.5", f"'Rated ' || {_NUM}", 10),
    ("rating < 3.5", f"'Low rating ' || {_NUM}", -5),
    ("reviews BETWEEN 5 AND 150", "reviews || ' reviews: active, likely independent'", 15),
    ("reviews BETWEEN 151 AND 500", "reviews || ' reviews'", 8),
    ("reviews > 500", "reviews || ' reviews: likely large'", 0),
    ("reviews < 5", "'Very few reviews'", 3),
    ("phone_type = 'mobile'", "'Mobile number (WhatsApp likely)'", 15),
    ("phone_type = 'landline'", "'Landline only (call, no WhatsApp)'", 5),
    ("phone_type = 'unknown'", "'Phone found'", 8),
    ("phone_type = 'invalid'", "'No usable phone'", -20),
    ("has_app = 'yes'", "'Already has its own app'", -25),
    ("has_app = 'maybe'", "'Mentions a portal or app'", -10),
    ("has_app = 'no' AND enriched", "'No app found on website'", 8),
    ("website <> '' AND NOT enriched", "'Has a website (not checked yet)'", 3),
    (r"regexp_matches(name, '(?i)\b(segment9|kidz chain|c\+\+ club)\b')", "'Looks like a franchise or chain: head office may decide'", -20),
)


def score_sql() -> str:
    return "CAST(greatest(0, least(100, 30 + " + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, _, p in SCORE_RULES) + ")) AS INT)"


def signals_sql() -> str:
    return "array_to_string([x for x in [" + ", ".join(f"CASE WHEN {c} THEN {t} || '=' || '{p}' END" for c, t, p in SCORE_RULES) + "] if x IS NOT NULL], '; ')"


view("v_leads", f"SELECT *, {score_sql()} AS score, {signals_sql()} AS signals FROM v_leads1", ("v_leads1",))
view(
    "v_act",
    """SELECT event_id AS id, user_id + 1 AS lead_id, CASE event_type WHEN 'click' THEN 'sent' WHEN 'signup' THEN 'replied' WHEN 'view' THEN 'note'
    WHEN 'purchase' THEN 'won' ELSE 'called' END AS type, CASE WHEN event_id % 3 = 0 THEN 'first' ELSE 'followup1' END AS step,
  CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 2 = 0 THEN 'interested' ELSE 'no_answer' END AS body, ts AS "at" FROM events""",
)


def leads(spark, d):
    """The derived lead table, scored."""
    k = F.col("c_custkey")
    nation = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))  # 25 rows
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    base = table(spark, d, "customer").join(nation, "c_nationkey").join(counts, "c_custkey", "left")
    address = F.concat(
        (k % 50).cast("string"), F.lit(" Gandhi St, Area "), F.lower("c_mktsegment"), F.when(k % 4 == 0, ", 2nd Floor").otherwise(""),
        F.lit(", "), "n_name", F.lit(" 600020, India"),
    )
    has_app = F.when(k % 9 == 0, "yes").when(k % 9 == 1, "maybe").when(k % 9 == 2, "no")
    none = F.lit(None)
    extra = F.struct(
        has_app.alias("hasApp"), none.cast("array<string>").alias("appEvidence"), none.cast("array<string>").alias("emails"),
        none.cast("array<string>").alias("otherPhones"), none.cast("string").alias("phoneNote"), none.cast("string").alias("enrichError"),
    )

    def ts(text, unit, n):
        return F.lit(text).cast("timestamp") + F.make_dt_interval(**{unit: n.cast("int")})

    talking = (k % 10).between(3, 5)
    rows = base.select(
        (k + 1).alias("id"),
        none.cast("string").alias("place_id"),
        F.concat("c_name", _pick(NAME_TAILS, k % 7)).alias("name"),
        address.alias("address"),
        F.when((k % 5 == 0), "").otherwise(L.guess_area(address, F.col("n_name"))).alias("area"),
        F.col("n_name").alias("city"),
        phone_text(k).alias("phone"),
        F.when(k % 3 == 0, F.concat(F.lit("www.shop"), k.cast("string"), F.lit(".example"))).otherwise("").alias("website"),
        *[F.lit("").alias(c) for c in ("email", "instagram", "facebook", "maps_url", "source", "seed", "notes")],
        F.when(k % 13 != 0, 3.0 + (k % 21) / 10.0).alias("rating"),
        F.when(k % 11 != 0, ((F.coalesce("n", F.lit(0)) * 13) % 700).cast("int")).alias("reviews"),
        none.cast("double").alias("lat"), none.cast("double").alias("lng"),
        F.when(k % 8 == 0, "").otherwise(F.col("c_mktsegment")).alias("query"),
        extra.alias("extra"),
        _pick(STAGES10, k % 10).alias("stage"),
        F.when(k % 4 == 1, "ta").otherwise("en").alias("lang"),
        F.when(k % 6 == 0, F.concat(F.lit("Owner "), k.cast("string"))).otherwise("").alias("contact_name"),
        F.when((k % 10).between(3, 8), (1 + k % 3).cast("int")).otherwise(0).alias("touches"),
        _pick(ACTIONS10, k % 10).alias("next_action"),
        F.when(talking, ts("2024-01-01 11:00:00", "days", k % 29)).alias("next_followup"),
        none.cast("timestamp").alias("last_contacted"),
        F.when((k % 10).isin(5, 6), ts("2023-12-20 09:30:00", "days", k % 11)).alias("pilot_start"),
        none.cast("string").alias("lost_reason"),
        F.when(k % 9 <= 2, F.lit("2024-01-02 00:00:00").cast("timestamp")).alias("enriched"),
        ts("2023-11-01 00:00:00", "mins", (k * 7919) % 40000).alias("created"),
        ts("2023-11-01 00:00:00", "mins", (k * 7919) % 40000).alias("updated"),
    )
    parsed = computed_once(rows, "_ph", norm_phone(F.col("phone")))
    return L.score_leads(parsed.withColumns({"wa": F.col("_ph.wa"), "phone_type": F.col("_ph.type")}).drop("_ph"), SETTINGS)


def activities(spark, d):
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") + 1).alias("lead_id"),
        F.when(kind == "click", "sent").when(kind == "signup", "replied").when(kind == "view", "note").when(kind == "purchase", "won")
        .otherwise("called").alias("type"),
        F.when(F.col("event_id") % 3 == 0, "first").otherwise("followup1").alias("step"),
        F.when(k % 2 == 0, "interested").otherwise("no_answer").alias("body"),
        F.col("ts").cast("timestamp").alias("at"),
    )


def now():
    return F.lit(NOW).cast("timestamp")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def signal_text(c="signals"):
    return F.array_join(F.transform(c, lambda s: F.concat_ws("=", s["label"], s["pts"].cast("string"))), "; ")
