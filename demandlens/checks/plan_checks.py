"""Task expansion, cache, breaker, place plans and budgets over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.checks import phrase_views as v
from demandlens.checks.registry import check, table, view
from demandlens.operators.ordering import global_rank
from demandlens.plans import attempts, places, tasks
from demandlens.plans.grid import cover_grid

NOUNS = ("abacus", "chess  Club", "Ring", "vedic maths", "gear", "Robot", "piano", "bolt")
_K = "s_suppkey"

# one scan per supplier
view(
    "v_supplier_scans",
    f"""SELECT {_K} AS search_id, {v._list(NOUNS)}[{_K} % 8 + 1] || CASE WHEN {_K} % 3 = 0 THEN ', ' || s_nationkey || ' kit' ELSE '' END
      || CASE WHEN {_K} % 5 = 0 THEN ' ,, ' || upper({v._list(NOUNS)}[{_K} % 8 + 1]) || ',x,y' ELSE '' END AS seed,
    CASE {_K} % 3 WHEN 0 THEN ['google'] WHEN 1 THEN ['google', 'bing'] ELSE ['bing', 'youtube', 'google'] END AS sources,
    CASE WHEN {_K} % 2 = 0 THEN 'City ' || s_nationkey ELSE '' END AS city,
    {v._list(("quick", "deep", "max", "odd"))}[{_K} % 4 + 1] AS depth FROM supplier""",
)


def supplier_scans(spark, d):
    k, nation = F.col(_K), F.col("s_nationkey").cast("string")
    noun = v._pick(NOUNS, k % 8)
    second = F.when(k % 3 == 0, F.concat(F.lit(", "), nation, F.lit(" kit"))).otherwise("")
    third = F.when(k % 5 == 0, F.concat(F.lit(" ,, "), F.upper(noun), F.lit(",x,y"))).otherwise("")
    lists = [F.array(*[F.lit(x) for x in names]) for names in (("google",), ("google", "bing"), ("bing", "youtube", "google"))]
    return table(spark, d, "supplier").select(
        k.alias("search_id"),
        F.concat(noun, second, third).alias("seed"),
        F.when(k % 3 == 0, lists[0]).when(k % 3 == 1, lists[1]).otherwise(lists[2]).alias("sources"),
        F.when(k % 2 == 0, F.concat(F.lit("City "), nation)).otherwise("").alias("city"),
        v._pick(("quick", "deep", "max", "odd"), k % 4).alias("depth"),
    )


_SEEDS = f"[x for x in [{v.NORM.format('y')} for y in string_split(seed, ',')] if x <> ''][1:3]"


@check(
    "seed_list",
    f"SELECT search_id, seed_no, s[seed_no + 1] AS seed FROM (SELECT search_id, s, unnest(range(len(s))) AS seed_no FROM (SELECT search_id, {_SEEDS} AS s FROM v_supplier_scans))",
    ("v_supplier_scans",),
)
def seed_list(spark, d):
    return tasks.seeds(supplier_scans(spark, d))


def _template_values() -> str:
    rows = [f"({i}, '{c}', '{f}', {w}::DOUBLE)" for i, (c, f, w) in enumerate(tasks._templates(fixed.SUFFIXES, fixed.PREFIXES))]
    return "(VALUES " + ", ".join(rows) + ") AS t(i, cond, fmt, weight)"


@check(
    "tasks_level1",
    f"""SELECT search_id, source, q, w FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id, source, q ORDER BY s_no, seed_no, i) AS r FROM (
    SELECT search_id, sources[s_no + 1] AS source, replace(replace(fmt, '{{s}}', s[seed_no + 1]), '{{c}}', city) AS q, weight AS w, s_no, seed_no, i
    FROM (SELECT *, unnest(range(len(s))) AS seed_no FROM (SELECT *, unnest(range(len(sources))) AS s_no, {_SEEDS} AS s FROM v_supplier_scans)),
      {_template_values()}
    WHERE cond = 'always' OR (cond = 'wide' AND depth IN ('deep', 'max')) OR (cond = 'city' AND city <> ''))) WHERE r = 1""",
    ("v_supplier_scans",),
)
def tasks_level1(spark, d):
    return tasks.expand_level1(supplier_scans(spark, d)).select("search_id", "source", "q", "w")


@check(
    "tasks_level2",
    """SELECT s.search_id, source, phrase || ' ' || chr(CAST(97 + l AS INT)) AS q, 0.6::DOUBLE AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, phrase) AS pos FROM v_scored
  WHERE len(string_split(phrase, ' ')) <= 4) r
  JOIN (SELECT search_id, depth, unnest(CASE depth WHEN 'deep' THEN ['google'] WHEN 'max' THEN ['google', 'bing'] ELSE [] END) AS source FROM v_scans) s
    USING (search_id), range(26) AS letters(l)
WHERE pos <= CASE depth WHEN 'deep' THEN 20 WHEN 'max' THEN 60 ELSE 0 END AND NOT (search_id = 2 AND source = 'bing')""",
    ("v_scored", "v_scans"),
)
def tasks_level2(spark, d):
    both = v.scans(spark, d).withColumn("sources", F.array(F.lit("google"), F.lit("bing")))
    off = both.filter("search_id = 2").select("search_id", F.lit("bing").alias("source"))
    return tasks.expand_level2(v.scored(spark, d), both, off).select("search_id", "source", "q", "w")


@check(
    "cache_split",
    """SELECT o_orderkey, hit, v FROM (SELECT o_orderkey, '{"k": ' || (o_custkey % 130) || '}' AS k FROM orders)
LEFT JOIN (SELECT k, v, exp >= TIMESTAMP '2024-02-10 00:00:00' AS live FROM (
    SELECT props AS k, arg_max(event_type, {'w': ts, 'i': event_type}) AS v, max(ts) + INTERVAL 14 DAY AS exp FROM events GROUP BY props)) c USING (k),
  LATERAL (SELECT coalesce(live, false) AS hit) WHERE hit
UNION ALL
SELECT o_orderkey, false, NULL FROM orders WHERE '{"k": ' || (o_custkey % 130) || '}' NOT IN (
  SELECT props FROM events GROUP BY props HAVING max(ts) + INTERVAL 14 DAY >= TIMESTAMP '2024-02-10 00:00:00')""",
)
def cache_split(spark, d):
    at = F.col("ts").cast("timestamp")
    cache = table(spark, d, "events").select(
        F.col("props").alias("k"), F.col("event_type").alias("v"), (at + F.expr("INTERVAL 14 DAYS")).alias("exp"), at.alias("written")
    )
    todo = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit('{"k": '), (F.col("o_custkey") % 130).cast("string"), F.lit("}")).alias("k")
    )
    now = F.lit("2024-02-10 00:00:00").cast("timestamp")
    return tasks.cache_lookup(todo, cache, now).select("o_orderkey", "hit", "v")


# --- attempts -----------------------------------------------------------------------------------------------------------
_STATUS1 = "CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 429 WHEN 'view' THEN 302 ELSE 200 END"
view(
    "v_tries",
    f"""SELECT search_id, source, seq, try_no, status, has_list FROM (
  SELECT user_id % 3 AS search_id, CAST(user_id % 7 AS VARCHAR) AS source, event_id AS seq, 1 AS try_no, {_STATUS1} AS status,
    value < 100 AS has_list FROM events
  UNION ALL
  SELECT user_id % 3, CAST(user_id % 7 AS VARCHAR), event_id, 2, CASE WHEN event_id % 3 = 0 THEN 200 ELSE {_STATUS1} END, true FROM events
  WHERE event_type IN ('error', 'click', 'view') OR value >= 100)""",
)
view(
    "v_outcomes",
    """SELECT search_id, source, seq, arg_max(o, try_no) AS outcome, count(*) AS requests FROM (
  SELECT *, CASE WHEN status IN (429, 403, 503) OR (status >= 300 AND status < 400) THEN 'rate'
    WHEN status IS NULL OR status < 200 OR status >= 300 OR NOT has_list THEN 'err' ELSE 'ok' END AS o FROM v_tries)
  GROUP BY search_id, source, seq""",
    ("v_tries",),
)
view(
    "v_breaker",
    """SELECT c.*, off_at, off_reason, coalesce(seq > off_at, false) AS skipped FROM (
    SELECT *, sum((outcome = 'rate')::BIGINT) OVER w AS strikes, sum((outcome = 'err')::BIGINT) OVER w AS errs FROM (
      SELECT *, sum((outcome = 'ok')::BIGINT) OVER (PARTITION BY search_id, source ORDER BY seq) AS island FROM v_outcomes)
    WINDOW w AS (PARTITION BY search_id, source, island ORDER BY seq)) c
  LEFT JOIN (SELECT search_id, source, min(seq) AS off_at, arg_min(outcome, seq) AS off_reason FROM (
      SELECT *, sum((outcome = 'rate')::BIGINT) OVER w AS strikes, sum((outcome = 'err')::BIGINT) OVER w AS errs FROM (
        SELECT *, sum((outcome = 'ok')::BIGINT) OVER (PARTITION BY search_id, source ORDER BY seq) AS island FROM v_outcomes)
      WINDOW w AS (PARTITION BY search_id, source, island ORDER BY seq))
    WHERE (outcome = 'rate' AND strikes >= 4) OR (outcome = 'err' AND errs >= 25) GROUP BY ALL) f USING (search_id, source)""",
    ("v_outcomes",),
)


def tries(spark, d):
    return tries_of(table(spark, d, "events"))


def tries_of(events):
    """One row per request: a second one where the first did not end ok."""
    kind = F.col("event_type")
    status = F.when(kind == "error", None).when(kind == "click", 429).when(kind == "view", 302).otherwise(200)
    again = kind.isin("error", "click", "view") | (F.col("value") >= 100)
    first = F.struct(F.lit(1).alias("try_no"), status.alias("status"), (F.col("value") < 100).alias("has_list"))
    second = F.struct(
        F.lit(2).alias("try_no"), F.when(F.col("event_id") % 3 == 0, 200).otherwise(status).alias("status"), F.lit(True).alias("has_list")
    )
    return events.select(
        (F.col("user_id") % 3).alias("search_id"),
        (F.col("user_id") % 7).cast("string").alias("source"),
        F.col("event_id").alias("seq"),
        F.when(again, 2).otherwise(1).alias("tries"),
        F.explode(F.when(again, F.array(first, second)).otherwise(F.array(first))).alias("t"),
    ).select("search_id", "source", "seq", "tries", "t.*")


def outcomes(spark, d):
    return attempts.classify_attempts(tries(spark, d))


@check("attempt_outcomes", "SELECT search_id, source, seq, outcome, requests FROM v_outcomes", ("v_outcomes",))
def attempt_outcomes(spark, d):
    return outcomes(spark, d)


@check(
    "breaker",
    "SELECT search_id, source, seq, outcome, CAST(strikes AS BIGINT) AS strikes, CAST(errs AS BIGINT) AS errs, off_at, skipped FROM v_breaker",
    ("v_breaker",),
)
def breaker(spark, d):
    return attempts.breaker(outcomes(spark, d)).select(
        "search_id", "source", "seq", "outcome", "strikes", "errs", "off_at", "skipped"
    )


@check(
    "scan_summary",
    """SELECT b.search_id, b.done, b.total, b.requests, b.cached, p.phrases, CASE WHEN note IS NULL THEN 'done' ELSE 'partial' END AS status, coalesce(note, '') AS note
FROM (SELECT search_id, count(*) AS done, count(*) AS total, CAST(sum(CASE WHEN NOT skipped THEN requests ELSE 0 END) AS BIGINT) AS requests, 0::BIGINT AS cached
  FROM v_breaker GROUP BY search_id) b
LEFT JOIN (SELECT search_id, string_agg(source || CASE WHEN off_reason = 'rate' THEN ' asked us to slow down, so we stopped using it for this scan.'
    ELSE ' kept failing, so we stopped using it for this scan.' END, ' ' ORDER BY off_at, source) AS note FROM v_breaker WHERE seq = off_at GROUP BY search_id) n USING (search_id)
LEFT JOIN (SELECT search_id, count(*) AS phrases FROM v_agg GROUP BY search_id) p USING (search_id)""",
    ("v_breaker", "v_agg"),
)
def scan_summary(spark, d):
    return attempts.scan_summary(attempts.breaker(outcomes(spark, d)), v.aggregated(spark, d).select("search_id", "phrase"))


# --- place searches -----------------------------------------------------------------------------------------------------
view(
    "v_searches",
    """WITH r AS (SELECT c_custkey AS plan_id, n_name AS city, c_custkey % 4 AS m, least(3, greatest(1, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE c_custkey % 5 END)) AS pages,
    10.0::DOUBLE + c_nationkey AS lat, 70.0::DOUBLE + c_nationkey / 4.0::DOUBLE AS lng,
    CASE WHEN c_custkey % 2 = 0 THEN [lower(c_mktsegment) || ' shop', 'repair'] ELSE [lower(c_mktsegment) || ' shop'] END AS qs
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
  q AS (SELECT *, unnest(range(len(qs))) AS q_no FROM r),
  grid AS (SELECT i, j, i * 4.0::DOUBLE AS dx, j * 4.0::DOUBLE AS dy FROM range(-3, 4) AS a(i), range(-3, 4) AS b(j)
    WHERE sqrt((i * 4.0) ** 2 + (j * 4.0) ** 2) <= 12 + 1.6)
  SELECT plan_id, q_no, l.sub_no, qs[q_no + 1] AS query, qs[q_no + 1] || ' in ' || l.name || ', ' || city AS text, pages, NULL::DOUBLE AS b_lat, NULL::DOUBLE AS b_lng, NULL::INT AS radius
    FROM q, (VALUES (0, 'Old Town'), (1, 'Harbour'), (2, 'Lake View')) AS l(sub_no, name) WHERE m = 0
  UNION ALL
  SELECT plan_id, q_no, (i + 3) * 7 + j + 3, qs[q_no + 1], qs[q_no + 1] || ' in ' || city, pages, round(lat + degrees(dy / 6371.0), 5),
    round(lng + degrees(dx / 6371.0) / cos(radians(lat)), 5), 3000 FROM q, grid WHERE m = 1
  UNION ALL
  SELECT plan_id, q_no, 0, qs[q_no + 1], qs[q_no + 1] || ' in ' || city, pages, NULL, NULL, NULL FROM q WHERE m > 1""",
)


def searches(spark, d):
    k = F.col("c_custkey")
    segment = F.concat(F.lower("c_mktsegment"), F.lit(" shop"))
    nation = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))  # 25 rows
    requests = (
        table(spark, d, "customer")
        .join(nation, "c_nationkey")
        .select(
            k.alias("plan_id"),
            F.when(k % 2 == 0, F.array(segment, F.lit(" repair"), F.concat(segment, F.lit(" ")), F.lit("")))
            .otherwise(F.array(segment))
            .alias("queries"),
            F.concat(F.lit(" "), "n_name").alias("city"),
            F.when(k % 4 == 0, "localities").when(k % 4 == 1, "grid").when(k % 4 == 2, "city").alias("mode"),
            F.array(*[F.lit(x) for x in ("Old Town", "Harbour ", "", "Harbour", "Lake View")]).alias("localities"),
            (k % 5).cast("int").alias("pages"),
            (10.0 + F.col("c_nationkey")).alias("lat"),
            (70.0 + F.col("c_nationkey") / 4.0).alias("lng"),
        )
    )
    return places.plan_searches(requests)


@check(
    "plan_searches",
    "SELECT plan_id, q_no, sub_no, query, text, pages, b_lat, b_lng, radius FROM v_searches",
    ("v_searches",),
)
def plan_searches(spark, d):
    return searches(spark, d).select(
        "plan_id", "q_no", "sub_no", "query", "text", "pages", F.col("bias.lat").alias("b_lat"), F.col("bias.lng").alias("b_lng"), "bias.radius"
    )


@check(
    "plan_estimate",
    """SELECT plan_id, count(*) AS searches, CAST(sum(pages) AS BIGINT) AS worst_requests,
  greatest(0, 500 - (SELECT count(*) FROM events WHERE event_type = 'view' AND CAST(ts AS DATE) = DATE '2024-01-15')) AS room_today,
  CAST(format('{:.2f}', CAST(sum(pages) AS BIGINT) * 0.035::DOUBLE) AS DOUBLE) AS est_usd, array_to_string(list(text ORDER BY q_no, sub_no)[1:3], '|') AS sample
FROM v_searches GROUP BY plan_id""",
    ("v_searches",),
)
def plan_estimate(spark, d):
    used = places.used_on(usage(spark, d), "view", F.lit("2024-01-15").cast("date"))
    out = places.plan_estimate(searches(spark, d), used, cap=500)
    return out.withColumn("sample", F.array_join("sample", "|"))


@check(
    "admit_tasks",
    """SELECT plan_id, ord, CAST(allowed AS BIGINT) AS allowed, CASE WHEN failed THEN 0 ELSE least(needed, allowed) END AS used, allowed > 0 AS admitted FROM (
  SELECT *, least(3, greatest(0, 15000 - coalesce(prior, 0))) AS allowed FROM (
    SELECT *, sum(CASE WHEN failed THEN 3 ELSE needed END) OVER (PARTITION BY plan_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (
      SELECT l_suppkey % 3 AS plan_id, l_orderkey * 8 + l_linenumber AS ord, CAST(l_quantity AS INT) % 3 + 1 AS needed, l_returnflag = 'R' AND l_linestatus = 'F' AS failed FROM lineitem)))""",
)
def admit_tasks(spark, d):
    todo = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 3).alias("plan_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.lit(3).alias("pages"),
        (F.col("l_quantity").cast("int") % 3 + 1).alias("needed"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("failed"),
    )
    return places.admit_tasks(todo, 15000).select("plan_id", "ord", "allowed", "used", "admitted")


def usage(spark, d):
    return places.usage_daily(
        table(spark, d, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("api"), F.lit(1).alias("n"))
    )


@check(
    "usage_daily",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS api, count(*) AS n FROM events GROUP BY ALL",
)
def usage_daily(spark, d):
    return usage(spark, d).withColumn("day", F.col("day").cast("string"))


@check(
    "follow_pages",
    """SELECT search_no, page, results FROM (SELECT *, count(*) FILTER (results < 20 OR token = '') OVER (PARTITION BY search_no ORDER BY page
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM (
  SELECT l_orderkey AS search_no, l_linenumber AS page, CASE WHEN l_quantity > 8 THEN 20 ELSE CAST(l_quantity AS INT) END AS results,
    CASE WHEN l_returnflag = 'R' THEN '' ELSE 'next' END AS token FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)))
WHERE stops = 0 AND page <= 3""",
)
def follow_pages(spark, d):
    first = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(first).alias("r"))
    pages = lines.select(
        F.col("l_orderkey").alias("search_no"),
        F.col("l_linenumber").alias("page"),
        F.when(F.col("r.l_quantity") > 8, 20).otherwise(F.col("r.l_quantity").cast("int")).alias("results"),
        F.when(F.col("r.l_returnflag") == "R", "").otherwise("next").alias("token"),
    )
    return places.follow_pages(pages).select("search_no", "page", "results")


@check(
    "prefill_queries",
    r"""SELECT search_id, coalesce(q, trim(string_split(seed, ',')[1]) || ' classes') AS queries FROM v_scans LEFT JOIN (
  SELECT search_id, string_agg(phrase, '|' ORDER BY rank) AS q FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY rank) AS r FROM v_keywords
    WHERE rank <= 2000 AND intent = 'local' AND place = '' AND len(string_split(phrase, ' ')) <= 3 AND NOT regexp_matches(phrase, 'near me|online|free'))
  WHERE r <= 2 GROUP BY search_id) USING (search_id)""",
    ("v_scans", "v_keywords"),
)
def prefill_queries(spark, d):
    kw = v.keywords(spark, d)
    out = places.prefill_queries(kw, v.scans(spark, d), loaded=2000)
    return out.withColumn("queries", F.array_join("queries", "|"))


@check(
    "grid",
    """SELECT c_custkey, (i + 3) * 7 + j + 3 AS point_no, round(lat + degrees(j * 4.0::DOUBLE / 6371.0), 5) AS p_lat,
  round(lng + degrees(i * 4.0::DOUBLE / 6371.0) / cos(radians(lat)), 5) AS p_lng, 3000 AS radius
FROM (SELECT c_custkey, -40.0::DOUBLE + c_custkey % 80 AS lat, -100.0::DOUBLE + c_custkey % 200 AS lng FROM customer), range(-3, 4) AS a(i), range(-3, 4) AS b(j)
WHERE sqrt((i * 4.0) ** 2 + (j * 4.0) ** 2) <= 12 + 1.6""",
)
def grid(spark, d):
    k = F.col("c_custkey")
    cities = table(spark, d, "customer").select(k, (-40.0 + k % 80).alias("lat"), (-100.0 + k % 200).alias("lng"))
    return cover_grid(cities, 0, 0).select("c_custkey", "point_no", "p_lat", "p_lng", "radius")


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")


@check(
    "admit_all",
    f"""SELECT plan_id, ord, CAST(allowed AS BIGINT) AS allowed, CASE WHEN failed THEN 0 ELSE least(needed, allowed) END AS used, allowed > 0 AS admitted FROM (
  SELECT *, least(3, greatest(0, budget - coalesce(prior, 0))) AS allowed FROM (
    SELECT *, sum(CASE WHEN failed THEN 3 ELSE needed END) OVER (PARTITION BY plan_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
      count(*) OVER (PARTITION BY plan_id) AS budget FROM (
      SELECT l_suppkey % 3 AS plan_id, row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY {', '.join(_LINE)}) AS ord, CAST(l_quantity AS INT) % 3 + 1 AS needed,
        l_returnflag = 'R' AND l_linestatus = 'F' AS failed FROM lineitem)))""",
)
def admit_all(spark, d):
    """Every line is a search with a place of its own in the plan's order; the budget ends midway."""
    lines = table(spark, d, "lineitem").select((F.col("l_suppkey") % 3).alias("plan_id"), *_LINE)
    ranked = global_rank(lines, ["plan_id"], [F.col(c) for c in _LINE], "ord", "budget")
    todo = ranked.select(
        "plan_id", "ord", "budget", F.lit(3).alias("pages"), (F.col("l_quantity").cast("int") % 3 + 1).alias("needed"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("failed"),
    )
    return places.admit_tasks(todo, F.col("budget")).select("plan_id", "ord", "allowed", "used", "admitted")


_PAGE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")


@check(
    "follow_all_pages",
    f"""SELECT search_no, page, results FROM (SELECT *, count(*) FILTER (results < 20 OR token = '') OVER (PARTITION BY search_no ORDER BY page
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM (
  SELECT l_orderkey AS search_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_PAGE)}) AS page, CASE WHEN l_quantity > 8 THEN 20 ELSE CAST(l_quantity AS INT) END AS results,
    CASE WHEN l_returnflag = 'R' THEN '' ELSE 'next' END AS token FROM lineitem))
WHERE stops = 0 AND page <= 3""",
)
def follow_all_pages(spark, d):
    """Every line is a page, numbered within its order."""
    lines = global_rank(table(spark, d, "lineitem").select("l_orderkey", *_PAGE), ["l_orderkey"], [F.col(c) for c in _PAGE], "page")
    pages = lines.select(
        F.col("l_orderkey").alias("search_no"), "page",
        F.when(F.col("l_quantity") > 8, 20).otherwise(F.col("l_quantity").cast("int")).alias("results"),
        F.when(F.col("l_returnflag") == "R", "").otherwise("next").alias("token"),
    )
    return places.follow_pages(pages).select("search_no", "page", "results")


@check(
    "admit_until_refused",
    f"""WITH t AS (SELECT l_suppkey % 5 AS plan_id, row_number() OVER (PARTITION BY l_suppkey % 5 ORDER BY {', '.join(_LINE)}) AS ord, CAST(l_quantity AS INT) % 3 + 1 AS needed,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN CASE WHEN l_partkey % 307 = 11 THEN 403 WHEN l_partkey % 211 = 5 THEN 400 ELSE 503 END END AS status FROM lineitem),
  b AS (SELECT plan_id, least(4000, greatest(1, CASE plan_id WHEN 0 THEN 900 WHEN 1 THEN 0 WHEN 2 THEN -5 WHEN 3 THEN 100000 END, CASE WHEN plan_id = 4 THEN 3 * n END, CASE WHEN plan_id = 1 THEN 3 * n END)) AS budget
    FROM (SELECT plan_id, count(*) AS n FROM t GROUP BY plan_id)),
  a AS (SELECT *, least(3, greatest(0, budget - coalesce(prior, 0))) AS room FROM (
    SELECT t.*, budget, sum(CASE WHEN status IS NOT NULL THEN 3 ELSE needed END) OVER (PARTITION BY plan_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM t JOIN b USING (plan_id))),
  s AS (SELECT plan_id, min(ord) AS stop FROM a WHERE status IN (400, 401, 403) AND room > 0 GROUP BY plan_id),
  c AS (SELECT a.*, CASE WHEN ord > stop THEN 0 ELSE room END AS allowed FROM a LEFT JOIN s USING (plan_id))
SELECT plan_id, ord, CAST(allowed AS BIGINT) AS allowed, CASE WHEN status IS NOT NULL THEN 0 ELSE least(needed, allowed) END AS used, allowed > 0 AS admitted FROM c""",
)
def admit_until_refused(spark, d):
    """Budgets from what is left, asked for and needed at worst; a refused search ends its plan."""
    lines = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("plan_id"), *_LINE)
    ranked = global_rank(lines, ["plan_id"], [F.col(c) for c in _LINE], "ord", "n")
    failed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    asked = F.element_at(F.array(*[F.lit(x).cast("long") for x in (900, 0, -5, 100_000, None)]), (F.col("plan_id") + 1).cast("int"))
    todo = ranked.select(
        "plan_id", "ord", F.lit(3).alias("pages"), (F.col("l_quantity").cast("int") % 3 + 1).alias("needed"), failed.alias("failed"),
        F.when(failed, F.when(F.col("l_partkey") % 307 == 11, 403).when(F.col("l_partkey") % 211 == 5, 400).otherwise(503)).alias("status"),
        places.request_budget(F.lit(4000), asked, F.col("n") * 3).alias("budget"),
    )
    return places.admit_tasks(todo, F.col("budget")).select("plan_id", "ord", "allowed", "used", "admitted")
