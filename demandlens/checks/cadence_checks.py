"""The event fold, queues, reports and messages over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.checks import lead_views as v
from demandlens.checks.registry import check, table, view
from demandlens.operators import cadence, outreach, reports
from demandlens.plans import places
from demandlens.settings import Settings

# --- events for the fold --------------------------------------------------------------------------------------------------
# event_id % 12 picks what happens, so that all kinds occur in any order
_KINDS = (
    ("sent", None), ("sent", None), ("called", "no_answer"), ("replied", None), ("sent", None), ("called", "interested"), ("note", None),
    ("snooze", None), ("pilot", None), ("no_whatsapp", None), ("called", "not_interested"), ("sent", None), ("won", None), ("lost", None),
    ("wrong_number", None), ("dance", None), ("sent", None),
)
_PICK = "event_id * 31 + CAST(floor(value) AS BIGINT)"


def _kind_list(i: int) -> str:
    return "[" + ",".join("NULL" if k[i] is None else f"'{k[i]}'" for k in _KINDS) + "]"


view(
    "v_events",
    f"""SELECT event_id, user_id * 7 + 1 AS lead_id, {_kind_list(0)}[({_PICK}) % {len(_KINDS)} + 1] AS ev, {_kind_list(1)}[({_PICK}) % {len(_KINDS)} + 1] AS outcome,
  CASE WHEN event_id % 5 = 0 THEN 'too dear' END AS reason, CAST(event_id % 4 AS INT) AS days, CASE WHEN event_id % 6 = 0 THEN 'text ' || event_id ELSE '' END AS body,
  CASE WHEN event_id % 7 = 0 THEN 'ta' END AS lang, ts AS "at" FROM events""",
)


def events(spark, d):
    return events_of(table(spark, d, "events"))


def events_of(raw):
    i = F.col("event_id")
    pick = (i * 31 + F.floor("value")) % len(_KINDS)
    kinds = F.array(*[F.struct(F.lit(e).alias("ev"), F.lit(o).cast("string").alias("outcome")) for e, o in _KINDS])
    kind = F.element_at(kinds, (pick + 1).cast("int"))
    return raw.select(
        i,
        (F.col("user_id") * 7 + 1).alias("lead_id"),
        kind["ev"].alias("ev"),
        kind["outcome"].alias("outcome"),
        F.when(i % 5 == 0, "too dear").alias("reason"),
        (i % 4).cast("int").alias("days"),
        F.when(i % 6 == 0, F.concat(F.lit("text "), i.cast("string"))).otherwise("").alias("body"),
        F.when(i % 7 == 0, "ta").alias("lang"),
        F.col("ts").cast("timestamp").alias("at"),
    )


def _eleven(days: str) -> str:
    return f"date_trunc('day', e.at + INTERVAL 1 DAY * ({days})) + INTERVAL 11 HOUR"


_STEP = "coalesce(f.action, CASE WHEN f.stage = 'new' THEN CASE WHEN f.wa <> '' AND NOT f.landline THEN 'first' ELSE 'call' END END)"
_TALK = "e.ev = 'called' AND coalesce(e.outcome, '') NOT IN ('interested', 'not_interested') AND f.stage IN ('replied', 'pilot')"
_COLD = "e.ev = 'called' AND coalesce(e.outcome, '') NOT IN ('interested', 'not_interested') AND f.stage NOT IN ('replied', 'pilot')"
_WARM = "(e.ev = 'called' AND e.outcome = 'interested') OR (e.ev = 'replied' AND f.stage IN ('new', 'contacted'))"
# one event per lead and recursion step
view(
    "v_fold",
    f"""WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY "at", event_id) AS rn FROM v_events
    WHERE ev <> 'dance' AND lead_id IN (SELECT id FROM v_leads)),
  fold AS (
    SELECT id AS lead_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS ev, NULL::VARCHAR AS step, stage, next_action AS action, next_followup AS followup,
      touches, phone_type = 'landline' AS landline, wa, pilot_start, NULL::VARCHAR AS lost_reason, NULL::TIMESTAMP AS last_contacted FROM v_leads
    UNION ALL
    SELECT f.lead_id, e.rn, e.event_id, e.ev, {_STEP},
      CASE WHEN e.ev = 'sent' AND {_STEP} = 'first' THEN 'contacted' WHEN {_WARM} THEN 'replied' WHEN e.ev = 'called' AND e.outcome = 'not_interested' THEN 'lost'
        WHEN {_COLD} THEN CASE WHEN f.touches > 0 THEN 'lost' ELSE 'contacted' END WHEN e.ev = 'pilot' THEN 'pilot' WHEN e.ev IN ('won', 'lost') THEN e.ev
        WHEN e.ev = 'wrong_number' THEN 'invalid' ELSE f.stage END,
      CASE WHEN e.ev = 'sent' THEN CASE {_STEP} WHEN 'first' THEN 'followup1' WHEN 'followup1' THEN 'call' WHEN 'send_details' THEN 'nudge_details' WHEN 'nudge_details' THEN 'call'
          WHEN 'checkin3' THEN 'checkin7' WHEN 'checkin7' THEN 'review30' WHEN 'review30' THEN NULL ELSE f.action END
        WHEN {_WARM} THEN 'send_details' WHEN {_TALK} THEN coalesce({_STEP}, 'nudge_details') WHEN {_COLD} THEN CASE WHEN f.touches > 0 THEN NULL ELSE 'call' END
        WHEN e.ev = 'called' OR e.ev IN ('won', 'lost', 'wrong_number') THEN NULL WHEN e.ev = 'pilot' THEN 'checkin3' WHEN e.ev = 'no_whatsapp' THEN 'call'
        WHEN e.ev = 'snooze' THEN {_STEP} ELSE f.action END,
      CASE WHEN e.ev = 'sent' THEN CASE {_STEP} WHEN 'first' THEN {_eleven('1')} WHEN 'followup1' THEN {_eleven('3')} WHEN 'send_details' THEN {_eleven('2')} WHEN 'nudge_details' THEN {_eleven('2')}
          WHEN 'checkin3' THEN {_eleven('4')} WHEN 'checkin7' THEN {_eleven('greatest(1, CAST(ceil(epoch_us(coalesce(f.pilot_start, e.at) + INTERVAL 30 DAY) / 86400000000.0::DOUBLE - epoch_us(e.at) / 86400000000.0::DOUBLE) AS INT))')}
          WHEN 'review30' THEN NULL ELSE f.followup END
        WHEN {_WARM} THEN e.at WHEN {_TALK} THEN {_eleven('2')} WHEN {_COLD} THEN CASE WHEN f.touches > 0 THEN NULL ELSE {_eleven('1')} END
        WHEN e.ev = 'called' OR e.ev IN ('won', 'lost', 'wrong_number') THEN NULL WHEN e.ev = 'pilot' THEN {_eleven('3')} WHEN e.ev = 'no_whatsapp' THEN e.at
        WHEN e.ev = 'snooze' THEN {_eleven('greatest(1, e.days)')} ELSE f.followup END,
      CASE WHEN e.ev = 'sent' AND {_STEP} IN ('first', 'followup1') THEN f.touches + 1 WHEN {_COLD} AND NOT f.touches > 0 THEN 1 ELSE f.touches END,
      f.landline OR e.ev = 'no_whatsapp', f.wa, CASE WHEN e.ev = 'pilot' THEN e.at ELSE f.pilot_start END,
      CASE WHEN e.ev = 'called' AND e.outcome = 'not_interested' THEN 'not interested' WHEN {_COLD} AND f.touches > 0 THEN 'no reply after call'
        WHEN e.ev = 'lost' THEN coalesce(e.reason, 'not interested') WHEN e.ev = 'wrong_number' THEN 'wrong number' ELSE f.lost_reason END,
      CASE WHEN e.ev IN ('sent', 'called') THEN e.at ELSE f.last_contacted END
    FROM fold f JOIN ev e ON e.lead_id = f.lead_id AND e.rn = f.rn + 1)
  SELECT * FROM fold""",
    ("v_events", "v_leads"),
)


@check(
    "cadence_state",
    f"""SELECT lead_id AS id, stage, action AS next_action, {v.stamp_sql('followup')} AS next_followup, touches, landline, {v.stamp_sql('pilot_start')} AS pilot_start,
  lost_reason, {v.stamp_sql('last_contacted')} AS last_contacted FROM v_fold QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY rn DESC) = 1""",
    ("v_fold",),
)
def cadence_state(spark, d):
    leads, _, _ = cadence.log_events(v.leads(spark, d), events(spark, d))
    return leads.select(
        "id", "stage", "next_action", v.stamp("next_followup").alias("next_followup"), "touches", (F.col("phone_type") == "landline").alias("landline"),
        v.stamp("pilot_start").alias("pilot_start"), "lost_reason", v.stamp("last_contacted").alias("last_contacted"),
    )


@check(
    "cadence_activities",
    f"""SELECT f.event_id AS id, f.lead_id, f.ev AS type, coalesce(f.step, '') AS step, coalesce(e.lang, l.lang) AS lang,
  CASE WHEN e.body <> '' THEN e.body ELSE coalesce(e.outcome, e.reason, '') END AS body, {v.stamp_sql('e."at"')} AS "at"
FROM v_fold f JOIN v_events e ON e.event_id = f.event_id JOIN v_leads l ON l.id = f.lead_id""",
    ("v_fold",),
)
def cadence_activities(spark, d):
    _, activities, _ = cadence.log_events(v.leads(spark, d), events(spark, d))
    return activities.withColumn("at", v.stamp("at"))


@check(
    "cadence_errors",
    """SELECT event_id, lead_id, ev, CASE WHEN ev = 'dance' THEN 'Unknown event dance' ELSE 'Lead not found' END AS problem FROM v_events
WHERE ev = 'dance' OR lead_id NOT IN (SELECT id FROM v_leads)""",
    ("v_events", "v_leads"),
)
def cadence_errors(spark, d):
    _, _, errors = cadence.log_events(v.leads(spark, d), events(spark, d))
    return errors


@check(
    "current_step",
    """SELECT id, coalesce(next_action, CASE WHEN stage = 'new' THEN CASE WHEN wa <> '' AND phone_type <> 'landline' THEN 'first' ELSE 'call' END END) AS step,
  strftime(date_trunc('day', created + INTERVAL 3 DAY) + INTERVAL 11 HOUR, '%Y-%m-%d %H:%M:%S') AS slot FROM v_leads""",
    ("v_leads",),
)
def current_step(spark, d):
    slot = cadence.at_eleven(F.col("created"), F.lit(3))
    return v.leads(spark, d).select("id", cadence.current_step().alias("step"), v.stamp(slot).alias("slot"))


# --- queues ---------------------------------------------------------------------------------------------------------------
_LV = ("v_leads", "v_act")
_DUE = f"next_action IS NOT NULL AND next_followup <= TIMESTAMP '{v.NOW}' AND stage NOT IN ('won', 'lost', 'invalid')"
_NEW = "stage = 'new' AND next_action IS NULL AND phone_type <> 'invalid'"
_LEFT = f"(SELECT greatest(0, 400 - count(*)) FROM v_act WHERE type = 'sent' AND step = 'first' AND \"at\" >= date_trunc('day', TIMESTAMP '{v.NOW}'))"


@check("queue_due", f"SELECT id, next_action, {v.stamp_sql('next_followup')} AS next_followup FROM v_leads WHERE {_DUE} ORDER BY v_leads.next_followup, id LIMIT 200", ("v_leads",))
def queue_due(spark, d):
    return cadence.due(v.leads(spark, d), v.now()).select("id", "next_action", v.stamp("next_followup").alias("next_followup"))


@check(
    "queue_fresh",
    f"""SELECT id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, reviews DESC NULLS LAST, id) AS r FROM v_leads WHERE {_NEW} AND score >= 30) WHERE r <= {_LEFT}""",
    _LV,
)
def queue_fresh(spark, d):
    return cadence.fresh(v.leads(spark, d), v.activities(spark, d), v.now(), cap=400, min_score=30).select("id", "score")


@check("queue_cap", f"SELECT {_LEFT} AS cap_left", ("v_act",))
def queue_cap(spark, d):
    return cadence.cap_left(v.activities(spark, d), v.now(), cap=400)


@check("queue_waiting", f"SELECT count(*) AS waiting FROM v_leads WHERE {_NEW}", ("v_leads",))
def queue_waiting(spark, d):
    return cadence.waiting(v.leads(spark, d))


@check(
    "state_counts",
    f"""SELECT least(200, (SELECT count(*) FROM v_leads WHERE {_DUE})) AS due, least({_LEFT}, (SELECT count(*) FROM v_leads WHERE {_NEW} AND score >= 30)) AS fresh,
  (SELECT count(*) FROM v_leads) AS leads, (SELECT count(*) FROM events WHERE event_type = 'view' AND CAST(ts AS DATE) = DATE '2024-01-15') AS used_today""",
    _LV,
)
def state_counts(spark, d):
    log = table(spark, d, "events").select(
        F.col("ts").alias("at"), F.when(F.col("event_type") == "view", "places").otherwise("other").alias("api"), F.lit(1).alias("n")
    )
    return cadence.state_counts(v.leads(spark, d), v.activities(spark, d), places.usage_daily(log), v.now(), cap=400, min_score=30)


# --- reports --------------------------------------------------------------------------------------------------------------
view(
    "v_funnel",
    """SELECT count(*) AS found, count(*) FILTER (phone_type <> 'invalid') AS reachable, count(*) FILTER (touches > 0) AS contacted,
  (SELECT count(DISTINCT lead_id) FROM v_act WHERE type = 'replied' OR (type = 'called' AND body = 'interested')) AS replied,
  count(*) FILTER (pilot_start IS NOT NULL) AS pilot, count(*) FILTER (stage = 'won') AS won FROM v_leads""",
    _LV,
)
_STAGE_NAMES = "[" + ",".join(f"'{s}'" for s in fixed.FUNNEL_STAGES) + "]"
view(
    "v_conversion",
    f"""SELECT i - 1 AS i, {_STAGE_NAMES}[i] AS stage, ns[i] AS n, CASE WHEN i > 1 THEN ns[i - 1] END AS prev, CASE WHEN i > 1 THEN {_STAGE_NAMES}[i - 1] END AS prev_stage,
    CASE WHEN i > 1 AND ns[i - 1] > 0 THEN ns[i]::DOUBLE / ns[i - 1] END AS ratio
  FROM (SELECT [found, reachable, contacted, replied, pilot, won] AS ns, unnest(range(1, 7)) AS i FROM v_funnel)""",
    ("v_funnel",),
)


def _funnel(spark, d):
    return reports.funnel(v.leads(spark, d), v.activities(spark, d))


@check("funnel", "SELECT * FROM v_funnel", ("v_funnel",))
def funnel(spark, d):
    return _funnel(spark, d)


@check("funnel_conversion", "SELECT i, stage, n, prev, CAST(floor(ratio * 100 + 0.5) AS INT) AS percent FROM v_conversion", ("v_conversion",))
def funnel_conversion(spark, d):
    return reports.funnel_conversion(_funnel(spark, d)).select("i", "stage", "n", "prev", "percent")


@check(
    "weakest_step",
    "SELECT prev_stage AS from_stage, stage AS to_stage, CAST(floor(ratio * 100 + 0.5) AS INT) AS percent FROM v_conversion WHERE prev >= 5 ORDER BY ratio, i LIMIT 1",
    ("v_conversion",),
)
def weakest_step(spark, d):
    return reports.weakest_step(reports.funnel_conversion(_funnel(spark, d)))


_DAYS = """SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, count(*) FILTER (type = 'sent') AS sent, count(*) FILTER (type = 'replied') AS replied
FROM (SELECT DATE '2024-02-02' - CAST(i AS INT) AS day FROM range(14) AS r(i)) LEFT JOIN v_act ON CAST("at" AS DATE) = day GROUP BY day"""


def _daily(spark, d):
    return reports.daily_activity(v.activities(spark, d), F.lit("2024-02-02 08:00:00").cast("timestamp"))


@check("daily_activity", _DAYS, ("v_act",))
def daily_activity(spark, d):
    return _daily(spark, d).withColumn("day", F.col("day").cast("string"))


@check("activity_totals", f"SELECT CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(replied) AS BIGINT) AS replied FROM ({_DAYS})", ("v_act",))
def activity_totals(spark, d):
    return reports.activity_totals(_daily(spark, d))


def _rate_sql(dim: str) -> str:
    return f"""SELECT '{dim}' AS dim, k, contacted, replied, CAST(floor(replied / contacted::DOUBLE * 100 + 0.5) AS INT) AS rate FROM (
  SELECT {dim} AS k, count(*) AS contacted, count(*) FILTER (stage IN ('replied', 'pilot', 'won') OR pilot_start IS NOT NULL) AS replied
  FROM v_leads WHERE touches > 0 AND {dim} <> '' GROUP BY {dim} ORDER BY contacted DESC, k LIMIT 3)"""


@check("reply_rate", f"{_rate_sql('lang')} UNION ALL {_rate_sql('query')}", ("v_leads",))
def reply_rate(spark, d):
    return reports.reply_rate(v.leads(spark, d), top=3).select("dim", "k", "contacted", "replied", "rate")


@check("stage_counts", "SELECT stage, count(*) AS n FROM v_leads GROUP BY stage", ("v_leads",))
def stage_counts(spark, d):
    return reports.stage_counts(v.leads(spark, d))


# --- messages -------------------------------------------------------------------------------------------------------------
_S = Settings()
_HELLO = "CASE WHEN contact_name <> '' THEN 'Hello ' || contact_name || ' 🙏' ELSE 'Hello 🙏' END"
_AREA_LINE = f"CASE WHEN area <> '' THEN 'I found your {_S.org} in ' || area || '.' ELSE '' END"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _render_sql(step: str, lang: str) -> str:
    cases = []
    for name, _, _, tpl in fixed.STEPS:
        ta = _S.templates.get(f"{tpl}_ta")
        if ta:
            cases.append(f"WHEN {step} = '{name}' AND {lang} = 'ta' THEN {_text(ta)}")
        cases.append(f"WHEN {step} = '{name}' THEN {_text(_S.templates[f'{tpl}_en'])}")
    out = "CASE " + " ".join(cases) + " ELSE '' END"
    for key in ("sender", "product", "topic", "org", "link", "offer"):
        out = f"replace({out}, '{{{key}}}', {_text(getattr(_S, key))})"
    out = f"replace(replace(replace({out}, '{{hello}}', {_HELLO}), '{{area_line}}', {_AREA_LINE}), '{{name}}', name)"
    return f"trim(regexp_replace(regexp_replace({out}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))"


_CAN = "(wa <> '' AND phone_type <> 'landline')"
_ENC = "url_encode(text)"
for _code, _char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
    _ENC = f"replace({_ENC}, '{_code}', '{_char}')"
_LABELS = "MAP {" + ", ".join(f"'{s}': '{label}'" for s, label, _, _ in fixed.STEPS) + "}"
_HINTS = "MAP {" + ", ".join(f"'{s}': {_text(_S.hints[s])}" for s, *_ in fixed.STEPS) + "}"


def _action_sql(where: str = "true", step0: str | None = None) -> str:
    step0 = step0 or f"coalesce(next_action, CASE WHEN stage = 'new' THEN CASE WHEN {_CAN} THEN 'first' ELSE 'call' END END)"
    return f"""SELECT id, step, CASE WHEN fallback THEN 'Call (no WhatsApp number)' ELSE ({_LABELS})[step0] END AS label, CASE WHEN step = 'call' THEN 'call' ELSE 'whatsapp' END AS channel,
    ({_HINTS})[step0] AS hint, text, CASE WHEN {_CAN} THEN 'https://wa.me/' || wa || '?text=' || {_ENC} ELSE '' END AS wa,
    CASE WHEN wa <> '' THEN 'tel:+' || wa WHEN phone <> '' THEN 'tel:' || regexp_replace(phone, '[^0-9+]', '', 'g') ELSE '' END AS tel
  FROM (SELECT *, {_render_sql('step', 'lang')} AS text FROM (SELECT *, CASE WHEN fallback THEN 'call' ELSE step0 END AS step FROM (
    SELECT *, step0 <> 'call' AND NOT {_CAN} AS fallback FROM (SELECT *, {step0} AS step0 FROM v_leads WHERE {where})))) WHERE step IS NOT NULL"""


def _flat(df):
    a = F.col("action")
    return df.filter(a.isNotNull()).select("id", *[a[c].alias(c) for c in ("step", "label", "channel", "hint", "text", "wa", "tel")])


@check("next_actions", _action_sql(), ("v_leads",))
def next_actions(spark, d):
    return _flat(outreach.next_actions(v.leads(spark, d), _S))


@check("render_override", _action_sql(step0="'followup1'").replace("lang = 'ta'", "true"), ("v_leads",))
def render_override(spark, d):
    """Step and language chosen by the caller."""
    return _flat(outreach.next_actions(v.leads(spark, d), _S, step="followup1", lang="ta"))


@check(
    "queue_actions",
    f"""WITH due AS (SELECT 'due' AS queue, id FROM v_leads WHERE {_DUE} ORDER BY v_leads.next_followup, id LIMIT 200),
  fresh AS (SELECT 'fresh' AS queue, id FROM (SELECT *, row_number() OVER (ORDER BY score DESC, reviews DESC NULLS LAST, id) AS r FROM v_leads WHERE {_NEW} AND score >= 30) WHERE r <= {_LEFT}),
  actions AS ({_action_sql()})
SELECT queue, id, step, text FROM (SELECT * FROM due UNION ALL SELECT * FROM fresh) JOIN actions USING (id)""",
    _LV,
)
def queue_actions(spark, d):
    leads, acts = v.leads(spark, d), v.activities(spark, d)
    both = outreach.queue_with_actions(cadence.due(leads, v.now()), cadence.fresh(leads, acts, v.now(), 400, 30), _S)
    return both.select("queue", "id", F.col("action.step").alias("step"), F.col("action.text").alias("text"))
