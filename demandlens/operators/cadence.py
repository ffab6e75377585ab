"""Follow-up cadence: the event-driven state of a lead, and the queues that come out of it.

Only the control state of a lead (see ``transitions``) needs a fold over its events; what an event writes is then read off the rule it
meets.  Events become functions from control states to control states, and their composition is associative, so the fold is a parallel
prefix: a lead's events are cut into chunks of CHUNK, each chunk's function is composed in one aggregate, FAN chunks make a
larger one, until a lead is one chunk; the states at the borders are handed down the same way.  A lead with up to CHUNK events needs
no functions, and one with any number never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens import fixed
from demandlens.functions import text
from demandlens.operators import ordering, transitions
from demandlens.operators.transitions import ACTIONS, EVENT_KINDS, EVENTS, N_STATES
from demandlens.session import pin

#: Events of a chunk, chunks of a larger chunk.
CHUNK, FAN = 64, 64
#: After so many events of a chunk all start states have come down to a few, and only those are followed.
HEAD = 8


def _ints(values) -> Column:
    """A constant array, folded once when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _texts(values) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values])


# --- column expressions ---------------------------------------------------------------------------------------------------


def current_step() -> Column:
    """The next action; for a new lead without one the first message, or a call if it cannot get one; else NULL."""
    reachable = (text.or_blank(F.col("wa")) != "") & (text.or_blank(F.col("phone_type")) != "landline")
    opening = F.when(F.col("stage") == "new", F.when(reachable, "first").otherwise("call"))
    return F.coalesce(text.blank_to_null(F.col("next_action")), opening)


def at_eleven(ts: Column, days: Column) -> Column:
    """Eleven o'clock, session zone, ``days`` after ``ts``."""
    shifted = ts + F.make_dt_interval(days=days.cast("int"))
    return F.date_trunc("day", shifted) + F.expr("INTERVAL 11 HOURS")


def event_kind(ev: Column, outcome: Column) -> Column:
    split = (ev == "called") & F.coalesce(outcome.isin("interested", "not_interested"), F.lit(False))
    return F.when(split, F.concat_ws(":", ev, outcome)).otherwise(ev)


def current_rule(kind: Column, state: Column) -> Column:
    """Number of the rule (see ``transitions.RULES``) that an event of the given kind code meets."""
    table = [transitions.rule_of(s, k) for k in EVENT_KINDS for s in range(N_STATES)]
    return F.get(_ints(table), kind * N_STATES + state)


def transition(df: DataFrame) -> DataFrame:
    """What one event does to the lead row it is joined with.

    Needs ``_kind`` (code of the event), ``_before`` (control state), the lead's pilot_start and the event's at, reason, days.  Adds
    ``u``: step (before), stage, touch (0/1), schedule (whether next_action/next_followup are written), action, followup,
    contacted, pilot, landline, lost_reason (NULL = not written), writes (whether anything is written).
    """
    rules = (transitions.NO_RULE, *transitions.RULES)
    rule, at, kind = F.col("_rule"), F.col("at"), F.col("_kind")
    of = lambda values: F.get(_texts(values), rule)
    base = df.withColumns(
        {
            "_rule": current_rule(F.col("_kind"), F.col("_before")),
            "_step": text.blank_to_null(F.get(_texts(transitions.step_of(s) for s in range(N_STATES)), F.col("_before"))),
        }
    )
    wait, action = of(r.wait for r in rules), of(r.action for r in rules)
    trial_end = F.coalesce("pilot_start", "at") + F.expr("INTERVAL 30 DAYS")
    days_left = F.ceil((F.unix_micros(trial_end) - F.unix_micros(at)) / F.lit(86_400_000_000))
    days = (
        F.when(wait == transitions.TRIAL, F.greatest(F.lit(1), days_left))
        .when(wait == transitions.ASKED, F.greatest(F.lit(1), F.coalesce("days", F.lit(1))))
        .when(wait != transitions.NOW, wait.try_cast("int"))
    )
    reason = of(r.reason for r in rules)
    lost = [i for i, r in enumerate(rules) if r.kind == "lost"]
    is_kind = lambda *names: kind.isin(*[EVENT_KINDS.index(n) for n in names])
    contacted = is_kind("sent", "called", "called:interested", "called:not_interested")
    schedule = action.isNotNull()
    new_stage = of(r.stage for r in rules)
    return base.withColumn(
        "u",
        F.struct(
            F.col("_step").alias("step"),
            F.coalesce(new_stage, F.get(_texts(transitions.decode(s)[0] for s in range(N_STATES)), F.col("_before"))).alias("stage"),
            F.get(_ints(int(r.touch) for r in rules), rule).alias("touch"),
            schedule.alias("schedule"),
            F.when(action == transitions.SAME, F.col("_step")).otherwise(text.blank_to_null(action)).alias("action"),
            F.when(wait == transitions.NOW, at).when(wait.isNotNull(), at_eleven(at, days)).alias("followup"),
            contacted.alias("contacted"),
            is_kind("pilot").alias("pilot"),
            is_kind("no_whatsapp").alias("landline"),
            F.when(rule.isin(lost), F.coalesce(text.blank_to_null(F.col("reason")), reason)).otherwise(reason).alias("lost_reason"),
            (contacted | schedule | new_stage.isNotNull()).alias("writes"),
        ),
    ).drop("_kind", "_rule", "_step")


# --- the fold -------------------------------------------------------------------------------------------------------------


def _after(kind: Column, state: Column) -> Column:
    return F.get(_ints(transitions.after(s, k) for k in EVENT_KINDS for s in range(N_STATES)), kind * N_STATES + state)


def _chunk_function(kinds: Column) -> Column:
    """Where each control state ends up after the events of a chunk."""

    def followed(states: Column, some: Column) -> Column:
        return F.aggregate(some, states, lambda acc, k: F.transform(acc, lambda s: _after(k, s)))

    def rest(begun: Column) -> Column:
        few = F.array_distinct(begun)
        return text.let(
            F.struct(few.alias("few"), followed(few, F.slice(kinds, HEAD + 1, CHUNK)).alias("ends")),
            lambda x: F.transform(begun, lambda s: F.get(x["ends"], (F.array_position(x["few"], s) - 1).cast("int"))),
        )

    return text.let(followed(_ints(range(N_STATES)), F.slice(kinds, 1, HEAD)), rest)


def _last(a: Column) -> Column:
    return F.element_at(a, -1)


def _scan(start: Column, parts: Column, step) -> Column:
    """What holds before each of ``parts``, in their order, and after the last one."""
    return F.aggregate(parts, F.array(start), lambda acc, x: F.array_append(acc, step(_last(acc), x)))


def _borders(ranked: DataFrame, largest: int) -> DataFrame:
    """(lead_id, _c, _state, _pilot): control state and last pilot time before each chunk of the leads that have several."""
    order = F.sort_array(F.collect_list(F.struct("_n", "_kind", "_at_us"))).alias("_events")
    chunks = ranked.filter(F.col("_many") > CHUNK).groupBy("lead_id", F.expr(f"(_n - 1) div {CHUNK}").alias("_c")).agg(F.first("_start").alias("_start"), order)
    pilots = F.filter("_events", lambda e: e["_kind"] == EVENT_KINDS.index("pilot"))
    level = chunks.select("lead_id", "_c", "_start", _chunk_function(F.transform("_events", lambda e: e["_kind"])).alias("_f"), F.array_max(F.transform(pilots, lambda e: e["_at_us"])).alias("_p"))
    groups, width = [], CHUNK
    while True:
        parts = F.sort_array(F.collect_list(F.struct("_c", "_f", "_p"))).alias("_parts")
        groups.append(pin(level.groupBy("lead_id", F.expr(f"_c div {FAN}").alias("_up")).agg(F.first("_start").alias("_start"), parts)))
        width *= FAN
        if largest <= width:
            break
        whole = F.aggregate("_parts", _ints(range(N_STATES)), lambda acc, x: F.transform(acc, lambda s: F.get(x["_f"], s)))
        level = groups[-1].select("lead_id", F.col("_up").alias("_c"), "_start", whole.alias("_f"), F.array_max(F.transform("_parts", lambda x: x["_p"])).alias("_p"))
    known = groups[-1].select("lead_id", F.col("_up"), F.col("_start").alias("_state"), F.lit(None).cast("long").alias("_pilot"))
    for group in reversed(groups):
        met = group.join(known, ["lead_id", "_up"])
        states = _scan(F.col("_state"), F.col("_parts"), lambda s, x: F.get(x["_f"], s))
        pilots = _scan(F.col("_pilot"), F.col("_parts"), lambda p, x: F.coalesce(x["_p"], p))
        each = met.select("lead_id", F.inline(F.arrays_zip(F.transform("_parts", lambda x: x["_c"]).alias("_c"), states.alias("_state"), pilots.alias("_pilot"))))
        known = each.filter("_c IS NOT NULL").withColumnRenamed("_c", "_up")
    return known.withColumnRenamed("_up", "_c")


def label_events(events: DataFrame) -> DataFrame:
    """``events(lead_id, event_id, at, _kind int, _start int, ...)`` with ``_before`` and ``_pilot_us``: the control state before each event
    and the time of the lead's last pilot event before it."""
    ranked = ordering.global_rank(events.withColumn("_at_us", F.unix_micros("at")), ["lead_id"], [F.col("at"), F.col("event_id")], "_n", "_many")
    largest = ranked.agg(F.coalesce(F.max("_many"), F.lit(0))).first()[0]
    row = F.struct(*events.columns).alias("_row")
    items = F.sort_array(F.collect_list(F.struct("_n", "_kind", "_at_us", row))).alias("_items")
    chunks = ranked.groupBy("lead_id", F.expr(f"(_n - 1) div {CHUNK}").alias("_c")).agg(F.first("_start").alias("_start"), items)
    if largest > CHUNK:
        chunks = chunks.join(_borders(ranked, largest), ["lead_id", "_c"], "left")
    else:
        chunks = chunks.withColumns({"_state": F.lit(None).cast("int"), "_pilot": F.lit(None).cast("long")})
    states = _scan(F.coalesce("_state", "_start"), F.col("_items"), lambda s, e: _after(e["_kind"], s))
    pilots = _scan(F.col("_pilot"), F.col("_items"), lambda p, e: F.when(e["_kind"] == EVENT_KINDS.index("pilot"), e["_at_us"]).otherwise(p))
    each = chunks.select(F.inline(F.arrays_zip(F.transform("_items", lambda e: e["_row"]).alias("_row"), states.alias("_before"), pilots.alias("_pilot_us"))))
    return each.filter("_row IS NOT NULL").select("_row.*", "_before", "_pilot_us")


def _start_state() -> Column:
    """Control state of a lead row as an integer, matching ``transitions.encode``."""

    def index(values: tuple[str, ...], c: Column) -> Column:
        return F.coalesce(*[F.when(c == v, F.lit(i)) for i, v in enumerate(values)], F.lit(0))

    s = index(fixed.STAGES, F.col("stage")) * len(ACTIONS) + index(ACTIONS, text.or_blank(F.col("next_action")))
    touched = F.coalesce(F.col("touches") > 0, F.lit(False)).cast("int")
    landline = (text.or_blank(F.col("phone_type")) == "landline").cast("int")
    has_wa = (text.or_blank(F.col("wa")) != "").cast("int")
    return ((s * 2 + touched) * 2 + landline) * 2 + has_wa


def log_events(leads: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leads, activities, errors) after applying every event in the order of (at, event_id) per lead.

    ``events(event_id, lead_id, ev, at, outcome, reason, days, body, lang)``.  An activity carries the step before its event.  Events
    of unknown kind or for unknown leads go to ``errors`` with a ``problem``.
    """
    start = leads.select(
        F.col("id").alias("lead_id"), _start_state().alias("_start"), F.col("pilot_start").alias("_pilot0"), F.col("lang").alias("_lang")
    )
    joined = events.join(start, "lead_id", "left")
    known = F.col("ev").isin(*EVENTS)
    errors = joined.filter(~known | F.col("_start").isNull()).select(
        "event_id", "lead_id", "ev", F.when(~known, F.concat(F.lit("Unknown event "), "ev")).otherwise("Lead not found").alias("problem")
    )
    kind = event_kind(F.col("ev"), F.col("outcome"))
    code = F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(EVENT_KINDS)])
    labelled = label_events(joined.filter(known & F.col("_start").isNotNull()).withColumn("_kind", code))
    applied = transition(labelled.withColumn("pilot_start", F.coalesce(F.timestamp_micros("_pilot_us"), "_pilot0")))

    order = F.struct("at", "event_id")
    u = F.col("u")
    folded = applied.groupBy("lead_id").agg(
        F.max_by(u["stage"], order).alias("f_stage"),
        F.sum(u["touch"]).cast("int").alias("f_touch"),
        F.max_by(
            F.when(u["schedule"], F.struct(u["action"].alias("action"), u["followup"].alias("followup"))), F.when(u["schedule"], order)
        ).alias("f_next"),
        F.max(F.when(u["contacted"], F.col("at"))).alias("f_contacted"),
        F.max(F.when(u["pilot"], F.col("at"))).alias("f_pilot"),
        F.max_by(u["lost_reason"], F.when(u["lost_reason"].isNotNull(), order)).alias("f_reason"),
        F.bool_or(u["landline"]).alias("f_landline"),
        F.max(F.when(u["writes"], F.col("at"))).alias("f_updated"),
    )
    scheduled = F.col("f_next").isNotNull()
    after = leads.join(folded.withColumnRenamed("lead_id", "id"), "id", "left").withColumns(
        {
            "stage": F.coalesce("f_stage", "stage"),
            "touches": (F.coalesce("touches", F.lit(0)) + F.coalesce("f_touch", F.lit(0))).cast("int"),
            "next_action": F.when(scheduled, F.col("f_next.action")).otherwise(F.col("next_action")),
            "next_followup": F.when(scheduled, F.col("f_next.followup")).otherwise(F.col("next_followup")),
            "last_contacted": F.coalesce("f_contacted", "last_contacted"),
            "pilot_start": F.coalesce("f_pilot", "pilot_start"),
            "lost_reason": F.coalesce("f_reason", "lost_reason"),
            "phone_type": F.when(F.col("f_landline"), "landline").otherwise(F.col("phone_type")),
            "updated": F.coalesce("f_updated", "updated"),
        }
    )
    activities = applied.select(
        F.col("event_id").alias("id"),
        "lead_id",
        F.col("ev").alias("type"),
        text.or_blank(u["step"]).alias("step"),
        F.coalesce(text.blank_to_null(F.col("lang")), F.col("_lang")).alias("lang"),
        F.coalesce(*[text.blank_to_null(F.col(c)) for c in ("body", "outcome", "reason")], F.lit("")).alias("body"),
        "at",
    )
    return after.select(*leads.columns), activities, errors


# --- queues ---------------------------------------------------------------------------------------------------------------


def due(leads: DataFrame, now, most: int = 200) -> DataFrame:
    """Open leads whose follow-up time has come, oldest first: a distributed top-k."""
    ready = F.col("next_action").isNotNull() & (F.col("next_followup") <= F.lit(now)) & ~F.col("stage").isin(*fixed.CLOSED_STAGES)
    return leads.filter(ready).orderBy(F.col("next_followup").asc(), F.col("id").asc()).limit(most)


def sent_today(activities: DataFrame, now) -> DataFrame:
    """One row: first messages since the start of the day of ``now``."""
    first = (F.col("type") == "sent") & (F.col("step") == "first") & (F.col("at") >= F.date_trunc("day", F.lit(now)))
    return activities.filter(first).agg(F.count(F.lit(1)).alias("n"))


def cap_left(activities: DataFrame, now, cap: int = 15) -> DataFrame:
    return sent_today(activities, now).select(F.greatest(F.lit(0), F.lit(cap or 15) - F.col("n")).alias("cap_left"))


def _waiting() -> Column:
    return (F.col("stage") == "new") & F.col("next_action").isNull() & (F.col("phone_type") != "invalid")


def fresh(leads: DataFrame, activities: DataFrame, now, cap: int = 15, min_score: int = 0) -> DataFrame:
    """New leads to write to, best first, as many as today's cap leaves.

    The cap itself bounds the top-k; how much of it is left is a scalar subquery, so nothing is collected.
    """
    order = [F.col("score").desc(), F.col("reviews").desc_nulls_last(), F.col("id").asc()]
    top = leads.filter(_waiting() & (F.col("score") >= min_score)).orderBy(*order).limit(cap or 15)
    left = cap_left(activities, now, cap).scalar()
    # at most ``cap`` rows are numbered here
    numbered = top.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return numbered.filter(F.col("_n") <= left).drop("_n")


def waiting(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count_if(_waiting()).alias("waiting"))


def state_counts(leads: DataFrame, activities: DataFrame, usage: DataFrame, now, cap: int = 15, min_score: int = 0, most: int = 200) -> DataFrame:
    """One row: due, fresh (both as the queues would show them), leads, and place requests used today."""
    ready = F.col("next_action").isNotNull() & (F.col("next_followup") <= F.lit(now)) & ~F.col("stage").isin(*fixed.CLOSED_STAGES)
    left = cap_left(activities, now, cap).scalar()
    used = usage.filter((F.col("api") == "places") & (F.col("day") == F.to_date(F.lit(now)))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    counted = leads.agg(
        F.count_if(ready).alias("due"), F.count_if(_waiting() & (F.col("score") >= min_score)).alias("fresh"), F.count(F.lit(1)).alias("leads")
    )
    return counted.select(
        F.least(F.col("due"), F.lit(most)).alias("due"), F.least(F.col("fresh"), left).alias("fresh"), "leads", used.alias("used_today")
    )
