"""The cadence: documented transitions, the control table against the expression, and the fold against a sequential one."""

import datetime as dt
import random

import pytest
from lead_tables import lead_rows

from demandlens import fixed
from demandlens.operators import cadence as c
from demandlens.operators import transitions as t

T = dt.datetime(2024, 1, 10, 15, 0)
EVENT_SCHEMA = "event_id long, lead_id long, ev string, at timestamp, outcome string, reason string, days int, body string, lang string"


def events(spark, rows):
    names = "event_id lead_id ev at outcome reason days body lang".split()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVENT_SCHEMA)


def day(n, hour=11):
    return dt.datetime(2024, 1, n, hour, 0)


CASES = [
    ({"wa": "91", "phone_type": "mobile"}, {"ev": "sent"}, {"stage": "contacted", "touches": 1, "next_action": "followup1", "next_followup": day(11)}, "first"),
    ({"stage": "contacted", "next_action": "followup1", "touches": 1}, {"ev": "sent"}, {"touches": 2, "next_action": "call", "next_followup": day(13)}, "followup1"),
    ({"stage": "contacted", "next_action": "call", "touches": 2}, {"ev": "called", "outcome": "no_answer"}, {"stage": "lost", "lost_reason": "no reply after call", "next_action": None, "next_followup": None}, "call"),
    ({"wa": "91", "phone_type": "landline"}, {"ev": "called", "outcome": "no_answer"}, {"stage": "contacted", "touches": 1, "next_action": "call", "next_followup": day(11)}, "call"),
    ({"stage": "contacted"}, {"ev": "replied"}, {"stage": "replied", "next_action": "send_details", "next_followup": T}, ""),
    ({"stage": "replied"}, {"ev": "pilot"}, {"stage": "pilot", "pilot_start": T, "next_action": "checkin3", "next_followup": day(13)}, ""),
    ({"stage": "pilot", "next_action": "checkin7", "pilot_start": day(3, 15)}, {"ev": "sent"}, {"next_action": "review30", "next_followup": dt.datetime(2024, 2, 2, 11)}, "checkin7"),
    ({"wa": "91", "phone_type": "mobile"}, {"ev": "snooze", "days": 2}, {"stage": "new", "next_action": "first", "next_followup": day(12)}, "first"),
    ({"stage": "won"}, {"ev": "replied"}, {"stage": "won", "next_action": None, "updated": None}, ""),
    ({"wa": "91", "phone_type": "mobile"}, {"ev": "no_whatsapp"}, {"phone_type": "landline", "next_action": "call", "next_followup": T}, "first"),
    ({"stage": "replied"}, {"ev": "lost", "reason": "too dear"}, {"stage": "lost", "lost_reason": "too dear"}, ""),
    ({"stage": "replied"}, {"ev": "called", "outcome": "no_answer"}, {"stage": "replied", "next_action": "nudge_details", "next_followup": day(12)}, ""),
]


def test_documented_transitions(spark):
    leads = lead_rows(spark, [{"id": i, **before} for i, (before, _, _, _) in enumerate(CASES)])
    evs = events(spark, [{"event_id": i, "lead_id": i, "at": T, **e} for i, (_, e, _, _) in enumerate(CASES)])
    after, acts, errors = c.log_events(leads, evs)
    rows = {r.id: r.asDict() for r in after.collect()}
    for i, (_, _, want, _) in enumerate(CASES):
        assert {k: rows[i][k] for k in want} == want, i
    assert [r.step for r in acts.orderBy("lead_id").collect()] == [s for *_, s in CASES]
    assert errors.count() == 0


def test_errors(spark):
    leads = lead_rows(spark, [{"id": 1}])
    evs = events(spark, [{"event_id": 1, "lead_id": 1, "ev": "dance", "at": T}, {"event_id": 2, "lead_id": 5, "ev": "won", "at": T}])
    after, acts, errors = c.log_events(leads, evs)
    assert {r.problem for r in errors.collect()} == {"Unknown event dance", "Lead not found"}
    assert acts.count() == 0 and after.first().stage == "new"


AFTER_SENT = {"first": "followup1", "followup1": "call", "send_details": "nudge_details", "nudge_details": "call", "checkin3": "checkin7", "checkin7": "review30", "review30": ""}


def brute_step(stage, action, landline, has_wa):
    return action or (("first" if has_wa and not landline else "call") if stage == "new" else "")


def brute_after(stage, action, touched, landline, has_wa, kind):
    """The documented transitions, one by one."""
    step = brute_step(stage, action, landline, has_wa)
    if kind == "sent":
        return "contacted" if step == "first" else stage, AFTER_SENT.get(step, action), touched or step in ("first", "followup1"), landline
    if kind == "called":
        if stage in ("replied", "pilot"):
            return stage, step or "nudge_details", touched, landline
        return ("lost", "", True, landline) if touched else ("contacted", "call", True, landline)
    if kind == "called:interested" or (kind == "replied" and stage in ("new", "contacted")):
        return "replied", "send_details", touched, landline
    fixed_ends = {"called:not_interested": ("lost", ""), "lost": ("lost", ""), "won": ("won", ""), "wrong_number": ("invalid", ""), "pilot": ("pilot", "checkin3")}
    if kind in fixed_ends:
        return *fixed_ends[kind], touched, landline
    if kind == "no_whatsapp":
        return stage, "call", touched, True
    return stage, (action or step) if kind == "snooze" else action, touched, landline


def test_rules_and_expression(spark):
    """All states times all events: the table of rules and the column expression against the documented transitions."""
    rows = []
    for s in range(t.N_STATES):
        assert t.encode(*t.decode(s)) == s
        rows += [(s, k) for k in range(len(t.EVENT_KINDS))]
    df = spark.createDataFrame(rows, "_before int, k int").selectExpr("*", "k AS _kind", "timestamp'2024-01-10 15:00:00' at", "cast(null as timestamp) pilot_start", "cast(null as string) reason", "cast(null as int) days")
    for r in c.transition(df).collect():
        before, kind = t.decode(r._before), t.EVENT_KINDS[r.k]
        want = brute_after(*before, kind)
        assert t.decode(t.after(r._before, kind))[:4] == want
        action = (r.u.action if r.u.schedule else before[1]) or ""
        assert (r.u.stage, action, before[2] or r.u.touch > 0, before[3] or r.u.landline) == want and (r.u.step or "") == brute_step(before[0], before[1], before[3], before[4]), (before, kind)


def test_start_state(spark):
    leads = []
    for s in range(t.N_STATES):
        stage, action, touched, landline, has_wa = t.decode(s)
        leads.append({"id": s, "stage": stage, "next_action": action or None, "touches": int(touched), "phone_type": "landline" if landline else "mobile", "wa": "9" if has_wa else ""})
    assert all(r.s == r.id for r in lead_rows(spark, leads).select("id", c._start_state().alias("s")).collect())


@pytest.mark.parametrize("seed,chunk,fan", [(1, 64, 64), (2, 16, 64), (3, 5, 3)])
def test_fold_across_chunks(spark, monkeypatch, seed, chunk, fan):
    """One lead holds most events and spans chunks of one, two or many levels; labels equal a plain loop."""
    monkeypatch.setattr(c, "CHUNK", chunk)
    monkeypatch.setattr(c, "FAN", fan)
    rng = random.Random(seed)
    leads = [{"id": i, "stage": rng.choice(fixed.STAGES), "wa": rng.choice(["", "9"]), "phone_type": rng.choice(["mobile", "landline"])} for i in range(5)]
    rows = []
    for n in range(400):
        ev, outcome = (rng.choice([k for k in t.EVENT_KINDS if k not in ("won", "wrong_number")]).split(":") + [None])[:2]
        lead = 2 if rng.random() < 0.7 else rng.randrange(5)
        rows.append({"event_id": n, "lead_id": lead, "ev": ev, "outcome": outcome, "at": T + dt.timedelta(minutes=rng.randrange(300))})
    after, acts, _ = c.log_events(lead_rows(spark, leads), events(spark, rows))
    want_step, want_end = {}, {}
    for lead in leads:
        s, has_wa, pilot = (lead["stage"], "", False, lead["phone_type"] == "landline"), lead["wa"] != "", None
        for r in sorted((r for r in rows if r["lead_id"] == lead["id"]), key=lambda r: (r["at"], r["event_id"])):
            want_step[r["event_id"]] = brute_step(s[0], s[1], s[3], has_wa)
            s = brute_after(*s, has_wa, f"{r['ev']}:{r['outcome']}" if r["outcome"] else r["ev"])
            pilot = r["at"] if r["ev"] == "pilot" else pilot
        want_end[lead["id"]] = (*s, pilot)
    assert {r.id: r.step for r in acts.collect()} == want_step
    for r in after.collect():
        assert (r.stage, r.next_action or "", r.touches > 0, r.phone_type == "landline", r.pilot_start) == want_end[r.id]
