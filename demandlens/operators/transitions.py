"""What events do to a lead, as one table of rules that the batch fold and the stream both read.

What an event does depends on few things about a lead: its stage, its next action, whether it was ever touched, and whether it is a landline
(with or without a WhatsApp number).  These make up the *control state*, a small finite set.  Everything else an event writes (times, counts,
reasons) follows from the rule that the control state before the event picks.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

from demandlens import fixed

STEP_NAMES = tuple(s for s, _, _, _ in fixed.STEPS)
ACTIONS = ("", *STEP_NAMES)  # '' is no next action
# calls are told apart by outcome
EVENT_KINDS = (
    "sent", "called", "called:interested", "called:not_interested", "replied", "pilot", "won", "lost", "no_whatsapp", "wrong_number",
    "snooze", "note",
)
EVENTS = tuple(k for k in EVENT_KINDS if ":" not in k)
N_STATES = len(fixed.STAGES) * len(ACTIONS) * 8

#: Action of a rule: the step the event was at.  Times of a rule: now, a month into the trial, the days the event names.
SAME, NOW, TRIAL, ASKED = "=", "now", "trial", "asked"
#: Reason of a rule: the one the event names, or this.
GIVEN = "not interested"


class Rule(NamedTuple):
    """For an event ``kind``, met where step, stage and touch fit (None: always); what it writes (None: nothing; action '': none any more)."""

    kind: str
    step: str | None = None
    stages: tuple[str, ...] | None = None
    touched: bool | None = None
    stage: str | None = None
    action: str | None = None
    wait: int | str | None = None  # days until eleven o'clock, or NOW, TRIAL, ASKED
    touch: bool = False
    reason: str | None = None


_TALKS = ("replied", "pilot")
# --- fixed values: the follow-up rules ------------------------------------------------------------------------------------
RULES = (
    Rule("sent", step="first", stage="contacted", action="followup1", wait=1, touch=True),
    Rule("sent", step="followup1", action="call", wait=3, touch=True),
    Rule("sent", step="send_details", action="nudge_details", wait=2),
    Rule("sent", step="nudge_details", action="call", wait=2),
    Rule("sent", step="checkin3", action="checkin7", wait=4),
    Rule("sent", step="checkin7", action="review30", wait=TRIAL),
    Rule("sent", step="review30", action=""),
    Rule("called", stages=_TALKS, step="", action="nudge_details", wait=2),
    Rule("called", stages=_TALKS, action=SAME, wait=2),
    Rule("called", touched=False, stage="contacted", action="call", wait=1, touch=True),
    Rule("called", touched=True, stage="lost", action="", reason="no reply after call"),
    Rule("called:interested", stage="replied", action="send_details", wait=NOW),
    Rule("called:not_interested", stage="lost", action="", reason="not interested"),
    Rule("replied", stages=("new", "contacted"), stage="replied", action="send_details", wait=NOW),
    Rule("pilot", stage="pilot", action="checkin3", wait=3),
    Rule("won", stage="won", action=""),
    Rule("lost", stage="lost", action="", reason=GIVEN),
    Rule("no_whatsapp", action="call", wait=NOW),
    Rule("wrong_number", stage="invalid", action="", reason="wrong number"),
    Rule("snooze", action=SAME, wait=ASKED),
)
NO_RULE = Rule("")


@cache
def encode(stage: str, action: str, touched: bool, landline: bool, has_wa: bool) -> int:
    s = fixed.STAGES.index(stage) * len(ACTIONS) + ACTIONS.index(action or "")
    return ((s * 2 + touched) * 2 + landline) * 2 + has_wa


@cache
def decode(state: int) -> tuple[str, str, bool, bool, bool]:
    pair, flags = divmod(state, 8)
    stage, action = divmod(pair, len(ACTIONS))
    return fixed.STAGES[stage], ACTIONS[action], bool(flags & 4), bool(flags & 2), bool(flags & 1)


@cache
def step_of(state: int) -> str:
    """The next action; for a new lead without one the first message, or a call if it cannot get one."""
    stage, action, _, landline, has_wa = decode(state)
    opening = ("first" if has_wa and not landline else "call") if stage == "new" else ""
    return action or opening


@cache
def rule_of(state: int, kind: str) -> int:
    """Number of the rule that an event meets: its place in RULES from 1, 0 for none."""
    stage, _, touched, _, _ = decode(state)
    for i, r in enumerate(RULES, 1):
        if r.kind == kind and r.step in (None, step_of(state)) and (r.stages is None or stage in r.stages) and r.touched in (None, touched):
            return i
    return 0


@cache
def after(state: int, kind: str) -> int:
    """The control state after an event."""
    stage, action, touched, landline, has_wa = decode(state)
    r = (NO_RULE, *RULES)[rule_of(state, kind)]
    if r.action is not None:
        action = step_of(state) if r.action == SAME else r.action
    return encode(r.stage or stage, action, touched or r.touch, landline or kind == "no_whatsapp", has_wa)
