"""Structured Streaming forms.  Each gives the same answer as its batch twin once the same rows have arrived."""

from __future__ import annotations

import datetime as dt
import json
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from demandlens.operators import ordering, phrases
from demandlens.operators import transitions as rules
from demandlens.plans import attempts
from demandlens.plans.attempts import MAX_ERRORS, MAX_STRIKES
from demandlens.plans.places import utc_day
from demandlens.session import pin
from demandlens.sources import tables
from demandlens.sources.ledger import Ledger

DAY_US = 86_400_000_000
NO_TIME = -(1 << 62)


# --- phrase table, republished while a scan runs ----------------------------------------------------------------------------


STORED = "search_id long, phrase string, sources array<string>, occ long, best double, batch long, slot int"
#: Folders of each stored part, by a hash of the scan; parts that are read beside the compacted one.
SLOTS, PARTS = 64, 4


def phrase_updates(observations: DataFrame, scans: DataFrame, sources: tuple[str, ...] | None = phrases.SOURCE_IDS) -> DataFrame:
    """Running phrase aggregates of a stream of observations; ``scans`` is a static table.

    The fold commutes, so arrival order does not matter.  Use output mode ``update``, which
    allows one aggregate, so the sources are collected at once.
    """
    kept = phrases.relevant(phrases.of_sources(observations, sources), phrases.scan_dimension(scans))
    found = F.array_sort(F.collect_set("source")).alias("sources")
    best = F.greatest(phrases.best_weight(), F.lit(0.0)).alias("best")
    return kept.groupBy("search_id", "phrase").agg(found, F.count(F.lit(1)).alias("occ"), best)


def publish_keywords(scans: DataFrame, root: str):
    """A ``foreachBatch`` function that rewrites the keywords of the scans a micro-batch has touched.

    Each batch commits the changed aggregates once, as a part of a log; parts beyond PARTS are compacted to the newest row of each
    phrase.  The current aggregates of the touched scans are their newest rows in the compacted part and the few after it,
    whatever the number of batches so far; folders of other scans' slots are pruned and not read.
    """

    def publish(changed: DataFrame, batch_id: int) -> None:
        ledger = Ledger(changed.sparkSession, f"{root}/aggregates")
        slot = F.pmod(F.xxhash64("search_id"), F.lit(SLOTS)).cast("int")
        ledger.commit(batch_id, append={"phrases": changed.withColumns({"batch": F.lit(batch_id).cast("long"), "slot": slot})}, by=("slot",))
        ledger.compact("phrases", STORED, PARTS, ("slot",), newest_phrases)
        stored = ledger.read("phrases", STORED)
        touched = pin(stored.filter(F.col("batch") == batch_id).select("search_id", "slot").distinct())
        current = newest_phrases(stored.join(touched, ["slot", "search_id"], "left_semi"))
        dim = phrases.scan_dimension(scans)
        tables.write_keywords(phrases.classify_scored(phrases.score_phrases(current.drop("batch", "slot"), dim), dim), root)

    return publish


def newest_phrases(stored: DataFrame) -> DataFrame:
    """The newest row of each scan and phrase."""
    return stored.groupBy("search_id", "phrase", "slot").agg(F.max_by(F.struct("sources", "occ", "best"), "batch").alias("a"), F.max("batch").alias("batch")).select("search_id", "phrase", "a.*", "batch", "slot")


# --- lead state -------------------------------------------------------------------------------------------------------------

LEAD_STATE = (
    "stage string, next_action string, followup_us long, touches int, phone_type string, wa string, pilot_us long, contacted_us long, "
    "lost_reason string, lang string"
)
#: Groups that leads share in the stream, by a hash.
LEAD_SLOTS = 4096
LEAD_INPUT = "lead_id long, event_id long, ev string, at timestamp, outcome string, reason string, days int, body string, lang string"
EVENT_FIELDS = tuple(c for c in (f.split()[0] for f in LEAD_INPUT.split(", ")) if c != "at")
# times cross the Python border as UTC microseconds
LEAD_OUTPUT = (
    "lead_id long, kind string, event_id long, type string, step string, lang string, body string, at_us long, stage string, "
    "next_action string, next_followup_us long, touches int, phone_type string, pilot_start_us long, last_contacted_us long, "
    "lost_reason string"
)
def _at_eleven(us: int, days: int, zone: ZoneInfo) -> int:
    day = dt.datetime.fromtimestamp((us + days * DAY_US) // 1_000_000, zone).date()
    return int(dt.datetime(day.year, day.month, day.day, 11, tzinfo=zone).timestamp()) * 1_000_000


def apply_event(s: dict, ev: str, at_us: int, outcome, reason, days, zone: ZoneInfo) -> str:
    """Change lead state ``s`` in place by one event; returns the step before it.  The rules are those of the batch fold."""
    kind = f"{ev}:{outcome}" if f"{ev}:{outcome}" in rules.EVENT_KINDS else ev
    before = rules.encode(s["stage"], s["next_action"] or "", (s["touches"] or 0) > 0, s["phone_type"] == "landline", bool(s["wa"]))
    stage, action, _, landline, _ = rules.decode(rules.after(before, kind))
    r = (rules.NO_RULE, *rules.RULES)[rules.rule_of(before, kind)]
    if r.action is not None:
        trial_end = (s["pilot_us"] if s["pilot_us"] is not None else at_us) + 30 * DAY_US
        named = {rules.TRIAL: max(1, -(-(trial_end - at_us) // DAY_US)), rules.ASKED: max(1, days or 1)}
        s["followup_us"] = None if r.wait is None else at_us if r.wait == rules.NOW else _at_eleven(at_us, named.get(r.wait, r.wait), zone)
    if r.reason is not None:
        s["lost_reason"] = reason or r.reason if kind == "lost" else r.reason
    if ev in ("sent", "called"):
        s["contacted_us"] = at_us
    if ev == "pilot":
        s["pilot_us"] = at_us
    s.update(stage=stage, next_action=action or None, touches=(s["touches"] or 0) + r.touch, phone_type="landline" if landline else s["phone_type"])
    return rules.step_of(before)


class LeadProcessor(StatefulProcessor):
    """The leads of one slot, as one value, and one timer for the first of the follow-up times they wait for.

    Emits an ``activity`` row per event with the state after it, a ``due`` row when the watermark passes a follow-up time that still
    stands, and an ``error`` row for events that cannot be applied.  Events of a lead within a micro-batch are taken in the
    order of (at, event_id).
    """

    FIELDS = tuple(f.split()[0] for f in LEAD_STATE.split(", "))

    def __init__(self, zone: str) -> None:
        self.zone = ZoneInfo(zone)

    def init(self, handle) -> None:
        self.handle = handle
        # the leads are a JSON list of [lead_id, the time it waits for in ms, its LEAD_STATE]
        self.slot = handle.getValueState("slot", "timer_ms long, leads string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        leads = {row["lead_id"]: {f: row[f] for f in self.FIELDS} for row in initialState["leads"]}
        for s in leads.values():
            self._wait(s)
        self._store(leads, None)

    def _load(self) -> tuple[dict, int | None]:
        if not self.slot.exists():
            return {}, None
        timer, leads = self.slot.get()
        return {lead: {"wait_ms": wait, **dict(zip(self.FIELDS, s))} for lead, wait, *s in json.loads(leads)}, timer

    def _store(self, leads: dict, timer: int | None) -> None:
        """Keep the states of the slot, whose timer stood at ``timer``."""
        first = min((s["wait_ms"] for s in leads.values() if s["wait_ms"] is not None), default=None)
        rows = [[lead, s["wait_ms"], *[s[f] for f in self.FIELDS]] for lead, s in leads.items()]
        self.slot.update((first, json.dumps(rows, ensure_ascii=False, separators=(",", ":"))))
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def _wait(self, s: dict) -> None:
        s["wait_ms"] = s["followup_us"] // 1000 if s["next_action"] and s["followup_us"] is not None else None

    def _row(self, lead, s: dict, kind: str, event_id=None, type_=None, step=None, lang=None, body=None, at_us=None) -> Row:
        return Row(
            lead_id=lead, kind=kind, event_id=event_id, type=type_, step=step, lang=lang, body=body, at_us=at_us, stage=s["stage"],
            next_action=s["next_action"], next_followup_us=s["followup_us"], touches=s["touches"], phone_type=s["phone_type"],
            pilot_start_us=s["pilot_us"], last_contacted_us=s["contacted_us"], lost_reason=s["lost_reason"],
        )

    def handleInputRows(self, key, rows, timerValues):
        events: dict = {}
        for row in rows:
            events.setdefault(row["event"]["lead_id"], []).append(row["event"])
        leads, timer = self._load()
        changed = False
        for lead, some in events.items():
            known = lead in leads
            s = leads[lead] if known else dict.fromkeys(self.FIELDS)
            moved = False
            for r in sorted(some, key=lambda r: (r["at_us"], r["event_id"])):
                if not known or r["ev"] not in rules.EVENTS:
                    problem = "Lead not found" if r["ev"] in rules.EVENTS else f"Unknown event {r['ev']}"
                    yield self._row(lead, s, "error", r["event_id"], r["ev"], None, None, problem, r["at_us"])
                    continue
                step = apply_event(s, r["ev"], r["at_us"], r["outcome"], r["reason"], r["days"], self.zone)
                moved = True
                body = r["body"] or r["outcome"] or r["reason"] or ""
                yield self._row(lead, s, "activity", r["event_id"], r["ev"], step, r["lang"] or s["lang"], body, r["at_us"])
            if moved:
                self._wait(s)
                changed = True
        if changed:
            self._store(leads, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        leads, timer = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        for lead, s in leads.items():
            if s["wait_ms"] is not None and s["wait_ms"] < now:
                s["wait_ms"] = None
                if s["stage"] not in ("won", "lost", "invalid"):
                    yield self._row(lead, s, "due", at_us=s["followup_us"])
        self._store(leads, timer)

    def close(self) -> None:
        pass


def initial_lead_state(leads: DataFrame) -> DataFrame:
    return leads.select(
        F.col("id").alias("lead_id"), "stage", "next_action", F.unix_micros("next_followup").alias("followup_us"), "touches", "phone_type", "wa",
        F.unix_micros("pilot_start").alias("pilot_us"), F.unix_micros("last_contacted").alias("contacted_us"), "lost_reason", "lang",
    )


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("lead_id"), F.lit(slots)).alias("slot")


def lead_stream(events: DataFrame, leads: DataFrame, delay: str = "1 day", slots: int = LEAD_SLOTS) -> DataFrame:
    """A stream of events -> activities, due rows and errors.  Needs the RocksDB state store.  Days are those of the session zone.

    Events more than ``delay`` behind the newest are dropped (the batch form has no such rule).  Leads share ``slots`` groups by a hash,
    since each group of a micro-batch takes Python several calls to the state store, and a call far more time than a lead's own work.  A
    micro-batch reads and writes the groups it touches as a whole; a running stream must keep their number.
    """
    start = initial_lead_state(leads)
    event = F.struct(*EVENT_FIELDS, F.unix_micros("at").alias("at_us")).alias("event")
    out = (
        events.withWatermark("at", delay)
        .select(_slot(slots), "at", event)
        .groupBy("slot")
        .transformWithState(
            statefulProcessor=LeadProcessor(events.sparkSession.conf.get("spark.sql.session.timeZone")),
            outputStructType=LEAD_OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
            initialState=start.groupBy(_slot(slots)).agg(F.collect_list(F.struct(*start.columns)).alias("leads")).groupBy("slot"),
        )
    )
    times = {f"{c}_us": c for c in ("at", "next_followup", "pilot_start", "last_contacted")}
    return out.select(*[F.timestamp_micros(c).alias(times[c]) if c in times else c for c in out.columns])


# --- breaker ----------------------------------------------------------------------------------------------------------------


class BreakerProcessor(StatefulProcessor):
    """Strikes and errors of one source of one scan since its last ok."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("breaker", "strikes long, errs long, off_at long")

    def handleInputRows(self, key, rows, timerValues):
        strikes, errs, off_at = self.state.get() if self.state.exists() else (0, 0, None)
        for r in sorted(rows, key=lambda r: r["seq"]):
            skipped = off_at is not None
            if not skipped:
                if r["outcome"] == "ok":
                    strikes = errs = 0
                elif r["outcome"] == "rate":
                    strikes += 1
                elif r["outcome"] == "err":
                    errs += 1
                tripped = (r["outcome"] == "rate" and strikes >= MAX_STRIKES) or (r["outcome"] == "err" and errs >= MAX_ERRORS)
                off_at = r["seq"] if tripped else None
            yield Row(search_id=key[0], source=key[1], seq=r["seq"], outcome=r["outcome"], skipped=skipped, off_at=off_at)
        self.state.update((strikes, errs, off_at))

    def close(self) -> None:
        pass


def breaker_stream(tried: DataFrame) -> DataFrame:
    """Streaming twin of ``attempts.breaker`` for attempts that arrive in the order of ``seq``, source by source; see ``judge_attempts`` for others."""
    return tried.groupBy("search_id", "source").transformWithState(
        statefulProcessor=BreakerProcessor(),
        outputStructType="search_id long, source string, seq long, outcome string, skipped boolean, off_at long",
        outputMode="Append",
        timeMode="None",
    )


WAITING = "search_id long, source string, seq long, outcome string, at timestamp"
SWITCHES = "search_id long, source string, strikes0 long, errs0 long, off0 long, reason0 string"
JUDGED = "search_id long, source string, seq long, outcome string, strikes long, errs long, off_at long, skipped boolean"


def judge_attempts(root: str, delay: dt.timedelta):
    """A ``foreachBatch`` function: the breaker over attempts (search_id, source, seq, outcome, at) that come in any order within ``delay``.

    Attempts wait in a buffer until others that are ``delay`` newer have come; then they are judged in the order of ``seq`` by the
    batch breaker, which goes on from each source's counts.  Its work is cut into range partitions, so one source may hold any share
    of a batch; what is kept of a source is one row.  Attempts that come in after that are too late and are left out.  A micro-batch that is repeated changes nothing.
    Read the answers with ``judged``.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        _judge(Ledger(batch.sparkSession, root), batch.select(*[c.split()[0] for c in WAITING.split(", ")]), batch_id, delay)

    return judge


def finish_attempts(spark: SparkSession, root: str) -> None:
    """Judge what still waits; for a stream that has ended."""
    _judge(Ledger(spark, root), spark.createDataFrame([], WAITING), "end", None)


def judged(spark: SparkSession, root: str) -> DataFrame:
    return Ledger(spark, root).read("judged", JUDGED)


def _judge(ledger: Ledger, new: DataFrame, batch_id: int | str, delay: dt.timedelta | None) -> None:
    notes = ledger.manifest()["notes"]
    if ledger.committed(batch_id):
        return
    keys, at = ["search_id", "source"], F.unix_micros("at")
    new = pin(new if "limit" not in notes else new.filter(at > notes["limit"]))
    newest = max(x for x in (new.agg(F.max(at)).first()[0], notes.get("newest"), NO_TIME) if x is not None)
    limit = newest - delay // dt.timedelta(microseconds=1) if delay is not None else newest
    rows = new.unionByName(ledger.read("waiting", WAITING))
    start = ledger.read("switches", SWITCHES)
    told = pin(attempts.breaker(rows.filter(at <= limit), tuple(keys), start=start).select(*[c.split()[0] for c in JUDGED.split(", ")], "off_reason"))
    last = told.groupBy(*keys).agg(F.max_by(F.struct("strikes", "errs", "off_at", "off_reason"), "seq").alias("s"))
    moved = last.select(*keys, F.col("s.strikes").alias("strikes0"), F.col("s.errs").alias("errs0"), F.col("s.off_at").alias("off0"), F.col("s.off_reason").alias("reason0"))
    switches = ordering.same_keys(start, moved, keys, "left_anti").unionByName(moved)
    ledger.commit(
        batch_id, append={"judged": told.drop("off_reason")}, replace={"waiting": rows.filter(at > limit), "switches": switches},
        notes={"newest": newest, "limit": max(limit, notes.get("limit", NO_TIME))},
    )


# --- counters -----------------------------------------------------------------------------------------------------------------


def daily_usage(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests per UTC day and api from a stream of (at, api, n); later rows than ``delay`` are dropped."""
    return (
        log.withWatermark("at", delay)
        .groupBy(F.window("at", "1 day"), "api")
        .agg(F.sum("n").cast("long").alias("n"))
        .select(utc_day(F.col("window.start")).alias("day"), "api", "n")
    )
