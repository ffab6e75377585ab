"""Streams give the same answer as their batch twins."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from lead_tables import lead_rows
from pyspark.sql import functions as F
from test_cadence import EVENT_SCHEMA, events

from demandlens import fixed
from demandlens.operators import cadence, phrases, transitions
from demandlens.plans import attempts, places
from demandlens.sources import tables
from demandlens.sources.ledger import Ledger
from demandlens.streaming import live

T = dt.datetime(2024, 1, 10)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def as_stream(spark, df, path, pieces):
    """Write each piece as one file and read them back one per micro-batch."""
    for i, condition in enumerate(pieces):
        df.filter(condition).coalesce(1).write.mode("append").parquet(f"{path}/in")
        import time

        time.sleep(0.05)  # file order follows modification time
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def drain(stream, path, mode="append"):
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/cp").format("parquet").option("path", f"{path}/out")
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def test_lead_state(spark, tmp_path):
    rng = random.Random(3)
    leads = lead_rows(spark, [{"id": i, "stage": rng.choice(fixed.STAGES), "wa": rng.choice(["", "9"]), "phone_type": rng.choice(["mobile", "landline"])} for i in range(8)])
    rows = []
    for n in range(240):
        ev, outcome = (rng.choice([k for k in transitions.EVENT_KINDS if k not in ("won", "wrong_number")] + ["dance"]).split(":") + [None])[:2]
        rows.append({"event_id": n, "lead_id": rng.randrange(9), "ev": ev, "outcome": outcome, "at": T + dt.timedelta(hours=2 * n, minutes=rng.randrange(50)), "days": rng.choice([None, 0, 3])})
    evs = events(spark, rows)
    want, want_acts, want_err = cadence.log_events(leads, evs)
    stream = as_stream(spark, evs, str(tmp_path), ["event_id < 80", "event_id between 80 and 159", "event_id >= 160"])
    out = drain(live.lead_stream(stream, leads), str(tmp_path)).collect()
    acts = {r.id: (r.step, r.lang, r.body) for r in want_acts.collect()}
    assert {r.event_id: (r.step, r.lang, r.body) for r in out if r.kind == "activity"} == acts
    assert {(r.event_id, r.body) for r in out if r.kind == "error"} == {(r.event_id, r.problem) for r in want_err.collect()}
    last = {}
    for r in sorted((r for r in out if r.kind == "activity"), key=lambda r: (r.at, r.event_id)):
        last[r.lead_id] = r
    for w in want.collect():
        if w.id in last:
            g = last[w.id]
            for c in ("stage", "next_action", "next_followup", "touches", "phone_type", "pilot_start", "last_contacted", "lost_reason"):
                assert getattr(g, c) == getattr(w, c), (w.id, c)
    assert all(r.next_action and r.next_followup == r.at for r in out if r.kind == "due")


def test_snooze_moves_the_timer(spark, tmp_path):
    leads = lead_rows(spark, [{"id": 1, "wa": "9", "phone_type": "mobile"}, {"id": 2}])
    rows = [
        {"event_id": 1, "lead_id": 1, "ev": "sent", "at": T},
        {"event_id": 2, "lead_id": 1, "ev": "snooze", "days": 5, "at": T + dt.timedelta(hours=1)},
        {"event_id": 3, "lead_id": 2, "ev": "note", "at": T + dt.timedelta(days=4)},
        {"event_id": 4, "lead_id": 2, "ev": "note", "at": T + dt.timedelta(days=9)},
        {"event_id": 5, "lead_id": 2, "ev": "note", "at": T + dt.timedelta(days=10)},
    ]
    stream = as_stream(spark, events(spark, rows), str(tmp_path), [f"event_id = {i}" for i in range(1, 6)])
    out = drain(live.lead_stream(stream, leads), str(tmp_path)).filter("kind = 'due'").collect()
    assert [(r.lead_id, r.at) for r in out] == [(1, dt.datetime(2024, 1, 15, 11))]


class Store:
    """Stands in for the state store of one group and counts what is asked of it."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.remove(t)


def test_calls_to_the_state_store_follow_slots(spark):
    """Five hundred leads of a slot take as many calls as one, and the slot has one timer, for the first that waits."""
    calls = set()
    for n in (1, 500):
        store, processor = Store(), live.LeadProcessor("UTC")
        processor.init(store)
        state = dict.fromkeys(processor.FIELDS) | {"stage": "contacted", "next_action": "call", "wa": "9", "touches": 1}
        processor.handleInitialState((0,), {"leads": [state | {"lead_id": i, "followup_us": (n - i) * 10**6} for i in range(n)]}, None)
        assert store.timers == {1000}
        event = dict.fromkeys(live.EVENT_FIELDS) | {"ev": "snooze", "days": 2, "at_us": 5 * 10**6}
        out = list(processor.handleInputRows((0,), [{"event": event | {"lead_id": i, "event_id": i}} for i in range(n + 1)], None))
        assert [r.kind for r in out] == ["activity"] * n + ["error"] and len(store.timers) == 1
        calls.add(store.calls)
    assert len(calls) == 1


@pytest.mark.parametrize("slots", [1, 2])
def test_leads_of_a_slot_stay_apart(spark, tmp_path, slots):
    day = lambda n, hour=0: dt.datetime(2024, 1, n, hour)
    waits = {"stage": "contacted", "next_action": "call", "touches": 1}
    leads = lead_rows(spark, [
        {"id": 1, "wa": "9", "phone_type": "mobile"}, {"id": 2, **waits, "next_followup": day(12, 11)}, {"id": 3, **waits, "next_followup": day(12, 11)},
        {"id": 4, **waits, "next_followup": day(14, 11)}, {"id": None, **waits, "next_followup": day(13, 11)}, {"id": 6},
    ])
    rows = [
        {"event_id": 1, "lead_id": 1, "ev": "sent", "at": T}, {"event_id": 2, "lead_id": 3, "ev": "won", "at": T}, {"event_id": 3, "lead_id": 9, "ev": "won", "at": T},
        {"event_id": 4, "lead_id": 6, "ev": "note", "at": day(13)}, {"event_id": 5, "lead_id": 4, "ev": "snooze", "days": 6, "at": day(13, 1)},
        {"event_id": 6, "lead_id": 6, "ev": "note", "at": day(16)}, {"event_id": 11, "lead_id": 6, "ev": "note", "at": day(16, 1)},
        {"event_id": 7, "lead_id": 2, "ev": "note", "at": day(17)},  # it is late still, and said once more
        {"event_id": 8, "lead_id": None, "ev": "called", "at": day(17, 1)}, {"event_id": 9, "lead_id": None, "ev": "sent", "at": day(17, 1)},
        {"event_id": 10, "lead_id": 6, "ev": "note", "at": day(24)},
    ]
    stream = as_stream(spark, events(spark, rows), str(tmp_path), ["event_id < 4", "event_id in (4, 5)", "event_id = 6", "event_id = 11", "event_id in (7, 8, 9)", "event_id = 10"])
    out = drain(live.lead_stream(stream, leads, slots=slots), str(tmp_path)).collect()
    due = sorted(((r.lead_id or 0, r.at) for r in out if r.kind == "due"))
    assert due == [(0, day(13, 11)), (1, day(11, 11)), (2, day(12, 11)), (2, day(12, 11)), (4, day(19, 11))]
    assert {(r.event_id, r.lead_id, r.stage) for r in out if r.kind == "activity"} == {
        (1, 1, "contacted"), (2, 3, "won"), (4, 6, "new"), (5, 4, "contacted"), (6, 6, "new"), (7, 2, "contacted"), (8, None, "lost"), (9, None, "lost"), (10, 6, "new"), (11, 6, "new"),
    }
    assert [(r.event_id, r.lead_id) for r in out if r.kind == "error"] == [(3, 9)]


def test_breaker(spark, tmp_path):
    rng = random.Random(5)
    rows = [(1, rng.choice("abc"), n, rng.choice(["ok", "rate", "rate", "err", "err", "err"])) for n in range(300)]
    df = spark.createDataFrame(rows, "search_id long, source string, seq long, outcome string")
    want = {(r.source, r.seq): r.skipped for r in attempts.breaker(df).collect()}
    stream = as_stream(spark, df, str(tmp_path), ["seq < 100", "seq between 100 and 180", "seq > 180"])
    got = {(r.source, r.seq): r.skipped for r in drain(live.breaker_stream(stream), str(tmp_path)).collect()}
    assert got == want and any(want.values())


def test_phrase_table(spark, tmp_path):
    rng = random.Random(9)
    words = ["classes", "near me", "price", "in salem", "kit", "valve", "for kids", "book"]
    rows = [(rng.randrange(2), rng.choice(["google", "bing"]), rng.randrange(12), rng.choice([1.0, 0.8]), f"Abacus {rng.choice(words)} {rng.choice(words)}", n) for n in range(400)]
    obs = spark.createDataFrame(rows, "search_id long, source string, pos int, w double, phrase string, n long")
    scans = spark.createDataFrame([(0, "abacus", ["google", "bing"]), (1, "abacus", ["google", "bing"])], "search_id long, seed string, sources array<string>")
    stream = as_stream(spark, obs, str(tmp_path), ["n < 150", "n between 150 and 299 and search_id = 0", "n >= 300 or (n >= 150 and search_id = 1)"])
    root = str(tmp_path / "store")
    q = live.phrase_updates(stream, scans).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    q.foreachBatch(live.publish_keywords(scans, root)).trigger(availableNow=True).start().awaitTermination()
    got = tables.read_table(spark, root, "keywords")
    want = phrases.keyword_table(obs, scans)
    cols = ["search_id", "rank", "phrase", "score", "band", "intent", "place", "fringe"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_published_batches_read_a_bounded_log(spark, tmp_path):
    """Twenty batches: the parts and files that a batch reads do not grow, and a repeated batch changes nothing."""
    root, scans = str(tmp_path), spark.createDataFrame([(i, "abacus", ["google"]) for i in range(4)], "search_id long, seed string, sources array<string>")
    publish, parts, files = live.publish_keywords(scans, root), [], []
    newest = {}
    for batch in range(20):
        rows = [(batch % 4, f"abacus {n}", ["google"], batch + 1, 0.5) for n in range(batch, batch + 5)]
        newest |= {(r[0], r[1]): r[3] for r in rows}
        changed = spark.createDataFrame(rows, "search_id long, phrase string, sources array<string>, occ long, best double")
        publish(changed, batch)
        if batch % 7 == 3:
            publish(changed, batch)
        ledger = Ledger(spark, f"{root}/aggregates")
        parts.append(len(ledger.manifest()["tables"]["phrases"]))
        files.append(len(ledger.read("phrases", live.STORED).inputFiles()))
    assert max(parts) <= live.PARTS and max(files[10:]) <= max(files[:10]) + 4
    got = {(r.search_id, r.phrase): r.occ for r in tables.read_table(spark, root, "keywords").collect()}
    assert got == newest


def test_counters(spark, tmp_path):
    df = spark.createDataFrame([(T, "places", 2), (T + dt.timedelta(days=3), "places", 1), (T, "geo", 1), (T + dt.timedelta(days=60), "geo", 1), (T + dt.timedelta(days=61), "places", 4)], "at timestamp, api string, n int")
    stream = as_stream(spark, df, str(tmp_path / "b"), ["at < '2024-01-11'", "at between '2024-01-11' and '2024-02-01'", "n = 1 and at > '2024-03-01'", "n = 4"])
    seen = []
    q = live.daily_usage(stream.select("at", "api", "n")).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "b" / "cp"))
    q.foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).start().awaitTermination()
    want = places.usage_daily(df).collect()
    assert {(r.day, r.api): r.n for r in seen} == {(r.day, r.api): r.n for r in want}


def test_attempts_out_of_order(spark, tmp_path):
    """Five micro-batches in mixed order, one of them twice; rows that come after the delay are left out."""
    rng = random.Random(6)
    rows = [(1, rng.choice("aab"), n, rng.choice(["ok", "rate", "rate", "err", "err", "err", "cached"]), T + dt.timedelta(seconds=n)) for n in range(400)]
    rows += [(2, None, n, "rate", T + dt.timedelta(seconds=n)) for n in range(0, 400, 9)]
    df = spark.createDataFrame(rows, live.WAITING)
    judge, root = live.judge_attempts(str(tmp_path / "led"), dt.timedelta(seconds=120)), str(tmp_path / "led")
    for i in range(5):
        part = df.filter(f"floor((seq + (seq * 7919) % 90) / 100) = {i}").orderBy(F.rand(i))
        judge(part, i)
        if i == 2:
            judge(part, i)
    judge(spark.createDataFrame([(1, "a", 1000, "ok", T)], live.WAITING), 5)  # too late
    live.finish_attempts(spark, root)
    want = {(r.search_id, r.source, r.seq): (r.strikes, r.errs, r.off_at if r.skipped else None, r.skipped) for r in attempts.breaker(df).collect()}
    got = live.judged(spark, root).collect()
    assert {(r.search_id, r.source, r.seq): (r.strikes, r.errs, r.off_at if r.skipped else None, r.skipped) for r in got} == want and len(got) == len(rows)


def test_ledger_takes_a_batch_once(spark, tmp_path):
    root = str(tmp_path)
    acts = spark.createDataFrame([(i, i % 3, "sent", "first", "en", "", T) for i in range(40)], tables.SCHEMAS["activities"])
    for batch in (0, 1, 1, 0, 2, 2):
        tables.commit_activities(acts.filter(f"id % 3 = {batch}"), root, batch)
    assert sorted(tables.read_activities(spark, root).collect()) == sorted(acts.collect())
    ledger = Ledger(spark, f"{root}/activity_log")
    two = Ledger(spark, f"{root}/activity_log")
    now = ledger.manifest()
    assert two._publish({**now, "number": now["number"] + 1}) and not ledger._publish({**now, "number": now["number"] + 1})  # one of two writers wins
    assert ledger.commit(3, append={"activities": acts.limit(0)}) and ledger.compact("activities", tables.SCHEMAS["activities"], most=2)
    assert len(ledger.manifest()["tables"]["activities"]) == 1 and ledger.read("activities", tables.SCHEMAS["activities"]).count() == 40


def test_rules_in_another_zone(spark):
    """Eleven o'clock of the zone, also after the clocks change."""
    zone = ZoneInfo("Europe/Berlin")
    state = dict.fromkeys(live.LeadProcessor.FIELDS) | {"stage": "new", "wa": "9", "phone_type": "mobile", "touches": 0}
    at = dt.datetime(2024, 3, 30, 15, tzinfo=zone)
    live.apply_event(state, "sent", int(at.timestamp()) * 1_000_000, None, None, None, zone)
    assert dt.datetime.fromtimestamp(state["followup_us"] / 1e6, zone) == dt.datetime(2024, 3, 31, 11, tzinfo=zone)
