"""Entity resolution against a plain sequential fold."""

import random

import pytest
from lead_tables import NOW, batch_rows, lead_rows

from demandlens.operators import matching
from demandlens.operators.matching import first_come
from demandlens.operators.resolve import OLD, match_leads, resolve_leads
from demandlens.session import pin
from demandlens.settings import Settings


def sequential(existing, rows):
    """seq -> lead id, one row after the other."""
    leads = [{"lid": i - OLD, "p": p, "w": w} for i, p, w in sorted(existing)]
    out = {}
    for seq, p, w in sorted(rows):
        lead = next((x for x in leads if p and x["p"] == p), None)
        if lead is None and w:
            lead = next((x for x in leads if x["w"] == w), None)
        if lead is None:
            lead = {"lid": seq, "p": "", "w": ""}
            leads.append(lead)
        lead["p"] = lead["p"] or p
        lead["w"] = lead["w"] or w
        out[seq] = lead["lid"]
    return out


def random_case(rng, n, places, numbers, n_old):
    def place():
        return rng.choice(["", *(f"p{i}" for i in range(places))])

    def number():
        return rng.choice(["", "", *(f"w{i}" for i in range(numbers))])

    existing, used = [], set()
    for i in range(n_old):
        p = place()
        if p in used:
            p = ""
        used.add(p)
        existing.append((i + 1, p, number()))
    return existing, [(i, place(), number()) for i in range(n)]


def run(spark, existing, rows):
    e = spark.createDataFrame(existing, "id long, place_id string, wa string")
    r = spark.createDataFrame(rows, "seq long, p string, w string")
    return {x.seq: x.lid for x in match_leads(e, r).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_rows(spark, seed):
    rng = random.Random(seed)
    existing, rows = random_case(rng, 60, rng.choice([4, 15, 60]), rng.choice([3, 12, 40]), rng.choice([0, 8]))
    assert run(spark, existing, rows) == sequential(existing, rows)


@pytest.mark.parametrize("seed", range(5))
def test_crowded_keys(spark, seed):
    rng = random.Random(100 + seed)
    existing, rows = random_case(rng, 60, [4, 9, 20, 12, 5][seed], [3, 6, 15, 30, 14][seed], [0, 4, 6, 12, 3][seed])
    assert run(spark, existing, rows) == sequential(existing, rows)


def brute_first_come(rows):
    used, out = set(), set()
    for t, p, w in sorted(rows):
        if ("p", p) not in used and ("w", w) not in used:
            used |= {("p", p), ("w", w)}
            out.add((t, p, w))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_first_come(spark, seed):
    rng = random.Random(seed)
    keys = [30, 90, 200, 400][seed]
    rows = [(t, f"p{rng.randrange(keys)}", f"w{rng.randrange(keys)}") for t in range(600)]
    got = first_come(spark.createDataFrame(rows, "t long, p string, w string"))
    assert {tuple(r) for r in got.collect()} == brute_first_come(rows)


def test_long_chain_needs_few_rounds(spark, monkeypatch):
    """3,000 rows, each of which shares a key with the row before: settled by doubling, three tables a round."""
    pins = []
    monkeypatch.setattr(matching, "pin", lambda df: (pins.append(1), pin(df))[1])
    rows = [(t, f"p{(t + 1) // 2}", f"w{t // 2}") for t in range(3000)]
    got = first_come(spark.createDataFrame(rows, "t long, p string, w string"))
    assert {r.t for r in got.collect()} == set(range(0, 3000, 2)) and len(pins) <= 3 * 15


def test_hub_number_needs_few_rounds(spark):
    """One number shared by every place id: settled after its first row."""
    rows = [(i, f"p{i}", "hub") for i in range(200)] + [(200 + i, f"p{i}", "") for i in range(0, 200, 3)]
    rows += [(400 + i, f"p{i}", "hub") for i in range(200)]
    assert run(spark, [], rows) == sequential([], rows)


def test_chained_query_resolves_against_all_customers(spark):
    from demandlens.checks.lead_checks import lead_resolve_chained

    d = "/root/testdata/sf0.001"
    customers = [r[0] for r in spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").collect()]
    existing = [(k + 1, f"p{k}" if k < 701 and k % 3 else "", f"9{k * 7919 % 907}") for k in customers]
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    rows = [(o, f"p{c % 701}" if o % 3 else "", f"9{o * 7919 % 907}" if o % 4 else "") for o, c in orders]
    got = {r.seq: r.lid for r in lead_resolve_chained(spark, d).collect()}
    keyed = [r for r in rows if r[1] or r[2]]
    want = sequential(existing, keyed)
    assert {s: got[s] for s in want} == want and any(lid < 0 for lid in got.values())


def test_documented_order(spark):
    batch = batch_rows(
        spark,
        [
            {"seq": 0, "place_id": "X", "name": "A", "phone": "9876543210"},
            {"seq": 1, "place_id": "Y", "name": "B", "phone": "9876543210", "website": "s2"},
            {"seq": 2, "place_id": "Y", "name": "C", "phone": "9876543211"},
            {"seq": 3, "place_id": "X", "name": "D", "phone": "9876543211", "website": "s4"},
            {"seq": 4, "name": "E", "website": "s5"},
            {"seq": 5, "name": "F", "status": "CLOSED_PERMANENTLY"},
            {"seq": 6, "name": ""},
        ],
    )
    leads, outcomes = resolve_leads(lead_rows(spark, []), batch, Settings(), NOW)
    got = [(r.id, r.place_id, r.name, r.wa, r.website) for r in leads.orderBy("id").collect()]
    assert got == [
        (1, "X", "A", "919876543210", "s4"),
        (2, "Y", "C", "919876543211", ""),
        (3, None, "E", "", "s5"),
    ]
    assert [(r.seq, r.outcome) for r in outcomes.orderBy("seq").collect()] == [
        (0, "inserted"), (1, "updated"), (2, "inserted"), (3, "updated"), (4, "inserted"), (5, "skipped"), (6, "skipped"),
    ]


def test_merge_fills_and_keeps(spark):
    existing = lead_rows(
        spark,
        [
            {"id": 7, "place_id": "X", "name": "Old", "address": "a1", "rating": 4.0, "stage": "contacted", "notes": "n"},
            {"id": 9, "name": "Other", "wa": "919876543299", "phone": "9876543299", "phone_type": "mobile"},
        ],
    )
    batch = batch_rows(
        spark,
        [
            {"seq": 0, "place_id": "X", "name": "New", "address": "", "rating": 4.6, "phone": "9876543210", "city": "Salem"},
            {"seq": 1, "place_id": "X", "name": "New", "address": "a2", "phone": "9876543211"},
            {"seq": 2, "place_id": "Z", "name": "New", "phone": "9876543299"},
            {"seq": 3, "name": "Third", "phone": "044 2234 5678", "area": "Adyar"},
        ],
    )
    leads, _ = resolve_leads(existing, batch, Settings(), NOW)
    a, b, c = leads.orderBy("id").collect()
    assert (a.id, a.name, a.address, a.rating, a.stage, a.notes, a.wa, a.city) == (
        7, "Old", "a2", 4.6, "contacted", "n", "919876543210", "Salem",
    )
    assert a.score == 30 + 15 + 15 and [s.label for s in a.signals] == ["Rated 4.6", "Mobile number (WhatsApp likely)"]
    assert (b.id, b.place_id, b.wa) == (9, "Z", "919876543299")
    assert (c.id, c.name, c.phone_type, c.area, c.stage, c.score) == (10, "Third", "landline", "Adyar", "new", 35)
