"""Exact dedup, Jaccard join, mixing, archives, reputation: against brute-force versions."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from demandlens.llm import exact, jaccard, mixing, reputation, warc
from demandlens.llm.common import Shelf
from demandlens.llm.components import components


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustné") for _ in range(rng.choice([2, 5]))) + rng.choice(["", "", ".", ","]) for _ in range(n))


def test_exact(docs_of):
    rng = random.Random(5)
    base = [prose(rng, n) for n in (0, 1, 30, 900, 12_000)]
    rows = [(i, rng.choice([str, str.upper, str.title])(rng.choice(base)) if i % 3 else prose(rng, 50)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "ÉA"), (503, "éa"), (504, "Éa"), (505, "x" * 200_000), (506, "x" * 199_999 + "X"), (507, "x" * 199_999), (508, "dup"), (508, "dup"), (None, "dup"), (None, "alone")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact.groups(docs_of(rows)).collect())
    largest = lambda ids: max((i for i in ids if i is not None), default=None)
    assert got == sorted((str(i), str(largest(groups[low(t)])), len(groups[low(t)]), i == largest(groups[low(t)])) for i, t in rows)
    assert exact.groups(docs_of([])).collect() == []


def test_exact_with_collisions(docs_of, monkeypatch):
    """Identifiers that collide: hashes of three values only."""
    real = F.xxhash64
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: real(*c) % 3 if len(c) == 1 else real(*c))
    rows = [(i, f"text {i % 7}") for i in range(40)]
    got = exact.groups(docs_of(rows)).collect()
    assert all(r.keep_id % 7 == r.doc_id % 7 and r.group_size == sum(i % 7 == r.doc_id % 7 for i, _ in rows) for r in got) and len(got) == 40


def test_chunks_join_to_the_text(docs_of):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(["", "a", "\n" * 9000, prose(rng, 5000), "é" * 40_000, "😀x" * 9000])]
    df = docs_of(rows).select("text", exact.chunks(F.col("text")).alias("c"))
    assert all("".join(r.c) == r.text for r in df.collect())


def shingle_set(text, words):
    found = low(text).encode().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_components(rows, words, percent):
    sets = [shingle_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("words,percent,long_list", [(4, 85, 100), (5, 80, 100), (4, 85, 3), (4, 60, 5)])
def test_jaccard(docs_of, monkeypatch, words, percent, long_list):
    """Groups of near copies at all distances, shared passages, short texts, ties; also with every list long."""
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    rng = random.Random(words + percent + long_list)
    passage = prose(rng, 40)
    rows = []
    for g in range(12):
        base = prose(rng, rng.choice([5, 30, 120])).split()
        for _ in range(rng.choice([1, 2, 12, 30])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            if rng.random() < 0.3:
                copy += passage.split()
            rows.append((len(rows) * 7 % 1009, rng.choice([str, str.upper])(" ".join(copy))))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE\x0btwo"), (2005, "two one"), (2006, "one\u00a0two"), (2007, prose(rng, 30_000))]
    got = sorted(tuple(r) for r in jaccard.join_components(docs_of(rows).repartition(3), words, percent).collect())
    want = brute_components(rows, words, percent)
    if "é" in "".join(t or "" for _, t in rows):  # upper() changes é too: compare as the rule says
        assert got == want
    assert len(got) == len(rows)


def test_jaccard_small(docs_of):
    assert jaccard.join_components(docs_of([])).collect() == []
    got = sorted(str(tuple(r)) for r in jaccard.join_components(docs_of([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q")])).collect())
    assert got == sorted(map(str, [(None, 1, 5), (5, 1, 5), (5, 1, 5), (None, 1, None)]))


def test_jaccard_of_rows_without_ids(docs_of):
    """Rows without an id link like others; the least id of a component names it."""
    words = [f"w{i}" for i in range(100)]
    other = [f"x{i}" for i in range(100)]
    rows = [(5, " ".join(words)), (None, " ".join([*words[:99], "new"])), (9, " ".join([*words[:98], "new", "er"])), (None, " ".join(other)), (None, " ".join([*other, "y"])), (None, "alone")]
    got = sorted(str((r.doc_id, r.component_id)) for r in jaccard.join_components(docs_of(rows)).collect())
    assert got == sorted(map(str, [(5, 5), (None, 5), (9, 5), (None, None), (None, None), (None, None)]))


@pytest.mark.parametrize("with_base", [True, False])
def test_unlinked_group_costs_few_comparisons(docs_of, monkeypatch, with_base):
    """300 near copies of one text, most of which do not link with each other."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 20)  # the lists of short groups are met in full
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))] if with_base else []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(3)}" if rng.random() < 0.3 else f"e{i}x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(copy)))
    compared, real = [], jaccard.overlaps
    monkeypatch.setattr(jaccard, "overlaps", lambda met, have: (compared.append(met.count()), real(met, have))[1])
    got = sorted(tuple(r) for r in jaccard.join_components(docs_of(rows)).collect())
    assert got == brute_components(rows, 4, 85) and len({c for _, _, c in got}) > 100
    assert sum(compared) < 300 * 9, compared


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200, 320)] + [(1000, i) for i in range(1001, 1060)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)

    def least(n):
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m), todo.append(m)
        return min(seen)

    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Shelf(spark)).collect()}
    assert got == {n: least(n) for n in near if near[n] - {n}}


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 187.5, "b": 75.0, None: 37.5}
    capped = mixing.targets([("a", 10), ("b", 300), ("c", 90)])
    assert capped["a"] == 30 and sum(capped.values()) == pytest.approx(400) and capped["b"] == 2 * capped["c"]
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_flow_against_enumeration():
    """Shared patterns, against all ways of giving words to quotas."""
    patterns, quotas = {("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 5, "b": 4}
    flow = mixing.cheapest_flow(patterns, quotas)
    price = lambda n, w: sum(mixing.PRICES[(i // w)] for i in range(n))
    best = None
    for x in range(7):
        for y in range(7):
            for z in range(4):
                met = max(min(x + s, 5) + min(z + y - s, 4) for s in range(y + 1))
                if met == x + y + z:
                    key = (-met, price(x, 2) + price(y, 2) + price(z, 1))
                    best = min(best, key) if best else key
    assert (-sum(flow.values()), sum(price(flow[p], n) for p, n in patterns.items())) == best


def test_mix(docs_of):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 1, 40, 300])), "en", rng.choice(["s1", "s1", "s2", "é", None])) for i in range(150)] + [(900, None, None, "s2"), (901, "w " * 50_000, None, "big"), (902, "x y", None, "tiny"), (903, "", None, "empty"), (7, "same", None, "s1"), (7, "same", None, "s1")]
    got = mixing.mix(docs_of(rows, extra=False).withColumnRenamed("n_chars", "taken")).collect()
    again = mixing.mix(docs_of(rows, extra=False).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = mixing.targets(list(sizes.items()))
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == want[r.source]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert mixing.mix(docs_of([])).collect() == []


def test_mix_of_overlapping_sources(docs_of):
    rows = [(i, "w " * 10, None, "a" if i % 2 else "b") for i in range(40)]
    docs = docs_of(rows, extra=False).withColumn("members", F.when(F.col("doc_id") < 20, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source")))
    got = mixing.mix(docs).collect()
    assert sum(r.taken for r in got) == 400  # both quotas are met in all


def test_a_column_named_members_is_not_read_unless_asked(docs_of):
    rows = [(i, "w " * 10, None, "a" if i % 2 else "b") for i in range(8)]
    docs = docs_of(rows, extra=False)
    want = sorted(map(str, mixing.mix(docs).collect()))
    assert sorted(map(str, mixing.mix(docs.withColumn("members", F.lit(3))).collect())) == want
    assert sorted(map(str, mixing.mix(docs.withColumn("members", F.array(F.lit("a"), F.lit("b")))).collect())) == want
    assert mixing.mixed(docs.withColumn("members", F.lit(3))).columns == [*docs.columns, "members"]
    # all b words count for a too: a's quota is then met from both
    shared = mixing.mix(docs.withColumn("members", F.when(F.col("source") == "b", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))), members="members").collect()
    assert sum(r.taken for r in shared) == 80 and sum(r.taken for r in shared if r.source == "a") < sum(r.taken for r in mixing.mix(docs).collect() if r.source == "a")


@pytest.mark.parametrize("shared", [False, True])
def test_flow_of_many_patterns_ends(shared):
    rng = random.Random(9)
    n = 20_000
    patterns = {tuple(sorted({i, *(rng.randrange(n) for _ in range(2 * shared))})): rng.randrange(1, 100) for i in range(n)}
    quotas = {i: rng.randrange(250) for i in range(n)}
    start = time.process_time()
    flow = mixing.cheapest_flow(patterns, quotas)
    assert time.process_time() - start < 60 and all(0 <= flow[p] <= 3 * w for p, w in patterns.items())
    if not shared:
        assert all(flow[i,] == min(quotas[i], 3 * w) for (i,), w in patterns.items())


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS offset", "'y' AS file", "1 AS length")


RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, tmp_path, compression, monkeypatch):
    rng = random.Random(6)
    rows = [(i, f"http://h{i}.example.com/a b", prose(rng, rng.choice([0, 3, 60, 400]))) for i in range(60)]
    rows += [(100 + i, None, "copy " * 50) for i in range(30)] + [(200, "u\r\nWARC/1.1\r\n", None), (201, "", ""), (202, "x", "short"), (203, "x", "short"), (None, "n", "no id")]
    rows += [(300, "m", RECORD * 3), (301, "m", "WARC/1.1\r\n" * 50), (302, "m", "text " * 50 + RECORD), (303, "m", RECORD + "é" * 90), (304, "m", "\r\n\r\n" + RECORD), (305, "m", "WARC/1.1\r\nContent-Length: 999999\r\n\r\n"), (306, "m", "z" * 300_000)]
    path = str(tmp_path / "w")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        warc.write(pages_of(spark, rows).repartition(2), path, compression)
        got = warc.read(spark, path, payloads=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(html or "", i)
    want = [(f"<urn:page:{'' if i is None else i}>", "revisit", f"<urn:page:{first[h or '']}>", None) if len((h or "").encode()) >= 100 and first[h or ""] != i else (f"<urn:page:{'' if i is None else i}>", "response", None, (h or "").encode()) for i, _, h in rows]
    assert sorted(map(str, ((r.record_id, r.record_type, r.refers_to, bytes(r.payload) if r.record_type == "response" else None) for r in got))) == sorted(map(str, want))


def test_warc_round_trip(spark):
    assert warc.round_trip(pages_of(spark, [])).collect() == []
    got = warc.round_trip(pages_of(spark, [(1, "u", "a" * 200), (2, "u", "a" * 200), (2, "u", "a" * 200), (3, "u", None)])).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(1, 200, "response", None), (2, 200, "revisit", 1), (2, 200, "revisit", 1), (3, 0, "response", None)]
    assert len({r.payload_digest for r in got if r.page_id < 3}) == 1


def test_warc_reading_stops_where_the_chain_breaks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes((RECORD + RECORD + "junk " + RECORD).encode())
    (tmp_path / "b.txt").write_bytes(("junk" + RECORD).encode())
    (tmp_path / "c.txt").write_bytes(b"")
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.offset for r in got) == [0, len(RECORD)]


def test_rules_and_hosts(spark):
    urls = [
        ("http://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/1?x", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("http://m.example.com/de/1#x", "m.example.com", "/de/1", "com/", "allow"),
        ("https://a.net/fr/9", "a.net", "/fr/9", "net/fr/", "block"),
        ("https://net/es/", "net", "/es/", "net/es/", "block"),
        ("https://a.anet/es/", "a.anet", "/es/", None, "allow"),
        ("x://example.com", "example.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("a://b://c/", "b:", "//c/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(reputation.judge(pages, labels).collect())
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [u[1:] for u in urls]


def test_reputation(spark):
    """Bad hosts go, good hosts and hosts with little evidence stay; brothers of bad hosts inherit from their domain."""
    rows = [(f"http://bad.farm.org/{i}", 0) for i in range(80)] + [(f"http://good.org/{100 + i}", 1) for i in range(80)] + [("http://once.org/200", 0)] + [(f"http://p{i}.farm.org/{300 + i}", 0) for i in range(40)]
    rows += [(f"http://ok{i % 9}.org/{400 + i}", 1) for i in range(90)]
    pages = spark.createDataFrame([(i, u, "") for i, (u, _) in enumerate(rows)] + [(900, "http://new.farm.org/x", ""), (901, "http://new.org/", ""), (902, "http://good.org/", "")], "page_id long, url string, html string")
    labels = spark.createDataFrame([(int(u.rsplit("/", 1)[1]), q, 0) for u, q in rows] + [(None, 1, 0), (100, 1, 0)], "doc_id long, quality int, toxic int")
    host = {r.host: r.verdict for r in reputation.reputations(pages, labels).collect()}
    assert (host["bad.farm.org"], host["good.org"], host["once.org"], host["new.org"], host["new.farm.org"]) == ("block", "allow", "allow", "allow", "block")


def brute_posteriors(counts):
    """host -> (alpha, beta): (host, good, n), level by level; the level above counts without the member."""
    suffix = lambda h: h.split(".")[-1]
    domain = lambda h: ".".join(h.split(".")[-2:])
    total = [sum(g for _, g, _ in counts) + 1.0, sum(n - g for _, g, n in counts) + 1.0]
    above, out = {"": total}, None
    for key, up in ((suffix, lambda h: ""), (domain, suffix), (lambda h: h, domain)):
        table = defaultdict(lambda: [0, 0, None])
        for h, g, n in counts:
            row = table[key(h)]
            row[0], row[1], row[2] = row[0] + g, row[1] + n, up(h)
        linked = {k: (g, n, max(above[u][0] - g, 1e-3), max(above[u][1] - (n - g), 1e-3)) for k, (g, n, u) in table.items()}
        mean = {k: a / (a + b) for k, (g, n, a, b) in linked.items()}
        seen = sum(n * (g / n - mean[k]) ** 2 for k, (g, n, _, _) in linked.items())
        chance = sum(mean[k] * (1 - mean[k]) for k in linked)
        room = sum(n * mean[k] * (1 - mean[k]) for k, (_, n, _, _) in linked.items()) - chance
        between = max((seen - chance) / room, 1e-3) if room > 0 else 1e-3
        strength = min(max(1 / between - 1, 1.0), 1000.0)
        out = {}
        for k, (g, n, a, b) in linked.items():
            weight = min(strength, a + b)
            out[k] = (mean[k] * weight + g, (1 - mean[k]) * weight + n - g)
        above = out
    return out


def test_posteriors_against_brute_force(spark):
    rng = random.Random(8)
    counts = []
    for d in range(12):
        rate = rng.random()
        for h in range(rng.choice([1, 3, 6])):
            n = rng.choice([1, 2, 9, 40])
            counts.append((f"h{h}.d{d}.{rng.choice(['org', 'net']) if d % 3 else 'org'}", sum(rng.random() < rate for _ in range(n)), n))
    counts = list({c[0]: c for c in counts}.values())
    got = reputation.posteriors(spark.createDataFrame(counts, "host string, good long, n long"), Shelf(spark))["host"].collect()
    want = brute_posteriors(counts)
    assert len(got) == len(want) and all((r.alpha, r.beta) == pytest.approx(want[r.key]) for r in got)
