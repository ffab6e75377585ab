"""Mixing sources to target weights by min-cost flow.

Documents are added up by membership pattern (the set of sources that count them).  Each pattern gives its words up to three times, the
first pass for nothing, every further one at a higher price; sources ask for their quota.  The cheapest flow through this graph says how many words
of a pattern are taken, in whole passes and a rest; the rest falls on documents in seeded order.

Only sums by pattern and by source reach the driver.  Defined results: a null text has no words; a null source is a source of its own,
last in order; null ids and rows that repeat are documents of their own, ordered by text hash where ids tie; a table without words takes nothing; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import WORD, Shelf, free_name, with_row_keys

WEIGHTS = (5, 2, 1)
PASSES = 3
#: Price of a word in the first, second, third pass: convex, so that passes fill one after the other.
PRICES = (0, 1, 3)
#: Bound of what the driver works on: sources and patterns.  More stop the job rather than being dropped.  Measured for the flow here: 200,000
#: patterns of one source 0.3 s, as many overlapping ones over 2,000 sources 52 s; 20,000 overlapping ones over 20,000 sources 13 s.
MOST_PATTERNS = 200_000
SEED = "mix-1"


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, passes: int = PASSES) -> dict[str | None, float]:
    """Words each source should give: shares by weight of all words, at most ``passes`` times its own; what is over is shared again."""
    order = sorted(sizes, key=lambda s: (s[0] is None, [ord(c) for c in s[0] or ""]))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, whole, out = dict(order), sum(n for _, n in order), {}
    free = list(size)
    while free:
        left, share = whole - sum(passes * size[s] for s in out), sum(weight[s] for s in free)
        level = {s: weight[s] * left / share for s in free}
        over = [s for s in free if level[s] > passes * size[s]]
        if not over:
            return {**{s: float(n) for s, n in out.items()}, **level}
        out |= {s: passes * size[s] for s in over}
        free = [s for s in free if s not in out]
    return {s: float(n) for s, n in out.items()}


def cheapest_flow(patterns: dict[tuple, int], quotas: dict, prices: Sequence[int] = PRICES) -> dict[tuple, int]:
    """Words taken of each pattern: successive cheapest paths from patterns (one arc for each pass) through sources to quotas.

    Words may be rerouted between the sources of a pattern, so that a pattern that several sources share serves whoever lacks.  A pattern
    that is all its one source has needs no search: it gives the quota, or all its passes.
    """
    uses = Counter(source for pattern in patterns for source in pattern)
    alone = {p: min(quotas.get(p[0], 0), len(prices) * n) for p, n in patterns.items() if len(p) == 1 and uses[p[0]] == 1}
    patterns = {p: n for p, n in patterns.items() if p not in alone}
    quotas = {s: q for s, q in quotas.items() if (s,) not in alone}
    if not patterns:
        return alone
    start, end = "start", "end"
    arcs: dict[object, list[int]] = {start: [], end: []}
    to, room, cost = [], [], []

    def arc(a: object, b: object, most: int, price: int) -> None:
        for x, y, m, p in ((a, b, most, price), (b, a, 0, -price)):
            arcs.setdefault(x, []).append(len(to))
            to.append(y)
            room.append(m)
            cost.append(p)

    firsts = {}
    for pattern, words in patterns.items():
        firsts[pattern] = len(to)
        for price in prices:
            arc(start, ("pattern", pattern), words, price)
        for source in pattern:
            arc(("pattern", pattern), ("source", source), len(prices) * words, 0)
    for source, quota in quotas.items():
        arc(("source", source), end, quota, 0)
    high = dict.fromkeys(arcs, 0)
    while True:
        far, by, heap, n = {start: 0}, {}, [(0, 0, start)], 0
        while heap:
            d, _, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in arcs[x]:
                y = to[e]
                if room[e] and (new := d + cost[e] + high[x] - high[y]) < far.get(y, 1 << 60):
                    far[y], by[y], n = new, e, n + 1
                    heapq.heappush(heap, (new, n, y))
        if end not in far:
            return alone | {p: sum(room[f + 2 * i + 1] for i in range(len(prices))) for p, f in firsts.items()}
        most = max(far.values())
        for x in high:
            high[x] += far.get(x, most)
        while block(start, end, arcs, to, room, cost, high):
            pass


def block(start: object, end: object, arcs: dict, to: list, room: list, cost: list, high: dict) -> bool:
    """Push along the shortest paths of no reduced cost until none of them is left; False if there was none.

    No arc is looked at again once it is found to lead nowhere, so a call takes about as many steps as there are arcs.
    """
    level, now = {start: 0}, [start]
    while now and end not in level:
        then = []
        for x in now:
            for e in arcs[x]:
                y = to[e]
                if room[e] and y not in level and cost[e] + high[x] - high[y] == 0:
                    level[y] = level[x] + 1
                    then.append(y)
        now = then
    if end not in level:
        return False
    at, path, x = dict.fromkeys(level, 0), [], start
    while True:
        if x == end:
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
            full = next(i for i, e in enumerate(path) if not room[e])
            x = to[path[full] ^ 1]
            path = path[:full]
        tries = arcs[x]
        while at[x] < len(tries):
            e = tries[at[x]]
            y = to[e]
            if room[e] and level.get(y) == level[x] + 1 and cost[e] + high[x] - high[y] == 0:
                break
            at[x] += 1
        if at[x] < len(tries):
            path.append(e)
            x = y
        elif x == start:
            return True
        else:
            x = to[path.pop() ^ 1]
            at[x] += 1


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES, seed: str = SEED, row: str | None = None, members: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of every row.

    ``members`` names a column (array of sources, ``source`` among them) where documents count for several sources.  ``taken`` is
    exact: in each pattern one document at most is taken in part.  ``copies`` are whole: that document counts if half of it is taken.
    ``row`` names a column of row keys, which is kept.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark)
    pattern = F.array_sort(F.array_distinct(members)) if members else F.array("source")
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), pattern.cast("array<string>").alias("pattern"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("draw"), F.xxhash64("text").alias("h"), *([F.col(row)] if row else []))
    table = shelf.put(sized)
    by_source = table.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    by_pattern = table.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if max(len(by_source), len(by_pattern)) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sources or patterns: group them first")
    size = {r.source: r.n for r in by_source}
    target = targets(list(size.items()), weights, passes)
    flow = cheapest_flow({tuple(r.pattern): r.n for r in by_pattern}, {s: round(t) for s, t in target.items()}, PRICES[:passes])
    facts = spark.createDataFrame([(s, size[s], target[s]) for s in size], "source string, source_size long, target double")
    shares = spark.createDataFrame([(list(p), f // (n or 1), f % (n or 1)) for p, n, f in ((tuple(r.pattern), r.n, flow[tuple(r.pattern)]) for r in by_pattern)], "pattern array<string>, whole long, rest long")
    share = F.broadcast(shares.withColumn("p", F.to_json("pattern")).select("p", "whole", "rest"))  # MOST_PATTERNS rows at most
    placed = table.withColumn("p", F.to_json("pattern")).join(share, "p")
    before = words_before(placed, shelf)
    part = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("size"))
    done = before.join(F.broadcast(facts), before["source"].eqNullSafe(facts["source"])).select(*([before[row]] if row else []), before["doc_id"], before["source"], "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"), (F.col("whole") + (2 * part >= F.greatest("size", F.lit(1))).cast("long")).alias("copies"))
    return done


def words_before(placed: DataFrame, shelf: Shelf, digits: int = 3) -> DataFrame:
    """``placed`` with ``before``: words of the pattern's documents that come earlier in seeded order.

    Sums over the first hex digits of the draw are made first; only slots of like first digits are ordered, so a pattern that holds a third
    of all rows is spread over 16 ** digits windows, and 16 times as many for every digit more.
    """
    slot = F.substring("draw", 1, digits)
    slots = placed.groupBy("p", slot.alias("slot")).agg(F.sum("size").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("p").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    base = shelf.put(slots.select("p", "slot", F.coalesce(earlier, F.lit(0)).alias("base")))
    within = Window.partitionBy("p", "slot").orderBy("draw", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("slot", slot).withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return ranked.join(base, ["p", "slot"]).withColumn("before", F.col("base") + F.col("within"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns as they are, each as often as it is taken whole.

    Every row is a document of its own, whether its id is null or repeats.
    """
    rows, row = with_row_keys(docs, Shelf(docs.sparkSession))
    times = free_name(docs, "_times")
    taken = mix(rows, row=row).filter("copies > 0").select(row, F.sequence(F.lit(1), F.col("copies").cast("int")).alias(times))
    return rows.join(taken, row).withColumn(times, F.explode(times)).select(*docs.columns)
