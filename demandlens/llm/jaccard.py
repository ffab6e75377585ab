"""Exact Jaccard self-join of word shingle sets with set-relation skipping, down to connected components.

Sets are hashed once.  Equal sets become one class.  A class's prefix is its first n - ceil(t * n) + 1 shingles in one global order (shingles
of very long index lists last, then by hash): two linked sets share one of them.  Index lists hold (class, size, position).

Skipping within lists: entries are met by blocks of like size; the position of an entry bounds the size of its partners too, so blocks
beyond are skipped; a pair is skipped when size or position leave too few shingles that could be common, and a second bound uses both prefixes.

Skipping by set relations: instead of all pairs of a list, a few leaders are compared with the list's entries, and among them the one whose set has
the fewest rare shingles, since it lies in the middle of a group.  What links to a leader joins
its component, and entries of one component are never compared again: their answers follow from the leader's.  Of entries that did not link
the overlap with the leader is kept: two that were compared with the same leader can have no more in common than either has with it, and than
either has beside it, so most such pairs are settled without reading their sets.  A leader leaves its
lists, the rest goes on with 64 times as many, chosen from outside the list's largest component, until one component is left.
Every pair of a list is thus compared, bounded or known to be connected, so components are exact, and a group of m near copies that link costs
about m comparisons a round instead of m * m.

Sets are compared by 62-bit hashes of shingles.  Defined results: a null text, or one without words, has the empty set and is
linked with nothing; rows that repeat an id are members of that id's component each; a row without an id (null, or below -2^62) links like
others, and its component is named by the least id in it, null if none has one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import Shelf, batches_of, with_row_keys
from demandlens.llm.components import components, merged

WORDS, PERCENT = 4, 85
#: Index lists longer than this send their shingle to the end of the order; at most MOST_LATE shingles (the longest lists) are sent.
LONG_LIST, MOST_LATE = 100, 200_000
LATE = 1 << 62
#: Ids below this one are taken for null.
LEAST_ID = -(1 << 62)
FIRST_LEADERS, LEADER_GROWTH = 8, 64
#: What an entry knows of another class's answers: the class, and how much the two have in common.
REFERENCE = ("ref", "over")
#: So many prefix lengths of each set are kept at first, so that most prefixes can be put in the final order without the text.
HEAD = 2
#: Ids (8 bytes each) that are broadcast to pick texts; beyond it Spark joins by shuffle.
MOST_BROADCAST = 1_000_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 62-bit hashes of the word shingles of ``text``; words are split at ASCII white space, A-Z lower-cased."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            out = (out ^ (out >> np.uint64(29))) * _MULTIPLIERS[j % 8] + h[j : len(h) - width + 1 + j]
        out = (out ^ (out >> np.uint64(32))) * _MULTIPLIERS[7]
        out = (out ^ (out >> np.uint64(29))) * _MULTIPLIERS[6]
    return np.unique(out >> np.uint64(2)).astype(np.int64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of n two linked sets must share one of."""
    return n - (n * percent + 99) // 100 + 1 if n else 0


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def _lists(arrays: list[np.ndarray | None]) -> pa.ListArray:
    """An Arrow column of the arrays; None becomes null."""
    at = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in arrays])]).astype(np.int32)
    flat = [x for x in arrays if x is not None]
    values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(at), values, mask=pa.array([x is None for x in arrays], pa.bool_()))


def summaries(docs: DataFrame, late: np.ndarray | None = None, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, digest, prefix): set size, 128-bit digest of the set, and the prefix in the global order (late shingles moved by LATE).

    As long as ``late`` isn't known, ``prefix`` is the HEAD-fold prefix by hash alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2 << 20):
            sizes, digests, prefixes = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                s = shingles(text.as_py() or b"", words)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                length = prefix_length(len(s), percent)
                prefixes.append(s[: HEAD * length] if late is None else np.sort(s + _in(s, late) * LATE)[:length])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(prefixes)], ["doc_id", "n", "digest", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest binary, prefix array<long>")


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, s): whole sets of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2 << 20):
            found = [shingles(t.as_py() or b"", words) for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(found)], ["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, s array<long>")


def long_lists(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, lengths) of the longest lists, MOST_LATE at most, by counts (t, m)."""
    longest = counts.groupBy("t").agg(F.sum("m").alias("m")).filter(F.col("m") > LONG_LIST).orderBy(F.desc("m"), "t").limit(MOST_LATE)
    rows = longest.collect()
    return np.array([r.t for r in rows], np.int64), np.array([r.m for r in rows], np.int64)


def late_shingles(*lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles that come last in the order, MOST_LATE at most, those of the longest lists: which ones changes cost, never results."""
    t, m = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.lexsort((t, -m))
    _, at = np.unique(t[order], return_index=True)
    return np.sort(t[order][np.sort(at)[:MOST_LATE]])


def counted(sets_: DataFrame) -> DataFrame:
    """(t, m): how often each shingle is in the sets (s) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m = np.unique(batch.column("s").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(m, pa.int64())], ["t", "m"])

    return sets_.select("s").mapInArrow(run, "t long, m long")


def postings_of(table: DataFrame) -> DataFrame:
    """(t, c, n, pos, u): the index entries of the classes' prefixes; ``u`` counts the shingles in short lists at the prefix's start."""
    return table.select(F.col("doc_id").alias("c"), "n", "u", F.posexplode("prefix").alias("pos", "t")).select("t", "c", "n", F.col("pos").cast("long").alias("pos"), "u")


def needed(a: Column, b: Column, percent: int) -> Column:
    """Least number of common shingles of two linked sets of sizes a and b: ceil(percent * (a + b) / (100 + percent))."""
    return F.floor((F.lit(percent) * (a + b) + (100 + percent - 1)) / (100 + percent))


def linked_classes(docs: DataFrame, reps: DataFrame, shelf: Shelf, words: int, percent: int) -> DataFrame:
    """(node, root) of the classes that are linked with another: ``reps`` is (doc_id, n, prefix) of each class."""
    reps, have = index_order(docs, reps, shelf, words, percent)
    entries = shelf.put(with_lists(postings_of(reps)).withColumns({name: F.lit(None).cast("long") for name in REFERENCE}))
    k, roots = FIRST_LEADERS, None
    while not entries.isEmpty():
        members = entries.withColumn("leads", leads(k))
        met = shelf.put(bounded(pairs_of(members.filter("leads"), members, percent), reps, percent))
        ids = met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        lacking = shelf.put(ids.join(have.select("doc_id"), "doc_id", "left_anti"))
        if not lacking.isEmpty():
            have = have.union(shelf.put(sets(picked(docs, lacking), words)))
        rest, found = members.filter(~F.col("leads")).select("t", "c", "n", "pos", "u", *REFERENCE), None
        if not met.isEmpty():
            found = shelf.put(overlaps(met, have))
            links = found.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
            if not links.isEmpty():
                trees = components(links, shelf)
                known, roots = roots, trees if roots is None else shelf.put(merged(roots, trees))
                shelf.drop(*([known, trees] if known is not None else []))
            rest = referred(rest, found)
        now = shelf.put(with_lists(rest, roots))
        shelf.drop(entries, met, lacking, found)
        entries, k = now, k * LEADER_GROWTH
    return roots if roots is not None else reps.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root")).limit(0)


def referred(entries: DataFrame, found: DataFrame) -> DataFrame:
    """``entries`` with the class that their own was compared with (``ref``) and how many shingles the two have in common (``over``).

    Of several, the one that comes first by a hash is taken, so that classes of one list are likely to refer to the same.
    """
    both = found.select(F.col("a").alias("c"), F.col("b").alias("ref"), "common").union(found.select("b", "a", "common"))
    one = both.groupBy("c").agg(F.min_by(F.struct("ref", F.col("common").alias("over")), F.xxhash64("ref")).alias("r")).select("c", "r.ref", "r.over")
    known = entries.withColumnsRenamed({"ref": "ref0", "over": "over0"}).join(one, "c", "left")
    new = F.col("ref0").isNull()
    return known.select("t", "c", "n", "pos", "u", F.when(new, F.col("ref")).otherwise(F.col("ref0")).alias("ref"), F.when(new, F.col("over")).otherwise(F.col("over0")).alias("over"))


def with_lists(entries: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The entries of lists with several components, with their own ``root``, the list's length ``m``, its largest component (``main``, of ``most``
    entries), and the class whose set has the fewest rare shingles (``first``).

    At first most entries are alone in their list, and sums by list would be as many rows again: so entries are moved once, next to their list.
    """
    first = F.min(F.struct("u", F.xxhash64("c").alias("h"), "c"))
    if roots is None:
        whole = Window.partitionBy("t")
        held = entries.withColumns({"m": F.count("*").over(whole), "main": F.max("c").over(whole), "low": first.over(whole)}).filter("m > 1")
        return held.withColumns({"root": F.col("c"), "most": F.lit(1).cast("long"), "first": F.col("low.c")}).drop("low")
    named = entries.join(roots, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c")).drop("node")
    parts = named.groupBy("t", "root").agg(F.count("*").alias("m"), first.alias("low"))
    lists = parts.groupBy("t").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("top"), F.min("low").alias("low"))
    lists = lists.select("t", "m", F.col("top.root").alias("main"), F.col("top.m").alias("most"), "low").filter("m > most")
    return named.join(lists.withColumn("first", F.col("low.c")).drop("low"), "t")


def leads(k: int) -> Column:
    """Whether an entry leads: about k of each list from outside its largest component, all if there are fewer, and the one whose
    set has the fewest rare shingles: it is the likeliest to link with the others.

    Leaders are chosen by a hash of the class and the round, so that lists that overlap choose the same.
    """
    draw = (F.xxhash64(F.lit(k), "c") / F.lit(2.0**64)) + 0.5
    return (F.col("root") != F.col("main")) & ((draw * (F.col("m") - F.col("most")) <= k) | (F.col("c") == F.col("first")))


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids`` (a stored table); they aren't moved unless the ids are too many to send everywhere."""
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi")


def index_order(docs: DataFrame, reps: DataFrame, shelf: Shelf, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, prefix, u): prefixes in an order that puts shingles of long lists last, from heads (HEAD-fold prefixes by hash); and the sets that were read for it.

    The first shingles of a head that aren't late are the prefix.  Where a head holds too few of them, as in groups of near copies, the
    whole sets are read, and their shingles counted too, so that all that a group shares comes late.
    """
    heads = reps.select("doc_id", "n", "prefix")
    of_heads = long_lists(heads.select(F.explode("prefix").alias("t"), F.lit(1).alias("m")))
    few = shelf.put(reordered(heads, late_shingles(of_heads), percent).filter("prefix IS NULL").select("doc_id"))
    wholes = shelf.put(sets(picked(docs, few), words))
    late = late_shingles(of_heads, long_lists(counted(wholes)))
    ordered = shelf.put(reordered(heads, late, percent))
    lacking = ordered.filter("prefix IS NULL").select("doc_id", "n")
    more = shelf.put(lacking.select("doc_id").join(few, "doc_id", "left_anti"))
    have = wholes if more.isEmpty() else wholes.union(shelf.put(sets(picked(docs, more), words)))
    # an id that repeats may have several texts; the size tells the class's own
    own = lacking.join(have.withColumn("n", F.size("s").cast("long")), ["doc_id", "n"])
    again = shelf.put(reordered(own.select("doc_id", "n", F.col("s").alias("prefix")), late, percent).distinct())
    shelf.drop(reps, few, more)
    return ordered.filter("prefix IS NOT NULL").union(again), have


def reordered(heads: DataFrame, late: np.ndarray, percent: int) -> DataFrame:
    """Prefixes of heads or whole sets; null where a head doesn't hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, rare = [], []
            for n, head in zip(batch.column("n").to_pylist(), batch.column("prefix")):
                s, length = head.values.to_numpy(), prefix_length(n, percent)
                s = np.sort(s + _in(s, late) * LATE)
                prefixes.append(s[:length] if len(s) == n or s[length - 1] < LATE else None)
                rare.append(int(np.searchsorted(s[:length], LATE)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), _lists(prefixes), pa.array(rare, pa.int32())], ["doc_id", "n", "prefix", "u"])

    return heads.mapInArrow(run, "doc_id long, n long, prefix array<long>, u int")


def pairs_of(leaders: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b, na, nb, ra, rb), a < b: leaders with the entries of their lists that size, position and known answers allow, of other components.

    Lists are met by blocks of like size (powers of 100 / percent).  The position of a leader's entry bounds what can follow it in
    common, and so the size of a partner: blocks that lie beyond are skipped, and never read.  Of two classes that were both
    compared with a third, at most so much is in common as each has in common with it, and as each has beside it.
    """
    block = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    n1, p1 = F.col("n"), F.col("pos")
    most = F.least(n1 * 100 / percent, (n1 - p1) * ((100 + percent) / percent) - n1)
    blocks = F.sequence(block(n1 * percent / 100), F.greatest(block(most), block(n1 * percent / 100)))
    led = leaders.select("t", F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("root").alias("r1"), F.col("ref").alias("ref1"), F.col("over").alias("over1"), F.explode(blocks).alias("block"))
    met = members.withColumn("block", block(F.col("n"))).join(led, ["t", "block"])
    room = F.least(F.col("n") - F.col("pos"), F.col("n1") - F.col("p1"))
    known = F.least("over", "over1") + F.least(F.col("n") - F.col("over"), F.col("n1") - F.col("over1"))
    derived = F.coalesce((F.col("ref") != F.col("ref1")) | (known >= needed(F.col("n"), F.col("n1"), percent)), F.lit(True))
    able = (F.least("n", "n1") * 100 >= F.greatest("n", "n1") * percent) & (room >= needed(F.col("n"), F.col("n1"), percent)) & derived
    met = met.filter((F.col("root") != F.col("r1")) & able & (~F.col("leads") | (F.col("c") < F.col("c1"))))
    first = F.col("c") < F.col("c1")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.select(pick("c", "c1", "a"), pick("c1", "c", "b"), pick("n", "n1", "na"), pick("n1", "n", "nb"), pick("root", "r1", "ra"), pick("r1", "root", "rb")).distinct()


def bounded(met: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs that the prefixes leave possible: common shingles up to the lesser last prefix shingle, and at most all that follow it."""
    prefix = reps.select("doc_id", "prefix")
    both = met.join(prefix.select(F.col("doc_id").alias("a"), F.col("prefix").alias("pa")), "a").join(prefix.select(F.col("doc_id").alias("b"), F.col("prefix").alias("pb")), "b")
    last = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
    upto = lambda p: F.filter(p, lambda x: x <= F.col("last"))
    cut = both.withColumn("last", last).select(*met.columns, upto("pa").alias("pa"), upto("pb").alias("pb"))
    most = F.size(F.array_intersect("pa", "pb")) + F.least(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    return cut.filter(most >= needed(F.col("na"), F.col("nb"), percent)).select(*met.columns)


def overlaps(met: DataFrame, have: DataFrame) -> DataFrame:
    """The pairs with the number of shingles their sets have in common."""
    size = F.size("s").cast("long")
    both = met.join(have.select(F.col("doc_id").alias("a"), size.alias("na"), F.col("s").alias("sa")), ["a", "na"])
    both = both.join(have.select(F.col("doc_id").alias("b"), size.alias("nb"), F.col("s").alias("sb")), ["b", "nb"])
    return both.select(*met.columns, F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))


def named_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a null id is replaced by a number below LEAST_ID that follows from the text."""
    stand_in = F.lit(LEAST_ID) - 1 - F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("doc_id"), "text")


def own_id(name: str = "doc_id") -> Column:
    return F.when(F.col(name) >= LEAST_ID, F.col(name))


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    shelf, texts = Shelf(docs.sparkSession), named_rows(docs)
    rows = shelf.put(summaries(texts, None, words, percent))
    # rows of an id that repeats are held together by it; texts of equal sets by the set
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("c"), F.min(own_id()).alias("least"))
    classes = shelf.put(classes)
    one = rows.filter("n > 0").join(classes, "digest").filter(F.col("doc_id") == F.col("c")).dropDuplicates(["digest"])
    reps = shelf.put(one.select("doc_id", "n", "prefix"))
    names = shelf.put(rows.select("doc_id", "n", "digest"))  # heads are the bulk of the rows, and only the classes' are needed on
    shelf.drop(rows)
    roots = linked_classes(texts, reps, shelf, words, percent)
    top = classes.join(roots, F.col("c") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "c").alias("root"))
    top = top.join(top.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "component_id")
    named = names.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(top, "digest", "left")
    return named.select(own_id().alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), own_id()).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, all columns as they are: one row of each component, that of the least id.

    Components are those of rows, so one id may stand for several texts.  A null id stays if no other is there; of rows that share the
    least id, or have none, the first by its row key stays.
    """
    rows, row = with_row_keys(docs, Shelf(docs.sparkSession))
    found = join_components(rows.select(F.col(row).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    stay = found.join(ids, "row").groupBy("component_id").agg(first).select(F.col("first.row").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)
