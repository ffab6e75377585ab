"""Ranked lexical search with K2-treaps over the term-document grid.

One pass over the documents counts words and keeps, of each whole text, the postings of the items' terms; corpus counts follow by
aggregation.  A second pass over the stored postings cuts the documents into ranges of bounded size.  In each range the grid of terms
(rows) and documents (columns), whose cells hold the impact of a term on a document's score, becomes a compressed quadtree: a node is a
square of cells that isn't empty, with the largest impact inside.  For an item, the paths of its terms' rows descend together: a state
is a range of documents with one node for each row; its bound is the sum of the nodes' largest impacts.  States are taken best first,
in strips, until no bound reaches the 20th score found.  The best of all ranges are ranked at the end.

Items are taken in blocks bounded by count and text, each with its own pass, so the vocabulary that tasks hold is bounded.

Defined results: null texts and texts without terms hold nothing and count neither in N nor as results; every row is a document of its
own, also where ids repeat or are null (null ids last among equal scores); every item row is an item of its own; items without known
terms give no rows; empty tables give none; other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import Shelf, batches_of

TOP = 20
#: Bounds of a block of items: rows, and bytes of text beyond which no more are added.
ITEMS, ITEM_BYTES = 2_000, 4 << 20
#: Bounds of a range of documents: documents, and postings beyond which no more are added.
RANGE_DOCS, RANGE_POSTINGS = 1 << 16, 2_000_000
#: States that descend together.
STRIP = 1024
#: Bytes between terms become spaces, A-Z small; all bytes of characters beyond ASCII belong to terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or b"").translate(_BYTES).split()


def blocks_of_items(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """(item_id, text) in blocks; the driver holds one block at a time."""
    block, held = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).toLocalIterator():
        block.append((r.item_id, bytes(r.text)))
        held += len(r.text)
        if len(block) >= ITEMS or held >= ITEM_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): rows with the count of terms ``n`` of a document and the arrays of its postings; a last row of each task has ``n`` null, and the
    number of its documents with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding = np.zeros(len(vocabulary), np.int64)
        number = vocabulary.get
        for batch in batches_of(batches, 4 << 20):
            sizes, at, rows, counts = [], [0], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                found = terms(text.as_py())
                many = Counter(map(number, found))
                many.pop(None, None)
                sizes.append(len(found))
                rows.append(np.fromiter(many.keys(), np.int32, len(many)))
                counts.append(np.fromiter(many.values(), np.int32, len(many)))
                at.append(at[-1] + len(many))
            row, tf, at = np.concatenate([*rows, np.zeros(0, np.int32)]), np.concatenate([*counts, np.zeros(0, np.int32)]), np.array(at, np.int32)
            holding += np.bincount(row, minlength=len(holding))
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (row, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])
        some = np.flatnonzero(holding)
        lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (some, holding[some])]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


class Treap:
    """A compressed quadtree over a grid of 2^h by 2^h cells, with the largest value of each node.

    ``top[k]`` has the largest value of each node of level k, ``kids[k]`` the numbers of its four children in level k + 1, -1 where empty.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int):
        self.height = height
        code = np.zeros(len(rows), np.int64)
        for b in range(height):
            code |= ((rows >> b) & 1) << (2 * b + 1) | ((columns >> b) & 1) << (2 * b)
        order = np.argsort(code, kind="stable")
        code, top = code[order], values[order]
        self.top, self.kids = [top], []
        for _ in range(height):
            up = code >> 2
            first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            kids = np.full((len(first), 4), -1, np.int32)
            kids[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code)))), code & 3] = np.arange(len(code))
            code, top = up[first], np.maximum.reduceat(top, first)
            self.top.insert(0, top)
            self.kids.insert(0, kids)

    def best(self, rows: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k columns of the largest sums of ``times`` the values in ``rows`` (0 never), largest first, then by column; and the sums."""
        columns, sums, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        states = [(0, np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32), np.array([int((self.top[0][0] * times).sum())]))]  # level, range, nodes, bound
        while states:
            pick = max(range(len(states)), key=lambda i: (states[i][3][0], states[i][0]))  # each strip is in descending order
            level, where, nodes, bound = states.pop(pick)
            open_ = int(np.searchsorted(-bound, -least, side="right"))
            if not open_:
                continue
            if open_ > STRIP:
                states.append((level, where[STRIP:open_], nodes[STRIP:open_], bound[STRIP:open_]))
                open_ = STRIP
            where, nodes = where[:open_], nodes[:open_]
            half = 2 * ((rows >> (self.height - level - 1)) & 1)
            there, down = nodes >= 0, self.kids[level]
            wide = [np.where(there, down[nodes, half + side], -1) for side in (0, 1)]
            nodes, where = np.concatenate(wide), np.concatenate([2 * where, 2 * where + 1])
            bound = (np.where(nodes >= 0, self.top[level + 1][nodes], 0) * times).sum(axis=1)
            order = np.lexsort((where, -bound))
            order = order[bound[order] >= least]
            if level + 1 < self.height:
                if len(order):
                    states.append((level + 1, where[order], nodes[order], bound[order]))
                continue
            columns, sums = np.concatenate([columns, where[order]]), np.concatenate([sums, bound[order]])
            keep = np.lexsort((columns, -sums))[:k]
            columns, sums = columns[keep], sums[keep]
            least = max(1, int(sums[-1])) if len(sums) == k else 1
        return columns, sums


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, n, column, term, tf) of ranges of bounded size; ids are in ascending order, -1 stands for none and comes last."""
    held: list[pa.RecordBatch] = []
    docs = many = 0

    def cut():
        table = pa.Table.from_batches(held)
        ids = table["doc_id"].fill_null(-1).to_numpy()
        null = table["doc_id"].is_null().to_numpy()
        order = np.lexsort((ids, null))
        lists = table["term"].combine_chunks()
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        lengths = np.diff(lists.offsets.to_numpy())
        return (table["doc_id"].take(pa.array(order)), table["n"].to_numpy()[order], np.repeat(column, lengths), lists.flatten().to_numpy(), table["tf"].combine_chunks().flatten().to_numpy())

    for batch in batches:
        for i in range(0, len(batch), 4096):
            part = batch.slice(i, 4096)
            held.append(part)
            docs, many = docs + len(part), many + len(part.column("term").flatten())
            if docs > RANGE_DOCS - 4096 or many >= RANGE_POSTINGS:
                yield cut()
                held, docs, many = [], 0, 0
    if held:
        yield cut()


def found(stored: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, docs: int, length: int) -> DataFrame:
    """(item, doc_id, score): the TOP of every range of documents for each query (numbers of terms, times)."""
    shared = stored.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        for ids, n, column, term, tf in ranges(batches):
            m = 75 + np.array([25 * int(x) * docs // length for x in n], np.int64)
            tf = tf.astype(np.int64)
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[column]))
            some = impact > 0
            height = max(1, int(max(len(weight) - 1, len(ids) - 1)).bit_length())
            tree = Treap(term[some].astype(np.int64), column[some], impact[some], height) if some.any() else None
            for item, (rows, times) in enumerate(asked):
                if tree is None or not len(rows):
                    continue
                at, score = tree.best(rows, times, TOP)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), item, np.int32)), ids.take(pa.array(at)).combine_chunks(), pa.array(score)], ["item", "doc_id", "score"])

    return stored.filter(F.col("n") > 0).mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of each row of ``items`` (item_id, text) by score above 0."""
    spark, shelf, out = docs.sparkSession, Shelf(docs.sparkSession), None
    for block in blocks_of_items(items):
        asked = [Counter(terms(text)) for _, text in block]
        vocabulary = {term: i for i, term in enumerate(sorted(set().union(*asked)))}
        stored = shelf.put(postings(docs, vocabulary))
        total = stored.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        n, length = total[0], total[1] or 1
        held = stored.filter("n IS NULL").select(F.explode(F.arrays_zip("term", "tf")).alias("x")).groupBy("x.term").agg(F.sum("x.tf").alias("df")).toArrow()  # one row a term of the block
        weights, df = np.zeros(len(vocabulary), np.int64), dict(zip(held["term"].to_pylist(), held["df"].to_pylist(), strict=True))
        for i, many in df.items():
            weights[i] = math.floor(1000 * math.log((2 * n + 2) / (2 * many + 1)))
        queries = []
        for counts in asked:
            known = sorted((vocabulary[t], c) for t, c in counts.items() if vocabulary[t] in df)
            queries.append((np.array([i for i, _ in known], np.int64), np.array([c for _, c in known], np.int64)))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = found(stored, queries, weights, n, length).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
        top = shelf.put(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # at most ITEMS names
        shelf.drop(stored)
        out = top if out is None else out.union(top)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
