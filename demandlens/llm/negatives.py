"""Hard-negative mining by the threshold algorithm over per-dimension sorted lists.

Candidates are dealt into blocks of about ROWS rows, anchors likewise; each pair of blocks is one task.  A task sorts its candidates once a
dimension and class of labels.  For an anchor it reads all lists at once, downwards where the anchor's component is positive and upwards
where it is negative (sorted access), scores the rows it comes upon in integers (random access), and stops once the threshold, the score of a row made of the values read
last, lies strictly below the kth score of every window, or below the window itself.  A first pass finds the positives, a second the
negatives in the window of each positive; what blocks return is at most k rows an anchor and window, and the best of them are ranked.

Defined results: rows with a null id, label or vector, an empty vector or a null or non-finite component take no part; rows that repeat an id are
candidates of their own, equal ones are one anchor, and other rows are those of another id; shorter vectors count as filled up with zeros; anchors without positives, and positives without negatives,
give no rows; an empty table gives none; other columns aren't read.  Scores must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import Shelf

#: Fixed values of the contract.
ANCHOR_EVERY, SHIFT_EVERY, LABELS, SCALE, LEAST_PERCENT, POSITIVES, NEGATIVES = 100, 7, 10, 256, 80, 5, 5
#: Candidates of a block, and anchors of a block, about.
ROWS = 8192
#: First depth of sorted access; it doubles until the threshold is low enough.
FIRST_DEPTH = 16


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): labels shifted, components as whole numbers."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(x) > 0)
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % SHIFT_EVERY == 0, F.pmod(label + 1, F.lit(LABELS))).otherwise(label)
    whole = F.transform(x, lambda c: F.floor(c * SCALE))
    return vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), whole.alias("x"))


def matrix(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """Whole numbers, one vector a row, filled up with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def exact_types(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in a type in which their inner products are exact: doubles if all fit, else 64-bit integers, else Python's."""
    most = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0) * max((abs(int(v)) for v in (y.min(initial=0), y.max(initial=0))), default=0) * max(1, x.shape[1])
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    return x.astype(kind), y.astype(kind)


class SortedLists:
    """Candidates in one order a dimension."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.argsort(x, axis=0, kind="stable").astype(np.int32)

    def threshold(self, anchor: np.ndarray, depth: int):
        """The score of a row made of the values at the given depth of every list: no row not yet come upon has more."""
        n = len(self.x)
        if depth >= n:
            return None
        at = np.where(anchor > 0, n - depth, depth - 1)
        values = self.x[self.order[at, np.arange(len(anchor))], np.arange(len(anchor))]
        return (values * anchor).sum()

    def access(self, anchor: np.ndarray, first: int, last: int) -> np.ndarray:
        """Rows at depths first to last - 1 of all lists."""
        up, down = self.order[first:last, anchor < 0], self.order[max(0, len(self.x) - last) : len(self.x) - first, anchor > 0]
        return np.concatenate([up.ravel(), down.ravel()])

    def search(self, anchor: np.ndarray, usable: np.ndarray, windows: list[tuple[int | None, int | None]], k: int, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, row, score): the first k usable rows of each window (least, most), by score, then id.

        Lists of dimensions in which the anchor is 0 add nothing to a score and are not read; a zero anchor comes upon all rows at once.
        """
        n = len(self.x)
        seen, best = np.zeros(n, bool), [(np.zeros(0, np.int64), np.zeros(0, self.x.dtype)) for _ in windows]
        if not anchor.any():
            seen[:] = True
            new, depth = np.flatnonzero(usable), n
        else:
            new, depth = None, min(FIRST_DEPTH, n)
        first = 0
        while True:
            if new is None:
                fresh = np.zeros(n, bool)
                fresh[self.access(anchor, first, depth)] = True
                fresh &= ~seen
                seen |= fresh
                new = np.flatnonzero(fresh & usable)
            scores = self.x[new] @ anchor
            low = self.threshold(anchor, depth)
            going = low is not None
            done = True
            for w, (least, most) in enumerate(windows):
                fits = np.ones(len(new), bool)
                if least is not None:
                    fits &= (scores >= least) & (scores <= most)
                rows, had = np.concatenate([best[w][0], new[fits]]), np.concatenate([best[w][1], scores[fits]])
                keep = np.lexsort((ids[rows], -had))[:k] if had.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (-had[i], ids[rows[i]]))[:k], np.int64)
                best[w] = rows[keep], had[keep]
                if going and not (len(keep) == k and low < had[keep[-1]]) and not (least is not None and low < least):
                    done = False
            if done or not going:
                return [(w, int(r), int(s)) for w, (rows, had) in enumerate(best) for r, s in zip(rows, had, strict=True)]
            first, depth, new = depth, min(2 * depth, n), None


def dealt(df: DataFrame, key: str, blocks: int) -> DataFrame:
    return df.withColumn("block", F.pmod(F.xxhash64(F.lit(3), key), F.lit(blocks)).cast("int"))


def side_by_side(anchors: DataFrame, candidates: DataFrame, anchor_blocks: int, candidate_blocks: int) -> DataFrame:
    """(ab, cb, a, vec_id, label, x, windows): anchors (``a`` given) and candidates (``a`` null) of each pair of blocks."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    led = dealt(anchors, "a", anchor_blocks).select(F.col("block").alias("ab"), every(candidate_blocks).alias("cb"), "a", "vec_id", "label", "x", "windows")
    nothing = F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>").alias("windows")
    met = dealt(candidates, "vec_id", candidate_blocks).select(every(anchor_blocks).alias("ab"), F.col("block").alias("cb"), F.lit(None).cast("long").alias("a"), "vec_id", "label", "x", nothing)
    return led.union(met)


FOUND = "a long, positive_id long, positive_score long, other_id long, score long"


def searched(pairs: DataFrame, width: int, same: bool) -> DataFrame:
    """FOUND rows of each pair of blocks: positives (``same``; no window) or negatives of each window."""
    k = POSITIVES if same else NEGATIVES

    def run(table: pa.Table) -> pa.Table:
        led = table["a"].is_valid().to_numpy()
        out: list[tuple] = []
        anchors, rows = table.filter(pa.array(led)), table.filter(pa.array(~led))
        if len(anchors) and len(rows):
            ax, x = exact_types(matrix(anchors["x"], width), matrix(rows["x"], width))
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            own, own_labels, keys, windows = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), anchors["a"].to_numpy(), anchors["windows"].to_pylist()
            if same:  # lists of one label only
                by_label = {label: np.flatnonzero(labels == label) for label in np.unique(own_labels)}
                lists = {label: SortedLists(x[at]) for label, at in by_label.items() if len(at)}
            else:
                whole = SortedLists(x)
            for i in range(len(keys)):
                if same:
                    if own_labels[i] not in lists:
                        continue
                    at = by_label[own_labels[i]]
                    for _, r, s in lists[own_labels[i]].search(ax[i], ids[at] != own[i], [(None, None)], k, ids[at]):
                        out.append((keys[i], None, None, ids[at[r]], s))
                elif windows[i]:
                    limits = [(-(-LEAST_PERCENT * w["positive_score"] // 100), w["positive_score"]) for w in windows[i]]
                    for w, r, s in whole.search(ax[i], labels != own_labels[i], limits, k, ids):
                        out.append((keys[i], windows[i][w]["positive_id"], windows[i][w]["positive_score"], ids[r], s))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array([None if v is None else int(v) for v in c], pa.int64()) for c in columns], names=["a", "positive_id", "positive_score", "other_id", "score"])

    return pairs.groupBy("ab", "cb").applyInArrow(run, FOUND)


def first_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group, with their ``rank`` (int)."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are rows whose id is divisible by 100."""
    shelf = Shelf(vectors.sparkSession)
    candidates = shelf.put(taking_part(vectors))
    n, width = candidates.agg(F.count("*"), F.max(F.size("x"))).first()
    anchors = candidates.filter(F.col("vec_id") % ANCHOR_EVERY == 0).dropDuplicates(["vec_id", "label", "x"])
    anchors = shelf.put(anchors.withColumn("a", F.monotonically_increasing_id()).withColumn("windows", F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>")))
    blocks, anchor_blocks = n // rows + 1, anchors.count() // rows + 1
    width = width or 0
    near = searched(side_by_side(anchors, candidates, anchor_blocks, blocks), width, same=True)
    positives = first_of(near, ["a"], POSITIVES).groupBy("a").agg(F.sort_array(F.collect_list(F.struct(F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("windows"))  # 5 at most
    led = shelf.put(anchors.drop("windows").join(positives, "a").select("a", "vec_id", "label", "x", "windows"))
    # repeated rows may be two positives of one id: windows of one id and score are searched once
    one = F.array_distinct("windows").alias("windows")
    found = searched(side_by_side(led.select("a", "vec_id", "label", "x", one), candidates, anchor_blocks, blocks), width, same=False)
    ranked = first_of(found, ["a", "positive_id", "positive_score"], NEGATIVES)
    return ranked.join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a").select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
