"""Exact near-duplicate links of embeddings: dual traversal of cover trees.

Equal vectors become one class.  A bounded sample of classes gives the upper cells: every class belongs to the cell of its nearest pivot,
and cells, taken in the depth-first order of the pivots' own tree, are cut into groups of about ROWS classes (a hot cell fills several).
A class meets a group only if some cell there may reach it by its covering radius.  For each two groups that meet, one task builds a
cover tree of either side (nested levels, radii 2, 1, 1/2, ...) and walks both at once: a pair of nodes farther apart than both radii and
the threshold is pruned, a pair so near that all members must link is counted as a whole, other pairs go down one level, and pairs of
single vectors are decided by their cosine in doubles.

Tasks return counts by class and a spanning forest of the links they found, never the pairs, so a group of m near copies costs m rows a task.
The sample of pivots changes cost only.  Where distances are all alike (random directions in many dimensions) covering radii prune
little, and the work is that of all pairs of distinct vectors, as products of blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have 0 links and are their own component; shorter
vectors are compared as if filled up with zeros; rows that repeat an id are vectors of their own; a null id is a vector like others, but gives no
component its id (``component_id`` is null, and ``kept`` true, if no member has one); an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import Shelf
from demandlens.llm.components import components

COSINE = 0.95
#: Classes of a group, about: a task holds two groups.
ROWS = 8192
#: Bound of the sample of pivots; it is the only thing that the driver and all tasks hold.
PIVOTS = 1024
#: The last halved radius; below it all vectors are nodes of their own.
LEAST_RADIUS = 2.0**-6
#: Allowance of distance bounds for rounding: doubles, and 32-bit products that only prune.
CLOSE, ROUGH = 1e-7, 1e-4
#: Pairs of children from which on two nodes are met by a product of blocks, and what a single pair costs beside one in a product.
BROAD, SINGLE_COST = 4096, 20


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors in doubles, one a row, filled up with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        out = flat.reshape(-1, width).copy()
    else:
        out = np.zeros((len(lengths), width))
        out[np.arange(width) < lengths[:, None]] = flat
    if len(out):
        out /= np.abs(out).max(axis=1, keepdims=True)  # squares of very large or small components stay in range
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out


def distance(cosine: np.ndarray) -> np.ndarray:
    """Distance of unit vectors of the given cosine."""
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


class CoverTree:
    """A cover tree of unit vectors: ``level[i]`` is where vector i first is a node, below its ``parent[i]`` of the level above.

    A node goes on as its own first child.  ``radius[k][i]`` covers all vectors below node i of level k, ``weight[k][i]`` sums their weights.
    """

    def __init__(self, x: np.ndarray, weights: np.ndarray):
        self.x, n = x, len(x)
        self.rough = x.astype(np.float32)
        self.level, self.parent = np.zeros(n, np.int64), np.zeros(n, np.int64)
        near = np.full(n, -2.0, np.float32)  # about the largest cosine to a node so far, and that node
        owner = np.zeros(n, np.int64)
        rest = np.arange(1, n)
        self._meet(np.zeros(1, np.int64), rest, near, owner)
        radius, self.depth = 1.0, 0
        while len(rest):
            self.depth += 1
            self.parent[rest] = owner[rest]
            fresh = self._net(rest, radius, near, owner) if radius >= LEAST_RADIUS else rest
            self.level[fresh] = self.depth
            rest = rest[self.level[rest] == 0]
            radius /= 2
        self.apart = distance(np.einsum("ij,ij->i", x, x[self.parent]))  # in doubles: covering radii are measured, however nodes were chosen
        radii, weight = np.zeros(n), weights.astype(np.int64).copy()
        self.radius, self.weight, self.fresh = [radii.copy()], [weight.copy()], []
        for k in range(self.depth, 0, -1):
            new = np.flatnonzero(self.level == k)
            new = new[np.argsort(self.parent[new], kind="stable")]
            np.maximum.at(radii, self.parent[new], self.apart[new] + radii[new])
            np.add.at(weight, self.parent[new], weight[new])
            self.radius.insert(0, radii.copy())
            self.weight.insert(0, weight.copy())
            self.fresh.insert(0, new)

    def _meet(self, nodes: np.ndarray, others: np.ndarray, near: np.ndarray, owner: np.ndarray) -> None:
        """Tell ``others`` of the new ``nodes``."""
        for i in range(0, len(others), 4096):
            part = others[i : i + 4096]
            c = self.rough[part] @ self.rough[nodes].T
            at = c.argmax(axis=1)
            best = c[np.arange(len(part)), at]
            better = best > near[part]
            near[part[better]], owner[part[better]] = best[better], nodes[at[better]]

    def _net(self, rest: np.ndarray, radius: float, near: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Vectors of ``rest`` that become nodes, so that all others have a node within ``radius`` and nodes are farther apart."""
        reach, chosen = 1.0 - radius * radius / 2, []
        far = rest[near[rest] < reach]
        while len(far):
            batch = far[:256]
            close = self.rough[batch] @ self.rough[batch].T >= reach
            taken, free = [], np.ones(len(batch), bool)
            for i in range(len(batch)):
                if free[i]:
                    taken.append(i)
                    free &= ~close[i]
            nodes = batch[taken]
            chosen.append(nodes)
            near[nodes] = 2.0
            self._meet(nodes, rest[near[rest] < 2.0], near, owner)
            far = far[near[far] < reach]
        return np.concatenate(chosen) if chosen else rest[:0]

    def below(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For every node of level k, where its new children begin in ``fresh[k]``, and how many children it has, itself included."""
        n = len(self.x)
        if k >= self.depth:
            return np.zeros(n, np.int64), np.ones(n, np.int64)
        new = np.bincount(self.parent[self.fresh[k]], minlength=n)
        return np.cumsum(new) - new, new + 1

    def child(self, k: int, nodes: np.ndarray, begin: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The children of level k + 1 with the given numbers; a node is its own child 0."""
        new = self.fresh[k] if k < self.depth else np.zeros(0, np.int64)
        return np.where(number > 0, new[np.minimum(begin[nodes] + number - 1, len(new) - 1)], nodes) if len(new) else nodes

    def nodes_below(self, k: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes of level k + 1 below ``nodes`` of level k."""
        if k >= self.depth:
            return nodes
        above = np.zeros(len(self.x), bool)
        above[nodes] = True
        return np.concatenate([nodes, self.fresh[k][above[self.parent[self.fresh[k]]]]])

    def at(self, what: list[np.ndarray], k: int) -> np.ndarray:
        return what[min(k, self.depth)]

    def spread(self, added: dict[int, np.ndarray], joined: dict[int, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """What whole nodes were given, handed down to vectors: sums, and (vector, node) links of nodes whose members are connected."""
        n = len(self.x)
        sums, ties, links = np.zeros(n, np.int64), np.zeros(n, bool), []
        for k in range(self.depth + 1):
            sums += added.get(k, 0)
            ties |= joined.get(k, False)
            if k < self.depth:
                new = self.fresh[k]
                up = self.parent[new]
                sums[new] += sums[up]
                tied = new[ties[up]]
                ties[tied] = True
                links.append(np.stack([tied, self.parent[tied]]))
        return sums, links


def linked(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights linked with each vector of ``a``, of ``b``, and links (two rows of numbers, those of ``b`` after ``a``'s) that connect what is linked."""
    reach, offset = float(distance(np.float64(cosine))), 0 if a is b else len(a.x)
    given: tuple[dict, dict, dict, dict] = ({}, {}, {}, {})
    links: list[np.ndarray] = []
    pairs = np.zeros((2, 1), np.int64)
    waiting = {0: [_sorted_out(a, b, pairs, 0, reach, cosine, given, links, offset)]}
    while waiting:
        k = min(waiting)
        met = np.concatenate(waiting.pop(k), axis=1)
        begin_a, many_a = a.below(k)
        begin_b, many_b = b.below(k)
        size = many_a[met[0]] * many_b[met[1]]
        kept = []
        for p, q in met[:, size >= BROAD].T:  # nodes with many children: products of blocks
            ca, cb, deep = a.nodes_below(k, np.array([p])), b.nodes_below(k, np.array([q])), k + 1
            while deep < max(a.depth, b.depth):
                la, lb = a.nodes_below(deep, ca), b.nodes_below(deep, cb)
                if len(la) * len(lb) * (1 - SINGLE_COST * _undecided(a, b, ca, cb, deep, reach)) > len(ca) * len(cb):
                    break  # else a product one level down costs less than to follow what this one leaves open
                ca, cb, deep = la, lb, deep + 1
            rb = b.at(b.radius, deep)
            for part in (cb[rb[cb] == 0], cb[rb[cb] > 0]):
                for found in _near(a, b, ca, part, a.at(a.radius, deep), rb, reach) if len(part) else ():
                    waiting.setdefault(deep, []).append(_sorted_out(a, b, found, deep, reach, cosine, given, links, offset))
        met, size = met[:, size < BROAD], size[size < BROAD]
        ends = np.cumsum(size)
        start = 0
        while start < len(size):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 18), side="right")))
            p, q = met[:, start:end]
            of = np.repeat(np.arange(end - start), size[start:end])
            at = np.arange(len(of)) - (ends[start:end] - size[start:end] - (ends[start - 1] if start else 0))[of]
            wide = many_b[q][of]
            some = np.stack([a.child(k, p[of], begin_a, at // wide), b.child(k, q[of], begin_b, at % wide)])
            kept.append(_sorted_out(a, b, some, k + 1, reach, cosine, given, links, offset))
            start = end
        waiting.setdefault(k + 1, []).extend(kept)
        waiting = {level: parts for level, parts in waiting.items() if any(part.shape[1] for part in parts)}
    sums_a, more_a = a.spread(given[0], given[1])
    sums_b, more_b = b.spread(given[2], given[3]) if offset else (None, [])
    all_links = [*links, *more_a, *(m + offset for m in more_b)]
    return sums_a, sums_b, np.concatenate(all_links, axis=1) if all_links else pairs[:, :0]


def _undecided(a: CoverTree, b: CoverTree, ca: np.ndarray, cb: np.ndarray, k: int, reach: float) -> float:
    """About which share of the pairs of nodes of level k is neither too far apart nor near enough to count as a whole; from a few rows."""
    some = ca[:: max(1, len(ca) // 64)]
    d, r = distance(a.rough[some] @ b.rough[cb].T), a.at(a.radius, k)[some][:, None] + b.at(b.radius, k)[cb]
    return float(((d <= r + reach) & (d + r > reach) & (r > 0)).mean())


def _near(a: CoverTree, b: CoverTree, ca: np.ndarray, cb: np.ndarray, ra: np.ndarray, rb: np.ndarray, reach: float) -> list[np.ndarray]:
    """Pairs of nodes that covering radii can't part, by 32-bit products with an allowance; in tiles."""
    found, widest = [], rb[cb].max()
    step = max(1, (4 << 20) // len(cb))
    for i in range(0, len(ca), step):
        part = ca[i : i + step]
        least = 1.0 - np.minimum(ra[part] + widest + reach, 2.0) ** 2 / 2 - ROUGH
        x, y = np.nonzero(a.rough[part] @ b.rough[cb].T >= least[:, None].astype(np.float32))
        found.append(np.stack([part[x], cb[y]]))
    return found


def _sorted_out(a, b, pairs, k, reach, cosine, given, links, offset) -> np.ndarray:
    """The pairs of nodes of level k that must go on; those far apart go, those that link as a whole are noted."""
    kept = []
    for i in range(0, pairs.shape[1], 1 << 18):
        p, q = pairs[:, i : i + (1 << 18)]
        c = np.einsum("ij,ij->i", a.x[p], b.x[q])
        d, r = distance(c), a.at(a.radius, k)[p] + b.at(b.radius, k)[q]
        single = r == 0
        whole = np.where(single, c >= cosine, d + r <= reach - CLOSE)
        kept.append(np.stack([p, q])[:, ~whole & ~single & (d <= r + reach + CLOSE)])
        p, q = p[whole], q[whole]
        if len(p):
            _note(given, 0, a, p, b.at(b.weight, k)[q], k)
            if offset:
                _note(given, 2, b, q, a.at(a.weight, k)[p], k)
            else:
                _tie(given, 1, b, q, k)
            links.append(forest(np.stack([p, q + offset]), offset + len(b.x)))
    return np.concatenate(kept, axis=1) if kept else pairs[:, :0]


def _note(given, at: int, tree: CoverTree, nodes: np.ndarray, weights: np.ndarray, k: int) -> None:
    k = min(k, tree.depth)
    np.add.at(given[at].setdefault(k, np.zeros(len(tree.x), np.int64)), nodes, weights)
    _tie(given, at + 1, tree, nodes, k)


def _tie(given, at: int, tree: CoverTree, nodes: np.ndarray, k: int) -> None:
    given[at].setdefault(min(k, tree.depth), np.zeros(len(tree.x), bool))[nodes] = True


def forest(links: np.ndarray, n: int) -> np.ndarray:
    """(node, least node it is connected with) instead of any number of links among n nodes."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[links[0]], root[links[1]]), np.maximum(root[links[0]], root[links[1]])
        apart = low < high
        if not apart.any():
            moved = np.flatnonzero(root != np.arange(n))
            return np.stack([moved, root[moved]])
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def depth_first(tree: CoverTree) -> np.ndarray:
    """The vectors of a tree in an order in which everything below a node is together."""
    kids: dict[int, list[int]] = {}
    for i in np.lexsort((np.arange(len(tree.x)), tree.level))[1:]:
        kids.setdefault(int(tree.parent[i]), []).append(int(i))
    out, todo = [], [0]
    while todo:
        i = todo.pop()
        out.append(i)
        todo += kids.get(i, [])
    return np.array(out)


def cells(classes: DataFrame, pivots: np.ndarray, shelf: Shelf) -> DataFrame:
    """``classes`` (k, weight, v) with the number of their nearest pivot and the distance."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = unit(batch.column("v"), width) @ pivots.T
            at = c.argmax(axis=1)
            far = distance(c[np.arange(len(at)), at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "far"])

    kinds = dict(classes.dtypes)
    return shelf.put(classes.mapInArrow(run, f"k long, weight long, v {kinds['v']}, cell int, far double"))


def meetings(placed: DataFrame, pivots: np.ndarray, reach: float, rows: int) -> DataFrame:
    """(ga, gb, side, k, weight, v): classes with each pair of groups in which they may find a link."""
    found = {r.cell: (r.m, r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("m"), F.max("far").alias("far")).collect()}  # one row a pivot
    m = np.array([found.get(i, (0, 0.0))[0] for i in range(len(pivots))])
    radius = np.array([found.get(i, (0, -9.0))[1] for i in range(len(pivots))])
    start = np.cumsum(m) - m
    first, last, groups = start // rows, np.maximum(start + m - 1, start) // rows, int((m.sum() - 1) // rows) + 1
    group, width = np.arange(groups), pivots.shape[1]
    begin, end = np.searchsorted(last, group), np.searchsorted(first, group, side="right")  # the cells of each group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, (2 << 20) // max(groups, len(pivots)))
            for i in range(0, len(whole), step):
                batch = whole.slice(i, step)
                far = distance(unit(batch.column("v"), width) @ pivots.T)
                many = np.zeros((len(batch), len(pivots) + 1), np.int32)
                np.cumsum(far <= radius + reach + CLOSE, axis=1, out=many[:, 1:], dtype=np.int32)
                x, g = np.nonzero(many[:, end] > many[:, begin])
                at = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(batch)))]).astype(np.int32)
                cell, draw = batch.column("cell").to_numpy(), batch.column("draw").to_numpy()
                own = np.minimum(start[cell] + np.floor(draw * m[cell]).astype(np.int64), start[cell] + m[cell] - 1) // rows
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("weight"), batch.column("v"), pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(g.astype(np.int32)))], ["k", "weight", "v", "own", "wanted"])

    drawn = placed.withColumn("draw", F.xxhash64(F.lit(11), "k") / F.lit(2.0**64) + 0.5)
    met = drawn.mapInArrow(run, f"k long, weight long, v {dict(placed.dtypes)['v']}, own int, wanted array<int>")
    met = met.select("k", "weight", "v", "own", F.explode("wanted").alias("other"))
    return met.select(F.least("own", "other").alias("ga"), F.greatest("own", "other").alias("gb"), (F.col("own") > F.col("other")).alias("side"), "k", "weight", "v")


def answers(met: DataFrame, width: int, cosine: float) -> DataFrame:
    """(a, b, links): with b null, the weight that class a is linked with in one meeting; else two classes that are connected."""

    def run(table: pa.Table) -> pa.Table:
        side, k, weights = table["side"].to_numpy(), table["k"].to_numpy(), table["weight"].to_numpy()
        if table["ga"][0].as_py() == table["gb"][0].as_py():
            tree = CoverTree(unit(table["v"], width), weights)
            counts, _, found = linked(tree, tree, cosine)
            ids = k
        elif side.all() or not side.any():
            return table.select(["k", "k", "weight"]).rename_columns(["a", "b", "links"]).slice(0, 0)
        else:
            x = unit(table["v"], width)
            one, two = np.flatnonzero(~side), np.flatnonzero(side)
            ca, cb, found = linked(CoverTree(x[one], weights[one]), CoverTree(x[two], weights[two]), cosine)
            counts, ids = np.concatenate([ca, cb]), k[np.concatenate([one, two])]
        trees = forest(found, len(ids))
        some = counts > 0
        n = int(some.sum())
        null = np.concatenate([np.ones(n, bool), np.zeros(trees.shape[1], bool)])
        return pa.table({
            "a": np.concatenate([ids[some], ids[trees[0]]]),
            "b": pa.array(np.concatenate([ids[some], ids[trees[1]]]), mask=null),
            "links": pa.array(np.concatenate([counts[some], np.zeros(trees.shape[1], np.int64)]), mask=~null),
        })

    return met.groupBy("ga", "gb").applyInArrow(run, "a long, b long, links long")


def near_copies(vectors: DataFrame, cosine: float = COSINE, rows: int = ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    shelf = Shelf(vectors.sparkSession)
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(F.col("embedding")), F.col("embedding")).alias("v"))
    grouped = named.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("c"), F.count("*").alias("weight"))
    classes = shelf.put(grouped.withColumn("k", F.monotonically_increasing_id()))
    bare = named.filter("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = classes.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return bare
    sample = classes.select("v", "k").orderBy(F.xxhash64(F.lit(5), "k"), "k").limit(pivots).select("v").toArrow()
    x = unit(sample["v"], width)
    x = x[depth_first(CoverTree(x, np.ones(len(x))))]
    placed = cells(classes.select("k", "weight", "v"), x, shelf)
    found = shelf.put(answers(meetings(placed, x, float(distance(np.float64(cosine))), rows), width, cosine))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
    edges = found.filter("b IS NOT NULL").select("a", "b")
    trees = components(edges, shelf)
    of_class = classes.select("k", "v", "c").join(trees.select(F.col("node").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = of_class.groupBy("root").agg(F.min("c").alias("component_id"))
    told = of_class.join(least, "root").join(counts, "k").select("v", "links", "component_id")
    same = F.col("vec_id").eqNullSafe(F.col("component_id"))
    return named.filter("v IS NOT NULL").join(told, "v").select("vec_id", (F.col("links") - 1).alias("n_links"), "component_id", same.alias("kept")).union(bare)
