"""Embedding near-dedup and hard-negative mining: against brute-force versions."""

import math

import numpy as np
import pytest

from demandlens.llm import covertree, negatives


def vectors_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int") if rows else spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", *(f"'x' AS {n}" for n in ("k", "v", "c", "score", "block", "anchor_id", "weight", "root"))) if extra else df


def cluster(rng, d, m, spread):
    """m vectors in a chain or a ball, of any length."""
    at, out = rng.normal(size=d), []
    for _ in range(m):
        at = at + rng.normal(size=d) * spread * (rng.random() < 0.5)
        out.append((at + rng.normal(size=d) * spread) * rng.choice([0.01, 1, 100]))
    return out


def brute_links(rows, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    width = max([len(v) for (_, v, _), o in zip(rows, ok) if o], default=1)
    unit = np.array([np.pad(np.float32(v).astype(float), (0, width - len(v))) if o else np.zeros(width) for (_, v, _), o in zip(rows, ok)]).reshape(-1, width)
    unit = np.array([u / np.linalg.norm(u / abs(u).max()) / abs(u).max() if u.any() else u for u in unit])
    links = (unit @ unit.T >= cosine) & np.array(ok)[:, None] & np.array(ok)[None]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in np.flatnonzero(links[i]):
                low = min(root[i], root[j])
                if root[i] != low or root[j] != low:
                    root[i] = root[j] = low
                    changed = True
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted((str(r[0]), int(links[i].sum() - links[i][i]), str(least.get(root[i])), r[0] == least.get(root[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize("rows_a_group,pivots", [(8192, 64), (40, 16), (25, 1)])
def test_near_copies(spark, rows_a_group, pivots):
    rng = np.random.default_rng(rows_a_group)
    found = [v for s in (0.0, 1e-9, 1e-3, 0.05, 0.08, 0.2) for v in cluster(rng, 16, 45, s)] + list(rng.normal(size=(150, 16)))
    rows = [(int(i), [float(x) for x in v], 1) for i, v in zip(rng.permutation(len(found)), found)]
    rows += [(1000 + i, rows[5][1], 2) for i in range(60)] + [(1000, rows[5][1], 2), (1001, rows[300][1], 2), (None, rows[300][1], 2), (None, [9.0] + [0.0] * 15, 2)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None] * 8, 1), (2004, [float("inf")] * 16, 1), (2005, [], 1), (2006, [1.0], 1), (2007, [1e30] * 16, 1), (2008, [1e-30] * 16, 1), (None, None, 1)]
    got = covertree.near_copies(vectors_of(spark, rows), rows=rows_a_group, pivots=pivots)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got.collect()) == brute_links(rows, 0.95)


def test_near_copies_of_nothing(spark):
    assert covertree.near_copies(vectors_of(spark, [])).collect() == []
    assert [tuple(r) for r in covertree.near_copies(vectors_of(spark, [(3, None, 1)])).collect()] == [(3, 0, 3, True)]
    assert [tuple(r) for r in covertree.near_copies(vectors_of(spark, [(3, [1.0, 0.0], None)])).collect()] == [(3, 0, 3, True)]


def test_trees_prune_and_count_whole_nodes(monkeypatch):
    """A group of 3,000 near copies among 3,000 far ones: nodes are counted whole and most pairs are never decided one by one."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=24) + rng.normal(size=(3000, 24)) * 1e-3, rng.normal(size=(3000, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen = []
    real = covertree._sorted_out
    monkeypatch.setattr(covertree, "_sorted_out", lambda a, b, pairs, *rest: (seen.append(pairs.shape[1]), real(a, b, pairs, *rest))[1])
    tree = covertree.CoverTree(x, np.ones(len(x)))
    counts, _, links = covertree.linked(tree, tree, 0.95)
    assert (counts == (x @ x.T >= 0.95).sum(axis=1)).all() and covertree.forest(links, len(x)).shape[1] >= 2999
    assert sum(seen) < 400_000  # of 36 million


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.CoverTree(x, np.ones(400))
    for i in range(1, 400):
        k, p = tree.level[i], tree.parent[i]
        assert tree.level[p] < k and np.linalg.norm(x[i] - x[p]) <= 2.0 ** (2 - k) + 1e-4 or k == tree.depth
    for k in range(1, tree.depth):
        nodes = np.flatnonzero(tree.level <= k)
        far = np.linalg.norm(x[nodes][:, None] - x[nodes][None], axis=2) + np.eye(len(nodes)) * 9
        assert far.min() >= 2.0 ** (1 - k) - 1e-4 or 2.0 ** (1 - k) < covertree.LEAST_RADIUS
    assert tree.weight[0][0] == 400


def brute_negatives(rows):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max((len(r[1]) for r in ok), default=0)
    whole = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (width - len(v))) for i, v, label in ok]
    out = []
    anchors = {(i, label, tuple(v)) for i, label, v in whole if i % 100 == 0}
    for a, label, v in anchors:
        score = lambda r: sum(p * q for p, q in zip(v, r[2]))  # noqa: B023, E731
        same = sorted((-score(r), r[0]) for r in whole if r[1] == label and r[0] != a)[:5]
        other = sorted((-score(r), r[0]) for r in whole if r[1] != label)
        for p, i in set(same):
            fit = [(s, j) for s, j in other if 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("rows_a_block,scale", [(8192, 1.0), (50, 1.0), (70, 1e6), (64, 1e-3)])
def test_hard_negatives(spark, rows_a_block, scale):
    rng = np.random.default_rng(7)
    base = np.concatenate([rng.normal(size=(300, 8)), np.round(rng.normal(size=(200, 8)) * 2) / 4, rng.normal(size=8) + rng.normal(size=(120, 8)) * 0.05])
    rows = [(i, [float(x) for x in base[i] * scale], int(rng.integers(0, 10))) for i in range(len(base))]
    rows += [(100, rows[100][1], rows[100][2]), (103, rows[103][1], rows[103][2]), (200, rows[1][1], 3), (900, [0.0] * 8, 4), (1000, [1.0], 4), (1100, [], 4), (1200, None, 4), (1300, [1.0] * 8, None), (None, [1.0] * 8, 1), (1400, [float("nan")] * 8, 1), (1401, [None] * 8, 1)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(vectors_of(spark, rows), rows=rows_a_block).collect())
    assert got == brute_negatives(rows) and (len(got) > 20 or scale < 1)


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(vectors_of(spark, [])).collect() == []
    assert negatives.hard_negatives(vectors_of(spark, [(100, [1.0, 2.0], 1)])).collect() == []


def test_threshold_stops_early():
    """With a few rows far out, most rows are never come upon, and results are those of a full scan."""
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 50, size=(20_000, 3)).astype(float)
    x[:9] *= 20
    lists, read = negatives.SortedLists(x), []
    real = lists.access
    lists.access = lambda anchor, first, last: (read.append(last), real(anchor, first, last))[1]
    anchor = np.array([3.0, -2.0, 5.0])
    got = lists.search(anchor, np.ones(len(x), bool), [(None, None)], 5, np.arange(len(x)))
    scores = x @ anchor
    assert [r for _, r, _ in got] == list(np.lexsort((np.arange(len(x)), -scores))[:5]) and max(read) < 2000
