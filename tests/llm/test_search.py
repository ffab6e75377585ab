"""Ranked lexical search: against a brute-force version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from demandlens.llm import treap

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    words = [(i, terms_of(t)) for i, t in docs]
    words = [(i, w, Counter(w)) for i, w in words if w]
    n, length, df = len(words), sum(len(w) for _, w, _ in words), Counter(t for _, _, c in words for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, w, c in words:
            m = 75 + 25 * len(w) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(str(item), r + 1, str(i), -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:20])]
    return sorted(out)


@pytest.mark.parametrize("range_docs,items_a_block", [(1 << 16, 2000), (4096 + 30, 2)])
def test_ranked(spark, docs_of, monkeypatch, range_docs, items_a_block):
    monkeypatch.setattr(treap, "RANGE_DOCS", range_docs)
    monkeypatch.setattr(treap, "ITEMS", items_a_block)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioßñक") for _ in range(rng.choice([1, 2, 3]))) for _ in range(120)] + ["The", "x-y", "a_b", "7", "Ä", "don't"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([8, 40, 126])]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 10, 60]))) for i in range(400)] + [(500, None), (501, ""), (502, "--- !"), (503, text(20_000)), (504, "the"), (504, "the"), (None, "the the"), (None, None)] + [(600 + i, "same text the") for i in range(40)]
    items = [(i, text(n)) for i, n in enumerate([1, 5, 40, 40, 300])] + [(7, None), (8, "unknownterm"), (9, "THE the"), (9, "the"), (None, "same"), (10, "!!")]
    got = treap.ranked(docs_of(docs), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS item"))
    assert sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in got.collect()) == brute(docs, items)


def test_ranked_without_rows(spark, docs_of):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treap.ranked(docs_of([]), items).collect() == [] and treap.ranked(docs_of([(1, None)]), items).collect() == []
    assert treap.ranked(docs_of([(1, "a")]), items.limit(0)).collect() == []


def test_descent_skips_most_ranges(monkeypatch):
    """Documents with large impacts are found without coming upon the others."""
    rng = np.random.default_rng(3)
    n = 1 << 15
    rows, columns = np.repeat(np.arange(6), n), np.tile(np.arange(n), 6)
    values = rng.integers(1, 50, size=len(rows))
    values[rng.integers(0, len(rows), size=60)] += 5000
    tree = treap.Treap(rows, columns, values, 15)
    seen = []
    real = np.lexsort
    monkeypatch.setattr(treap.np, "lexsort", lambda keys: (seen.append(len(keys[0])), real(keys))[1])
    got, sums = tree.best(np.arange(6), np.array([1, 2, 1, 1, 3, 1]), 20)
    full = (values.reshape(6, n) * np.array([1, 2, 1, 1, 3, 1])[:, None]).sum(axis=0)
    expect = real((np.arange(n), -full))[:20]
    assert (got == expect).all() and (sums == full[expect]).all() and sum(seen) < n / 2  # of 2 n nodes
