"""The pipeline's stages: rows that repeat, null ids, one id for several texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_set_operators import shingle_set

import corpus_pipeline
from demandlens.llm import exact, jaccard, language, mixing, packing

ONE, TWO = "red green blue black white grey", "a b c d e f g h i j"
#: A row that repeats, null ids, an id for two texts, and a null text.
ROWS = [*[(7, ONE, "en", "s")] * 3, (None, ONE, "en", "s"), (None, TWO, "en", "s"), (None, TWO, "en", "s"), (5, "one two three", None, "s"), (5, "four five six seven", None, "s"), (4, None, None, "s")]


def told(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(params=["table", "frame"])
def docs(request, spark, docs_of, tmp_path):
    made = docs_of(ROWS).repartition(3)
    if request.param == "frame":
        return made
    made.write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_language_keeps_every_row_by_its_own_text(docs, monkeypatch):
    monkeypatch.setattr(language, "answers", lambda batch, lettered, model: (["en"] * len(batch), np.array([0.1 if "five" in (t.as_py() or "five") else 0.9 for t in batch.column("text")])))
    got = language.accepted(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    assert told(got) == Counter((i, t) for i, t, *_ in ROWS if t and "five" not in t)


def test_exact_keeps_one_row_of_each_text(docs):
    got = exact.deduplicated(docs)
    assert got.columns == docs.columns
    assert told(got) == Counter([(7, ONE), (None, TWO), (5, "one two three"), (5, "four five six seven"), (4, None)])


def test_jaccard_keeps_one_row_of_each_component(docs):
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    assert told(got) == Counter([(7, ONE), (None, TWO), (5, "one two three"), (5, "four five six seven"), (4, None)])


def test_mixed_copies_every_row_for_itself(docs):
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    # one source of weight 5: each word is taken once, so every row that has words comes once
    assert Counter({k: n for k, n in told(got).items() if k[1]}) == Counter((i, t) for i, t, *_ in ROWS if t)


def test_a_file_read_twice_has_different_row_keys(spark, docs_of, tmp_path):
    from demandlens.llm.common import Shelf, with_row_keys

    path = str(tmp_path / "docs")
    docs_of(ROWS).repartition(2).write.parquet(path)
    rows, row = with_row_keys(spark.read.parquet(path, path), Shelf(spark))
    assert rows.select(row).distinct().count() == rows.count() == 2 * len(ROWS)


def test_stages_one_by_one_against_plain_python(spark, docs_of, tmp_path):
    """Each stage on what the stage before wrote, with copies, near copies, repeated rows, null ids and extra columns."""
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = []
    for g in range(12):
        base = text(rng.choice([8, 60, 200]))
        rows += [(10 * g, base, rng.choice(["en", "de"]), rng.choice(["s1", "s2", None])), (10 * g + 1, base.upper(), "en", "s1"), (10 * g + 2, base + " " + text(1), "de", "s2")]
    rows += [rows[0]] * 3 + [rows[4]] * 2 + [(None, rows[7][1], "en", "s1"), (None, text(30), "en", "s3"), (20, text(40), "de", "s2"), (999, "12 34", "en", "s1"), (998, None, None, "s1")]
    rng.shuffle(rows)

    def components(kept):
        root = list(range(len(kept)))
        sets = [shingle_set(r.text, 5) for r in kept]
        for i in range(len(kept)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    old, new = root[i], root[j]
                    root = [new if x == old else x for x in root]
        return root

    def shown(rs):
        return Counter(tuple(r) for r in rs)

    df, n = docs_of(rows).repartition(3), 0
    for name, stage in corpus_pipeline.STAGES:
        df.write.parquet(str(tmp_path / str(n)))
        before = spark.read.parquet(str(tmp_path / str(n)))
        had, n = before.collect(), n + 1
        df = stage(spark, before, "")
        got = df.collect()
        if name != "packing":
            assert df.columns == before.columns and not shown(got).keys() - shown(had).keys()
        if name == "language_id":
            # the network's answer is the only thing taken from it; every row is judged by its text
            told_of = Counter((r.doc_id, r.lang_pred != "und" and r.score >= 0.5) for r in language.predict(before, language.fit(before)).collect())
            assert Counter(r.doc_id for r in got) == Counter({i: c for (i, ok), c in told_of.items() if ok})
            assert all(any(c.isalpha() for c in r.text) for r in got)
        elif name in ("exact_dedup", "jaccard_join"):
            groups = defaultdict(list)
            for r, key in zip(had, [r.text.lower() for r in had] if name == "exact_dedup" else components(had), strict=True):
                groups[key].append(r)
            known = [[r.doc_id for r in g if r.doc_id is not None] for g in groups.values()]
            best = max if name == "exact_dedup" else min
            assert Counter(r.doc_id for r in got) == Counter(best(k, default=None) for k in known) and len(got) == len(groups)
        elif name == "source_mix":
            sizes = Counter()
            for r in had:
                sizes[r.source] += len(r.text.split())
            want = mixing.targets(list(sizes.items()))
            taken = Counter()
            for r in got:
                taken[r.source] += len(r.text.split())
            longest = max(len(r.text.split()) for r in had)
            assert all(abs(taken[s] - want[s]) <= longest for s in sizes) and max(shown(got).values()) <= 3 * max(shown(had).values())
        else:
            import zlib

            encode = packing.encoder(packing.vocabulary()).encode_ordinary
            total = sum(len(encode(r.text)) + 1 for r in had)
            assert sum(r.length for r in got) == total and {r.doc_id for r in got} == {r.doc_id for r in had}
            whole = {(r.doc_id, zlib.crc32(np.array([*encode(r.text), packing.END], "<u4").tobytes())) for r in had}
            assert all((r.doc_id, r.ids_crc32) in whole for r in got if r.length == r.doc_tokens)
