"""Language ID and quality: held-out accuracy, and defined results on hard rows."""

import numpy as np
import pytest

from demandlens.llm import bytenet, language, quality
from demandlens.llm.common import read_table

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = read_table(spark, SF, "documents")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert len(held) > 200 and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_quality_held_out(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    pairs = [(a, b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert sum(a > b for a, b in pairs) >= 0.95 * len(pairs)
    assert sum(s >= quality.CUT for s, q in held if q == 1) >= 0.95 * sum(q == 1 for _, q in held)


def test_hard_rows(spark, docs_of):
    rows = [(i, f"{'das und ist ' if i % 2 else 'the and that '}" * 9, "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", None), (103, "und das " * 40_000, None), (104, "the the", None), (104, "the the", None), (None, "das", None)]
    got = language.identify(docs_of(rows)).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) and (by[100], by[101], by[102], by[103]) == ("und", "und", "und", "de")
    assert all((r.score == 0) == (r.lang_pred == "und") and 0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in language.identify(docs_of([(1, "some text")])).collect())
    assert language.identify(docs_of([])).collect() == []


@pytest.mark.parametrize("labelled", [[], [(1, 1, 0)]])
def test_quality_without_both_labels(spark, docs_of, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = quality.classify(docs_of([(1, "a text"), (2, None), (None, ""), (3, "x" * 100_000)]), labels).collect()
    assert len(got) == 4 and len({round(r.score, 6) for r in got}) == 1


def naive_features(net, window):
    """Filters at every position of one window, one product after the other; ReLU; the largest of each."""
    out = []
    for table, bias in zip(net.tables, net.bias):
        width, _, filters = table.shape
        for f in range(filters):
            answers = [sum(table[j, window[at + j], f] for j in range(width)) + bias[f] for at in range(len(window) - width + 1)]
            out.append(max(0.0, max(answers)))
    return np.array(out)


def test_convolution_against_a_naive_one():
    rng = np.random.default_rng(4)
    net = bytenet.new_net((2, 3, 5), 3, 2, seed=1)
    for b in net.bias:
        b += rng.normal(size=b.shape).astype(np.float32)
    x = rng.integers(0, 256, size=(7, 40)).astype(np.uint8)
    assert np.allclose(bytenet.pooled(net, x), [naive_features(net, w) for w in x], atol=1e-4)


def test_windows_cover_whole_texts():
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 256, size=n).astype(np.uint8) for n in (0, 1, 63, 64, 65, 120, 121, 500, 70_000)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seen = [np.zeros(len(t), bool) for t in texts]
    places = [0] * len(texts)
    for docs, x in bytenet.windows(np.concatenate(texts), at, 64, 56):
        for d, w in zip(docs, x):
            start, t = places[d] * 56, texts[d]
            part = t[start : start + 64]
            assert (w[: len(part)] == part).all() and not w[len(part) :].any()
            seen[d][start : start + 64] = True
            places[d] += 1
    assert all(s.all() for s in seen) and places[0] == 1


def test_language_score_against_a_naive_one(spark, docs_of):
    """The whole way of one text: windows, filters, maxima, dense layer, mean by filled bytes, softmax."""
    rows = [(i, f"{'das und ist ' if i % 2 else 'the and that '}" * 9, "de" if i % 2 else "en") for i in range(60)]
    model = language.fit(docs_of(rows), epochs=2)
    text = "the und that " * 60 + "ß"
    got = language.predict(docs_of([(1, text)]), model).collect()[0]
    raw = np.frombuffer(text.encode(), np.uint8)
    total, count = 0, 0
    starts = range(0, max(1, len(raw) - language.OVERLAP), language.WINDOW - language.OVERLAP)
    for start in starts:
        window = np.zeros(language.WINDOW, np.uint8)
        part = raw[start : start + language.WINDOW]
        window[: len(part)] = part
        total = total + (naive_features(model.net, window) @ model.net.dense + model.net.offset) * len(part)
        count += len(part)
    z = np.exp(total / count - (total / count).max())
    assert got.score == pytest.approx(float((z / z.sum()).max()), abs=1e-4) and got.lang_pred == model.languages[int(z.argmax())]
