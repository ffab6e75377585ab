"""Language ID by a byte convolutional network trained in numpy on labelled text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing is labelled.  Ties of
the averaged answer go to the language first in code-point order.  Repeated rows give repeated results; a null id counts as a
remainder that is not held out; other columns of the input, whatever their names, are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm import bytenet
from demandlens.llm.common import batches_of, free_name, remainder, text_bytes

WIDTHS, FILTERS = (2, 3, 4), 16
WINDOW, OVERLAP = 512, 8
#: At most so many labelled rows are fitted on in all, and windows cut from each; the rest of training follows from these.
SAMPLE_ROWS, SAMPLE_WINDOWS = 2400, 2
HELD_OUT_OF, HELD_OUT = 3, 1


@dataclass
class LanguageModel:
    languages: list[str]
    net: bytenet.Net


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, part, k): at most ``rows`` labelled documents not held out, the same number of each language where there are enough.

    Languages with the most rows come first if there are more languages than ``rows``.  Documents are taken in the order of a hash of
    their id; each gives ``SAMPLE_WINDOWS`` pieces at even distances.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT))
    usable = usable.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not counts:
        return usable.select("lang", F.lit("").alias("part"), F.lit(0).alias("k")).limit(0)
    each = max(1, rows // len(counts))
    # rows whose hash is under a share of all hashes: twice as many as needed, so that few reach the exact cut
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (2.0 * each + 40) / r.n)) for r in counts], "lang string, share double")
    near = usable.join(F.broadcast(share), "lang").filter((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("share"))
    first = near.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.length("text")))).filter(F.col("at") <= each)
    size = F.length("text")
    pieces = [F.struct(F.lit(k).alias("k"), F.substring(F.col("text"), (F.greatest(size - WINDOW, F.lit(0)) * (k / max(1, SAMPLE_WINDOWS - 1))).cast("int") + 1, F.lit(WINDOW)).alias("part")) for k in range(SAMPLE_WINDOWS)]
    return first.select("lang", F.explode(F.array(*pieces)).alias("p")).select("lang", "p.part", "p.k")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = 10, seed: int = 7) -> LanguageModel:
    """Train on the driver; what is collected is bounded by ``rows`` pieces of ``SAMPLE_WINDOWS`` x ``WINDOW`` characters."""
    sample = sorted((r.lang, r.part, r.k) for r in labelled_sample(docs, rows).collect())
    languages = sorted({lang for lang, _, _ in sample})
    x = np.zeros((len(sample), 1, WINDOW), np.uint8)
    for i, (_, part, _) in enumerate(sample):
        raw = np.frombuffer(part.encode()[:WINDOW], np.uint8)
        x[i, 0, : len(raw)] = raw
    short = np.arange(len(x)) % 4 == 3  # a quarter is cut short, so that short texts are known too
    x[short, :, 64:] = 0
    y = np.array([languages.index(lang) for lang, _, _ in sample], np.intp)
    net = bytenet.new_net(WIDTHS, FILTERS, max(1, len(languages)), seed)
    if len(sample):
        bytenet.train(net, x, y, np.ones((len(x), 1)), epochs, 64, 0.01, seed)
    return LanguageModel(languages, net)


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def answers(batch: pa.RecordBatch, lettered: str, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of a batch; ``lettered`` is the column that says whether its text has a letter."""
    data, at = text_bytes(batch.column("text"))
    total, count = np.zeros((len(batch), max(1, len(model.languages)))), np.zeros(len(batch))
    for doc, x in bytenet.windows(data, at, WINDOW, WINDOW - OVERLAP):
        filled = (x != 0).sum(axis=1)  # a short last window counts as much as it holds
        np.add.at(total, doc, (bytenet.pooled(model.net, x) @ model.net.dense + model.net.offset) * filled[:, None])
        np.add.at(count, doc, filled)
    p = bytenet.softmax(total / np.maximum(count, 1)[:, None])
    best = p.argmax(axis=1)
    known = batch.column(lettered).to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
    return [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p.max(axis=1), 0.0)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score): the softmax of the mean answer over all windows of the whole text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2 << 20):
            names, top = answers(batch, "lettered", model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(top, pa.float64())], ["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter().alias("lettered"))
    return narrow.mapInArrow(score, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a network fitted on those not held out."""
    found = predict(docs, fit(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, whose language is told with a score of ``least`` or more.

    Those without a letter or of no clear language go.  Each row is judged by its own text and the answer stays with the row, so
    null ids, rows that repeat and one id for different texts make no difference.
    """
    model, lettered, columns = fit(docs), free_name(docs, "lettered"), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2 << 20):
            names, top = answers(batch, lettered, model)
            yield batch.filter(pa.array((np.array(names) != "und") & (top >= least))).select(columns)

    return docs.withColumn(lettered, has_letter()).mapInArrow(keep, docs.schema)
