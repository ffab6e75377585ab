"""Quality classifier: a byte-level convolutional network over overlapping chunks of the whole document.

Filters answer at every byte, each chunk keeps its maxima, the maxima of all chunks of a document are averaged, and one dense layer
turns them into one probability of label 1.

Defined results: a null text counts as empty; the empty text is scored as one chunk of zero bytes.  Without labels of both kinds the
score is their share (0.5 without any).  Repeated rows give repeated results, a null id is never held out, labels that repeat for
an id count as they stand, and other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm import bytenet
from demandlens.llm.common import batches_of, remainder, text_bytes

WIDTHS, FILTERS = (3, 4, 5), 12
CHUNK, OVERLAP = 512, 64
#: At most so many labelled documents are fitted on, and chunks cut from each.
SAMPLE_ROWS, SAMPLE_CHUNKS = 3000, 4
#: Steps of training, in batches of BATCH documents; a small sample is gone through MOST_EPOCHS times at most.
STEPS, BATCH, MOST_EPOCHS = 750, 32, 20
HELD_OUT_OF, HELD_OUT = 4, 2
CUT = 0.7


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, quality, parts): the labelled documents first by a hash of their id, each cut to ``SAMPLE_CHUNKS`` pieces at even distances."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT))
    chosen = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.length(text)
    step = max(1, SAMPLE_CHUNKS - 1)
    parts = F.array(*[F.substring(text, (F.greatest(size - CHUNK, F.lit(0)) * (k / step)).cast("int") + 1, F.lit(CHUNK)) for k in range(SAMPLE_CHUNKS)])
    return docs.select("doc_id", parts.alias("parts")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11) -> bytenet.Net:
    """Train on the driver; what is collected is bounded by ``rows`` documents of ``SAMPLE_CHUNKS`` x ``CHUNK`` characters."""
    sample = sorted((r.doc_id, r.quality, list(r.parts)) for r in labelled_sample(docs, labels, rows).collect())
    x = np.zeros((len(sample), SAMPLE_CHUNKS, CHUNK), np.uint8)
    weight = np.zeros((len(sample), SAMPLE_CHUNKS))
    for i, (_, _, parts) in enumerate(sample):
        for k, part in enumerate(dict.fromkeys(parts)):  # a short text is one piece
            raw = np.frombuffer(part.encode()[:CHUNK], np.uint8)
            x[i, k, : len(raw)] = raw
            weight[i, k] = 1
    weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1)
    y = np.array([q for _, q, _ in sample], np.intp)
    net = bytenet.new_net(WIDTHS, FILTERS, 2, seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    net.offset[:] = [np.log(1 - share), np.log(share)]
    if len(set(y.tolist())) < 2:
        net.dense[:] = 0
        return net
    epochs = min(MOST_EPOCHS, max(1, STEPS * BATCH // len(y)))
    return bytenet.train(net, x, y, weight, epochs, BATCH, 0.01, seed)


def score(docs: DataFrame, net: bytenet.Net) -> DataFrame:
    """(doc_id, score): probability of label 1 over all chunks of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 8 << 20):
            data, at = text_bytes(batch.column("text"))
            total, count = np.zeros((len(batch), len(net.dense))), np.zeros(len(batch))
            for doc, x in bytenet.windows(data, at, CHUNK, CHUNK - OVERLAP):
                filled = np.maximum((x != 0).sum(axis=1), 1)  # a short last chunk counts as much as it holds
                np.add.at(total, doc, bytenet.pooled(net, x) * filled[:, None])
                np.add.at(count, doc, filled)
            p = bytenet.softmax(total / count[:, None] @ net.dense + net.offset)[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    found = score(docs, fit(docs, labels))
    held = remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
