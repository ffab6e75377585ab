"""A one-layer convolutional network over bytes in numpy: filters of several widths, ReLU, max pooling, one dense layer.

A filter of width w over one-hot bytes is w tables of 256 weights; its answer at a position is the sum of w table entries, so the
forward pass is table look-ups, and the gradient of max pooling reaches only the bytes under each maximum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Positions worked on at once; bounds memory and keeps the answers of one step in the processor's cache.
STEP = 32_768


@dataclass
class Net:
    """tables[k]: (width, 256, filters) of the k-th width; bias[k]: (filters,); dense: (filters of all widths, outputs)."""

    tables: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.bias, self.dense, self.offset]


def new_net(widths: tuple[int, ...], filters: int, outputs: int, seed: int) -> Net:
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
    dense = rng.normal(0, 0.1, (filters * len(widths), outputs)).astype(np.float32)
    return Net(tables, [np.zeros(filters, np.float32) for _ in widths], dense, np.zeros(outputs, np.float32))


def _answers(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(windows, positions, filters): the filters of one width at every position of the windows ``x``."""
    width, positions = len(table), x.shape[1] - len(table) + 1
    out = table[0].take(x[:, :positions], axis=0)
    for j in range(1, width):
        out += table[j].take(x[:, j : j + positions], axis=0)
    return out


def pooled(net: Net, x: np.ndarray) -> np.ndarray:
    """Max-pooled answers of all filters for the windows ``x`` of shape (windows, bytes)."""
    rows = max(1, STEP // x.shape[1])
    out = np.empty((len(x), len(net.dense)), np.float32)
    for i in range(0, len(x), rows):
        part = x[i : i + rows].astype(np.intp)
        out[i : i + rows] = np.concatenate([_answers(t, part).max(axis=1) + b for t, b in zip(net.tables, net.bias, strict=True)], axis=1)
    return np.maximum(out, 0, out=out)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, at: np.ndarray, length: int, stride: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number of each window, windows as rows) over all bytes of all documents, in steps of bounded size.

    Document i is ``data[at[i]:at[i+1]]``.  Windows start every ``stride`` bytes, so each byte is in one at least; the last is filled
    up with zero bytes, and an empty document has one window of zeros.
    """
    sizes = np.diff(at)
    counts = np.maximum(1, -(-(sizes - (length - stride)) // stride))
    ends = np.cumsum(counts)
    total, rows = int(ends[-1]) if len(ends) else 0, max(1, 4 * STEP // length)
    steps = np.arange(length)
    for first in range(0, total, rows):
        number = np.arange(first, min(total, first + rows))
        doc = np.searchsorted(ends, number, side="right")
        start = at[doc] + (number - (ends[doc] - counts[doc])) * stride
        where = start[:, None] + steps
        inside = where < at[doc + 1][:, None]
        x = np.where(inside, data[np.minimum(where, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(where.shape, np.uint8)
        yield doc, x


def train(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, batch: int, rate: float, seed: int, decay: float = 1e-4) -> Net:
    """Adam on cross-entropy.  ``x``: (examples, windows, bytes); an example's features are the mean over its windows; ``y``: class.

    ``weight`` (examples, windows) says how much each window counts; a row sums to 1.
    """
    rng = np.random.default_rng(seed)
    values = net.parameters()
    m, v, step = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values], 0
    n, per, length = x.shape
    for epoch in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            some = order[i : i + batch]
            part, share = x[some].reshape(-1, length).astype(np.intp), weight[some].astype(np.float32)
            best, where = [], []
            for table in net.tables:
                answers = _answers(table, part)
                top = answers.argmax(axis=1)
                where.append(top)
                best.append(np.take_along_axis(answers, top[:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate([b + c for b, c in zip(best, net.bias, strict=True)], axis=1)
            feature = (np.maximum(raw, 0).reshape(len(some), per, -1) * share[:, :, None]).sum(axis=1)
            error = softmax(feature @ net.dense + net.offset)
            error[np.arange(len(some)), y[some]] -= 1
            error /= len(some)
            back = ((error @ net.dense.T)[:, None, :] * share[:, :, None]).reshape(len(part), -1) * (raw > 0)
            tables, biases, k = [], [], 0
            for table, top in zip(net.tables, where, strict=True):
                filters = table.shape[2]
                slope = back[:, k : k + filters]
                k += filters
                biases.append(slope.sum(axis=0))
                at = [np.take_along_axis(part, top + j, axis=1) * filters + np.arange(filters) for j in range(len(table))]
                tables.append(np.stack([np.bincount(a.ravel(), slope.ravel(), 256 * filters).reshape(256, filters) for a in at]))
            slopes = [*tables, *biases, feature.T @ error, error.sum(axis=0)]
            step += 1
            now = rate * (1 - epoch / epochs)
            for p, g, a, b in zip(values, slopes, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) + decay * now * p).astype(np.float32)
    return net
