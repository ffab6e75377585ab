"""Document fingerprints by winnowing.

Every k characters in a row are hashed; of every window of w such hashes the smallest is kept, the rightmost if it ties.  Two texts
that share k + w - 1 characters in a row share a kept hash; positions (in characters) say where.

Defined results: a null text counts as empty and has no hash; a text of fewer than k characters has one hash, of the whole, at
position 0.  Likeness is common hashes over all hashes (Jaccard); 1 for two empty texts, 0 if only one is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import Shelf, batches_of

K, W = 16, 48
#: Characters of text that one task is meant to hold, for dealing out neighbouring documents.
PART_CHARS = 24_000_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, edited_positions array<int>"


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of every k codes in a row: polynomial sums made by doubling the length, then mixed."""
    base, out, done = np.uint64(0x9E3779B97F4A7C15), None, 0
    part, length, factor = codes.astype(np.uint64) + np.uint64(1), 1, base
    left = k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                out = part if out is None else out[: len(codes) - done - length + 1] * factor + part[done : done + len(codes) - done - length + 1]
                done += length
            left >>= 1
            if left:
                part = part[:-length] * factor + part[length:] if len(part) > length else part[:0]
                length, factor = 2 * length, factor * factor
        out = out[: len(codes) - k + 1].copy()
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out >>= np.uint64(32)
    return out


def winnow(codes: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept, in order of position."""
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) < k:
        return rolling(codes, len(codes)), np.zeros(1, np.int64)
    hashes = rolling(codes, k)
    low = np.uint64(0xFFFFFFFF)
    key = (hashes << np.uint64(32)) | (low - np.arange(len(hashes), dtype=np.uint64))  # least hash, then the rightmost
    if len(key) > w:
        least, length = key, 1
        while 2 * length <= w:
            least, length = np.minimum(least[:-length], least[length:]), 2 * length
        if length < w:
            least = np.minimum(least[: len(key) - w + 1], least[w - length :])
        keep = np.ones(len(least), bool)
        keep[1:] = least[1:] != least[:-1]
        key = least[keep]
    else:
        key = key.min(keepdims=True)
    return key >> np.uint64(32), (low - (key & low)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def text_of(hashes: np.ndarray) -> str:
    """Fingerprint as text: distinct hashes in order, 8 hex digits each."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hashes, positions) of every text: the general form, with all kept positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 4 << 20):
            found = [winnow(codes_of(t.as_py() or ""), k, w) for t in batch.column("text")]
            kinds = pa.list_(pa.int64())
            arrays = [pa.array([f[i].astype(np.int64) for f in found], kinds) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def with_neighbours(docs: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(part, turn, doc_id, text): every document once at turn 0, and after each part's last the document that follows it, at turn 1.

    Ids are cut at quantiles into ranges of about ``part_chars`` characters; the text moves once, the first document of each range
    twice.  The last range is followed by the first document of all.  Ids that repeat are ordered by text length and hash, null ids
    come first.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.length("text").alias("n"), F.xxhash64("text").alias("h"), "doc_id", "text")
    keys = Shelf(docs.sparkSession).put(keyed.select("key", "n", "h"))
    total = keys.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    parts = max(1, -(-(total.n or 0) // part_chars))
    # any borders give right results; quantiles give parts of like size
    cuts = keys.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10_000 + 20 * parts)).first()[0] if parts > 1 else None
    borders = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, key.to_numpy(), side="right").astype(np.int32))

    first = keys.groupBy(part_of("key").alias("part")).agg(F.min(F.struct("key", "n", "h")).alias("o"))
    heads = sorted((r.part, *r.o) for r in first.collect())  # one row for each part
    table = docs.sparkSession.createDataFrame([(*h, heads[i - 1][0]) for i, h in enumerate(heads)], "part int, head_key long, head_n int, head_h long, before int")
    placed = keyed.withColumn("part", part_of("key")).join(F.broadcast(table), "part")
    is_head = (F.col("key") == F.col("head_key")) & (F.col("n") == F.col("head_n")) & (F.col("h") == F.col("head_h"))
    here, there = F.struct("part", F.lit(0).alias("turn")), F.struct(F.col("before").alias("part"), F.lit(1).alias("turn"))
    spread = placed.select(F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))).alias("p"), "key", "n", "h", "doc_id", "text")
    moved = spread.select("p.part", "p.turn", "key", "n", "h", "doc_id", "text").repartition(2 * parts, "part")
    return moved.sortWithinPartitions("part", "turn", "key", "n", "h").select("part", "turn", "doc_id", "text")


def compare_edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited form (``SCHEMA``), with the positions (in characters) of all kept hashes.

    The edited form replaces the last quarter of the characters by the first as many of the next document by id.  A table of one
    document is its own neighbour.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches_of(batches, 4 << 20):
            rows = []
            for part, turn, doc_id, text in zip(batch.column("part").to_pylist(), batch.column("turn").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                codes = codes_of(text)
                hashes, at = winnow(codes, k, w)
                now = (part, doc_id, text, codes, np.unique(hashes), at.astype(np.int32))
                if last is not None and last[0] == part:
                    rows.append(judged(last, now))
                last = None if turn else now  # what follows a part has its own row in the next
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def judged(last: tuple, now: tuple) -> tuple:
        _, doc_id, text, codes, own, at = last
        q = len(codes) // 4
        head = now[3][:q]
        edited = codes[: len(codes) - q]
        edited = np.concatenate([edited.astype(np.uint32), head.astype(np.uint32)]) if q else codes
        hashes, other_at = winnow(edited, k, w) if q else (own, at)
        other = np.unique(hashes)
        sha = hashlib.sha256((text[: len(codes) - q] + now[2][:q]).encode()).hexdigest()
        return doc_id, len(codes), sha, text_of(own), text_of(other), likeness(own, other), likeness(own, now[4]), at, other_at.astype(np.int32)

    return with_neighbours(docs).mapInArrow(run, SCHEMA)
