"""Hierarchical packing of token streams into context windows of several lengths.

Documents are tokenised and routed by length: whole windows of the longest tier leave at once, what remains goes to the shortest tier
that holds it.  Each tier is packed into windows of its own length, the longest first: a document opens a window, its gap takes the best
fitting whole documents of its own and shorter tiers, and then the beginning of the shortest one, cut so that the window is full.  Tier
lengths are powers of two, so full windows need no padding; the few that nothing is left for are laid end to end and cut at powers of two.
Tasks pack what they read, in bounded rounds, so nothing is shuffled and no task holds more than
one round and one document.  Sequences of each length are dealt to step groups in turn, from a group that depends on the task, so that the groups
of a length differ by one sequence at most in a task and no group gets the rest of all tasks.

Defined results: a null text counts as empty, and a document without a token still has its end id; rows that repeat are packed each
for itself; an empty table gives no rows; ids may be null; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import batches_of

WINDOW = 2048
TIERS = (128, 256, 512, 1024, 2048)
#: Tokens that wait in a task before they are packed.
ROUND = 1 << 20
END = 1
STEP_GROUPS = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, step_group int"
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level encoder of a vocabulary file of ranks, made once per process; added tokens are read from the JSON file beside it."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Packer:
    """Packs pieces (row, start, ids) of one round; ``rows`` fill up with output tuples."""

    def __init__(self, task: int, window: int, tiers: tuple[int, ...]):
        self.next, self.window, self.tiers, self.rows = task << 40, window, tiers, []
        self.dealt: dict[int, int] = {}
        self.first_turn = zlib.crc32(str(task).encode()) % STEP_GROUPS
        self.waiting: list[tuple[int, int, int, np.ndarray]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self.emit([(doc_id, start, len(ids), ids[start : start + self.window])])
        if whole < len(ids):
            self.waiting.append((doc_id, whole, len(ids), ids[whole:].copy()))
            self.held += len(ids) - whole

    def emit(self, pieces: list[tuple], last: bool = False) -> None:
        """One sequence; a short one is cut so that every part but the padded end is a power of two long."""
        total = sum(len(p[3]) for p in pieces)
        while last and total & (total - 1):
            size = 1 << (total.bit_length() - 1)
            head, rest, room = [], [], size
            for doc_id, start, tokens, ids in pieces:
                if room:
                    head.append((doc_id, start, tokens, ids[:room]))
                if len(ids) > room:
                    rest.append((doc_id, start + room, tokens, ids[room:]))
                room = max(0, room - len(ids))
            self.emit(head)
            pieces, total = rest, total - size
        padded = total if not total & (total - 1) else self.window
        turn = self.dealt[padded] = self.dealt.get(padded, self.first_turn + padded.bit_length()) + 1
        offset = 0
        for doc_id, start, tokens, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, tokens, self.next, offset, padded, turn % STEP_GROUPS))
            offset += len(ids)
        self.next += 1

    def pack(self) -> None:
        """Pack all that waits."""
        by_tier: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}
        for i, piece in enumerate(self.waiting):
            by_tier[self._tier(len(piece[3]))].append((len(piece[3]), i))
        for tier in self.tiers:
            by_tier[tier].sort()
        short: list[tuple] = []
        for tier in reversed(self.tiers):
            while by_tier[tier]:
                size, i = by_tier[tier].pop()
                content, room = [self.waiting[i]], tier - size
                while room:
                    piece = self._fitting(by_tier, room) or self._cut(by_tier, room)
                    if piece is None:
                        break
                    content.append(piece)
                    room -= len(piece[3])
                if room:
                    short += content
                else:
                    self.emit(content)
        self.chain(short)
        self.waiting, self.held = [], 0

    def _tier(self, size: int) -> int:
        return self.tiers[bisect_left(self.tiers, size)]

    def _fitting(self, by_tier: dict[int, list[tuple[int, int]]], room: int) -> tuple | None:
        """The longest piece that ``room`` holds."""
        for tier in self.tiers[bisect_left(self.tiers, room) :: -1]:
            at = bisect_left(by_tier[tier], (room + 1, -1)) - 1
            if at >= 0:
                return self.waiting[by_tier[tier].pop(at)[1]]
        return None

    def _cut(self, by_tier: dict[int, list[tuple[int, int]]], room: int) -> tuple | None:
        """The first ``room`` ids of the shortest piece; all pieces are longer than that.  What follows goes on waiting."""
        for tier in self.tiers:
            if by_tier[tier]:
                _, i = by_tier[tier].pop(0)
                doc_id, start, tokens, ids = self.waiting[i]
                self.waiting[i] = doc_id, start + room, tokens, ids[room:]
                insort(by_tier[self._tier(len(ids) - room)], (len(ids) - room, i))
                return doc_id, start, tokens, ids[:room]
        return None

    def chain(self, pieces: list[tuple]) -> None:
        """Lay pieces end to end, cut at window borders; the last, short sequence is cut at powers of two."""
        now, room = [], self.window
        for doc_id, start, tokens, ids in pieces:
            while len(ids) > room:
                self.emit([*now, (doc_id, start, tokens, ids[:room])])
                start, ids, now, room = start + room, ids[room:], [], self.window
            if len(ids):
                now.append((doc_id, start, tokens, ids))
                room -= len(ids)
        if now:
            self.emit(now, last=True)


def pack(docs: DataFrame, vocabulary_path: str, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, round_tokens: int = ROUND) -> DataFrame:
    """One row per piece (see ``SCHEMA``).  ``window`` and ``tiers`` are powers of two, the last tier is the window."""
    assert tiers[-1] == window and not window & (window - 1)
    schema = pa.schema([pa.field(n, pa.int32() if t == "int" else pa.int64()) for n, t in (c.split() for c in SCHEMA.split(", "))])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path)
        added = {s for s in own.special_tokens_set if s}
        packer = Packer(TaskContext.get().partitionId(), window, tiers)
        for batch in batches_of(batches, 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = text.as_py() or ""
                special = any(s in words for s in added)
                ids = own.encode(words, allowed_special=added, disallowed_special=()) if special else own.encode_ordinary(words)
                packer.add(doc_id, np.array([*ids, END], np.uint32))
                if packer.held >= round_tokens:
                    packer.pack()
            if packer.rows:
                yield out(packer.rows)
                packer.rows = []
        packer.pack()
        if packer.rows:
            yield out(packer.rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
