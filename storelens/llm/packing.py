"""Cost-balanced packing of documents into training sequences.

Every document is tokenised, cut into pieces and laid into sequences of ``length`` tokens. Whole multiples of the
length become full sequences of their own. The rest of each document is packed by estimated attention cost: pieces
in descending order go to the sequence of lowest cost that still has room, where a piece of n tokens costs
``linear * n + quadratic * n * n`` (attention stays within a document). A piece that fits nowhere is cut. A window
opens exactly as many sequences as its tokens fill, so they end up full; what is left moves on to the next window.
At the end of a task the rest fills sequences whose lengths are powers of two, which need no padding either.

Each task packs the rows of its own partition, in windows of bounded size: nothing is shuffled, and a task that
runs again on the same rows gives the same pieces. Null and empty texts hold the end token alone. Repeated rows
are packed as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.tokens import END_ID, encoder, vocabulary_path

LENGTH = 2048
#: Remainders are packed as soon as this many tokens wait.
WINDOW_TOKENS = 1 << 20
#: Texts handled at once, in characters, where nothing smaller is asked for.
BATCH_CHARS = 8 << 20
#: Texts tokenised at once, in characters: the encoder holds some 30 bytes for each.
SLICE_CHARS = 1 << 20
#: Rows of a batch that are Python strings at once.
SLICE_ROWS = 256
#: Sequence ids: number of the partition, then a counter below this.
IDS_PER_PARTITION = 1 << 36

PIECES = "doc bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def cost(n, linear: float, quadratic: float):
    """Estimated cost of attending within a piece of n tokens."""
    return linear * n + quadratic * n * n


def assign(sizes: list[int], rooms: list[int], linear: float, quadratic: float) -> tuple[list[tuple], list[tuple]]:
    """Lay pieces into sequences of the given rooms.

    Returns ``(piece, from, to, sequence, offset)`` for what was laid, and ``(piece, from, to)`` for what no room
    was left for. Equal sizes go in their given order, equal costs to the first sequence.
    """
    room = np.array(rooms, np.int64)
    used = np.zeros(len(rooms), np.int64)
    load = np.zeros(len(rooms))
    waiting = [(-size, k, 0) for k, size in enumerate(sizes) if size]
    heapq.heapify(waiting)
    laid, left = [], []
    while waiting:
        size, k, first = heapq.heappop(waiting)
        size = -size
        fits = room >= size
        if fits.any():
            at, take = int(np.where(fits, load, np.inf).argmin()), size
        elif room.any():
            at = int(np.where(room > 0, load, np.inf).argmin())
            take = int(room[at])
            heapq.heappush(waiting, (take - size, k, first + take))
        else:
            left.append((k, first, first + size))
            continue
        laid.append((k, first, first + take, at, int(used[at])))
        room[at] -= take
        used[at] += take
        load[at] += cost(take, linear, quadratic)
    return laid, left


def powers_of_two(tokens: int, length: int) -> list[int]:
    """Descending powers of two that add up to a rest below ``length``."""
    return [1 << k for k in reversed(range(tokens.bit_length())) if tokens >> k & 1] if tokens < length else []


class _Packer:
    """Packs the documents of one partition."""

    def __init__(self, first_id: int, length: int, linear: float, quadratic: float, window: int):
        self.next_id, self.length, self.costs, self.window = first_id, length, (linear, quadratic), window
        self.waiting: list[tuple] = []  # (doc, start, doc tokens, ids)
        self.tokens = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        full = len(ids) // self.length * self.length
        for start in range(0, full, self.length):
            self._emit(doc, start, len(ids), self.next_id, 0, ids[start : start + self.length])
            self.next_id += 1
        if full < len(ids):
            self.waiting.append((doc, full, len(ids), ids[full:]))
            self.tokens += len(ids) - full
        if self.tokens >= self.window:
            self._pack([self.length] * (self.tokens // self.length))

    def finish(self) -> None:
        self._pack([self.length] * (self.tokens // self.length) + powers_of_two(self.tokens % self.length, self.length))

    def _pack(self, rooms: list[int]) -> None:
        laid, left = assign([len(w[3]) for w in self.waiting], rooms, *self.costs)
        for k, first, last, at, offset in laid:
            doc, start, total, ids = self.waiting[k]
            self._emit(doc, start + first, total, self.next_id + at, offset, ids[first:last])
        self.next_id += len(rooms)
        rest = [(self.waiting[k], first, last) for k, first, last in sorted(left)]
        self.waiting = [(doc, start + a, total, ids[a:b].copy()) for (doc, start, total, ids), a, b in rest]
        self.tokens = sum(len(w[3]) for w in self.waiting)

    def _emit(self, doc, start, total, sequence, offset, ids) -> None:
        self.out.append((doc, start, len(ids), total, sequence, offset, ids.tobytes()))

    def taken(self) -> pa.RecordBatch:
        kinds = (pa.int64(),) * 6 + (pa.binary(),)
        names = ("doc", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
        columns = zip(*self.out, strict=True) if self.out else ((),) * 7
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))
        self.out = []
        return batch


def text_groups(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch (columns 0 and 1) in groups of about ``limit`` characters."""
    ids, texts, size = [], [], 0
    for first in range(0, batch.num_rows, SLICE_ROWS):
        rows = batch.slice(first, SLICE_ROWS)
        for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text)
            size += len(text or "")
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    length: int = LENGTH,
    linear: float = 1.0,
    quadratic: float = 1.0 / LENGTH,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """One row per piece: ``(id_col, start, length, doc_tokens, sequence_id, offset, ids)``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers, ``start`` counts the document's
    ids before it, ``offset`` the sequence's. ``vocabulary`` is the path of a word-level BPE file.
    """
    path = vocabulary or vocabulary_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(
            TaskContext.get().partitionId() * IDS_PER_PARTITION, length, linear, quadratic, window_tokens
        )
        for batch in batches:
            for names, texts in text_groups(batch, SLICE_CHARS):
                ids, at = encoder(path).encode(texts, END_ID)
                ids = ids.astype("<u4", copy=False)
                for k, doc in enumerate(names):
                    packer.add(doc, ids[at[k] : at[k + 1]])
                packer.waiting = [(d, s, n, w.copy() if w.base is not None else w) for d, s, n, w in packer.waiting]
                yield packer.taken()
        packer.finish()
        yield packer.taken()

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(pack, PIECES)
    return rows.withColumnRenamed("doc", id_col)
