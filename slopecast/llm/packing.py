"""Packing token sequences into windows of one size by multiway differencing.

Each task packs the documents of its own partition, in batches of a fixed number of windows, so
nothing is shuffled, memory is bounded, and a hot source or id changes nothing. Within a batch
the Karmarkar-Karp method deals the pieces: every piece starts as a partial partition with one
filled window, and the two partitions with the largest imbalance are merged again and again,
the fullest windows of one against the emptiest of the other. The windows end up nearly equal.
If one of them exceeds the capacity, the batch is dealt again with one more window.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import encoder

CAPACITY = 4096
PIECE = 512  # what is left of a document beyond whole windows is cut into pieces of this size at most
WINDOWS = 128  # windows dealt together
SLACK = 10  # free places per window that a batch leaves for the imbalance

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Deal item numbers into at most ``k`` groups of nearly equal total: (total, items), largest first.

    A partial partition leaves out its empty groups. Of two partitions with a and b groups,
    the a + b - k smallest on either side cannot stand alone: they meet in opposite order.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        met = max(0, len(a) + len(b) - k)
        low_a, low_b = a[len(a) - met :], b[len(b) - met :]
        merged = a[: len(a) - met] + b[: len(b) - met]
        merged += [(x + y, xs + ys) for (x, xs), (y, ys) in zip(low_a, reversed(low_b), strict=True)]
        merged.sort(key=lambda g: -g[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    return heap[0][2] if heap else []


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows that hold all items; one more is opened as long as any would be too full."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, k)
        if not dealt or dealt[0][0] <= capacity:
            return [items for _, items in dealt]
        k += 1


class _Packer:
    """Cuts documents into pieces and deals them batch by batch."""

    def __init__(self, first_id: int, capacity: int, piece: int, windows: int):
        self.capacity, self.piece, self.windows, self.next_id = capacity, piece, windows, first_id
        self.goal = windows * (capacity - SLACK) if capacity > 2 * SLACK else windows * capacity
        self.held: list[tuple] = []
        self.total = 0

    def _row(self, doc, start, ids, n, seq, offset):
        return doc, start, len(ids), zlib.crc32(ids.tobytes()), n, seq, offset

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        n, at = len(ids), 0
        while n - at >= self.capacity:  # a whole window needs no dealing
            yield self._row(doc, at, ids[at : at + self.capacity], n, self.next_id, 0)
            self.next_id += 1
            at += self.capacity
        while at < n:
            take = min(self.piece, n - at, self.goal - self.total)
            self.held.append((doc, at, ids[at : at + take].copy(), n))
            self.total += take
            at += take
            if self.total == self.goal:
                yield from self.deal()

    def deal(self) -> Iterator[tuple]:
        held, self.held, self.total = self.held, [], 0
        for items in windows_of([len(x[2]) for x in held], self.capacity):
            offset = 0
            for i in sorted(items):
                doc, start, ids, n = held[i]
                yield self._row(doc, start, ids, n, self.next_id, offset)
                offset += len(ids)
            self.next_id += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [p.split()[0] for p in PIECES.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, piece: int = PIECE,
    windows: int = WINDOWS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece of each document's ids (``tokenizer``'s, then ``end_id``).

    A piece is ``length`` ids of its document from ``start`` on, placed at ``offset`` of window
    ``sequence_id``; ``ids_crc32`` is the CRC-32 of its ids as little-endian unsigned 32-bit
    integers. Each id lies in one piece, and windows are filled without gaps from 0. Windows are
    numbered apart in each partition, so ids are unique but not dense.

    A null or empty text has only its end id; very long texts fill whole windows by themselves;
    repeated rows are packed once each, a null id too; an empty table gives no rows. Other
    columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, piece, windows)
        end, out = np.array([end_id], "<u4"), []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, tok in enc.encode_column(batch.column(1)):
                out.extend(packer.add(ids[i], np.concatenate((tok.astype("<u4", copy=False), end))))
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
        out.extend(packer.deal())
        yield _batch(out)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, PIECES)
