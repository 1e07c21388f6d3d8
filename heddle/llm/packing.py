"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds the documents of over capacity / (k + 1) and at
most capacity / k ids, and a bin of class k takes k of them, whole. What a closed bin has left is filled
with documents that fit it whole, the tightest place first; only when many bins wait for such ones is a document
cut, over the largest places. Longer documents are cut into full sequences and a rest that is packed like a document.
Every worker fills its own bins: one open bin for each class and at most WAITING closed ones.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from heddle.llm.bpe import encoder
from heddle.llm.common import id_and_text, in_arrow, slices, strings

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Sequence ids of one worker; its partition number stands above these bits.
LOCAL_BITS = 40
#: Closed bins with room left that a worker holds before it cuts a document to fill them.
WAITING = 256

Piece = tuple[int | None, int, bytes, int]  # doc_id, start, ids (4 bytes each), the document's ids in all


def size(piece: Piece) -> int:
    return len(piece[2]) >> 2


def split(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


class Bins:
    """One worker's bins."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[Piece]] = defaultdict(list)
        self.waiting: list[tuple[int, int]] = []  # room left and bin number, in order
        self.held: dict[int, list[Piece]] = {}
        self.closed = 0

    def emit(self, pieces: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) >> 2
            yield doc, start, n, zlib.crc32(ids), total, self.next, offset
            offset += n
        self.next += 1

    def settle(self, number: int, pieces: list[Piece], room: int) -> Iterator[tuple]:
        """A bin with its class's count: it goes out if it is full, or waits for what fits."""
        if room:
            self.held[number] = pieces
            bisect.insort(self.waiting, (room, number))
        else:
            yield from self.emit(pieces)

    def into(self, place: int, piece: Piece) -> Iterator[tuple]:
        room, number = self.waiting.pop(place)
        yield from self.settle(number, [*self.held.pop(number), piece], room - size(piece))

    def add(self, piece: Piece) -> Iterator[tuple]:
        n = size(piece)
        while n >= self.capacity:
            full, piece = split(piece, self.capacity)
            yield from self.emit([full])
            n -= self.capacity
        if not n:
            return
        place = bisect.bisect_left(self.waiting, (n, -1))
        if place < len(self.waiting):
            yield from self.into(place, piece)
            return
        if len(self.waiting) >= WAITING:
            while n and self.waiting:  # no place is as large as the piece: the largest take parts of it
                part, piece = split(piece, min(n, self.waiting[-1][0]))
                n -= size(part)
                yield from self.into(len(self.waiting) - 1, part)
            if not n:
                return
        k = self.capacity // n
        group = self.open[k]
        group.append(piece)
        if len(group) == k:
            del self.open[k]
            self.closed += 1
            yield from self.settle(self.closed, group, self.capacity - sum(map(size, group)))

    def close(self) -> Iterator[tuple]:
        """What is left, end to end: full bins, and sequences of a power of two of ids for the rest."""
        left = [p for _, number in self.waiting for p in self.held[number]] + [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(map(size, left))
        rest = total % self.capacity
        rooms = [self.capacity] * (total // self.capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        left.reverse()
        for room in rooms:
            group = []
            while room:
                piece = left.pop()
                if size(piece) > room:
                    piece, after = split(piece, room)
                    left.append(after)
                group.append(piece)
                room -= size(piece)
            yield from self.emit(group)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, slice_bytes: int = 1 << 20) -> DataFrame:
    """Pieces of every row of ``docs`` with the sequence and offset each one went to.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. The
    sequences of a worker are full, but for at most log2(capacity) last ones, which have a power of
    two of ids; none needs padding. Sequence ids hold the worker's partition number, so a task that
    is run again gives the same rows. No shuffle. Texts of any length are cut as they come; ties in a
    place's room go to the bin closed first; repeated rows are packed each; an empty table
    gives no rows; other columns are ignored. ``capacity`` must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    last = np.array([end_id], dtype="<u4").tobytes()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        bins = Bins(capacity, TaskContext.get().partitionId() << LOCAL_BITS)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=NAMES)

        for part in slices(batches, "text", slice_bytes):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(strings(part.column("text"))), strict=True):
                ids += last
                rows += bins.add((doc_id, 0, ids, len(ids) >> 2))
            yield out(rows)
        yield out(list(bins.close()))

    return in_arrow(id_and_text(docs), fill, SCHEMA)
