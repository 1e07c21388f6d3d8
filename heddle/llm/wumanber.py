"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of normalised words with a space on either side. For each class of pattern
lengths, a shift table over hashed blocks says how far a cursor may jump; where the jump is zero, the
block's suffix-hash bucket names the patterns that may end their first m bytes there, and a direct
comparison with the text confirms. Many cursors, each with its own stretch of the text, move at once.

The benchmark is cut into groups of blocks by the bytes of its patterns. A group is broadcast, which is bounded, and
searched in one pass over the documents; a benchmark of several groups takes a pass for each, and what a pass has
found travels with its row to the next one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.common import id_and_text, in_arrow, slices, utf8, written

#: Bytes to word bytes: A-Z lower-cased, 0-9, a-z and all non-ASCII bytes as they are, the rest a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Patterns of under so many bytes get tables of their own, so that they don't shorten the others' jumps.
CLASSES = (4, 8, 16, 32, 64)
STRETCH = 1024


def words(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


def windows(item_words: list[bytes], size: int) -> list[bytes]:
    """An item's patterns; an item of fewer words, but not none, is one."""
    if not item_words:
        return []
    return [b" " + b" ".join(item_words[i : i + size]) + b" " for i in range(max(1, len(item_words) - size + 1))]


class Tables:
    """Shift table and suffix-hash buckets of one class of pattern lengths."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.m = m = min(map(len, patterns))
        self.block = block = min(8, m)
        self.bits = max(12, min(22, (len(patterns) * m).bit_length() + 3))
        self.keep = np.uint64((1 << (8 * block)) - 1)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), dtype=np.uint8).reshape(len(patterns), m)
        self.shift = np.full(1 << self.bits, min(255, m - block + 1), dtype=np.uint8)
        for end in range(block, m + 1):
            jump = m - end
            if jump < 255:
                slots = self.slots(self.value(heads[:, end - block : end]))
                self.shift[slots] = np.minimum(self.shift[slots], jump)
        last = self.slots(self.value(heads[:, m - block :]))
        order = np.argsort(last, kind="stable")
        self.bucket_key, self.bucket_first = np.unique(last[order], return_index=True)
        self.bucket_last = np.r_[self.bucket_first[1:], len(order)]
        self.members = order
        self.head = self.value(heads[:, :block])
        self.patterns, self.numbers = patterns, numbers

    @staticmethod
    def value(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(len(columns), dtype=np.uint64)
        for k in range(columns.shape[1]):
            out |= columns[:, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def slots(self, value: np.ndarray) -> np.ndarray:
        return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: bytes, eights: np.ndarray) -> tuple[list[int], list[int]]:
        """Starts and pattern numbers of all occurrences. eights: the 8 bytes from each place of the text."""
        n, m, block = len(text), self.m, self.block
        if n < m:
            return [], []
        cursor = np.arange(m, n + 1, STRETCH)  # ends of the first m bytes
        stop = np.minimum(cursor + STRETCH, n + 1)
        found, slots_found = [], []
        while len(cursor):
            slot = self.slots(eights[cursor - block] & self.keep)
            jump = self.shift[slot]
            if len(zero := np.flatnonzero(jump == 0)):
                found.append(cursor[zero])
                slots_found.append(slot[zero])
            cursor = cursor + np.maximum(jump, 1)
            on = cursor < stop
            cursor, stop = cursor[on], stop[on]
        if not found:
            return [], []
        ends, slot = np.concatenate(found), np.concatenate(slots_found)
        at = np.searchsorted(self.bucket_key, slot)
        at[at == len(self.bucket_key)] = 0
        real = self.bucket_key[at] == slot
        ends, at = ends[real], at[real]
        heads = eights[ends - m] & self.keep
        starts, numbers = [], []
        for round_ in range(int((self.bucket_last - self.bucket_first).max())):
            more = self.bucket_first[at] + round_ < self.bucket_last[at]
            ends, at, heads = ends[more], at[more], heads[more]
            if not len(ends):
                break
            member = self.members[self.bucket_first[at] + round_]
            likely = np.flatnonzero(self.head[member] == heads)
            for end, k in zip((ends[likely] - m).tolist(), member[likely].tolist(), strict=True):
                if text.startswith(self.patterns[k], end):
                    starts.append(end)
                    numbers.append(self.numbers[k])
        return starts, numbers


class Matcher:
    """All tables of one block of the benchmark."""

    def __init__(self, owners: dict[bytes, set[str]]):
        patterns = sorted(owners)
        self.items = [sorted(owners[p]) for p in patterns]
        self.n_words = np.array([p.count(b" ") - 1 for p in patterns], dtype=np.int64)
        classes = defaultdict(list)
        for k, p in enumerate(patterns):
            classes[sum(len(p) >= c for c in CLASSES)].append(k)
        self.tables = [Tables([patterns[k] for k in ks], ks) for ks in classes.values()]

    def find(self, text: bytes, eights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = [t.find(text, eights) for t in self.tables]
        return (np.array([x for b in both for x in b[i]], dtype=np.int64) for i in (0, 1))


def groups(benchmark: DataFrame, size: int, id_col: str, text_col: str, most_bytes: int, block_bytes: int) -> Iterator[list[Matcher]]:
    """Matchers over blocks of the benchmark's patterns, in groups of at most ``most_bytes`` of patterns (one block at least).

    The driver holds one group. A window that items of several blocks share is a pattern of each block.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    group, owners, held, in_group = [], defaultdict(set), 0, 0
    for row in items.toLocalIterator():
        for w in windows(words(row["text"].encode()), size):
            held += len(w) if w not in owners else 0
            owners[w].add(row["item"])
        if held > block_bytes:
            if group and in_group + held > most_bytes:
                yield group
                group, in_group = [], 0
            group.append(Matcher(owners))
            in_group += held
            owners, held = defaultdict(set), 0
    if owners:
        if group and in_group + held > most_bytes:
            yield group
            group = []
        group.append(Matcher(owners))
    if group:
        yield group


def search(texts: list[bytes], blocks: list[Matcher]) -> list[tuple[int, np.ndarray, set[str]]]:
    """Words, runs of hit words (first and one past the last of each, in turn) and items of each text."""
    split = [words(t) for t in texts]
    text = b"".join(b"\n " + b" ".join(w) + b" " for w in split)
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    padded = np.frombuffer(text + bytes(8), dtype=np.uint8)
    eights = np.ndarray(shape=(len(text) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    spaces = np.flatnonzero(padded[: len(text)] == 32)
    first = np.r_[0, np.cumsum(np.where(counts > 0, counts + 1, 2))]  # each text's first space
    edge = np.zeros(len(spaces) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        starts, numbers = block.find(text, eights)
        if len(starts):
            at = np.searchsorted(spaces, starts)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + block.n_words[numbers], -1)
            doc = np.searchsorted(first, at, side="right") - 1
            for d, k in np.unique(np.stack([doc, numbers], axis=1), axis=0).tolist():
                items[d].update(block.items[k])
    turns = np.flatnonzero(np.diff(np.r_[False, np.cumsum(edge) > 0, False]))  # no run crosses texts: a text's last space starts no word
    cuts = np.searchsorted(turns, first)
    return [(n, turns[a:b] - at, found) for n, a, b, at, found in zip(counts.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), first[:-1].tolist(), items, strict=True)]


def merged(runs: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The union of two lists of runs."""
    if not len(runs) or not len(more):
        return more if len(more) else runs
    places = np.r_[runs, more]
    step = np.tile([1, -1], len(places) // 2)
    order = np.lexsort((-step, places))
    depth = np.cumsum(step[order])
    opens = (step[order] > 0) & (depth == 1)
    closes = depth == 0
    return places[order][opens | closes]


def searched(docs: DataFrame, benchmark: DataFrame, size: int, text_col: str, id_col: str, item_text: str, most_bytes: int, block_bytes: int, slice_bytes: int, finish, schema) -> DataFrame:
    """``finish`` of every batch of ``docs`` and, for each row, its number of words, hit runs and items.

    With one group of the benchmark, as usual, this is one narrow pass. Otherwise rows are written between passes with
    what was found, in two columns under names of their own.
    """
    spark, left = docs.sparkSession, docs
    runs_col, items_col = (next(n for n in (f"{base}{'_' * k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("__runs", "__items"))

    def scan(blocks, carried: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, text_col, slice_bytes):
                found = search(utf8(piece.column(text_col)), blocks.value)
                if carried:
                    before = zip(piece.column(runs_col).to_pylist(), piece.column(items_col).to_pylist(), strict=True)
                    found = [(n, merged(np.array(r, dtype=np.int64), runs), {*i, *own}) for (n, runs, own), (r, i) in zip(found, before, strict=True)]
                    piece = piece.drop_columns([runs_col, items_col])
                if last:
                    yield finish(piece, found)
                else:
                    columns = [*piece.columns, pa.array([r.tolist() for _, r, _ in found], pa.list_(pa.int64())), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, runs_col, items_col])

        return run

    between = T.StructType([*docs.schema.fields, T.StructField(runs_col, T.ArrayType(T.LongType())), T.StructField(items_col, T.ArrayType(T.StringType()))])
    carried, group = False, None
    for after in groups(benchmark, size, id_col, item_text, most_bytes, block_bytes):
        if group is not None:
            sent = spark.sparkContext.broadcast(group)
            left, carried = written(in_arrow(left, scan(sent, carried, False), between), "searched"), True
            sent.destroy()
        group = after
    return in_arrow(left, scan(spark.sparkContext.broadcast(group or []), carried, True), schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text",
    most_bytes: int = 64 << 20, block_bytes: int = 16 << 20, slice_bytes: int = 2 << 20,
) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit (words inside an occurrence of a benchmark window), the items, contaminated.

    A narrow pass over the documents for every ``most_bytes`` of benchmark patterns, which are what is broadcast at
    once, in blocks of ``block_bytes``; a benchmark of any size is searched whole. Null and
    empty texts have no words and no hits; null items and null item ids match nothing; windows that
    several items share count for each; texts of any length are searched by cursors that move together; rows repeated
    in either table change nothing else; with an empty benchmark nothing is hit. Other columns are ignored.
    """

    def finish(piece: pa.RecordBatch, found: list) -> pa.RecordBatch:
        hits = [int((runs[1::2] - runs[::2]).sum()) for _, runs, _ in found]
        return pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                *(pa.array(c, pa.int64()) for c in ([f[0] for f in found], hits, [len(f[2]) for f in found])),
                pa.array([hashlib.sha256(",".join(sorted(f[2])).encode()).hexdigest() for f in found], pa.string()),
                pa.array([n > 0 for n in hits], pa.bool_()),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )

    return searched(id_and_text(docs), benchmark, size, "text", id_col, text_col, most_bytes, block_bytes, slice_bytes, finish, SCHEMA)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", most_bytes: int = 64 << 20, block_bytes: int = 16 << 20, slice_bytes: int = 2 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark window.

    A null or empty text holds none; with an empty benchmark all rows stay; repeated rows stay or go alike; an empty
    table gives no rows; columns of any names are kept. The benchmark may be of any size, as in decontaminate.
    """

    def finish(piece: pa.RecordBatch, found: list) -> pa.RecordBatch:
        return piece.filter(pa.array([not len(runs) for _, runs, _ in found], pa.bool_()))

    return searched(docs, benchmark, size, text_col, "item_id", "text", most_bytes, block_bytes, slice_bytes, finish, docs.schema)
