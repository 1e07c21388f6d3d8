"""Removal of repeated byte strings by a distributed sparse suffix array.

A string of SPAN bytes repeats if it starts at two places. Sorting every suffix would move each byte many
times over, so only sampled suffixes are sorted: each window of SPAN bytes picks the place of its least
k-byte hash (the leftmost, if tied), so two equal windows pick the same place within them. Windows that pick
one place form a stretch, and its suffix is the one that is sorted:

1. sampled splitters range-partition the suffixes by their leading tokens (the first four bytes and a
   hash of the first k); a bucket sorts its own by multikey quicksort and compares neighbours. Equal
   stretches are removed whole; suffixes that lead alike but lie in different stretches go on to 2. A run
   that reaches a bucket's edge is compared across the boundary, with the buckets beside it;
2. the suffixes that go on come with their bytes, by a join with the texts. A task sorts those of a leading token by
   multikey quicksort over their bytes, eight at a time, and the bytes before them likewise, backwards. Neighbours'
   longest common prefixes then tell, for each offset, which windows have an equal one.

Texts are named by 128 bits of hashes of their content, so copies of a text are one: a text that has a copy is removed
whole, and only others meet in the buckets. No task gathers more than HOT suffixes that lead alike: beyond that, windows
are counted one by one with map-side sums, told apart by a 64-bit hash beside the leading token, as stretches are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import in_arrow, written

K = 64
PIECE = 1 << 19
#: Suffixes that lead alike which one task compares.
HOT = 512
#: Suffixes of several leading tokens that are sorted at once.
AT_ONCE = 16_384
#: A text with more copies than one row in so many meets its spans under several salts.
SALTED = 1024
TEXT = "doc long, doc2 long"
RECORD = f"key long, stretch long, {TEXT}, place long, least int, most int"
_rng = np.random.default_rng(20240229)
TOKEN = _rng.integers(0, 1 << 64, size=256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C1B)  # 3 modulo 8
STEP_INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse for i < n at least; one table is kept."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for step in (STEP, STEP_INVERSE):
            p = np.full(size, step, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = tuple(out)
    return _powers[size]


class Hashes:
    """Hashes of any stretch of a byte buffer, by prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(TOKEN[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    padded = np.full(-(-n // width) * width + width, np.uint64((1 << 64) - 1), dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces(docs: list[int], texts: list[bytes], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Texts of at least a window, long ones cut with windows kept whole, joined to buffers of about PIECE bytes.

    Yields doc, place in the doc and place in the buffer of each part, and the buffer.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        ends = np.cumsum([len(h[2]) for h in held])
        return np.array([h[0] for h in held], dtype=np.int64), np.array([h[1] for h in held], dtype=np.int64), np.r_[0, ends], b"".join(h[2] for h in held)

    for doc, text in zip(docs, texts, strict=True):
        for at in range(0, len(text) - span + 1, PIECE):
            part = text[at : at + PIECE + span - 1]
            if held and size + len(part) > PIECE + span:
                yield joined()
                held, size = [], 0
            held.append((doc, at, part))
            size += len(part)
    if held:
        yield joined()


def stretches(docs: np.ndarray, at: np.ndarray, ends: np.ndarray, buffer: bytes, span: int) -> dict[str, np.ndarray]:
    """The sampled suffixes of a buffer: where they start, how far before them windows start, and keys."""
    data = np.frombuffer(buffer, dtype=np.uint8)
    hashes = Hashes(data)
    grams = mix(hashes.all(K))
    index = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least((grams & ~np.uint64((1 << 24) - 1)) | index, span - K + 1)
    sizes = np.diff(ends) - span + 1
    part = np.repeat(np.arange(len(sizes)), sizes)
    window = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends[:-1], sizes)
    picked = (least[window] & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (picked[1:] != picked[:-1]) | (part[1:] != part[:-1])])
    last = np.r_[first[1:], len(picked)] - 1
    x, low, high, part = picked[first], window[first], window[last], part[first]
    lead = np.zeros(len(x), dtype=np.uint64)
    for j in range(4):
        lead = (lead << np.uint64(8)) | data[x + j].astype(np.uint64)
    key = (lead << np.uint64(32)) | (grams[x] >> np.uint64(32))
    most, fewest = x - low, x - high
    whole = mix(hashes(low, high + span) + mix((most << 20 | fewest).astype(np.uint64)))
    return {
        "key": key.view(np.int64), "stretch": whole.view(np.int64), "row": docs[part], "place": at[part] + x - ends[part],
        "least": fewest.astype(np.int32), "most": most.astype(np.int32),
    }


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: rows are parted by their first token; only those that tie are sorted by the next."""
    order = np.argsort(columns[0], kind="quicksort")
    new = np.ones(len(order), dtype=bool)
    new[1:] = columns[0][order[1:]] != columns[0][order[:-1]]
    for column in columns[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, rows = np.cumsum(new)[at], order[at]
        rows = rows[np.lexsort((column[rows], group))]
        order[at] = rows
        new[at[1:]] |= (at[1:] == at[:-1] + 1) & (column[rows[1:]] != column[rows[:-1]])
    return order


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sampled(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """RECORD of the sampled suffixes; of copies of a text within a task one is looked at."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            doc, doc2 = (part.column(c).to_numpy() for c in ("doc", "doc2"))
            both = list(zip(doc.tolist(), doc2.tolist(), strict=True))
            new = [i for i, d in enumerate(both) if d not in seen and not seen.add(d)]
            texts = part.column("text").cast(pa.large_binary()).take(pa.array(new, pa.int64())).to_pylist()
            for rows, places, ends, buffer in pieces(new, texts, span):
                found = stretches(rows, places, ends, buffer, span)
                found["doc"], found["doc2"] = doc[found["row"]], doc2[found["row"]]
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in names(RECORD)], names=names(RECORD))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket. State 0: an equal stretch exists; 1: leads alike, to be compared by windows.

    State 2: a class of equal stretches in a run at the bucket's edge, one row with their number.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    columns = [whole.column(c).to_numpy() for c in ("key", "stretch", "doc", "doc2", "place")]
    order = multikey_order(columns)
    once = np.zeros(len(order), dtype=bool)  # copies of a text in different tasks gave the same suffixes
    once[0] = True
    for c in columns:
        once[1:] |= c[order[1:]] != c[order[:-1]]
    order = order[once]
    key, stretch = columns[0][order], columns[1][order]
    new_key = np.r_[True, key[1:] != key[:-1]]
    new_class = new_key | np.r_[True, stretch[1:] != stretch[:-1]]

    def sizes(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(new)
        n = np.diff(np.r_[starts, len(new)])
        return np.repeat(n, n), np.repeat(np.add.reduceat(new_class.astype(np.int64), starts), n)

    (in_class, _), (in_key, classes) = sizes(new_class), sizes(new_key)
    run = np.cumsum(new_key)
    edge = (run == 1) | (run == run[-1])
    for state, chosen in ((0, in_class > 1), (1, ~edge & (in_key > 1) & (classes > 1) & new_class), (2, edge & new_class)):
        at = np.flatnonzero(chosen)
        for begin in range(0, len(at), 1 << 16):
            part = at[begin : begin + (1 << 16)]
            rows = whole.take(pa.array(order[part])).combine_chunks()
            n = rows.num_rows
            first = [pa.array(np.full(n, state, dtype=np.int32)), pa.array(in_class[part])]
            yield pa.RecordBatch.from_arrays([*first, *(c.combine_chunks() for c in rows.columns)], names=["state", "n", *rows.schema.names])


def _words(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """``width`` bytes from each start (backwards with step -1) as big-endian words; zeros behind each length."""
    inside = np.arange(-(-width // 8) * 8)
    at = np.clip(start[:, None] + step * inside, 0, len(data) - 1)
    return np.where(inside < length[:, None], data[at], 0).astype(np.uint8).view(">u8").astype(np.uint64)


def _sorted(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key, then bytes, and how many bytes each row in it shares with the one before (-1: none, nor the key)."""
    order = multikey_order([key, *words.T])
    a, b, k = words[order[1:]], words[order[:-1]], key[order]
    differ = a != b
    word = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    at = np.minimum(word, words.shape[1] - 1)
    x = (a ^ b)[np.arange(len(at)), at]
    zeros = sum((x < np.uint64(1 << shift)).astype(np.int64) for shift in range(8, 64, 8))
    common = np.where(word < words.shape[1], 8 * word + zeros, 8 * words.shape[1])
    return order, np.r_[-1, np.where(k[1:] == k[:-1], common, -1)]


def same_windows(key: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray, contents: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of what their windows share with windows of other rows of the same key.

    contents: the bytes of each row's windows, from ``most`` before its place to ``span - least`` behind.
    """
    lengths = np.fromiter(map(len, contents), dtype=np.int64, count=len(contents))
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    x = np.cumsum(lengths) - lengths + most
    ahead, ahead_common = _sorted(key, _words(data, x, span - least, span))
    behind, behind_common = _sorted(key, _words(data, x - 1, most, span, -1))
    n, top = len(key), int(most.max()) + 1
    twice = np.zeros((n, top + 2), dtype=np.int8)
    after, before = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for j in range(int(least.min()), top):  # the windows that start j bytes before their place
        rows = np.flatnonzero((least <= j) & (j <= most))
        if len(rows) < 2:
            continue
        after[ahead] = np.cumsum(ahead_common < span - j)
        before[behind] = np.cumsum(behind_common < j)
        both = after[rows] * (n + 1) + before[rows]
        order = np.argsort(both, kind="quicksort")
        equal = both[order][1:] == both[order][:-1]
        twice[rows[order[1:][equal]], j + 1] = 1
        twice[rows[order[:-1][equal]], j + 1] = 1
    edge = np.diff(twice, axis=1)
    row, first = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return row, place[row] - stop + 1, place[row] - first + span


SPANS = f"{TEXT}, start long, end long"


def repeated_spans(rows: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """(doc, doc2, start, end) intervals that cover exactly the bytes of windows which repeat in other places of distinct texts.

    rows: doc, doc2 (what names a text), doc_id, text; texts: doc, doc2, rep (the doc_id of the row to take it from).
    """
    names_of = ["doc", "doc2"]
    enough = rows.where(F.octet_length("text") >= span)
    suffixes = in_arrow(enough.select(*names_of, "text"), lambda batches: _sampled(batches, span), RECORD)
    compared = written(in_arrow(suffixes.repartitionByRange("key", "stretch", *names_of, "place"), _compare, "state int, n long, " + RECORD), "suffixes")
    # across boundaries: runs at the edges of buckets; their keys are two for each bucket at most
    edge = compared.where("state = 2").drop("state")
    one = F.min(F.struct(*names_of, "place", "least", "most")).alias("one")
    classes = written(edge.groupBy("key", "stretch").agg(F.sum("n").alias("total"), one), "edges")
    shared = classes.groupBy("key").agg(F.count("*").alias("n_classes")).where("n_classes > 1").select("key")
    # those alone in their bucket with an equal stretch in another one; the others are in state 0 already
    equal = edge.where("n = 1").join(classes.where("total > 1").select("key", "stretch"), ["key", "stretch"], "left_semi")
    alike = classes.join(F.broadcast(shared), "key").select("key", "one.*")
    columns = ["key", *names_of, "place", "least", "most"]
    alike = written(compared.where("state = 1").select(*columns).unionByName(alike.select(*columns)), "alike")
    equal = compared.where("state = 0").select(*columns).unionByName(equal.select(*columns))
    found = equal.select(*names_of, (F.col("place") - F.col("most")).alias("start"), (F.col("place") - F.col("least") + span).alias("end"))

    # the suffixes that go on, with their bytes; a text's places are at most a list as long as it
    many = written(alike.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot")), "hot")
    marked = alike.join(many, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    places = marked.groupBy(*names_of).agg(F.collect_list(F.struct("key", "place", "least", "most", "hot")).alias("places")).join(texts.select(*names_of, "rep"), names_of)

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            texts = batch.column("text").cast(pa.large_binary())
            for doc, doc2, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("doc2").to_pylist(), texts, batch.column("places").to_pylist(), strict=True):
                data = text.as_py()
                for p in wanted:
                    content = data[p["place"] - p["most"] : p["place"] - p["least"] + span]
                    held.append((p["key"], doc, doc2, p["place"], p["least"], p["most"], p["hot"], content))
                    size += len(content)
                if size > PIECE:
                    yield _batch(held, CONTENT)
                    held, size = [], 0
            if held:
                yield _batch(held, CONTENT)

    joined = enough.join(places.hint("shuffle_hash"), (enough["doc"] == places["doc"]) & (enough["doc2"] == places["doc2"]) & enough["doc_id"].eqNullSafe(places["rep"]))
    joined = joined.select(enough["doc"], enough["doc2"], enough["text"], "places")
    contents = written(in_arrow(joined, fetched, CONTENT), "contents")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        key, *where = (whole.column(c).to_numpy() for c in ("key", *names_of, "place"))
        order = np.lexsort((*reversed(where), key))
        once = np.r_[True, np.any([c[order[1:]] != c[order[:-1]] for c in (key, *where)], axis=0)]
        order = order[once]
        starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        size = np.diff(np.r_[starts, len(order)])
        order = order[np.repeat(size > 1, size)]
        size = size[size > 1]
        begin, ends = 0, np.cumsum(size)
        while begin < len(order):  # whole keys
            end = ends[min(np.searchsorted(ends, begin + AT_ONCE), len(ends) - 1)]
            part = whole.take(pa.array(order[begin:end]))
            column = lambda c: part.column(c).to_numpy()  # noqa: B023, E731
            row, start, stop = same_windows(column("key"), column("place"), column("least").astype(np.int64), column("most").astype(np.int64), part.column("content").to_pylist(), span)
            yield pa.RecordBatch.from_arrays([pa.array(column("doc")[row]), pa.array(column("doc2")[row]), pa.array(start), pa.array(stop)], names=names(SPANS))
            begin = end

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                content = part.column("content").to_pylist()
                hashes = Hashes(np.frombuffer(b"".join(content), dtype=np.uint8))
                lengths = np.fromiter(map(len, content), dtype=np.int64, count=len(content))
                n = lengths - span + 1
                row = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = (np.cumsum(lengths) - lengths)[row] + step
                value = mix(hashes(begin, begin + span))
                start = part.column("place").to_numpy()[row] - part.column("most").to_numpy()[row] + step
                columns = [part.column(c).to_numpy()[row] for c in ("key", *names_of)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(value.view(np.int64)), *map(pa.array, columns[1:]), pa.array(start)], names=["key", "value", *names_of, "start"])

    found = found.unionByName(in_arrow(contents.where("not hot").repartition("key"), matched, SPANS))
    counted = written(in_arrow(contents.where("hot"), windows, f"key long, value long, {TEXT}, start long"), "windows")
    place = F.struct(*names_of, "start")
    twice = counted.groupBy("key", "value").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key", "value")
    return found.unionByName(counted.join(twice, ["key", "value"], "left_semi").select(*names_of, "start", (F.col("start") + span).alias("end")))


CONTENT = f"key long, {TEXT}, place long, least int, most int, hot boolean, content binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[f.split()[1]]) for c, f in zip(columns, schema.split(", "), strict=True)], names=names(schema))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, bytes of repeated strings of ``span`` bytes removed.

    All places of a string count, overlapping ones and those in one document too; strings are judged on
    the input. A null text is empty; texts shorter than ``span`` keep all their bytes; texts of any length are scanned
    in pieces; repeated rows are
    copies of each other and lose all they have in common; an empty table gives no rows; other columns
    are ignored. ``span`` must be more than K.
    """
    if span <= K:
        raise ValueError(f"span must be more than {K}")
    text, keys = F.coalesce(F.col(text_col).cast("string"), F.lit("")), ["doc", "doc2"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("doc"), F.xxhash64(F.lit(1), text).alias("doc2"))
    texts = written(rows.where(F.octet_length("text") >= span).groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "texts")
    copies = texts.where("n > 1").select(*keys, "n")
    spans = repeated_spans(rows, texts, span).distinct().groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.join(copies, keys, "left_anti").withColumn("whole", F.lit(False))
    # a text with very many copies is met under salts; SALTED of them at most are known to all
    bound = (texts.agg(F.sum("n")).first()[0] or 0) / SALTED
    common = copies.where(F.col("n") > bound).select(*keys, F.floor(F.col("n") / max(1.0, bound) + 1).cast("int").alias("salts"))
    side = spans.unionByName(copies.select(*keys, F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(True).alias("whole")))
    salts = F.coalesce("salts", F.lit(1))
    side = side.join(F.broadcast(common), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    side = written(side, "spans")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                texts = part.column("text").cast(pa.large_binary())
                for doc_id, text, found, whole in zip(part.column("doc_id").to_pylist(), texts, part.column("spans").to_pylist(), part.column("whole").to_pylist(), strict=True):
                    data = text.as_py()
                    removed = runs = end = 0
                    left = hashlib.sha256()
                    for a, b in [(0, len(data))] if whole else sorted((s["start"], s["end"]) for s in found or ()):
                        if a > end or not runs:
                            left.update(data[end:a])
                            runs += 1
                            removed += b - a
                            end = b
                        elif b > end:
                            removed += b - end
                            end = b
                    left.update(data[end:])
                    out.append((doc_id, len(data), removed, runs, left.hexdigest()))
                if out:
                    yield _batch(out, RESULT)

    salted = rows.join(F.broadcast(common), keys, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    joined = salted.join(side.hint("shuffle_hash"), [*keys, "salt"], "left").select("doc_id", "text", "spans", "whole")
    return in_arrow(joined, kept, RESULT)
