"""Near-duplicate texts: links that fingerprints propose, by the exact Jaccard similarity of their sets of shingle hashes.

Texts with equal sets are one node. Only shingles that two nodes or more hold can make nodes similar, so the
others are dropped once counted. The caller's index of fingerprints comes first: each pair that it links is checked
exactly and connects its nodes if it is similar. Fingerprints only estimate similarity, so similar pairs that are
too far apart for them remain. Nodes that share one of the rarest shingles of each form a bucket, in which every
similar pair has to be found:

1. in each bucket the others are compared with one of it, the leader, some times over with another one. That costs in
   proportion to the bucket and connects the copies of one text, however many there are;
2. buckets whose nodes are all connected by now need nothing more. The others form groups, which are cut into blocks
   of nodes; each pair of blocks is one cell, and a worker compares all pairs within a cell. Two blocks that are
   wholly of one connected part make no cell, so a large part costs what the rest of its group has blocks.

So no row is ever made for a pair that is not compared, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import in_arrow, slices, utf8, written
from heddle.llm.components import components

BLOCK = 256
#: Times that buckets are compared with a leader.
LEADERS = 2
COLUMNS = 8192
#: Partitions of the shingles' shuffles, as a multiple of the session's number.
PARTS = 1


def node_of(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes (sorted, without repeats)."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).astype(np.int64))


def least(similarity: Fraction, n):
    """The fewest elements that a set of n shares with any set as similar."""
    return -(-similarity.numerator * n // similarity.denominator)


def nodes_of(docs: DataFrame, shingles: Callable[[bytes], np.ndarray], signed: Callable[[np.ndarray], int], carried: list[str], text_col: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """The carried columns (longs), the node, its fingerprint f0 (``signed`` of its set) and its size (number of shingles) of every row."""
    columns = [F.col(c).cast("long").alias(c) for c in carried]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", slice_bytes):
            sets = [np.unique(shingles(t)) for t in utf8(piece.column("text"))]
            found = [pa.array(map(node_of, sets), pa.int64()), pa.array(map(signed, sets), pa.int64()), pa.array(map(len, sets), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carried), *found], names=[*carried, "node", "f0", "n"])

    return in_arrow(docs.select(*columns, F.col(f"`{text_col}`").cast("string").alias("text")), scan, ", ".join(f"{c} long" for c in [*carried, "node", "f0"]) + ", n int")


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def shared_sets(docs: DataFrame, rows: DataFrame, shingles: Callable[[bytes], np.ndarray], similarity: Fraction, text_col: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """node, n (its set's size), common (the hashes that other nodes hold too, as bytes, the rarest first).

    Nodes that share too few of their hashes to be similar to any other are left out.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task; those of other tasks meet by hash
        for piece in slices(batches, "text", slice_bytes):
            sets = {}
            for t in utf8(piece.column("text")):
                hashes = np.unique(shingles(t))
                if len(hashes) and (node := node_of(hashes)) not in seen:
                    seen.add(node)
                    sets[node] = hashes
            if not sets:
                continue
            columns = [np.concatenate(list(sets.values())).view(np.int64), np.repeat(np.array(list(sets), dtype=np.int64), [len(s) for s in sets.values()])]
            yield from _in_parts(columns, ["hash", "node"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        token, node = (table.column(c).to_numpy() for c in ("hash", "node"))
        del table  # its rows are copied, and they are many
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        once = _first(token, node)
        token, node = token[once], node[once]
        starts = np.flatnonzero(_first(token))
        sizes = np.diff(np.r_[starts, len(token)])
        held = np.repeat(sizes, sizes)
        keep = held > 1
        yield from _in_parts([node[keep], token[keep], np.minimum(held[keep], (1 << 31) - 1).astype(np.int32)], ["node", "hash", "held"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        node, token, held = (table.column(c).to_numpy() for c in ("node", "hash", "held"))
        del table
        order = np.lexsort((token, held, node))
        node, token = node[order], token[order]
        starts = np.flatnonzero(_first(node))  # of each node the row with its size
        n, ends = token, np.r_[starts[1:], len(node)]
        enough = (n[starts] > 0) & (ends - starts - 1 >= least(similarity, n[starts]))
        starts, ends = starts[enough], ends[enough]
        for at in range(0, len(starts), 1024):
            a, b = starts[at : at + 1024], ends[at : at + 1024]
            common = [token[i + 1 : j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(n[a].astype(np.int32)), pa.array(common, pa.binary())], names=["node", "n", "common"])

    dealt = in_arrow(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), deal, "hash long, node long")
    # shingles are the most rows by far, and a task sorts all that it gets
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = in_arrow(dealt.repartition(parts, "hash"), count, "node long, hash long, held int")
    # a node's size travels as a row that no shingle has: one held by none
    sizes = rows.groupBy("node").agg(F.max("n").cast("long").alias("hash")).select("node", "hash", F.lit(0).alias("held"))
    return in_arrow(counted.unionByName(sizes).repartition(parts, "node"), gather, "node long, n int, common binary")


def _in_parts(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=names)


def prefixes(sets: DataFrame, similarity: Fraction) -> DataFrame:
    """hash, node, n: the buckets in which every similar pair of nodes meets; none is lost.

    Two sets that share at least ``least`` of each one's elements share one of the first n - least + 1 of
    each in any common order, here the rarest first.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                sizes = piece.column("n").to_numpy()
                # hashes that no other node holds come first in the order and are in no other's set
                tokens = [h[: len(h) - least(similarity, n) + 1] for h, n in zip((np.frombuffer(c, dtype=np.int64) for c in piece.column("common").to_pylist()), sizes.tolist(), strict=True)]
                count = [len(t) for t in tokens]
                yield from _in_parts([np.concatenate(tokens), np.repeat(piece.column("node").to_numpy(), count), np.repeat(sizes, count)], ["hash", "node", "n"])

    return in_arrow(sets.select("node", "n", "common"), deal, "hash long, node long, n int")


def _buckets(batches: Iterator[pa.RecordBatch], similarity: Fraction):
    """node, size, part and run of a task's buckets, in order of size: a run is cut where the next set is too large to be similar."""
    if (table := _whole(batches)) is None:
        return None
    token, node, n, part = (table.column(c).to_numpy() for c in ("hash", "node", "n", "part"))
    order = np.lexsort((node, n, token))
    token, node, n, part = token[order], node[order], n[order].astype(np.int64), part[order]
    new = _first(token)
    new[1:] |= n[:-1] < least(similarity, n[1:])
    starts = np.flatnonzero(new)
    mixed = np.maximum.reduceat(part, starts) != np.minimum.reduceat(part, starts)  # runs of one part are done
    keep = np.repeat(mixed, np.diff(np.r_[starts, len(node)]))
    return node[keep], n[keep], part[keep], np.cumsum(new)[keep]


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    both = np.unique(np.stack([a, b], axis=1), axis=0)
    yield from _in_parts([both[:, 0].copy(), both[:, 1].copy()], ["a", "b"])


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def leader_links(buckets: DataFrame, similarity: Fraction, seed: int) -> DataFrame:
    """Pairs (a, b) of each bucket's leader and the nodes of other parts in it. All buckets prefer the same leaders."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _buckets(batches, similarity)) is None or not len(found[0]):
            return
        node, n, part, run = found
        order = np.lexsort((_mixed(node, seed), run))
        node, n, part, run = node[order], n[order], part[order], run[order]
        first = np.flatnonzero(_first(run))
        head = np.repeat(first, np.diff(np.r_[first, len(run)]))
        small, large = np.minimum(n, n[head]), np.maximum(n, n[head])
        near = (part != part[head]) & (small >= least(similarity, large))
        yield from _pairs(node[head[near]], node[near])

    return in_arrow(buckets.repartition("hash"), lead, "a long, b long").distinct()


def chain_links(buckets: DataFrame, similarity: Fraction) -> DataFrame:
    """Links (a, b) whose groups hold every pair of nodes of different parts that share a bucket and may be similar."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _buckets(batches, similarity)) is None or not len(found[0]):
            return
        node, _, _, run = found
        near = run[1:] == run[:-1]
        yield from _pairs(node[:-1][near], node[1:][near])

    return in_arrow(buckets.repartition("hash"), chain, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of elements that each two sets share."""
    sizes = [len(s) for s in sets]
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, (_, column) = row[keep], np.unique(column[keep], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, width - at)), dtype=np.float32)
        held[row[a:b], column[a:b] - at] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def similar(sets: list[np.ndarray], n: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether each two sets, of sizes n and these shared elements, have the Jaccard similarity or more."""
    both = overlaps(sets)
    return both * similarity.denominator >= similarity.numerator * (n[:, None] + n[None, :] - both)


def led(sets: DataFrame, pairs: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (leader a, b) that are similar. A leader's set is sent to each block of those it leads."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        table = table.sort_by([("cell", "ascending"), ("a", "ascending"), ("leads", "descending")])
        a, leads = table.column("a").to_numpy(), table.column("leads").to_numpy(zero_copy_only=False)
        node, n, common = table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.int64), table.column("common").to_pylist()
        starts = np.flatnonzero(leads)
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
            if end - at < 2:
                continue
            own = np.sort(np.frombuffer(common[at], dtype=np.int64))
            sets = [np.frombuffer(c, dtype=np.int64) for c in common[at + 1 : end]]
            every = np.concatenate(sets)
            place = np.minimum(np.searchsorted(own, every), len(own) - 1)
            both = np.add.reduceat((own[place] == every).astype(np.int64), np.cumsum([0, *(len(s) for s in sets[:-1])]))
            near = both * similarity.denominator >= similarity.numerator * (n[at] + n[at + 1 : end] - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[at + 1 : end][near]), pa.array(node[at + 1 : end][near])], names=["a", "b"])

    pairs = written(pairs, "pairs")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    followers = pairs.join(blocks, "a").select("a", F.col("b").alias("node"), block.alias("block"), F.lit(False).alias("leads"))
    leaders = blocks.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("leads"))
    cells = sets.join(followers.unionByName(leaders), "node").select(F.xxhash64("a", "block").alias("cell"), "a", "leads", "node", "n", "common")
    return in_arrow(cells.repartition("cell"), compare, "a long, b long")


def in_cells(sets: DataFrame, parts: DataFrame, candidates: DataFrame, similarity: Fraction) -> DataFrame:
    """Links (a, b) that join just those nodes of each group of ``candidates`` which similar pairs connect, parts aside.

    parts: node, part of the nodes that are connected already.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        table = table.sort_by("cell")
        starts = np.flatnonzero(_first(table.column("cell").to_numpy()))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            if b - a < 2:
                continue
            cell = table.slice(a, b - a)
            node, n = cell.column("node").to_numpy(), cell.column("n").to_numpy().astype(np.int64)
            near = similar([np.frombuffer(c, dtype=np.int64) for c in cell.column("common").to_pylist()], n, similarity)
            np.fill_diagonal(near, True)
            head = np.arange(len(node))
            while (now := np.where(near, head[None, :], len(node)).min(axis=1)).tolist() != head.tolist():
                head = now
            moved = np.flatnonzero(head != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[head[moved]])], names=["a", "b"])

    found = components(candidates).withColumnRenamed("root", "group")
    found = written(found.join(parts, "node", "left").select("node", "group", F.coalesce("part", "node").alias("part")), "candidates")
    # parts of over BLOCK nodes have blocks of their own, behind those in which all others of the group are dealt
    counts = found.groupBy("group", "part").agg(F.count("*").alias("n"))
    large = written(counts.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "large")
    pool = counts.groupBy("group").agg(F.ceil(F.sum(F.when(F.col("n") <= BLOCK, F.col("n")).otherwise(0)) / BLOCK).cast("int").alias("pool"))
    ahead = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = large.select("group", "part", F.col("blocks").alias("own"), F.coalesce(F.sum("blocks").over(ahead), F.lit(0)).cast("int").alias("before"))
    total = large.groupBy("group").agg(F.sum("blocks").cast("int").alias("large"))
    placed = found.join(pool, "group").join(total, "group", "left").join(before, ["group", "part"], "left")
    placed = placed.withColumns({"all": F.col("pool") + F.coalesce("large", F.lit(0)), "first": F.coalesce(F.col("pool") + F.col("before"), F.lit(0)), "dealt": F.coalesce("own", "pool")})
    placed = placed.withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("dealt")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda o: F.col("own").isNull() | (o < F.col("first")) | (o >= F.col("first") + F.col("own")))
    placed = placed.select("node", "group", "block", F.explode(others).alias("other"))
    cell = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))
    cells = sets.join(placed.select("node", cell.alias("cell")), "node").select("cell", "node", "n", "common")
    return in_arrow(cells.repartition("cell"), compare, "a long, b long")


def verified_links(sets: DataFrame, proposed: DataFrame, similarity: Fraction) -> DataFrame:
    """Links (a, b) of similar nodes that connect all which similar pairs connect; the ``proposed`` pairs (a, b) of these sets are checked first."""
    buckets = written(prefixes(sets, similarity), "buckets")
    links = written(led(sets, proposed, similarity), "led")
    for seed in range(LEADERS + 1):
        parts = components(links).withColumnRenamed("root", "part")
        parted = buckets.join(parts, "node", "left").select("hash", "node", "n", F.coalesce("part", "node").alias("part"))
        if seed < LEADERS:
            links = links.unionByName(written(led(sets, leader_links(parted, similarity, seed), similarity), "led"))
    rest = in_cells(sets, parts, chain_links(parted, similarity), similarity)
    return links.unionByName(rest)


def linked(
    docs: DataFrame,
    shingles: Callable[[bytes], np.ndarray],
    signed: Callable[[np.ndarray], int],
    near: Callable[[DataFrame], DataFrame],
    similarity: Fraction,
    carried: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The rows (carried columns, node), and node -> root of the nodes that similar pairs connect to others.

    ``signed`` makes the fingerprint of a set; ``near`` proposes pairs (a, b) of rows (node, f0), one for each set.
    """
    rows = written(nodes_of(docs, shingles, signed, list(carried), text_col), "nodes")
    sets = written(shared_sets(docs, rows, shingles, similarity, text_col), "sets")
    # nodes whose shingles no other holds are similar to none, so they are not asked for
    prints = rows.select("node", "f0").distinct().join(sets.select("node"), "node", "left_semi")
    return rows, components(verified_links(sets, near(prints), similarity))


def _named(rows: DataFrame, roots: DataFrame, first) -> DataFrame:
    """node, first (of its rows) and root of every node."""
    nodes = rows.groupBy("node").agg(first.alias("first"))
    return written(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "named")


def grouped(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id and component_id of every row (doc_id, node): the least doc_id of all nodes that links connect."""
    named = _named(rows, roots, F.min("doc_id"))
    heads = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(heads, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def heads(rows: DataFrame, roots: DataFrame, digest: str) -> DataFrame:
    """doc_id and the digest of the row (doc_id, digest, node) that stands for each group: the least of both."""
    named = _named(rows, roots, F.min(F.struct("doc_id", digest)))
    return named.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
