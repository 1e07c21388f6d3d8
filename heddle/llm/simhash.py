"""SimHash fingerprints and a Gray-order hierarchical index over them.

A bucket's distinct fingerprints are sorted by Gray rank, so that neighbours share bits. Runs of
FANOUT fingerprints form a node: the mask of the bits that all of them agree on and the pattern under
that mask; runs of nodes form the next level, again up to a root. A search descends from the root: the
differences under a node's mask bound those to all its members from below, so one comparison prunes the
whole group. A group that lies in the searcher's own component already is skipped as well.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import jaccard
from heddle.llm.common import id_and_text, in_arrow, slices, utf8, written
from heddle.llm.components import components

SEED = 42
FANOUT = 16


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; words lie between ASCII white space, A-Z lower-cased."""
    words = data.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    text = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further independent bits of a hash; word 0 is the hash itself."""
    if not word:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * word & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(data: bytes, size: int, words: int) -> np.ndarray:
    """The fingerprint of a text's shingles; no words: zero."""
    return voted(shingle_hashes(data, size), words)


def voted(hashes: np.ndarray, words: int) -> np.ndarray:
    """Each bit is 1 if it is set in over half of the hashes."""
    out = np.zeros(words, dtype=np.uint64)
    for w in range(words if len(hashes) else 0):
        votes = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = mixed(hashes[at : at + (1 << 16)], w)
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, size: int, words: int = 1, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id and f0, f1, ... (64 bits each, as signed longs) of every row."""
    names = [f"f{w}" for w in range(words)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", slice_bytes):
            found = np.stack([fingerprint(t, size, words) for t in utf8(piece.column("text"))]).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(found[:, w]) for w in range(words))], names=["doc_id", *names])

    return in_arrow(id_and_text(docs), scan, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def apart(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    d = a ^ b
    return np.bitwise_count(d if mask is None else d & mask).sum(axis=-1, dtype=np.int64)


class GrayIndex:
    """Index over fingerprints (n x words, uint64) of many buckets; a bucket is searched on its own.

    bucket: non-decreasing bucket numbers of the rows.
    """

    def __init__(self, bucket: np.ndarray, prints: np.ndarray):
        order = np.lexsort((gray_rank(prints[:, 0]), bucket))
        self.order, self.prints = order, prints[order]
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)])
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        self.levels = []  # from the leaves' parents upwards: first child, last child, mask, pattern
        mask, pattern, sizes_now = np.full_like(self.prints, ~np.uint64(0)), self.prints, sizes
        while True:
            first = np.concatenate([[0], np.cumsum(sizes_now)[:-1]])
            above = -(-sizes_now // FANOUT)
            inner = np.arange(above.sum()) - np.repeat(np.r_[0, np.cumsum(above)[:-1]], above)
            begin = np.repeat(first, above) + inner * FANOUT
            end = np.minimum(begin + FANOUT, np.repeat(first + sizes_now, above))
            every = np.bitwise_and.reduceat(pattern, begin, axis=0)
            some = np.bitwise_or.reduceat(pattern, begin, axis=0)
            agreed = np.bitwise_and.reduceat(mask, begin, axis=0) & ~(every ^ some)
            mask, pattern = agreed, every & agreed
            self.levels.append((begin, end, mask, pattern))
            if (above <= 1).all():
                break
            sizes_now = above
        self.root = np.arange(len(sizes))  # one node for each bucket on the top level

    def link(self, most: int, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(member, head) of every row that has others of its bucket in reach, as places in the original order."""
        n = len(self.prints)
        head = np.arange(n)

        def find(x: np.ndarray) -> np.ndarray:
            while ((up := head[x]) != x).any():
                head[x] = head[up]
                x = up
            return x

        for at in range(0, n, at_once):
            asks = np.arange(at, min(n, at + at_once))
            own = self.own_heads(find)
            me, node = asks, self.root[self.group[asks]]
            for depth in range(len(self.levels) - 1, -1, -1):
                begin, end, mask, pattern = self.levels[depth]
                near = end_after(self, depth, node) > me  # pairs are looked for once, with later rows
                me, node = me[near], node[near]
                same = own[depth][node] == head[me]
                near = ~same & (apart(self.prints[me], pattern[node], mask[node]) <= most)
                me, node = me[near], node[near]
                kids = end[node] - begin[node]
                me = np.repeat(me, kids)
                node = np.arange(len(me)) - np.repeat(np.cumsum(kids) - kids, kids) + np.repeat(begin[node], kids)
            later = (node > me) & (head[node] != head[me])
            me, node = me[later], node[later]
            close = apart(self.prints[me], self.prints[node]) <= most
            union(head, find, me[close], node[close])
        head = find(np.arange(n))
        moved = np.flatnonzero(head != np.arange(n))
        return self.order[moved], self.order[head[moved]]

    def own_heads(self, find) -> list[np.ndarray]:
        """For each node the head that all of its rows have, or -1."""
        out, low = [], find(np.arange(len(self.prints)))
        high = low
        for begin, _, _, _ in self.levels:
            low, high = np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)
            out.append(np.where(low == high, low, -1))
        return out


def end_after(index: GrayIndex, depth: int, node: np.ndarray) -> np.ndarray:
    """One past the last row under each node."""
    last = node
    for d in range(depth, -1, -1):
        last = index.levels[d][1][last] - 1
    return last + 1


def union(head: np.ndarray, find, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; heads point to smaller places."""
    while len(a):
        a, b = find(a), find(b)
        differ = a != b
        a, b = a[differ], b[differ]
        if not len(a):
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(head, high, low)
        a, b = np.unique(np.stack([low, high], axis=1), axis=0).T


def near_links(prints: DataFrame, keys, most: int, words: int) -> DataFrame:
    """Links (a, b) among rows (rep, f0, ...) that share a key and differ in ``most`` bits at most.

    ``keys`` maps an array of fingerprints (n x words) to n x k bucket keys. A worker takes whole
    buckets, and of each one returns a spanning forest: a row has at most one link for each key.
    """
    names = [f"f{w}" for w in range(words)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            rep = batch.column("rep").to_numpy()
            for at in range(0, len(rep), 4096):
                part = table[at : at + 4096]
                key = keys(part.view(np.uint64))
                k = key.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.reshape(-1)), pa.array(np.repeat(rep[at : at + 4096], k)), *(pa.array(np.repeat(part[:, w], k)) for w in range(words))],
                    names=["key", "rep", *names],
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        key = whole.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        size = np.diff(np.r_[np.flatnonzero(new), len(key)])
        keep = np.repeat(size > 1, size)  # a bucket of one has nothing to search
        order, number = order[keep], np.cumsum(new)[keep]
        if not len(order):
            return
        rep = whole.column("rep").to_numpy()[order]
        prints = np.stack([whole.column(c).to_numpy() for c in names], axis=1).view(np.uint64)[order]
        del whole, held
        a, b = GrayIndex(number, prints).link(most)
        pairs = np.unique(np.stack([rep[a], rep[b]], axis=1), axis=0)
        for at in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16), i]) for i in (0, 1)], names=["a", "b"])

    dealt = in_arrow(prints, deal, "key long, rep long, " + ", ".join(f"{n} long" for n in names))
    return in_arrow(dealt.repartition("key"), link, "a long, b long")


def block_keys(blocks: int, most: int):
    """Bucket keys that lose no pair: of so many blocks of a 64-bit fingerprint, all but ``most`` are equal if that many bits differ.

    A key is one choice of equal blocks: about 64 * (blocks - most) / blocks bits wide.
    """
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    masks = [sum((1 << hi) - (1 << lo) for lo, hi in (edges[b : b + 2] for b in chosen)) for chosen in itertools.combinations(range(blocks), blocks - most)]

    def keys(prints: np.ndarray) -> np.ndarray:
        x = prints[:, 0]
        # the kept bits, mixed with the number of the choice, in 64 bits: other choices' keys and other bits meet by chance only
        return np.stack([mixed(x & np.uint64(m), k + 1) for k, m in enumerate(masks)], axis=1).view(np.int64)

    return keys


def blocks_for(rows: int, most: int) -> int:
    """Blocks whose keys are as wide as ``rows`` fingerprints need, so that buckets of unlike ones stay small at every size."""
    blocks = most + 1
    while rows > 1 << (64 * (blocks - most) // blocks + 6) and blocks < 2 * most:
        blocks += 1
    return blocks


def within(nodes: DataFrame, most: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints (rep, f0; no two equal) that differ in ``most`` bits or fewer, and only such."""
    return near_links(nodes, block_keys(blocks_for(nodes.count(), most), most), most, 1)


def groups(docs: DataFrame, size: int = 3, most: int = 3) -> DataFrame:
    """doc_id, f0, component_id of every row; rows link at ``most`` differing bits or fewer.

    No link is lost, whatever the keys (see block_keys). Rows with equal fingerprints are one node, the least doc_id standing for
    them, so exact copies never meet in a bucket. A null text counts as empty; texts without words have
    fingerprint zero and link like others; repeated rows come back each; an empty table gives no rows; a
    null doc_id is kept and has component null if it alone has its fingerprint.
    """
    names = ["f0"]
    prints = written(fingerprints(docs, size), "prints")
    nodes = written(prints.groupBy(*names).agg(F.min("doc_id").alias("rep")), "nodes")
    found = components(within(nodes.where("rep is not null"), most))
    named = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*names, F.coalesce("root", "rep").alias("component_id"))
    named = written(named, "named")
    return prints.join(named, names, "left").select("doc_id", *names, "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: three-word shingles, links at three bits or fewer."""
    found = groups(docs, size=3, most=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Shingle size and least similarity of near-duplicates, and the bits in which fingerprints may differ that link at first.
SHINGLE, BOUND, MOST = 5, Fraction(4, 5), 3


def _five_words(data: bytes) -> np.ndarray:
    return shingle_hashes(data, SHINGLE)


def _signed(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of a set of hashes, as a signed long."""
    return int(voted(hashes, 1).view(np.int64)[0])


def proposed(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, f0) whose fingerprints are equal or linked by the Gray index at MOST bits or fewer.

    As in groups(), one node stands for all of its fingerprint; a is the one that stands for more.
    """
    prints = written(prints, "prints")
    standing = written(prints.groupBy("f0").agg(F.min("node").alias("rep")), "standing")
    equal = prints.join(standing, "f0").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = within(standing, MOST).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return equal.unionByName(near.distinct())


def _linked(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    return jaccard.linked(docs, _five_words, _signed, proposed, BOUND, carried, text_col)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and component_id; rows whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

    Fingerprints of these sets link first, at three bits or fewer, and each of their links is checked exactly; similar pairs
    that are further apart are found by their rarest shingles. The links are exact but for equal 64-bit hashes: no similar pair is lost and none below the bound links.
    Groups are transitive. A null text counts as empty; texts without words are copies of each other; repeated
    rows come back each; a null doc_id is kept and has component null if only such rows are in its group.
    """
    return jaccard.grouped(*_linked(docs))


def one_of_each(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates: of a group one row of the least doc_id stays.

    Of several rows with that doc_id in one group the least hash of all columns decides, and of wholly equal ones any
    stays; rows with that doc_id in other groups, whose texts differ, are judged there. Rows without a doc_id can't be named and stay.
    Null and empty texts, and those without words, are copies of each other; an empty table gives no rows; columns of
    any names are kept.
    """
    columns = docs.columns
    digest, row = "__row", F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    known = docs.where("doc_id is not null").withColumn(digest, row)
    heads = written(jaccard.heads(*_linked(known, ("doc_id", digest), text_col), digest), "heads")
    # the heads grow with the documents, so they are never broadcast, however few they are
    kept = known.join(heads.hint("shuffle_hash"), ["doc_id", digest], "left_semi")
    # both steps are dealt by the same key, so equal rows that meet here were shuffled once
    kept = kept.dropDuplicates(["doc_id", digest]).select(*(F.col(f"`{c}`") for c in columns))
    return kept.unionByName(docs.where("doc_id is null"))
