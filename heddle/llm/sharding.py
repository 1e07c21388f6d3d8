"""Sharding by best-fit-decreasing bin packing over a balanced tree of remaining capacities.

Groups of equal texts are the indivisible items. The few groups that are large against a shard (their
number has a fixed bound) are placed once, for all; the rest is dealt to cells by hash, each of which packs
its own share of every shard's remaining capacity, largest group first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import id_and_text, in_arrow, written

#: Groups of over 1 / (shards * LARGE) of all bytes are placed on the driver: shards * LARGE groups at most.
LARGE = 64
MOST_CELLS = 4096
ROWS_IN_CELL = 20_000
GROUPS_IN_CELL = 50_000


class Tree:
    """AVL tree of (remaining capacity, bin), ordered; all steps take logarithmic time."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # [key, left, right, height]

    @staticmethod
    def _fixed(n: list) -> list:
        def height(x):
            return x[3] if x else 0

        def settle(x):
            x[3] = 1 + max(height(x[1]), height(x[2]))
            return x

        def lean(x):
            return height(x[1]) - height(x[2])

        def turned(x, near, far):
            up = x[near]
            x[near] = up[far]
            up[far] = settle(x)
            return settle(up)

        settle(n)
        for near, far, sign in ((1, 2, 1), (2, 1, -1)):
            if sign * lean(n) > 1:
                if sign * lean(n[near]) < 0:
                    n[near] = turned(n[near], far, near)
                return turned(n, near, far)
        return n

    def add(self, key: tuple) -> None:
        def go(n):
            if n is None:
                return [key, None, None, 1]
            side = 1 if key < n[0] else 2
            n[side] = go(n[side])
            return self._fixed(n)

        self.root = go(self.root)

    def remove(self, key: tuple) -> None:
        def go(n, k):
            if k == n[0]:
                if n[1] is None or n[2] is None:
                    return n[1] or n[2]
                after = n[2]
                while after[1]:
                    after = after[1]
                n[0] = after[0]
                n[2] = go(n[2], after[0])
            else:
                side = 1 if k < n[0] else 2
                n[side] = go(n[side], k)
            return self._fixed(n)

        self.root = go(self.root, key)

    def tightest(self, size: float) -> tuple | None:
        """The least remaining capacity that still takes ``size``."""
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[1]
            else:
                n = n[2]
        return best

    def roomiest(self) -> tuple | None:
        n = self.root
        while n and n[2]:
            n = n[2]
        return n and n[0]


def best_fit_decreasing(sizes: list[float], room: list[float], capacity: float | None = None) -> tuple[list[int], list[float]]:
    """Bin of each item and the bins' remaining room; larger items first, each into the tightest bin that takes it.

    room: the bins there are. With ``capacity`` an item that fits nowhere opens a new bin of that
    capacity, so that few bins are used; without, the roomiest bin takes it beyond its capacity.
    """
    tree, room, out = Tree(), list(room), [0] * len(sizes)
    for k, r in enumerate(room):
        tree.add((r, k))
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.tightest(sizes[i])
        if at is None and capacity is not None:
            at = (max(capacity, sizes[i]), len(room))
            room.append(at[0])
        else:
            at = at or tree.roomiest()
            tree.remove(at)
        left, k = at[0] - sizes[i], at[1]
        room[k], out[i] = left, k
        tree.add((left, k))
    return out, room


def shard_documents(docs: DataFrame, shards: int = 16, most_share: float | None = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; sizes of shards nearly equal.

    Law ``bytes``. A group of equal texts is an indivisible item and stays in one shard. Only a group of more than
    ``most_share`` of a shard's fair share, which no packing into equal shards could hold, is dealt out in parts by
    doc_id; with ``most_share`` None no group is ever divided, and a shard is as large as its largest group. Size is
    the UTF-8 bytes of the text plus 1; a null text is empty and groups with empty ones. Slots run
    without gaps from 0 in each shard. The result depends on the rows alone: groups are dealt to cells by hash, and a
    cell is packed by itself, whatever task it falls to. Ties in size go by the text's hash; texts of any length
    are read once; repeated rows take a slot each; an empty table gives no rows;
    other columns are ignored; grown_shard is null, as this law doesn't keep places when shards are added.
    """
    text = F.coalesce("text", F.lit(""))
    rows = id_and_text(docs).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"))
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, n_rows, n_groups = groups.agg(F.sum("bytes"), F.sum("n"), F.count("*")).first()
    fair = (total or 0) / shards
    # groups of over 1 / (shards * LARGE) of all bytes, or of all rows: 2 * shards * LARGE at most
    large = groups.where((F.col("bytes") > fair / LARGE) | (F.col("n") > (n_rows or 0) / (shards * LARGE))).collect()
    large = sorted((r["text_key"], r["bytes"], r["n"]) for r in large)
    divided = {k: int(LARGE * b // fair) + 1 for k, b, _ in large if most_share is not None and b > most_share * fair}
    items = [((k, 0), b) for k, b, _ in large if k not in divided and b > fair / LARGE]
    parted = rows.withColumns({"part": F.lit(0), "salts": F.lit(1)})
    if large:
        known = _table(rows, [(k, divided.get(k, 1), n // ROWS_IN_CELL + 1) for k, _, n in large], "text_key long, cut int, salts int")
        by_id = F.xxhash64("doc_id", "text_crc32")
        parted = rows.join(F.broadcast(known), "text_key", "left").withColumns({"part": F.pmod(by_id, F.coalesce("cut", F.lit(1))).cast("int"), "salts": F.coalesce("salts", F.lit(1))}).drop("cut")
    if divided:
        some = parted.where(F.col("text_key").isin(list(divided))).groupBy("text_key", "part").agg(F.sum("size").alias("bytes")).collect()
        items += sorted(((r["text_key"], r["part"]), r["bytes"]) for r in some)
    bins, room = best_fit_decreasing([b for _, b in items], [fair] * shards)
    room = [max(0.0, r) for r in room]
    over = sum(room) or 1.0
    shares = [r / over for r in room]
    cells = max(1, min(MOST_CELLS, (n_groups or 0) // GROUPS_IN_CELL))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).sort_by([("cell", "ascending"), ("bytes", "descending"), ("text_key", "ascending")])
        cell = whole.column("cell").to_numpy()
        starts = [0, *(i for i in range(1, len(cell)) if cell[i] != cell[i - 1]), len(cell)]
        keys, sizes, out = whole.column("text_key"), whole.column("bytes").to_pylist(), []
        for a, b in itertools.pairwise(starts):
            own = sum(sizes[a:b])
            # each cell starts at another shard, so that what cells' last items add does not fall on the same ones
            turn = int(cell[a]) % shards
            order = [*range(turn, shards), *range(turn)]
            out += [order[k] for k in best_fit_decreasing(sizes[a:b], [own * shares[s] for s in order])[0]]
        yield pa.RecordBatch.from_arrays([keys.combine_chunks(), pa.array([0] * len(out), pa.int32()), pa.array(out, pa.int32())], names=["text_key", "part", "shard"])

    schema = "text_key long, part int, shard int"
    small = groups.where(F.col("bytes") <= fair / LARGE).select("text_key", "bytes", F.pmod(F.xxhash64("text_key"), F.lit(cells)).cast("int").alias("cell"))
    placed = in_arrow(small.repartition("cell"), pack, schema)
    if items:
        placed = placed.unionByName(_table(rows, [(k, p, s) for ((k, p), _), s in zip(items, bins, strict=True)], schema))
    placed = written(placed, "placed")
    # a key of many rows meets its place under several salts, so no task takes all its rows
    parted = parted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    if large:
        placed = placed.join(F.broadcast(known.select("text_key", "salts")), "text_key", "left")
        placed = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    else:
        placed = placed.withColumn("salt", F.lit(0))
    found = parted.join(placed, ["text_key", "part", "salt"]).select("doc_id", "size", "text_crc32", "shard")
    found = written(found, "sharded")
    cells = max(1, min(MOST_CELLS, (n_rows or 0) // (ROWS_IN_CELL * shards)))
    found = found.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int"))
    counts = {(r["shard"], r["cell"]): r["count"] for r in found.groupBy("shard", "cell").count().collect()}  # shards * MOST_CELLS rows at most
    before, begin = [], 0
    for s in range(shards):
        begin = 0
        for c in range(cells):
            before.append((s, c, begin))
            begin += counts.get((s, c), 0)
    starts = F.broadcast(_table(rows, before, "shard int, cell int, begin long"))
    order = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        found.withColumn("n", F.row_number().over(order)).join(starts, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a frame."""
    names = [c.split()[0] for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return df.sparkSession.createDataFrame(pa.table(dict(zip(names, map(list, columns), strict=True))).cast(_arrow(schema)))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])
