"""Sharding by best-fit-decreasing bin packing: groups of equal texts, largest first, enter the tightest shard that still takes them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut

#: Bundles of small groups hold this part of a shard; so the driver packs at most about 2 x FINE items a shard.
FINE = 500
#: Groups that one task bundles.
AT_ONCE = 100_000


class Room:
    """The bins' remaining capacities in a balanced (AVL) tree: the tightest that takes an item is found, removed and put back."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _built(key, left, right):
        height = lambda t: t[3] if t else 0
        node = lambda k, a, b: (k, a, b, 1 + max(height(a), height(b)))
        if height(left) > height(right) + 1:
            k, a, b, _ = left
            return node(k, a, node(key, b, right)) if height(a) >= height(b) else node(b[0], node(k, a, b[1]), node(key, b[2], right))
        if height(right) > height(left) + 1:
            k, a, b, _ = right
            return node(k, node(key, left, a), b) if height(b) >= height(a) else node(a[0], node(key, left, a[1]), node(k, a[2], b))
        return node(key, left, right)

    def add(self, room: int, bin_: int) -> None:
        def put(tree):
            if tree is None:
                return ((room, bin_), None, None, 1)
            key, left, right, _ = tree
            return self._built(key, put(left), right) if (room, bin_) < key else self._built(key, left, put(right))

        self.root = put(self.root)

    def tightest(self, size: int) -> tuple[int, int] | None:
        tree, found = self.root, None
        while tree:
            if tree[0][0] >= size:
                found, tree = tree[0], tree[1]
            else:
                tree = tree[2]
        return found

    def take(self, key: tuple[int, int]) -> None:
        def least(tree):
            return least(tree[1]) if tree[1] else tree[0]

        def cut_out(tree, gone):
            k, left, right, _ = tree
            if gone < k:
                return self._built(k, cut_out(left, gone), right)
            if gone > k:
                return self._built(k, left, cut_out(right, gone))
            if left is None or right is None:
                return left or right
            after = least(right)
            return self._built(after, left, cut_out(right, after))

        self.root = cut_out(self.root, key)


def best_fit(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each item; ``sizes`` come largest first and none exceeds ``capacity``. With ``bins``, None if these don't do."""
    room, out, used = Room(), [], 0
    if bins is not None:
        for b in range(bins):
            room.add(capacity, b)
    for size in sizes:
        key = room.tightest(size)
        if key is None:
            if bins is not None:
                return None
            key = (capacity, used)
            used += 1
        else:
            room.take(key)
        out.append(key[1])
        room.add(key[0] - size, key[1])
    return out


def into(sizes: list[int], bins: int) -> list[int]:
    """Items, largest first, in ``bins`` bins as evenly as best fit gets: items over an even share stand alone, and the rest share the
    smallest capacity, raised by a thousandth until all fit."""
    alone, left = 0, sum(sizes)
    while alone < bins - 1 and alone < len(sizes) and sizes[alone] * (bins - alone) >= left:
        left -= sizes[alone]
        alone += 1
    rest = sizes[alone:]
    capacity = max(-(-left // (bins - alone)), rest[0] if rest else 0)
    while (found := best_fit(rest, capacity, bins - alone)) is None:
        capacity += max(1, capacity // 1000)
    return [*range(alone), *(b + alone for b in found)]


def bundled(groups: DataFrame, unit: int, n_groups: int) -> DataFrame:
    """``key``, ``item``, ``size``, ``n`` of each group (``key``, ``size``): groups of ``unit`` or more are items of their own, smaller
    ones are packed into bundles of ``unit``, task by task. Where a group lands depends on its key and size alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"key": [], "size": []}), *frames])
        if held.empty:
            return
        held = held.assign(size=held["size"].astype("int64"), hex=held["key"].map(bytes.hex)).sort_values(["size", "hex"], ascending=[False, True])
        small = held["size"] < unit
        large = held[~small]
        items = [*range(len(large)), *(b + len(large) for b in best_fit(held[small]["size"].tolist(), unit))]
        yield pd.DataFrame({"key": held["key"], "item": [f"{TaskContext.get().partitionId()}:{i}" for i in items], "size": held["size"]})

    return groups.repartition(max(1, -(-n_groups // AT_ONCE)), "key").select("key", "size").mapInPandas(run, "key binary, item string, size long")


def shards(docs: DataFrame, bins: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``size`` (UTF-8 bytes + 1), ``crc`` of the text, ``shard`` and ``slot``, from 0.

    Equal texts (null texts too) are one group and share a shard, however many they are; a group larger than an even share therefore
    has a shard for itself, and the other shards are as even as best fit makes them. Groups under 1/500 of a shard are bundled where
    they are, so that the driver packs some thousand items whatever the input. Slots follow a hash of the id, then the id, without
    gaps; null ids stand first, repeated rows get slots of their own. A null text has no bytes. An empty table returns no rows.
    """
    text = F.col(text_col)
    key = F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(text, 256)))
    rows = cut(docs.select(F.col(id_col).alias("id"), key.alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    totals = groups.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    placed = cut(bundled(groups, max(1, totals["s"] // (bins * FINE)), totals["k"]))
    items = sorted(((r["s"], r["item"]) for r in placed.groupBy("item").agg(F.sum("size").alias("s")).collect()), key=lambda x: (-x[0], x[1]))
    found = into([s for s, _ in items], bins) if items else []
    spark = docs.sparkSession
    where = spark.createDataFrame(pd.DataFrame({"item": pd.Series([i for _, i in items], dtype=object), "shard": pd.Series(found, dtype="int32")}), "item string, shard int")
    assigned = placed.join(F.broadcast(where), "item").select("key", "shard")
    buckets = max(32, totals["n"] // (bins * 10_000))
    rows = cut(rows.join(assigned, "key").select("id", "size", "crc", "shard", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size")) - 1
    return rows.withColumn("own", slot).join(counts, ["shard", "bucket"]).select("id", "size", "crc", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"))
