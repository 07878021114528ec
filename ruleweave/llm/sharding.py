"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are packed from large to small; each enters the shard whose
remaining capacity is the tightest that holds it, found in a balanced tree. Equal
sizes are interchangeable, so the driver packs a histogram of the exact group sizes
rather than the groups. Different sizes that add up to T bytes are at most sqrt(2 T),
so the histogram is that of some 10 million rows at 100 TB, if every group had a size
of its own. The executors then hand the packed ranges to groups by their rank in
their size. The capacity
is the least (to a part in ten thousand) at which the given number of shards is
enough, which also makes their sizes near equal.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, spread_rank, text_or_empty

SHARDS = 24
ROW_BYTES = 8
#: Cells into which the rows of a shard (and the groups of a size class) are cut to be numbered.
CELLS = 1024


class RemainingTree:
    """A balanced search tree (treap) of (remaining capacity, shard)."""

    def __init__(self) -> None:
        self.root, self.draw = None, random.Random(7)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._cut(self.root, key)
        self.root = self._joined(self._joined(low, [self.draw.random(), key, None, None]), high)

    def remove(self, key: tuple[int, int]) -> None:
        low, rest = self._cut(self.root, key)
        _, high = self._cut(rest, (key[0], key[1] + 1))
        self.root = self._joined(low, high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest key with at least ``size`` left."""
        node, found = self.root, None
        while node:
            if node[1][0] >= size:
                node, found = node[2], node[1]
            else:
                node = node[3]
        return found

    def _cut(self, node, key):
        if not node:
            return None, None
        if node[1] < key:
            node[3], high = self._cut(node[3], key)
            return node, high
        low, node[2] = self._cut(node[2], key)
        return low, node

    def _joined(self, a, b):
        if not a or not b:
            return a or b
        if a[0] > b[0]:
            a[3] = self._joined(a[3], b)
            return a
        b[2] = self._joined(a, b[2])
        return b


def pack(sizes: list[tuple[int, int]], capacity: int, most: int | None = None, start: int = 0) -> list[tuple[int, int, int]] | None:
    """Best-fit decreasing over (size, count): (size, shard, count) in order of ranks, None if over ``most`` shards.

    A run of equal sizes fills the tightest shard as far as it goes: that is what
    packing its members one by one would do, as the shard they enter stays the tightest.
    """
    tree, shards, out = RemainingTree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        while count:
            key = tree.tightest(size)
            if key is None:
                if shards == most:
                    return None
                key = (capacity, start + shards)
                tree.add(key)
                shards += 1
            take = min(count, key[0] // size) if size else count
            tree.remove(key)
            tree.add((key[0] - take * size, key[1]))
            out.append((size, key[1], take))
            count -= take
    return out


def pack_into(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Pack into exactly ``shards`` at the least capacity; a group above the others' mean has a shard of its own."""
    rest, alone = {s: n for s, n in sizes if n}, []
    while rest and len(alone) < shards - 1:
        largest, total = max(rest), sum(s * n for s, n in rest.items())
        if largest * (shards - len(alone)) <= total:
            break
        alone.append((largest, len(alone), 1))
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
    if not rest:
        return alone
    left = shards - len(alone)
    low = max(max(rest), -(-sum(s * n for s, n in rest.items()) // left))
    high, items = low, list(rest.items())
    while (best := pack(items, high, left, len(alone))) is None:
        low, high = high, high + max(1, high // 64)
    while high - low > max(1, high // 10_000):
        mid = (low + high) // 2
        if (found := pack(items, mid, left, len(alone))) is None:
            low = mid
        else:
            best, high = found, mid
    return alone + best


def shard(docs: DataFrame, shards: int = SHARDS, law: str = "bytes") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    ``law``: ``bytes`` packs groups of equal texts so that sizes are near equal;
    ``rows`` deals rows so that counts are at most one apart; ``key`` lets doc_id
    and the number of shards decide (highest random weight), and grown_shard is
    the shard with one more. Null texts are as empty ones: size 8, text_crc32 0,
    one group. Repeated rows each get a slot; a null doc_id is a value like any.
    Equal texts whose bytes exceed a shard's share keep a shard of their own. An
    empty table gives an empty result. Other columns are not read.
    """
    text = text_or_empty()
    size = F.octet_length(text).cast("long") + ROW_BYTES
    rows = docs.select(F.col("doc_id").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"))
    cell = F.pmod(F.xxhash64("doc_id", "key"), F.lit(CELLS))
    if law == "bytes":
        rows = saved(rows.withColumn("key", F.unhex("key")), "rows")
        groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
        groups = groups.select("key", F.col("bytes").alias("class"))
        groups = saved(groups.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(CELLS))), "groups")
        histogram = [tuple(r) for r in groups.groupBy("class").count().collect()]  # at most sqrt(2 x all bytes) rows
        plan: dict[int, tuple[list[int], list[int]]] = {}
        given: dict[int, int] = {}
        for s, to, n in pack_into(histogram, shards):
            starts, shard_of = plan.setdefault(s, ([], []))
            starts.append(given.get(s, 0))
            shard_of.append(to)
            given[s] = given.get(s, 0) + n
        schema = T.StructType([T.StructField("class", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("of", T.ArrayType(T.IntegerType()))])
        ranges = docs.sparkSession.createDataFrame([(s, *x) for s, x in plan.items()], schema)
        ranked = spread_rank(groups, ["class"], ["cell"], [F.col("key")], "rank")
        placed = ranked.join(ranges, "class").select("key", F.element_at("of", F.size(F.filter("starts", lambda x: x <= F.col("rank")))).alias("shard"))
        rows = rows.join(placed, "key")
    elif law == "rows":
        rows = spread_rank(rows.withColumn("cell", cell), [], ["cell"], [F.col("doc_id"), F.col("key")], "rank")
        rows = rows.withColumn("shard", (F.col("rank") % shards).cast("int")).drop("rank", "cell")
    elif law == "key":
        def heaviest(n: int):
            return -F.array_max(F.array(*[F.struct(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(i)).alias("w"), F.lit(-i).alias("i")) for i in range(n)]))["i"]

        rows = rows.withColumn("shard", heaviest(shards)).withColumn("grown", heaviest(shards + 1))
    else:
        raise ValueError(f"no such law: {law}")
    rows = rows.withColumn("cell", cell)
    slotted = spread_rank(rows, ["shard"], ["cell"], [F.col("doc_id"), F.col("key")], "slot")
    grown = F.col("grown") if law == "key" else F.lit(None)
    return slotted.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), grown.cast("int").alias("grown_shard"))
