"""Sharding by a minimax contiguous partition, with DataFrame functions only.

Rows of equal text are one atomic group; groups stand in the order of their text's 128-bit hash. The
shards are runs of that order, cut so that the largest shard is as small as possible: the smallest
feasible capacity is found by binary search, a capacity being feasible if filling shards greedily needs
no more shards than there are. The law is ``bytes``: sizes are as near equal as the groups allow.

The driver never sees all groups. It holds sums of cells (ranges of the hash); two greedy runs over cells
bound the capacity and every cut from below and above, and only cells in which a cut may fall are
refined, until those cells are single groups. The search itself then is exact.

Defined cases: a null text counts and hashes as the empty one; rows that repeat keep separate slots; an
empty table gives no rows; with fewer groups than shards some shards stay empty; a group larger than an
even share has a shard of its own size as the capacity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.shared import saved

SHARDS = 24
#: Bytes that a row counts besides its text.
ROW_BYTES = 8
#: Bits by which cells are refined, and groups that the driver takes at once.
BITS, TAKE = 8, 1 << 15


class Cells:
    """Runs of groups in order: the key of the first, total size, largest group and number of groups."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int]]):
        rows = sorted(rows)  # first h1, first h2, bits, total, largest, groups
        self.rows = rows
        self.total = np.array([r[3] for r in rows], np.int64)
        self.largest = np.array([r[4] for r in rows], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.total)])

    def land(self, x: int) -> int:
        """The cell in which place x of the running size lies."""
        return int(np.searchsorted(self.start, x, "right")) - 1

    def low(self, place: int, capacity: int) -> int:
        """A cut that begins at place falls here or later: the group at the limit begins in its cell, less than its size before."""
        x = place + capacity
        if x >= self.start[-1]:
            return int(self.start[-1])
        c = self.land(x)
        return int(max(self.start[c], x - self.largest[c] + 1))

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Where greedy shards end (exact where the cells at the cuts are single groups)."""
        out = [0]
        for _ in range(shards):
            out.append(self.low(out[-1], capacity) if self.rows else 0)
        return out[1:]

    def feasible(self, capacity: int, shards: int) -> bool:
        return not self.rows or self.cuts(capacity, shards)[-1] >= self.start[-1]

    def least(self, low: int, high: int, shards: int) -> int:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.feasible(mid, shards) else (mid + 1, high)
        return low


def find_cuts(groups: DataFrame, shards: int, take: int = TAKE, bits: int = BITS) -> tuple[int, list[tuple[int, int]]]:
    """The smallest capacity, and the (h1, h2) of the first group of every shard but the first.

    groups: h1, h2, total. Cells of b bits hold the groups whose h1 begins with the same b bits.
    """

    def cells(of: DataFrame, b: int) -> list[tuple]:
        cell = F.shiftright("h1", 64 - b).alias("cell")
        got = of.groupBy(cell).agg(F.min(F.struct("h1", "h2")).alias("first"), F.sum("total"), F.max("total"), F.count("*")).collect()
        return [(r["first"][0], r["first"][1], b, r[2], r[3], r[4]) for r in got]

    held = Cells(cells(groups, bits))
    total = int(held.start[-1])
    while True:
        low = max(-(-total // shards), int(held.largest.max(initial=0)))
        high = held.least(low, max(low, total), shards)
        near, far, coarse = 0, 0, set()
        for _ in range(shards - 1):
            near, far = held.low(near, low), min(total, far + high)
            if held.rows:
                for c in range(held.land(min(near, total - 1)), held.land(min(far, total - 1)) + 1):
                    if held.rows[c][5] > 1:
                        coarse.add(c)
        if not coarse:
            break
        fine: list[tuple] = [r for c, r in enumerate(held.rows) if c not in coarse]
        for b in sorted({held.rows[c][2] for c in coarse}):
            mine = [held.rows[c] for c in sorted(coarse) if held.rows[c][2] == b]
            of = groups.filter(F.shiftright("h1", 64 - b).isin([r[0] >> (64 - b) for r in mine]))
            if sum(r[5] for r in mine) <= take or b + bits > 56:
                fine += [(r[0], r[1], 64, r[2], r[2], 1) for r in of.select("h1", "h2", "total").collect()]
            else:
                fine += cells(of, b + bits)
        held = Cells(fine)
    capacity = held.least(low, max(low, high), shards)
    ends = held.cuts(capacity, shards)[:-1]
    return capacity, [held.rows[int(np.searchsorted(held.start, e))][:2] for e in ends if e < total]


def text_key(text: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def shard(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *text_key(F.col(text_col)))
    groups = saved(rows.groupBy("h1", "h2").agg(F.sum("size").alias("total"), F.count("*").alias("rows")))
    _, firsts = find_cuts(groups, shards)
    after = [((F.col("h1") > a) | ((F.col("h1") == a) & (F.col("h2") >= b))).cast("int") for a, b in firsts]
    count = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    parts = max(64, count // (shards * 20_000))  # of a shard, so that slots are dealt in many small parts and equal texts over all of them
    rows = rows.select("doc_id", "size", "text_crc32", sum(after, F.lit(0)).alias("shard"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts)).alias("part"))
    rows = saved(rows)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id"))
    return rows.withColumn("place", place).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
