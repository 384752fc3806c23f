"""Sharding: a contiguous partition of ordered groups that makes the largest shard as small as can be."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.session import numbered, slices, staged, tidied

#: Most histogram rows that the driver asks for at once.
HISTOGRAM_ROWS = 1 << 14


@dataclass
class Block:
    """Consecutive groups: ids with `id >> shift == number`."""

    shift: int
    number: int
    low: int
    high: int
    weight: int

    @property
    def whole(self) -> bool:
        return self.low == self.high


def histogram(items: DataFrame, shift: int, under: tuple[int, list[int]] | None = None) -> list[Block]:
    if under:
        items = items.where(F.shiftright("gid", under[0]).isin(under[1]))
    rows = items.groupBy(F.shiftright("gid", shift).alias("b")).agg(F.min("gid").alias("low"), F.max("gid").alias("high"), F.sum("weight").alias("weight"))
    return [Block(shift, r.b, r.low, r.high, r.weight) for r in rows.collect()]


class Prefix:
    """Sums over blocks in order. `ends[j]` is the weight of the first j blocks."""

    def __init__(self, blocks: list[Block], shards: int):
        self.blocks, self.shards, self.ends = sorted(blocks, key=lambda b: b.low), shards, [0]
        for b in self.blocks:
            self.ends.append(self.ends[-1] + b.weight)

    def reach(self, capacity: int, sure: bool, start: int = 0, shards: int | None = None) -> list[int]:
        """Where greedy cuts fall. sure: only at known ends of blocks, so the cuts can be made; else as far as a cut could
        lie if a block that is not yet split could be cut anywhere, so the true cuts lie no further."""
        at, cuts = start, []
        for _ in range(self.shards if shards is None else shards):
            x = at + capacity
            if x >= self.ends[-1]:
                return [*cuts, self.ends[-1]]
            j = bisect_right(self.ends, x) - 1
            at = self.ends[j] if sure or self.blocks[j].whole else x
            cuts.append(at)
        return cuts

    def fits(self, capacity: int, sure: bool, start: int = 0, shards: int | None = None) -> bool:
        if start == self.ends[-1]:
            return True
        cuts = self.reach(capacity, sure, start, shards)
        return bool(cuts) and cuts[-1] == self.ends[-1]

    def smallest(self, low: int, sure: bool) -> int:
        high = self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid, sure) else (mid + 1, high)
        return low


def plan(items: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, first id of each shard after the first) for items(gid, weight), gid unique.

    The capacity is searched on the driver over a histogram of the ids. Where a block is too coarse to tell a feasible
    capacity from one that is not, Spark counts that block again in finer blocks, until both bounds meet; so the result
    is exact, and the driver holds HISTOGRAM_ROWS rows for each round, whatever the number of groups.
    """
    first = items.agg(F.min("gid").alias("low"), F.max("gid").alias("high"), F.sum("weight").alias("total"), F.max("weight").alias("most")).first()
    if first.low is None:
        return 0, []
    shift = 0
    while (first.high >> shift) - (first.low >> shift) >= HISTOGRAM_ROWS:
        shift += 1
    blocks, floor_ = histogram(items, shift), max(first.most, -(-first.total // shards))
    while True:
        sums = Prefix(blocks, shards)
        low, high = sums.smallest(floor_, sure=False), sums.smallest(floor_, sure=True)
        if low == high:
            return high, cuts(sums, high)
        split: set[int] = set()
        for a, b in zip(sums.reach(low, sure=True), sums.reach(high, sure=False), strict=False):
            split.update(range(max(0, bisect_left(sums.ends, min(a, b)) - 1), bisect_right(sums.ends, max(a, b))))
        todo = [sums.blocks[j] for j in split if j < len(sums.blocks) and not sums.blocks[j].whole]
        finer = max(1, (HISTOGRAM_ROWS // len(todo)).bit_length() - 1)
        blocks = [b for b in blocks if b not in todo]
        for shift in {b.shift for b in todo}:
            blocks += histogram(items, max(0, shift - finer), (shift, [b.number for b in todo if b.shift == shift]))


def cuts(sums: Prefix, capacity: int) -> list[int]:
    """Cuts of shards no larger than `capacity`: each as near to an even share of what is left as the rest allows."""
    at, found = 0, []
    for left in range(sums.shards - 1, 0, -1):
        total = sums.ends[-1]
        if at >= total:
            break
        even = at + (total - at) / (left + 1)
        j = bisect_left(sums.ends, even)
        near = sorted({j - 1, j, bisect_right(sums.ends, at + capacity) - 1}, key=lambda i: abs(sums.ends[min(max(i, 0), len(sums.ends) - 1)] - even))
        for i in near:
            if 0 <= i < len(sums.ends) and at < sums.ends[i] <= at + capacity and sums.fits(capacity, True, sums.ends[i], left):
                at = sums.ends[i]
                break
        if at < total:
            found.append(sums.blocks[bisect_left(sums.ends, at)].low)
    return found


def place(value: Column, firsts: list[int], low: int = 0) -> Column:
    """How many of `firsts`, in order, the value reaches: a tree of comparisons, as deep as the logarithm of their number."""
    if not firsts:
        return F.lit(low).cast("int")
    mid = len(firsts) // 2
    return F.when(value >= F.lit(firsts[mid]), place(value, firsts[mid + 1 :], low + mid + 1)).otherwise(place(value, firsts[:mid], low))


@tidied
def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, size, text_crc32, group_id, law, shard, slot, grown_shard.

    The law is `bytes`. Rows with equal texts are one group, and groups stand in order of their smallest doc_id. The
    smallest capacity for which greedy filling needs no more than `shards` shards is searched for, and groups are cut
    into contiguous shards of that capacity at most. slot counts a shard's rows from 0, in order of doc_id.
    size is the UTF-8 bytes of the text plus 1. grown_shard is null under this law.

    Null text: no bytes, size 1, the crc of nothing (0), one group with empty texts. Null doc_id: last in its shard; a
    group without any id stands at id 0. Groups that have the same smallest doc_id (repeated ids) stay together.
    An empty table: no rows. Other columns of docs play no part, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_same"))
    base = staged(base)
    groups = staged(base.groupBy("_same").agg(F.coalesce(F.min("doc_id"), F.lit(0)).cast("long").alias("gid"), F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")))
    _, firsts = plan(groups.groupBy("gid").agg(F.sum("weight").alias("weight")), shards)
    of_group = groups.select(F.col("_same").alias("_g"), F.col("gid").alias("group_id"))
    rows = base.join(of_group, F.col("_same") == F.col("_g")).drop("_same", "_g")
    number = place(F.col("group_id"), firsts)
    n = slices(spark, groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 2_000_000)
    rows = numbered(rows.withColumn("shard", number), n, ["shard"], ["doc_id", "text_crc32"], "slot")
    return rows.select("doc_id", "size", "text_crc32", "group_id", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
