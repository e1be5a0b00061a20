"""Contiguous shards whose largest size is as small as it can be (minimax), over ordered atomic groups.

Rows with equal texts form one group, which stays whole. Groups are ordered by a hash of their text. The
smallest feasible capacity is found by binary search with a greedy check. The driver sees prefix sums only:
of 2^16 ranges of the hash at first, then of ever finer ranges around the places where cuts can fall.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells_for, saved, saved_rows, small_table, with_rank

FIRST, NEXT = 16, 10  # bits of the order key that the first and each further level tell apart


class Prefix:
    """Ordered atoms with prefix sums: (first key, end key, size, whether it is one group)."""

    def __init__(self, parts: list[tuple[int, int, int, bool]]):
        self.parts, self.ends, self.total = sorted(parts), [], 0
        for p in self.parts:
            self.total += p[2]
            self.ends.append(self.total)

    def _sum(self, at: int) -> int:
        return self.ends[at - 1] if at else 0

    def greedy(self, capacity: int, shards: int, at: int = 0) -> list[int]:
        """Fill one shard after another from atom ``at`` on; for each the number of atoms before its end."""
        out = []
        for _ in range(shards):
            at = bisect.bisect_right(self.ends, self._sum(at) + capacity, lo=at)
            out.append(at)
        return out

    def feasible(self, capacity: int, shards: int, at: int = 0) -> bool:
        return at == len(self.parts) or bool(shards) and self.greedy(capacity, shards, at)[-1] == len(self.parts)

    def least(self, shards: int, low: int, high: int) -> int:
        """Binary search of the smallest feasible capacity."""
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.feasible(mid, shards) else (mid + 1, high)
        return low

    def cut(self, capacity: int, shards: int) -> list[int]:
        """Ends of all shards but the last. None is above the capacity; inside it they are as even as the rest allows."""
        at, out = 0, []
        for left in range(shards, 1, -1):
            spent = self._sum(at)
            far = bisect.bisect_right(self.ends, spent + capacity, lo=at)
            even = min(far, bisect.bisect_left(self.ends, spent + -(-(self.total - spent) // left), lo=at) + 1)
            at = even if self.feasible(capacity, left - 1, even) else far
            out.append(at)
        return out


def _first_bits(bits: int):
    return F.shiftrightunsigned("key", 64 - bits)


def _sums(groups: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
    rows = groups.groupBy(_first_bits(bits).alias("p")).agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    wide = 64 - bits
    return [((k := r["p"] % (1 << 64)) << wide, (k + 1) << wide, r["size"], r["n"] == 1 or not wide) for r in rows]


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """The keys (unsigned) at which shards 1, 2, ... begin, for ``groups`` (key, size), keys distinct."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    groups = groups.select("key", "size", F.lit(1).alias("n"))
    bits, prefix = FIRST, Prefix(_sums(groups, FIRST))
    while True:
        low = max([-(-prefix.total // shards), *(p[2] for p in prefix.parts if p[3])])
        high = prefix.least(shards, low, prefix.total)
        # A cut at a capacity from low to high lies between these two, whatever the groups inside a range are.
        todo, top = set(), 0
        for end in prefix.greedy(low, shards):
            top = min(prefix.total, top + high)
            todo.update(k for k in range(end, min(len(prefix.parts), bisect.bisect_left(prefix.ends, top) + 1)) if not prefix.parts[k][3])
        if low == high or not todo:
            break
        wanted = [((prefix.parts[k][0] >> (64 - bits)),) for k in sorted(todo)]
        # A few ranges for each cut.
        table = small_table(groups.sparkSession, wanted, "p long")
        inside = groups.join(F.broadcast(table), _first_bits(bits) == F.col("p"), "left_semi")
        bits = min(64, bits + NEXT)
        prefix = Prefix([p for k, p in enumerate(prefix.parts) if k not in todo] + _sums(inside, bits))
    ends = prefix.cut(high, shards)
    return [prefix.parts[k][0] for k in ends if k < len(prefix.parts)]


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every row of ``docs`` in a shard.

    A null text counts as empty and groups with it, of size 1. Rows of one group share a shard, however many they
    are; repeated rows get slots of their own; null ids are kept. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")
    )
    rows = saved_rows(rows, "at")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    n = rows.count()
    cuts = minimax_cuts(saved(groups), shards) if n else []
    # Unsigned order of signed longs: flip the first bit.
    flipped = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    shard = sum((F.when(flipped >= F.lit(c - (1 << 63)), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = with_rank(rows.withColumn("shard", shard.cast("int")), ["shard"], cells_for(n, 20_000), tie="at")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

