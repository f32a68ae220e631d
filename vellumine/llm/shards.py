"""Sharding by minimax contiguous partition of ordered atomic groups, in DataFrame functions only.

Rows with equal texts form a group that no cut divides. Groups are ordered by a 64-bit hash of the
text. A binary search finds the smallest capacity with which a greedy walk along that order fills
no more than the wished number of shards.

The walk needs running sums only where cuts can fall. The driver holds sums at a few thousand
points of the key space; where a cut may fall between two points, that range alone is divided
again, until it holds a single group. So the result is exact, the groups stay on the executors,
and what comes to the driver is bounded by the number of shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.ranks import ranked
from vellumine.session import cut

#: Key bits of the first points (4096 ranges) and of each division of a range (64 parts).
FIRST_BITS, NEXT_BITS = 12, 6
#: Bytes that a row counts besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Range:
    start: int  # smallest key
    shift: int  # the range holds 2**shift keys
    groups: int
    weight: int
    heaviest: int


class _Line:
    """Known points of the order: sums of all before them, and what lies between."""

    def __init__(self, ranges: list[Range]):
        self.ranges = [r for r in sorted(ranges, key=lambda r: r.start) if r.groups]
        self.sums = [0]
        for r in self.ranges:
            self.sums.append(self.sums[-1] + r.weight)
        self.total = self.sums[-1]

    def whole(self, i: int) -> bool:
        """No cut can fall inside range i."""
        return i >= len(self.ranges) or self.ranges[i].groups <= 1

    def surely(self, capacity: int, shards: int) -> bool:
        """Cuts at known points alone suffice."""
        at = used = 0
        while at < len(self.ranges):
            then = bisect_right(self.sums, self.sums[at] + capacity) - 1
            used += 1
            if then == at or used > shards:
                return False
            at = then
        return True

    def perhaps(self, capacity: int, shards: int) -> bool:
        """Cuts suffice if ranges that are still unknown could be cut anywhere."""
        done = used = 0
        while done < self.total:
            i = bisect_right(self.sums, done + capacity) - 1
            then = self.sums[i] if self.whole(i) else done + capacity
            used += 1
            if then <= done or used > shards:
                return False
            done = then
        return True

    def least(self, test, shards: int) -> int:
        lo = max(max((r.heaviest for r in self.ranges), default=0), -(-self.total // shards))
        hi = max(self.total, lo)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if test(mid, shards) else (mid + 1, hi)
        return lo

    def open_between(self, low: int, high: int) -> set[Range]:
        """Unknown ranges that meet the sums from ``low`` to ``high``."""
        i, j = bisect_right(self.sums, low) - 1, bisect_right(self.sums, high) - 1
        return {self.ranges[k] for k in range(max(i, 0), min(j, len(self.ranges) - 1) + 1) if not self.whole(k)}


def _measure(groups: DataFrame, inside: list[Range] | None) -> list[Range]:
    """Divide ranges (None: the whole key space) and measure their parts."""
    out: list[Range] = []
    for shift in sorted({r.shift for r in inside}) if inside is not None else [64]:
        finer = max(64 - FIRST_BITS if shift == 64 else shift - NEXT_BITS, 0)
        part = groups
        if inside is not None:
            part = groups.where(F.shiftright("key", shift).isin([r.start >> shift for r in inside if r.shift == shift]))
        found = part.groupBy(F.shiftright("key", finer).alias("p")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("weight").alias("m"))
        out += [Range(r["p"] << finer, finer, r["n"], int(r["w"]), int(r["m"])) for r in found.collect()]
    return out


def cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of shards 1, 2, ... (a key may repeat: empty shards), and the smallest capacity.

    ``groups``: (key long, weight long), keys distinct. Among the partitions of the smallest capacity
    that one is taken whose cuts, from the left, lie nearest to equal shares of what is left.
    """
    ranges = _measure(groups, None)
    while True:
        line = _Line(ranges)
        high, low = line.least(line.surely, shards), line.least(line.perhaps, shards)
        if low == high:
            found, wanted = _balanced(line, high, shards)
        else:
            wanted = _reach(line, low, high, shards)
        if not wanted:
            return found, high
        ranges = [r for r in ranges if r not in wanted] + _measure(groups, sorted(wanted, key=lambda r: r.start))


def _reach(line: _Line, low: int, high: int, shards: int) -> set[Range]:
    """Unknown ranges in which greedy cuts can fall for a capacity from ``low`` to ``high``."""
    wanted: set[Range] = set()
    least = most = 0
    for _ in range(shards):
        i = bisect_right(line.sums, least + low) - 1
        wanted |= line.open_between(line.sums[i], min(most + high, line.total))
        least, most = line.sums[i], min(most + high, line.total)
        if len(wanted) > 2048:
            break
    return wanted


def _balanced(line: _Line, capacity: int, shards: int) -> tuple[list[int], set[Range]]:
    wanted: set[Range] = set()
    tail = [line.total]  # tail[k]: the least sum from which k more shards suffice
    for _ in range(shards - 1):
        at = max(tail[-1] - capacity, 0)
        i = bisect_left(line.sums, at)
        if line.sums[i] != at and not line.whole(i - 1):
            wanted.add(line.ranges[i - 1])
        tail.append(line.sums[i])
    found, done = [], 0
    for k in range(1, shards):
        share = done + -(-(line.total - done) // (shards - k + 1))
        low, high = max(tail[shards - k], done), done + capacity
        near = min(max(share, low), high)
        i = bisect_right(line.sums, near) - 1
        if line.sums[i] != near and not line.whole(i):
            wanted.add(line.ranges[i])
        options = [s for s in line.sums[i : i + 2] if low <= s <= high]
        done = min(options, key=lambda s: (abs(s - near), s)) if options else line.sums[i]
        place = bisect_left(line.sums, done)
        found.append(line.ranges[place].start if place < len(line.ranges) else None)
    last = (1 << 63) - 1
    return [last if k is None else k for k in found], wanted


def _shard(key: Column, starts: list[int]) -> Column:
    """Number of cuts at or below a key; no key reaches the last 64-bit value, which stands for the end."""
    return F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= key)) if starts else F.lit(0)


#: Groups of several rows whose first places are broadcast, of some 40 bytes each; more are joined by a shuffle.
BROADCAST_GROUPS = 1 << 18


def with_shards(df: DataFrame, shards: int = 40, text: str = "text", tie: str = "doc_id", position: str | None = None) -> DataFrame:
    """``df`` with ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``shard`` and ``slot`` (from 0 within the shard).

    Shard sizes in bytes are as near to equal as groups of equal texts allow: no partition of the order
    has a smaller largest shard. Null and empty texts are one group. Rows that repeat lie in one
    shard, each in a slot of its own; ``tie`` orders a cell's rows and need not be unique. An empty table has
    no rows. Columns of these names are replaced. Raises ValueError for fewer than one shard.

    Groups are ordered by a hash of the text, or by ``position``, a column of distinct longs from 0: each shard then is
    a range of positions, but for rows that belong to a group begun elsewhere, and slots follow positions. That column is left out.
    """
    if shards < 1:
        raise ValueError("there has to be a shard")
    own = [c for c in df.columns if c not in ("size", "text_crc32", "shard", "slot", position)]
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = df.select(
        F.struct(*own).alias("_own"),  # columns of df can't clash with those below
        F.col(tie).alias("_tie"),
        (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        # the last key is left free; two texts of one hash would share a shard
        F.least(F.xxhash64(whole), F.lit((1 << 63) - 2)).alias("_key"),
        *([F.col(position).alias("_at")] if position else []),
    )
    if position is None:
        groups = cut(keyed.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("weight")))
        starts, _ = cuts(groups, shards)
        placed = keyed.withColumn("shard", _shard(F.col("_key"), starts).cast("int"))
        return ranked(placed, "shard", "_key", "_tie", "size", "slot", "_sum").select("_own.*", "size", "text_crc32", "shard", "slot")
    groups = cut(keyed.groupBy("_key").agg(F.min("_at").alias("key"), F.sum("size").alias("weight"), F.count("*").alias("_rows")))
    starts, _ = cuts(groups.select("key", "weight"), shards)
    # rows of a group lie where its first one does; most groups are one row
    several = groups.where("_rows > 1").select("_key", F.col("key").alias("_begun"))
    several = F.broadcast(several) if several.count() <= BROADCAST_GROUPS else several
    placed = keyed.join(several, "_key", "left").withColumn("shard", _shard(F.coalesce("_begun", "_at"), starts).cast("int"))
    return ranked(placed, "shard", "_at", None, "size", "slot", "_sum").select("_own.*", "size", "text_crc32", "shard", "slot")
