"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in the order of a hash, are packed into blocks of equal bytes. At every moment the sources that
have blocks left share one slot in proportion to their weights; that is the ideal. Block k of a source is
released in the slot in which its ideal share first reaches k blocks and is due by the slot in which
it reaches k + 1, and each slot goes to the released block that is due first. The ideal itself keeps all
these windows, so earliest deadline first keeps them too: at every slot each source is less than one block
off its ideal share, also when other sources have run dry. Weights are taken as the exact
binary fractions that they are, so this holds for any weights.

The order of blocks is one sequence, made by one task that holds a few numbers a source and takes some
microseconds a block; blocks of 64 MB make a mix of 100 TB 1.6 million blocks long.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.ranks import counted, ranked
from vellumine.session import cut

#: Bytes of a block unless given.
BLOCK_BYTES = 4 << 10
#: Shares are taken as bytes to this power unless weights are given: small sources count for more.
TEMPER = 0.9
#: Blocks up to which their slots are broadcast, of some 130 bytes each, to rows of numbers and to whole rows; more are joined by
#: a shuffle, which costs more with whole rows.
BROADCAST_BLOCKS, BROADCAST_TO_ROWS = 1 << 16, 1 << 18
_BATCH = 1 << 16


class Ideal:
    """The ideal share of sources with some blocks and positive weights: exact, in closed form.

    In virtual time v a source has received min(v * weight, blocks); slots are the sum over all sources.
    """

    def __init__(self, blocks: Sequence[int], weights: Sequence[float]):
        ratios = [Fraction(w) for w in weights]
        whole = max((r.denominator for r in ratios), default=1)  # powers of two all
        self.blocks, self.parts = blocks, [int(r * whole) for r in ratios]
        self.order = sorted(range(len(blocks)), key=lambda i: Fraction(blocks[i], self.parts[i]))
        self.done, self.rate = [0], [sum(self.parts)]  # before the j-th source runs dry: blocks of those dry, parts of the others
        for i in self.order:
            self.done.append(self.done[-1] + blocks[i])
            self.rate.append(self.rate[-1] - self.parts[i])

    def slots(self, i: int, k: int) -> tuple[int, int]:
        """Whole slots before, and up to, the moment at which source i has received k blocks."""
        p = self.parts[i]
        dry = bisect_left(self.order, True, key=lambda j: self.blocks[j] * p >= k * self.parts[j])
        before, rest = divmod(self.done[dry] * p + k * self.rate[dry], p)
        return before, before + (rest > 0)

    def end(self, lost: float) -> int:
        """Slots until sources with more than ``lost`` of the weight are dry; all of them if that never is."""
        least = Fraction(lost) * self.rate[0]
        for j, i in enumerate(self.order):
            if self.rate[0] - self.rate[j + 1] > least:
                return self.slots(i, self.blocks[i])[1]
        return self.done[-1]


def schedule(blocks: Sequence[int], weights: Sequence[float], lost: float = 1.0) -> Iterator[tuple[int, int, int, bool]]:
    """(source, block, slot, in_mix) of every block, slot by slot; sources are numbers.

    Blocks are in the mix up to the slot at which sources with more than ``lost`` of the weight have run
    dry: with 1, all are. Sources without a positive weight come last and are not in the mix.
    Of blocks that are due together the source with the lower number comes first.
    """
    live = [i for i, (n, w) in enumerate(zip(blocks, weights, strict=True)) if n > 0 and w > 0]
    ideal = Ideal([blocks[i] for i in live], [weights[i] for i in live])
    end = ideal.end(lost)
    placed = [0] * len(live)
    waiting = [(0, j) for j in range(len(live))]
    ready: list[tuple[int, int]] = []
    for slot in range(ideal.done[-1]):
        while waiting and waiting[0][0] <= slot:
            _, j = heapq.heappop(waiting)
            heapq.heappush(ready, (ideal.slots(j, placed[j] + 1)[1], j))
        _, j = heapq.heappop(ready)
        yield live[j], placed[j], slot, slot < end
        placed[j] += 1
        if placed[j] < ideal.blocks[j]:
            heapq.heappush(waiting, (ideal.slots(j, placed[j])[0], j))
    slot = ideal.done[-1]
    for i in sorted(set(range(len(blocks))) - set(live)):
        for k in range(blocks[i]):
            yield i, k, slot, False
            slot += 1


_SLOTS = "_name string, block long, slot long, in_mix boolean"


def _scheduled(sources: DataFrame, lost: float) -> DataFrame:
    """The slot of each block of (_name, _blocks, _weight): one task, whose memory grows with the sources only."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_name", "_blocks", "_weight")), strict=True))
        names = pa.array([r[0] for r in rows], pa.string())
        held: list[tuple[int, int, int, bool]] = []
        for row in schedule([r[1] for r in rows], [r[2] for r in rows], lost):
            held.append(row)
            if len(held) == _BATCH:
                yield batch(names, held)
                held = []
        if held:
            yield batch(names, held)

    def batch(names: pa.Array, held: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
        source, block, slot, inside = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([names.take(pa.array(source, pa.int64())), pa.array(block, pa.int64()), pa.array(slot, pa.int64()), pa.array(inside)], names=["_name", "block", "slot", "in_mix"])

    return sources.coalesce(1).mapInArrow(order, _SLOTS)


def _name(source: str):
    """A source's name for matching: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("n"))


def _placed(df: DataFrame, weights: dict[str | None, float] | None, source: str, text: str, key: str, block_bytes: int, lost: float, most: int, *kept) -> DataFrame:
    """``kept`` columns of each row of ``df`` with size, block, slot, in_mix and, for an order, _key and _tie; ``most`` blocks are broadcast."""
    if any(w is None or not math.isfinite(w) for w in (weights or {}).values()):
        raise ValueError("weights have to be finite numbers")
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size")
    # copies of a key, null or not, are told apart by their texts, so that no key is one task's
    rows = df.select(*kept, size, F.xxhash64(F.col(key)).alias("_key"), F.xxhash64(F.col(key), F.col(text)).alias("_tie"), _name(source).alias("_name"))
    cells = cut(counted(rows, "_name", "_key", "_tie", "size"))
    sums = cells.groupBy(F.col("_group._name").alias("_name")).agg(F.sum("_sum").alias("_bytes"))
    if weights is None:
        weight = F.pow(F.col("_bytes").cast("double"), F.lit(TEMPER))
    else:
        given = df.sparkSession.createDataFrame([("n" if s is None else f"s:{s}", float(w)) for s, w in weights.items()] or [("", 0.0)], "_name string, _given double")
        sums, weight = sums.join(F.broadcast(given), "_name", "left"), F.greatest(F.coalesce("_given", F.lit(0.0)), F.lit(0.0))
    sources = sums.select("_name", F.ceil(F.col("_bytes") / F.lit(block_bytes)).cast("long").alias("_blocks"), weight.alias("_weight"))
    slots = cut(_scheduled(sources, lost))
    blocked = ranked(rows, "_name", "_key", "_tie", "size", counts=cells).withColumn("block", F.expr(f"before div {block_bytes}").cast("long"))
    return blocked.join(F.broadcast(slots) if slots.count() <= most else slots, ["_name", "block"])


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES, lost: float = 1.0) -> DataFrame:
    """(key, source, size, block, slot, in_mix) of each row of ``df``.

    ``size`` is UTF-8 bytes plus 16 (null and empty texts: 16). ``block`` counts the source's blocks of
    ``block_bytes`` and ``slot`` is the block's place in the mix; rows of one slot follow in any order. A row
    longer than a block takes the next blocks too, whose slots then hold no row. Null is a source of its own,
    with its weight given under None; null and repeated keys are rows like others, and rows that are equal
    in key and text share out their places in any way. Without ``weights`` a source's weight is its bytes to the
    power 0.9. Every row of a source with a positive weight is in the mix: what it has over its share takes
    later slots. With ``lost`` below 1 the mix ends once sources with more than that part of the weight have run dry.
    Sources without a weight, or with one of 0 or less, come last and are not in the mix; a weight that is None, NaN or infinite
    raises ValueError. Other columns are ignored; an empty table has no rows. Any number of sources can be mixed.
    """
    out = _placed(df, weights, source, text, key, block_bytes, lost, BROADCAST_BLOCKS, F.col(key).alias("_id"), F.col(source).alias("_source"))
    return out.select(F.col("_id").alias(key), F.col("_source").alias(source), "size", "block", "slot", "in_mix")


def mixed(df: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES, lost: float = 1.0) -> DataFrame:
    """The rows of ``df`` that are in the mix, sorted into its order across files, all columns kept.

    Each row takes its own place as ``mix`` says, whatever its key. Without ``weights`` that is every row.
    """
    own = F.struct(*df.columns).alias("_own")  # columns of df can't clash
    kept = _placed(df, weights, source, text, key, block_bytes, lost, BROADCAST_TO_ROWS, own).where("in_mix")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartitionByRange(n, "slot", "_key", "_tie").sortWithinPartitions("slot", "_key", "_tie").select("_own.*")
