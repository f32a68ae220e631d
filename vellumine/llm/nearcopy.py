"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Under each random permutation a document keeps both its smallest and its largest shingle hash, so
n permutations give 2n signature values for n hash evaluations. Runs of values are bands;
documents that share a band are candidates. What follows never writes out the pairs of a group:

1. Documents with equal shingle sets collapse to one representative.
2. In each band's bucket every member is held against the bucket's first member (a star), on
   full sets; stars of links give components.
3. Only buckets that still hold several components are worked through completely. Where all but the main component
   fits into one block, that block meets the others in pairs: each is one bounded task that compares whole
   sets by matrix products, and a task returns at most a spanning forest of the links it finds.
4. In buckets with a larger rest every member names the shingles of its prefix: as many of its rarest in the bucket as two linked
   sets cannot both miss. Members that share one are held against the first of them, then, where several
   components are left, in pairs of blocks. A template with very many fills shares no prefix, so its cost
   is one set and one prefix a member, not one a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.arrow import by_bytes, bounded_batches, utf8
from vellumine.llm.components import components
from vellumine.llm.words import NOT_SPACE, mix, shingles, words
from vellumine.session import cut

#: 70 permutations give 140 values in 28 bands of 5. A pair with similarity 0.85 shares no band with
#: probability 7e-8, one with 0.8 with 1.5e-5.
PERMUTATIONS, BAND_ROWS = 70, 5
#: Most members, and about most shingles, of one block of a bucket.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20
#: Members of a bucket whose shingles tell which are rare in it.
RARE_SAMPLE = 64
#: Up to so many ids are broadcast to find the texts of candidates; beyond it that join shuffles.
BROADCAST_IDS = 1 << 20

_SCAN_BYTES = 1 << 19
_HAS_SET = "n_shingles > 0 AND doc_id IS NOT NULL"


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    keys = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return keys[:n] | np.uint64(1), keys[n:]


def signature_bands(sets: np.ndarray, offsets: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """Band keys, one row for each non-empty set of hashes."""
    factors, terms = _permutations(permutations)
    starts = offsets[:-1]
    values = np.empty((2 * permutations, len(starts)), dtype=np.uint64)
    for p in range(permutations):
        permuted = sets * factors[p] + terms[p]
        values[2 * p] = np.minimum.reduceat(permuted, starts)
        values[2 * p + 1] = np.maximum.reduceat(permuted, starts)
    bands = 2 * permutations // rows
    keys = np.empty((len(starts), bands), dtype=np.uint64)
    for k in range(bands):
        key = np.full(len(starts), k + 1, dtype=np.uint64)
        for row in values[k * rows : (k + 1) * rows]:
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + row)
        keys[:, k] = key
    return keys


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and their offsets."""
    all_of, offsets = shingles(words(texts, NOT_SPACE), size)
    own = [np.unique(all_of[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
    return (np.concatenate(own) if own else all_of), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def signatures(documents: DataFrame, size: int, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands) of each document: set size, a 128-bit digest of the set, band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, texts in by_bytes(utf8(batch.column(1)), _SCAN_BYTES):
                sets, offsets = shingle_sets(texts, size)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                keys = np.zeros((len(texts), 2 * permutations // rows), dtype=np.uint64)
                digest = np.zeros((2, len(texts)), dtype=np.uint64)
                if len(full):
                    tight = np.concatenate([offsets[full], offsets[-1:]])
                    keys[full] = signature_bands(sets, tight, permutations, rows)
                    for k, salt in enumerate((0x632BE59BD9B4E019, 0x9FB21C651E98DF25)):
                        digest[k, full] = np.add.reduceat(mix(sets ^ np.uint64(salt)), tight[:-1])
                held = np.concatenate([[0], np.cumsum(np.where(n > 0, keys.shape[1], 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in digest), pa.ListArray.from_arrays(pa.array(held), pa.array(keys[full].reshape(-1).view(np.int64)))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    bounded_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _sets(documents: DataFrame, size: int) -> DataFrame:
    """(id, shingles) with the full sorted set of each document's shingle hashes."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in by_bytes(utf8(batch.column(1)), _SCAN_BYTES):
                sets, offsets = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["id", "shingles"])

    return documents.select("doc_id", "text").mapInArrow(collect, "id long, shingles array<long>")


def _block_links(percent: int):
    """Function of one pair of blocks: edges between components, a spanning forest of the links found."""

    def links(block: pd.DataFrame) -> pd.DataFrame:
        side = block["side"].to_numpy()
        # block pair (i, i) has its members once, (i, j) those of i and of j
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        size = block["shingles"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(block)), size)
        values = np.concatenate(block["shingles"].to_list())
        _, column = np.unique(values, return_inverse=True)
        often = np.bincount(column) > 1  # a shingle of one member meets no other
        keep = often[column]
        owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        most = int(often.sum())
        for begin in range(0, most, 8192):
            lo, hi = np.searchsorted(column, [begin, begin + 8192])
            dense = np.zeros((len(block), min(8192, most - begin)), dtype=np.float32)
            dense[owner[lo:hi], column[lo:hi] - begin] = 1
            common += dense[left] @ dense[right].T
        union = size[left][:, None] + size[right][None, :] - common
        of = block["component"].to_numpy()
        linked = (100 * common >= percent * union) & (of[left][:, None] != of[right][None, :])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i, j in np.argwhere(linked):
            a, b = int(of[left[i]]), int(of[right[j]])
            if find(a) != find(b):
                root[find(a)] = find(b)
                found.append((a, b))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return links


def _prefixes(percent: int):
    """Function of one part of a bucket, its members (side 0) and its sample (side 1): the shingles of each member's prefix."""

    def prefixes(part: pd.DataFrame) -> pd.DataFrame:
        common = part["side"].to_numpy() == 1
        values, often = np.unique(np.concatenate([*part.loc[common, "shingles"], np.zeros(0, np.int64)]), return_counts=True)
        out = []
        for rep, component, x in part.loc[~common, ["rep", "component", "shingles"]].itertuples(index=False):
            n = len(x) - -(-percent * len(x) // 100) + 1
            place = np.minimum(np.searchsorted(values, x), max(len(values) - 1, 0))
            seen = np.where(values[place] == x, often[place], 0) if len(values) else np.zeros(len(x), np.int64)
            # the rarest first, equally rare ones in the order of a second hash: one order for the whole bucket
            rarest = np.lexsort((mix(x.view(np.uint64)), seen))[:n]
            out.append(pd.DataFrame({"rep": rep, "component": component, "shingle": x[rarest]}))
        found = pd.concat(out) if out else pd.DataFrame({"rep": [], "component": [], "shingle": []})
        found["band"] = part["band"].iloc[0]
        return found[["band", "rep", "component", "shingle"]].astype("int64")

    return prefixes


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents`` (doc_id, text, any more).

    Words are runs of other than ASCII white space, A-Z lowered; a set holds the distinct shingles of
    ``size`` words, or the whole sequence if it is shorter. Documents are linked if 100 times their
    common shingles are at least ``percent`` times all their shingles. component_id is the smallest
    doc_id that links reach; the row with that doc_id is kept. Null, empty and white-space
    texts have no shingles and link with nothing. Rows that repeat a doc_id get equal component
    values if their texts are equal; a null doc_id is kept, alone, with a null component.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(signatures(documents, size, permutations, rows))
    full = signed.where(_HAS_SET)
    # Aggregates are written before they are joined: a join of two plain shuffles is one that adaptive execution splits where a key is hot.
    first = cut(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    bands = full.join(first, ["d1", "d2"]).where("doc_id = rep").select("rep", F.explode("bands").alias("band")).distinct()

    buckets = bands.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n"), F.sum(F.xxhash64("rep") % 1_000_000_007).alias("who")).where("n > 1")
    buckets = cut(buckets.groupBy("hub", "n", "who").agg(F.min("band").alias("band")))  # one bucket of those with equal members
    held = cut(bands.join(buckets.select("band", "hub"), "band"))

    ids = cut(held.select(F.col("rep").alias("doc_id")).distinct())
    count = ids.count()
    if not count:
        return _result(signed, first, [])
    sets = cut(_sets(documents.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", "left_semi"), size))

    stars = components(_star_links(held, sets, percent))
    blocked = _unresolved(held.select("band", "rep"), stars, sets)
    found = _compared(blocked.where("k1 = 1"), sets, percent)
    large = blocked.where("k1 > 1")
    if not large.isEmpty():
        found = found.union(_by_prefix(large, sets, percent))
    return _result(signed, first, [stars, components(found)])


def _star_links(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) of members (rep) with their ``hub``, on full sets."""
    pairs = held.where("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    near = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    near = near.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return near.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the ``component`` of ``rep``: itself unless ``found`` says more."""
    return rows.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _unresolved(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with the blocks that each bucket fills.

    (band, rep, component, main, k0, k1): ``main`` is the bucket's largest component, which fills ``k0`` blocks,
    and the rest ``k1``; what fits into one block altogether has k0 = 0 and k1 = 1.
    """
    labelled = _labelled(members, found)
    several = cut(labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo < hi AND m > 2").select("band"))
    sizes = sets.select(F.col("id").alias("rep"), F.size("shingles").alias("size"))
    inside = cut(labelled.join(several, "band").join(sizes, "rep").select("band", "rep", "component", "size"))
    return _blocked(inside)


def _blocked(inside: DataFrame) -> DataFrame:
    """(band, rep, component, main, k0, k1) of (band, rep, component, size)."""
    parts = inside.groupBy("band", "component").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    stats = parts.groupBy("band").agg(F.max(F.struct("c", "s", "component")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    need = lambda c, s: F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    one = need(F.col("c"), F.col("s")) == 1  # what fits into one block is one block
    blocks = cut(
        stats.select(
            "band",
            F.col("main.component").alias("main"),
            F.when(one, 0).otherwise(need(F.col("main.c"), F.col("main.s"))).alias("k0"),
            F.when(one, 1).otherwise(need(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s"))).alias("k1"),
        )
    )
    return inside.select("band", "rep", "component").join(blocks, "band")


def _by_prefix(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within buckets whose rest is large: members that share a shingle of their prefixes, first as stars, then completely."""
    parts = F.col("k0") + F.col("k1")
    dealt = large.select("band", "rep", "component", F.pmod(F.xxhash64("rep"), parts).cast("long").alias("part"), F.lit(0).alias("side"))
    # a sample of the bucket, by hash, goes to each of its parts
    chance = F.greatest(F.lit(1), (parts * F.lit(BLOCK_ROWS) / F.lit(RARE_SAMPLE)).cast("long"))
    sample = large.where(F.pmod(F.xxhash64("rep", "band"), chance) == 0)
    sample = sample.select("band", "rep", "component", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))).alias("part"), F.lit(1).alias("side"))
    shipped = dealt.union(sample).join(sets.withColumnRenamed("id", "rep"), "rep")
    named = cut(shipped.groupBy("band", "part").applyInPandas(_prefixes(percent), "band long, rep long, component long, shingle long"))
    groups = cut(named.groupBy("band", "shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("rep", "component")).alias("hub")).where("lo < hi"))
    held = cut(named.join(groups.select("band", "shingle", "hub"), ["band", "shingle"]).select(F.xxhash64("band", "shingle").alias("band"), "rep", "component", "hub"))
    near = cut(_star_links(held.where("component != hub.component").select("rep", F.col("hub.rep").alias("hub")), sets, percent))
    known = held.select("rep", "component").distinct()
    for side in ("a", "b"):
        near = near.join(known.select(F.col("rep").alias(side), F.col("component").alias(f"{side}_component")), side)
    met = near.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")).distinct()
    # groups of a shingle whose components the stars have not made one
    now = components(met).select(F.col("id").alias("component"), F.col("component").alias("_now"))
    left = held.select("band", "rep", "component").join(now, "component", "left").select("band", "rep", F.coalesce("_now", "component").alias("component")).distinct()
    left = cut(left)
    several = cut(left.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo < hi AND m > 2").select("band"))
    sizes = sets.select(F.col("id").alias("rep"), F.size("shingles").alias("size"))
    rest = cut(left.join(several, "band").join(sizes, "rep").select("band", "rep", "component", "size"))
    return met.union(_compared(_blocked(rest), sets, percent))


def _compared(blocked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket, found block by block.

    Members of a bucket's main component need not be held against each other: their blocks meet those of the rest only.
    """
    place = F.xxhash64("rep", "band")
    rest = F.col("component") != F.col("main")
    block = F.when(F.col("k0") == 0, 0).when(rest, F.col("k0") + F.pmod(place, F.col("k1"))).otherwise(F.pmod(place, F.greatest("k0", F.lit(1)))).cast("int")
    dealt = blocked.withColumn("rest", rest).withColumn("block", block)
    # a block is the lower of a pair on side 0, the higher on side 1
    others = F.sequence(F.when(F.col("rest"), 0).otherwise(F.col("k0")), F.col("k0") + F.col("k1") - 1)
    meets = F.transform(others, lambda o: F.struct(F.least(o, "block").alias("lo"), F.greatest(o, "block").alias("hi"), F.when(F.col("block") > o, 1).otherwise(0).alias("side")))
    dealt = dealt.select("band", "rep", "component", F.explode(meets).alias("m")).select("band", "rep", "component", "m.*")
    shipped = dealt.join(sets.withColumnRenamed("id", "rep"), "rep")
    return shipped.groupBy("band", "lo", "hi").applyInPandas(_block_links(percent), "a long, b long")


def _result(signed: DataFrame, first: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Compose set -> representative -> component of each of ``found`` in turn; documents meet their set last.

    What is composed has one row a set and is written, so that documents are shuffled once and few stages run at a time: the driver's need
    grows with those.
    """
    label = first
    for step in found:
        label = _labelled(label, step).withColumn("rep", F.col("component")).drop("component")
    label = cut(label.select("d1", "d2", "rep")) if found else label
    with_set = signed.where(_HAS_SET).join(label, ["d1", "d2"]).select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    out = with_set.union(signed.where(~F.expr(_HAS_SET)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each group of near duplicates, the one with the smallest doc_id; all columns kept.

    Rows without words stay, and so do rows with a null doc_id. Of rows that repeat a doc_id one stays, the same in every
    run: that with the smallest hash of its columns.
    """
    found = near_duplicates(documents, size, percent)
    gone = cut(found.where("NOT kept").select("doc_id").distinct())
    count = gone.count()
    kept = documents.join(F.broadcast(gone) if count <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*documents.columns)
    again = cut(documents.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    order = F.struct(F.xxhash64(*documents.columns), "text")
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), order).alias("_row")).select("_row.*")
    return kept.join(again, "doc_id", "left_anti").select(*documents.columns).unionByName(once)
