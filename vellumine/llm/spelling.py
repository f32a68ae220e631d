"""Grouping of spelling variants: words of a corpus that differ by one edit, and the frequent form that each belongs to.

Method: even-partition pigeonhole join. A word of length l is parted at l // 2; one edit leaves one of the two segments
whole. Both are indexed with l and their place. A word probes the index with its own segments, for words of equal
length, and, for words one shorter, with what its segments would be if its extra code point stood in the other one: its head, and
its tail shifted by one place. Candidates share a key; each pair is taken under one key only and verified as a single edit.

Where a key has very many members, which all share one segment, the other segment of these words is parted in the same way,
again and again until it is one code point: what a bucket holds is bounded by a parameter or the alphabet, and no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut

#: Fixed value: what a run of letters is.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Members of a bucket over which it is divided again.
BUCKET = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = 1) -> DataFrame:
    """(key, run): every maximal run of letters of at least ``least`` code points, A-Z lowered. Null texts have none."""
    runs = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return df.select(F.col(key).alias("key"), F.explode(runs).alias("run"))


def misspelt(runs: DataFrame, one_in: int) -> DataFrame:
    """(word): runs, of which one in ``one_in`` loses a code point; which, and where, is a hash of key and run."""
    h = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(h % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n): distinct words of some length and count. Counts combine before the shuffle, however frequent a word is."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _members(words: DataFrame) -> DataFrame:
    """(word, n, size, lo, hi, longer): each word once for each segment that may hold the edit, places lo to hi of an indexed word of ``size``.

    ``longer`` rows are probes for words of one code point less; the others are indexed and probe each other.
    """
    size = F.length("word")
    of = lambda n, longer: F.array(
        *[F.struct(n.alias("size"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.lit(longer).alias("longer")) for lo, hi in ((F.lit(0), F.floor(n / 2)), (F.floor(n / 2), n))]
    )
    rows = F.array_distinct(F.concat(of(size, False), F.when(size > 0, of(size - 1, True)).otherwise(F.array())))  # the empty word has one segment
    return words.select("word", "n", F.explode(rows).alias("m")).select("word", "n", "m.*")


def _halved(members: DataFrame) -> DataFrame:
    """Members with the segment that may hold the edit parted once more."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return members.select("word", "n", "size", "longer", F.explode(parts).alias("p")).select("word", "n", "size", "p.lo", "p.hi", "longer")


def _keyed(members: DataFrame) -> DataFrame:
    """Members with ``bucket``, a hash of where the edit may be and of all that stands around it."""
    behind = F.col("hi") + F.col("longer").cast("int") + 1  # from 1
    return members.withColumn("bucket", F.xxhash64("size", "lo", "hi", F.substr("word", F.lit(1), F.col("lo")), F.substr("word", behind)))


def _pairs(members: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs of one edit among members that share a bucket, each once."""
    side = lambda s: members.select("bucket", *[F.col(c).alias(f"{s}_{c}") for c in ("word", "n", "hi", "longer")])
    met = side("a").where(~F.col("a_longer")).join(side("b"), "bucket").where(F.col("b_longer") | (F.col("a_word") < F.col("b_word")))
    # Words of equal length meet in the bucket of the place where they differ, and nowhere else. A longer one may fit several
    # places; the one that counts is the first at which the two differ.
    first = ~F.col("b_longer") | (F.length("a_word") == F.col("a_hi")) | (F.substr("a_word", F.lit(1), F.col("a_hi")) != F.substr("b_word", F.lit(1), F.col("a_hi")))
    met = met.where(first & (F.levenshtein("a_word", "b_word", 1) == 1))
    return met.select(F.col("a_word").alias("a"), F.col("a_n"), F.col("b_word").alias("b"), F.col("b_n"))


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of ``words`` (word, n; distinct) that differ by exactly one inserted, deleted or replaced code point, each once.

    Buckets of more than ``bucket`` members are divided until they are smaller or what may differ is one code
    point. The empty word is near to words of one code point. ``words`` is read several times: write it first.
    """
    members, found = _keyed(_members(words)), None
    while True:
        counts = members.groupBy("bucket").agg(F.count("*").alias("_all"), F.count_if(~F.col("longer")).alias("_own"), F.max(F.col("hi") - F.col("lo")).alias("_open"))
        counts = counts.where((F.col("_own") > 0) & (F.col("_all") > 1))
        counts = cut(counts.select("bucket", ((F.col("_all") > bucket) & (F.col("_open") > 1)).alias("_full")))
        # a join of two plain shuffles, written: adaptive execution splits it where a bucket is large
        met = cut(members.join(counts, "bucket"))
        pairs = _pairs(met.where(~F.col("_full")))
        found = pairs if found is None else found.unionByName(pairs)
        full = met.where("_full")
        if full.isEmpty():
            return found
        members = _keyed(_halved(full))


def variant_forms(words: DataFrame, ratio: int = 10, bucket: int = BUCKET) -> DataFrame:
    """``words`` (word, n) with ``form``, ``root``, ``n_near`` and ``form_n``.

    A word's form is its near word of the largest n (ties: the smallest in code-point order) if that is at least ``ratio`` times
    its own, else null. ``root`` is where following forms ends: the word itself if it has none. With a
    ratio over 1 counts grow along the way, so it ends after as many steps as the largest count has digits to that base.
    Repeated and null words have to be combined before; an empty table has no rows.
    """
    words = cut(words)
    pairs = near_pairs(words, bucket)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    both = pairs.select(F.explode(ends).alias("e")).select("e.*")
    # the largest count, then the smallest word: strings are compared by bytes, which is code-point order
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    best = cut(best.select("word", "n_near", F.when(-F.col("best.m") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f")))
    roots = _followed(best.where("f IS NOT NULL").select("word", F.col("f.form").alias("root")))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "f.form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "f.form_n")


def _followed(links: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, root) links, by doubling the steps that a link spans."""
    links = cut(links)
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_then"))
        next_links = cut(links.join(onward, "root", "left").select("word", F.coalesce("_then", "root").alias("root"), F.col("_then").isNotNull().alias("_moved")))
        links = next_links.select("word", "root")
        if next_links.where("_moved").isEmpty():
            return links
