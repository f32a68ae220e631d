"""Sources and sinks."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.schemas import ARTICLES, schema
from vellumine.session import cut

# Words that a reader of the same file in pandas takes for a missing value.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: A few frequent Indonesian words for tests and defaults; production passes a word list of its own.
STOPWORDS = ("yang", "dan", "di", "ke", "dari", "untuk", "pada", "dengan", "ini", "itu", "dalam", "adalah", "oleh", "sebagai", "atau", "juga", "tidak", "akan")


def articles_csv(spark: SparkSession, path: str, na_words: Sequence[str] = ()) -> DataFrame:
    """The exported article table (S1): a header, quoted cells over several lines, columns by name.

    ``na_words`` are read as missing titles and abstracts, as NA_WORDS are by pandas.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    kinds = {f.name: f for f in schema(ARTICLES).fields}
    text = ", ".join(f"`{c}` string" for c in header)
    raw = spark.read.schema(text).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return _typed(raw, header, kinds, na_words)


def _typed(raw: DataFrame, header: Sequence[str], kinds: dict, na_words: Sequence[str]) -> DataFrame:
    df = raw.select(*[F.col(c).try_cast(kinds[c].dataType).alias(c) if c in kinds else F.col(c) for c in header])
    for c in ("title", "abstract"):
        if na_words and c in header:
            df = df.withColumn(c, F.when(~F.col(c).isin(list(na_words)), F.col(c)))
    return df.select(*[c for c in kinds if c in header])


def articles_csv_split(spark: SparkSession, path: str, na_words: Sequence[str] = ()) -> DataFrame:
    """As ``articles_csv``, but a large file is read by many tasks, although its cells span lines.

    Files are read line by line, in byte ranges. The quotes of each range are counted and summed over the ranges before it; an odd sum
    says that the range begins inside a quoted cell. With that every range finds by itself the lines at which a record begins, and lines of
    a record meet under that line's number. Quotes inside cells are doubled and lines end with a newline; a header stands at
    the head of each file, in one line.
    """
    kinds = {f.name: f for f in schema(ARTICLES).fields}
    header = spark.read.option("header", True).option("escape", '"').csv(path).columns
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("odd", F.length(F.regexp_replace("value", '[^"]+', "")) % 2)
    ranges = lines.groupBy("file", "begin").agg((F.sum("odd") % 2).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut(ranges.select("file", "begin", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).alias("inside")))
    # within a range: is a line's head inside a cell, and which line is the last at or before it that begins a record
    own = Window.partitionBy("file", "begin").orderBy("at")
    known = lines.join(ranges, ["file", "begin"])
    known = known.withColumn("starts", (F.col("inside") + F.coalesce(F.sum("odd").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 0)
    known = known.withColumn("record", F.max(F.when(F.col("starts"), F.col("at"))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # lines at the head of a range that continue the last record begun in a range before
    last = known.groupBy("file", "begin").agg(F.max("record").alias("last"))
    last = cut(last.select("file", "begin", F.last("last", ignorenulls=True).over(earlier).alias("before")))
    met = known.join(last, ["file", "begin"]).select("file", "begin", "at", "value", F.coalesce("record", "before").alias("record"))
    records = met.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("begin", "at", "value"))).alias("parts"))
    first = lines.where("begin = 0").groupBy("file").agg(F.min("at").alias("record"))  # a file's header
    records = records.join(first, ["file", "record"], "left_anti")
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    cells = F.from_csv(text, ", ".join(f"`{c}` string" for c in header), {"escape": '"', "multiLine": "true"})
    raw = records.select(cells.alias("c")).select(*[F.col("c")[c].alias(c) for c in header])
    return _typed(raw, header, kinds, na_words)


def corpus(articles: DataFrame) -> DataFrame:
    """The columns that text analysis needs."""
    return articles.select("id", "title", "abstract")


def persisted(spark: SparkSession, path: str, key: str = "url", but: tuple[str, int] | None = None) -> DataFrame:
    """Keys of rows persisted already (S5); a table that isn't there yet has none. ``but``: those of one writer's batch are left out."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{key} string")
    held = spark.read.parquet(path)
    if but is not None and {"writer", "batch"} <= set(held.columns):
        held = held.where((F.col("writer") != but[0]) | (F.col("batch") != but[1]))  # prunes folders
    return held.select(key)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Fetched files at rest (S6): path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)


def stopword_table(spark: SparkSession, path: str) -> DataFrame:
    """(term) of a text file, one a line (S11), blank lines left out: a list of any length, for a join."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.lower(F.trim("value")).alias("term")).distinct()


def stopwords(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """The words of ``stopword_table`` as a list for literals. Raises ValueError if they are more than ``most``: use the table then."""
    found = [r["term"] for r in stopword_table(spark, path).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} words")
    return sorted(found)


def settings(prefix: str) -> dict[str, str]:
    """Reader options from environment variables that begin with ``prefix``."""
    return {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
