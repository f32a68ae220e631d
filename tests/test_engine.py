"""Keys that are null or very frequent, files read in ranges, batches that run again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumine import joins
from vellumine.operators import ingest, tfidf
from vellumine.sources import readers


def test_rows_without_a_key_are_spread(spark, rows):
    data = [(None, i) for i in range(400)] + [("a", 1), ("b", 2), ("b", 3), ("", 4)]
    df = rows(data, "k string, v int")
    known = rows([("a", 10), (None, 11), ("c", 12)], "k string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = joins.without(df, known, "k")
        parts = Counter(r[0] for r in fresh.where("k IS NULL").select(F.spark_partition_id()).collect())
        assert len(parts) == 4 and max(parts.values()) < 200
        assert sorted(map(str, fresh.collect())) == sorted(map(str, [r for r in df.collect() if r["k"] != "a"]))
        joined = joins.left(df, known, "k")
        assert joined.columns == ["k", "v", "w"] and joined.count() == 404
        assert [tuple(r) for r in joined.where("w IS NOT NULL").collect()] == [("a", 1, 10)]
        assert len({r[0] for r in joined.where("k IS NULL").select(F.spark_partition_id()).collect()}) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_a_frequent_term_are_split(spark, rows):
    texts = [(i, "hot " + f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x", "hot " * 3) for i in range(20_000)]
    corpus = rows(texts, "id long, title string, abstract string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = tfidf.tfidf(corpus)
        got = df.collect()
        assert "skew=true" in plan(df)
        assert len(got) == 60_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("most", [97, 1000, 1 << 20])
def test_csv_in_ranges_equals_whole_files(spark, rows, tmp_path, most):
    odd = ["plain", 'a "quoted" one', "two\nlines", '"', '""', "\n\n", "comma, here", 'ends with "', "three\n\"lines\"\nin all, yes", "NA", "x" * 400]
    data = [(i, odd[i % len(odd)], odd[(i * 7 + 3) % len(odd)], 1990 + i % 30, f"http://x/{i}") for i in range(300)]
    made = rows(data, "id long, title string, abstract string, year int, url string").repartition(2)
    made.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(most))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        whole, ranges = (f(spark, str(tmp_path / "t"), ["NA"]) for f in (readers.articles_csv, readers.articles_csv_split))
        assert ranges.columns == whole.columns
        assert sorted(map(str, ranges.collect())) == sorted(map(str, whole.collect()))
        if most == 97:
            assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_batch_that_runs_again_replaces_itself(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    batch = rows([("a", 1), (None, 2), (None, 3)], "url string, n int")
    assert ingest.append_batch(batch, table, "w1", 0) == 3
    for _ in range(2):
        fresh = ingest.unseen(batch, readers.persisted(spark, table, but=("w1", 0)))
        assert ingest.append_batch(fresh, table, "w1", 0) == 3
    assert spark.read.parquet(table).count() == 3
    later = ingest.unseen(batch, readers.persisted(spark, table, but=("w1", 1)))
    assert ingest.append_batch(later, table, "w1", 1) == 2  # rows without an address are always new
    assert spark.read.parquet(table).count() == 5 and readers.persisted(spark, table).count() == 5


def test_a_stream_forgets_keys_behind_its_watermark(spark, tmp_path):
    from vellumine.streaming.landing import deduplicate_folder

    folder, table, marks = tmp_path / "landing", str(tmp_path / "table"), str(tmp_path / "marks")
    kinds = "url string, at timestamp, n int"

    def run(*data):
        made = spark.createDataFrame(data, "url string, at string, n int").select("url", F.to_timestamp("at").alias("at"), "n")
        made.coalesce(1).write.mode("append").parquet(str(folder))
        query = deduplicate_folder(spark, str(folder), table, marks, kinds, "url", "at", "1 hour")
        query.awaitTermination()
        return query

    run(("a", "2026-01-01 00:00:00", 1), ("a", "2026-01-01 00:10:00", 2), (None, "2026-01-01 00:00:00", 3), (None, "2026-01-01 00:00:00", 3), ("b", None, 4))
    run(("a", "2026-01-01 00:30:00", 5), ("b", "2026-01-01 00:20:00", 6), ("b", None, 7))  # a again within the hour
    run(("c", "2026-01-01 05:00:00", 8))  # moves the watermark to 04:00
    run(("a", "2026-01-01 04:30:00", 9), ("d", "2026-01-01 01:00:00", 10), (None, "2026-01-01 01:00:00", 11))  # a is new again, d too late, no key
    run(("a", "2026-01-01 04:40:00", 12))
    got = Counter((r["url"], r["n"]) for r in spark.read.parquet(table).collect())
    first = [k for k in got if k in {("a", 1), ("a", 2)}]
    assert len(first) == 1 and got == Counter([first[0], (None, 3), (None, 3), ("b", 4), ("b", 6), ("b", 7), ("c", 8), ("a", 9), (None, 11)])
    # a run without new files adds nothing
    deduplicate_folder(spark, str(folder), table, marks, kinds, "url", "at", "1 hour").awaitTermination()
    assert spark.read.parquet(table).count() == 9
