"""The persisted index of keys against the anti join."""

import pytest
from pyspark.sql import functions as F

from vellumine import joins
from vellumine.operators import keyindex


def filled(spark, rows, path, expected=3000, buckets=8):
    keyindex.create(spark, path, expected, buckets)
    for batch in (0, 1, 1):
        keyindex.add(rows([(f"u{i}",) for i in range(batch * 500, batch * 500 + 600)] + [(None,)], "url string"), path, batch)


def test_equals_the_anti_join(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    filled(spark, rows, path)
    data = [(f"u{i}", i) for i in range(0, 3000, 3)] + [(None, -1)] * 50 + [("hot", i) for i in range(700)] + [("u3", 7)] * 700 + [("", 0)]
    asked = rows(data, "url string, block int")  # a column named as one of the index's own
    known = rows([(f"u{i}",) for i in range(1100)], "url string")
    want = sorted(map(str, joins.without(asked, known, "url").collect()))
    got = keyindex.unseen(asked, path)
    assert got.columns == asked.columns and sorted(map(str, got.collect())) == want
    found = keyindex.held(asked, path)
    assert found.count() == found.distinct().count() == len({u for u, _ in data if u and u[0] == "u" and int(u[1:]) < 1100})


def test_an_empty_index_and_no_candidates(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    keyindex.create(spark, path, 1, 1)
    assert keyindex.unseen(rows([("a",), (None,)], "url string"), path).count() == 2
    keyindex.add(rows([], "url string"), path, 0)
    assert keyindex.unseen(rows([("a",)], "url string"), path).count() == 1
    assert keyindex.unseen(rows([], "url string"), path).count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        keyindex.create(spark, path, 1)
    with pytest.raises(ValueError, match="at least one"):
        keyindex.create(spark, path + "2", 0)


def test_only_buckets_that_may_hold_a_candidate_are_read(spark, rows, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "index"), []
    filled(spark, rows, path, buckets=16)
    read = keyindex.stored
    monkeypatch.setattr(keyindex, "stored", lambda spark, path, buckets: asked.append(buckets) or read(spark, path, buckets))
    df = keyindex.held(rows([("u5",), ("none",), ("u6",), ("neither",)], "url string"), path)
    assert {r["key"] for r in df.collect()} == {"u5", "u6"}
    keys = spark.read.parquet(f"{path}/keys").where(F.col("key").isin("u5", "u6")).select("bucket").distinct()
    assert {r["bucket"] for r in keys.collect()} <= set(asked[0]) and len(asked[0]) <= 4
    part = read(spark, path, asked[0])
    part.collect()
    files = part._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert 1 <= files <= 2 * len(asked[0])  # of each batch


def test_filters_pass_what_they_hold_and_little_else(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    keyindex.create(spark, path, 6000, 2)
    keyindex.add(spark.range(6000).select(F.concat(F.lit("in"), "id").alias("url")), path, 3)
    ask = lambda word: keyindex.possible(spark.range(6000).select(F.concat(F.lit(word), "id").alias("key")), path).count()
    assert ask("in") == 6000 and ask("out") < 180


def test_rebuilt(spark, rows, tmp_path):
    path, to = str(tmp_path / "index"), str(tmp_path / "other")
    filled(spark, rows, path)
    keyindex.rebuilt(spark, path, to, 10_000, 3)
    assert sorted(r["key"] for r in spark.read.parquet(f"{to}/keys").collect()) == sorted(f"u{i}" for i in range(1100))
    assert keyindex.unseen(rows([("u1",), ("x",)], "url string"), to).count() == 1
