"""Numbers over whole tables, in ranges."""

import pytest
from pyspark.sql import functions as F

from vellumine.operators import ingest, numbering


def test_numbers_equal_a_sort(rows):
    data = [((i * 37) % 101 if i % 9 else None, i % 7, f"v{i}") for i in range(500)]
    df = rows(data, "a int, _range int, _c0 string")  # names that clash with its own
    got = numbering.numbered(df, ("a", "_c0"), "n").collect()
    assert [r["n"] for r in sorted(got, key=lambda r: r["n"])] == list(range(1, 501))
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [(r["a"], r["_range"], r["_c0"]) for r in sorted(got, key=lambda r: r["n"])] == want


@pytest.fixture
def ranges(monkeypatch):
    """Rows of each range, noted as ranges are written."""
    sizes, write = [], numbering.materialized

    def noted(df, name):
        made = write(df, name)
        if name == "numbered":
            sizes.extend(r["count"] for r in made.groupBy(F.shiftright("_id", numbering.ROW_BITS)).count().collect())
        return made

    monkeypatch.setattr(numbering, "materialized", noted)
    return sizes


def test_a_hot_tie_is_dealt_over_ranges(rows, ranges):
    df = rows([(1, i) for i in range(4000)], "a int, b int")
    got = numbering.numbered(df, ("a",))
    assert sorted(r["position"] for r in got.collect()) == list(range(1, 4001))
    assert sum(ranges) == 4000 and len(ranges) >= 3 and max(ranges) < 3000


def test_empty_and_a_replaced_column(rows):
    assert numbering.numbered(rows([], "a int"), ("a",)).collect() == []
    got = numbering.numbered(rows([(3, 9), (1, 9)], "a int, position int"), ("a",))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (3, 2)]
    assert numbering.leading(rows([(3,), (1,)], "a int"), 0, ("a",)).count() == 0


def test_a_large_cap_meets_in_no_one_task(spark, ranges):
    blocks = spark.range(0, 300_000, 1, 6).select((F.lit(299_999) - F.col("id")).alias("page_no"), F.lit(1).alias("pos"), "id")
    taken = ingest.capped(blocks, 200_000)
    text = taken._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in text
    assert taken.agg(F.count("*"), F.min("position"), F.max("position"), F.sum(F.abs(F.col("position") - 1 - F.col("page_no"))), F.min("id")).first() == (200_000, 1, 200_000, 0, 100_000)
    assert sum(ranges) == 300_000 and max(ranges) < 150_000
