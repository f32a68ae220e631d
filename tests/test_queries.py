import duckdb
import pytest

import __spark_entry__ as entry
from vellumine.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return made


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    made = duck.execute(registry.SQL[name])
    columns = [d[0] for d in made.description]
    assert sorted(columns) == names
    want = sorted(str(tuple(r[columns.index(c)] for c in names)) for r in made.fetchall())
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "field", "term", "tfidf"] and df.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries over the two pluggable parts that are Python: PDF parser, stemmer.
PLUGGED = {"pdf_page_texts", "pdf_page_errors", "tfidf_stemmed"}


def test_plans_stay_native(spark):
    for name, query in registry.QUERIES.items():
        text = plan(query(spark, SF))
        assert "CartesianProduct" not in text, name
        assert (name in PLUGGED) == any(x in text for x in ("Python", "InPandas", "ArrowEval", "UDTF")), name


def test_scan_is_pruned(spark):
    text = plan(registry.QUERIES["project_columns"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text
