"""Sketches, SQL functions, the parser's table function and encodings."""

import duckdb
import pytest
from pyspark.sql import functions as F

from vellumine import sqlfunctions
from vellumine.functions import urls
from vellumine.operators import sketches
from vellumine.plans import registry
from vellumine.sources import pdf


def test_merged_sketches_stay_within_two_percent(spark, tmp_path):
    path = str(tmp_path / "s")
    batch = lambda low, high: spark.range(low, high).select((F.col("id") % 3).alias("g"), F.concat(F.lit("u"), "id").alias("v"))
    for n, (low, high) in enumerate([(0, 200_000), (100_000, 300_000), (100_000, 300_000)]):
        sketches.store(sketches.sketched(batch(low, high), "v", "g"), path, min(n, 1))  # the last run replaces its batch
    got = sketches.total(spark, path).first()
    assert got["n_rows"] == 400_000 and abs(got["n_distinct"] - 300_000) < 6_000
    assert all(abs(r["n_distinct"] - 100_000) < 2_000 for r in sketches.total(spark, path, "g").collect())
    whole = sketches.estimated(sketches.sketched(batch(0, 300_000), "v")).first()
    assert abs(whole["n_distinct"] - got["n_distinct"]) < 0.01 * 300_000


def test_sketches_of_nulls_and_nothing(rows):
    df = rows([(None, None), (None, "a"), ("x", None), ("x", "b"), ("x", "b"), (None, "c")], "g string, v string")
    got = {r["g"]: (r["n_rows"], r["n_distinct"]) for r in sketches.estimated(sketches.sketched(df, "v", "g")).collect()}
    assert got == {None: (3, 2), "x": (3, 1)}
    empty = rows([], "g string, v string")
    assert tuple(sketches.estimated(sketches.merged(sketches.sketched(empty, "v"))).first()) == (0, 0)
    assert sketches.sketched(empty, "v", "g").count() == 0


def test_pages_and_errors_by_a_lateral_join(spark, rows):
    def parser(data):
        yield from pdf.strict_form_feed_parser(data)
        if b"late" in data:
            raise OSError("behind the last page")

    files = [("a", bytearray(b"%PDF\nx\f\fy")), ("b", bytearray(b"%PDF\nx\f\xff")), ("c", bytearray(b"no")), ("d", None), ("e", bytearray(b"%PDF\nlate")), (None, bytearray(b"%PDF\nz"))]
    blobs = rows(files, "path string, content binary")
    got = {tuple(r) for r in pdf.pages_with_errors(blobs, parser).collect()}
    assert got == {("a", 1, "x", None), ("a", 3, "y", None), ("b", 1, "x", None), ("b", 2, None, "UnicodeDecodeError"), ("e", 1, "late", None), ("e", 2, None, "OSError"), (None, 1, "z", None)}
    pdf.registered(spark, parser, "their_pages")
    plain = spark.sql("SELECT b.path, p.* FROM {b} b, LATERAL their_pages(b.content) p", b=blobs)
    assert plain.columns == ["path", "page_no", "text"] and plain.count() == 5
    for bad, why in (("their_pages('text')", "content is binary"), ("their_pages(b.content, b.path = 'a')", "true or false")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT p.* FROM {{b}} b, LATERAL {bad} p", b=blobs).collect()


def test_functions_in_sql(spark, rows):
    sqlfunctions.register(spark)
    sqlfunctions.register(spark)  # again in the same session
    got = spark.sql("SELECT cleaned('A-b  C1'), words_of(NULL), words_of(' x,Y '), citation_count('Cited by 12'), citation_count('none'), citation_count('99999999999')").first()
    assert tuple(got) == ("a b c", [], ["x", "y"], 12, 0, 0)
    found = sqlfunctions.search(rows([("a b",), (None,)], "keyword string"), "http://s", 10).collect()
    assert sorted(tuple(r) for r in found) == [("a b", 0, "http://s?q=a+b&hl=id&as_sdt=0,5&start=0"), ("a b", 1, "http://s?q=a+b&hl=id&as_sdt=0,5&start=10")]


def test_tfidf_in_sql(rows):
    corpus = rows([(1, "a a b", None), (2, "b", "c"), (3, None, "")], "id long, title string, abstract string")
    df = sqlfunctions.tfidf(corpus)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "CartesianProduct" not in text
    got = {(r["id"], r["field"], r["term"]): round(r["tfidf"], 6) for r in df.collect()}
    assert got == {(1, "title", "a"): round(2 / 3 * 0.477121, 6), (1, "title", "b"): round(0.176091 / 3, 6), (2, "title", "b"): 0.176091, (2, "abstract", "c"): 0.477121}
    assert {r["term"] for r in sqlfunctions.tfidf(corpus, 1, ("a", "b")).collect()} == {"c"}
    assert {r["term"] for r in sqlfunctions.tfidf(corpus, 2).collect()} == {"b"}


@pytest.mark.parametrize(
    ("body", "stated", "kind", "found"),
    [
        ("﻿it is Forbidden".encode("utf-16-le"), None, "utf-16le", True),
        ("﻿it is FORBIDDEN".encode("utf-16-be"), "text/html; charset=utf-8", "utf-16be", True),
        ("forbidden".encode("utf-16-le"), "text/html; charset=UTF-16", "utf-16le", True),
        (b"\xff\xfe\x00\xd8" + "forbidden".encode("utf-16-le") + b"\x00", None, "utf-16le", True),  # half of a pair, an odd byte
        (b"\xff\xfe" + b"\x00" + "forbidden".encode("utf-16-le"), None, "utf-16le", False),  # not where units begin
        ("forb漢idden".encode("utf-16-le"), "x; charset='utf-16le'", "utf-16le", False),
        (b"\xef\xbb\xbfForbidden", "text/html; charset=latin1", "utf-8", True),
        (b"\xff forbidden", "text/html; charset=utf8", "utf-8", True),  # not valid
        (b"<html><META  http-equiv=x content='text/html; charset=UTF-8'>forbidden", None, "utf-8", True),
        (b"<meta charset=utf-16>forbidden", None, "utf-8", True),
        (b"\xff\xe9 forbidden", "text/html", "iso-8859-1", True),
        ("forbidden".encode("utf-16-le"), None, "iso-8859-1", False),
        (b"", "", "iso-8859-1", False),
        (None, None, "iso-8859-1", None),
        (b"x" * 3_000_000 + b"forbidden", "charset=koi8-r", "koi8-r", True),
        (("x" * 1_500_000 + "forbidden").encode("utf-16-le"), "charset=utf-16le", "utf-16le", True),
    ],
)
def test_encodings_of_bodies(spark, body, stated, kind, found):
    df = spark.createDataFrame([(bytearray(body) if body is not None else None, stated)], "body binary, stated string")
    got = df.select(urls.charset(F.col("body"), F.col("stated")), urls.mentions(F.col("body"), content_type=F.col("stated"))).first()
    assert tuple(got) == (kind, found)


@pytest.mark.parametrize("order", ["utf-16-le", "utf-16-be", "utf-8"])
def test_words_match_in_every_case_of_every_letter(spark, order):
    texts = ["x FÜR", "xx für", "Für", "fÜr", "FUR", "f\u5cfcr", "STRAßE für", "\U0001f600FÜR"]
    df = spark.createDataFrame([(i, bytearray(t.encode(order))) for i, t in enumerate(texts)], "i int, body binary").orderBy("i")
    found = df.select(urls.mentions(F.col("body"), "Für", F.lit(f"text/html; charset={order}")).alias("found")).collect()
    assert [r["found"] for r in found] == ["für" in t.lower() for t in texts]


def test_body_charsets_of_upper_case_and_blank_pages(spark, tmp_path):
    data = [(i, "u", t) for i, t in enumerate(["<p>FÜR", "WAS FÜR", "Für", "FÜR was"] * 3 + ["", "", "", ""])] + [(None, "u", "für"), (-3, "u", "FÜR")]
    spark.createDataFrame(data, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r["page_id"]), r["charset"], r["was"], r["fuer"]) for r in registry.QUERIES["body_charsets"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted((str(r[0]), *r[1:]) for r in duck.execute(registry.SQL["body_charsets"]).fetchall())
