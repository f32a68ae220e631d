import os

import pytest
from pyspark.sql import functions as F

from vellumine.functions.urls import normalized
from vellumine.operators import ingest, tfidf
from vellumine.schemas import RESULT_BLOCKS
from vellumine.sources import html, pdf, readers
from vellumine.streaming.landing import ingest_folder

PAGE = """<html><body><div id=x>
<div class="gs_r gs_or gs_scl"><h3 class="gs_rt"><span>[PDF]</span> <a href="http://a/1">Satu <b>Dua</b></a></h3>
 <div class="gs_a">A B - J, 2019 - q.id</div><div class="gs_rs">Isi<br>baris</div>
 <a href="/x?cites=9">Dirujuk 12 kali</a><a href="/x?cites=8">Dirujuk 13 kali</a><div class="gs_or_ggsm"><a href="http://a/1.pdf">PDF</a></div></div>
<div class="gs_r gs_or gs_scl"><h3 class="gs_rt">no link</h3></div>
<div class="other gs_scl gs_or gs_r"><h3 class="gs_rt"><a href="http://a/2">Tiga</a></h3><a href="/cites/5">Kutip 5</a></div>
<div class="gs_r gs_or"><h3 class="gs_rt"><a href="http://a/9">not a block</a></h3></div>
<div class="gs_r gs_or gs_scl"><h3 class="gs_rt"><a href="http://a/1">Again</a></h3><div class="gs_a">plain</div></div>
<div class="gs_r gs_or gs_scl"><h3 class="gs_rt"><a href="http://a/old">Old</a></h3></div>
</div></body></html>"""


def blocks(rows):
    return html.result_blocks(rows([(0, PAGE), (1, None), (2, "")], "page_no int, html string"))


def test_block_extractor(rows):
    got = {r["pos"]: r for r in blocks(rows).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    r = got[1]
    assert (r["title"], r["url"], r["info"], r["abstract"], r["cite_text"], r["has_pdf_link"], r["pdf_url"]) == ("Satu Dua", "http://a/1", "A B - J, 2019 - q.id", "Isi\nbaris", "Dirujuk 12 kali", True, "http://a/1.pdf")
    assert got[2]["title"] is None and got[2]["url"] is None
    assert got[3]["cite_text"] is None and got[3]["cite_text_loose"] == "Kutip 5"


def test_ingest_a(rows, tmp_path, spark):
    existing = rows([("http://a/old",)], "url string")
    now = F.to_timestamp(F.lit("2026-02-01 00:00:00"))
    out = ingest.articles_a(blocks(rows), existing, now, 50, downloaded=rows([("http://a/1.pdf",)], "pdf_url string"))
    got = {r["url"]: r for r in out.collect()}
    assert sorted(got) == ["http://a/1", "http://a/2"]
    r = got["http://a/1"]
    assert (r["title"], r["authors"], r["year"], r["source"], r["citations"], r["scrape_status"]) == ("Satu Dua", "A B", 2019, "q.id", 12, "pdf_downloaded")
    assert got["http://a/2"]["abstract"] == "" and got["http://a/2"]["citations"] == 0 and got["http://a/2"]["scrape_status"] == "metadata_only"
    table = str(tmp_path / "articles")
    assert readers.persisted(spark, table).count() == 0
    assert ingest.append(out, table) == 2
    again = ingest.articles_a(blocks(rows), readers.persisted(spark, table).union(existing), now, 50)
    assert ingest.append(again, table) == 0 and spark.read.parquet(table).count() == 2


def test_cap_counts_attempted_blocks(rows):
    got = ingest.articles_a(blocks(rows), rows([], "url string"), F.current_timestamp(), 2).collect()
    assert [r["url"] for r in got] == ["http://a/1"]
    assert ingest.capped(blocks(rows), 3).count() == 3


def test_ingest_b(rows):
    now = F.to_timestamp(F.lit("2026-02-01 00:00:00"))
    one = blocks(rows).where("page_no = 0")
    pages = pdf.pages(rows([("http://a/1.pdf", bytearray(b"%PDF\nx\fRef, 2001")), ("bad", bytearray(b"no"))], "path string, content binary"), pdf.form_feed_parser)
    from vellumine.functions.refs import references_of_pages

    out = ingest.articles_b(one, now, 4, rows([("http://a/1.pdf",)], "pdf_url string"), references_of_pages(pages), rows([("http://a/2", "h, 2002")], "url string, html_references string"))
    got = sorted((r["title"], r["citations"], r["year"], r["references_text"], r["references_status"]) for r in out.collect())
    assert got == [("Again", 0, None, "", "No PDF / metadata only"), ("Satu Dua", 12, 2019, "Ref, 2001", "PDF success"), ("Tiga", 5, None, "h, 2002", "HTML fallback")]


def test_titled_blocks_without_an_address_all_stay(rows):
    page = "".join(f'<div class="gs_r gs_or gs_scl"><h3 class="gs_rt"><a>Title {i % 2}</a></h3></div>' for i in range(3))
    found = html.result_blocks(rows([(0, page)], "page_no int, html string"))
    out = ingest.articles_a(found, rows([(None,), ("x",)], "url string"), F.current_timestamp(), None).collect()
    assert sorted((r["title"], r["url"]) for r in out) == [("Title 0", ""), ("Title 0", ""), ("Title 1", "")]


def test_one_row_a_block_whatever_the_references(rows):
    one = blocks(rows).where("page_no = 0")
    twice = rows([("http://a/1.pdf", "a, 2001"), ("http://a/1.pdf", "b, 2002"), (None, "n")], "pdf_url string, references_text string")
    pages = rows([("http://a/2", "h, 2002"), ("http://a/2", "g, 2001"), (None, "n")], "url string, html_references string")
    out = ingest.articles_b(one, F.current_timestamp(), 10, rows([("http://a/1.pdf",), ("http://a/1.pdf",)], "pdf_url string"), twice, pages)
    got = sorted((r["title"], r["references_text"]) for r in out.collect())
    assert got == [("Again", ""), ("Old", ""), ("Satu Dua", "b, 2002"), ("Tiga", "h, 2002")]


def test_settings_and_words(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("VELLUMINE_TEST_URL", "jdbc:x")
    monkeypatch.setenv("VELLUMINE_TEST_USER", "me")
    assert readers.settings("VELLUMINE_TEST_") == {"url": "jdbc:x", "user": "me"}
    (tmp_path / "words").write_text("Yang\n dan \n\nyang\n")
    assert readers.stopwords(spark, str(tmp_path / "words")) == ["dan", "yang"]
    with pytest.raises(ValueError, match="more than 1"):
        readers.stopwords(spark, str(tmp_path / "words"), 1)
    assert readers.blobs(spark, str(tmp_path / "words")).first()["length"] == 17


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from vellumine import session

    made = []
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake)
    context.master = "local[2]"
    assert "vellumine-checkpoint-" in session.shared_folder(fake) == made[0]


def test_first_per_key_and_unseen(rows):
    df = rows([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "n"), ("a", 1, "y"), (None, 2, "m"), (None, 1, "n")], "k string, pos int, v string")
    got = sorted((r["k"] or "", r["v"]) for r in ingest.first_per_key(df, "k", "pos").collect())
    assert got == [("", "m"), ("", "n"), ("", "n"), ("a", "y"), ("b", "z")]
    assert {r["v"] for r in ingest.unseen(df, rows([("a",)], "k string"), "k").collect()} == {"z", "n", "m"}
    assert ingest.first_per_key(rows([], "k string, pos int"), "k", "pos").count() == 0


def test_csv_over_lines(spark, tmp_path):
    path = tmp_path / "articles.csv"
    path.write_text('title,id,abstract,year,scraped_at,extra\n"A ""q"", b",1,"two\nlines",2012,2026-02-01 00:29:16.250012+00,z\nNA,x,,x,,\n')
    got = sorted(readers.articles_csv(spark, str(path), readers.NA_WORDS).collect(), key=lambda r: r["id"] or 0)
    assert [(r["id"], r["title"], r["abstract"], r["year"]) for r in got] == [(None, None, None, None), (1, 'A "q", b', "two\nlines", 2012)]
    assert got[1]["scraped_at"].microsecond == 250012


@pytest.mark.skipif("ARTICLES_CSV" not in os.environ, reason="ARTICLES_CSV names no exported article table")
def test_sample_goldens(spark):
    df = readers.articles_csv(spark, os.environ["ARTICLES_CSV"])
    posted = tfidf.postings(readers.corpus(df))
    stats = {r["term"]: r for r in tfidf.inverse_frequency(df, tfidf.document_frequency(posted)).collect()}
    assert df.count() == 52 and len(stats) == 538 and posted.count() == 1409
    assert stats["website"]["df_t"] == 97 and abs(stats["website"]["idf"] + 0.270768) < 1e-6
    assert df.select("url").distinct().count() == 52 and df.select(normalized(F.col("url"))).distinct().count() == 44
    assert sorted(t for t, r in stats.items() if r["idf"] < 0) == ["pembuatan", "website"]


def test_a_failed_stream_batch_runs_again(spark, rows, tmp_path, monkeypatch):
    from vellumine.streaming import landing

    folder, table, marks = tmp_path / "landing", str(tmp_path / "table"), str(tmp_path / "marks")
    kinds = blocks(rows).schema
    data = [{"page_no": 1, "pos": k, "title": f"t{k}", "url": u, "has_pdf_link": False} for k, u in enumerate(["http://a", None, None])]
    spark.createDataFrame([{f.name: d.get(f.name) for f in kinds} for d in data], kinds).write.parquet(str(folder))
    written = landing.append_batch

    def fails(*args):
        written(*args)
        raise OSError("lost after the write")

    monkeypatch.setattr(landing, "append_batch", fails)
    with pytest.raises(Exception, match="lost after the write"):
        ingest_folder(spark, str(folder), table, marks).awaitTermination()
    assert spark.read.parquet(table).count() == 3
    monkeypatch.setattr(landing, "append_batch", written)
    ingest_folder(spark, str(folder), table, marks).awaitTermination()
    assert sorted(r["title"] for r in spark.read.parquet(table).collect()) == ["t0", "t1", "t2"]


def test_streaming_appends_once(spark, rows, tmp_path):
    folder, table = tmp_path / "landing", str(tmp_path / "table")
    blocks(rows).write.parquet(str(folder))
    for _ in range(2):
        ingest_folder(spark, str(folder), table, str(tmp_path / "marks")).awaitTermination()
    assert spark.read.parquet(table).count() == 3
    assert RESULT_BLOCKS
