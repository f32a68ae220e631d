import pytest
from pyspark.sql import functions as F

from vellumine.functions import biblio, refs, urls

INFO = [
    ("M Suhartanto - Speed-Sentra Penelitian, 2012 - ijns.org", "M Suhartanto", 2012, "ijns.org", "M Suhartanto", 2012),
    ("AD Riyanto - 2015 - 2015 - neliti.com", "AD Riyanto", 2015, "2015 - neliti.com", "AD Riyanto", 2015),
    ("X Al-Farisi, B C - J 12012, 2012 - z.org", "X Al-Farisi, B C", 2012, "2012 - z.org", "X Al", 2012),
    ("No separator 2019", "No separator 2019", None, "", "No separator 2019", 2019),
    ("A B - publisher only", "A B", None, "publisher only", "A B", None),
    ("A B - Vol 1850, 2101 - q.id", "A B", None, "Vol 1850, 2101 - q.id", "A B", 1850),
    ("P Q - 1998", "P Q", 1998, "", "P Q", 1998),
    ("2020 Group - Jurnal, 2021 - r.id", "2020 Group", 2021, "r.id", "2020 Group", 2020),
]


def test_info_lines(spark):
    df = spark.createDataFrame([(r[0],) for r in INFO] + [(None,)], "info string")
    a, b = biblio.info_a(F.col("info")), biblio.info_b(F.col("info"))
    got = df.select("info", *[v.alias(f"a_{k}") for k, v in a.items()], *[v.alias(f"b_{k}") for k, v in b.items()]).collect()
    for row, want in zip(got, INFO, strict=False):
        assert (row["a_authors"], row["a_year"], row["a_source"], row["b_authors"], row["b_year"], row["b_source"]) == (*want[1:], want[0])
    assert (got[-1]["a_authors"], got[-1]["a_year"], got[-1]["a_source"]) == ("", None, "")


@pytest.mark.parametrize(("text", "n"), [("Dirujuk 370 kali", 370), ("1.234 x", 1), ("Kutip", 0), ("", 0), (None, 0), ("99999999999", 0)])
def test_citations(spark, text, n):
    assert spark.createDataFrame([(text,)], "x string").select(biblio.citations(F.col("x"))).first()[0] == n


def test_pdf_status(spark):
    df = spark.createDataFrame([(False, None, None), (True, "u", True), (True, "u", False), (True, None, None)], "l boolean, u string, g boolean")
    got = [tuple(r) for r in df.select(*biblio.pdf_status(F.col("l"), F.col("u"), F.col("g")).values()).collect()]
    assert got == [(None, "metadata_only"), ("u", "pdf_downloaded"), ("u", "pdf_url_only"), (None, "pdf_url_only")]


def test_reference_status(spark):
    cases = [
        (("u", True, "p", "h"), ("p", "PDF success")),
        (("u", True, "", "h"), ("h", "HTML fallback")),
        (("u", True, None, ""), ("", "PDF empty")),
        (("u", False, "p", "h"), ("", "PDF fail / maybe paid or redirect")),
        ((None, None, None, "h"), ("h", "HTML fallback")),
        (("", False, None, None), ("", "No PDF / metadata only")),
    ]
    df = spark.createDataFrame([c[0] for c in cases], "u string, g boolean, p string, h string")
    got = [tuple(r) for r in df.select(*biblio.reference_status(*[F.col(c) for c in "ugph"]).values()).collect()]
    assert got == [c[1] for c in cases]


def test_reference_lines(spark, rows):
    yes = ["Smith, J. (2019). Title.", "(Smith, 2019)", "see http://x.id/2020", "Halaman 1234 dari, x"]
    no = ["2019 only", "http://x.id/a20201", "x, 12345", "Smith 2019; no comma", "a, 2019b", "a_2019, b", "é2020, x"]
    df = spark.createDataFrame([(x,) for x in yes + no], "line string")
    assert [r[0] for r in df.where(refs.is_reference(F.col("line"))).collect()] == yes
    text = "junk\n  a, 2001 \n b, 2002\nend"
    assert spark.createDataFrame([(text,), (None,)], "t string").select(refs.reference_text(F.col("t")).alias("r")).collect()[0]["r"] == "a, 2001\nb, 2002"
    pages = rows([("u", 2, "c, 2003"), ("u", 1, text), ("u", 3, None), ("v", 1, "no")], "pdf_url string, page_no int, text string")
    assert {r["pdf_url"]: r["references_text"] for r in refs.references_of_pages(pages).collect()} == {"u": "a, 2001\nb, 2002\nc, 2003", "v": ""}


def test_urls(spark):
    def one(f, x, kind="string"):
        return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x"))).first()[0]

    assert one(urls.safe_title, "Pembuatan Website: (Studi Kasus) é!") == "Pembuatan_Website_Studi_Kasus_é_"
    assert len(one(urls.safe_title, "x" * 99)) == 80
    for url, want in [("http://a/b/c.pdf?x=1", "c.pdf"), ("http://a/b/?f=q.pdf", ""), ("http://a/b%20c.pdf", "b%20c.pdf"), ("http://a/x;p=1.pdf", "x"), ("a b|c/d.pdf", "d.pdf"), ("http://a", "")]:
        assert one(urls.basename, url) == want
    for url, want in [("http://a/b/c.PDF", True), ("http://a/b/c.pdf?x=1", False), ("http://a/b/?f=q.pdf", True)]:
        assert one(urls.has_suffix, url) is want
    assert one(urls.mentions, bytearray(b"\xff 403 FORBIDDEN"), "binary") and not one(urls.mentions, bytearray(b"%PDF"), "binary")
    for url, want in [("http://a/?id=1&ots=x&sig=y", "http://a/?id=1"), ("http://a/?ots=x&id=1#f", "http://a/?id=1#f"), ("http://a/?sig=x", "http://a/"), ("http://a/?dots=x", "http://a/?dots=x"), ("http://a", "http://a")]:
        assert one(urls.normalized, url) == want
    assert [urls.page_count(n) for n in (0, 5, 10, 50)] == [1, 1, 2, 6]
    words = spark.createDataFrame([("a b",), (None,), ("c",)], "keyword string")
    assert sorted(map(tuple, urls.search_url(words, "https://s").collect())) == [("a b", 0, "https://s?q=a+b&hl=id"), ("c", 0, "https://s?q=c&hl=id")]
    assert [tuple(r) for r in urls.search_urls(words.where("keyword = 'a b'"), "https://s", 10).orderBy("page_no").collect()] == [("a b", i, f"https://s?q=a+b&hl=id&as_sdt=0,5&start={10 * i}") for i in (0, 1)]


def test_downloads(rows):
    blobs = rows([("u1.pdf", 200, "text/html", bytearray(b"%PDF-1")), ("u2.pdf", 200, "Application/PDF", bytearray(b"x")), ("u3.pdf", 404, "application/pdf", bytearray(b"%PDF")), ("u4.pdf", 200, "text/html", bytearray(b"Forbidden"))], "path string, status int, content_type string, content binary")
    asked = rows([(f"u{i}.pdf", f"T {i}") for i in range(1, 6)], "pdf_url string, title string")
    a = {r["pdf_url"]: r["file"] for r in urls.downloaded_a(blobs, asked).collect()}
    assert a == {"u1.pdf": "pdfs/T_1.pdf", "u2.pdf": "pdfs/T_2.pdf", "u3.pdf": None, "u4.pdf": None, "u5.pdf": None}
    b = {r["pdf_url"]: r["file"] for r in urls.downloaded_b(blobs, asked).collect()}
    assert b == {"u1.pdf": "pdfs/u1.pdf", "u2.pdf": "pdfs/u2.pdf", "u3.pdf": None, "u4.pdf": None, "u5.pdf": None}
