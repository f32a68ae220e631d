"""Page texts of PDF files (S9, P12): the parser is pluggable, since none is installed here.

A parser is a function from bytes to an iterator of page texts. It may stop with an exception: pages
before that are kept. ``pages`` leaves the error out; ``registered`` makes a table function that gives it a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from vellumine.functions.urls import PDF_MAGIC, starts_with
from vellumine.schemas import PDF_PAGES

Parser = Callable[[bytes], Iterable[str | None]]


def looks_valid(content: Column) -> Column:
    """The native approximation of structural validity: the file's first bytes."""
    return F.coalesce(starts_with(content), F.lit(False))


def pages(blobs: DataFrame, parser: Parser, url: str = "path", content: str = "content") -> DataFrame:
    """(pdf_url, page_no, text) of each file, page_no from 1; pages without text are left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for address, data in zip(batch["url"], batch["content"], strict=True):
                rows = []
                try:
                    for n, text in enumerate(parser(bytes(data)), 1):
                        rows.append((address, n, text))
                except Exception as why:  # noqa: BLE001  a parser's error ends this file only
                    del why
                yield pd.DataFrame([r for r in rows if r[2]], columns=["pdf_url", "page_no", "text"])

    return blobs.where(looks_valid(F.col(content))).select(F.col(url).alias("url"), F.col(content).alias("content")).mapInPandas(parse, PDF_PAGES)


def form_feed_parser(data: bytes) -> Iterator[str]:
    """A parser for tests: text behind the header line, pages parted by form feeds."""
    yield from data.partition(b"\n")[2].decode("utf-8", "replace").split("\f")


def strict_form_feed_parser(data: bytes) -> Iterator[str]:
    """As ``form_feed_parser``, but a page that is no UTF-8 is an error."""
    for page in data.partition(b"\n")[2].split(b"\f"):
        yield page.decode("utf-8")


def registered(spark: SparkSession, parser: Parser, name: str = "pdf_pages") -> None:
    """Make ``name(content[, errors])`` a table function of the session, for lateral joins in SQL.

    It gives (page_no, text) for each page with text, page_no from 1. Where ``errors`` is the constant true, a column ``error`` is added and a file
    at which the parser stops has one more row: the number of the page that failed, no text, and the exception's name. Null
    content and content that does not begin as a PDF have no rows; content of another type than binary is refused when the query is analysed.
    """

    class Pages:
        @staticmethod
        def analyze(content: AnalyzeArgument, errors: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not isinstance(content.dataType, T.BinaryType):
                raise ValueError(f"content is binary, not {content.dataType.simpleString()}")
            if errors is not None and not (errors.isConstantExpression and isinstance(errors.value, bool)):
                raise ValueError("errors is true or false, not a column")
            kinds = T.StructType().add("page_no", T.IntegerType()).add("text", T.StringType())
            return AnalyzeResult(kinds.add("error", T.StringType()) if errors is not None and errors.value else kinds)

        def eval(self, content, errors=False):
            more = (None,) if errors else ()
            if content is None or not bytes(content).startswith(PDF_MAGIC):
                return
            n = 0
            try:
                for n, text in enumerate(parser(bytes(content)), 1):
                    if text:
                        yield (n, text, *more)
            except Exception as why:  # noqa: BLE001  a parser's error ends this file only
                if errors:
                    yield n + 1, None, type(why).__name__

    spark.udtf.register(name, F.udtf(Pages))


def pages_with_errors(blobs: DataFrame, parser: Parser, url: str = "path", content: str = "content") -> DataFrame:
    """(pdf_url, page_no, text, error) of each file: as ``pages``, and one row with an error for each file at which the parser stopped."""
    registered(blobs.sparkSession, parser, "pdf_pages_with_errors")
    files = blobs.select(F.col(url).alias("pdf_url"), F.col(content).alias("content"))
    return blobs.sparkSession.sql("SELECT b.pdf_url, p.page_no, p.text, p.error FROM {files} b, LATERAL pdf_pages_with_errors(b.content, true) p", files=files)
