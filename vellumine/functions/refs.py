"""Reference lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.biblio import FOUR_DIGITS
from vellumine.functions.text import strip


def is_reference(line: Column) -> Column:
    """A four-digit word and a comma or ``http`` (P7). A bracketed year with a comma before it has a comma already."""
    return line.rlike(FOUR_DIGITS) & (F.contains(line, F.lit(",")) | F.contains(line, F.lit("http")))


def reference_text(text: Column) -> Column:
    """Reference lines of one text, each stripped, joined by newlines, the whole stripped (A8, D7). Null: empty."""
    lines = F.transform(F.filter(F.split(text, "\n"), is_reference), strip)
    return F.coalesce(strip(F.array_join(lines, "\n")), F.lit(""))


def reference_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of reference lines, line_no from 1, lines stripped."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    return lines.where(is_reference(F.col("raw"))).select(key, (F.col("pos") + 1).alias("line_no"), strip(F.col("raw")).alias("line"))


def references_of_pages(pages: DataFrame, key: str = "pdf_url") -> DataFrame:
    """(key, references_text) of page texts (key, page_no, text), pages in order.

    A key whose pages hold no text or no reference has an empty text. Pages are reduced to
    their own references before they meet.
    """
    own = pages.select(key, "page_no", reference_text(F.col("text")).alias("own"))
    parts = F.array_sort(F.collect_list(F.when(F.col("own") != "", F.struct("page_no", "own"))))
    return own.groupBy(key).agg(strip(F.array_join(F.transform(parts, lambda p: p["own"]), "\n")).alias("references_text"))
