"""Bibliographic parsing as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.text import strip

# A year of 1900-2099 and any four digits, as whole words by Unicode.
YEAR = r"(?<![\p{L}\p{N}_])(?:19|20)\p{Nd}{2}(?![\p{L}\p{N}_])"
FOUR_DIGITS = r"(?<![\p{L}\p{N}_])\p{Nd}{4}(?![\p{L}\p{N}_])"
SEPARATOR = " - "
TRIMMED = " ,-."


def _int(text: Column) -> Column:
    return text.try_cast("int")


def info_a(info: Column) -> dict[str, Column]:
    """Variant A (D1): authors before the first `` - ``, year 1900-2099 behind it, source behind the year.

    A null line gives empty authors and source and a null year.
    """
    line = F.coalesce(info, F.lit(""))
    split = F.contains(line, F.lit(SEPARATOR))
    authors = strip(F.when(split, F.substring_index(line, SEPARATOR, 1)).otherwise(line))
    rest = F.when(split, F.substr(line, F.locate(SEPARATOR, line) + len(SEPARATOR))).otherwise(F.lit(""))
    year = F.regexp_substr(rest, F.lit(YEAR))
    behind = F.btrim(F.substr(rest, F.instr(rest, year) + 4), F.lit(TRIMMED))
    return {"authors": authors, "year": _int(year), "source": F.when(year.isNotNull(), behind).otherwise(strip(rest))}


def info_b(info: Column) -> dict[str, Column]:
    """Variant B (D2): authors before the first hyphen, year the first four-digit word, source the line itself."""
    line = F.coalesce(info, F.lit(""))
    return {"authors": strip(F.split_part(line, F.lit("-"), F.lit(1))), "year": _int(F.regexp_substr(line, F.lit(FOUR_DIGITS))), "source": line}


def citations(text: Column) -> Column:
    """The first run of digits (D3), 0 if there is none or it is no 32-bit number."""
    return F.coalesce(_int(F.regexp_substr(text, F.lit("[0-9]+"))), F.lit(0))


def pdf_status(has_link: Column, url: Column, downloaded: Column) -> dict[str, Column]:
    """Kept URL and status of variant A (D4). What counts is that a link is there, not that it has an address."""
    link = F.coalesce(has_link, F.lit(False))
    status = F.when(~link, "metadata_only").when(F.coalesce(downloaded, F.lit(False)), "pdf_downloaded").otherwise("pdf_url_only")
    return {"pdf_url": F.when(link, url), "scrape_status": status}


def has_text(x: Column) -> Column:
    """Present and not empty."""
    return F.coalesce(x != "", F.lit(False))


def reference_status(pdf_url: Column, downloaded: Column, from_pdf: Column, from_html: Column) -> dict[str, Column]:
    """Reference text and status of variant B (D5). A failed download does not fall back to HTML."""
    url, got = has_text(pdf_url), F.coalesce(downloaded, F.lit(False))
    pdf, html = has_text(from_pdf), has_text(from_html)
    failed, in_pdf = url & ~got, url & got & pdf
    text = F.when(failed, "").when(in_pdf, from_pdf).when(html, from_html).otherwise("")
    status = (
        F.when(failed, "PDF fail / maybe paid or redirect")
        .when(in_pdf, "PDF success")
        .when(html, "HTML fallback")
        .when(url, "PDF empty")
        .otherwise("No PDF / metadata only")
    )
    return {"references_text": text, "references_status": status}
