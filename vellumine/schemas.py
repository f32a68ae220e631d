"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


ARTICLES = "id bigint, title string, abstract string, authors string, source string, year int, citations int, url string, scraped_at timestamp, scrape_status string, pdf_url string"
ARTICLE_REFS = "title string, authors string, year int, source string, url string, pdf_url string, citations int, references_text string, references_status string, scraped_at timestamp"
RESULT_BLOCKS = "page_no int, pos int, title string, url string, info string, abstract string, cite_text string, cite_text_loose string, has_pdf_link boolean, pdf_url string"
PDF_PAGES = "pdf_url string, page_no int, text string"
PDF_BLOBS = "path string, status int, content_type string, content binary"

# The closed sets of the two status columns.
SCRAPE_STATUS = ("metadata_only", "pdf_downloaded", "pdf_url_only")
REFERENCES_STATUS = ("PDF success", "HTML fallback", "PDF empty", "PDF fail / maybe paid or redirect", "No PDF / metadata only")


def schema(text: str) -> T.StructType:
    """The schema that a string of this module names."""
    return _struct(text)
