"""URLs, file names and downloaded bytes as native column expressions."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine import joins

PDF_MAGIC = b"%PDF"
#: Results on a page of the paged search source.
PAGE_SIZE = 10


def safe_title(title: Column, most: int = 80) -> Column:
    """Runs of other than letters, digits and ``_`` as one ``_``, at most ``most`` characters."""
    return F.substring(F.regexp_replace(title, r"[^\p{L}\p{N}_]+", "_"), 1, most)


def pdf_path(title: Column, folder: str = "pdfs") -> Column:
    """The file that a title's PDF is kept in (F24); titles alike in 80 characters share it."""
    return F.concat(F.lit(f"{folder}/"), safe_title(title), F.lit(".pdf"))


#: Parameters that change from visit to visit.
VOLATILE = ("ots", "sig")


def normalized(url: Column, volatile: tuple[str, ...] = VOLATILE) -> Column:
    """The URL without volatile query parameters (an extension; de-duplication is on exact URLs by default)."""
    out = F.regexp_replace(url, rf"([?&])(?:{'|'.join(volatile)})=[^&#]*(?=[&#]|$)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"&&+", "&"), r"\?&+", "?")
    return F.regexp_replace(out, r"[?&]+(?=#|$)", "")


def basename(url: Column) -> Column:
    """The last segment of a URL's path, without its parameters (F25); any string is accepted."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")
    return F.regexp_replace(F.substring_index(path, "/", -1), ";.*$", "")


def download_path(url: Column, folder: str = "pdfs") -> Column:
    return F.concat(F.lit(f"{folder}/"), basename(url))


def has_suffix(url: Column, suffix: str = ".pdf") -> Column:
    """The whole URL ends so, whatever its case (P9, F20); a query string stands in the way."""
    return F.endswith(F.lower(url), F.lit(suffix.lower()))


# First bytes that name an encoding, and other spellings of encodings' names.
BYTE_ORDER_MARKS = (("EFBBBF", "utf-8"), ("FFFE", "utf-16le"), ("FEFF", "utf-16be"))
CHARSET_NAMES = {"utf8": "utf-8", "utf16": "utf-16le", "utf-16": "utf-16le", "utf-16-le": "utf-16le", "utf-16-be": "utf-16be", "latin1": "iso-8859-1", "latin-1": "iso-8859-1", "us-ascii": "iso-8859-1", "ascii": "iso-8859-1"}
#: Bytes at the head of a page in which its own statement of an encoding is looked for.
META_BYTES = 1024


def charset(body: Column, content_type: Column | None = None) -> Column:
    """The encoding of a body, in lower case: by its byte order mark, else its content type, else its own ``<meta>``, else ISO-8859-1.

    A ``<meta>`` that can be read says so in ASCII, so there UTF-16 is taken for UTF-8. UTF-16 without a mark is little-endian.
    """
    named = lambda text, pattern: F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit(""))
    usual = lambda name: F.coalesce(F.create_map(*[F.lit(x) for pair in CHARSET_NAMES.items() for x in pair])[name], name)
    body = body.cast("binary")
    head = F.decode(F.substring(body, 1, META_BYTES), "ISO-8859-1")
    marks = [F.when(F.startswith(F.hex(F.substring(body, 1, 3)), F.lit(mark)), F.lit(name)) for mark, name in BYTE_ORDER_MARKS]
    header = usual(named(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)")) if content_type is not None else F.lit(None).cast("string")
    meta = usual(named(head, r"(?is)<meta\s[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)"))
    return F.coalesce(*marks, header, F.when(F.startswith(meta, F.lit("utf-16")), F.lit("utf-8")).otherwise(meta), F.lit("iso-8859-1"))


@functools.cache
def _with_lower(lower: str) -> tuple[str, ...]:
    """All characters whose lower case is ``lower``, itself included."""
    return (lower, *(c for c in map(chr, range(sys.maxunicode + 1)) if c != lower and c.lower() == lower))


def _cases(lower: str, order: str) -> str:
    """A pattern of the bytes of a character in all its cases."""
    return "(?:" + "|".join("".join(rf"\x{b:02x}" for b in c.encode(order)) for c in _with_lower(lower)) + ")"


def mentions(body: Column, word: str = "forbidden", content_type: Column | None = None) -> Column:
    """The body, read by its ``charset``, holds a word, whatever its case (P10).

    UTF-8 that is not valid is read with replacements. UTF-16 is searched unit by unit, so units that are no text end
    nothing. Encodings other than these are read as ISO-8859-1.
    """
    kind, body = charset(body, content_type), body.cast("binary")
    plain = F.decode(body, "ISO-8859-1")
    units = lambda order: F.rlike(plain, F.lit("(?s)^(?:..)*?" + "".join(_cases(c, order) for c in word.lower())))
    found = F.when(kind == "utf-16le", units("utf-16-le")).when(kind == "utf-16be", units("utf-16-be"))
    found = found.when(kind == "utf-8", F.contains(F.lower(F.make_valid_utf8(body.cast("string"))), F.lit(word.lower())))
    return found.otherwise(F.contains(F.lower(plain), F.lit(word.lower())))


def starts_with(content: Column, magic: bytes = PDF_MAGIC) -> Column:
    """The first bytes are ``magic``."""
    return F.substring(content.cast("binary"), 1, len(magic)) == F.lit(bytearray(magic))


def valid_download(status: Column, content_type: Column, content: Column) -> Column:
    """Status 200, and the type or the first bytes say PDF."""
    typed = F.coalesce(F.contains(F.lower(content_type), F.lit("application/pdf")), F.lit(False))
    return F.coalesce((status == 200) & (typed | F.coalesce(starts_with(content), F.lit(False))), F.lit(False))


def downloaded_a(blobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (pdf_url, title) with ``file`` (null: no valid PDF) by variant A (D13); ``blobs``: path = URL."""
    got = joins.left(requests, blobs.select(F.col("path").alias("pdf_url"), "status", "content_type", "content"), "pdf_url")
    return got.withColumn("file", F.when(valid_download(F.col("status"), F.col("content_type"), F.col("content")), pdf_path(F.col("title")))).select(*requests.columns, "file")


def downloaded_b(blobs: DataFrame, requests: DataFrame, folder: str = "pdfs") -> DataFrame:
    """``requests`` (pdf_url) with ``file`` by variant B (D14): suffix ``.pdf``, no error status, no "forbidden" in the body, which is read by its encoding."""
    kind = F.col("content_type") if "content_type" in blobs.columns else F.lit(None).cast("string")
    got = joins.left(requests, blobs.select(F.col("path").alias("pdf_url"), F.col("status").alias("_status"), F.col("content").alias("_content"), kind.alias("_kind")), "pdf_url")
    fine = has_suffix(F.col("pdf_url")) & (F.col("_status") < 400) & ~mentions(F.col("_content"), content_type=F.col("_kind"))
    return got.withColumn("file", F.when(F.coalesce(fine, F.lit(False)), download_path(F.col("pdf_url"), folder))).select(*requests.columns, "file")


def page_count(max_results: int) -> int:
    """Pages that the paged source is asked for (L6): one more than needed at multiples of ten."""
    return max_results // PAGE_SIZE + 1


def search_urls(keywords: DataFrame, base: str, max_results: int, language: str = "id", keyword: str = "keyword") -> DataFrame:
    """(keyword, page_no, url) of the paged search source for each row of ``keywords`` (S2): each space a ``+``, ten results a page. Null keywords have none."""
    rows = keywords.where(F.col(keyword).isNotNull()).select(F.col(keyword).alias("keyword"), F.explode(F.sequence(F.lit(0), F.lit(page_count(max_results) - 1))).alias("page_no"))
    url = F.format_string(f"{base}?q=%s&hl={language}&as_sdt=0,5&start=%d", F.replace("keyword", F.lit(" "), F.lit("+")), F.col("page_no") * PAGE_SIZE)
    return rows.select("keyword", "page_no", url.alias("url"))


def search_url(keywords: DataFrame, base: str, language: str = "id", keyword: str = "keyword") -> DataFrame:
    """(keyword, page_no, url) of the one-page search source for each row of ``keywords`` (S3). Null keywords have none."""
    query = F.replace("keyword", F.lit(" "), F.lit("+"))
    rows = keywords.where(F.col(keyword).isNotNull()).select(F.col(keyword).alias("keyword"))
    return rows.select("keyword", F.lit(0).alias("page_no"), F.concat(F.lit(f"{base}?q="), query, F.lit(f"&hl={language}")).alias("url"))
