"""Ingest semantics over result blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vellumine import joins
from vellumine.functions import biblio
from vellumine.operators import numbering


def capped(blocks: DataFrame, max_results: int, page: str = "page_no", pos: str = "pos") -> DataFrame:
    """The first ``max_results`` blocks over all pages, with ``position`` from 1.

    The cap counts attempted blocks: it comes before blocks without a title go. Only the first blocks
    of each task are moved, and they are numbered in ranges, so a cap of many millions meets in no one task. Blocks of equal page and place
    come in any order.
    """
    return numbering.leading(blocks, max_results, (page, pos))


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by ``order`` (W2). Combined before the shuffle.

    A null key is no key: such rows are all kept, since a lookup by null finds nothing. Rows that tie are told apart by their
    other columns.
    """
    rest = [c for c in df.columns if c not in (*order, key)]
    # rows without a key are groups by themselves, so that ``df``, which may be dear, is made once
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    best = df.groupBy(key, own.alias("_own")).agg(F.min_by(F.struct(*df.columns), F.struct(*order, *[F.col(c).cast("string") for c in rest])).alias("_r"))
    return best.select("_r.*")


def unseen(candidates: DataFrame, existing: DataFrame, key: str = "url") -> DataFrame:
    """Candidates whose key is not in ``existing`` (J1): exact equality, null keys are kept and not shuffled."""
    return joins.without(candidates, existing, key)


def with_title(blocks: DataFrame) -> DataFrame:
    """Blocks that have a title. Filters behind a generator aren't pushed into what makes the columns, which would make them twice."""
    return blocks.select(F.inline(F.array(F.struct(*blocks.columns)))).where(F.col("title").isNotNull())


def typed_articles(df: DataFrame, now: Column) -> DataFrame:
    """Article rows with defaults for what is missing (P3); ``now`` is the time to record."""
    names = set(df.columns)
    at = lambda name, kind, default: (F.coalesce(F.col(name).cast(kind), default) if name in names else default).alias(name)
    empty, none = F.lit(""), lambda kind: F.lit(None).cast(kind)
    return df.select(
        at("title", "string", empty),
        at("authors", "string", empty),
        at("year", "int", none("int")),
        at("source", "string", empty),
        at("abstract", "string", empty),
        at("citations", "int", F.lit(0)),
        at("url", "string", empty),
        at("pdf_url", "string", none("string")),
        at("scrape_status", "string", F.lit("metadata_only")),
        now.cast("timestamp").alias("scraped_at"),
    )


def articles_a(blocks: DataFrame, existing: DataFrame, now: Column, max_results: int | None = 50, downloaded: DataFrame | None = None) -> DataFrame:
    """Ingest A (D15): cap (None: all blocks), title, first of each URL, not persisted yet, then parsing and PDF status.

    ``downloaded`` has (pdf_url) of valid downloads. Titled blocks without a URL are all kept.
    """
    taken = blocks if max_results is None else capped(blocks, max_results)
    fresh = first_per_key(with_title(taken), "url", "page_no", "pos")
    fresh = unseen(fresh, existing, "url")
    got = F.lit(False)
    if downloaded is not None:
        fresh = joins.left(fresh, downloaded.select("pdf_url").distinct().withColumn("_got", F.lit(True)), "pdf_url")
        got = F.col("_got")
    info = biblio.info_a(F.col("info"))
    pdf = biblio.pdf_status(F.col("has_pdf_link"), F.col("pdf_url"), got)
    parsed = fresh.select("title", "url", "abstract", biblio.citations(F.col("cite_text")).alias("citations"), *[v.alias(k) for k, v in (info | pdf).items()])
    return typed_articles(parsed, now)


def articles_b(blocks: DataFrame, now: Column, max_results: int = 10, downloaded: DataFrame | None = None, pdf_refs: DataFrame | None = None, html_refs: DataFrame | None = None) -> DataFrame:
    """Ingest B (D16): cap on one page, title, parsing, references and their status; no de-duplication.

    ``downloaded`` has (pdf_url), ``pdf_refs`` (pdf_url, references_text), ``html_refs`` (url, html_references); of several
    texts for one address the greatest counts, so that a block gives one row at most.
    """
    rows = with_title(blocks.where(F.col("pos") <= max_results))
    rows = joins.left(rows, downloaded.select("pdf_url").distinct().withColumn("_got", F.lit(True)), "pdf_url") if downloaded is not None else rows.withColumn("_got", F.lit(False))
    rows = joins.left(rows, pdf_refs.groupBy("pdf_url").agg(F.max("references_text").alias("_pdf")), "pdf_url") if pdf_refs is not None else rows.withColumn("_pdf", F.lit(""))
    rows = joins.left(rows, html_refs.groupBy("url").agg(F.max("html_references").alias("_html")), "url") if html_refs is not None else rows.withColumn("_html", F.lit(""))
    info = biblio.info_b(F.col("info"))
    refs = biblio.reference_status(F.col("pdf_url"), F.col("_got"), F.col("_pdf"), F.col("_html"))
    pdf = F.when(biblio.has_text(F.col("pdf_url")), F.col("pdf_url"))
    return rows.select("title", info["authors"].alias("authors"), info["year"].alias("year"), info["source"].alias("source"), "url", pdf.alias("pdf_url"), biblio.citations(F.col("cite_text_loose")).alias("citations"), *[v.alias(k) for k, v in refs.items()], now.cast("timestamp").alias("scraped_at"))


def observed(df: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows as they are written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("success")), seen


def append(df: DataFrame, path: str) -> int:
    """Append rows to a Parquet table as one atomic batch (S8); returns how many."""
    counted, seen = observed(df)
    counted.write.mode("append").parquet(path)
    return seen.get["success"]


def append_batch(df: DataFrame, path: str, writer: str, batch: int) -> int:
    """Rows of one numbered batch of a ``writer`` into a Parquet table; returns how many.

    Each batch has a folder of its own, ``writer=.../batch=...``, which a batch that is run again replaces: its
    rows stand in the table once, however often it ran, those with null keys too. The two names are columns of the table.
    """
    counted, seen = observed(df)
    counted.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={batch}")
    return seen.get["success"]
