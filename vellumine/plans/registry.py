"""Registry of the engine's own queries and of the DuckDB SQL that each must equal.

The driver's tables stand in for the engine's: a document's first line for a title and the rest for an
abstract, order columns for an info line, pages for stored HTML. All run over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine import sqlfunctions
from vellumine.functions import biblio, refs, text, urls
from vellumine.operators import ingest, keyindex, numbering, sketches, tfidf
from vellumine.session import shared_folder, spread
from vellumine.sources import html, pdf, readers
from vellumine.streaming import landing

#: Stopwords of the queries: frequent words of the test tables.
STOP = ("the", "of", "and", "der", "die", "und", "de", "la", "le", "que")
#: Blocks that the capped ingest query takes, and words that its test stemmer shortens.
CAP, SUFFIXES = 10_000, ("ing", "ed", "ly")
PLACES = 9

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.corpus_of_lines(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def _rounded(name: str):
    return F.round(F.col(name), PLACES).alias(name)


# --- SQL parts ------------------------------------------------------------------------------

_CORPUS = "corpus AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS abstract FROM documents)"
_CLEAN = "trim(regexp_replace(lower({}), '[^a-z]+', ' ', 'g'))"
_TOKENS = f"list_filter(string_split(coalesce({_CLEAN}, ''), ' '), lambda t: t <> '')"
_FIELDS = "fields AS (SELECT id, 'title' AS field, title AS text FROM corpus UNION ALL SELECT id, 'abstract', abstract FROM corpus)"
_WORDS = f"words AS (SELECT id, field, unnest({_TOKENS.format('text')}) AS term FROM fields)"
_POSTINGS = "postings AS (SELECT id, field, term, count(*) AS freq, count(*) / sum(count(*)) OVER (PARTITION BY id, field) AS tf FROM words GROUP BY id, field, term)"
_STATS = "stats AS (SELECT term, count(*) AS df_t, log10((SELECT count(*) FROM corpus) / count(*)) AS idf FROM postings GROUP BY term)"
_WITH = f"WITH {_CORPUS}, {_FIELDS}, {_WORDS}, {_POSTINGS}, {_STATS} "
_STOP = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_STRIP = r"regexp_replace({}, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g')"
_IS_REF = r"regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])\p{{Nd}}{{4}}([^\p{{L}}\p{{N}}_]|$)') AND (contains({0}, ',') OR contains({0}, 'http'))"
_INFO = "('Clerk-' || o_custkey || ' - ' || o_orderpriority || ', ' || year(o_orderdate) || ' - ' || o_orderstatus || '.org')"


# --- projections and counts -------------------------------------------------------------------


@_query("SELECT doc_id, lang, source FROM documents")
def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


@_query("SELECT count(*) AS n_rows FROM documents")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").agg(F.count("*").alias("n_rows"))


@_query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(10)


@_query(f"SELECT doc_id, {_CLEAN.format('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@_query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def tokenize_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spread(_table(spark, sf_dir, "documents").select("text")).select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


@_query(f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@_query(f"WITH {_CORPUS} SELECT id, abstract IS NULL AS no_abstract, CAST(len({_TOKENS.format('abstract')}) AS BIGINT) AS n_tokens FROM corpus")
def null_text_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("id", F.col("abstract").isNull().alias("no_abstract"), F.size(text.tokens(F.col("abstract"))).cast("long").alias("n_tokens"))


@_query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) WHERE term NOT IN {_STOP} GROUP BY term")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spread(_table(spark, sf_dir, "documents").select("text")).select(F.explode(text.without(text.tokens(F.col("text")), STOP)).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


@_query(
    f"WITH {_CORPUS}, {_FIELDS}, t AS (SELECT id, field, {_TOKENS.format('text')} AS tokens FROM fields) "
    f"SELECT id, field, CAST(len(list_filter(tokens, lambda t: list_contains({_STOP_LIST}, t))) AS BIGINT) AS n_stop, list_has_any(tokens, {_STOP_LIST}) AS gate FROM t"
)
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tfidf.union_fields(_corpus(spark, sf_dir)).select("id", "field", text.tokens(F.col("text")).alias("tokens"))
    return found.select("id", "field", text.stopword_count(F.col("tokens"), STOP).cast("long").alias("n_stop"), text.gate(F.col("tokens"), STOP).alias("gate"))


def _stop_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP], "term string")


@_query(f"WITH {_CORPUS}, {_FIELDS}, {_WORDS} SELECT id, field, count(*) AS n FROM words WHERE term NOT IN {_STOP} GROUP BY id, field")
def stopword_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tfidf.without_listed(tfidf.words(_corpus(spark, sf_dir)), _stop_table(spark))
    return kept.groupBy("id", "field").agg(F.count("*").alias("n"))


@_query(f"WITH {_CORPUS}, {_FIELDS}, {_WORDS} SELECT DISTINCT id, field FROM words WHERE term IN {_STOP}")
def language_gate_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.in_language(tfidf.words(_corpus(spark, sf_dir)), _stop_table(spark))


@_query(f"WITH {_CORPUS}, {_FIELDS} SELECT id, field, text FROM fields")
def union_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.union_fields(_corpus(spark, sf_dir))


# --- term statistics ----------------------------------------------------------------------------


@_query(_WITH + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM (SELECT DISTINCT term FROM postings)")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.vocabulary(tfidf.document_terms(_corpus(spark, sf_dir)))


@_query(_WITH + "SELECT count(DISTINCT term) AS n_terms FROM postings")
def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.document_terms(_corpus(spark, sf_dir)).agg(F.countDistinct("term").alias("n_terms"))


@_query(_WITH + f"SELECT id, field, term, freq, round(tf, {PLACES}) AS tf FROM postings")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.postings(_corpus(spark, sf_dir)).select("id", "field", "term", "freq", _rounded("tf"))


@_query(_WITH + "SELECT term, df_t FROM stats")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.document_frequency(tfidf.document_terms(_corpus(spark, sf_dir)))


@_query(_WITH + f"SELECT term, df_t, round(idf, {PLACES}) AS idf FROM stats")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    return tfidf.inverse_frequency(corpus, tfidf.document_frequency(tfidf.document_terms(corpus))).select("term", "df_t", _rounded("idf"))


@_query(_WITH + f"SELECT id, field, term, round(tf * idf, {PLACES}) AS tfidf FROM postings JOIN stats USING (term)")
def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.tfidf(_corpus(spark, sf_dir)).select("id", "field", "term", _rounded("tfidf"))


QUERIES["tfidf"], SQL["tfidf"] = QUERIES.pop("_tfidf"), SQL.pop("_tfidf")

_STOPPED = _WORDS.replace("words AS", "raw AS") + f", words AS (SELECT * FROM raw WHERE term NOT IN {_STOP})"


@_query(f"WITH {_CORPUS}, {_FIELDS}, {_STOPPED}, {_POSTINGS}, {_STATS} SELECT id, field, term, round(tf * idf, {PLACES}) AS tfidf FROM postings JOIN stats USING (term)")
def tfidf_without_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.tfidf(_corpus(spark, sf_dir), STOP).select("id", "field", "term", _rounded("tfidf"))


@_query(
    _WITH + f", grid AS (SELECT id, field, unnest({_STOP_LIST}) AS term FROM fields) "
    f"SELECT g.id, g.field, g.term, round(coalesce(tf * idf, 0), {PLACES}) AS tfidf FROM grid g LEFT JOIN postings p USING (id, field, term) LEFT JOIN stats s ON s.term = g.term"
)
def tfidf_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weights of the listed terms, absent ones 0."""
    corpus = _corpus(spark, sf_dir)
    return tfidf.densified(tfidf.tfidf(corpus), corpus, STOP).select("id", "field", "term", _rounded("tfidf"))


def short_stem(word: str) -> str:
    """A stemmer for tests that SQL can repeat: one of SUFFIXES goes from words of over five letters."""
    return next((word[: -len(x)] for x in SUFFIXES if len(word) > 5 and word.endswith(x)), word)


_STEMMED = (
    f"lists AS (SELECT id, field, list_filter({_TOKENS.format('text')}, lambda t: NOT list_contains({_STOP_LIST}, t)) AS tokens, list_has_any({_TOKENS.format('text')}, {_STOP_LIST}) AS gate FROM fields), "
    "raw AS (SELECT id, field, gate, unnest(tokens) AS term FROM lists), "
    "words AS (SELECT id, field, CASE WHEN gate AND length(term) > 5 THEN regexp_replace(term, '(ing|ed|ly)$', '') ELSE term END AS term FROM raw)"
)


@_query(f"WITH {_CORPUS}, {_FIELDS}, {_STEMMED}, {_POSTINGS}, {_STATS} SELECT id, field, term, round(tf * idf, {PLACES}) AS tfidf FROM postings JOIN stats USING (term)")
def tfidf_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF after stopwords went and the tokens of texts in the language were stemmed."""
    return tfidf.tfidf(_corpus(spark, sf_dir), STOP, short_stem).select("id", "field", "term", _rounded("tfidf"))


@_query(
    f"WITH {_CORPUS}, t AS (SELECT id, list_concat({_TOKENS.format('title')}, {_TOKENS.format('abstract')}) AS tokens FROM corpus) "
    "SELECT id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM t"
)
def list_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _corpus(spark, sf_dir).select("id", tfidf.both_fields().alias("tokens"))
    return found.select("id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@_query(
    _WITH + f"SELECT id, field, round(coalesce(max(CASE WHEN term = 'the' THEN tf END), 0), {PLACES}) AS tf_the, round(coalesce(max(CASE WHEN term = 'und' THEN tf END), 0), {PLACES}) AS tf_und, count(*) AS n_terms FROM postings GROUP BY id, field"
)
def tf_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = tfidf.frequency_maps(tfidf.postings(_corpus(spark, sf_dir)))
    found = maps.select("id", "field", tfidf.looked_up(maps, "the").alias("tf_the"), tfidf.looked_up(maps, "und").alias("tf_und"), F.size(F.map_entries("tf")).cast("long").alias("n_terms"))
    return found.select("id", "field", _rounded("tf_the"), _rounded("tf_und"), "n_terms")


# --- bibliographic parsing ------------------------------------------------------------------------


def _info_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Clerk-"), F.col("o_custkey"), F.lit(" - "), F.col("o_orderpriority"), F.lit(", "), F.year("o_orderdate"), F.lit(" - "), F.col("o_orderstatus"), F.lit(".org"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", line.alias("info"))


@_query(
    f"WITH i AS (SELECT o_orderkey, {_INFO} AS info FROM orders), "
    "p AS (SELECT o_orderkey, split_part(info, ' - ', 1) AS authors, substr(info, strpos(info, ' - ') + 3) AS rest FROM i), "
    r"y AS (SELECT *, nullif(regexp_extract(rest, '(?:^|[^\p{L}\p{N}_])((?:19|20)\p{Nd}{2})(?:[^\p{L}\p{N}_]|$)', 1), '') AS yr FROM p) "
    "SELECT o_orderkey, trim(authors) AS authors, CAST(yr AS INTEGER) AS year, CASE WHEN yr IS NOT NULL THEN trim(substr(rest, strpos(rest, yr) + 4), ' ,-.') ELSE trim(rest) END AS source FROM y"
)
def biblio_parse_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _info_lines(spark, sf_dir).select("o_orderkey", *[v.alias(k) for k, v in biblio.info_a(F.col("info")).items()])


@_query(
    f"WITH i AS (SELECT o_orderkey, {_INFO} AS info FROM orders) "
    r"SELECT o_orderkey, trim(split_part(info, '-', 1)) AS authors, TRY_CAST(regexp_extract(info, '(?:^|[^\p{L}\p{N}_])(\p{Nd}{4})(?:[^\p{L}\p{N}_]|$)', 1) AS INTEGER) AS year, info AS source FROM i"
)
def biblio_parse_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _info_lines(spark, sf_dir).select("o_orderkey", *[v.alias(k) for k, v in biblio.info_b(F.col("info")).items()])


@_query("SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '[0-9]+') AS INTEGER), 0) AS citations FROM events")
def citation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", biblio.citations(F.col("props")).alias("citations"))


_FLAGS = "o_orderstatus <> 'P' AS has_link, CASE WHEN o_orderkey % 3 > 0 THEN 'http://x.org/' || o_orderkey || '.pdf' END AS url, o_orderkey % 2 = 0 AS got, CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN 'pdf refs' END AS from_pdf, CASE WHEN o_custkey % 5 < 2 THEN 'html refs' END AS from_html"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") != "P").alias("has_link"),
        F.when(key % 3 > 0, F.concat(F.lit("http://x.org/"), key, F.lit(".pdf"))).alias("url"),
        (key % 2 == 0).alias("got"),
        F.when(cust % 3 == 0, "").when(cust % 3 == 1, "pdf refs").alias("from_pdf"),
        F.when(cust % 5 < 2, "html refs").alias("from_html"),
    )


@_query(f"WITH f AS (SELECT o_orderkey, {_FLAGS} FROM orders) SELECT o_orderkey, CASE WHEN has_link THEN url END AS pdf_url, CASE WHEN NOT has_link THEN 'metadata_only' WHEN got THEN 'pdf_downloaded' ELSE 'pdf_url_only' END AS scrape_status FROM f")
def pdf_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("o_orderkey", *[v.alias(k) for k, v in biblio.pdf_status(F.col("has_link"), F.col("url"), F.col("got")).items()])


@_query(
    f"WITH f AS (SELECT o_orderkey, {_FLAGS} FROM orders) SELECT o_orderkey, "
    "CASE WHEN url IS NOT NULL AND NOT got THEN '' WHEN url IS NOT NULL AND from_pdf <> '' THEN from_pdf WHEN from_html <> '' THEN from_html ELSE '' END AS references_text, "
    "CASE WHEN url IS NOT NULL AND NOT got THEN 'PDF fail / maybe paid or redirect' WHEN url IS NOT NULL AND from_pdf <> '' THEN 'PDF success' WHEN from_html <> '' THEN 'HTML fallback' WHEN url IS NOT NULL THEN 'PDF empty' ELSE 'No PDF / metadata only' END AS references_status FROM f"
)
def reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("o_orderkey", *[v.alias(k) for k, v in biblio.reference_status(F.col("url"), F.col("got"), F.col("from_pdf"), F.col("from_html")).items()])


# --- reference lines ----------------------------------------------------------------------------


def _lines_sql(table: str, key: str, body: str) -> str:
    return f"lines AS (SELECT {key}, unnest(string_split({body}, chr(10))) AS raw, generate_subscripts(string_split({body}, chr(10)), 1) AS line_no FROM {table})"


def _ref_lines(keys: str) -> str:
    return f"SELECT {keys}, line_no, {_STRIP.format('raw')} AS line FROM lines WHERE {_IS_REF.format('raw')}"


@_query(f"WITH {_lines_sql('documents', 'doc_id', 'text')} " + _ref_lines("doc_id"))
def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.reference_lines(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query(
    f"WITH {_lines_sql('documents', 'doc_id', 'text')}, r AS ({_ref_lines('doc_id')}), "
    f"a AS (SELECT doc_id, {_STRIP.format('string_agg(line, chr(10) ORDER BY line_no)')} AS references_text FROM r GROUP BY doc_id) "
    "SELECT d.doc_id, coalesce(references_text, '') AS references_text, CAST(length(coalesce(references_text, '')) AS BIGINT) AS n_characters FROM documents d LEFT JOIN a USING (doc_id)"
)
def reference_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", refs.reference_text(F.col("text")).alias("references_text"))
    return found.withColumn("n_characters", F.length("references_text").cast("long"))


@_query(
    f"WITH pg AS (SELECT doc_id % 50 AS file, doc_id, text FROM documents), {_lines_sql('pg', 'file, doc_id', 'text')}, r AS ({_ref_lines('file, doc_id')}), "
    f"a AS (SELECT file, {_STRIP.format('string_agg(line, chr(10) ORDER BY doc_id, line_no)')} AS references_text FROM r GROUP BY file) "
    "SELECT f.file, coalesce(references_text, '') AS references_text FROM (SELECT DISTINCT file FROM pg) f LEFT JOIN a USING (file)"
)
def reference_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("file"), F.col("doc_id").alias("page_no"), "text")
    return refs.references_of_pages(pages, "file")


@_query(f"WITH {_lines_sql('pages', 'page_id', 'html')} " + _ref_lines("page_id"))
def reference_lines_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.reference_lines(_table(spark, sf_dir, "pages"), "page_id", "html")


# --- names, URLs and bytes ----------------------------------------------------------------------

_SAFE = r"substr(regexp_replace(split_part(text, chr(10), 1), '[^\p{L}\p{N}_]+', '_', 'g'), 1, 80)"


@_query(f"SELECT doc_id, {_SAFE} AS safe_title, 'pdfs/' || {_SAFE} || '.pdf' AS file FROM documents")
def safe_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = text.first_line(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", urls.safe_title(title).alias("safe_title"), urls.pdf_path(title).alias("file"))


@_query(f"SELECT {_SAFE} AS safe_title, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def safe_title_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "documents").select(urls.safe_title(text.first_line(F.col("text"))).alias("safe_title"))
    return names.groupBy("safe_title").agg(F.count("*").alias("n")).where("n > 1")


@_query(r"SELECT page_id, regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*', ''), '[^/]*$'), ';.*$', '') AS basename FROM pages")
def url_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", urls.basename(F.col("url")).alias("basename"))


@_query("SELECT page_id, url FROM pages WHERE ends_with(lower(url), '.html')")
def url_suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").where(urls.has_suffix(F.col("url"), ".html")).select("page_id", "url")


@_query("SELECT page_id FROM pages WHERE NOT contains(lower(html), 'was')")
def forbidden_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").where(~urls.mentions(F.col("html"), "was")).select("page_id")


@_query("SELECT page_id, substr(html, 1, 4) = '<!DO' AS is_html, substr(html, 1, 4) = '%PDF' AS is_pdf FROM pages")
def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", urls.starts_with(F.col("html"), b"<!DO").alias("is_html"), urls.starts_with(F.col("html")).alias("is_pdf"))


@_query("SELECT page_id, 200 + CAST(page_id % 2 AS INTEGER) * 204 = 200 AND (page_id % 3 = 0 OR substr(html, 1, 4) = '%PDF') AS valid FROM pages")
def valid_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.lit(200) + (F.col("page_id") % 2).cast("int") * 204
    kind = F.when(F.col("page_id") % 3 == 0, "Application/PDF; x").otherwise("text/html")
    return _table(spark, sf_dir, "pages").select("page_id", urls.valid_download(status, kind, F.col("html")).alias("valid"))


@_query("SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@_query("""SELECT page_id, pos, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages)""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("p", "href"))
    return found.select("page_id", (F.col("p") + 1).cast("long").alias("pos"), "href")


# --- result pages: orders, written as stored HTML of ten blocks a page ------------------------------

_BLOCKS = f"""blocks AS (
  SELECT CAST(o_orderkey // 10 AS INTEGER) AS page_no, CAST(row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS INTEGER) AS pos,
    CASE WHEN o_orderstatus <> 'P' THEN 'Order ' || o_orderkey || ' & more' END AS title,
    CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' THEN 'http://x.org/' || o_custkey END AS url,
    {_INFO} AS info, 'Status' || chr(10) || o_orderstatus AS abstract,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Cited ' || o_custkey || ' times' END AS cite_text,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Cited ' || o_custkey || ' times' END AS cite_text_loose,
    o_orderpriority IN ('2-HIGH', '3-MEDIUM') AS has_pdf_link,
    CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'http://x.org/' || o_orderkey || '.pdf' END AS pdf_url
  FROM orders)"""


def _result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_no, html): each order a result block; some have no title link, address, citations or PDF. Of links of a kind there are two: the first counts."""
    key, status, priority, customer = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")
    info = F.concat(F.lit("Clerk-"), customer, F.lit(" - "), priority, F.lit(", "), F.year("o_orderdate"), F.lit(" - "), status, F.lit(".org"))
    link = F.concat(F.lit("<a"), F.when(priority != "5-LOW", F.concat(F.lit(' href="http://x.org/'), customer, F.lit('"'))).otherwise(""), F.lit(">Order <b>"), key, F.lit('</b> &amp; more</a> <a href="http://x.org/second">second title</a>'))
    cited = F.when(priority == "1-URGENT", F.lit("/s?cites=1")).when(priority == "2-HIGH", F.lit("/cites/2"))
    block = F.concat(
        F.lit('<div class="gs_r gs_or gs_scl"><h3 class="gs_rt">'), F.when(status != "P", link).otherwise("no link"),
        F.lit('</h3><div class="gs_a">'), info, F.lit('</div><div class="gs_rs">Status<br>'), status, F.lit("</div>"),
        F.coalesce(F.concat(F.lit('<a href="'), cited, F.lit('">Cited '), customer, F.lit(' times</a> <a href="'), cited, F.lit('9">Cited 0 times</a>')), F.lit("")),
        F.when(priority.isin("2-HIGH", "3-MEDIUM"), F.concat(F.lit('<div class="gs_or_ggsm"><a href="http://x.org/'), key, F.lit('.pdf">PDF</a> <a href="http://x.org/second.pdf">PDF</a></div>'))).otherwise(""),
        F.lit("</div>"),
    )
    pages = _table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 10").cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))).alias("blocks"))
    return pages.select("page_no", F.concat(F.lit("<html><body>"), F.array_join(F.transform("blocks", lambda x: x["b"]), "\n"), F.lit("</body></html>")).alias("html"))


@_query(f"WITH {_BLOCKS} SELECT * FROM blocks")
def result_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every block of stored result pages."""
    return html.result_blocks(_result_pages(spark, sf_dir))


@_query(f"WITH {_BLOCKS} SELECT page_no, count(*) AS n FROM blocks GROUP BY page_no")
def results_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.result_blocks(_result_pages(spark, sf_dir)).groupBy("page_no").agg(F.count("*").alias("n"))


# --- ingest ---------------------------------------------------------------------------------------


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def anti_join_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose key is not persisted yet: orders of which no large line is held. Keys that are held repeat."""
    held = _table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.unseen(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), held, "o_orderkey")


@_query(SQL["anti_join_dedup"])
def key_index_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same candidates held against a persisted index of keys, which two batches have filled and one of them twice."""
    path = _scratch(spark, "index")
    held = _table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", F.col("l_linenumber") % 2)
    keyindex.create(spark, path, 1_000_000)
    for batch, part in ((0, "= 0"), (1, "= 1"), (0, "= 0")):
        keyindex.add(held.where(f"`(l_linenumber % 2)` {part}"), path, batch, "l_orderkey")
    return keyindex.unseen(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, "o_orderkey")


@_query("SELECT user_id, event_type, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS n FROM events")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's number in the order of time, without one sorted partition."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return numbering.numbered(events, ("ts", "event_id"), "n").select("user_id", "event_type", "n")


@_query("SELECT DISTINCT user_id || '/' || event_type AS key FROM events")
def stream_first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they land, file by file, with the keys that the stream has seen as its state."""
    folder, table = _scratch(spark, "events"), _scratch(spark, "first")
    rows = _table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(3).write.parquet(folder)
    landing.deduplicate_folder(spark, folder, table, _scratch(spark, "marks"), "key string, ts timestamp", "key", "ts", "3650 days", 1).awaitTermination()
    return spark.read.parquet(table).select("key")


@_query("SELECT min(doc_id) AS doc_id, length(text) AS n_chars FROM documents GROUP BY text")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("text", "doc_id")
    return ingest.first_per_key(documents, "text", "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"))


@_query("SELECT page_id, row_number() OVER (ORDER BY page_id) AS position FROM pages QUALIFY position <= 50 AND ends_with(lower(url), '.html')")
def position_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = ingest.capped(_table(spark, sf_dir, "pages").withColumn("pos", F.lit(1)), 50, "page_id", "pos")
    return capped.where(urls.has_suffix(F.col("url"), ".html")).select("page_id", F.col("position").cast("long").alias("position"))


@_query("SELECT c_name || ' ' || c_mktsegment AS keyword, CAST(i AS INTEGER) AS page_no, 'https://search.example.org/scholar?q=' || replace(c_name || ' ' || c_mktsegment, ' ', '+') || '&hl=id&as_sdt=0,5&start=' || (i * 10) AS url FROM customer, range(0, 50 // 10 + 1) AS r(i)")
def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.search_urls(_keywords(spark, sf_dir), "https://search.example.org/scholar", 50)


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("keyword"))


@_query(
    "SELECT 'Order ' || o_orderkey AS title, '' AS authors, year(o_orderdate)::INTEGER AS year, o_orderpriority AS source, '' AS abstract, 0 AS citations, 'http://x.org/' || o_orderkey AS url, "
    "CAST(NULL AS VARCHAR) AS pdf_url, 'metadata_only' AS scrape_status, TIMESTAMP '2026-02-01 00:00:00' AS scraped_at FROM orders"
)
def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("source"), F.concat(F.lit("http://x.org/"), F.col("o_orderkey")).alias("url")
    )
    typed = ingest.typed_articles(rows, F.to_timestamp(F.lit("2026-02-01 00:00:00")))
    return typed.withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))


_NOW = "2026-02-01 00:00:00"
_YEAR_A = r"nullif(regexp_extract(rest, '(?:^|[^\p{L}\p{N}_])((?:19|20)\p{Nd}{2})(?:[^\p{L}\p{N}_]|$)', 1), '')"
_INGESTED = (
    f"{_BLOCKS}, capped AS (SELECT *, row_number() OVER (ORDER BY page_no, pos) AS position FROM blocks QUALIFY position <= {{cap}}), "
    "first AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY position) AS rn FROM capped WHERE title IS NOT NULL), "
    "fresh AS (SELECT * FROM first f WHERE (rn = 1 OR url IS NULL) AND NOT EXISTS (SELECT 1 FROM customer c WHERE c_mktsegment = 'BUILDING' AND 'http://x.org/' || c_custkey = f.url)), "
    f"parsed AS (SELECT *, trim(split_part(info, ' - ', 1)) AS authors, substr(info, strpos(info, ' - ') + 3) AS rest, {_YEAR_A} AS yr FROM fresh) "
    "SELECT title, authors, CAST(yr AS INTEGER) AS year, CASE WHEN yr IS NOT NULL THEN trim(substr(rest, strpos(rest, yr) + 4), ' ,-.') ELSE trim(rest) END AS source, abstract, "
    "coalesce(TRY_CAST(regexp_extract(cite_text, '[0-9]+') AS INTEGER), 0) AS citations, coalesce(url, '') AS url, pdf_url, "
    "CASE WHEN NOT has_pdf_link THEN 'metadata_only' WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND 'http://x.org/' || o_orderkey || '.pdf' = parsed.pdf_url) THEN 'pdf_downloaded' ELSE 'pdf_url_only' END AS scrape_status, "
    f"TIMESTAMP '{_NOW}' AS scraped_at FROM parsed"
)


def _ingested(spark: SparkSession, sf_dir: str, cap: int | None) -> DataFrame:
    blocks = html.result_blocks(_result_pages(spark, sf_dir))
    existing = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("http://x.org/"), "c_custkey").alias("url"))
    downloaded = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("http://x.org/"), "o_orderkey", F.lit(".pdf")).alias("pdf_url"))
    made = ingest.articles_a(blocks, existing, F.to_timestamp(F.lit(_NOW)), cap, downloaded)
    return made.withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))


@_query(f"WITH {_INGESTED.replace("{cap}", str(CAP))}")
def ingest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest A: blocks of stored pages, cap, titles, first of each URL, what is persisted already, parsing and PDF status."""
    return _ingested(spark, sf_dir, CAP)


@_query(f"WITH {_INGESTED.replace("{cap}", str(1 << 62))}")
def ingest_articles_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest A without a cap, as the stream takes it."""
    return _ingested(spark, sf_dir, None)


@_query(
    f"WITH {_BLOCKS}, r AS (SELECT l_orderkey, 'Ref ' || max(l_linenumber) || ', 2001' AS t FROM lineitem GROUP BY l_orderkey), h AS (SELECT c_custkey, max(c_name) AS t FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY c_custkey), "
    "j AS (SELECT b.*, coalesce(pdf_url <> '', false) AS has, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND 'http://x.org/' || o_orderkey || '.pdf' = b.pdf_url) AS got, r.t AS from_pdf, h.t AS from_html "
    "FROM blocks b LEFT JOIN r ON 'http://x.org/' || l_orderkey || '.pdf' = b.pdf_url LEFT JOIN h ON 'http://x.org/' || c_custkey = b.url WHERE title IS NOT NULL AND pos <= 7) "
    r"SELECT title, trim(split_part(info, '-', 1)) AS authors, TRY_CAST(regexp_extract(info, '(?:^|[^\p{L}\p{N}_])(\p{Nd}{4})(?:[^\p{L}\p{N}_]|$)', 1) AS INTEGER) AS year, info AS source, url, pdf_url, "
    "coalesce(TRY_CAST(regexp_extract(cite_text_loose, '[0-9]+') AS INTEGER), 0) AS citations, "
    "CASE WHEN has AND NOT got THEN '' WHEN has AND from_pdf <> '' THEN from_pdf WHEN from_html <> '' THEN from_html ELSE '' END AS references_text, "
    "CASE WHEN has AND NOT got THEN 'PDF fail / maybe paid or redirect' WHEN has AND from_pdf <> '' THEN 'PDF success' WHEN from_html <> '' THEN 'HTML fallback' WHEN has THEN 'PDF empty' ELSE 'No PDF / metadata only' END AS references_status, "
    f"TIMESTAMP '{_NOW}' AS scraped_at FROM j"
)
def ingest_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest B: the first seven blocks of each page, titles, parsing, references of PDFs and pages with their status."""
    blocks = html.result_blocks(_result_pages(spark, sf_dir))
    address = lambda c: F.concat(F.lit("http://x.org/"), F.col(c), F.lit(".pdf")).alias("pdf_url")
    downloaded = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(address("o_orderkey"))
    # several lines for one PDF: one row a block all the same
    pdf_refs = _table(spark, sf_dir, "lineitem").select(address("l_orderkey"), F.concat(F.lit("Ref "), "l_linenumber", F.lit(", 2001")).alias("references_text"))
    html_refs = _table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("http://x.org/"), "c_custkey").alias("url"), F.col("c_name").alias("html_references"))
    made = ingest.articles_b(blocks, F.to_timestamp(F.lit(_NOW)), 7, downloaded, pdf_refs, html_refs)
    return made.withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))


# --- sources and sinks ------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_query(
    "SELECT CAST(c_custkey AS BIGINT) AS id, c_name || ', \"' || c_mktsegment || '\"' AS title, 'first line' || chr(10) || c_name AS abstract, CAST(c_nationkey AS INTEGER) AS year, 'http://x.org/' || c_custkey AS url FROM customer"
)
def csv_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exported table, written with quotes and cells of several lines, read back by its schema."""
    return readers.articles_csv(spark, _exported(spark, sf_dir)).select("id", "title", "abstract", "year", "url")


def _exported(spark: SparkSession, sf_dir: str) -> str:
    path = _scratch(spark, "csv")
    rows = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("title"), F.concat(F.lit("first line\n"), "c_name").alias("abstract"),
        F.col("c_nationkey").alias("year"), F.concat(F.lit("http://x.org/"), "c_custkey").alias("url"),
    )
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return path


@_query(SQL["csv_articles"])
def csv_split_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same exported table, read in byte ranges of its files instead of file by file."""
    return readers.articles_csv_split(spark, _exported(spark, sf_dir)).select("id", "title", "abstract", "year", "url")


@_query(
    "SELECT step, count(*) AS success, (SELECT count(DISTINCT o_custkey) FROM orders) AS rows_in_table FROM ("
    "SELECT 1 AS step, o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey UNION ALL "
    "SELECT 2, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'F' AND p.o_custkey = o.o_custkey) GROUP BY o_custkey) GROUP BY step"
)
def append_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one table, each of what it does not hold yet, with the rows that each reports; the second run of a step adds none."""
    path = _scratch(spark, "table")
    urls_of = lambda df: df.select(F.concat(F.lit("http://x.org/"), "o_custkey").alias("url")).distinct()
    orders = _table(spark, sf_dir, "orders")
    counts = []
    for step, batch in ((1, orders.where("o_orderstatus = 'F'")), (2, orders), (3, orders)):
        counts.append((step, ingest.append(ingest.unseen(urls_of(batch), readers.persisted(spark, path)), path)))
    done = spark.createDataFrame([c for c in counts if c[1]], "step int, success long")
    total = spark.read.parquet(path).agg(F.count("*").alias("rows_in_table"))
    return done.join(F.broadcast(total.withColumn("k", F.lit(1))), F.lit(1) == F.col("k")).select("step", "success", "rows_in_table")


@_query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY line")
def blob_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at rest, read as bytes: lines of all documents by how often they stand there."""
    path = _scratch(spark, "blobs")
    spread(_table(spark, sf_dir, "documents").select("text")).where("text IS NOT NULL").write.text(path)
    lines = readers.blobs(spark, f"{path}/part-*").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    return lines.where("line != ''").groupBy("line").agg(F.count("*").alias("n"))


@_query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) WHERE term NOT IN {_STOP} GROUP BY term")
def stopword_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopwords from a file, as a table for the join and as a list for literals."""
    path = _scratch(spark, "stopwords")
    spark.createDataFrame([(f" {w.upper()} ",) for w in (*STOP, "", STOP[0])], "value string").write.text(path)
    words = spread(_table(spark, sf_dir, "documents").select("text")).select(F.explode(text.without(text.tokens(F.col("text")), readers.stopwords(spark, path))).alias("term"))
    return tfidf.without_listed(words, readers.stopword_table(spark, path)).groupBy("term").agg(F.count("*").alias("n"))


@_query(
    "SELECT 'doc-' || doc_id || '.pdf' AS pdf_url, CAST(page_no AS INTEGER) AS page_no, page AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents) WHERE page <> ''"
)
def pdf_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts of files by a pluggable parser: each line of a document is a page, pages without text are left out."""
    content = F.concat(F.lit("%PDF-1.4\n"), F.translate("text", "\n", "\f")).cast("binary")
    blobs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.concat(F.lit("doc-"), "doc_id", F.lit(".pdf")).alias("path"), content.alias("content"))
    return pdf.pages(blobs, pdf.form_feed_parser)


_STATUS = "CASE WHEN o_orderpriority = '5-LOW' THEN 404 ELSE 200 END"
_KIND = "CASE WHEN o_orderstatus = 'F' THEN 'Application/PDF; x' ELSE 'text/html' END"
_BODY = "CASE WHEN o_orderpriority = '1-URGENT' THEN '%PDF-1.4 ' WHEN o_orderpriority = '2-HIGH' THEN 'FORBIDDEN ' ELSE 'page ' END || o_orderkey"
_ADDRESS = "'http://x.org/d/' || o_orderkey || CASE WHEN o_orderstatus = 'O' THEN '.html' ELSE '.PDF' END"


def _fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bodies of what was fetched, one an order, and requests with titles, one of an address that was not."""
    orders = _table(spark, sf_dir, "orders")
    blobs = orders.select(F.expr(_ADDRESS).alias("path"), F.expr(_STATUS).alias("status"), F.expr(_KIND).alias("content_type"), F.expr(_BODY).cast("binary").alias("content"))
    requests = orders.select(F.expr(_ADDRESS).alias("pdf_url"), F.concat(F.lit("Order: "), "o_orderkey").alias("title"))
    return blobs, requests.union(spark.createDataFrame([("http://x.org/gone.pdf", "gone")], "pdf_url string, title string"))


@_query(
    f"SELECT {_ADDRESS} AS pdf_url, 'Order: ' || o_orderkey AS title, CASE WHEN {_STATUS} = 200 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') THEN 'pdfs/Order_' || o_orderkey || '.pdf' END AS file FROM orders "
    "UNION ALL SELECT 'http://x.org/gone.pdf', 'gone', NULL"
)
def download_triage_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.downloaded_a(*_fetched(spark, sf_dir))


@_query(
    f"SELECT {_ADDRESS} AS pdf_url, 'Order: ' || o_orderkey AS title, CASE WHEN o_orderstatus <> 'O' AND {_STATUS} < 400 AND o_orderpriority <> '2-HIGH' THEN 'pdfs/' || o_orderkey || '.PDF' END AS file FROM orders "
    "UNION ALL SELECT 'http://x.org/gone.pdf', 'gone', NULL"
)
def download_triage_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.downloaded_b(*_fetched(spark, sf_dir))


@_query("SELECT c_name || ' ' || c_mktsegment AS keyword, CAST(0 AS INTEGER) AS page_no, 'https://search.example.org/scholar?q=' || replace(c_name || ' ' || c_mktsegment, ' ', '+') || '&hl=id' AS url FROM customer")
def search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.search_url(_keywords(spark, sf_dir), "https://search.example.org/scholar")


_MARKED = "CASE page_id % 4 WHEN 0 THEN 'utf-16le' WHEN 1 THEN 'utf-16be' ELSE 'utf-8' END"


@_query(f"SELECT page_id, {_MARKED} AS charset, contains(lower(html), 'was') AS was, contains(lower(html), 'für') AS fuer FROM pages WHERE html IS NOT NULL")
def body_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in bodies of four kinds: UTF-16 with a mark, UTF-16 by its content type, UTF-8 by its content type and by its own statement."""
    html, kind = F.col("html"), F.col("page_id") % 4
    body = F.when(kind == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE"))).when(kind == 1, F.encode(html, "UTF-16BE")).when(kind == 2, html.cast("binary")).otherwise(F.concat(F.lit('<meta charset="utf-8">'), html).cast("binary"))
    stated = F.when(kind == 1, "text/html; charset=UTF-16BE").when(kind == 2, "text/html;charset='utf8'").otherwise("text/html")
    bodies = _table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", body.alias("body"), stated.alias("stated"))
    at = {"body": F.col("body"), "content_type": F.col("stated")}
    return bodies.select("page_id", urls.charset(**at).alias("charset"), urls.mentions(word="was", **at).alias("was"), urls.mentions(word="für", **at).alias("fuer"))


@_query(f"SELECT source, count(*) AS n_rows, count(DISTINCT term) AS n_exact, true AS near FROM (SELECT source, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY source")
def distinct_terms_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of each source by sketches of its languages, stored in two batches and merged, beside the exact number: within 2 percent of it."""
    path = _scratch(spark, "sketches")
    documents = spread(_table(spark, sf_dir, "documents").select("source", "lang", "text", "doc_id"))
    words = documents.select("source", "lang", (F.col("doc_id") % 2).alias("half"), F.explode(text.tokens(F.col("text"))).alias("term"))
    for batch in (0, 1):
        sketches.store(sketches.sketched(words.where(F.coalesce(F.col("half"), F.lit(0)) == batch), "term", "source", "lang"), path, batch)
    exact = words.groupBy("source").agg(F.countDistinct("term").alias("n_exact")).withColumnRenamed("source", "_source")
    both = sketches.total(spark, path, "source").join(exact, F.col("source").eqNullSafe(F.col("_source")))
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 0.02 * F.col("n_exact")
    return both.select("source", "n_rows", "n_exact", near.alias("near"))


@_query(
    f"SELECT pdf_url, page_no, text, CAST(NULL AS VARCHAR) AS error FROM ({SQL['pdf_page_texts']}) UNION ALL "
    "SELECT 'doc-' || doc_id || '.pdf', CAST(len(string_split(text, chr(10))) + 1 AS INTEGER), NULL, 'UnicodeDecodeError' FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL"
)
def pdf_page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of files by a lateral join with the parser's table function; every third file ends in a page that can't be read, and a row says so."""
    tail = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("0CFF0C41"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.concat(F.lit("%PDF-1.4\n"), F.translate("text", "\n", "\f")).cast("binary"), tail)
    blobs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.concat(F.lit("doc-"), "doc_id", F.lit(".pdf")).alias("path"), content.alias("content"))
    return pdf.pages_with_errors(blobs, pdf.strict_form_feed_parser)


@_query(f"{_WITH} SELECT id, field, term, round(tf * idf, {PLACES}) AS tfidf FROM postings JOIN stats USING (term) WHERE df_t >= 3 AND term NOT IN {_STOP}")
def tfidf_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF as one SQL query over the session's functions, with bound arguments and a given table."""
    return sqlfunctions.tfidf(_corpus(spark, sf_dir), 3, STOP).withColumn("tfidf", _rounded("tfidf"))


@_query(SQL["search_urls"])
def search_urls_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search addresses by a table function of the session, joined laterally."""
    return sqlfunctions.search(_keywords(spark, sf_dir), "https://search.example.org/scholar", 50)
