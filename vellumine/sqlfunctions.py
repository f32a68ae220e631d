"""The engine's functions under names for SQL, and its longer queries as SQL with bound arguments.

Functions are SQL themselves, so Catalyst inlines them: a query that calls them plans as if it were written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FUNCTIONS = (
    "cleaned(t STRING) RETURNS STRING RETURN trim(regexp_replace(lower(t), '[^a-z]+', ' '))",
    "words_of(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(coalesce(trim(regexp_replace(lower(t), '[^a-z]+', ' ')), ''), ' '), w -> w <> '')",
    # runs of a sorted list: where each begins, and how far the next one or the end is
    "run_starts(w ARRAY<STRING>) RETURNS ARRAY<INT> RETURN filter(sequence(0, greatest(size(w) - 1, 0)), i -> i < size(w) AND (i = 0 OR get(w, i) <> get(w, i - 1)))",
    "run_lengths(w ARRAY<STRING>, starts ARRAY<INT>) RETURNS ARRAY<STRUCT<term: STRING, freq: BIGINT>> RETURN "
    "transform(starts, (s, k) -> named_struct('term', get(w, s), 'freq', CAST(coalesce(get(starts, k + 1), size(w)) - s AS BIGINT)))",
    "citation_count(t STRING) RETURNS INT RETURN coalesce(try_cast(nullif(regexp_extract(t, '[0-9]+', 0), '') AS INT), 0)",
    "search_addresses(keyword STRING, base STRING, most INT) RETURNS TABLE (page_no INT, url STRING) RETURN "
    "SELECT p AS page_no, concat(base, '?q=', replace(keyword, ' ', '+'), '&hl=id&as_sdt=0,5&start=', p * 10) AS url FROM explode(sequence(0, most div 10)) AS t(p) WHERE keyword IS NOT NULL",
)

TFIDF = """
WITH fields AS (SELECT id, f.field, sort_array(words_of(f.text)) AS words FROM {corpus} LATERAL VIEW inline(array(named_struct('field', 'title', 'text', title), named_struct('field', 'abstract', 'text', abstract))) f AS field, text),
runs AS (SELECT id, field, words, run_starts(words) AS starts FROM fields),
counted AS (SELECT id, field, size(words) AS n, run_lengths(words, starts) AS found FROM runs),
postings AS (SELECT id, field, term, freq, freq / n AS tf FROM counted LATERAL VIEW inline(CASE WHEN n > 0 THEN found END) w AS term, freq),
stats AS (SELECT term, count(*) AS df_t FROM postings GROUP BY term)
SELECT id, field, p.term, p.tf * log10((SELECT count(*) FROM {corpus}) / s.df_t) AS tfidf
FROM postings p JOIN stats s ON p.term = s.term WHERE s.df_t >= :least_df AND NOT array_contains(CAST(:stopwords AS ARRAY<STRING>), p.term)
"""

SEARCH = "SELECT k.keyword, a.page_no, a.url FROM {keywords} k, LATERAL search_addresses(k.keyword, :base, :most) a"


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, in place of earlier ones of their names."""
    for text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


def tfidf(corpus: DataFrame, least_df: int = 1, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(id, field, term, tfidf) of (id, title, abstract), by SQL: terms of at least ``least_df`` documents that are no stopwords.

    Stopwords are left out of the result only and still count in a document's length.
    """
    spark = corpus.sparkSession
    register(spark)
    return spark.sql(TFIDF, args={"least_df": least_df, "stopwords": _array(stopwords)}, corpus=corpus)


def search(keywords: DataFrame, base: str, most: int) -> DataFrame:
    """(keyword, page_no, url) of (keyword), by SQL: the paged search addresses of each keyword; null keywords have none."""
    spark = keywords.sparkSession
    register(spark)
    return spark.sql(SEARCH, args={"base": base, "most": most}, keywords=keywords)


def _array(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])
