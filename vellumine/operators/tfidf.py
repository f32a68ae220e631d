"""Term statistics over a two-field corpus, in long form.

A corpus has (id, title, abstract). Its 2N documents are all titles and all abstracts; N is the
number of rows. The inverse document frequency is log10(N / df) with df over the 2N documents, so
a term in most of them has a negative one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.functions.stem import Stemmer, stemmed_lists
from vellumine.session import cut


def corpus_of_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A two-field corpus from whole texts: the first line, and what stands behind it (null without a newline)."""
    return documents.select(F.col(key).alias("id"), X.first_line(F.col(text)).alias("title"), X.after_first_line(F.col(text)).alias("abstract"))


def union_fields(corpus: DataFrame) -> DataFrame:
    """(id, field, text): titles and abstracts as rows of one table, in one scan."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "abstract")])
    return corpus.select("id", F.explode(pairs).alias("p")).select("id", "p.field", "p.text")


def token_lists(corpus: DataFrame, stopwords: Sequence[str] = ()) -> DataFrame:
    """(id, field, tokens, stem): tokens without stopwords, and whether the language gate lets them be stemmed."""
    kept, gate = X.preprocess(F.col("text"), stopwords)
    return union_fields(corpus).select("id", "field", kept.alias("tokens"), gate.alias("stem"))


def both_fields() -> Column:
    """The tokens of title and abstract as one list (F37); a null field has none."""
    return F.concat(X.tokens(F.col("title")), X.tokens(F.col("abstract")))


def words(corpus: DataFrame) -> DataFrame:
    """(id, field, term): every token as a row."""
    return union_fields(corpus).select("id", "field", F.explode(X.tokens(F.col("text"))).alias("term"))


def without_listed(found: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Words that are not in a stopword table, for lists too long for a literal (P6, J6 anti)."""
    return found.join(stopwords.select("term").distinct(), "term", "left_anti").select(*found.columns)


def in_language(found: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(id, field) of texts that hold a word of the table (P13, J6 semi)."""
    return found.join(stopwords.select("term").distinct(), "term", "left_semi").select("id", "field").distinct()


def _runs(ordered: str) -> Column:
    """Places, from 1, at which a new value begins in a sorted array; none in an empty one."""
    n = F.size(ordered)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.filter(places, lambda i: (i <= n) & ((i == 1) | (F.element_at(ordered, i) != F.element_at(ordered, F.greatest(i - 1, F.lit(1))))))


def postings(corpus: DataFrame, stopwords: Sequence[str] = (), stemmer: Stemmer | None = None) -> DataFrame:
    """(id, field, term, freq, tf): term frequencies over token counts.

    A document's tokens all stand in one row, so counting them needs no shuffle. With a
    ``stemmer``, tokens of texts in the language are replaced by their stems first, in the row too.
    """
    lists = _lists(corpus, stopwords, stemmer)
    runs = lists.select("id", "field", F.sort_array("tokens").alias("_sorted")).withColumn("_starts", _runs("_sorted"))
    ends = F.concat(F.slice("_starts", 2, F.greatest(F.size("_starts") - 1, F.lit(1))), F.array(F.size("_sorted") + 1))
    zipped = F.arrays_zip(F.col("_starts").alias("s"), ends.alias("e"))
    terms = F.transform(zipped, lambda p: F.struct(F.element_at("_sorted", p["s"]).alias("term"), (p["e"] - p["s"]).cast("long").alias("freq")))
    # no filter on empty lists: it would be pushed down and tokenise twice; exploding null gives no row
    terms = F.when(F.size("_sorted") > 0, terms)
    out = runs.select("id", "field", F.size("_sorted").alias("_n"), F.explode(terms).alias("t"))
    return out.select("id", "field", "t.term", "t.freq", (F.col("t.freq") / F.col("_n")).alias("tf"))


def document_terms(corpus: DataFrame, stopwords: Sequence[str] = (), stemmer: Stemmer | None = None) -> DataFrame:
    """(id, field, term): each document's distinct terms, without their frequencies."""
    return _lists(corpus, stopwords, stemmer).select("id", "field", F.explode(F.array_distinct("tokens")).alias("term"))


def _lists(corpus: DataFrame, stopwords: Sequence[str], stemmer: Stemmer | None) -> DataFrame:
    lists = token_lists(corpus, stopwords)
    return lists if stemmer is None else stemmed_lists(lists, stemmer)


def document_frequency(posted: DataFrame) -> DataFrame:
    """(term, df_t): documents, of the 2N, that hold the term (A5); postings, like document terms, are distinct by document."""
    return posted.groupBy("term").agg(F.count("*").alias("df_t"))


def vocabulary(posted: DataFrame) -> DataFrame:
    """(term, term_idx): distinct terms numbered in code-point order from 0.

    Ranges of terms are numbered by themselves and moved by what stands before them, so no task sorts all.
    """
    terms = posted.select("term").distinct().withColumn("_head", F.substring("term", 1, 2))
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = terms.groupBy("_head").agg(F.count("*").alias("_n")).select("_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = terms.withColumn("_row", F.row_number().over(Window.partitionBy("_head").orderBy("term")) - 1)
    return own.join(F.broadcast(offsets), "_head").select("term", (F.col("_first") + F.col("_row")).cast("long").alias("term_idx"))


def inverse_frequency(corpus: DataFrame, frequency: DataFrame) -> DataFrame:
    """(term, df_t, idf): log10(N / df), N the rows of the corpus (J5, F30). Never clamped."""
    n = corpus.agg(F.count("*").alias("_n"))
    return frequency.crossJoin(F.broadcast(n)).select("term", "df_t", F.log10(F.col("_n") / F.col("df_t")).alias("idf"))


def tfidf(corpus: DataFrame, stopwords: Sequence[str] = (), stemmer: Stemmer | None = None) -> DataFrame:
    """(id, field, term, tfidf) of every posting."""
    posted = postings(corpus, stopwords, stemmer)
    # Every term has its statistics. A left join may broadcast those, never the postings. They are written, so that the join is one of
    # two plain shuffles, of which adaptive execution splits a frequent term's postings.
    stats = cut(inverse_frequency(corpus, document_frequency(document_terms(corpus, stopwords, stemmer))))
    return posted.join(stats, "term", "left").select("id", "field", "term", (F.col("tf") * F.col("idf")).alias("tfidf"))


def densified(weights: DataFrame, ids: DataFrame, terms: Sequence[str], value: str = "tfidf") -> DataFrame:
    """Every (id, field, term) of some documents and the given terms, absent ones 0.

    Each document has a cell for each term, so the terms are a list that the caller holds, not a vocabulary.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("term")) for f in ("title", "abstract") for t in dict.fromkeys(terms)])
    grid = ids.select("id").distinct().select("id", F.explode(cells).alias("c")).select("id", "c.field", "c.term")
    weights = weights.where(F.col("term").isin(list(terms)))
    return grid.join(weights, ["id", "field", "term"], "left").select("id", "field", "term", F.coalesce(value, F.lit(0.0)).alias(value))


def frequency_maps(posted: DataFrame) -> DataFrame:
    """(id, field, tf map): a map of term to frequency per document (F40). Terms are distinct, so keys are."""
    return posted.groupBy("id", "field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "tf")))).alias("tf"))


def looked_up(maps: DataFrame, term: str) -> Column:
    """The frequency of a term, 0 if absent."""
    return F.coalesce(F.col("tf")[term], F.lit(0.0))
