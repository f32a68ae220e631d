"""Text cleansing and tokens as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without Unicode white space at either end (F4); ``trim`` takes off spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Lower case, everything but a-z and white space a separator, single spaces, no ends (F1-F4). Null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z]+", " "))


def tokens(text: Column) -> Column:
    """Tokens of the cleansed text; a null text has none, as an empty one has."""
    return F.coalesce(F.filter(F.split(clean(text), " "), lambda t: t != ""), F.array().cast("array<string>"))


def without(found: Column, stopwords: Sequence[str]) -> Column:
    """Tokens that are no stopwords (P6), for a list short enough to be a literal."""
    return F.filter(found, lambda t: ~t.isin(list(stopwords))) if stopwords else found


def gate(found: Column, stopwords: Sequence[str]) -> Column:
    """Whether any raw token is a stopword of the language (P13). Nulls and empty lists: false."""
    if not stopwords:
        return F.lit(False)
    return F.coalesce(F.exists(found, lambda t: t.isin(list(stopwords))), F.lit(False))


def stopword_count(found: Column, stopwords: Sequence[str]) -> Column:
    """Number of tokens that are stopwords (A4)."""
    return F.size(F.filter(found, lambda t: t.isin(list(stopwords)))) if stopwords else F.lit(0)


def preprocess(text: Column, stopwords: Sequence[str]) -> tuple[Column, Column]:
    """Tokens without stopwords, and whether their text is in the language, so that they are to be stemmed.

    The gate sees the text before stopwords go.
    """
    # one filter for both, by a set; no token is empty
    kept = F.filter(F.split(clean(text), " "), lambda t: ~t.isin([*stopwords, ""]))
    return F.coalesce(kept, F.array().cast("array<string>")), gate(tokens(text), stopwords)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    """What stands behind the first newline; null without a newline."""
    return F.when(F.locate("\n", text) > 0, F.substr(text, F.locate("\n", text) + 1))
