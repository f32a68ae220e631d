"""Stemming on distinct terms (S12, X3): a stemmer is any function from a word to its stem.

``Confix`` strips Indonesian affixes by the rules of the published confix-stripping family: particles and
possessives, then a derivational suffix, then up to three prefixes with recoding, and only as far as a
root dictionary confirms. Without a dictionary every word is its own stem.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut

Stemmer = Callable[[str], str]

# Affixes of Indonesian, and the letters that nasal prefixes replace.
PARTICLES = ("lah", "kah", "tah", "pun")
POSSESSIVES = ("ku", "mu", "nya")
SUFFIXES = ("i", "kan", "an")
PREFIXES = ("di", "ke", "se", "ber", "bel", "be", "ter", "te", "per", "pel", "pe", "me")
RECODED = {"mem": ("", "p"), "men": ("", "t"), "meng": ("", "k"), "meny": ("s",), "pem": ("", "p"), "pen": ("", "t"), "peng": ("", "k"), "peny": ("s",)}
FORBIDDEN = {("be", "i"), ("di", "an"), ("ke", "i"), ("ke", "kan"), ("me", "an"), ("se", "i"), ("se", "kan"), ("te", "an")}


def identity(word: str) -> str:
    return word


class Confix:
    """Confix stripping confirmed by a dictionary of roots."""

    def __init__(self, roots: Iterable[str] = ()):
        self.roots = frozenset(roots)

    def __call__(self, word: str) -> str:
        if len(word) < 4 or word in self.roots:
            return word
        for base in self._without_inflection(word):
            if base in self.roots:
                return base
            for suffix in ("", *SUFFIXES):
                if suffix and not (base.endswith(suffix) and len(base) - len(suffix) > 2):
                    continue
                root = self._without_prefixes(base[: len(base) - len(suffix)] if suffix else base, suffix, 3)
                if root:
                    return root
        return word

    @staticmethod
    def _without_inflection(word: str) -> Iterator[str]:
        yield word
        for endings in (PARTICLES, POSSESSIVES):
            for ending in endings:
                if word.endswith(ending) and len(word) - len(ending) > 2:
                    word = word[: -len(ending)]
                    yield word
                    break

    def _without_prefixes(self, base: str, suffix: str, left: int) -> str | None:
        if base in self.roots:
            return base
        if not left:
            return None
        for prefix, heads in RECODED.items():
            if base.startswith(prefix) and (prefix[:2], suffix) not in FORBIDDEN:
                for head in heads:
                    if (root := self._without_prefixes(head + base[len(prefix) :], suffix, left - 1)) is not None:
                        return root
        for prefix in PREFIXES:
            if base.startswith(prefix) and len(base) - len(prefix) > 2 and (prefix[:2], suffix) not in FORBIDDEN:
                if (root := self._without_prefixes(base[len(prefix) :], suffix, left - 1)) is not None:
                    return root
        return None


def stemmed_terms(terms: DataFrame, stemmer: Stemmer, term: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms; the stemmer runs once for each, in Arrow batches.

    Distinct terms are written first: a join by term then is one of two plain shuffles, which adaptive execution splits where
    a term is frequent.
    """

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(stemmer, na_action="ignore")

    return cut(terms.select(term).distinct()).withColumn("stem", F.pandas_udf(apply, "string")(F.col(term)))


#: Stems that a task remembers; beyond, it begins anew, and terms are stemmed again.
REMEMBERED = 200_000


def stemmed_lists(lists: DataFrame, stemmer: Stemmer) -> DataFrame:
    """``lists`` (columns ``tokens`` and ``stem`` among them) with the tokens of rows marked by ``stem`` replaced by their stems.

    Nothing is shuffled: the stemmer runs in the row's task, once for each distinct term that the task remembers. A term without a stem stays.
    """

    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}

        def stem(word: str) -> str:
            if word not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = stemmer(word)
                known[word] = word if found is None else found
            return known[word]

        for tokens, gate in batches:
            flat, lengths = tokens.flatten(), np.asarray(pc.list_value_length(tokens))
            marked = np.repeat(np.asarray(gate.to_numpy(zero_copy_only=False), bool), lengths)
            coded = flat.filter(pa.array(marked)).dictionary_encode()
            stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], flat.type).take(coded.indices)
            words = pc.replace_with_mask(flat, pa.array(marked), stems)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.ListArray.from_arrays(ends, words)

    return lists.withColumn("tokens", F.arrow_udf(apply, "array<string>")("tokens", "stem"))
