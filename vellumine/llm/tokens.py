"""Token counts of whole texts, by public tokenizer files.

Method: batches in Arrow functions that return lengths only. Texts are dealt into encoder calls
by bytes, and a long text is cut where the tokenizer can't join across the cut.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.arrow import by_bytes, bounded_batches, utf8

#: Bytes of text in one call of the encoder; a text over it is cut.
CALL_BYTES = 256 << 10


_CUT = re.compile(rb"[0-9A-Za-z] (?=[0-9A-Za-z])")


def safe_cuts(text: bytes, every: int, keep: bool = False) -> list[bytes]:
    """Parts of ``text`` of about ``every`` bytes, cut at single spaces between ASCII letters or digits.

    The space itself goes, for an encoder that puts a word mark before each part, or stays at the head of the next
    part (``keep``). A text without such a place stays whole.
    """
    parts, begin, search = [], 0, 0
    while len(text) - begin > every:
        found = _CUT.search(text, max(begin + every, search))
        if found is None:
            break
        at = found.start() + 1
        parts.append(text[begin:at])
        begin = at + (not keep)
        search = at + 1
    parts.append(text[begin:])
    return parts


#: Whether and how an encoder's long texts may be cut.
WHOLE, DROP_SPACE, KEEP_SPACE = None, False, True
_PROBES = [("a", "b"), ("Word", "word"), ("x9", "7 up"), ("the end", "Of it. 3,5"), ("z", "q  double\n\tlines")]


def _joins(encode: Callable[[str], list], space: str) -> bool:
    """Whether pieces of two parts are those of the whole for texts of all kinds that are cut."""
    return all(encode(f"{a} {b}") == encode(a) + encode(space + b) for a, b in _PROBES)


def _by_words(spec: dict) -> bool:
    """Whether a tokenizer file splits texts into words before merging, by rules that part a word from a space behind it."""
    step = spec.get("pre_tokenizer") or {}
    kinds = [x.get("type") for x in step.get("pretokenizers", [step])]
    whole = all(" " not in t["content"] for t in spec.get("added_tokens") or [])
    return whole and spec.get("normalizer") is None and kinds[:1] in (["ByteLevel"], ["Whitespace"], ["WhitespaceSplit"], ["BertPreTokenizer"]) and step.get("add_prefix_space", False) is False


@functools.cache
def _encoder(path: str) -> tuple[Callable[[list[bytes]], list[int]], bool | None]:
    """A function from texts to token counts, and how long texts may be cut.

    A cut is safe if no merge reaches across it: no piece holds a word mark behind another character, or words are parted
    before merging, and a part gets back what stood before it.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        marked = all("▁" not in p.lstrip("▁") for p in pieces)
        cut = DROP_SPACE if marked and _joins(lambda t: model.encode(t, out_type=str), "") else WHOLE
        return lambda texts: [len(x) for x in model.encode([t.decode() for t in texts], num_threads=1)], cut
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        cut = KEEP_SPACE if _by_words(json.loads(tokenizer.to_str())) and _joins(lambda t: tokenizer.encode(t, add_special_tokens=False).tokens, " ") else WHOLE
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)], cut
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        coding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # the pattern takes a space with the word behind it
        cut = KEEP_SPACE if regex.findall(public_tokenizers.PATTERN, "ab cd 12 ef") == ["ab", " cd", " 12", " ef"] and _joins(coding.encode_ordinary, " ") else WHOLE
        return lambda texts: [len(coding.encode_ordinary(t.decode())) for t in texts], cut
    raise ValueError(f"no library for {path}")


def count_batch(texts: list[bytes | None], path: str, call_bytes: int = CALL_BYTES) -> np.ndarray:
    """Token counts of ``texts`` (null: empty)."""
    encode, cut = _encoder(path)
    owners, parts = [], []
    for i, text in enumerate(texts):
        for part in [text or b""] if cut is WHOLE else safe_cuts(text or b"", call_bytes, cut):
            owners.append(i)
            parts.append(part)
    out = np.zeros(len(texts), dtype=np.int64)
    for first, run in by_bytes(parts, call_bytes):
        np.add.at(out, owners[first : first + len(run)], encode(run))
    return out


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of ``text`` by the tokenizer file at ``path`` (every executor has it there).

    Null and empty texts have none. No begin, end or special tokens are added.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(count_batch(utf8(pa.array(texts, type=pa.string())), path))

    return counted(text)


def with_token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null texts count as empty. Columns of these names are replaced. Map only: nothing is shuffled.
    """
    bounded_batches(df.sparkSession)
    return (
        df.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
        .withColumn("n_tokens", token_count(F.col(text), path))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
