import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vellumine.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def loaded(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def library(text, end=2, path=PATH):
    return loaded(path).encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def odd_texts():
    rng = random.Random(8)
    signs = ["word", "Word,", "don't", "it's", "I'LL", "x1y22", "é", "é", "≠", "a,́", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "　", "\x1c", "😀", "日本語", "Σας", "ΣΑΣ", "...", "'s", "' s", "\t", "\n\n", "ab'", "'re.", "½", "٣"]
    made = ["".join(rng.choice(signs) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return made + [None, "", " ", "a", "<|startoftext|>x", "x" * 3000, "word " * 9000]


def test_ids_are_the_library_s():
    texts = odd_texts()
    for kind in (pa.string(), pa.large_string()):
        ids, limits = packing.token_ids(pa.array(texts, kind), PATH, 2)
        assert [ids[a:b].tolist() for a, b in zip(limits, limits[1:], strict=False)] == [library(t) for t in texts]
    ids, limits = packing.token_ids(pa.array(texts), PATH)
    assert [ids[a:b].tolist() for a, b in zip(limits, limits[1:], strict=False)] == [library(t, None) for t in texts]


def test_ids_of_files_that_read_across_words():
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), odd_texts()[:40] + [None, ""]
    assert packing._library(path)[1] is None and packing._library(PATH)[1] is not None
    ids, limits = packing.token_ids(pa.array(texts), path, 7)
    assert [ids[a:b].tolist() for a, b in zip(limits, limits[1:], strict=False)] == [library(t, 7, path) for t in texts]


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 5)
    monkeypatch.setattr(packing, "_kept", {})
    texts = pa.array(["a b c d e f g", "a b c h i", "z" * 99])
    for _ in range(2):
        ids, limits = packing.token_ids(texts, PATH, 2)
        assert [ids[a:b].tolist() for a, b in zip(limits, limits[1:], strict=False)] == [library(t) for t in texts.to_pylist()]
        assert all(len(w) <= packing.KEPT_CHARS for g in packing._kept[PATH] for w in g) and sum(map(len, packing._kept[PATH])) < 24


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 4096])
def test_pieces_of_lengths(capacity):
    lengths = np.array([0, 1, 2, 3, 63, 64, 65, 4095, 4096, 4097, 9000, *random.Random(1).sample(range(20_000), 60)])
    doc, start, length, kind = packing.pieces_of(lengths, capacity)
    assert (length == capacity // kind).all() and (np.bincount(doc, weights=length, minlength=len(lengths)) == lengths).all()
    for i, n in enumerate(lengths):
        at = 0
        for s, k in zip(start[doc == i], length[doc == i], strict=True):
            assert s == at
            left = n - at
            assert k == max(capacity // c for c in range(1, capacity + 1) if capacity // c <= left)  # the longest that fits
            at += k
        assert at == n


def held(pieces, docs, capacity, path=PATH, end=2):
    """Every id in one piece, places without gaps, right digests. Gives the lengths of sequences."""
    want = defaultdict(list)
    for k, t in docs:
        ids = library(t, end, path)
        if ids:
            want[k].append(ids)
    of, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(of) == set(want)
    for k, found in of.items():
        if len(want[k]) == 1:
            at, ids = 0, want[k][0]
            for r in sorted(found, key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(ids)
        else:
            assert sum(r["length"] for r in found) == sum(map(len, want[k]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return [sum(n for _, n in p) for p in sequences.values()]


@pytest.mark.parametrize("capacity", [1, 8, 64, 4096])
def test_every_id_is_packed_once(rows, capacity):
    texts = odd_texts()
    docs = [*enumerate(texts), (None, "null key here"), (3, "again"), (3, "again")]
    df = rows([(k, t, "s") for k, t in docs], "doc_id long, text string, length string")
    got = packing.packed(df, PATH, end=2, capacity=capacity)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sizes = held(got.collect(), docs, capacity)
    padding = sum(capacity - n for n in sizes if n & (n - 1))
    assert padding <= capacity + 0.02 * sum(sizes)


def test_little_padding(rows):
    rng = random.Random(3)
    docs = [(i, "ab " * rng.choice([3, 40, 300, 700, 2500, 6000])) for i in range(400)]
    sizes = held(packing.packed(rows(docs, "doc_id long, text string"), PATH, end=2).collect(), docs, 4096)
    assert sum(4096 - n for n in sizes if n & (n - 1)) <= 4096 + 0.005 * sum(sizes)


def test_sequences(rows):
    docs = [(i, "one two three " * i) for i in range(50)]
    pieces = packing.packed(rows(docs, "doc_id long, text string"), PATH, end=2, capacity=64, with_ids=True)
    made = packing.sequences(pieces, 64, pad=9).collect()
    got = sorted(x for r in made for x in r["ids"][: r["n_ids"]])
    assert got == sorted(x for _, t in docs for x in library(t))
    for r in made:
        n = r["n_ids"]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else 64) and all(x == 9 for x in r["ids"][n:]) and r["limits"][0] == 0


def test_empty_tables(rows):
    assert packing.packed(rows([], "doc_id long, text string"), PATH, end=2).count() == 0
    assert packing.packed(rows([(1, None), (2, "")], "doc_id long, text string"), PATH).count() == 0
    assert [tuple(r)[:5] for r in packing.packed(rows([(1, None)], "doc_id long, text string"), PATH, end=2).collect()] == [(1, 0, 1, zlib.crc32(b"\2\0\0\0"), 1)]


def test_first_fit():
    rng = random.Random(0)
    lengths = [rng.choice([1, 2, 3, 17, 40, 64, 100]) for _ in range(500)]
    placed = packing.first_fit(lengths, 100)
    taken = defaultdict(list)
    for (b, o), n in zip(placed, lengths, strict=True):
        taken[b].append((o, n))
    for places in taken.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 100
    assert len(taken) <= sum(lengths) / 100 * 1.3 + 1
