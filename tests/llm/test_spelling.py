import random
import zlib
from collections import Counter

import pytest

from vellumine.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], [ord(c) for c in v])) for w, vs in near.items() if vs}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def invented():
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))): rng.choice([1, 2, 5, 30, 400, 9000]) for _ in range(500)}
    words |= {"common" + a + b + c: rng.choice([2, 40, 900]) for a in "abcdefg" for b in "abcdefg" for c in "abcé"}  # all share a segment
    words |= {"aaaaaaa": 50, "aaaaaaaa": 5, "aaaaaaaaa": 600, "zyxwvut": 3, "ÿ": 4, "é" * 3000: 2, "é" * 2999: 30}
    return words


@pytest.mark.parametrize("bucket", [2, 64])
def test_equals_brute_force(rows, bucket):
    words = invented()
    got = spelling.variant_forms(rows(list(words.items()), "word string, n long"), bucket=bucket)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(words)


@pytest.mark.parametrize("bucket", [1, 3])
def test_pairs_are_found_once(rows, bucket):
    words = dict.fromkeys(["", "a", "b", "aa", "ab", "ba", "bb", "aaa", "aab", "aba", "baa", "abb", "aaaa", "abab", "baba"], 1)
    got = [(r["a"], r["b"]) for r in spelling.near_pairs(rows(list(words.items()), "word string, n long"), bucket).collect()]
    want = {tuple(sorted((a, b))) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(want) and {tuple(sorted(p)) for p in got} == want


def test_large_buckets_are_divided(rows):
    # 26 * 26 * 10 words of one length share a segment: candidates stay few
    words = [("abcd" + chr(97 + i) + chr(97 + j) + str(k), 2) for i in range(26) for j in range(26) for k in range(10)]
    df = rows(words, "word string, n long")
    pairs = spelling.near_pairs(df, 64)
    assert pairs.count() == 26 * 26 * 10 * (25 + 25 + 9) // 2


def test_words_of_texts(rows):
    docs = [(1, "Straße ÉCOLE Überall naïveté,über-all x1yz ABCDEFGHIJ"), (2, None), (3, ""), (None, "Null identity"), (1, "Straße"), (4, "12 34 ×÷")]
    df = rows([(k, t, "r") for k, t in docs], "doc_id long, text string, run string")
    runs = sorted(((r["key"], r["run"]) for r in spelling.letter_runs(df).collect()), key=str)
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    import re

    want = sorted(((k, m) for k, t in docs for m in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(low))), key=str)
    assert runs == want
    def spelt(k, w, one_in=3):
        h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
        at = h % len(w)
        return w[:at] + w[at + 1 :] if h % one_in == 0 else w
    got = Counter(r["word"] for r in spelling.misspelt(spelling.letter_runs(df), 3).collect())
    assert got == Counter(spelt(k, w) for k, w in want)
    counted = spelling.vocabulary(spelling.misspelt(spelling.letter_runs(df), 1000), 4, 2)
    assert {tuple(r) for r in counted.collect()} == {("straße", 2)}


def test_empty_tables(rows):
    empty = rows([], "word string, n long")
    assert spelling.variant_forms(empty).count() == 0 and spelling.near_pairs(empty).count() == 0
    assert spelling.letter_runs(rows([], "doc_id long, text string")).count() == 0
