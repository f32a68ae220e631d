import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import words as words_module
from vellumine.llm.words import ALNUM, NOT_SPACE, shingles, words

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
RULES = [(NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def check(texts):
    for table, pattern in RULES:
        found = words([t.encode() for t in texts], table)
        want = [re.findall(pattern, t.translate(LOWER)) for t in texts]
        assert found.counts().tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        meaning: dict[int, str] = {}
        for h, w in zip(found.hashes.tolist(), flat, strict=True):
            assert meaning.setdefault(h, w) == w
        assert len(set(flat)) == len(meaning)
        for size in (1, 3, 5):
            hashes, offsets = shingles(found, size)
            for i, ws in enumerate(want):
                grams = [tuple(ws[k : k + size]) for k in range(max(len(ws) - size + 1, 1))] if ws else []
                own = hashes[offsets[i] : offsets[i + 1]].tolist()
                assert len(own) == len(grams)
                assert len(set(own)) == len(set(grams))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbZ \t\n\x0b\x85\xa0é0-_\x00", max_size=30), max_size=5))
def test_words_equal_patterns(texts):
    check(texts)


def test_long_and_empty_texts():
    check([])
    check(["", " ", "x" * 100_000, "a b " * 50_000])
    same = words([b"one two", b"", b"ONE  two"], NOT_SPACE)
    assert same.hashes[:2].tolist() == same.hashes[2:].tolist()


def test_no_collisions_among_many_words():
    rng = random.Random(1)
    made = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(200_000)}
    assert len(np.unique(words([" ".join(made).encode()], NOT_SPACE).hashes)) == len(made)


CORES = {
    "nearcopy": "s, o = m.shingle_sets([text], 3); m.signature_bands(s, o, 70, 5)",
    "toxicity": "m.savings(text, text[:16000], b' badword ' * 50)",
    "langmix": "m.mixtures([text], m.LanguageModel(tuple('abcd'), np.random.rand(1 << 17, 4).astype(np.float32), np.ones(4) / 4))",
    "tokens": "import public_tokenizers; m.count_batch([text], public_tokenizers.path('piece_bpe_32k.model'))",
    "tiff": "p = text[: 576 * 20000]; m.payload_digest(m.read_pages(m.write_payload(p)))",
}


@pytest.mark.parametrize("module", CORES)
def test_memory_of_a_long_text(module):
    code = f"""
import resource, numpy as np
from vellumine.llm import {module} as m
rss = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
text = np.random.default_rng(1).choice(np.frombuffer(b"abcdefghij      ", np.uint8), 12 << 20).tobytes()
before = rss()
{CORES[module]}
print(rss() - before)
"""
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(words_module.__file__).parents[2], check=True)
    assert int(made.stdout) < 600
