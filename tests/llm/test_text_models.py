import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

from vellumine.llm import langmix, tokens, toxicity

SF = "/root/testdata/sf0.1"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def area(score, label):
    rank = pd.Series(score).rank().to_numpy()
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_toxicity_on_held_out_rows(spark):
    from vellumine.llm.queries import op3_toxicity

    got = op3_toxicity(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert area(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.92
    right = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert right / held["toxic"].sum() > 0.55 and right / held["predicted"].sum() > 0.8
    assert ((got["predicted"] == 1) == (got["score"] >= 0.5)).all() and got["score"].between(0, 1).all()


def test_toxicity_of_planted_words(rows):
    rng = random.Random(1)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rst", "lom", "ter")]
    text = lambda bad: " ".join([rng.choice(plain) for _ in range(80)] + ["zorgblat"] * bad + [rng.choice(plain) for _ in range(80)])
    train = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = rows([(i, t) for i, t, _ in train], "doc_id long, text string")
    labels = rows([(i, y) for i, _, y in train] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert b"zorgbla" in model.toxic
    df = rows([(1, text(1), "s"), (2, text(0), "s"), (3, None, None), (4, "", "s"), (5, "zorgblat", "s"), (6, "x" * 500_000, "s"), (2, text(0), "s")], "doc_id long, text string, score string")
    got = toxicity.with_toxicity(df, model).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 7 and score[1] > 0.5 > score[2] and score[3] == score[4] and all(0 <= s <= 1 for s in score.values())
    long = (" ".join(rng.choice(plain) for _ in range(150_000)) + " " + "zorgblat " * 40).encode()
    (top, levels), (plain_top, _) = (toxicity.savings(t, model.ordinary, model.toxic) for t in (long, long[:-361]))
    assert top[0] > plain_top[0] and levels.sum() == -(-(150_040 - 1) // toxicity.STEP)
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and 1 not in {r["doc_id"] for r in kept.collect()}
    nothing = toxicity.fit(rows([], "doc_id long, text string"), rows([], "doc_id long, toxic int"))
    assert all(0 < r["score"] < 0.5 for r in toxicity.with_toxicity(df, nothing).collect())


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_windows_stand_on_one_grid(size, monkeypatch):
    rng = random.Random(size)
    read = toxicity._words
    monkeypatch.setattr(toxicity, "_words", lambda text: read(text, size))
    for n in (0, 1, 2, 5, 6, 7, 11, 12, 300):
        words = [b"".join(rng.choice([b"a", b"B", b"\xc3\xa9"]) for _ in range(rng.randint(1, 9))) for _ in range(n)]
        text = b" \n".join(words)
        want = [b" ".join(words[i : i + toxicity.WINDOW]).lower() for i in range(0, max(n - 1, 1), toxicity.STEP)] if n else []
        assert [w.removesuffix(toxicity.ANCHOR).strip() for part in toxicity._windows(text, 3) for w in part] == want
        seen = [tuple(x[i - 1 : i + 3]) for x in toxicity._stretches(text) for i in range(1, len(x) - 2)]
        padded = [b"", *(w.lower() for w in words), b"", b""]
        assert seen == [tuple(padded[i - 1 : i + 3]) for i in range(1, n + 1)]
    whole = bytes(rng.randrange(97, 123) for _ in range(3000))
    pieces = [w for found in read(whole) for w in found]
    assert all(any(whole[i : i + toxicity.OVERLAP] in p for p in pieces) for i in range(len(whole) - toxicity.OVERLAP + 1))
    assert max(map(len, pieces)) <= toxicity.LONGEST_WORD


def test_toxicity_of_a_phrase_of_ordinary_words(rows):
    rng = random.Random(4)
    plain = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(3000)] + ["balom", "kurst"]
    words = lambda n: [rng.choice(plain) for _ in range(n)]
    text = lambda bad: " ".join(words(40) + ["balom kurst" if bad else "balom"] * 2 + words(20) + ["kurst"] * 2 + words(40))
    train = [(i, text(i % 2 == 0), int(i % 2 == 0)) for i in range(400)]
    model = toxicity.fit(rows([(i, t) for i, t, _ in train], "doc_id long, text string"), rows([(i, y) for i, _, y in train], "doc_id long, toxic int"))
    assert b"balom kur" in model.toxic
    score = toxicity.scores([text(k % 2).encode() for k in range(40)], model)
    assert sum((s >= 0.5) == k % 2 for k, s in enumerate(score)) > 32


def test_toxicity_learns_from_whole_texts(rows):
    rng = random.Random(2)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rst", "lom", "ter")]
    words = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    text = lambda bad: words(6000) + " zorgblat" * bad + " " + words(80)
    train = [(i, text(i % 2 == 0), int(i % 2 == 0)) for i in range(160)]
    assert min(len(t.split(" zorgblat")[0]) for _, t, y in train if y) > 24 << 10
    model = toxicity.fit(rows([(i, t) for i, t, _ in train], "doc_id long, text string"), rows([(i, y) for i, _, y in train], "doc_id long, toxic int"))
    assert b"zorgbla" in model.toxic
    held = [text(k % 2) for k in range(20)]
    assert [int(s >= 0.5) for s in toxicity.scores([t.encode() for t in held], model)] == [k % 2 for k in range(20)]


def test_languages_on_held_out_rows(spark):
    from vellumine.llm.queries import op8_language_mixtures

    got = op8_language_mixtures(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "lang"]), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.995


def test_language_mixture_of_one_text(spark, rows):
    table = pd.read_parquet(f"{SF}/documents.parquet")
    model = langmix.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    pick = lambda lang: table[(table["lang"] == lang) & table["n_chars"].between(1500, 2500)]["text"].iloc[0]
    both = pick("de")[:1500] + " " + pick("fr")[:1500]
    share = langmix.mixtures([both.encode(), pick("es").encode(), b"", b"12 34"], model)
    names = np.array(model.languages)
    assert set(names[share[0] > 0.2]) == {"de", "fr"} and names[share[1].argmax()] == "es" and share[1].max() > 0.95
    assert share[2].sum() == 0 and abs(share[0].sum() - 1) < 1e-6
    df = rows([(1, None, "q"), (2, "12, 34", "q"), (3, pick("en"), None), (4, "", "q"), (3, pick("en"), None), (5, "é", "q")], "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["languages"]) for r in langmix.with_language(df, model).collect()}
    assert got[1] == got[2] == got[4] == ("und", 0.0, "") and got[3][0] == "en" and got[5][0] in model.languages
    empty = langmix.fit(rows([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langmix.with_language(df, empty).collect()} == {"und"}
    assert langmix.with_language(rows([], "doc_id long, text string"), model).count() == 0


def plain_mixture(text, model):
    """The same inference with plain loops, one window and one language at a time."""
    import math

    raw = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in text)
    bits = len(model.logs).bit_length() - 1
    padded = b" " * 4 + raw + b" " * 4
    starts = [i for i in range(4, len(padded)) if padded[i] != 32 and padded[i - 1] == 32][:: langmix.WINDOW]
    if not starts:
        return [0.0] * len(model.languages)
    logs = []
    for a, b in zip(starts, [*starts[1:], len(padded)], strict=True):
        sums = [0.0] * len(model.languages)
        for i in range(a, b):
            if padded[i] != 32 or padded[i - 1] != 32:
                code = sum(padded[i - k] << (8 * k) for k in range(4))
                row = model.logs[((code * 2654435761) & 0xFFFFFFFF) >> (32 - bits)]
                sums = [s + float(v) for s, v in zip(sums, row, strict=True)]
        logs.append(sums)
    like = [[math.exp(max(v - max(w), -60)) for v in w] for w in logs]

    def em(share):
        for _ in range(langmix.ROUNDS):
            parts = [[x * s for x, s in zip(w, share, strict=True)] for w in like]
            share = [sum(p[k] / sum(p) for p in parts) / len(parts) for k in range(len(share))]
        return share, sum(math.log(sum(x * s for x, s in zip(w, share, strict=True))) for w in like)

    share, best = em(list(model.prior))
    allowed = set(range(len(share)))
    while len(allowed) > 1:
        least = min(sorted(allowed), key=lambda k: share[k])
        rest = [max(s, 1e-9) if k in allowed and k != least else 0.0 for k, s in enumerate(share)]
        fewer, value = em([r / sum(rest) for r in rest])
        if value + 0.5 * math.log(len(like) + 1) + 1 < best:
            break
        share, best = fewer, value
        allowed.discard(least)
    return [s if k in allowed else 0.0 for k, s in enumerate(share)]


def test_mixtures_equal_plain_loops(spark, monkeypatch):
    table = pd.read_parquet(f"{SF}/documents.parquet")
    model = langmix.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    short = [t.encode() for t in table[table["n_chars"] < 400]["text"].head(25)]
    texts = [*short, b"".join(short[:6]), b" ".join(short[3:8]), b"", b"12 -- 34", "\u00e9".encode(), b"x" * 700]
    want = np.array([plain_mixture(t, model) for t in texts])
    assert np.abs(langmix.mixtures(texts, model) - want).max() < 1e-6
    for size, gathered in ((64, 50), (300, 1)):  # long texts in slices, few likelihoods at a time
        monkeypatch.setattr(langmix, "_SCAN_BYTES", size)
        monkeypatch.setattr(langmix, "_GATHERED", gathered)
        assert np.abs(langmix.mixtures(texts, model) - want).max() < 1e-6


def test_language_fit_reads_whole_texts_of_any_number_of_languages(rows, monkeypatch):
    rng = random.Random(5)
    data = [(i, " ".join(f"{chr(97 + i % 7)}{rng.randint(0, 9)}{chr(97 + i % 23)}q" for _ in range(30)), f"l{i % 300}") for i in range(900)]
    narrow = langmix.fit(rows(data, "doc_id long, text string, lang string"))
    assert len(narrow.languages) == 300 and narrow.logs.nbytes <= langmix.MODEL_BYTES
    late = [(1, "common words " * 9000 + "zebra " * 50, "a"), (2, "common words " * 9000, "b")]
    model = langmix.fit(rows(late, "doc_id long, text string, lang string"))
    assert langmix.mixtures([b"zebra zebra zebra zebra zebra zebra"], model)[0].argmax() == 0
    texts, seen = [t.encode() for _, t, _ in late] + ["é ü" .encode() * 900, b"y" * 3000], []
    for size in (1 << 19, 1000):  # slices lose no n-gram and count none twice
        monkeypatch.setattr(langmix, "_SCAN_BYTES", size)
        total = np.zeros((len(texts), 1 << langmix.TABLE_BITS), dtype=np.int64)
        for first, joined, begin in langmix._runs(texts):
            place, counted = langmix._grams(joined)
            for i in range(len(begin) - 1):
                part = slice(begin[i], begin[i + 1])
                total[first + i] += np.bincount(place[part][counted[part]], minlength=total.shape[1])
        seen.append(total)
    assert np.array_equal(*seen)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(rows, name):
    from tokenizers import Tokenizer

    texts = [None, "", " ", "a  b", "</s>[INST] <|endoftext|>", "é" * 50, "日本語 text", "x\ty\nz", "word " * 3000, "q" * 3000, "tail ", " two  spaces  here " * 500]
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t or "")) for t in texts]
    else:
        model = Tokenizer.from_file(path)
        want = [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert tokens.count_batch([None if t is None else t.encode() for t in texts], path, 100).tolist() == want
    df = rows([(i, t, "x") for i, t in enumerate(texts)] + [(3, "a  b", "x")], "doc_id long, text string, n_tokens string")
    got = tokens.with_token_counts(df, path, limit=100).collect()
    assert len(got) == len(texts) + 1
    assert {r["doc_id"]: (r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in got} == {i: (n, len((t or "").encode()), n > 100) for i, (t, n) in enumerate(zip(texts, want, strict=True))}
    assert tokens.with_token_counts(rows([], "text string"), path).count() == 0


def test_ranks_and_vocabulary_agree():
    texts = [b"plain words, 123 and more\n\n  x", "é ü 日本".encode(), b"", None]
    a, b = (tokens.count_batch(texts, public_tokenizers.path(f"byte_bpe_50k.{kind}")).tolist() for kind in ("json", "tiktoken"))
    assert a == b and a[2:] == [0, 0]
    with pytest.raises(ValueError, match="no library"):
        tokens.count_batch([b"x"], "other.bin")


@pytest.mark.parametrize(("name", "cut"), [("piece_bpe_32k.model", tokens.DROP_SPACE), ("byte_bpe_50k.json", tokens.KEEP_SPACE), ("byte_bpe_50k.tiktoken", tokens.KEEP_SPACE)])
def test_cuts_are_safe(name, cut):
    encode, found = tokens._encoder(public_tokenizers.path(name))
    assert found is cut
    rng = random.Random(3)
    texts = [t.encode() for t in rng.sample(list(pd.read_parquet(f"{SF}/documents.parquet")["text"]), 40)]
    texts += [b"</s>[INST] x <|endoftext|> y " * 30, "a b é c 日本 d 1 2  3 4 'll it's we 've".encode() * 20]
    for text in texts:
        parts = tokens.safe_cuts(text, 64, cut)
        assert (b"" if cut else b" ").join(parts) == text and (len(text) < 2000 or len(parts) > 5)
        assert sum(encode(parts)) == encode([text])[0]
    assert tokens.safe_cuts(b"x" * 1000, 10, cut) == [b"x" * 1000]


def test_other_files_are_cut_only_where_words_are_parted():
    for name in ("word_bpe_49k.json",):
        encode, cut = tokens._encoder(public_tokenizers.path(name))
        text = ("Some words, and 12 more; " * 400).encode()
        assert sum(encode([text] if cut is tokens.WHOLE else tokens.safe_cuts(text, 64, cut))) == encode([text])[0]
