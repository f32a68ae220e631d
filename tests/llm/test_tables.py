import hashlib
import random
import re
import textwrap
import zlib
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vellumine.llm import chat, decontaminate, licences, mixing, shards
from vellumine.llm.ranks import ranked

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


# --- decontamination


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def contaminated(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = item_words(t)
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(None if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = item_words(t), set(), set()
        for size in {len(k) for k in wins}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in wins:
                    hit |= set(range(k, k + size))
                    ids |= wins[g] - {None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.choice([12, 25, 60]))) for i in range(25)] + [(100, "alpha BETA"), (101, None), (102, ""), (103, "solo"), (None, line(15)), (3, line(20)), (104, "a a a a a a a a a a a a")]
    docs = []
    for i in range(120):
        parts = [line(rng.randint(0, 60))]
        if i % 3 == 0:
            parts.append((rng.choice(items)[1] or "").upper().replace(" ", ", "))
        if i % 11 == 0:
            parts.append("a " * 30)
        docs.append((i, "; ".join([*parts, line(5)])))
    return docs + [(500, None), (501, ""), (502, "solo"), (503, "x " * 40_000 + "alpha beta"), (3, docs[3][1]), (3, docs[3][1]), (None, "alpha beta")], items


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_decontamination_equals_brute_force(rows, block):
    docs, items = case()
    df, bench = rows([(d, t, "x") for d, t in docs], "doc_id long, text string, n_hit string"), rows(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contamination(df, bench, block_bytes=block).collect()), key=str)
    want = contaminated(docs, items)
    assert got == want
    clean = decontaminate.clean_documents(df, bench, block_bytes=block)
    assert clean.columns == df.columns
    dirty = {(r[0], r[1]) for r in want if r[5]}
    assert clean.count() == sum(not r[5] for r in want) and not any(r["doc_id"] in {d for d, _ in dirty} for r in clean.collect() if r["doc_id"] is not None)


def test_longest_matches(rows):
    item = " ".join(f"w{i}" for i in range(30))
    docs = rows([(1, "pre x, " + item.upper() + " post"), (2, " ".join(f"w{i}" for i in range(5, 20)) + " other " + " ".join(f"w{i}" for i in range(15, 30)))], "doc_id long, text string")
    got = sorted(map(tuple, decontaminate.longest_matches(docs, rows([(7, item)], "item_id long, text string")).collect()))
    assert [r[:5] for r in got] == [("7", k, 30 - k, 1, 2 + k) for k in range(21)]
    assert got[0][5:] == (7, 7 + len(item))


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_longest_matches_equal_brute_force(rows, block):
    docs, items = case()
    docs = [d for d in docs if d[0] != 503] + [(503, "x " * 400 + "alpha beta")]
    got = sorted(map(tuple, decontaminate.longest_matches(rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string"), block_bytes=block).select("item_id", "item_word", "n_words", "doc_id", "doc_word").collect()), key=str)
    held, want = [(d, item_words(t)) for d, t in docs], []
    for i, t in items:
        w = item_words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            best = None
            for d, v in held:
                for p in range(len(v)):
                    n = 0
                    while k + n < len(w) and p + n < len(v) and w[k + n] == v[p + n]:
                        n += 1
                    if n >= min(len(w), 10) and (best is None or (-n, d is None, d or 0, p) < best):
                        best = (-n, d is None, d or 0, p)
            if best:
                want.append((None if i is None else str(i), k, -best[0], None if best[1] else best[2], best[3]))
    assert got == sorted(want, key=str)


def test_the_driver_holds_one_block_at_a_time(spark, rows, monkeypatch):
    import gc
    import weakref

    docs, items = case()
    docs = docs[:60] + [(3, "again " + (items[4][1] or ""))] * 40
    blocks = list(decontaminate._blocks(rows(items, "item_id long, text string"), "item_id", "text", 700))
    assert len(blocks) >= 8
    held, most, prepare = [], [0], decontaminate.prepare

    def watched(*args):
        gc.collect()
        most[0] = max(most[0], 1 + sum(r() is not None for r in held))
        made = prepare(*args)
        held.append(weakref.ref(made))
        return made

    monkeypatch.setattr(decontaminate, "prepare", watched)
    df, bench = rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contamination(df, bench, block_bytes=700).collect()), key=str)
    assert got == contaminated(docs, items)
    assert len(held) == len(blocks) and most[0] <= 2
    decontaminate.longest_matches(df, bench, block_bytes=700).count()
    assert len(held) == 2 * len(blocks) and most[0] <= 2


def test_least_of_ranges():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 333)
    lo = rng.integers(0, 332, 500)
    hi = np.array([rng.integers(a + 1, 334) for a in lo])
    assert decontaminate._least(values, lo, hi).tolist() == [values[a:b].min() for a, b in zip(lo, hi, strict=True)]
    assert len(decontaminate._least(values, lo[:0], hi[:0])) == 0


def test_longest_matches_of_repeated_text(rows):
    import time

    began = time.perf_counter()
    docs = rows([(i, "a b " * 50_000) for i in range(2)], "doc_id long, text string")
    got = decontaminate.longest_matches(docs, rows([(7, "a b " * 3000)], "item_id long, text string")).collect()
    assert len(got) == 5991 and all(r["doc_id"] == 0 and r["doc_word"] == r["item_word"] % 2 and r["n_words"] == 6000 - r["item_word"] for r in got)
    assert time.perf_counter() - began < 120


def test_parts_of_a_long_document(rows, monkeypatch):
    docs, items = case()
    want = contaminated(docs, items)
    for size in (1, 9, 10, 64):
        monkeypatch.setattr(decontaminate, "PART_WORDS", size)
        of = decontaminate.prepare([None if i is None else str(i) for i, _ in items], [None if t is None else t.encode() for _, t in items])
        found, place, which = decontaminate._searched([(t or "").encode()[:6000] for _, t in docs], of, 10)
        covered = decontaminate._covered(len(found.hashes), place, of.sizes[which])
        total = [0, *covered.cumsum()]
        hits = [total[b] - total[a] for a, b in zip(found.offsets, found.offsets[1:], strict=False)]
        short = contaminated([(d, (t or "")[:6000]) for d, t in docs], items)
        assert sorted(hits) == sorted(r[2] for r in short)
    assert want


def test_words_whose_hashes_meet(monkeypatch):
    items = decontaminate.prepare(["1"], [b"a b c d e f g h i j"])
    good = decontaminate.words
    def clash(texts, kinds):  # z has the hash of a
        found, one = good(texts, kinds), good([b"a z"], kinds).hashes
        found.hashes[found.hashes == one[1]] = one[0]
        return found
    monkeypatch.setattr(decontaminate, "words", clash)
    _, place, _ = decontaminate._searched([b"z b c d e f g h i j", b"a b c d e f g h i j"], items, 10)
    assert place.tolist() == [10]
    with pytest.raises(ValueError, match="share a hash"):
        decontaminate.prepare(["1"], [b"a z"])


def test_no_documents_or_items(rows):
    docs, items = rows([(1, "a b")], "doc_id long, text string"), rows([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).first()["n_items"] == 0
    assert decontaminate.contamination(rows([], "doc_id long, text string"), rows([(1, "a")], "item_id long, text string")).count() == 0
    assert decontaminate.clean_documents(docs, items).count() == 1 and decontaminate.longest_matches(docs, items).count() == 0


# --- chat

EVENTS = "conv_id long, msg long, seq long, kind string, role string, text string"


def test_events_fold(rows):
    log = [
        (1, 0, 1, "start", "user", None), (1, 0, 2, "delta", None, "Hel"), (1, 0, 3, "delta", None, "lo"),
        (1, 1, 4, "start", "assistant", None), (1, 1, 5, "delta", None, "bad"),
        (1, 2, 6, "start", "user", None), (1, 2, 7, "delta", None, "taken back"),
        (1, 1, 8, "regenerate", None, None), (1, 1, 9, "delta", None, "go"), (1, 1, 10, "delta", None, "od"),
        (1, 3, 11, "start", "user", None), (1, 3, 12, "delta", None, "x"), (1, 3, 13, "edit", None, "y<|im_end|>\n~1"), (1, 3, 14, "delta", None, "z"),
        (None, 0, 1, "delta", "tool\n[", "orphan"), (2, 0, 1, "unknown", "user", "no"), (3, 0, 1, "start", None, None),
    ]
    folded = chat.fold_events(rows(log, EVENTS))
    got = sorted(map(tuple, folded.collect()), key=str)
    assert got == sorted([(1, 0, "user", "Hello"), (1, 1, "assistant", "good"), (1, 3, "user", "y<|im_end|>\n~1z"), (None, 0, "tool\n[", "orphan"), (3, 0, "", "")], key=str)
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(folded)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", "Hello"), ("assistant", "good"), ("user", "y<|im_end|>\n~1z")]
    assert back[1]["loss_texts"] == ["good"] and [(t["role"], t["text"]) for t in back[None]["turns"]] == [("tool\n[", "orphan")]
    assert back[1]["formatted"].count("<|im_end|>") == 3 and "[" not in back[None]["formatted"]
    assert chat.render(chat.fold_events(rows([], EVENTS))).count() == 0


def test_rows_come_back(rows):
    rng = random.Random(6)
    alphabet = ["<", "[", "~", "0", "1", "2", "3", "\n", "|", "é", "😀", " ", "a"]
    table = [(c, t, rng.choice(["user", "assistant", "system", None]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 700])))) for c in range(8) for t in range(rng.randint(1, 6))]
    table += [(9, 0, "user", None), (9, 1, "assistant", None), (9, 1, "assistant", "tie"), (10, 0, "user", "twice"), (10, 0, "user", "twice"), (11, None, "assistant", "no turn")]
    df = rows([(*r, "x") for r in table], "conv_id long, turn long, role string, text string, seq string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold_events(chat.events_of_rows(df)))).collect()}
    for c in {r[0] for r in table}:
        want = sorted([(r[1], r[2] or "", r[3] or "") for r in table if r[0] == c], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = [(t["role"], t["text"]) for t in got[c]["turns"]]
        assert sorted(turns) == sorted((r, t) for _, r, t in want) and [t[0] for t in turns] == [r for _, r, _ in want]
        assert got[c]["loss_texts"] == [t for r, t in turns if r == "assistant"]


# --- licences


def test_license_digests(spark, rows):
    mit = licences.KNOWN["MIT"][0]
    varied = "Copyright (c) 2020 Some One\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,")
    df = rows([(1, varied, "x"), (2, mit + " more", "x"), (3, None, "x"), (4, "", "x"), (5, "(c) 1999 x", "x"), (6, "licensed under the  APACHE licence version 2.0", "x"), (6, "Licensed under the Apache License, Version 2.0.", "x")], "doc_id long, text string, license string")
    got = sorted((r["doc_id"], r["license"]) for r in licences.with_license(df, licences.known_digests(spark)).collect())
    assert got == [(1, "MIT"), (2, None), (3, None), (4, None), (5, None), (6, "Apache-2.0"), (6, "Apache-2.0")] or [g[1] for g in got] == ["MIT", None, None, None, None, "Apache-2.0", "Apache-2.0"]


def test_adjacent_repeats_of_a_spelling(rows):
    df = rows([(1, "licence licence LICENCE text"), (2, "license license license text"), (3, "sub licence sub-license"), (4, "sublicense sublicence")], "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in df.select("doc_id", licences.canonical(F.col("text")).alias("f")).collect()}
    assert got[1] == got[2] == "license  license  license  text" and got[3] == got[4] == "sublicense  sublicense"


def varied(text):
    """Another case, other spellings, copyright lines and wrapping; paragraphs that hold a copyright line keep their lines."""
    out = []
    for k, part in enumerate(re.split(r"\n\s*\n", text)):
        if not re.search(r"copyright|\(c\)|all rights reserved", part, re.IGNORECASE):
            part = textwrap.fill(" ".join(part.split()), 55 + 7 * (k % 4))
        out.append(part.upper() if k % 2 else part)
    return "Copyright (c) 2019, 2021 Some One <one@example.org>\n(c) 2022 Another\nAll rights reserved.\n\n" + "\n\n".join(out).replace("license", "licence").replace(" and ", ", and ")


def test_whole_licences_in_other_spellings(spark, rows):
    known = [(name, text) for name, texts in licences.KNOWN.items() for text in texts]
    folder = Path("/usr/share/common-licenses")
    shipped = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl", "GFDL-1.3": "GFDL-1.3-only"}
    known += [(name, (folder / f).read_text()) for f, name in shipped.items() if (folder / f).is_file()]
    df = rows([(i, varied(text)) for i, (_, text) in enumerate(known)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licences.with_license(df, licences.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(known))] == [name for name, _ in known]
    assert {name for name, _ in licences.whole_digests()} >= set(shipped.values())


def test_scan_of_rows(spark, rows):
    mit, isc = "Released under the MIT License.", "SPDX-License-Identifier: ISC"
    data = [(1, f"a\n{mit}\n\n{isc}\n{mit}", "x"), (1, "a\nb", "x"), (None, mit, "x"), (None, None, None), (2, "", "x"), (3, licences.KNOWN["ISC"][0], "y"), (4, f"{mit} more\n {mit.upper()} ", "z")]
    got = licences.scanned(rows(data, "doc_id long, text string, digest string"), licences.known_digests(spark)).collect()
    assert sorted(map(str, ((r["doc_id"], r["document_license"], r["n_license_lines"], r["line_licenses"], r["digest"] is None) for r in got))) == sorted(
        map(str, [(1, None, 3, "ISC,MIT", False), (1, None, 0, "", False), (None, "MIT", 1, "MIT", False), (None, None, 0, "", True), (2, None, 0, "", False), (3, "ISC", 0, "", False), (4, None, 1, "MIT", False)])
    )
    assert licences.scanned(rows([], "doc_id long, text string"), licences.known_digests(spark)).count() == 0


# --- ranks, shards and mixing


def test_ranks(rows):
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), rng.getrandbits(63) if rng.random() < 0.5 else 77, i, rng.randint(1, 9)) for i in range(900)]
    got = ranked(rows(data, "g string, k long, id long, v long"), "g", "k", "id", "v").collect()
    assert len(got) == len(data)
    for g in ("a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        total = 0
        for r in own:
            assert r["before"] == total
            total += r["v"]


def test_long_chats_are_folded_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    def seconds(n):
        text = F.repeat(F.lit("añ😀~<[ \n"), n)
        table = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), text.alias("text"), F.lit("x").alias("parts"))
        began = time.perf_counter()
        back = chat.read_back(chat.render(chat.fold_events(chat.events_of_rows(table)))).select(F.sha2(F.element_at("turns", 1)["text"].cast("binary"), 256), F.size("loss_texts")).first()
        assert back[0] == hashlib.sha256(("añ😀~<[ \n" * n).encode()).hexdigest() and back[1] == 1
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(2_000_000) < 60  # 24 MB; a walk from the start for each piece would take more than an hour


def test_odd_weights(rows):
    df = rows([(1, "a", "s"), (2, "b", "t")], "doc_id long, text string, source string")
    for w in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mix(df, {"s": w, "t": 1.0})
    assert {r["source"]: r["in_mix"] for r in mixing.mix(df, {"s": -1.0, "t": 1.0}).collect()} == {"s": False, "t": True}


def smallest(weights, shards):
    fits = lambda c: sum(1 for _ in packed(weights, c)) <= shards
    lo, hi = max(weights), sum(weights)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def packed(weights, capacity):
    held = 0
    for w in weights:
        if held + w > capacity:
            yield held
            held = 0
        held += w
    yield held


@pytest.mark.parametrize(("n", "k"), [(700, 7), (30, 40), (5000, 40), (1, 3)])
def test_shards_are_minimax(rows, n, k):
    rng = random.Random(n)
    texts = ["hot" * 500] * (n // 3) + ["t" * rng.randint(0, 300) + str(rng.randint(0, n)) for _ in range(n - n // 3)] + [None, ""]
    df = rows([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, _range string, shard int")
    got = shards.with_shards(df, k).collect()
    assert len(got) == len(texts)
    total, of = [0] * k, {}
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and r["_range"] == "x"
        assert of.setdefault(t, r["shard"]) == r["shard"]
        total[r["shard"]] += r["size"]
    for s in range(k):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    groups = df.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("w")).orderBy("h").collect()
    assert max(total) == smallest([r["w"] for r in groups], k)


def test_shards_zoom_into_narrow_ranges(spark):
    # keys that differ in their last bits only: ranges have to be divided to the end
    keys = [5 + (i << 1) for i in range(300)] + [-(1 << 62) + i for i in range(300)]
    weights = [1 + i % 13 for i in range(600)]
    starts, capacity = shards.cuts(spark.createDataFrame(list(zip(keys, weights, strict=True)), "key long, weight long"), 11)
    ordered = [w for _, w in sorted(zip(keys, weights, strict=True))]
    assert capacity == smallest(ordered, 11)
    sums = [0] * 11
    for k, w in zip(keys, weights, strict=True):
        sums[sum(s <= k for s in starts)] += w
    assert max(sums) == capacity
    assert shards.with_shards(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def ideal_shares(blocks, weights):
    """What each source should have after every slot, slot by slot, by following the sources that have blocks left."""
    got, left = [Fraction(0)] * len(blocks), {i for i, n in enumerate(blocks) if n and weights[i] > 0}
    while left:
        room = Fraction(1)
        while room and left:
            total = sum(Fraction(weights[i]) for i in left)
            step = min(room, min((blocks[i] - got[i]) * total / Fraction(weights[i]) for i in left))
            for i in left:
                got[i] += step * Fraction(weights[i]) / total
            left = {i for i in left if got[i] < blocks[i]}
            room -= step
        yield list(got)


def check_schedule(blocks, weights):
    plan = list(mixing.schedule(blocks, weights))
    assert [p[2] for p in plan] == list(range(sum(blocks)))
    assert sorted(p[:2] for p in plan) == [(i, k) for i, n in enumerate(blocks) for k in range(n)]
    done = [0] * len(blocks)
    for (i, k, _, inside), want in zip(plan, ideal_shares(blocks, weights), strict=False):
        assert k == done[i] and inside
        done[i] += 1
        assert all(abs(d - w) < 1 for d, w in zip(done, want, strict=True))
    assert not any(p[3] for p in plan if weights[p[0]] <= 0) and all(p[3] for p in plan if weights[p[0]] > 0)


def test_pfair_deviation_is_below_one_block_at_every_slot():
    rng = random.Random(9)
    for n in (1, 2, 7, 12):
        check_schedule([rng.randint(0, 40) for _ in range(n)] + [3, 0], [rng.choice([rng.random(), 1.0, 2.0**-30, 0.1]) for _ in range(n)] + [0.0, 1.0])
    check_schedule([300] + [1] * 40, [1.0] + [1e-9] * 40)
    check_schedule([60] * 3 + [5] * 20, [0.3] * 3 + [0.005] * 20)


def test_pfair_of_one_large_and_very_many_tiny_weights():
    # the large source is never a whole block behind its share before the others' first blocks are due
    plan = list(mixing.schedule([5000] + [1] * 2000, [1.0] + [1e-9] * 2000))
    at = [p[2] for p in plan if p[0] == 0]
    total = 1 + Fraction(1e-9) * 2000
    assert all(abs(k + 1 - Fraction(s + 1) / total) < 1 for k, s in enumerate(at)) and at[-1] < 5001


def test_schedule_is_earliest_deadline_first():
    # every choice repeated by a plain loop over all blocks whose release and deadline come from the ideal's own definition
    blocks, weights = [9, 14, 3, 1], [0.5, 0.3, 0.15, 0.05]
    marks = [[0] * (n + 1) for n in blocks]
    shares = [[Fraction(0)] * len(blocks), *ideal_shares(blocks, weights)]
    for i, n in enumerate(blocks):
        for k in range(n + 1):
            marks[i][k] = (max(t for t in range(len(shares)) if shares[t][i] <= k and (t == 0 or shares[t][i] < k or shares[t - 1][i] < k)), min(t for t in range(len(shares)) if shares[t][i] >= k))
    done = [0] * len(blocks)
    for i, _, slot, _ in mixing.schedule(blocks, weights):
        ready = [(marks[j][done[j] + 1][1], j) for j in range(len(blocks)) if done[j] < blocks[j] and (done[j] == 0 or marks[j][done[j]][0] <= slot)]
        assert min(ready) == (marks[i][done[i] + 1][1], i)
        done[i] += 1


def test_mix_of_a_table(rows):
    rng = random.Random(10)
    data = [(i, "big" if i < 300 else rng.choice(["a", "b", "c", None]), "t" * rng.randint(0, 60)) for i in range(900)]
    data += [(900, "a", None), (901, None, "x" * 9000), (None, "b", "null key"), (5, "big", "again"), (902, "unwanted", "t" * 40)]
    df = rows([(*r, "y") for r in data], "doc_id long, source string, text string, _slot string")
    wanted = {"big": 0.1, "a": 0.3, "b": 0.3, "c": 0.2, None: 0.1}
    got = mixing.mix(df, wanted, block_bytes=256).collect()
    assert len(got) == len(data)
    slots = {}
    for r in got:
        assert slots.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
        assert r["in_mix"] == (r["source"] != "unwanted")
    # blocks are the source's rows in some order, 256 bytes each, and slots those of the schedule
    names = ["n", "s:a", "s:b", "s:big", "s:c", "s:unwanted"]
    size = {n: sum(r["size"] for r in got if (f"s:{r['source']}" if r["source"] else "n") == n) for n in names}
    plan = {(names[i], k): t for i, k, t, _ in mixing.schedule([-(-size[n] // 256) for n in names], [0.1, 0.3, 0.3, 0.1, 0.2, 0])}
    for r in got:
        assert plan[(f"s:{r['source']}" if r["source"] else "n", r["block"])] == r["slot"]
    ended = mixing.mixed(df, wanted, block_bytes=256, lost=0.05)
    rows_out = ended.collect()
    assert ended.columns == df.columns and 0 < len(rows_out) < len(data)
    held = {s: sum(len(r["text"] or "") + 16 for r in rows_out if r["source"] == s) for s in wanted}
    total = sum(held.values())
    for s, w in wanted.items():
        if s is not None:  # one row of null's is longer than many blocks
            assert abs(held[s] / total - w) < 0.08
    assert mixing.mix(rows([], "doc_id long, source string, text string")).count() == 0
    assert mixing.mixed(rows([], "doc_id long, source string, text string")).count() == 0


def test_null_and_repeated_keys_stay_in_their_source(rows):
    data = [(None, "in", "a")] + [(None, "out", f"b{i}") for i in range(50)] + [(1, "in", "c"), (1, "out", "c"), (1, "in", "c")]
    df = rows(data, "doc_id long, source string, text string")
    got = mixing.mixed(df, {"in": 1.0, "out": 0.0}).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "in", "a"), (1, "in", "c"), (1, "in", "c")], key=str)


@pytest.mark.parametrize("broadcast", [0, 1 << 18])
def test_default_mix_keeps_every_row(rows, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", broadcast)
    monkeypatch.setattr(mixing, "BROADCAST_TO_ROWS", broadcast)
    data = [(i, "hot" if i % 3 == 0 else f"s{i % 20}", "t" * 40) for i in range(900)] + [(None, None, None), (5, "s5", "again")]
    df = rows(data, "doc_id long, source string, text string")
    assert all(r["in_mix"] for r in mixing.mix(df, block_bytes=256).collect())
    assert sorted(map(str, mixing.mixed(df, block_bytes=256).collect())) == sorted(map(str, df.collect()))


def test_mix_of_very_many_sources(rows):
    n = 12_000
    data = [(i, f"web{i}", "t" * (i % 50)) for i in range(n)] + [(n + i, "hot", "h" * 400) for i in range(1000)]
    got = mixing.mix(rows(data, "doc_id long, source string, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(data))) and all(r["in_mix"] for r in got)
    slots = {}
    for r in got:
        assert slots.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])


def test_memory_of_a_large_benchmark_and_a_long_text():
    import subprocess
    import sys

    code = """
import random, resource
from vellumine.llm import decontaminate as D
rss = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
r = random.Random(1)
words = [bytes(r.choices(b"abcdefgh", k=r.randint(1, 9))) for _ in range(30000)]
text = b" ".join(r.choices(words, k=300000))
items, held = [], 0
while held < 16 << 20:
    at = r.randrange(len(text) - 400)
    items.append((str(len(items)), text[at : at + 400] + b" z%d" % len(items)))
    held += 405
before = rss()
of = D.prepare([a for a, _ in items], [b for _, b in items])
D._searched([text], of, 10)
large = rss() - before
D._searched([b"word " * 400_000], D.prepare(["1"], [b"word " * 12]), 10)
print(large, rss() - before)
"""
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=decontaminate.__file__.rsplit("/vellumine/", 1)[0], check=True)
    large, both = map(int, made.stdout.split())
    assert large < 1000 and both < 1000
