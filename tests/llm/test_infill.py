import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumine.llm import infill, units

UNITS = ["character", "word", "line"]


def split(text, unit):
    if unit == "character" or not text:
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    # the first unit begins with the text, the others with a word
    starts = sorted({0, *(m.start() for m in re.finditer(r"(?<=[ \t\n\v\f\r])[^ \t\n\v\f\r]", text))})
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]


def plainly(key, text, unit="character", cut=90, turned=20):
    text = text or ""
    u, digest = split(text, unit), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= cut:
        return n, "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < turned else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(2)
    signs = "ab é\n\t あ😀<P>S M"
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return made + [None, "", "é", "a", "<P>", "x<S>y", "<M", "<", "<P", "P>", "\n\n", " ", "  lead", "< P>", "x" * 70_000 + "é" * 70_000]


@pytest.mark.parametrize("unit", UNITS)
def test_equals_plain_python(rows, unit):
    data = [(i, t, "mine") for i, t in enumerate(texts())] + [(None, "null key", "mine"), (3, "ab é", "mine"), (3, "ab é", "mine")]
    df = rows(data, "doc_id long, text string, form string")
    got = infill.with_infill(df, unit=unit, cut_percent=80, suffix_first_percent=40).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(str((k, *plainly(k, t, unit, 80, 40), t or "")) for k, t, _ in data)
    assert sorted(str((r["doc_id"], *(r[c] for c in infill.OUT), r["back"])) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_odd_tables(rows):
    assert infill.with_infill(rows([], "doc_id long, text string")).count() == 0
    df = infill.with_infill(rows([("k", "abc", 1, "z")], "id string, output string, n int, _own string"), text="output", key="id")
    assert df.columns == ["id", "_own", "n", "form", "prefix_chars", "middle_chars", "output"]
    row = df.first()
    assert row["n"] == 3 and infill.PREFIX in row["output"] and row["_own"] == "z"
    assert rows([("<P>a", "psm")], "o string, f string").select(infill.restored(F.col("o"), F.col("f"))).first()[0] is None


def test_slices_of_arrow_arrays():
    column = pa.array(["xx", "ab", None, "é😀", ""]).slice(1)
    data, offsets = units.utf8_buffers(column)
    assert data.tobytes().decode() == "abé😀" and offsets.tolist() == [0, 2, 2, 8, 8]
    running, before, n = units.counts(units.CHARACTERS.starts(data, offsets), offsets)
    assert n.tolist() == [2, 0, 2, 0]
    assert units.places(running, before, n, offsets, np.array([1, 0, 1, 0])).tolist() == [1, 2, 4, 8]
    assert units.utf8_buffers(pa.nulls(2))[1].tolist() == [0, 0, 0] and units.utf8_buffers(pa.array([], pa.string()))[1].tolist() == [0]


def test_memory_of_long_texts():
    import tracemalloc

    text = pa.array(["é" * 5_000_000])
    zero = [np.array([7], np.int64)] * 4
    tracemalloc.start()
    made = infill.infill_batch(text, zero, units.CHARACTERS)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made[0].to_pylist() == [5_000_000] and most < 12 * 10_000_000


def test_nothing_is_shuffled(spark):
    from vellumine.llm import queries

    plan = queries.op11_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
