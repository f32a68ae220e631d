import random
import re

import pytest

from vellumine.llm import nearcopy
from vellumine.llm.components import components

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string"


def brute(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df, size, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nearcopy.near_duplicates(df, size, percent).collect()}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(rows, size, percent):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, n = [], 0
    for _ in range(12):  # chains of copies, each with a few words changed, around the threshold
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 40, 150]))]
        for _ in range(25):
            own = list(rng.choice([base, own]) if n % 3 else base) if texts else list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append((n, " ".join(own).upper() if n % 7 == 0 else "\n".join(own)))
            n += 1
    texts += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE "), (n + 5, "one two"), (n + 6, "x y z w v u " * 20_000)]
    assert result(rows(texts, DOCS), size, percent) == brute(texts, size, percent)


@pytest.mark.parametrize("block", [7, 40])
def test_blocks_of_a_large_bucket(rows, monkeypatch, block):
    monkeypatch.setattr(nearcopy, "BLOCK_ROWS", block)  # many parts and pairs of blocks
    monkeypatch.setattr(nearcopy, "RARE_SAMPLE", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"x{rng.random()}"
        texts.append((i, " ".join(own)))
    assert result(rows(texts, DOCS), 3, 85) == brute(texts, 3, 85)


def test_fills_of_a_template_cost_one_set_each(rows, monkeypatch):
    monkeypatch.setattr(nearcopy, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearcopy, "RARE_SAMPLE", 4)
    template, shipped, pairs = [f"w{i}" for i in range(120)], [], []
    for m in (250, 500):
        rng = random.Random(m)
        texts = [(i, " ".join(template + [f"x{rng.random()}" for _ in range(28)])) for i in range(m)]
        count = [0, 0]
        monkeypatch.setattr(nearcopy, "_by_prefix", spied(count, 0, nearcopy._by_prefix))
        monkeypatch.setattr(nearcopy, "_compared", spied(count, 1, nearcopy._compared))
        got = result(rows(texts, DOCS), 3, 85)
        monkeypatch.undo()
        monkeypatch.setattr(nearcopy, "BLOCK_ROWS", 16)
        monkeypatch.setattr(nearcopy, "RARE_SAMPLE", 4)
        assert got == brute(texts, 3, 85) and all(kept for _, _, kept in got.values())
        shipped.append(count[0])
        pairs.append(count[1])
    # twice the fills: twice the sets that travel, with none for pairs of blocks
    assert shipped[0] > 200 and shipped[1] < 2.5 * shipped[0] and pairs[1] < 2.5 * pairs[0]


def spied(count, k, real):
    """``real``, with the rows of its first argument counted."""

    def call(rows, *more):
        count[k] += rows.count()
        return real(rows, *more)

    return call


def test_edges_of_the_table(rows):
    assert nearcopy.near_duplicates(rows([], DOCS)).count() == 0
    df = rows([(1, "a b c d e f", "en", 1), (1, "a b c d e f", "en", 1), (2, "a b c d e f", None, 2), (None, "a b c d e f", "x", 3), (None, None, "x", 3), (3, "other words stand here now", "y", 4), (4, None, None, None)], "doc_id long, text string, rep string, band long")
    got = sorted(map(tuple, nearcopy.near_duplicates(df, 5, 80).collect()), key=str)
    assert [r for r in got if r[0] in (1, 2)] == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert [r for r in got if r[0] is None] == [(None, 0, None, True), (None, 2, None, True)]
    kept = nearcopy.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 3, 4]
    assert nearcopy.deduplicated(rows([], DOCS)).count() == 0


def test_components(rows):
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    mixed = [(2000 + rng.randrange(200), 2000 + rng.randrange(200)) for _ in range(150)]
    edges = path + star + mixed + [(7, 7), (None, 3), (5, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(rows(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(rows([], "a long, b long")).count() == 0


def test_components_in_few_tasks(spark, rows):
    """Few edges in many partitions: the driver is asked for few tasks, and no star is made twice."""
    edges = [(i, i // 7) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(5)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("few-tasks", "components")
    try:
        got = {r["id"]: r["component"] for r in components(rows(edges, "a long, b long")).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, value in held.items():
            spark.conf.set(k, value)
    assert got == {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1006)}
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert tasks < 3500, tasks  # 5,196 where stars were made again and read in all partitions, 2,720 now
