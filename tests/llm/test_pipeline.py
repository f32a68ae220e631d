import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellumine.llm import mixing, queries, shards, toxicity
from vellumine.session import materialized

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return made


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    made = duck.execute(queries.SQL[name])
    columns = [d[0] for d in made.description]
    assert sorted(columns) == names
    assert got == sorted(str(tuple(r[columns.index(c)] for c in names)) for r in made.fetchall())


def test_every_query_has_a_row_for_each_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in queries.QUERIES.items():
        if name not in ("op5_event_chat", "op12_spelling_variants", "op13_harmonic_packing", "pipeline"):
            assert query(spark, SF).count() == n, name


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialized(stage(spark, docs, SF), f"stage-{k}")
        counts.append(docs.count())
        assert counts[-1] <= counts[-2] and (docs.columns == columns or k == 4), name
    assert {"shard", "slot", "doc_id", "text"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, SF).count() == counts[-1] == counts[3] == counts[4] > 0.6 * counts[0]


def test_mixing_keeps_every_clean_document(spark):
    docs, ids = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialized(stage(spark, docs, SF), f"kept-{k}")
        ids.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    assert ids[2] == ids[3] == ids[4]


@pytest.mark.parametrize("name", ["op5_event_chat", "op6_license_digests", "op9_minimax_shards"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


def test_no_pairs_are_crossed(spark):
    for name, query in queries.QUERIES.items():
        if name != "pipeline":
            plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(rows, folder, docs, labels, items):
    rows(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    rows(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_on_odd_rows(spark, rows, tmp_path):
    words = lambda k, n: " ".join(f"w{(k * 7919 + i * i) % 997}" for i in range(n))
    docs = [(i, words(i, 60), "en", f"s{i % 3}", 1) for i in range(60)]
    docs += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n", "en", "s1", 2), (None, words(500, 40), "en", "s2", 5), (None, None, None, None, None)]
    docs += [(0, words(0, 60), "en", "s0", 1)] * 2 + [(103, words(0, 60), "en", "s1", 1), (104, "x " * 200_000, "en", "s2", 9), (105, "one", "en", "s2", 3)]
    docs += [(106, "pre " + words(900, 12) + " post", "en", "s0", 4)]
    labels = [(i, 1, 0) for i in range(50)] + [(None, None, None), (3, None, None)]
    folder = tables(rows, tmp_path, docs, labels, [(1, words(900, 12)), (None, None), (2, "")])
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = materialized(stage(spark, frame, folder), f"odd-{k}")
        ids = [r["doc_id"] for r in frame.select("doc_id").collect()]
        if name == "near duplicates":
            assert ids.count(0) == 1 and 103 not in ids and {100, 101, 102, 104, 105, 106} <= set(ids) and ids.count(None) == 2
        if name == "decontamination":
            assert 106 not in ids and {100, 104} <= set(ids)
    assert frame.count() > 30
    again = rows([(1, "a b c d e", "en", "s", 1, "x", 2)], DOCS + ", rep string, shard int")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, again, folder).columns == again.columns, name


def test_stages_on_empty_tables(spark, rows, tmp_path):
    folder = tables(rows, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    for name, query in queries.QUERIES.items():
        if name != "op5_event_chat":
            assert query(spark, folder).count() == 0, name


def plain_score(text, model):
    """One text's score, window by window."""
    import math

    import zstandard

    words = []
    for w in text.encode().lower().split():
        words += [w] if len(w) <= 256 else [w[i : i + 256] for i in range(0, len(w) - 32, 224)]
    plain, marked = toxicity._compressors(model.ordinary, model.toxic)
    assert isinstance(plain, zstandard.ZstdCompressor)
    windows = [b" " + b" ".join(words[i : i + 6]) + b" " + toxicity.ANCHOR for i in range(0, max(len(words) - 1, 1), 5)] if words else []
    saved = [max(len(plain.compress(w)) - len(marked.compress(w)), 0) for w in windows]
    top = sorted(saved, reverse=True)[:3] + [0] * 3
    clear = [min(s, toxicity.LEVELS - 1) for s in saved if s >= model.clear]
    x = [*top[:3], math.log1p(len(clear)), math.log1p(sum(s - model.clear + 1 for s in clear)), math.log1p(len(saved))]
    z = sum(w * (v - m) / s for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=True)) + model.bias
    return 1 / (1 + math.exp(-z))


def follows_weights(mixed, before):
    """In the order of the files every source is within two blocks and a row of what its weight gives it, until one runs dry."""
    rows = [(r["source"], len((r["text"] or "").encode()) + 16) for r in mixed.collect()]
    total: dict = {}
    for s, n in rows:
        total[s] = total.get(s, 0) + n
    assert total == {r["source"]: r["n"] for r in before.groupBy("source").agg(F.sum(F.octet_length("text") + 16).alias("n")).collect()}
    weights = {s: n**mixing.TEMPER for s, n in total.items()}
    blocks = {s: -(-n // mixing.BLOCK_BYTES) for s, n in total.items()}
    slots = min(blocks[s] * sum(weights.values()) / weights[s] for s in blocks)  # the first source is dry then
    room = 2 * mixing.BLOCK_BYTES + max(n for _, n in rows)
    done, passed = dict.fromkeys(total, 0), 0
    for s, n in rows:
        done[s] += n
        passed += n
        if passed > slots * mixing.BLOCK_BYTES - len(total) * room:
            break
        assert done[s] <= weights[s] / sum(weights.values()) * (passed + len(total) * room) + room


def test_stages_equal_brute_force(spark):
    from test_nearcopy import brute
    from test_tables import contaminated, smallest

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs, made = read("documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialized(stage(spark, docs, SF), f"brute-{k}")
        made.append(docs)
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    model = toxicity.fit(read("documents"), read("labels"))
    raw = texts(read("documents"))
    assert ids(made[0]) == sorted(i for i, t in raw if plain_score(t, model) < corpus_pipeline.TOXIC)
    assert ids(made[1]) == sorted(i for i, (_, _, kept) in brute(texts(made[0]), 5, 80).items() if kept)
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    assert ids(made[2]) == sorted(r[0] for r in contaminated(texts(made[1]), items) if not r[5])
    assert ids(made[3]) == ids(made[2])
    follows_weights(made[3], made[2])
    rows_out = made[4].collect()
    assert ids(made[4]) == ids(made[3])
    total: dict[int, int] = {}
    for r in rows_out:
        total[r["shard"]] = total.get(r["shard"], 0) + len(r["text"].encode()) + 16
    # ranges of the mix: groups by their first row, slots in the order of the mix
    mix = [(r["doc_id"], r["text"], r["source"]) for r in in_file_order(made[3])]
    sizes: dict = {}
    for _, t, _ in mix:
        sizes[t] = sizes.get(t, 0) + len(t.encode()) + 16
    assert max(total.values()) == smallest(list(sizes.values()), corpus_pipeline.SHARDS)
    shard = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows_out}
    assert sorted(shard[i] for i, _, _ in mix) == [shard[i] for i, _, _ in mix]
    assert {s for s, _ in shard.values()} == set(range(corpus_pipeline.SHARDS))
    # each of the first shards has the sources of the mix; without the mix they are elsewhere
    weights = {r["source"]: r["n"] ** mixing.TEMPER for r in made[2].groupBy("source").agg(F.sum(F.octet_length("text") + 16).alias("n")).collect()}
    sources = {i: s for i, _, s in mix}
    for k in range(3):
        own = [r for r in rows_out if r["shard"] == k]
        for s, w in weights.items():
            got = sum(len(r["text"].encode()) + 16 for r in own if sources[r["doc_id"]] == s)
            biggest = max(len(t.encode()) + 16 for _, t, x in mix if x == s)
            assert abs(got - w / sum(weights.values()) * total[k]) <= 2 * (mixing.BLOCK_BYTES + biggest) * len(weights)
    unmixed = corpus_pipeline.STAGES[4][1](spark, made[2], SF)
    assert sum(shard[r["doc_id"]] != (r["shard"], r["slot"]) for r in unmixed.collect()) > len(shard) / 2


def in_file_order(df):
    """Rows of a Parquet table as its files, by name, hold them."""
    import pyarrow.parquet as pq

    for path in sorted(df.inputFiles()):
        yield from pq.read_table(path.removeprefix("file://")).to_pylist()


def test_positions(spark, rows, tmp_path):
    from vellumine.llm import order

    sorted_rows = spark.range(5000).repartitionByRange(7, "id").sortWithinPartitions(F.desc("id")).select("id", F.lit(1).alias("_file"), F.lit(2).alias("_row"))
    sorted_rows.write.parquet(str(tmp_path / "t"))
    got = order.with_position(spark.read.parquet(str(tmp_path / "t"))).orderBy("_position").collect()
    assert [r["id"] for r in got] == [r["id"] for r in in_file_order(spark.read.parquet(str(tmp_path / "t")))]
    assert got[0].asDict().keys() == {"id", "_file", "_row", "_position"} and got[-1]["_position"] < 1 << order.BITS
    plain = order.with_position(rows([(i,) for i in range(50)], "id long")).collect()
    assert len({r["_position"] for r in plain}) == 50
    assert order.with_position(rows([], "id long")).count() == 0


def test_shards_along_positions(rows):
    from test_tables import smallest

    texts = ["x" * (7 * i % 50) for i in range(200)] + [None, "", "same", "same", "same"] * 9
    data = [(i, t, i * 1000, "s") for i, t in enumerate(texts)]
    got = shards.with_shards(rows(data, "doc_id long, text string, at long, slot string"), 8, position="at").collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "size", "text_crc32", "shard", "slot"}
    groups: dict = {}
    for _, t, at, _ in data:
        g = groups.setdefault(t or "", [at, 0])
        g[1] += len(t or "") + 16
    total = [0] * 8
    for r in got:
        total[r["shard"]] += r["size"]
    assert max(total) == smallest([w for _, w in sorted(groups.values())], 8) and sum(total) == sum(w for _, w in groups.values())
    assert len({(r["text"] or "", r["shard"]) for r in got}) == len(groups)
    for k in range(8):
        own = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == k)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    with pytest.raises(ValueError):
        shards.with_shards(rows(data, "doc_id long, text string, at long, slot string"), 0)
