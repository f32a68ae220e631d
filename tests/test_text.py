import math

from pyspark.sql import functions as F

from vellumine import sqlfunctions
from vellumine.functions import text as X
from vellumine.functions.stem import Confix, identity, stemmed_lists, stemmed_terms
from vellumine.operators import tfidf


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_clean_and_tokens(spark):
    assert one(spark, X.clean, "  Sistem-Informasi  2020\tDESA\n") == "sistem informasi desa"
    assert one(spark, X.tokens, "É a1b, ") == ["a", "b"]
    assert one(spark, X.tokens, None) == []
    assert one(spark, X.tokens, "") == []
    assert one(spark, X.strip, " \t x \n") == "x"


def test_gate_sees_text_before_removal(spark):
    stop = ["yang", "dan"]
    kept, gate = X.preprocess(F.col("x"), stop)
    got = spark.createDataFrame([("yang desa",), ("desa",), (None,)], "x string").select(kept.alias("k"), gate.alias("g")).collect()
    assert [(r["k"], r["g"]) for r in got] == [(["desa"], True), (["desa"], False), ([], False)]
    assert one(spark, lambda c: X.without(X.tokens(c), []), "a b") == ["a", "b"]


def corpus(rows):
    return rows([(1, "a b b", "b c"), (2, "a", None), (3, "", "  ")], "id long, title string, abstract string")


def test_postings_and_weights(rows):
    df = corpus(rows)
    got = {(r["id"], r["field"], r["term"]): (r["freq"], r["tf"]) for r in tfidf.postings(df).collect()}
    assert got == {(1, "title", "a"): (1, 1 / 3), (1, "title", "b"): (2, 2 / 3), (1, "abstract", "b"): (1, 0.5), (1, "abstract", "c"): (1, 0.5), (2, "title", "a"): (1, 1.0)}
    weights = {(r["id"], r["field"], r["term"]): r["tfidf"] for r in tfidf.tfidf(df).collect()}
    assert weights.keys() == got.keys()
    assert abs(weights[1, "title", "b"] - 2 / 3 * math.log10(3 / 2)) < 1e-12


def test_idf_may_be_negative(rows):
    df = rows([(1, "a", "a"), (2, "a", "a")], "id long, title string, abstract string")
    got = tfidf.inverse_frequency(df, tfidf.document_frequency(tfidf.postings(df))).first()
    assert got["df_t"] == 4 and abs(got["idf"] - math.log10(2 / 4)) < 1e-12


def test_vocabulary_is_in_code_point_order(rows):
    terms = ["b", "a", "ab", "aa", "ba", "zz", "z"]
    df = rows([(1, " ".join(terms), None)], "id long, title string, abstract string")
    got = {r["term"]: r["term_idx"] for r in tfidf.vocabulary(tfidf.postings(df)).collect()}
    assert got == {t: i for i, t in enumerate(sorted(terms))}


def test_empty_corpus(rows):
    df = rows([], "id long, title string, abstract string")
    assert tfidf.tfidf(df).count() == 0 and tfidf.vocabulary(tfidf.postings(df)).count() == 0


def test_densified_and_maps(rows):
    df = corpus(rows)
    weights = tfidf.tfidf(df)
    terms = ["a", "b", "c", "nowhere", "a"]
    grid = {(r["id"], r["field"], r["term"]): r["tfidf"] for r in tfidf.densified(weights, df.select("id"), terms).collect()}
    held = {(r["id"], r["field"], r["term"]): r["tfidf"] for r in weights.collect()}
    assert grid == {(i, f, t): held.get((i, f, t), 0.0) for i in (1, 2, 3) for f in ("title", "abstract") for t in terms}
    maps = tfidf.frequency_maps(tfidf.postings(df))
    got = {(r["id"], r["field"]): r["b"] for r in maps.select("id", "field", tfidf.looked_up(maps, "b").alias("b")).collect()}
    assert got == {(1, "title"): 2 / 3, (1, "abstract"): 0.5, (2, "title"): 0.0}


def test_stemmer_on_distinct_terms(rows):
    stem = Confix(["desa", "buat", "ajar", "sapu", "tulis", "kirim"])
    assert [stem(w) for w in ("desanya", "pembuatan", "mengajarkan", "menyapu", "menulis", "mengirim", "desalah", "xyzzy", "di")] == ["desa", "buat", "ajar", "sapu", "tulis", "kirim", "desa", "xyzzy", "di"]
    assert identity("x") == "x"
    got = stemmed_terms(rows([("pembuatan",), ("pembuatan",), ("desa",)], "term string"), stem).collect()
    assert {(r["term"], r["stem"]) for r in got} == {("pembuatan", "buat"), ("desa", "desa")}
    df = rows([(1, "pembuatan dan desa", "pembuatan")], "id long, title string, abstract string")
    terms = {(r["field"], r["term"]) for r in tfidf.postings(df, ["dan"], stem).collect()}
    # the abstract has no stopword, so the gate leaves it unstemmed
    assert terms == {("title", "buat"), ("title", "desa"), ("abstract", "pembuatan")}


def test_sums_are_one(rows):
    df = rows([(i, "a b c " * (i + 1), "x y" if i % 2 else None) for i in range(20)], "id long, title string, abstract string")
    for r in tfidf.postings(df).groupBy("id", "field").agg(F.sum("tf").alias("s")).collect():
        assert abs(r["s"] - 1) < 1e-9


def test_stems_are_made_in_the_row_without_a_shuffle(rows):
    lists = rows([(1, ["walked", "in", "walked"], True), (2, ["walked"], False), (3, [], True), (4, ["gone", "x"], True)], "id int, tokens array<string>, stem boolean")
    df = stemmed_lists(lists.coalesce(1), lambda w: None if w == "gone" else w.removesuffix("ed"))
    got = {r["id"]: (r["tokens"], r["stem"]) for r in df.collect()}
    assert got == {1: (["walk", "in", "walk"], True), 2: (["walked"], False), 3: ([], True), 4: (["gone", "x"], True)}


def test_postings_shuffle_nothing(spark, rows):
    corpus = rows([(1, "a a b", None), (2, "walked the b", "c"), (3, None, "")], "id long, title string, abstract string").localCheckpoint()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(tfidf.postings(corpus, ("the",), lambda w: w.removesuffix("ed")))
    # by SQL: one count of documents by term and one join by term
    assert plan(sqlfunctions.tfidf(corpus)).count("hashpartitioning(id") == 0
    found = {(r["id"], r["field"], r["term"], r["freq"]) for r in tfidf.postings(corpus, ("the",), lambda w: w.removesuffix("ed")).collect()}
    assert found == {(1, "title", "a", 2), (1, "title", "b", 1), (2, "title", "walk", 1), (2, "title", "b", 1), (2, "abstract", "c", 1)}
