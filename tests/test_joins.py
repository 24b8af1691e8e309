"""Blocked joins against all pairs, and the corpus operators."""

import random

import pytest

from kindred.operators import corpus as K
from kindred.operators.batch import Batch
from kindred.operators.join import similarity_join

NAMES = ["Erik Larsen", "Eric Larsen", "Erik Larson", "Ana Souza", "LINDQVIST", "LINQDVIST", "Petra Nowak", "Petra Novak", "Louise Meyer", "Luise Meier", "Bo", "", "x"]


def texts(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé日😀 _,") for _ in range(r.randint(0, 14))) for _ in range(n)]
    return base + ["".join(c if r.random() > 0.15 else r.choice("abé ") for c in x) for x in base] + ["", "", base[0]]


@pytest.mark.parametrize("name,t", [("levenshtein", 0.6), ("levenshtein", 0.0), ("jaro_winkler", 0.9), ("jaro_winkler", 0.6), ("hamming", 0.7), ("jaccard_bigram", 0.4), ("jaccard_word", 0.5), ("minhash_default", 0.4), ("simhash_default", 0.85), ("simhash_default", 0.7), ("bm25", 0.3), ("bm25", 0.0), ("tfidf", 0.3), ("tfidf", 0.8), ("hamming", 0.0), ("levenshtein", 0.95)])
def test_blocking_loses_nothing(spark, name, t):
    df = spark.createDataFrame(list(enumerate(texts(30, 5))), "id long, text string")
    want = {(r[0], r[1]): r[2] for r in Batch.of(name).matrix(df, keep="upper").where(f"score > {t}").collect()}
    got = {(r[0], r[1]): r[2] for r in similarity_join(df, name, t).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("name,t", [("levenshtein", 0.5), ("levenshtein", 0.8), ("levenshtein", 0.9), ("bm25", 0.5), ("tfidf", 0.6), ("jaccard_word", 0.6)])
def test_blocking_of_long_texts(spark, name, t):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(25)]
    near = [" ".join(w for w in x.split() if r.random() > 0.1) for x in base] + ["".join(c for c in x if r.random() > 0.06) for x in base]
    df = spark.createDataFrame(list(enumerate(base + near + ["", " ", " \t"])), "id long, text string")
    want = {(r[0], r[1]): r[2] for r in Batch.of(name).matrix(df, keep="upper").where(f"score > {t}").collect()}
    got = {(r[0], r[1]): r[2] for r in similarity_join(df, name, t).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_a_threshold_of_zero_loses_nothing(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a" + 100 * "x"), (2, "ab")], "id long, text string")
    assert {(r[0], r[1]) for r in similarity_join(df, "levenshtein", 0.0).collect()} == {(0, 1), (0, 2), (1, 2)}
    for name in ("levenshtein", "hamming", "jaccard_word", "bm25", "tfidf", "simhash_default", "minhash_default"):
        got = [(r[0], r[1]) for r in similarity_join(df, name, 0.0, strict=False).collect()]
        want = {(0, 1), (0, 2), (1, 2)} if name != "hamming" else set()
        assert sorted(got) == sorted(set(got)) and (set(got) == want or name == "hamming")


def test_names(spark):
    df = spark.createDataFrame(list(enumerate(NAMES)), "id long, text string")
    got = {(NAMES[r[0]], NAMES[r[1]]): round(r[2], 3) for r in similarity_join(df, "jaro_winkler", 0.90).collect()}
    all_ = Batch.of("jaro_winkler").matrix(df, keep="upper").where("score > 0.9").collect()
    assert got == {(NAMES[r[0]], NAMES[r[1]]): round(r[2], 3) for r in all_} and len(got) >= 5
    other = spark.createDataFrame([(7, "Eric Larsen"), (8, None)], "id long, text string")
    assert {(r[0], r[1]) for r in similarity_join(df, "levenshtein", 0.85, other=other).collect()} == {(0, 7), (1, 7)}
    with pytest.raises(ValueError):
        similarity_join(df, "levenshtein", 1.5)


def test_corpus(spark):
    docs = spark.createDataFrame([(0, "the cat sat on the mat"), (1, "the dog sat on the log"), (2, "quick brown fox")], "doc_id long, text string")
    index = K.build(docs)
    assert index.stats.first()[:2] == (3, 5.0)
    q = spark.createDataFrame([(0, "cat mat"), (1, "the sat"), (2, "unknown")], "query_id long, query string")
    got = {(r[0], r[1]): round(r[2], 6) for r in K.bm25_all(index, q).collect()}
    assert len(got) == 9 and got[0, 0] == 1.813298 and got[1, 0] == got[1, 1] == 1.046296 and got[2, 2] == 0.0
    norm = {(r[0], r[1]): r[2] for r in K.normalized(K.bm25_all(index, q)).collect()}
    assert norm[0, 0] == 1.0 and norm[0, 1] == 0.0 and norm[2, 0] == 0.0
    assert round(K.bm25_one(index, "cat mat", 0).first()["score"], 6) == 1.813298
    idf = {r[0]: round(r[1], 6) for r in K.idf(index).collect()}
    assert idf["the"] == 1.287682 and idf["fox"] == 1.693147
    assert [round(r["magnitude"], 6) for r in K.vectors(index).orderBy("doc_id").collect()] == [0.660014, 0.660014, 0.977539]
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "id_a long, id_b long")
    assert {(r[0], r[1]): round(r[2], 6) for r in K.cosine_pairs(index, pairs).collect()} == {(0, 1): 0.634396, (0, 2): 0.0}
    assert [r["doc_id"] for r in K.search(index, q.where("query_id = 1"), 1).collect()] == [0]
    empty = K.build(spark.createDataFrame([(0, None), (1, "")], "doc_id long, text string"))
    assert K.vectors(empty).agg({"magnitude": "sum"}).first()[0] == 0.0 and {r[2] for r in K.cosine_pairs(empty, pairs.where("id_b = 1")).collect()} == {1.0}
