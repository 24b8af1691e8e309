"""Work that must not outgrow the input: candidates, memory and shuffles of single operators."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from kindred.operators import corpus as K
from kindred.operators import join as J
from kindred.plans import algorithms as A
from kindred.runtime import Workspace, ship


def test_one_shared_rare_word_is_no_candidate(spark):
    r = random.Random(3)
    rows = [(i, [f"own{i}_{j}" for j in range(20)] + [f"rare{k}" for k in (i % 7, 7 + i % 5)] + [f"often{r.randrange(40)}x{j}" for j in range(30)]) for i in range(60)]
    rows += [(100, rows[0][1][:-3] + ["p", "q", "s"])]
    values = spark.createDataFrame(rows, "t long, p array<string>")
    sets = J._shared(values.select("t", F.col("p").alias("items")), Workspace(spark, "test"))
    found = J._prefixes(sets, lambda n: F.ceil(0.8 * n), lambda x, y: F.least(x, y) >= 0.8 * F.greatest(x, y))
    assert [tuple(x) for x in found.collect()] == [(0, 100)]


def test_hamming_candidates_are_not_all_that_share_a_start(spark):
    values = spark.createDataFrame([(i, f"Supplier#{i:09d}") for i in range(300)], "t long, p string")
    found, _ = J._candidates(values, A.HAMMING, 0.92, True, Workspace(spark, "test"))
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if sum(x != y for x, y in zip(f"{i:09d}", f"{j:09d}")) == 1}
    assert {tuple(sorted(x)) for x in found.collect()} == want


def test_near_fingerprints_of_one_band_are_dealt_out(spark):
    r = random.Random(4)
    base = [r.getrandbits(20) << 40 for _ in range(6)]
    f = sorted({(b ^ sum(1 << r.randrange(40) for _ in range(r.randint(0, 3)))) for b in base for _ in range(150)})
    found = J._near(spark.createDataFrame([(x,) for x in f], "f long"), 60 / 64, True)
    want = {(a, b) for i, a in enumerate(f) for b in f[i + 1 :] if (a ^ b).bit_count() < 4}
    rows = [(x[0], x[1]) for x in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def ranked(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randint(0, 30)))) for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i} w{i} w{2 * i} w{3 * i + 1}") for i in range(8)] + [(8, "none"), (9, "")], "query_id long, query string")
    return K.build(docs), queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_made_where_the_documents_are(spark):
    index, queries = ranked(spark)
    found = K.bm25_all(index, queries)
    assert "Exchange" not in plan(found) and found.count() == 2000
    got, want = ({(x[0], x[1]): x[2] for x in df.collect()} for df in (K.bm25(index, queries), K._joined(index, queries, "query_id", "query")))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_no_task_holds_all_scores_of_a_query(spark):
    index, queries = ranked(spark)
    scores = K.bm25(index, queries).persist()
    assert "Window" not in plan(K.normalized(scores))
    best = {}
    for x in scores.collect():
        best[x["query_id"]] = max(best.get(x["query_id"], 0), x["score"])
    assert all(abs(x["score"] - y["score"] / best[x["query_id"]]) < 1e-12 for x, y in zip(K.normalized(scores).orderBy("query_id", "doc_id").collect(), scores.orderBy("query_id", "doc_id").collect()))


def test_zeros_are_not_shuffled(spark):
    index, queries = ranked(spark)
    found = K.normalized(K.bm25_all(index, queries))
    assert "SortMergeJoin" not in plan(found) and "Window" not in plan(found)
    assert found.count() == 2000 and found.where("score = 1").select("query_id").distinct().count() == 8 and found.where("query_id > 7 and score <> 0").isEmpty()


def test_search_ranks_few_rows(spark):
    index, queries = ranked(spark)
    all_ = K._joined(index, queries, "query_id", "query").collect()
    want = {(q, i + 1, x["doc_id"]) for q in range(10) for i, x in enumerate(sorted((x for x in all_ if x["query_id"] == q), key=lambda x: (-round(x["score"], 9), x["doc_id"]))[:3])}
    assert {(x["query_id"], x["rank"], x["doc_id"]) for x in K.search(index, queries, 3).collect()} == want
    assert K._ranked(index, queries, "query_id", "query", best=3).count() < len(all_) / 2


def test_cosines_with_few_frequent_terms(spark, monkeypatch):
    index, _ = ranked(spark)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(199)], "id_a long, id_b long")
    whole = {x[0]: x[2] for x in K.cosine_pairs(index, pairs).collect()}
    unit = {}
    w = {(x["doc_id"], x["term"]): x["w"] for x in K.tfidf_weights(index).collect()}
    for (d, _t), x in w.items():
        unit[d] = unit.get(d, 0) + x * x
    for i in range(199):
        dot = sum(x * w.get((i + 1, t), 0) for (d, t), x in w.items() if d == i)
        norm = (unit.get(i, 0) * unit.get(i + 1, 0)) ** 0.5
        assert abs(whole[i] - (dot / norm if norm else float(i not in unit and i + 1 not in unit))) < 1e-9
    monkeypatch.setattr(K, "FREQUENT", 5)
    assert all(abs(x[2] - whole[x[0]]) < 1e-9 for x in K.cosine_pairs(index, pairs).collect())


def test_vectors_of_frequent_and_other_terms(spark, monkeypatch):
    index, _ = ranked(spark)
    whole = {x["doc_id"]: x for x in K.vectors(index).collect()}
    assert "collect_list" not in plan(K.vectors(index)) and len(whole) == 200
    monkeypatch.setattr(K, "FREQUENT", 5)
    for x in K.vectors(index).collect():
        y = whole[x["doc_id"]]
        assert x["weights"].keys() == y["weights"].keys() and abs(x["magnitude"] - y["magnitude"]) < 1e-12


def test_python_workers_get_small_batches(spark):
    ship(spark)
    seen = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("s")).mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array([x.nbytes])], ["n"]) for x in b), "n long")
    assert max(x["n"] for x in seen.collect()) < 10_000_000


def test_arrow_udfs_get_small_batches(spark):
    ship(spark)
    size = F.arrow_udf(lambda s: pa.array([s.nbytes] * len(s)), "long")
    assert spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("s")).select(size("s").alias("n")).agg(F.max("n")).first()[0] < 10_000_000


def test_jaro_counts_characters(spark):
    from kindred.functions.text import jaro_winkler_similarity

    pair = spark.createDataFrame([("la ciónadogaas coci que cici.", "rata asos el osta ción.")], "a string, b string")
    assert round(pair.select(jaro_winkler_similarity("a", "b")).first()[0], 6) == 0.644959


def test_best_scores_are_found_where_the_documents_are(spark, monkeypatch):
    index, queries = ranked(spark)
    for every, scores in ((True, K.bm25_all), (False, K.bm25)):
        found = K.bm25_normalized(index, queries, every=every)
        assert "Exchange" not in plan(found) and "Join" not in plan(found)
        got, want = ({(x[0], x[1]): x[2] for x in df.collect()} for df in (found, K.normalized(scores(index, queries))))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    monkeypatch.setattr(K, "SENT", 1)
    assert {(x[0], x[1]): round(x[2], 9) for x in K.bm25_normalized(index, queries).collect()} == {k: round(v, 9) for k, v in want.items()}


def test_tokens_of_an_index_are_those_of_the_expression(spark):
    from kindred.functions.text import tokens

    odd = ["ΑΣ.ΒΣ ΣΑΣ", "İI ı K\u0085ẞ", "a-b_c!", "", " ", None, "　x\x1fy\x00z", "Ǆ ÀB'c", "~!@", "one  two\tTHREE\r\n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd * 3)], "doc_id long, text string")
    got, want = (sorted((x["doc_id"], x["len"], sorted(zip(x["terms"], x["tfs"]))) for x in K.build(df, tokenized=done).rows.collect()) for df, done in ((docs, False), (docs.select("doc_id", tokens("text").alias("text")), True)))
    assert got == want
    index = K.build(docs)
    assert "Generate" not in plan(index.terms)
    assert {tuple(x) for x in index.terms.collect()} == {tuple(x) for x in index.postings.groupBy("term").agg(F.count(F.lit(1))).collect()}


def test_counts_and_magnitudes_leave_the_terms_where_they_are(spark, monkeypatch):
    index, _ = ranked(spark)
    monkeypatch.setattr(K, "FREQUENT", 5)
    found = K.vectors(index)
    asked = found.select("doc_id", "n_terms", "magnitude")
    assert "collect_list" in plan(found) and "collect_list" not in plan(asked) and "TakeOrdered" not in plan(asked)
    whole = {x["doc_id"]: x for x in found.collect()}
    got = asked.collect()
    assert len(got) == 200 and all(x["n_terms"] == len(whole[x["doc_id"]]["weights"]) and abs(x["magnitude"] - whole[x["doc_id"]]["magnitude"]) < 1e-12 for x in got)
    monkeypatch.setattr(K, "FREQUENT", 0)
    assert {x["doc_id"]: (x["n_terms"], round(x["magnitude"], 9)) for x in K.vectors(index).collect()} == {x["doc_id"]: (x["n_terms"], round(x["magnitude"], 9)) for x in got}


def test_words_of_a_block_are_not_all_split_at_once(monkeypatch):
    from kindred.llm import textarrow

    texts = pa.array([f"  Ab{i % 50} c{i % 7}\tAB{i % 50} " * (i % 4) for i in range(3000)], pa.large_string())
    monkeypatch.setattr(textarrow, "PIECE", 1 << 40)
    per, codes, words = textarrow.word_codes(texts)
    before = pa.default_memory_pool().bytes_allocated()
    monkeypatch.setattr(textarrow, "PIECE", 1000)
    most, split = [], textarrow.pc.ascii_split_whitespace
    monkeypatch.setattr(textarrow.pc, "ascii_split_whitespace", lambda x: most.append(pa.default_memory_pool().bytes_allocated() - before) or split(x))
    got = textarrow.word_codes(texts)
    assert (got[0] == per).all() and (got[1] == codes).all() and got[2].equals(words) and len(most) > 50 and max(most) < 100_000
    assert [len(x) for x in textarrow.word_codes(texts[:0])] == [0, 0, 0]


def test_base_scores_need_no_model(spark, monkeypatch):
    from kindred.llm import bilinear

    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{min(r.randrange(90), r.randrange(90))}" for _ in range(r.randint(0, 40)))) for i in range(120)] + [(None, "a w1"), (7, None)], "doc_id long, text string")
    want = sorted(map(str, bilinear.score(docs).drop("score").collect()))
    monkeypatch.setattr(bilinear.Model, "start", None)
    assert sorted(map(str, bilinear.base(docs).collect())) == want
