"""Routing, cascade and batches."""

import pytest

from kindred.operators.batch import Batch
from kindred.plans import algorithms as A
from kindred.plans.flow import Flow, Threshold, between, greater_than, less_than


def frame(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")


def results(df):
    return [None if r["result"] is None else (round(r["result"]["score"], 6), r["result"]["tier"], r["result"]["algorithm"]) for r in sorted(df.collect(), key=lambda r: r["i"])]


def hook():
    """Local, so that it is sent to the workers by value."""

    def even(a, b):
        same = sum(x == y for x, y in zip(a, b))
        return (0.75, "close") if len(a) == len(b) and 2 * same > len(a) else (0.25, None)

    return even


def test_auto_routing(spark):
    sizes = [(0, "hamming"), (1, "hamming"), (20, "hamming"), (21, "jaro_winkler"), (50, "jaro_winkler"), (51, "bm25"), (500, "bm25"), (501, "simhash"), (600, "simhash")]
    df = frame(spark, [("x" * n, "x" * n) for n, _ in sizes] + [("hello", "world!"), (None, "a")])
    got = results(Flow.auto().compare(df))
    assert [g[2] for g in got[:-1]] == [n for _, n in sizes] + ["jaro_winkler"] and all(g[1] == 0 for g in got[:-1]) and got[-1] is None
    odd = frame(spark, [("é", "ab")])
    assert results(Flow.auto().errors("null").compare(odd)) == [None]
    with pytest.raises(Exception, match="equal length"):
        Flow.auto().compare(odd).collect()


def test_cascade(spark):
    flow = Flow().tier_1("jaro_winkler", greater_than(0.95), less_than(0.10)).tier_2("bm25", between(0.30, 0.94)).fallback(hook())
    df = frame(spark, [(None, "x"), ("hello world", "hello there"), ("abc", "xyz"), ("kitten", "sitting"), ("same words", "same words"), ("MARTHA", "MARHTA"), ("the quick brown fox", "the quick lazy dog")])
    assert results(flow.compare(df)) == [None, (0.75, 3, "fallback"), (0.0, 1, "jaro_winkler"), (0.25, 3, "fallback"), (1.0, 1, "jaro_winkler"), (0.961111, 1, "jaro_winkler"), (0.25, 3, "fallback")]
    row = flow.compare(df).where("i = 1").first()["result"]
    assert row["fallback_called"] and row["fallback_data"] == "close"
    two = Flow().tier_1("levenshtein", greater_than(0.95), less_than(0.10)).tier_2("bm25", between(0.30, 0.95))
    assert results(two.compare(frame(spark, [("the quick brown fox", "the quick blue fox")]))) == [(0.441061, 2, "bm25")]
    one = Flow().tier_1("levenshtein", greater_than(0.99), less_than(0.01))
    assert results(one.compare(frame(spark, [("kitten", "sitting")]))) == [(0.571429, 1, "levenshtein")]
    ignored = Flow().tier_1("levenshtein", between(0.0, 1.0), less_than(0.0)).fallback(hook())
    assert results(ignored.compare(frame(spark, [("kitten", "kitten")]))) == [(0.75, 3, "fallback")]


def test_preprocessor_strategy_and_error_propagation(spark):
    from kindred import Cleaner

    df = frame(spark, [("The  Cat", "cat"), ("cat", "the cats")])
    flow = Flow().with_preprocessor(Cleaner().with_remove_stopwords()).with_strategy("cascade").tier_1("levenshtein", greater_than(0.9), less_than(0.1))
    assert results(flow.compare(df)) == [(1.0, 1, "levenshtein"), (0.75, 1, "levenshtein")]
    assert flow.compare(df).first()["result"].asDict() == {"score": 1.0, "tier": 1, "algorithm": "levenshtein", "fallback_called": False, "fallback_data": None}
    # A Hamming tier on unequal lengths fails before the hook is asked, or gives NULL.
    strict = Flow().tier_1("hamming", greater_than(0.9), less_than(0.1)).fallback(hook())
    with pytest.raises(Exception, match="equal length"):
        strict.compare(frame(spark, [("abc", "ab")])).collect()


def test_exports():
    import kindred

    assert all(getattr(kindred, name) is not None for name in kindred.__all__) and kindred.Flow is Flow
    with pytest.raises(AttributeError):
        kindred.nothing


def test_errors(spark):
    df = frame(spark, [("abc", "abcd")])
    with pytest.raises(ValueError):
        Flow().compare(df)
    lone = Flow().tier_2("levenshtein", greater_than(0.99))
    with pytest.raises(Exception, match="no tiers"):
        lone.compare(df).collect()
    assert results(lone.errors("null").compare(df)) == [None]
    with pytest.raises(Exception, match="equal length"):
        Flow().tier_1("hamming", greater_than(0.9), less_than(0.1)).fallback(hook()).compare(df).collect()
    for bad in (lambda: A.by_name("nope"), lambda: Threshold.of("ge", 0.5), lambda: Threshold("between", 0.1), lambda: A.resolve("poems"), lambda: Flow().with_strategy("vote"), lambda: Flow().errors("ignore"), lambda: A.minhash(3, 0)):
        with pytest.raises(ValueError):
            bad()


def test_intents(spark):
    df = frame(spark, [("MARTHA", "MARHTA")])
    for name, algorithm in (("names", "jaro_winkler"), ("typos", "levenshtein"), ("codes", "hamming"), ("documents", "bm25"), ("deduplication", "simhash")):
        assert results(Flow().compare_with_intent(df, name))[0][1:] == (0, algorithm)
    assert results(Flow.for_intent("names").compare(df)) == [(0.961111, 1, "jaro_winkler")]
    assert Flow.for_intent("auto").first[0] is A.HAMMING


def test_batches(spark):
    left = spark.createDataFrame([(0, "hello"), (1, "world"), (2, "rust")], "id long, text string")
    right = spark.createDataFrame([(0, "hello"), (1, "word"), (2, "rusty")], "id long, text string")
    got = Batch.of("levenshtein").zip(left, right).orderBy("index_a").collect()
    assert [(r["index_a"], r["index_b"], round(r["score"], 6)) for r in got] == [(0, 0, 1.0), (1, 1, 0.8), (2, 2, 0.8)]
    assert Batch.of("levenshtein").matrix(left, right).count() == 9 and Batch.of("jaccard", n=3).matrix(left, keep="upper").count() == 3
    assert {r["score"] for r in Batch.auto().one_to_many("hello!", left).collect()} == {0.0}
    assert {r["index_b"] for r in Batch.auto(per_pair=True).one_to_many("hello", left).where("score = 1").collect()} == {0}
    with pytest.raises(Exception, match="different keys"):
        Batch.of("levenshtein").zip(left, right.where("id < 2")).collect()
