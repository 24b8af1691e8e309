"""Column and SQL functions, and cleaning, against golden values."""

import pytest
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.functions.cleaning import Cleaner, clean_text, clean_text_stopwords
from kindred.functions.sql import register_all

GOLDEN = """
MARTHA|MARHTA|2|0.666667|0.961111|0.666667|0.250000|0.142857|0.000000|0.156250|0.687500|0.000000|0.000000
DWAYNE|DUANE|2|0.666667|0.840000||0.125000|0.000000|0.000000|0.000000|0.421875|0.000000|0.000000
DIXON|DICKSONX|4|0.500000|0.813333||0.222222|0.000000|0.000000|0.000000|0.500000|0.000000|0.000000
CATHERINE|KATHERINE|1|0.888889|0.925926|0.888889|0.777778|0.750000|0.000000|0.859375|0.875000|0.000000|0.000000
hello|hallo|1|0.800000|0.880000|0.800000|0.333333|0.200000|0.000000|0.226562|0.593750|0.000000|0.000000
hello world|hello there|5|0.545455|0.854545|0.545455|0.357143|0.285714|0.333333|0.390625|0.718750|0.208256|0.336097
||0|1.000000|1.000000|1.000000|1.000000|1.000000|1.000000|1.000000|1.000000|0.000000|1.000000
hello||5|0.000000|0.000000||0.000000|0.000000|0.000000|0.000000|0.578125|0.000000|0.000000
the quick brown fox|the quick blue fox|4|0.789474|0.911228||0.619048|0.500000|0.600000|0.507812|0.750000|0.441061|0.602975
Hello World|hello world|2|0.818182|0.878788|0.818182|0.538462|0.384615|0.000000|0.500000|0.734375|1.000000|1.000000
café|cafe|1|0.750000|0.883333|0.750000|0.500000|0.333333|0.000000|0.335938|0.375000|0.000000|0.000000
the the the|the|8|0.272727|0.830303||0.500000|0.250000|1.000000|0.273438|0.468750|0.885714|1.000000
""".strip("\n").split("\n")
NAMES = ("levenshtein_distance", "levenshtein_similarity", "jaro_winkler_similarity", "hamming_similarity", "jaccard_bigram_similarity", "jaccard_trigram_similarity", "jaccard_word_similarity", "minhash_similarity", "simhash_similarity", "bm25_similarity", "tfidf_similarity")


def near(x, y):
    return (x is None) == (y is None) and (x is None or abs(x - y) < 1.5e-6)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [r.split("|") for r in GOLDEN]
    return spark.createDataFrame([(i, r[0], r[1], *[float(x) if x else None for x in r[2:]]) for i, r in enumerate(rows)], "i int, a string, b string, " + ", ".join(f"g{k} double" for k in range(11))).cache()


def test_columns(pairs):
    got = pairs.select("*", *(getattr(T, n)("a", "b").cast("double").alias(f"s{k}") for k, n in enumerate(NAMES))).collect()
    bad = [(r["a"], r["b"], NAMES[k], r[f"s{k}"], r[f"g{k}"]) for r in got for k in range(11) if not near(r[f"s{k}"], r[f"g{k}"])]
    assert not bad


def test_sql(spark, pairs):
    names = register_all(spark)
    assert set(NAMES) <= {*names, "minhash_similarity", "simhash_similarity"} and len(names) >= 20
    pairs.createOrReplaceTempView("golden_pairs")
    calls = [f"{n}(a, b)" if n not in ("minhash_similarity", "simhash_similarity") else f"{n}_default(a, b)" for n in NAMES]
    got = spark.sql("SELECT *, " + ", ".join(f"cast({c} as double) s{k}" for k, c in enumerate(calls)) + " FROM golden_pairs").collect()
    assert not [(r["a"], NAMES[k], r[f"s{k}"]) for r in got for k in range(11) if not near(r[f"s{k}"], r[f"g{k}"])]
    one = spark.sql("SELECT jaccard_similarity('abcd', 'abce', 2), minhash_similarity('hello world', 'hello there', 3, 128), simhash_fingerprint('hi', 4), hex(fnv1a('a')), size(minhash_signature('x', 3, 7)), clean_text('  A  B '), clean_text_stopwords('the fox')").first()
    assert list(one) == [0.5, 0.390625, 628919584683901914, "AF63DC4C8601EC8C", 7, "a b", "fox"]


def test_null_in_null_out(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "a string, b string")
    got = df.select(*(getattr(T, n)("a", "b").alias(n) for n in NAMES), T.ngrams("a").alias("g"), T.simhash_fingerprint("a").alias("f"), clean_text("a").alias("c")).collect()
    assert all(r[n] is None for r in got for n in NAMES) and got[0]["g"] is None and got[0]["f"] is None and got[0]["c"] is None


def test_tokens_and_grams(spark):
    df = spark.createDataFrame([("It's  a_test—Hello, WORLD! €5 x+y",), ("",)], "s string")
    t = [r[0] for r in df.select(T.tokens("s")).collect()]
    assert t == [["it", "s", "a", "test—hello", "world", "€5", "x", "y"], []]
    g = spark.createDataFrame([("",), ("a",), ("abab",)], "s string").select(T.ngrams("s", 2)).collect()
    assert [r[0] for r in g] == [[""], ["a"], ["ab", "ba"]]
    with pytest.raises(ValueError):
        T.ngrams("s", 0)


CLEAN = [
    ("  Hello   World!  ", Cleaner(), "hello world!"),
    ("  Hello   World  ", Cleaner().with_lowercase(False), "Hello World"),
    ("é", Cleaner(), "é"),
    ("the quick brown fox jumps over the lazy dog", Cleaner().with_remove_stopwords(), "quick brown fox jumps lazy dog"),
    ("hello wonderful world", Cleaner().with_remove_stopwords().with_stopwords(["hello", "world"]), "wonderful"),
    ("hello world", Cleaner().with_max_length(5), "hello"),
    ("a 　b\u001cc", Cleaner(), "a b\u001cc"),
    ("café", Cleaner().with_max_length(4), "caf"),
    ("The the, THE", Cleaner().with_lowercase(False).with_remove_stopwords(), "The the, THE"),
    ("", Cleaner(), ""),
    ("a b", Cleaner().with_trim(False).with_collapse_whitespace(False).with_normalize_unicode(False), "a b"),
]


def test_cleaning(spark):
    df = spark.createDataFrame([tuple(c[0] for c in CLEAN)], ", ".join(f"c{i} string" for i in range(len(CLEAN))))
    got = df.select(*(c[1].apply(f"c{i}").alias(f"c{i}") for i, c in enumerate(CLEAN))).first()
    assert list(got) == [c[2] for c in CLEAN]
    assert df.select(clean_text_stopwords(F.lit("The fox"))).first()[0] == "fox"
    with pytest.raises(ValueError):
        Cleaner().with_max_length(-1)
