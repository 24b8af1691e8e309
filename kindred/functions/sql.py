"""The scalar functions by name in SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kindred.functions import kernels
from kindred.functions.cleaning import WIDE, nfc_udf
from kindred.functions.stopwords import DEFAULT
from kindred.functions.text import _BREAK, SPACE, bm25_udf, placed, tfidf_udf, to_arrow_type
from kindred.runtime import ship


def _q(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _native() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, type, body); inlined by the optimiser wherever they are used."""
    grams = "CASE WHEN char_length({s}) < n THEN array({s}) ELSE array_distinct(transform(sequence(1, greatest(char_length({s}) - n + 1, 1)), i -> substring({s}, i, n))) END"
    both = "size(array_intersect({x}, {y}))"
    tokens = f"transform(filter(split(s, {_q(_BREAK)}), x -> x <> ''), x -> lower(x))"

    def jaccard(n: str) -> str:
        x, y = grams.format(s="a").replace(" n ", f" {n} ").replace("- n +", f"- {n} +").replace("i, n)", f"i, {n})"), grams.format(s="b").replace(" n ", f" {n} ").replace("- n +", f"- {n} +").replace("i, n)", f"i, {n})")
        return f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN 1.0D ELSE {both.format(x=x, y=y)} / size(array_union({x}, {y})) END"

    def word(s: str) -> str:
        return f"array_distinct(filter(split({s}, {_q(SPACE)}), x -> x <> ''))"

    differ = "size(filter(zip_with(split(a, ''), split(b, ''), (x, y) -> x <> y), z -> z))"
    two = "a STRING, b STRING"
    # Text below U+0300 is in NFC already and never reaches Python.
    nfc = f"coalesce(kindred_nfc(CASE WHEN s RLIKE {_q(WIDE)} THEN s END), s)"
    clean = f"regexp_replace(regexp_replace(lower({nfc}), {_q(SPACE)}, ' '), '^ | $', '')"
    listed = "array(" + ", ".join("'" + w + "'" for w in sorted(DEFAULT)) + ")"
    return {
        "clean_text": ("s STRING", "STRING", clean),
        "clean_text_stopwords": ("s STRING", "STRING", f"array_join(filter(split({clean}, ' '), x -> x <> '' AND NOT array_contains({listed}, x)), ' ')"),
        "bm25_similarity": (two, "DOUBLE", f"kindred_bm25_tokens({tokens.replace('split(s', 'split(a')}, {tokens.replace('split(s', 'split(b')})"),
        "tfidf_similarity": (two, "DOUBLE", f"kindred_tfidf_tokens({tokens.replace('split(s', 'split(a')}, {tokens.replace('split(s', 'split(b')})"),
        "levenshtein_distance": (two, "INT", "levenshtein(a, b)"),
        "levenshtein_similarity": (two, "DOUBLE", "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(char_length(a), char_length(b)) = 0 THEN 1.0D ELSE 1.0D - levenshtein(a, b) / greatest(char_length(a), char_length(b)) END"),
        "hamming_distance": (two, "INT", f"CASE WHEN char_length(a) = char_length(b) THEN CASE WHEN a = b THEN 0 ELSE {differ} END END"),
        "hamming_similarity": (two, "DOUBLE", f"CASE WHEN char_length(a) = char_length(b) THEN CASE WHEN a = b THEN 1.0D ELSE 1.0D - {differ} / char_length(a) END END"),
        "jaccard_similarity": (two + ", n INT", "DOUBLE", jaccard("n")),
        "jaccard_bigram_similarity": (two, "DOUBLE", jaccard("2")),
        "jaccard_trigram_similarity": (two, "DOUBLE", jaccard("3")),
        "jaccard_word_similarity": (two, "DOUBLE", f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size({word('a')}) + size({word('b')}) = 0 THEN 1.0D ELSE {both.format(x=word('a'), y=word('b'))} / size(array_union({word('a')}, {word('b')})) END"),
        "text_tokens": ("s STRING", "ARRAY<STRING>", tokens),
        "signature_similarity": ("x ARRAY<BIGINT>, y ARRAY<BIGINT>", "DOUBLE", "CASE WHEN least(size(x), size(y)) > 0 THEN size(filter(zip_with(x, y, (p, q) -> coalesce(p = q, false)), z -> z)) / least(size(x), size(y)) END"),
        "simhash_distance": ("x BIGINT, y BIGINT", "INT", "bit_count(x ^ y)"),
        "fingerprint_similarity": ("x BIGINT, y BIGINT", "DOUBLE", "1.0D - bit_count(x ^ y) / 64.0D"),
    }


def _column_wise(kernel, kind: str, arity: int):
    """An Arrow UDF that sees only rows without NULL: lists in, one array out."""

    def run(*columns: pa.Array) -> pa.Array:
        has = columns[0].is_valid()
        for c in columns[1:]:
            has = pc.and_(has, c.is_valid())
        some = [c.filter(has).to_pylist() for c in columns]
        out = kernel(*some) if some[0] else []
        return placed(out if isinstance(out, pa.Array) else pa.array(out, to_arrow_type(kind)), has)

    return F.arrow_udf({1: _one, 2: _two, 3: _three, 4: _four}[arity](run), kind)


def _one(run):
    def f(a: pa.Array) -> pa.Array:
        return run(a)

    return f


def _two(run):
    def f(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return f


def _three(run):
    def f(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    return f


def _four(run):
    def f(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return run(a, b, c, d)

    return f


def _agree(x, y) -> list[float]:
    return (x == y).mean(1).tolist()


def _near(x, y) -> list[float]:
    return [1.0 - (int(p) ^ int(q)).bit_count() / 64.0 for p, q in zip(x.view("uint64"), y.view("uint64"))]


def register_all(spark: SparkSession) -> list[str]:
    """Registers every scalar function for SQL and returns their names."""
    ship(spark)
    for name, udf in (("kindred_nfc", nfc_udf()), ("kindred_bm25_tokens", bm25_udf()), ("kindred_tfidf_tokens", tfidf_udf())):
        spark.udf.register(name, udf)
    for name, (args, kind, body) in _native().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")

    def per_size(f):
        def run(*columns):
            """Options are columns in SQL: rows of equal options go through together."""
            texts, options = columns[: f.__code__.co_argcount - f.n_options], list(zip(*columns[f.__code__.co_argcount - f.n_options :]))
            out = [None] * len(options)
            for o in set(options):
                at = [i for i, x in enumerate(options) if x == o]
                for i, v in zip(at, f(*([t[i] for i in at] for t in texts), *o)):
                    out[i] = v
            return out

        return run

    def minhash_signature(a, size, k):
        return kernels.minhash(a, size, k).tolist()

    def minhash_similarity(a, b, size, k):
        return _agree(kernels.minhash(a, size, k), kernels.minhash(b, size, k))

    def simhash_fingerprint(a, size):
        return kernels.simhash(a, size).tolist()

    def simhash_similarity(a, b, size):
        return _near(kernels.simhash(a, size), kernels.simhash(b, size))

    for f, n in ((minhash_signature, 2), (minhash_similarity, 2), (simhash_fingerprint, 1), (simhash_similarity, 1)):
        f.n_options = n
    udfs = {
        "jaro_similarity": (lambda a, b: kernels.jaro(a, b)[0].tolist(), "double", 2),
        "jaro_winkler_similarity": (lambda a, b: kernels.jaro_winkler(a, b).tolist(), "double", 2),
        "fnv1a": (lambda a: kernels.fnv1a(a).view("int64").tolist(), "long", 1),
        "minhash_signature": (per_size(minhash_signature), "array<long>", 3),
        "minhash_similarity": (per_size(minhash_similarity), "double", 4),
        "minhash_similarity_default": (lambda a, b: _agree(kernels.minhash(a), kernels.minhash(b)), "double", 2),
        "simhash_fingerprint": (per_size(simhash_fingerprint), "long", 2),
        "simhash_fingerprint_default": (lambda a: kernels.simhash(a).tolist(), "long", 1),
        "simhash_similarity": (per_size(simhash_similarity), "double", 3),
        "simhash_similarity_default": (lambda a, b: _near(kernels.simhash(a), kernels.simhash(b)), "double", 2),
    }
    for name, (kernel, kind, arity) in udfs.items():
        spark.udf.register(name, _column_wise(kernel, kind, arity))
    return sorted([*_native(), *udfs])
