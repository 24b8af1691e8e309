"""Similarity scores, distances and signatures as Column expressions; NULL in, NULL out.

What Spark's own functions can express stays in the JVM; Jaro, the hashes and the two token weightings are Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\p{IsWhite_Space}]+"
_BREAK = r"[\p{IsWhite_Space}!-/:-@\[-`{-~]+"
ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _known(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def _let(f: Callable[..., Column], *values: Column) -> Column:
    """f of values that are computed once per row, however often f uses them and whatever the optimiser inlines."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(bound), lambda r: f(*[r[f"v{i}"] for i in range(len(values))])).getItem(0)


def levenshtein_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.levenshtein(_c(a), _c(b))


def levenshtein_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    def of(a: Column, b: Column) -> Column:
        longest = F.greatest(F.char_length(a), F.char_length(b))
        return _known(a, b, F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest))

    return _let(of, _c(a), _c(b))


def hamming_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Positions that differ; NULL where the lengths do."""
    return _let(_hamming, _c(a), _c(b))


def _hamming(a: Column, b: Column) -> Column:
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))
    return F.when(F.char_length(a) == F.char_length(b), F.when(a == b, F.lit(0)).otherwise(differ))


def hamming_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    def of(a: Column, b: Column) -> Column:
        return F.when(F.char_length(a) == F.char_length(b), F.when(a == b, F.lit(1.0)).otherwise(1.0 - _hamming(a, b) / F.char_length(a)))

    return _let(of, _c(a), _c(b))


def ngrams(s: ColumnOrName, n: int = 2) -> Column:
    """Distinct character n-grams; a shorter text is its only one."""
    if n < 1:
        raise ValueError("n must be at least 1")

    def of(s: Column) -> Column:
        size = F.char_length(s)
        grams = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))
        return F.when(size < n, F.array(s)).when(size >= n, F.array_distinct(grams))

    return _let(of, _c(s))


def words(s: ColumnOrName) -> Column:
    """Distinct words between white space, as they are."""
    return F.array_distinct(F.filter(F.split(_c(s), SPACE), lambda x: x != ""))


def tokens(s: ColumnOrName) -> Column:
    """Lower-cased tokens between white space and ASCII punctuation, in order."""
    return F.transform(F.filter(F.split(_c(s), _BREAK), lambda x: x != ""), F.lower)


def set_jaccard(x: Column, y: Column) -> Column:
    """Of two sets as distinct arrays; two empty ones are equal."""

    def of(x: Column, y: Column, both: Column) -> Column:
        union = F.size(x) + F.size(y) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both / union)

    return F.when(x.isNotNull() & y.isNotNull(), _let(lambda x, y: _let(of, x, y, F.size(F.array_intersect(x, y))), x, y))


def jaccard_similarity(a: ColumnOrName, b: ColumnOrName, n: int = 2) -> Column:
    a, b = _c(a), _c(b)
    return _known(a, b, F.when(a == b, F.lit(1.0)).otherwise(set_jaccard(ngrams(a, n), ngrams(b, n))))


def jaccard_bigram_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    return jaccard_similarity(a, b, 2)


def jaccard_trigram_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    return jaccard_similarity(a, b, 3)


def jaccard_word_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    a, b = _c(a), _c(b)
    return _known(a, b, set_jaccard(words(a), words(b)))


def _present(kernel: Callable, kind: str, count: int = 2):
    """An Arrow UDF of a kernel that sees only rows without NULL: lists of strings in, one array out."""

    def run(*columns: pa.Array) -> pa.Array:
        has = columns[0].is_valid()
        for c in columns[1:]:
            has = pc.and_(has, c.is_valid())
        some = [c.filter(has).to_pylist() for c in columns]
        out = kernel(*some) if some[0] else []
        return placed(out if isinstance(out, pa.Array) else pa.array(out, to_arrow_type(kind)), has)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    return F.arrow_udf(two if count == 2 else one, kind)


def to_arrow_type(kind: str) -> pa.DataType:
    return {"double": pa.float64(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "string": pa.string()}[kind]


def placed(values: pa.Array, has: pa.Array) -> pa.Array:
    """The values at the rows that has marks, NULL elsewhere."""
    if len(values) == len(has):
        return values
    where = np.asarray(has)
    return values.take(pa.array(np.cumsum(where) - 1, mask=~where))


def jaro_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    from kindred.functions import kernels

    return _present(lambda x, y: kernels.jaro(x, y)[0], "double")(_c(a), _c(b))


def jaro_winkler_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Jaro plus a tenth per common first character, up to four, whatever Jaro is."""
    from kindred.functions import kernels

    return _present(kernels.jaro_winkler, "double")(_c(a), _c(b))


def fnv1a(s: ColumnOrName) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed long."""
    from kindred.functions import kernels

    return _present(lambda x: kernels.fnv1a(x).view("int64"), "long", 1)(_c(s))


def minhash_signature(s: ColumnOrName, shingle: int = 3, hashes: int = 128) -> Column:
    from kindred.functions import kernels

    if shingle < 1 or hashes < 1:
        raise ValueError("shingle and hashes must be at least 1")
    return _present(lambda x: kernels.rows(kernels.minhash(x, shingle, hashes)), "array<long>", 1)(_c(s))


def signature_similarity(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Share of equal places, over the shorter signature."""
    x, y = _c(x), _c(y)
    shorter = F.least(F.size(x), F.size(y))
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda z: z))
    return F.when(x.isNotNull() & y.isNotNull() & (shorter > 0), same / shorter)


def minhash_similarity(a: ColumnOrName, b: ColumnOrName, shingle: int = 3, hashes: int = 128) -> Column:
    return signature_similarity(minhash_signature(a, shingle, hashes), minhash_signature(b, shingle, hashes))


def simhash_fingerprint(s: ColumnOrName, shingle: int = 4) -> Column:
    from kindred.functions import kernels

    if shingle < 1:
        raise ValueError("shingle must be at least 1")
    return _present(lambda x: kernels.simhash(x, shingle), "long", 1)(_c(s))


def fingerprint_distance(x: ColumnOrName, y: ColumnOrName) -> Column:
    return F.bit_count(_c(x).bitwiseXOR(_c(y)))


def fingerprint_similarity(x: ColumnOrName, y: ColumnOrName) -> Column:
    return 1.0 - fingerprint_distance(x, y) / 64.0


def simhash_similarity(a: ColumnOrName, b: ColumnOrName, shingle: int = 4) -> Column:
    return fingerprint_similarity(simhash_fingerprint(a, shingle), simhash_fingerprint(b, shingle))


def _of_tokens(name: str):
    from kindred.functions import kernels

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        has = pc.and_(x.is_valid(), y.is_valid())
        if x.null_count or y.null_count:  # else a copy of the batch for nothing
            x, y = x.filter(has), y.filter(has)
        return placed(pa.array(getattr(kernels, name)(x, y)), has)

    return F.arrow_udf(run, "double")


def bm25_udf():
    return _of_tokens("bm25_pairs")


def tfidf_udf():
    return _of_tokens("tfidf_pairs")


def bm25_tokens(x: Column, y: Column) -> Column:
    return bm25_udf()(x, y)


def tfidf_tokens(x: Column, y: Column) -> Column:
    return tfidf_udf()(x, y)


def bm25_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """b's BM25 score for a's tokens over the better of the two documents; not symmetric, 0 without a shared token."""
    return bm25_tokens(tokens(a), tokens(b))


def tfidf_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    return tfidf_tokens(tokens(a), tokens(b))
