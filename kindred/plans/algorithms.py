"""Algorithms as values: what each side of a pair is prepared to, and how two prepared sides score."""

from __future__ import annotations

import enum
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import text as T


@dataclass(frozen=True)
class Algorithm:
    """name is the one in results; prepare works on one side, so a join does it once per row and not per pair."""

    name: str
    prepare: Callable[[Column], Column]
    compare: Callable[[Column, Column], Column]
    native: bool = True

    def score(self, a: Column, b: Column) -> Column:
        return self.compare(self.prepare(a), self.prepare(b))


def _same(x: Column) -> Column:
    return x


LEVENSHTEIN = Algorithm("levenshtein", _same, T.levenshtein_similarity)
JARO_WINKLER = Algorithm("jaro_winkler", _same, T.jaro_winkler_similarity, native=False)
HAMMING = Algorithm("hamming", _same, T.hamming_similarity)
JACCARD_WORD = Algorithm("jaccard_word", T.words, T.set_jaccard)
BM25 = Algorithm("bm25", T.tokens, T.bm25_tokens, native=False)
TFIDF = Algorithm("tfidf", T.tokens, T.tfidf_tokens, native=False)


def jaccard(n: int, name: str = "jaccard") -> Algorithm:
    T.ngrams(F.lit(""), n)
    return Algorithm(name, lambda s: T.ngrams(s, n), T.set_jaccard)


def minhash(shingle: int = 3, hashes: int = 128) -> Algorithm:
    if shingle < 1 or hashes < 1:
        raise ValueError("shingle and hashes must be at least 1")
    return Algorithm("minhash", lambda s: T.minhash_signature(s, shingle, hashes), T.signature_similarity, native=False)


def simhash(shingle: int = 4) -> Algorithm:
    if shingle < 1:
        raise ValueError("shingle must be at least 1")
    return Algorithm("simhash", lambda s: T.simhash_fingerprint(s, shingle), T.fingerprint_similarity, native=False)


def by_name(name: str | Algorithm, **options: int) -> Algorithm:
    """levenshtein, jaro_winkler, hamming, jaccard (n), jaccard_bigram, jaccard_trigram, jaccard_word, minhash (shingle, hashes), minhash_default, simhash (shingle), simhash_default, bm25, tfidf."""
    if isinstance(name, Algorithm):
        return name
    made: dict[str, Callable[..., Algorithm]] = {
        "levenshtein": lambda: LEVENSHTEIN,
        "jaro_winkler": lambda: JARO_WINKLER,
        "hamming": lambda: HAMMING,
        "jaccard": lambda n=2: jaccard(n),
        "jaccard_bigram": lambda: jaccard(2, "jaccard_bigram"),
        "jaccard_trigram": lambda: jaccard(3, "jaccard_trigram"),
        "jaccard_word": lambda: JACCARD_WORD,
        "minhash": minhash,
        "minhash_default": minhash,
        "simhash": simhash,
        "simhash_default": simhash,
        "bm25": lambda: BM25,
        "tfidf": lambda: TFIDF,
    }
    if name not in made:
        raise ValueError(f"unknown algorithm {name!r}; known: {', '.join(made)}")
    return made[name](**options)


class Intent(enum.Enum):
    """What a comparison is for; AUTO is decided by byte lengths."""

    NAMES = "names"
    TYPOS = "typos"
    CODES = "codes"
    DOCUMENTS = "documents"
    DEDUP = "dedup"
    AUTO = "auto"

    @staticmethod
    def of(name: str | Intent) -> Intent:
        if isinstance(name, Intent):
            return name
        try:
            return Intent({"deduplication": "dedup"}.get(name, name))
        except ValueError:
            raise ValueError(f"unknown intent {name!r}") from None


def resolve(intent: str | Intent) -> Algorithm:
    """An intent's algorithm; AUTO here is decided on two empty texts, which means Hamming."""
    return {
        Intent.NAMES: JARO_WINKLER,
        Intent.TYPOS: LEVENSHTEIN,
        Intent.CODES: HAMMING,
        Intent.DOCUMENTS: BM25,
        Intent.DEDUP: simhash(),
        Intent.AUTO: HAMMING,
    }[Intent.of(intent)]


def auto_choice(a: Column, b: Column) -> Column:
    """Name of the algorithm for two texts, by their lengths in bytes."""
    la, lb = F.octet_length(a), F.octet_length(b)
    longest = F.greatest(la, lb)
    return F.when((la == lb) & (la <= 20), F.lit("hamming")).when(longest <= 50, F.lit("jaro_winkler")).when(longest <= 500, F.lit("bm25")).when(longest.isNotNull() & la.isNotNull() & lb.isNotNull(), F.lit("simhash"))
