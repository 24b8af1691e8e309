"""Kindred: a PySpark-native text-similarity and matching engine.

The names below are importable from here; each is loaded when it is first asked for, so that Python workers, which import
kernels alone, stay small.
"""

from __future__ import annotations

import importlib

_HOME = {
    "kindred.plans.flow": ("Flow", "Threshold", "greater_than", "less_than", "between"),
    "kindred.plans.algorithms": ("Algorithm", "Intent", "by_name", "resolve"),
    "kindred.functions.cleaning": ("Cleaner", "clean_text", "clean_text_stopwords"),
    "kindred.functions.sql": ("register_all",),
    "kindred.operators.batch": ("Batch",),
    "kindred.operators.join": ("similarity_join",),
    "kindred.functions.text": (
        "levenshtein_distance", "levenshtein_similarity", "hamming_distance", "hamming_similarity", "jaro_similarity", "jaro_winkler_similarity", "ngrams", "words", "tokens", "jaccard_similarity", "jaccard_bigram_similarity",
        "jaccard_trigram_similarity", "jaccard_word_similarity", "fnv1a", "minhash_signature", "minhash_similarity", "signature_similarity", "simhash_fingerprint", "simhash_similarity", "fingerprint_distance", "fingerprint_similarity",
        "bm25_similarity", "tfidf_similarity",
    ),
}
_WHERE = {name: home for home, names in _HOME.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_WHERE[name]), name)
