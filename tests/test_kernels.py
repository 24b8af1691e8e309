"""Kernels against golden values and slow scalar versions."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kindred.functions import kernels as K

ALPHABET = ["a", "b", "c", "d", "é", "日", "😀", " ", " ", "_", ","]


def texts(n, most, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(n)]


def slow_fnv(raw):
    h = 0xCBF29CE484222325
    for x in raw:
        h = ((h ^ x) * 0x100000001B3) % 2**64
    return h


def slow_windows(s, n):
    return [s[i : i + n] for i in range(len(s) - n + 1)] if len(s) >= n else [s]


def slow_jaro(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, matched = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                matched.append(x)
                break
    other = [y for y, u in zip(b, used) if u]
    m = len(matched)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(matched, other)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def test_fnv_and_shingles():
    some = [*texts(200, 40, 1), "", "a", "hello world"]
    assert K.fnv1a(some).tolist() == [slow_fnv(s.encode()) for s in some]
    for n in (1, 3, 4):
        h, counts = K.shingle_hashes(some, n)
        assert h.tolist() == [slow_fnv(w.encode()) for s in some for w in slow_windows(s, n)]
        assert counts.tolist() == [len(slow_windows(s, n)) for s in some]


def test_hash_goldens():
    assert int(K.fnv1a([""])[0]) == 0xCBF29CE484222325
    assert int(K.fnv1a(["a"])[0]) == 0xAF63DC4C8601EC8C
    sim = K.simhash(["hello world", "the quick brown fox", "hi", ""]).view(np.uint64).tolist()
    assert sim == [0x4A98F4A451080124, 0x696E10F6600E9D18, 0x08BA5F07B55EC3DA, 0xCBF29CE484222325]
    m = K.minhash(["hello world", ""])
    assert m[0, :4].tolist() == [44401920091960339, 94683473809106323, 252195892270319644, 10822630094801330] and m[0, 127] == 212950627235930958
    assert m[1, :2].tolist() == [214467063832468254, 1007223326381081109]


@pytest.mark.parametrize("most", [6, 14, 70])
def test_jaro(most):
    a, b = texts(400, most, 2), texts(400, most, 3)
    a += ["MARTHA", "DWAYNE", "karolin", "abcde", "日本語", "é", "", "x", "same", "ab" * 300]
    b += ["MARHTA", "DUANE", "kathrin", "axxxx", "日本", "ab", "", "", "same", "ba" * 300]
    score, prefix = K.jaro(a, b)
    assert np.allclose(score, [slow_jaro(x, y) for x, y in zip(a, b)])
    assert K.jaro_winkler(["MARTHA", "abcde"], ["MARHTA", "axxxx"]).round(6).tolist() == [0.961111, 0.52]


def slow_pair(a, b):
    """(BM25, TF-IDF) of two token lists, term by term."""
    fa, fb = Counter(a), Counter(b)
    mean = (len(a) + len(b)) / 2

    def total(tf, size):
        norm = 1.2 * (0.25 + 0.75 * size / mean) if mean else 0.0
        return sum(n * math.log(1.2 if t in fb else 2.0) * tf[t] * 2.2 / (tf[t] + norm) for t, n in fa.items() if t in tf)

    other = total(fb, len(b))
    top = max(total(fa, len(a)), other, 0.0)
    if not a or not b:
        return 0.0, float(not a and not b)
    size = lambda own, rest: math.sqrt(sum((n * (1 if t in rest else math.log(1.5) + 1)) ** 2 for t, n in own.items()))
    return (other / top if top else 0.0), sum(n * fb[t] for t, n in fa.items()) / (size(fa, fb) * size(fb, fa))


def test_pairs_of_tokens():
    a = [["a", "a", "b"], ["a", "b", "c"], [], ["a"], "the quick brown fox".split()]
    b = [["a", "b", "c"], ["a", "a", "b"], [], [], "the lazy dog".split()]
    bm25, tfidf = (f(pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string()))).round(6).tolist() for f in (K.bm25_pairs, K.tfidf_pairs))
    assert bm25[:4] == [0.8, 0.409357, 0.0, 0.0] and tfidf[2:] == [1.0, 0.0, 0.170776]
    r = random.Random(5)
    a, b = ([[r.choice("abcdefgh") for _ in range(r.randint(0, 12))] for _ in range(400)] for _ in range(2))
    got = list(zip(K.bm25_pairs(pa.array(a), pa.array(b)), K.tfidf_pairs(pa.array(a), pa.array(b))))
    assert np.allclose(got, [slow_pair(x, y) for x, y in zip(a, b)])


def test_memory_of_pairs_of_tokens_does_not_grow_with_the_batch():
    r = np.random.default_rng(9)
    sizes = r.integers(0, 1000, (2, 4000))
    sizes[:, [0, 1, -1]], sizes[0, 7] = 0, K.PAIR_TOKENS + 1
    words = pa.array([f"w{i}" for i in range(300)])
    a, b = (pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), words.take(pa.array(r.integers(0, 300, n.sum())))) for n in sizes)
    usual = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        got = np.stack([K.bm25_pairs(a, b), K.tfidf_pairs(a, b)], axis=1)
        peak = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(usual)
    assert peak < 50e6
    some = [*range(12), *range(1990, 2010), *range(3990, 4000)]
    assert np.allclose(got[some], [slow_pair(a[i].as_py(), b[i].as_py()) for i in some])
    assert np.allclose(got[5:90], np.stack([f(a[5:90], b[5:90]) for f in (K.bm25_pairs, K.tfidf_pairs)], axis=1))
    assert K.tfidf_pairs(a[:0], b[:0]).tolist() == []


def test_simhash_counts_long_texts():
    some = ["ab" * 400, "x" * 1000, *texts(50, 900, 6)]
    h, counts = K.shingle_hashes(some, 4)
    bits = [[sum(int(x) >> i & 1 for x in part) for i in range(64)] for part in np.split(h, np.cumsum(counts)[:-1])]
    want = [sum((2 * n > c) << i for i, n in enumerate(b)) for b, c in zip(bits, counts.tolist())]
    assert K.simhash(some).view(np.uint64).tolist() == want


def test_sizes_are_checked():
    for bad in (lambda: K.shingle_hashes(["a"], 0), lambda: K.minhash(["a"], 3, 0)):
        with pytest.raises(ValueError):
            bad()
