"""Vectorised kernels over many texts at once: tokens, Jaro, FNV-1a, MinHash and SimHash. No Spark in here."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OFFSET, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
MERSENNE = np.uint64(2**61 - 1)
_GOLDEN = 0x9E3779B97F4A7C15


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, their number per text)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), sizes


_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[i for i in range(128) if chr(i) in "\t\n\v\f\r" or 32 < i < 127 and not chr(i).isalnum()]] = 32


def split_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(tokens per text, code of each in order, distinct tokens): the tokens of text.tokens, but for their case; NULL has none."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, _WIDE_SPACE)).as_py():
        texts = pc.replace_substring_regex(texts, _WIDE_SPACE, " ")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    spaced = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(_SPACED[raw])])
    parts = pc.ascii_split_whitespace(spaced)
    found = parts.flatten().dictionary_encode()
    codes, per = np.asarray(found.indices, dtype=np.int64), np.asarray(pc.list_value_length(parts), dtype=np.int64)
    some = np.asarray(pc.not_equal(found.dictionary, ""), dtype=bool)[codes]  # before a leading and after a closing space
    return np.bincount(np.repeat(np.arange(len(per)), per)[some], minlength=len(per)), codes[some], found.dictionary


def _fold(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """FNV-1a over the UTF-8 bytes of one more code point each."""
    if not len(cp):
        return h
    out = (h ^ cp.astype(np.uint64)) * PRIME
    wide = np.flatnonzero(cp >= 0x80)
    if len(wide):
        out[wide] = _fold_wide(h[wide], cp[wide].astype(np.uint64))
    return out


def _fold_wide(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """The same for code points of two to four bytes."""
    three, four = cp >= 0x800, cp >= 0x10000
    six = np.uint64(0x3F)
    lead = np.where(four, 0xF0 | cp >> np.uint64(18), np.where(three, 0xE0 | cp >> np.uint64(12), 0xC0 | cp >> np.uint64(6)))
    h = (h ^ lead) * PRIME
    for shift, has in ((12, four), (6, three)):
        if has.any():
            h = np.where(has, (h ^ (np.uint64(0x80) | (cp >> np.uint64(shift)) & six)) * PRIME, h)
    return (h ^ (np.uint64(0x80) | cp & six)) * PRIME


def fnv1a(texts: Sequence[str]) -> np.ndarray:
    """FNV-1a 64 of each text's UTF-8 bytes."""
    cp, sizes = code_points(texts)
    h = np.full(len(texts), OFFSET)
    starts = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        h[has] = _fold(h[has], cp[starts[has] + k])
    return h


def shingle_hashes(texts: Sequence[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all character windows, with multiplicity; their number per text). A shorter text is its only window."""
    if size < 1:
        raise ValueError("a shingle has at least one character")
    cp, lengths = code_points(texts)
    counts = np.where(lengths >= size, lengths - size + 1, 1)
    total = len(cp) - size + 1
    # All windows of the texts in a row, without a gather; those that begin in the last size - 1 characters of a text go.
    h = np.full(max(total, 0), OFFSET)
    for k in range(size if total > 0 else 0):
        h = _fold(h, cp[k : k + total])
    short = lengths < size
    ends = np.cumsum(lengths)
    inside = np.ones(max(total, 0), bool)
    for k in range(1, size):
        at = ends[(ends >= k) & (lengths >= k)] - k
        inside[at[at < total]] = False
    if not short.any():
        return h[inside], counts
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    one = np.zeros(len(out), bool)
    one[starts[short]] = True
    out[~one] = h[inside]
    out[one] = fnv1a([texts[i] for i in np.flatnonzero(short)])
    return out, counts


def minhash_coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    i = [(_GOLDEN * (n + 1)) for n in range(k)]
    return np.array([(x + 0xABCD) % 2**64 | 1 for x in i], dtype=np.uint64), np.array([(x + 0x1234) % 2**64 for x in i], dtype=np.uint64)


def minhash(texts: Sequence[str], size: int = 3, k: int = 128) -> np.ndarray:
    """Signatures, one row per text; all values are below 2**61."""
    if k < 1:
        raise ValueError("a signature has at least one hash")
    h, counts = shingle_hashes(texts, size)
    ends = np.cumsum(counts)
    starts = ends - counts
    a, b = minhash_coefficients(k)
    out = np.empty((len(texts), k), np.int64)
    at = 0
    while at < len(texts):  # some windows at a time, which stay in the cache for all k hashes
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + 40_000, side="right")))
        some, first = h[starts[at] : ends[stop - 1]], starts[at:stop] - starts[at]
        for i in range(k):
            x = a[i] * some + b[i]
            x = (x & MERSENNE) + (x >> np.uint64(61))  # less than twice the modulus
            out[at:stop, i] = np.minimum.reduceat(np.minimum(x, x - MERSENNE), first)
        at = stop
    return out


#: The bits of a byte, each in a byte of its own.
_SPREAD = np.array([sum(((x >> i) & 1) << (8 * i) for i in range(8)) for x in range(256)], dtype=np.uint64)


def rows(matrix: np.ndarray) -> pa.Array:
    """A matrix as an array of lists."""
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, max(k, 1), dtype=np.int32)), pa.array(matrix.ravel()))


def simhash(texts: Sequence[str], size: int = 4) -> np.ndarray:
    """Fingerprints as signed 64-bit values; a tied bit is 0.

    Eight bits are counted at once, in the bytes of one word, over runs of up to 255 windows.
    """
    out, at = [np.zeros(0, np.int64)], 0
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    while at < len(texts):  # some texts at a time, which stay in the cache
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 30_000, side="right")))
        out.append(_simhash(texts[at:stop], size))
        at = stop
    return np.concatenate(out)


def _simhash(texts: Sequence[str], size: int) -> np.ndarray:
    h, counts = shingle_hashes(texts, size)
    runs = (counts + 254) // 255
    first = np.cumsum(runs) - runs
    owner = np.repeat(np.arange(len(counts)), runs)
    begins = (np.cumsum(counts) - counts)[owner] + 255 * (np.arange(len(owner)) - first[owner])
    out = np.zeros(len(texts), np.uint64)
    parts = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    for j in range(8):  # little-endian: byte j holds the bits from 8 * j on
        sums = np.add.reduceat(_SPREAD[parts[:, j]], begins).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(sums, first, axis=0)
        out |= ((2 * ones > counts[:, None]).astype(np.uint64) << np.arange(8 * j, 8 * j + 8, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out.view(np.int64)


def _matrix(cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    width = int(sizes.max(initial=0))
    at = starts[:, None] + np.arange(width)
    inside = np.arange(width) < sizes[:, None]
    return np.where(inside, cp[np.where(inside, at, 0)] if len(cp) else 0, fill).astype(np.int64)


def jaro(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(Jaro similarity, length of the common prefix up to 4) of each pair; pairs of like size go through the matching together."""
    n = len(a)
    score, prefix = np.zeros(n), np.zeros(n, np.int64)
    ca, la = code_points(a)
    cb, lb = code_points(b)
    sa, sb = np.cumsum(la) - la, np.cumsum(lb) - lb
    order = np.argsort(np.maximum(la, lb), kind="stable")
    at = 0
    while at < n:
        width = max(int(max(la[order[at]], lb[order[at]])), 1)
        stop = at + 1
        limit = max(1, 2_000_000 // max(width, 16))
        while stop < n and stop - at < limit and max(la[order[stop]], lb[order[stop]]) <= 2 * width + 8:
            stop += 1
        some = order[at:stop]
        x, y = _matrix(ca, sa[some], la[some], -1), _matrix(cb, sb[some], lb[some], -2)
        score[some], prefix[some] = _jaro(x, y, la[some], lb[some])
        at = stop
    return score, prefix


def _jaro(x: np.ndarray, y: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, wa, wb = len(x), x.shape[1], y.shape[1]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free = np.arange(wb) < lb[:, None]
    order = np.full((n, max(wa, 1)), -1, np.int64)  # for each character of a, its place in b
    places = np.arange(wb)
    most = int(reach.max(initial=0))
    for i in range(wa if wb else 0):
        low, high = max(0, i - most), min(wb, i + most + 1)
        if low >= high:
            continue
        hit = (y[:, low:high] == x[:, i : i + 1]) & free[:, low:high] & (np.abs(places[low:high] - i)[None, :] <= reach[:, None])
        rows = np.flatnonzero(hit.any(1))
        j = hit[rows].argmax(1) + low
        order[rows, i] = j
        free[rows, j] = False
    matched = order >= 0
    m = matched.sum(1)
    t = np.zeros(n, np.int64)
    if wb:
        taken = (np.arange(wb) < lb[:, None]) & ~free
        who, ia = np.nonzero(matched)
        who2, jb = np.nonzero(taken)
        t = np.bincount(who, x[who, ia] != y[who2, jb], minlength=n).astype(np.int64) // 2 if len(who) else t
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(m > 0, (m / la + m / lb + (m - t) / m) / 3.0, 0.0)
    short = min(wa, wb, 4)
    same = (x[:, :short] == y[:, :short]).astype(np.int64)
    prefix = np.cumprod(same, axis=1).sum(1) if short else np.zeros(n, np.int64)
    equal = (la == lb) & (prefix == np.minimum(la, 4))
    if equal.any() and wa and wb:
        w = min(wa, wb)
        equal &= ((x[:, :w] == y[:, :w]) | (np.arange(w) >= la[:, None])).all(1)
    return np.where(equal, 1.0, s), prefix


def jaro_winkler(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    score, prefix = jaro(a, b)
    return score + prefix * 0.1 * (1.0 - score)


def _counts(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, ...]:
    """Of rows of two token lists: lengths, and per distinct token of a row its row, its count there and on the other side."""
    la, lb = (np.asarray(pc.fill_null(pc.list_value_length(x), 0), dtype=np.int64) for x in (a, b))
    codes = np.asarray(pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices, dtype=np.int64)
    span = int(codes.max(initial=0)) + 1
    ka, na = np.unique(np.repeat(np.arange(len(la)), la) * span + codes[: la.sum()], return_counts=True)
    kb, nb = np.unique(np.repeat(np.arange(len(lb)), lb) * span + codes[la.sum() :], return_counts=True)

    def beside(k: np.ndarray, others: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(others, k), max(len(others) - 1, 0))
        return np.where(others[at] == k, n[at], 0) if len(others) else np.zeros(len(k), np.int64)

    return la, lb, ka // span, na, beside(ka, kb, nb), kb // span, nb, beside(kb, ka, na)


#: Tokens of the rows that are counted at a time: what that takes does not grow with the batch.
PAIR_TOKENS = 200_000


def _by_pieces(score: Callable[[pa.Array, pa.Array], np.ndarray], a: pa.Array, b: pa.Array) -> np.ndarray:
    """The score of all rows, some at a time; a row of more tokens is taken by itself."""
    out, at = [np.zeros(0)], 0
    ends = sum(np.cumsum(pc.fill_null(pc.list_value_length(x), 0), dtype=np.int64) for x in (a, b))
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_TOKENS, side="right")))
        out.append(score(a.slice(at, stop - at), b.slice(at, stop - at)))
        at = stop
    return np.concatenate(out)


def bm25_pairs(a: pa.Array, b: pa.Array, k1: float = 1.2, length_weight: float = 0.75) -> np.ndarray:
    """Tokens of a as the query over the two documents: b's score over the larger one; 0 if none is positive."""
    return _by_pieces(lambda x, y: _bm25_pairs(x, y, k1, length_weight), a, b)


def _bm25_pairs(a: pa.Array, b: pa.Array, k1: float, length_weight: float) -> np.ndarray:
    la, lb, row, n, other, *_ = _counts(a, b)
    mean = np.maximum((la + lb) / 2.0, 0.5)
    idf = np.where(other > 0, math.log(1.2), math.log(2.0))

    def total(tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        norm = (k1 * (1 - length_weight + length_weight * size / mean))[row]
        return np.bincount(row, np.where(tf > 0, n * idf * tf * (k1 + 1) / (tf + norm), 0.0), len(la))

    sb = total(other, lb)
    top = np.maximum(total(n, la), sb)
    return np.where(top > 0, sb / np.where(top > 0, top, 1.0), 0.0)


def tfidf_pairs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Cosine of the two documents' weights; 1 for two empty ones, 0 for one."""
    return _by_pieces(_tfidf_pairs, a, b)


def _tfidf_pairs(a: pa.Array, b: pa.Array) -> np.ndarray:
    la, lb, row, n, other, row_b, n_b, other_b = _counts(a, b)
    alone = math.log(1.5) + 1.0

    def size(row: np.ndarray, n: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.sqrt(np.bincount(row, (n * np.where(other > 0, 1.0, alone)) ** 2, len(la)))

    dot = np.bincount(row, n * other.astype(np.float64), len(la))
    norm = size(row, n, other) * size(row_b, n_b, other_b)
    return np.where(norm > 0, dot / np.where(norm > 0, norm, 1.0), ((la == 0) & (lb == 0)).astype(np.float64))
