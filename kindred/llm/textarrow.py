"""Arrow helpers of the text operators: whole texts in, flat numpy arrays out."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Bytes of text that are split into words at a time.
PIECE = 1_000_000


def _taken(held: list[pa.RecordBatch]) -> pa.Table:
    table = pa.Table.from_batches(held)
    held.clear()
    return table


def blocks(batches: Iterator[pa.RecordBatch], max_bytes: int = 24_000_000, text: str = "text") -> Iterator[pa.Table]:
    """Regroup a partition's batches into tables of about max_bytes of text; a single longer row is a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        col = batch.column(text)
        if batch.num_rows == 0:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + max_bytes - size, side="right"))
            stop = max(stop, start + (not held))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - before)
            if stop < batch.num_rows or size >= max_bytes:
                size = 0
                yield _taken(held)
            start = stop
    if held:
        yield _taken(held)


def strings(table: pa.Table | pa.RecordBatch, name: str = "text") -> pa.Array:
    """A column as one large_string array, nulls as empty texts."""
    col = table.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.cast(pa.large_string()).combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(col.cast(pa.large_string()), "")


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words per text, code of each word in order, distinct words). Words are [^\\x20\\x09-\\x0D]+; only A-Z is lowered."""
    pers, found, named, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [pa.array([], texts.type)], 0
    for some in _pieces(texts):  # words take several times the room of their text
        parts = pc.ascii_split_whitespace(pc.ascii_lower(some) if lower else some)
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        encoded = parts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        pers.append(np.diff(offsets))
        found.append(np.asarray(encoded.indices, dtype=np.int32) + np.int32(seen))
        named.append(encoded.dictionary)
        seen += len(encoded.dictionary)
    merged = pa.concat_arrays(named).dictionary_encode()
    place, words = np.asarray(merged.indices, dtype=np.int32), merged.dictionary
    per, codes = np.concatenate(pers), np.concatenate([place[x] for x in found])
    empty = np.asarray(pc.equal(pc.binary_length(words), 0))
    if empty.any():
        keep = ~empty[codes]
        owner = np.repeat(np.arange(len(per)), per)
        per = np.bincount(owner[keep], minlength=len(per))
        codes = codes[keep]
    return per.astype(np.int64), codes, words


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def give_back() -> None:
    """Free memory of this worker to the system, which else stays with it through all later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
