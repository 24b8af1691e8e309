"""Cost-balanced packing of token ids into fixed-length training sequences.

Attention costs a piece of n tokens ``linear * n + quadratic * n * n``. Every document is cut into full sequences and
one shorter rest; rests go, longest first, to the sequence of lowest cost that has room for all of it, found in an index by
free capacity; where no sequence has, to the one of lowest cost with any room, and what does not fit waits its turn again. A block of documents is packed by the task that tokenises it, so nothing is
shuffled, and a block has as many sequences as its tokens fill: no padding. What is left of a block, less than one
sequence, goes into sequences whose lengths are the powers of two that sum to it; those need no padding either.

Defined results: a null text is an empty one and has the end id alone; repeated rows are packed each; an empty table
gives no pieces; very long texts are cut over many sequences; equal lengths keep the order of ids, and then of rows;
other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.textarrow import blocks, strings
from kindred.runtime import ship

#: Unicode white space, and what some tables count as such.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Token ids of many texts at once: each distinct space-led run of a block is encoded once.

    The byte-level pattern joins a space to what precedes it only inside white space: both before it and after it, or at
    the end of the text. All other texts can be cut before each space; these, and those with a special token, are
    encoded whole.
    """

    #: Of this process, by path: the tokenizer and the ids of the runs seen first, at most KEPT of them (about 200 bytes each).
    _known: dict[str, tuple] = {}
    KEPT = 150_000

    def __init__(self, path: str, end_id: int = 1) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads only take from other tasks
        from tokenizers import Tokenizer

        if path not in self._known:
            self._known[path] = Tokenizer.from_file(path), {}
        self.tokenizer, self.cache = self._known[path]
        self.end_id = end_id
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as unsigned 32-bit values."""
        out = list(map(self.cache.get, pieces))
        new = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for i, x in zip(some, self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)):
                out[i] = array("I", x.ids).tobytes()
        room = self.KEPT - len(self.cache)
        self.cache.update((pieces[i], out[i]) for i in new[: max(room, 0)] if len(pieces[i]) < 40)
        return out

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each text's followed by the end id; their number per text)."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = np.asarray(pc.match_substring_regex(texts, rf"{SPACE} (?:{SPACE}|\z)"))
        for token in self.special:
            whole |= np.asarray(pc.match_substring(texts, token))
        parts = pc.split_pattern(pc.if_else(pa.array(~whole), texts, pa.scalar("", pa.large_string())), " ")
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        encoded = parts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        codes, words = np.asarray(encoded.indices, dtype=np.int64), encoded.dictionary.to_pylist()
        offsets = offsets - offsets[0]
        first = offsets[:-1]
        heads = codes[first]
        used, codes[first] = np.unique(heads, return_inverse=True)
        codes[first] += len(words)
        odd = np.flatnonzero(whole)
        codes[first[odd]] = len(words) + len(used) + np.arange(len(odd))
        source = [" " + w for w in words] + [words[i] for i in used] + texts.take(pa.array(odd)).to_pylist()
        ids = self.encode(source)
        ids.append(np.uint32(self.end_id).tobytes())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), np.uint32)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        end = len(source)
        del source, words, parts, encoded, ids
        counts = np.add.reduceat(lengths[codes], first) + 1
        out = np.empty(int(counts.sum()), np.uint32)
        doc, filled = 0, 0
        while doc < n:  # documents a few at a time, as each step needs several arrays as long as its ids
            stop = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + 400_000, side="right")) - 1)
            some = np.insert(codes[offsets[doc] : offsets[stop]], offsets[doc + 1 : stop + 1] - offsets[doc], end)
            took = lengths[some]
            ends = np.cumsum(took)
            index = np.repeat(starts[some] - (ends - took), took)
            index += np.arange(len(index))
            out[filled : filled + len(index)] = table[index]
            doc, filled = stop, filled + len(index)
        return out, counts


class Sequences:
    """Open sequences by free capacity: a heap of (cost, sequence) per capacity, under a tree of the least of each range."""

    def __init__(self, bins: int, size: int) -> None:
        self.leaves = 1 << size.bit_length()  # capacities 0 to size
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
        self.heaps[size] = [(0.0, s) for s in range(bins)]
        none = (math.inf, 0)
        self.tree = [none] * (2 * self.leaves)
        self._raise(size)

    def _raise(self, room: int) -> None:
        tree, heap, at = self.tree, self.heaps[room], room + self.leaves
        tree[at] = heap[0] if heap else (math.inf, 0)
        while at > 1:
            at >>= 1
            x, y = tree[2 * at], tree[2 * at + 1]
            new = x if x <= y else y
            if tree[at] == new:
                break
            tree[at] = new

    def _least(self, room: int) -> tuple[float, int]:
        """The least of all with at least this room."""
        tree, at = self.tree, room + self.leaves
        best = tree[at]
        while at > 1:
            if not at & 1 and tree[at + 1] < best:
                best = tree[at + 1]
            at >>= 1
        return best

    def any(self, room: int = 1) -> bool:
        return room < len(self.heaps) and self._least(room)[0] < math.inf

    def pop(self, room: int) -> tuple[float, int, int]:
        """(cost, sequence, free capacity) of the cheapest with at least this room, taken out."""
        best = self._least(room)
        at = room + self.leaves
        while self.tree[at] != best:  # up to a range that holds it, then down
            while at & 1:
                at >>= 1
            at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] == best else 2 * at + 1
        found = at - self.leaves
        heapq.heappop(self.heaps[found])
        self._raise(found)
        return *best, found

    def push(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._raise(room)


def assign(counts: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these token counts, in their order on a tie."""
    out = []
    sequence = 0
    rests: list[tuple[int, int, int]] = []  # (-length, document, start)
    for doc, n in enumerate(counts.tolist()):
        at = 0
        while n - at >= size:
            out.append((doc, at, size, sequence, 0))
            sequence += 1
            at += size
        if n > at:
            rests.append((at - n, doc, at))
    left = -sum(r[0] for r in rests)
    base, bins = sequence, left // size
    heapq.heapify(rests)
    open_ = Sequences(bins, size)
    while rests and open_.any():
        length, doc, at = heapq.heappop(rests)
        length = -length
        cost, s, room = open_.pop(length if open_.any(length) else 1)
        took = min(length, room)
        out.append((doc, at, took, base + s, size - room))
        if room > took:
            open_.push(cost + linear * took + quadratic * took * took, s, room - took)
        if took < length:
            heapq.heappush(rests, (took - length, doc, at + took))
    sequence = base + bins
    room = left - bins * size
    for power in [1 << b for b in range(room.bit_length() - 1, -1, -1) if room >> b & 1]:
        filled = 0
        while filled < power:
            length, doc, at = heapq.heappop(rests)
            took = min(-length, power - filled)
            out.append((doc, at, took, sequence, filled))
            filled += took
            if took < -length:
                heapq.heappush(rests, (took + length, doc, at + took))
        sequence += 1
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    size: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
    end_id: int = 1,
    block_bytes: int = 16_000_000,
    ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost and, with ids, the ids.

    sequence_id is unique over the whole result: the input partition above 2**32, its sequences below. A sequence's
    padded length is its size, or its own length where that is a power of two.
    """
    ship(docs.sparkSession)
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, end_id)
        sequence = TaskContext.get().partitionId() << 32
        for table in blocks(batches, block_bytes):
            doc_ids = np.asarray(pc.fill_null(table.column("doc_id"), 0), dtype=np.int64)
            nulls = np.asarray(pc.is_null(table.column("doc_id")))
            flat, counts = encoder.flat(strings(table))
            order = np.argsort(doc_ids, kind="stable")
            starts = np.concatenate([[0], np.cumsum(counts)])[order]
            pieces = np.array(assign(counts[order], size, linear, quadratic), dtype=np.int64).reshape(-1, 5)
            doc, at, length, seq, offset = pieces.T
            begin = starts[doc] + at
            raw = memoryview(np.ascontiguousarray(flat.astype("<u4"))).cast("B")
            crc = np.array([zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())], dtype=np.int64)
            columns = [
                pa.array(doc_ids[order][doc], mask=nulls[order][doc]),
                *(pa.array(x) for x in (at, length, crc, counts[order][doc], seq + sequence, offset)),
                pa.array(linear * length + quadratic * length.astype(np.float64) ** 2),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
            sequence += int(seq.max()) + 1 if len(seq) else 0
            step = 500 if ids else 1 << 20
            for k in range(0, len(doc), step):
                some = [c.slice(k, step) for c in columns]
                if ids:
                    b, n = begin[k : k + step], length[k : k + step]
                    ends = np.cumsum(n)
                    index = np.repeat(b - (ends - n), n) + np.arange(ends[-1])
                    some.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat[index].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(some, names + ["ids"] * ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)
