r"""Removal of repeated substrings by bucket-pointer refinement over suffix buckets.

A byte goes when a string of `length` bytes that covers it also starts earlier. As in bucket-pointer refinement, suffixes
get a first bucket from their q-gram, and longer prefixes get theirs from the bucket identifiers at later offsets:
identifier(2k) at i is a mix of identifier(k) at i and at i + k, so 1, 2, 4 ... 64 bytes reuse what was found before, and
any longer string is named by identifiers at two or three offsets. Identifiers are hashes, the same on every executor.

Not all suffixes are shuffled. Of the q-grams in a window of `length` bytes, the one of smallest identifier is its anchor;
equal windows have equal anchors at equal offsets, and neighbouring windows mostly share theirs. Such a run of windows is
one row: bucket (anchor's identifier), name of all the bytes the run spans. Rows of a bucket with the same name repeat each
other as a whole, and all but the first are done. Buckets of one row, or of one name, are never looked at again. What is
left open is refined: into parts of a run, in buckets named by what all windows of a part have in common, and these into
single windows. Texts are reread for that, not shuffled, while the open rows are few enough to be sent to the tasks; only
the bytes that open rows span are looked at, and their anchors found anew.

Blocks resolve what repeats within them before anything is shuffled, so a passage that a third of all documents hold is
sent once per block. Names have 64 bits of their own: however many rows share an anchor, and so a bucket, m of them with
different names are taken for each other with a chance of about m * m / 2**65. Bytes are not compared.

Rows of a bucket meet in one task, but for the hot buckets, such as that of an anchor in a passage that very many blocks
hold after different text: of these the first row of each name is found by a pre-aggregated minimum, and the others by a
join with that.

Texts are UTF-8 bytes; matches never cross documents. Defined results: a null text is empty; texts shorter than `length`
keep all; rows that share an id are told apart, in the order of a written copy of the table; a null id comes before all; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.hot import LEAST, hot_keys
from kindred.llm.textarrow import blocks, strings
from kindred.runtime import Workspace

Q = 32
#: Windows of a part of a run.
STEP = 8
#: Up to so many open rows, or removed runs, are sent to the tasks (13 or 16 bytes each); more are joined to the documents.
MOST_SENT = 3_000_000
#: About so many positions have their identifiers in memory at once; few enough for these to stay in a core's cache.
CHUNK = 1 << 16
#: Bits of a position in a piece, in the place of the last bits of an identifier: anchors are the least of these.
BITS = np.uint64(4 * CHUNK - 1)
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_MULT = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a * _MULT[level]
    x ^= x >> np.uint64(31)
    x += b
    x *= _MULT[level + 8]
    return x


def identifiers(data: np.ndarray) -> np.ndarray:
    """Identifiers of the 32 bytes from each position; data is padded so that each has them."""
    h, k = _BYTE[data], 1
    for level in range(5):
        h = _mix(h[:-k], h[k:], level)
        k *= 2
    return h


def name(h32: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Names of strings of 64 to 192 bytes from the identifiers of 64 bytes at two or three offsets."""

    def h64(at: np.ndarray) -> np.ndarray:
        return _mix(h32[at], h32[at + Q], 5)

    x = _mix(h64(start), h64(start + np.minimum(64, size - 64)), 6)
    return _mix(x, h64(start + size - 64), 7) + size.astype(np.uint64)


def _owner(ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return _mix(ids.view(np.uint64), nth.astype(np.uint64), 4)


def _piece(data: np.ndarray, spans: Iterator[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers in the spans of data, one after the other, and these with their places as the last bits."""
    h32 = identifiers(np.concatenate([*(data[a:b] for a, b in spans), np.zeros(256, np.uint8)]))
    key = h32 & ~BITS
    key |= np.arange(len(h32), dtype=np.uint64)
    return h32, key


_NONE = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, bucket, name) of each run of windows of equal anchors; documents are slices of data."""
    out: list[tuple[np.ndarray, ...]] = [_NONE]
    width = length - Q + 1
    pieces: list[list[tuple[int, int, int]]] = [[]]  # (document, first window, windows) of about CHUNK windows together
    held = 0
    for d, n in enumerate(np.maximum(sizes - length + 1, 0).tolist()):
        at = 0
        while at < n:
            if held >= CHUNK:
                pieces.append([])
                held = 0
            took = min(n - at, CHUNK)
            pieces[-1].append((d, at, took))
            held += took + length
            at += took
    for piece in pieces:
        if not piece:
            continue
        d, at, took = np.array(piece).T
        left = starts[d] + at
        h32, key = _piece(data, zip(left.tolist(), (left + took + length - 1).tolist()))
        span = 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        begin = np.cumsum(took + length - 1) - (took + length - 1)
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        new[begin] = True
        new[begin + took] = True  # the windows from here cross into the next document
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        of = np.searchsorted(begin, first, "right") - 1
        inside = first < (begin + took)[of]
        first, last, of = first[inside], last[inside], of[inside]
        anchor = (key[first] & BITS).astype(np.int64)
        shift = (at - begin)[of]  # from places in the piece to windows of the document
        out.append((d[of], first + shift, last + shift, h32[anchor], name(h32, first, last - first + length).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def parts(data: np.ndarray, starts: np.ndarray, length: int, level: int, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """What runs gives, for the parts of the open rows, which are sorted by document and first window.

    Level 1 cuts runs at offsets from the anchor that are multiples of STEP; such a part's bucket is named by what all its
    windows have in common. Level 2 cuts these parts into single windows. Only the bytes of the open rows are looked at:
    all windows of one have the same anchor, which is the first of the least identifiers in any of them, so in all.
    """
    out: list[tuple[np.ndarray, ...]] = [_NONE]
    width = length - Q + 1
    start, stop = starts[doc] + first, starts[doc] + last + length
    if not len(doc):
        return _NONE
    ahead = np.concatenate([[0], np.maximum.accumulate(stop)[:-1]])
    size = np.cumsum(np.maximum(stop - np.maximum(start, ahead), 0))  # bytes up to each row
    cuts = np.unique(np.searchsorted(size, np.arange(0, size[-1], CHUNK)))
    for rows in map(slice, cuts.tolist(), [*cuts[1:].tolist(), len(doc)]):
        a, z = start[rows], np.maximum.accumulate(stop[rows])
        new = np.concatenate([[True], a[1:] > z[:-1]])  # rows that overlap or touch are one span
        left = a[new]
        right = z[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
        h32, key = _piece(data, zip(left.tolist(), right.tolist()))
        f = a + (np.cumsum(right - left) - right)[np.cumsum(new) - 1]
        n = last[rows] - first[rows]
        ends = np.stack([f, f + n + width], 1).ravel()
        anchor = (np.minimum.reduceat(key, ends)[::2] & BITS).astype(np.int64)
        bucket = h32[anchor]
        for k in range(level):
            step = STEP if k == 0 else 1
            if k + 1 < level:  # the row is one part already
                j, each, p = (anchor - f) // step, np.arange(len(f)), (f, f + n)
            else:
                low, count = (anchor - f - n) // step, (anchor - f) // step - (anchor - f - n) // step + 1
                each = np.repeat(np.arange(len(f)), count)
                j = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                p = np.maximum(f[each], anchor[each] - step * j - step + 1), np.minimum((f + n)[each], anchor[each] - step * j)
            common = name(h32, anchor[each] - step * j, np.full(len(j), length - step + 1))
            bucket = _mix(_mix(bucket[each], common, 6), j.astype(np.uint64), 7)
        shift = (first[rows] - f)[each]
        out.append((doc[rows][each], p[0] + shift, p[1] + shift, bucket, name(h32, p[0], p[1] - p[0] + length).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start and size of each text)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id with null as the smallest long, nth, rank of each row in their order)."""
    ids = np.asarray(pc.fill_null(table.column("doc_id"), -(2**63)), dtype=np.int64)
    nth = np.asarray(table.column("nth"), dtype=np.int64)
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((nth, ids))] = np.arange(len(ids))
    return ids, nth, rank


def _open_rows(table: pa.Table, ids: np.ndarray, nth: np.ndarray, sizes: np.ndarray, length: int, sent) -> tuple[np.ndarray, ...]:
    """(document, first window, last window) of the open rows, sorted; they are sent, or each document brings its own."""
    if sent is not None:
        owners, firsts, mores = sent.value
        own = _owner(ids, nth)
        low = np.searchsorted(owners, own, "left")
        count = np.searchsorted(owners, own, "right") - low
        doc = np.repeat(np.arange(len(ids)), count)
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(doc))
        first, more = firsts[at].astype(np.int64), mores[at]
    else:
        lists = table.column("open").combine_chunks()
        doc = np.repeat(np.arange(len(ids)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))
        key = np.asarray(lists.flatten(), dtype=np.int64)
        first, more = key >> 8, key & 255
    last = first + more
    order = np.lexsort((first, doc))
    order = order[last[order] + length <= sizes[doc[order]]]  # owners are hashes where ids repeat
    return doc[order], first[order], last[order]


def _again(doc: np.ndarray, first: np.ndarray, bucket: np.ndarray, names: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which rows have the bucket and name of an earlier one."""
    out = np.zeros(len(doc), bool)
    order = np.argsort(bucket)
    b = bucket[order]
    same = np.concatenate([[False], b[1:] == b[:-1], [False]])
    some = order[same[1:] | same[:-1]] if len(order) else order  # the others are alone in their bucket
    some = some[np.lexsort((first[some], rank[doc[some]], names[some], bucket[some]))]
    b, n = bucket[some], names[some]
    out[some[1:][(b[1:] == b[:-1]) & (n[1:] == n[:-1])]] = True
    return out


_ROWS = "kind byte, bucket long, name long, doc_id long, nth long, first int, last int"


def _table(kind: int, bucket: np.ndarray, names: np.ndarray, ids: np.ndarray, nth: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
    return pa.table({"kind": np.full(len(ids), kind, np.int8), "bucket": bucket.view(np.int64), "name": names, "doc_id": ids, "nth": nth, "first": first.astype(np.int32), "last": last.astype(np.int32)})


def _rows(length: int, level: int, sent):
    """Rows of kind 0, the first of each bucket and name in a block, and of kind 1, the spans they resolve.

    The open rows are sent, or each document brings its own in a column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, 16_000_000 if level == 0 else 8_000_000):
            ids, nth, rank = _keys(table)
            data, starts, sizes = _bytes(strings(table))
            if level:
                found = parts(data, starts, length, level, *_open_rows(table, ids, nth, sizes, length, sent))
            else:
                found = runs(data, starts, sizes, length)
            doc, first, last, bucket, names = found
            again = _again(doc, first, bucket, names, rank)
            for kind in range(2):
                some = np.flatnonzero(again == kind)
                yield from _table(kind, bucket[some], names[some], ids[doc[some]], nth[doc[some]], first[some], last[some]).to_batches()

    return run


def _merge(length: int):
    """Removed runs of each document from the windows that repeat: neither overlapping nor touching, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for fs, ls in zip(batch.column("firsts"), batch.column("lasts")):
                f, stop = np.asarray(fs.values, dtype=np.int32), np.asarray(ls.values, dtype=np.int32) + length
                order = np.argsort(f, kind="stable")
                f, stop = f[order], np.maximum.accumulate(stop[order])
                new = np.concatenate([[True], f[1:] > stop[:-1]])
                starts.append(f[new])
                ends.append(stop[np.append(np.flatnonzero(new)[1:] - 1, len(f) - 1)])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("nth"), pa.array(starts, kind), pa.array(ends, kind)], ["doc_id", "nth", "starts", "ends"])

    return run


def _removed(sent):
    """The result of each document; the removed runs are sent, or each document brings its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, 8_000_000):
            data, begins, sizes = _bytes(strings(table))
            raw = memoryview(data)
            if sent is not None:
                owners, at, to = sent.value
                ids, nth, _ = _keys(table)
                own = _owner(ids, nth)
                lo, hi = np.searchsorted(owners, own, "left"), np.searchsorted(owners, own, "right")
                lists = [(at[x:y].tolist(), to[x:y].tolist()) for x, y in zip(lo, hi)]
            else:
                lists = list(zip(*(table.column(c).to_pylist() for c in ("starts", "ends"))))
            out: list[list] = [[], [], [], [], []]
            for begin, n, (gone_at, gone_to) in zip(begins.tolist(), sizes.tolist(), lists):
                gone_at, gone_to = gone_at or [], gone_to or []
                h, k, removed = hashlib.sha256(), 0, 0
                for a, b in zip(gone_at, gone_to):
                    h.update(raw[begin + k : begin + a])
                    k, removed = b, removed + b - a
                h.update(raw[begin + k : begin + n])
                for x, y in zip(out, (n, removed, len(gone_at), h.hexdigest(), [{"start": a, "end": b} for a, b in zip(gone_at, gone_to)])):
                    x.append(y)
            spans = pa.array(out[4], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            ids = table.column("doc_id").combine_chunks()
            ids = pc.if_else(table.column("unnamed").combine_chunks(), pa.scalar(None, pa.int64()), ids)
            yield from pa.table({"doc_id": ids, "n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "n_spans": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string()), "spans": spans}).to_batches()

    return run


def _sift(ws: Workspace, rows: DataFrame, name: str, least: int) -> DataFrame:
    """Rows that are done (they repeat an earlier one) or open (the first of one of several names in a bucket)."""
    columns = ("bucket", "name", "doc_id", "nth", "first", "last")
    hot = hot_keys(rows, "bucket", ("doc_id", "nth", "first"), least=least)
    some = rows if hot is None else rows.join(F.broadcast(hot), "bucket", "left_anti")
    of = Window.partitionBy("bucket", "name").orderBy("doc_id", "nth", "first")
    bucket = Window.partitionBy("bucket")
    seen = some.repartition("bucket").withColumn("place", F.row_number().over(of)).withColumn("low", F.min("name").over(bucket)).withColumn("high", F.max("name").over(bucket))
    found = seen.where("place > 1 or low <> high").select((F.col("place") > 1).alias("done"), *columns)
    if hot is None:
        return found
    many = ws.write(rows.join(F.broadcast(hot), "bucket", "left_semi").select(*columns), f"hot-{name}")
    own = F.struct("doc_id", "nth", "first", "last")
    heads = ws.write(many.groupBy("bucket", "name").agg(F.min(own).alias("head"), F.count(F.lit(1)).alias("rows")), f"heads-{name}")
    several = heads.groupBy("bucket").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("bucket")
    firsts = heads.join(F.broadcast(several), "bucket", "left_semi").select(F.lit(False).alias("done"), "bucket", "name", "head.*")
    later = many.join(heads.where("rows > 1").drop("rows"), ["bucket", "name"]).where(own != F.col("head")).select(F.lit(True).alias("done"), *columns)
    return found.unionByName(firsts).unionByName(later)


def _collected(rows: DataFrame, unique: bool, *columns: str) -> tuple[np.ndarray, ...]:
    """Owner and columns of all rows, sorted by owner and first column; nth stays where ids are unique, as it is 0."""
    ids, *rest = (x.to_numpy() for x in rows.select("doc_id", *(() if unique else ("nth",)), *columns).toArrow().columns)
    nth = np.zeros(len(ids), np.int64) if unique else rest.pop(0)
    own = _owner(np.ascontiguousarray(ids), nth)
    order = np.lexsort((rest[0], own))
    return own[order], *(x[order] for x in rest)


def repeats(docs: DataFrame, *, length: int = 100, most_sent: int = MOST_SENT, hot_rows: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of the removed runs).

    A bucket of more than hot_rows rows (and a ten-thousandth of all) is hot.
    """
    if not 64 + STEP <= length <= 128:
        raise ValueError(f"length must be from {64 + STEP} to 128 bytes")
    spark = docs.sparkSession
    ws = Workspace(spark, "suffixes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    unique = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    if unique:
        docs = docs.withColumn("nth", F.lit(0).cast("long"))
    else:
        docs = ws.write(docs.withColumn("nth", F.monotonically_increasing_id()), "docs")
    least = F.lit(-(2**63)).cast("long")
    docs = docs.select(F.coalesce("doc_id", least).alias("doc_id"), "nth", "text", F.col("doc_id").isNull().alias("unnamed"))
    texts = docs.drop("unnamed")

    spans: list[DataFrame] = []
    keys: DataFrame | None = None
    for level in range(3):
        given, sent = texts, None
        if level:
            if keys.count() <= most_sent:
                sent = spark.sparkContext.broadcast(_collected(keys, unique, "first", "more"))
            else:
                key = F.shiftleft(F.col("first").cast("long"), 8) + F.col("more")
                lists = keys.groupBy("doc_id", "nth").agg(F.collect_list(key).alias("open"))
                given = texts.join(lists.hint("shuffle_hash"), ["doc_id", "nth"])
        rows = ws.write(given.mapInArrow(_rows(length, level, sent), _ROWS), f"rows-{level}")
        found = ws.write(_sift(ws, rows.where("kind = 0"), str(level), hot_rows), f"found-{level}")
        done = rows.where("kind = 1").select("doc_id", "nth", "first", "last").union(found.where("done").select("doc_id", "nth", "first", "last"))
        spans.append(ws.write(done, f"spans-{level}"))
        ws.drop(f"rows-{level}", f"hot-{level}", f"heads-{level}")
        if level < 2:
            more = (F.col("last") - F.col("first")).cast("byte").alias("more")  # a run has up to 97 windows
            keys = ws.write(found.where("not done").select("doc_id", "nth", "first", more), f"keys-{level}")
        ws.drop(f"found-{level}")
    all_ = spans[0].union(spans[1]).union(spans[2])
    gone = all_.groupBy("doc_id", "nth").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    gone = ws.write(gone.mapInArrow(_merge(length), "doc_id long, nth long, starts array<int>, ends array<int>"), "gone")
    ws.drop("spans-0", "spans-1", "spans-2", "keys-0", "keys-1")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    if (gone.agg(F.sum(F.size("starts"))).first()[0] or 0) <= most_sent:
        flat = gone.select("doc_id", "nth", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("doc_id", "nth", "x.starts", "x.ends")
        return docs.mapInArrow(_removed(spark.sparkContext.broadcast(_collected(flat, unique, "starts", "ends"))), fields)
    return docs.join(gone.hint("shuffle_hash"), ["doc_id", "nth"], "left").mapInArrow(_removed(None), fields)
