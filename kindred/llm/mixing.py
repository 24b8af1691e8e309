"""Mixing sources to target weights by pivotal dependent rounding.

Every document has the fractional copies target / source size of its source. Their whole parts are taken; the fractions
are rounded in pairs: words move from one document of a source to another until one of the two fractions is 0 or 1, in
the direction that keeps each fraction's expectation. So the words a source takes stay at its target throughout. Leaves
of a source, cut by a hash of the id, are rounded in streams that hold one open fraction, and what they leave is combined
level by level in the same way. The one fraction that a source has left at the end is not drawn, which could miss the
target by as much as its longest document: that document is taken in part, its first words as often as the fraction says.
A source thus takes its target to within half a word.

Defined results: a null text has size 0 and takes 0 words; a null source is one more source, the last; a source without
words has target 0; repeated rows are rounded each; an empty table gives an empty result; all draws are hashes of the
ids, so reruns agree; other columns of the input are carried by apply() only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.runtime import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources are broadcast to the documents; more are joined on the source and a salt.
SMALL = 20_000
EPS = 1e-12


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's partition and place in it."""
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n, dtype=np.int64))], [*batch.schema.names, "part", "place"])
        place += n


def targets(ws: Workspace, sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, small: int = SMALL) -> DataFrame:
    """Adds target to source, source_size, source_docs: weights repeat over the sources by code point, null last; none exceeds most times its size.

    The excess of those that would is shared again by weight until none is above; a pass of that is one aggregate. Up to
    `small` sources are ranked in one task; more are ranked in ranges, of which the driver sees the sizes alone.
    """
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    if sources.count() <= small:
        ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(order)) - 1)
    else:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sources.schema)
        ranges = ws.write(sources.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(_number, f"{schema}, part int, place long"), "ranges")
        before, sums = 0, []
        for part, n in sorted(map(tuple, ranges.groupBy("part").count().collect())):
            sums.append((part, before))
            before += n
        ranked = ranges.join(F.broadcast(spark.createDataFrame(sums, "part int, before long")), "part").withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    df = ws.write(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).drop("rank"), "weighted")
    level, stopped = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        n, caps, open_, all_ = df.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum("source_size")).first()
        if n == stopped or not open_:
            break
        stopped, level = n, (all_ - caps) / open_
    return df.select("source", "source_size", "source_docs", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """Draws in (0, 1) from 64-bit mixes of the ids."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def pivot(open_: tuple[float, float], new: tuple[float, float], u: float) -> tuple[float, float]:
    """The two fractions after words moved between documents of (fraction, size); at least one is 0 or 1."""
    (p, w), (q, v) = open_, new
    up, down = min((1 - p) * w, q * v), min(p * w, (1 - q) * v)
    if u * (up + down) < down:  # the open one gains
        return (1.0, q - up / v) if (1 - p) * w <= q * v else (p + up / w, 0.0)
    return (0.0, q + down / v) if p * w <= (1 - q) * v else (p - down / w, 1.0)


def _whole(p: float) -> bool:
    return p < EPS or p > 1 - EPS


def _rounds(seed: int, final: bool):
    """A stream over rows sorted by (source, leaf): all fractions of a leaf are decided but one; final leaves it as the part taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # key, row, fraction
        schema = None

        def close(rows: list, copies: list, rest: list) -> None:
            nonlocal state
            if state is not None:
                _, row, p = state[:3]
                rows.append(row)
                copies.append(int(p > 0.5) if _whole(p) else 0 if final else None)
                rest.append(None if _whole(p) else p)
                state = None

        def emit(rows: list, copies: list, rest: list) -> pa.RecordBatch:
            held = pa.Table.from_batches(rows).combine_chunks()
            base = np.asarray(held.column("base"), dtype=np.int64)
            given = pa.array([None if c is None else c + int(b) for c, b in zip(copies, base)], pa.int64())
            names = ["doc_id", "row", "source", "size", "source_size", "target", "base"]
            return pa.RecordBatch.from_arrays([*(held.column(n).combine_chunks() for n in names), pa.array(rest, pa.float64()), given], [*names, "p", "copies"])

        for batch in batches:
            schema = batch.schema
            n = batch.num_rows
            sources, leaves = batch.column("source").to_pylist(), batch.column("leaf").to_pylist()
            p = batch.column("p").to_pylist()
            size = batch.column("size").to_pylist()
            ids = np.asarray(batch.column("doc_id").fill_null(0), dtype=np.int64)
            draws, ends = _uniform(ids, seed).tolist(), _uniform(ids, seed + 7919).tolist()
            rows, copies, rest = [], [], []
            decided: list[int | None] = [None] * n
            left: list[float | None] = [None] * n
            for i in range(n):
                key = (sources[i], leaves[i])
                if state is not None and state[0] != key:
                    if isinstance(state[1], int):
                        kept, at = state[2], state[1]
                        if _whole(kept):
                            decided[at] = int(kept > 0.5)
                        else:
                            decided[at], left[at] = 0 if final else None, kept
                        state = None
                    else:
                        close(rows, copies, rest)
                q = p[i]
                if size[i] == 0:
                    decided[i] = int(q > 1 - EPS or (q >= EPS and ends[i] < q))
                    continue
                if _whole(q):
                    decided[i] = int(q > 0.5)
                    continue
                if state is None:
                    state = [key, i, q, size[i]]
                    continue
                a, b = pivot((state[2], state[3]), (q, size[i]), draws[i])
                if _whole(a):
                    if isinstance(state[1], int):
                        decided[state[1]] = int(a > 0.5)
                    else:
                        rows.append(state[1])
                        copies.append(int(a > 0.5))
                        rest.append(None)
                    state = None
                    if _whole(b):
                        decided[i] = int(b > 0.5)
                    else:
                        state = [key, i, b, size[i]]
                else:
                    decided[i] = int(b > 0.5)
                    state[2] = a
            if state is not None and isinstance(state[1], int):
                at = state[1]
                state[1] = batch.slice(at, 1)
                keep = [j for j in range(n) if j != at]
                rows.append(batch.take(pa.array(keep, pa.int64())))
                copies.extend(decided[j] for j in keep)
                rest.extend(left[j] for j in keep)
            else:
                rows.append(batch)
                copies.extend(decided)
                rest.extend(left)
            yield emit(rows, copies, rest)
        if state is not None and schema is not None:
            rows, copies, rest = [], [], []
            close(rows, copies, rest)
            yield emit(rows, copies, rest)

    return run


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, part (words of one more, cut copy), taken (copies * size + part).

    Options: weights, most, leaf_docs (documents of a leaf), seed, small (sources up to which they are broadcast).
    """
    return _mix(docs.withColumn("_row", F.lit(0).cast("long")), **options).drop("row")


def _mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, leaf_docs: int = 50_000, seed: int = 11, small: int = SMALL) -> DataFrame:
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    sizes = ws.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_row").alias("row"), F.col("source").cast("string").alias("source"), words.alias("size")), "sizes")
    per_source = ws.write(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs")), "per-source")
    sources = ws.write(targets(ws, per_source, weights, most, small).withColumn("leaves", F.ceil(F.col("source_docs") / leaf_docs)), "sources")
    known, leaves = sources.agg(F.count(F.lit(1)), F.max("leaves")).first()
    if known <= small:
        few = F.broadcast(sources.drop("source_docs"))
        rows = sizes.join(few, sizes["source"].eqNullSafe(few["source"])).drop(few["source"])
    else:
        salt: Column = F.pmod(F.xxhash64("doc_id", "row", F.lit(1)), F.lit(32))
        spread = sources.drop("source_docs").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
        left = sizes.withColumn("salt", salt)
        rows = left.join(spread, left["source"].eqNullSafe(spread["source"]) & (left["salt"] == spread["salt"])).drop(spread["source"]).drop("salt")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(f + EPS)).withColumn("p", F.greatest(f - F.col("base"), F.lit(0.0)))
    level, leaves = 0, int(leaves or 1)
    done: list[DataFrame] = []
    while True:
        count = F.lit(1) if leaves == 1 else F.least(F.col("leaves"), F.lit(leaves)) if "leaves" in rows.columns else F.lit(leaves)
        keyed = rows.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "row", "size", F.lit(level)), count).cast("int")).select("doc_id", "row", "source", "size", "source_size", "target", "base", "p", "leaf")
        order = keyed.repartition("source", "leaf").sortWithinPartitions(F.col("source").asc_nulls_last(), "leaf", F.col("size").desc(), "doc_id", "row")
        out = order.mapInArrow(_rounds(seed + level, leaves == 1), "doc_id long, row long, source string, size long, source_size long, target double, base long, p double, copies long")
        out = ws.write(out, f"level{level}")
        done.append(out.where(F.col("copies").isNotNull()))
        if leaves == 1:
            break
        rows = out.where(F.col("copies").isNull()).drop("copies")
        leaves, level = math.ceil(leaves / leaf_docs), level + 1
    all_ = done[0]
    for x in done[1:]:
        all_ = all_.unionByName(x)
    part = F.round(F.coalesce("p", F.lit(0.0)) * F.col("size")).cast("long")
    all_ = all_.withColumn("part", part)
    return all_.select("doc_id", "row", "source", "size", "source_size", "target", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    led = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(led, F.lit(1), n.cast("int")), "")


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns; a part taken is one more row, whose text
    is cut and whose n_chars, where there is one, is brought up to date.

    Where ids repeat, rows are told apart by their places in a written copy of the table.
    """
    names = docs.columns
    place = {c: f"_c{i}" for i, c in enumerate(names)}
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in place.items()))
    key = F.col(place["doc_id"]).cast("long")
    if inner.groupBy(key).count().where("count > 1").isEmpty():
        inner = inner.withColumn("_row", F.lit(0).cast("long"))
        on = F.col("_key").eqNullSafe(F.col("_id"))
    else:
        inner = Workspace(docs.sparkSession, "mix-rows").write(inner.withColumn("_row", F.monotonically_increasing_id()), "rows")
        on = F.col("_row") == F.col("_of")
    given = _mix(inner.select(F.col(place["doc_id"]).alias("doc_id"), F.col(place["text"]).alias("text"), F.col(place["source"]).alias("source"), "_row"), **options)
    given = given.select(F.col("doc_id").alias("_id"), F.col("row").alias("_of"), F.col("copies").alias("_copies"), F.col("part").alias("_part"))
    given = given.where("_copies > 0 or _part > 0")
    joined = inner.withColumn("_key", key).join(given.hint("shuffle_hash"), on)
    last = F.when(F.col("_part") > 0, F.array(F.col("_part"))).otherwise(F.array().cast("array<bigint>"))
    joined = joined.withColumn("_cut", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("_copies").cast("int")), last)))
    made = {c: F.col(n) for c, n in place.items()}
    cut = F.when(F.col("_cut") > 0, first_words(F.col(place["text"]), F.col("_cut"))).otherwise(F.col(place["text"]))
    if "n_chars" in made:
        made["n_chars"] = F.when(F.col("_cut") > 0, F.char_length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(made["n_chars"])
    made["text"] = cut
    return joined.select(*(c.alias(name) for name, c in made.items()))
