"""Threshold similarity joins with lossless blocking: candidates by equi-joins on small keys, then exact scores.

Texts are one row per distinct value, named by a number; only names, keys and fingerprints are joined, candidates are made
distinct by names, and texts (or what an algorithm prepares of them) are attached once per pair to be scored. Each algorithm
has keys such that two texts above the threshold share at least one: segments of an edit-distance partition, positions,
rare-first prefixes of gram, word or character sets or of weighted tokens, or bands of signatures.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.plans import algorithms as A
from kindred.plans.algorithms import Algorithm
from kindred.runtime import Workspace

SLACK = 1e-9
#: Pairs of up to so many edits are found by segments, others by their grams.
EDITS = 6
#: Sets share so many items of their prefixes, which are so much longer, before they are candidates.
COMMON = 3
#: Texts of up to so many characters get Hamming keys without the places that all of their length agree on, and so many keys at most.
SHORT, KEYS = 64, 64


def similarity_join(df: DataFrame, algorithm: str | Algorithm, threshold: float, *, key: str = "id", text: str = "text", other: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """index_a, index_b, score of pairs that score above the threshold (at or above, if not strict).

    With one frame its pairs with index_a < index_b, else those of df and other. NULL texts are in no pair.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold is from 0 to 1")
    algorithm = A.by_name(algorithm)
    itself = other is None
    ws = Workspace(df.sparkSession, "simjoin")
    h = (F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))

    def side(frame: DataFrame) -> DataFrame:
        return frame.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null and id is not null").select("id", "text", *h)

    left = side(df)
    right = left if itself else side(other)
    every = left if itself else left.unionByName(right)
    values = every.groupBy("h1", "h2").agg(F.first("text").alias("text")).select("h1", "h2", "text", algorithm.prepare(F.col("text")).alias("p"))
    enough = F.col("score") > threshold if strict else F.col("score") >= threshold

    def spread(scored: DataFrame, same: DataFrame, name: str, directed: bool) -> DataFrame:
        """Pairs of names, and names with themselves, as pairs of ids: a name's ids travel as one list until the last step."""
        parts = 4 * df.sparkSession.sparkContext.defaultParallelism
        ids = [ws.write(frame.select("id", "h1", "h2").join(named, ["h1", "h2"]).groupBy(F.col(name).alias(f"{name}_{s}")).agg(F.collect_list("id").alias(f"ids_{s}")), f"ids_{s}") for frame, s in ((left, "a"), (right, "b"))[: 1 if itself else 2]]
        if itself:
            ids.append(ids[0].select(F.col(f"{name}_a").alias(f"{name}_b"), F.col("ids_a").alias("ids_b")))
        elif not directed:
            scored = scored.union(scored.select(F.col(f"{name}_b").alias(f"{name}_a"), F.col(f"{name}_a").alias(f"{name}_b"), "score"))

        def out(pairs: DataFrame) -> DataFrame:
            met = pairs.join(ids[0], f"{name}_a").join(ids[1], f"{name}_b").select("ids_a", "ids_b", "score").repartition(parts)
            return met.select("ids_b", "score", F.explode("ids_a").alias("index_a")).select("index_a", F.explode("ids_b").alias("index_b"), "score")

        met, own = out(scored), out(same.select(F.col(name).alias(f"{name}_a"), F.col(name).alias(f"{name}_b"), "score"))
        if not itself:
            return met.union(own)
        met = met.where("index_a < index_b") if directed else met.where("index_a <> index_b").select(F.least("index_a", "index_b").alias("index_a"), F.greatest("index_a", "index_b").alias("index_b"), "score")
        return met.union(own.where("index_a < index_b"))

    if algorithm.name == "simhash":  # fingerprints say all
        named = ws.write(values.select("h1", "h2", F.col("p").alias("f")), "values")
        scored = _near(named.select("f").distinct(), threshold, strict)
        same = named.select("f", F.lit(1.0).alias("score")).distinct().where(enough)
        return spread(ws.write(scored, "scored"), same, "f", False)

    values = ws.write(values.select("h1", "h2", "p", F.monotonically_increasing_id().alias("t")), "values")
    named = values.select("h1", "h2", "t")
    same = values.select("t", algorithm.compare(F.col("p"), F.col("p")).alias("score")).where(enough)
    if algorithm.name.startswith("jaccard") and (threshold > 0 or strict):
        return spread(ws.write(_jaccard(values, threshold, ws).where(enough), "scored"), same, "t", False)
    candidates, directed = _candidates(values, algorithm, threshold, strict, ws)
    a, b = (values.select(*(F.col(c).alias(f"{c}_{s}") for c in ("t", "p"))) for s in "ab")
    pairs = candidates.distinct().join(a, "t_a").join(b, "t_b")
    if algorithm.name == "levenshtein":
        longest = F.greatest(F.char_length("p_a"), F.char_length("p_b"))
        bound = F.floor((1 - threshold) * longest + SLACK).cast("int")
        # Spark's banded distance gives -1 beyond the bound.
        pairs = pairs.withColumn("bound", bound).where((F.abs(F.char_length("p_a") - F.char_length("p_b")) <= F.col("bound")) & (F.expr("levenshtein(p_a, p_b, bound)") >= 0))
    scored = ws.write(pairs.select("t_a", "t_b", algorithm.compare(F.col("p_a"), F.col("p_b")).alias("score")).where(enough), "scored")
    return spread(scored, same, "t", directed)


def _candidates(values: DataFrame, algorithm: Algorithm, t: float, strict: bool, ws: Workspace) -> tuple[DataFrame, bool]:
    """Pairs (t_a, t_b) of names: at least all that score t or more, t_a < t_b, or, if directed, in the order they are scored."""
    name = algorithm.name
    if t <= 0 and not strict:
        every = _everything(values)
        return (every.union(every.select(F.col("t_b").alias("t_a"), F.col("t_a").alias("t_b"))), True) if name == "bm25" else (every, False)
    if name == "levenshtein":
        return (_edits(values, t, ws), False) if t > 0 else (_everything(values), False)
    if name == "hamming":
        size = F.char_length("p")
        parts = F.floor((1 - t) * size + SLACK).cast("int") + 1
        cut = F.transform(F.sequence(F.lit(0), F.least(parts, F.greatest(size, F.lit(1))) - 1), lambda i: F.xxhash64(size, i, F.substring(F.col("p"), (F.floor(i * size / parts) + 1).cast("int"), (F.floor((i + 1) * size / parts) - F.floor(i * size / parts)).cast("int"))))
        whole = parts > size  # more segments than characters: an empty one is shared by all of the length
        long_ = values.where(size > SHORT).select("t", F.explode(F.when(whole, F.array(F.xxhash64(size))).otherwise(cut)).alias("key"))
        short = values.where(size <= SHORT)
        # Places where all texts of a length have the same character never differ.
        places = short.select(size.alias("n"), F.posexplode(F.split("p", "")).alias("i", "c")).where("c <> ''").groupBy("n", "i").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").collect()
        vary: dict[int, list[int]] = {}
        for n, i in sorted((r["n"], r["i"]) for r in places):
            vary.setdefault(n, []).append(i)
        return _pairs(long_.union(short.repartition(2 * values.sparkSession.sparkContext.defaultParallelism, "t").select("t", F.explode(_places(t, vary)("p")).alias("key")))).distinct(), False
    if name == "jaro_winkler":
        need = 3 * (t - 0.4) / 0.6 - 1  # m / la + m / lb of the least Jaro that four common first characters lift to t
        if need <= 0:
            return _everything(values), False
        # m <= min(la, lb): the other text has at least (need - 1) * la characters, and m >= need * la * lb / (la + lb).
        def least(n: Column) -> Column:
            low = F.greatest((need - 1) * n, F.lit(1.0))
            return F.greatest(F.ceil(need * n * low / (n + low) - SLACK), F.lit(1))

        return _sets(values.withColumn("items", _numbered(1)("p")), least, lambda x, y: F.least(x, y) * (1 / x + 1 / y) >= need - SLACK, ws), False
    if name == "minhash":
        if t <= SLACK:
            return _everything(values), False
        size = F.size("p")
        bands = F.floor((1 - t) * size + SLACK).cast("int") + 1
        keys = F.transform(F.sequence(F.lit(0), F.least(bands, size) - 1), lambda i: F.xxhash64(i, F.slice("p", (F.floor(i * size / bands) + 1).cast("int"), (F.floor((i + 1) * size / bands) - F.floor(i * size / bands)).cast("int"))))
        return _pairs(values.select("t", F.explode(keys).alias("key"))), False
    return _weighted(values, name, t)


def _pairs(keyed: DataFrame) -> DataFrame:
    a, b = (keyed.select("key", F.col("t").alias(f"t_{s}")) for s in "ab")
    return a.join(b, "key").where("t_a < t_b").select("t_a", "t_b")


def _everything(values: DataFrame) -> DataFrame:
    """No key can be had at this threshold: blocks of one side meet all of the other, both ways."""
    blocks = max(2, 2 * values.sparkSession.sparkContext.defaultParallelism)
    a = values.select(F.col("t").alias("t_a"), F.pmod(F.xxhash64("t"), F.lit(blocks)).alias("key"))
    b = values.select(F.col("t").alias("t_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("key"))
    return a.join(b, "key").where("t_a < t_b").select("t_a", "t_b")


def _near(prints: DataFrame, t: float, strict: bool) -> DataFrame:
    """f_a, f_b, score of different fingerprints above the threshold.

    Of most + 2 bands two equal ones are left by `most` differing bits; keys are pairs of bands, and of the keys that two
    fingerprints share the first alone gives a row.
    """
    most = max(d for d in range(65) if 1 - d / 64 > t or (not strict and 1 - d / 64 >= t) or d == 0)
    bands = min(most + 2, 64)
    cuts = [(i * 64 // bands, (i + 1) * 64 // bands) for i in range(bands)]
    score = T.fingerprint_similarity("f_a", "f_b").alias("score")
    if most > 12:  # so many keys that most pairs share one
        blocks = max(2, 2 * prints.sparkSession.sparkContext.defaultParallelism)
        a = prints.select(F.col("f").alias("f_a"), F.pmod(F.xxhash64("f"), F.lit(blocks)).alias("key"))
        b = prints.select(F.col("f").alias("f_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("key"))
        return a.join(b, "key").where("f_a < f_b").where(T.fingerprint_distance("f_a", "f_b") <= most).select("f_a", "f_b", score)

    def band(f: Column, i: int) -> Column:
        lo, hi = cuts[i]
        return F.shiftrightunsigned(F.shiftleft(f, 64 - hi), 64 - hi + lo)

    two = [(i, j) for i in range(bands) for j in range(i + 1, bands)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), band(F.col("f"), i).alias("x"), band(F.col("f"), j).alias("y")) for k, (i, j) in enumerate(two)]))
    parts = 4 * prints.sparkSession.sparkContext.defaultParallelism  # a number of its own: the rows are small, the work is not
    keyed = prints.repartition(parts).select("f", keys.alias("key")).select("f", "key.*").repartition(parts, "k", "x", "y").sortWithinPartitions("k", "x", "y")
    return keyed.mapInArrow(_within(two, cuts, most), "f_a long, f_b long").select("f_a", "f_b", score)


def _within(two: list[tuple[int, int]], cuts: list[tuple[int, int]], most: int):
    """Pairs within the distance among rows (f, k, x, y) of equal keys, which stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array([(1 << i) | (1 << j) for i, j in two], np.int64)
        rest: list[np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                some = [np.asarray(batch.column(c), dtype=np.int64) for c in ("f", "k", "x", "y")]
                rest = some if rest is None else [np.concatenate(z) for z in zip(rest, some)]
            if rest is None or not len(rest[0]):
                continue
            new = np.flatnonzero(np.any([z[1:] != z[:-1] for z in rest[1:]], axis=0)) + 1
            stop = len(rest[0]) if batch is None else int(new[-1]) if len(new) else 0  # the last key may go on
            if not stop:
                continue
            f, k = rest[0][:stop].view(np.uint64), rest[1][:stop]
            rest = [z[stop:] for z in rest]
            begins = np.concatenate([[0], new[new < stop]])
            ends = np.repeat(np.append(begins[1:], stop), np.diff(np.append(begins, stop)))
            at = np.arange(stop)
            step = 0
            while True:
                step += 1
                at = at[at + step < ends[at]]
                if not len(at):
                    break
                a, b = f[at], f[at + step]
                hit = np.bitwise_count(a ^ b) <= most
                if not hit.any():
                    continue
                a, b, key = a[hit], b[hit], k[at[hit]]
                differ = a ^ b
                # The places of the first two equal bands, as bits.
                equal = np.zeros(len(a), np.int64)
                for i, (lo, hi) in enumerate(cuts):
                    equal |= ((differ >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1) == 0).astype(np.int64) << i
                first = equal & -equal
                more = equal - first
                mine = own[key] == (first | (more & -more))
                a, b = a[mine].view(np.int64), b[mine].view(np.int64)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["f_a", "f_b"])

    return run


def _sets(values: DataFrame, least, sizes, ws: Workspace) -> DataFrame:
    """Rare-first prefix filter of sets: pairs of names."""
    return _prefixes(_shared(values, ws), least, sizes)


def _shared(values: DataFrame, ws: Workspace) -> DataFrame:
    """t, n, ids: the size of a set and the numbers of its items that other sets have too, rare ones first."""
    flat = values.select("t", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = ws.write(flat.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumn("code", F.monotonically_increasing_id()), "items")
    made = flat.join(often, "item").groupBy("t", "n").agg(F.sort_array(F.collect_list(F.struct("df", "code"))).alias("ids"))
    return ws.write(made.select("t", "n", F.col("ids.code").alias("ids")), "sets")


def _prefixes(sets: DataFrame, least, sizes) -> DataFrame:
    """Two sets of enough common items share c of the first n - least(n) + c of each, for every c up to what they share.

    What is before and after a shared item bounds what two sets share besides it.
    """
    enough = least(F.col("n")).cast("int")
    common = F.least(F.lit(COMMON), enough)
    alone = F.col("n") - F.size("ids")  # items of no other set come first of all
    first = F.slice("ids", F.lit(1), F.greatest(F.col("n") - enough + common - alone, F.lit(0)))
    prefix = sets.select("t", "n", enough.alias("least"), common.alias("common"), alone.alias("alone"), F.posexplode(first).alias("place", "key")).withColumn("place", F.col("alone") + F.col("place") + 1)
    a, b = (prefix.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("t", "n", "least", "common", "place"))) for s in "ab")
    most = F.least("place_a", "place_b") + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    met = a.join(b, "key").where((F.col("t_a") < F.col("t_b")) & sizes(F.col("n_a"), F.col("n_b")) & (most >= F.greatest("least_a", "least_b")))
    return met.groupBy("t_a", "t_b", F.least("common_a", "common_b").alias("common")).count().where("count >= common").select("t_a", "t_b")


def _jaccard(values: DataFrame, t: float, ws: Workspace) -> DataFrame:
    """t_a, t_b, score: common items are counted by number, items of one set alone only in its size."""
    sets = _shared(values.select("t", F.col("p").alias("items")), ws)
    found = _prefixes(sets, lambda n: F.greatest(F.ceil(t * n - SLACK), F.lit(1)), lambda x, y: F.least(x, y) >= t * F.greatest(x, y) - SLACK)
    a, b = (sets.select(*(F.col(c).alias(f"{c}_{s}") for c in ("t", "n", "ids"))) for s in "ab")
    both = found.join(a, "t_a").join(b, "t_b").select("t_a", "t_b", "n_a", "n_b", F.size(F.array_intersect("ids_a", "ids_b")).alias("both"))
    none = _pairs(values.where(F.size("p") == 0).select("t", F.lit(0).alias("key"))).select("t_a", "t_b", F.lit(1.0).alias("score"))
    return both.select("t_a", "t_b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("score")).union(none)


def _places(t: float, vary: dict[int, list[int]]):
    """Keys of a text for Hamming: what is left without any of the places that may differ, or else segments of places taken in turn."""

    def one(x: str) -> list[int]:
        n = len(x)
        free, k = vary.get(n, []), math.floor((1 - t) * n + SLACK)
        if k >= len(free):
            kept: list[tuple[int, ...]] = [()]
        elif math.comb(len(free), k) <= KEYS:
            kept = list(itertools.combinations(free, len(free) - k))
        else:
            kept = [tuple(free[i :: k + 1]) for i in range(k + 1)]
        raw = (f"{n} {i} {''.join(x[j] for j in places)}" for i, places in enumerate(kept))
        return [int.from_bytes(hashlib.blake2b(r.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for r in raw]

    def run(s: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in s.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")


def _weighted(values: DataFrame, name: str, t: float) -> tuple[DataFrame, bool]:
    """Prefix filter on weighted tokens, rare ones first.

    TF-IDF: a weight alone is at least one that is shared, so the cosine is at most that of the plain counts, and two texts
    that share only what is after a prefix have at most the norm of the rest over the whole. BM25 is directed: the tokens
    of a that b has must carry a share of a's own score that follows from the bounds of the saturated counts; b's tokens
    have no such bound, all of them are keys.
    """
    flat = values.where(F.size("p") > 0).select("t", F.explode("p").alias("item")).groupBy("t", "item").agg(F.count(F.lit(1)).cast("double").alias("n"))
    often = flat.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    if name == "tfidf":
        weight, whole = F.col("n") * F.col("n"), F.col("n") * F.col("n")
        need = t * t
    else:
        shared, alone = math.log(1.2), math.log(2.0)
        own = F.col("n") * 2.2 * F.col("n") / (F.col("n") + 2.1)  # the least a token gives a's own score, over its idf
        weight, whole = F.col("n") * shared * 2.2 + t * (alone - shared) * own, own
        need = t * alone
    ranked = flat.join(often, "item", "left").select("t", "item", "df", weight.alias("w"), whole.alias("o"))
    by_text = Window.partitionBy("t")
    order = by_text.orderBy(F.coalesce("df", F.lit(1)).desc(), F.col("item").desc())  # the rest of a token: it and all more frequent ones
    rest = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    prefix = ranked.withColumn("rest", rest).withColumn("all", F.sum("o").over(by_text)).where(F.col("df").isNotNull() & (F.col("rest") >= need * F.col("all") * (1 - SLACK)))
    a = prefix.select(F.col("item").alias("key"), F.col("t").alias("t_a"))
    if name == "tfidf":
        found = _pairs(prefix.select("t", F.col("item").alias("key")))
        return found.union(_pairs(values.where(F.size("p") == 0).select("t", F.lit(0).alias("key")))), False
    b = flat.select(F.col("item").alias("key"), F.col("t").alias("t_b"))
    return a.join(b, "key").where("t_a <> t_b").select("t_a", "t_b"), True


def _numbered(q: int):
    """The q-grams of a text, each with the number of its occurrence, as hashes: a multiset as a set."""

    def run(s: pa.Array) -> pa.Array:
        out = []
        for x in s.to_pylist():
            seen: dict[str, int] = {}
            items = []
            for i in range(len(x) - q + 1):
                g = x[i : i + q]
                seen[g] = k = seen.get(g, 0) + 1
                items.append(f"{g}\u0000{k}")
            out.append(items)
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def _edits(values: DataFrame, t: float, ws: Workspace) -> DataFrame:
    """Pairs within floor((1 - t) * the longer one's length) edits.

    Where that allows at most EDITS edits, by the partition scheme: within k edits, a text contains one of the k + 1
    segments of the other, about in place; of two texts the shorter (or equally long) one is cut. Longer texts share all
    but k * q of their q-grams, so there the prefix filter on these holds.
    """
    most = min(math.ceil((EDITS + 1) / (1 - t)) + 1, 1_000_000) if t < 1 else 1_000_000  # the longest text with at most EDITS edits
    while math.floor((1 - t) * most + SLACK) > EDITS:
        most -= 1
    size = F.char_length("p")
    short = values.where(size <= most)
    found = _pairs(short.select("t", F.explode(_segments(t, most)("p")).alias("key")))
    q = max(1, min(4, math.floor(1 / (2 * (1 - t))))) if t < 1 else 4
    long_ = values.where(size >= max(q, math.floor(t * most)))
    if long_.where(size > most).isEmpty():
        return found

    def least(n: Column) -> Column:
        """Grams that a text with n of them shares at least: L - q + 1 - (1 - t) * L * q, where L, the longer one's length, is its own or more."""
        return F.greatest(F.ceil((n + (q - 1)) * (1 - q * (1 - t)) - (q - 1) - SLACK), F.lit(1))

    def sizes(x: Column, y: Column) -> Column:
        longest = F.greatest(x, y) + (q - 1)
        return (longest > most) & (F.abs(x - y) <= F.floor((1 - t) * longest + SLACK))

    return found.union(_sets(long_.withColumn("items", _numbered(q)("p")), least, sizes, ws))


def _segments(t: float, most: int):
    def edits(longer: int) -> int:
        return math.floor((1 - t) * longer + SLACK)

    def key(shorter: int, longer: int, i: int, part: str) -> int:
        # Of 64 bits; segments that share one are candidates more, no more.
        return (zlib.crc32(part.encode()) << 31) ^ (shorter * 1_000_003 + longer * 8191 + i)

    def one(x: str) -> list[int]:
        n, out = len(x), set()
        longer = n
        while longer - n <= edits(longer) and longer <= most:  # as the shorter one
            parts = edits(longer) + 1
            out |= {key(n, longer, i, x[i * n // parts : (i + 1) * n // parts]) for i in range(parts)}
            longer += 1
        k = edits(n)
        for shorter in range(max(0, n - k), n + 1):  # as the longer one
            for i in range(k + 1):
                lo, hi = i * shorter // (k + 1), (i + 1) * shorter // (k + 1)
                for at in range(max(0, lo - k), min(n - (hi - lo), lo + k) + 1):
                    out.add(key(shorter, n, i, x[at : at + hi - lo]))
        return list(out)

    def run(s: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in s.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")
