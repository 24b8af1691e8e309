r"""Similarity join of documents on the Jaccard coefficient of their 5-word shingles.

Documents of equal sets are one class, and classes are joined. The shingles of a class are put in a global order, rare
ones first: first those that no block of documents repeats, by their hash, then the repeated ones by how often they
repeat. Two classes of coefficient t or more share a shingle among the first n - ceil(t n) + 1 of each, so only these
prefixes are shuffled and joined. Of the pairs that meet, those survive whose sizes are close enough (length filter) and
whose places leave room for enough common shingles (positional filter). They are verified once each, in tiles of a
connected part of the candidate graph: a bound from counts per hash range (suffix filter), then the exact overlap. A tile
gives the number of each class's links and edges that join what the links join, not the links one by one.

The holders of a shingle meet in one task, but for hot shingles, which are counted by pre-aggregation; and where more than
CELL classes hold one, they are joined in cells of a hash of theirs against one of the others', so no task has them all.

Words are [^\x20\x09-\x0D]+ with A-Z lowered; fewer words than a shingle are one shingle. Defined results: a null or
empty text, or one without words, has an empty set and is linked with nothing; equal sets link always; repeated rows are
documents each, and where rows of different texts share an id, each belongs to its own text's component; rows without id
are linked with nothing; other columns are carried by deduplicate() only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.graph import connected_components, union
from kindred.llm.hot import LEAST, hot_keys
from kindred.llm.textarrow import blocks, hashes, strings, word_codes
from kindred.runtime import Workspace

#: Documents of a block; a shingle's hash has the 64 bits that their number leaves.
BLOCK_DOCS, HASH_BITS = 1 << 13, 51
#: A shingle that so many documents of a block hold is repeated.
LOCAL = 3
#: The most repeated shingles have their own places in the order (12 bytes each in every task); the rest keep their hash order.
RANKED = 200_000
#: Classes of a tile.
TILE = 128
#: Up to so many ids (8 bytes each) of candidate documents are sent to the tasks that reread texts; more are joined.
SENT = 1_000_000
#: Classes of a cell, where the holders of a shingle are joined in cells.
CELL = 1024
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x * _MULT
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size per text, the sets' hashes, ascending within a text) of at most BLOCK_DOCS texts."""
    per, codes, words = word_codes(texts)
    named = hashes(words)
    starts = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    keys = [np.zeros(0, np.uint64)]
    doc = 0
    while doc < len(per):  # a few documents at a time, as each step needs several arrays as long as their words
        stop = max(doc + 1, int(np.searchsorted(starts, starts[doc] + 300_000, side="right")) - 1)
        keys.append(_shingles(per[doc:stop], named[codes[starts[doc] : starts[stop]]], width, doc))
        doc = stop
    key = np.concatenate(keys)
    owner = (key >> np.uint64(HASH_BITS)).astype(np.int64)
    return np.bincount(owner, minlength=len(per)), (key & np.uint64(2**HASH_BITS - 1)).astype(np.int64)


def _shingles(per: np.ndarray, h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Distinct (document, shingle) keys, ascending, of documents of these word counts and word hashes; base is the first one's number."""
    starts = np.cumsum(per) - per
    grams = np.where(per >= width, per - width + 1, np.minimum(per, 1))
    owner = np.repeat(np.arange(len(per)), grams)
    ends = np.cumsum(grams)
    at = np.repeat(starts - (ends - grams), grams) + np.arange(len(owner))
    short = (per < width)[owner]
    acc = np.zeros(len(owner), np.uint64)
    length = per[owner]
    with np.errstate(over="ignore"):
        for k in range(width):
            if short.any():
                real = ~short | (k < length)
                nxt = h[np.where(real, at + k, 0)] if len(h) else acc
                acc = np.where(real, _stir(acc) + nxt, acc)
            else:
                acc = _stir(acc) + h[at + k]
        acc = _stir(np.where(short, acc + length.astype(np.uint64), acc))
    key = ((owner + base).astype(np.uint64) << np.uint64(HASH_BITS)) | (acc >> np.uint64(64 - HASH_BITS))
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def _small_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for table in blocks(batches, 12_000_000):
        for at in range(0, table.num_rows, BLOCK_DOCS):
            yield table.slice(at, BLOCK_DOCS)


def _set_keys(sizes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; 0 stands for the empty one."""
    import xxhash

    raw = memoryview(np.ascontiguousarray(sets)).cast("B") if len(sets) else b""
    ends = (8 * np.cumsum(sizes)).tolist()
    return np.array([xxhash.xxh3_64_intdigest(raw[b - 8 * n : b]) if n else 0 for b, n in zip(ends, sizes.tolist())], dtype=np.uint64).view(np.int64)


def _classes(width: int):
    """Per document its id, set size and key; per block, with no id, the shingles that its distinct sets repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _small_blocks(batches):
            sizes, sets = shingle_sets(strings(table), width)
            keys = _set_keys(sizes, sets)
            yield from pa.table({"kind": np.zeros(len(keys), np.int8), "doc_id": table.column("doc_id"), "row": table.column("row"), "n": sizes.astype(np.int64), "key": keys}).to_batches()
            first = np.zeros(len(keys), bool)
            first[np.unique(keys, return_index=True)[1]] = True
            found = np.sort(sets[np.repeat(first, sizes)])
            starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(found)))
            often = counts >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(often.sum(), np.int8)), *[pa.nulls(int(often.sum()), pa.int64())] * 2, pa.array(counts[often].astype(np.int64)), pa.array(found[starts[often]])], ["kind", "doc_id", "row", "n", "key"])

    return run


def _prefixes(width: int, percent: int, ranked):
    """The prefix shingles of a block's distinct sets, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, times = ranked.value
        for table in _small_blocks(batches):
            sizes, sets = shingle_sets(strings(table), width)
            keys = _set_keys(sizes, sets)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, sets), len(tokens) - 1)
                often = np.where(tokens[at] == sets, times[at], 0)
                order = np.argsort(owner * (int(times.max()) + 1) + often, kind="stable")
                sets = sets[order]
            place = np.arange(len(sets)) - (np.cumsum(sizes) - sizes)[owner]
            first = np.zeros(len(keys), bool)
            first[np.unique(keys, return_index=True)[1]] = True
            keep = first[owner] & (place < sizes[owner] - (percent * sizes[owner] + 99) // 100 + 1)
            yield from pa.table({"token": sets[keep], "key": keys[owner[keep]], "n": sizes[owner[keep]].astype(np.int32), "place": place[keep].astype(np.int32)}).to_batches()

    return run


def _wanted(width: int, ids):
    """Key and set of the documents with these ids (all, if None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _small_blocks(batches):
            if ids is not None:
                table = table.filter(pc.is_in(table.column("doc_id"), pa.array(ids.value)))
            sizes, sets = shingle_sets(strings(table), width)
            raw = np.ascontiguousarray(sets).tobytes()
            ends = (8 * np.cumsum(sizes)).tolist()
            yield from pa.table({"key": _set_keys(sizes, sets), "tokens": pa.array([raw[b - 8 * n : b] for b, n in zip(ends, sizes.tolist())], pa.binary())}).to_batches()

    return run


def overlaps(sets: list[np.ndarray], pairs: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (rows of two indexes into sets) reach the coefficient."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    both = sizes[pairs[:, 0]] + sizes[pairs[:, 1]]
    ranges = np.array([np.bincount(s >> (HASH_BITS - 5), minlength=32) for s in sets])
    most = np.minimum(ranges[pairs[:, 0]], ranges[pairs[:, 1]]).sum(1)
    left = np.flatnonzero((100 + percent) * most >= percent * both)
    out = np.zeros(len(pairs), bool)
    if not len(left):
        return out
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    step = 8192
    for low in range(0, len(tokens), step):
        a, b = np.searchsorted(at, [low, low + step])
        held = np.zeros((len(sets), min(step, len(tokens) - low)), np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        common += held @ held.T
    i = common[pairs[left, 0], pairs[left, 1]].astype(np.int64)
    out[left] = (100 + percent) * i >= percent * both[left]
    return out


def _verify(percent: int):
    """Rows sorted by (part, ta, tb, kind): a tile's sets with their copies, then its pairs; a tile is never held longer than its rows last.

    Per class with links in the tile: key, how many documents it links to there, and the smallest key they reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets, copies, pairs = None, {}, {}, []

        def close() -> pa.RecordBatch | None:
            if not pairs:
                return None
            names = list(sets)
            at = {k: i for i, k in enumerate(names)}
            p = np.array([(at[a], at[b]) for a, b in pairs if a in at and b in at], dtype=np.int64).reshape(-1, 2)
            good = p[overlaps([sets[k] for k in names], p, percent)] if len(p) else p
            if not len(good):
                return None
            ids, times = np.array(names, dtype=np.int64), np.array([copies[k] for k in names], dtype=np.float64)
            links = np.bincount(good[:, 0], times[good[:, 1]], len(ids)) + np.bincount(good[:, 1], times[good[:, 0]], len(ids))
            nodes, roots = union(ids[good[:, 0]], ids[good[:, 1]])
            order = np.argsort(ids)
            mine = order[np.searchsorted(ids[order], nodes)]
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links[mine].astype(np.int64)), pa.array(roots)], ["key", "links", "root"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "ta", "tb", "a", "b", "tokens")]
            for part, ta, tb, a, b, tokens in zip(*columns):
                if (part, ta, tb) != tile:
                    if (done := close()) is not None:
                        yield done
                    tile, sets, copies, pairs = (part, ta, tb), {}, {}, []
                if tokens is not None:
                    sets[a], copies[a] = np.frombuffer(tokens, np.int64), b
                else:
                    pairs.append((a, b))
        if (done := close()) is not None:
            yield done

    return run


def _shared(ws: Workspace, prefixes: DataFrame, least: int) -> DataFrame:
    """The rows of tokens with several holders, with their number, two hashes of who they are, and the first of them."""
    columns = ("token", "key", "n", "place")
    signs = {"in": F.count(F.lit(1)), "s1": F.bit_xor(F.xxhash64("key", "n")), "s2": F.bit_xor(F.xxhash64("n", "key", F.lit(7))), "low": F.min(F.struct("key", "place"))}
    hot = hot_keys(prefixes, "token", ("key",), least=least)
    some = prefixes if hot is None else prefixes.join(F.broadcast(hot), "token", "left_anti")
    # A token's rows are counted and joined in one partitioning; rows of one class from different blocks are one.
    held = some.repartition("token").groupBy(*columns).agg(F.lit(1).alias("one")).drop("one")
    token = Window.partitionBy("token")
    shared = held.withColumn("in", F.count(F.lit(1)).over(token)).where(F.col("in") > 1)
    shared = shared.select(*columns, "in", *(c.over(token).alias(name) for name, c in signs.items() if name != "in"))
    if hot is None:
        return shared
    many = ws.write(prefixes.join(F.broadcast(hot), "token", "left_semi").groupBy(*columns).agg(F.lit(1).alias("one")).drop("one"), "hot")
    known = many.groupBy("token").agg(*(c.alias(name) for name, c in signs.items())).where(F.col("in") > 1)
    return shared.unionByName(many.join(F.broadcast(known), "token").select(*shared.columns))


def _meet(shared: DataFrame, percent: int, cell: int) -> DataFrame:
    """Pairs a < b of the classes that share a token, by lengths and places."""
    names = ("key", "n", "place")
    a, b = (shared.select("token", "in", *(F.col(c).alias(f"{c}_{s}") for c in names)) for s in "ab")
    least = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent) - 1e-9)
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    near = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (room >= least)
    few = F.col("in") <= cell
    pairs = a.where(few).join(b.where(few).drop("in"), "token").where((F.col("key_a") < F.col("key_b")) & near).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    if shared.where(~few).isEmpty():
        return pairs
    parts = F.ceil(F.col("in") / cell).cast("int")

    def cells(side: DataFrame, key: str, first: bool) -> DataFrame:
        own = side.where(~few).withColumn("own", F.pmod(F.xxhash64(key), parts).cast("int"))
        other = F.sequence(F.col("own"), parts - 1) if first else F.sequence(F.lit(0), F.col("own"))
        own = own.withColumn("other", F.explode(other))
        x, y = ("own", "other") if first else ("other", "own")
        return own.select("token", F.col(x).alias("x"), F.col(y).alias("y"), *(c for c in own.columns if c[-2:] in ("_a", "_b")))

    met = cells(a, "key_a", True).join(cells(b, "key_b", False), ["token", "x", "y"])
    met = met.where(near & F.when(F.col("x") == F.col("y"), F.col("key_a") < F.col("key_b")).otherwise(F.col("key_a") != F.col("key_b")))
    return pairs.union(met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")))


def similar(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_similar, component_id (smallest doc_id its links reach, its own included), class_id.

    Every link between different sets is found; documents of one set are one class and not expanded into pairs. Options:
    percent, width (words of a shingle), tile and cell (classes), hot_rows (rows of a token beyond which it is hot).
    """
    return _similar(docs.withColumn("_row", F.lit(0).cast("long")), **options).drop("row", "component_key")


def _similar(docs: DataFrame, *, percent: int = 90, width: int = 5, tile: int = TILE, cell: int = CELL, hot_rows: int = LEAST) -> DataFrame:
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_row").alias("row"), F.col("text").cast("string").alias("text"))
    found = ws.write(texts.mapInArrow(_classes(width), "kind byte, doc_id long, row long, n long, key long"), "classes")
    texts = texts.drop("row")
    rows = found.where("kind = 0").drop("kind")
    named_rows = rows.where("n > 0 and doc_id is not null")
    repeats = found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "key").limit(RANKED).toArrow()
    tokens, times = (repeats.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    order = np.argsort(tokens)
    ranked = spark.sparkContext.broadcast((tokens[order], times[order]))
    prefixes = ws.write(texts.mapInArrow(_prefixes(width, percent, ranked), "token long, key long, n int, place int"), "prefixes")

    shared = ws.write(_shared(ws, prefixes, hot_rows), "shared")
    ws.drop("prefixes", "hot")
    # Of tokens with the same holders the first in order is enough: it is the first that any two of these holders share.
    once = shared.groupBy("s1", "s2", "in", F.col("low.key")).agg(F.min(F.struct("low.place", "token")).alias("first")).select("first.token")
    shared = ws.write(shared.select("token", "key", "n", "place", "in").join(once, "token", "left_semi"), "first-shared")
    pairs = ws.write(_meet(shared, percent, cell).distinct(), "pairs")
    ws.drop("shared", "first-shared")

    # Tiles: the parts of the candidate graph, cut by a hash where they are large.
    parts = connected_components(ws, pairs, "parts").select(F.col("node").alias("key"), F.col("component").alias("part"))
    sizes = parts.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    placed = ws.write(parts.join(sizes, "part").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")), "placed")
    of = placed.select("key", "part", "tile")
    there = pairs.join(of.select(F.col("key").alias("a"), "part", F.col("tile").alias("x")), "a").join(of.select(F.col("key").alias("b"), F.col("tile").alias("y")), "b")
    there = there.select("part", F.least("x", "y").alias("ta"), F.greatest("x", "y").alias("tb"), "a", "b")
    there = ws.write(there, "tiled")
    # A candidate class is reread from its first document, and goes to the tiles of its pairs.
    classes = named_rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    chosen = ws.write(classes.join(placed.select("key"), "key", "left_semi").select(F.col("rep").alias("doc_id"), "key", "copies"), "chosen")
    ids_of = chosen.select("doc_id").distinct()
    if chosen.count() <= SENT:
        ids = spark.sparkContext.broadcast(ids_of.toArrow().column("doc_id").to_numpy())
        sets = texts.mapInArrow(_wanted(width, ids), "key long, tokens binary")
    else:
        sets = texts.join(ids_of.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_wanted(width, None), "key long, tokens binary")
    goes = there.select(F.col("a").alias("key"), "part", "ta", "tb").union(there.select("b", "part", "ta", "tb")).distinct().join(chosen.select("key", "copies"), "key")
    spread = goes.hint("shuffle_hash").join(sets, "key").select("part", "ta", "tb", F.col("key").alias("a"), F.col("copies").alias("b"), "tokens")
    rows_ = spread.unionByName(there.withColumn("tokens", F.lit(None).cast("binary")))
    links = rows_.repartition("part", "ta", "tb").sortWithinPartitions("part", "ta", "tb", F.col("tokens").isNull()).mapInArrow(_verify(percent), "key long, links long, root long")
    links = ws.write(links, "links")
    ws.drop("tiled", "placed")

    # Classes with copies or links; every other document stands alone. Components are those of classes, named by their smallest id.
    components = connected_components(ws, links.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct())
    partners = links.groupBy("key").agg(F.sum("links").alias("partners"))
    known = classes.join(partners, "key", "left").where("copies > 1 or partners is not null")
    known = known.join(components.select(F.col("node").alias("key"), F.col("component").alias("component_key")), "key", "left")
    known = ws.write(known.withColumn("component_key", F.coalesce("component_key", "key")), "members")
    names = known.groupBy("component_key").agg(F.min("rep").alias("component"))
    known = ws.write(known.join(names, "component_key").select("key", "rep", "component_key", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("links"), "component"), "known")
    out = rows.join(known, (rows["key"] == known["key"]) & (rows["n"] > 0) & rows["doc_id"].isNotNull(), "left").drop(known["key"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"), "row", F.coalesce("component_key", "key").alias("component_key"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id, and of rows that repeat it, the first.

    Rows without id or without words stay. Where ids repeat, rows are told apart by their places in a written copy.
    """
    ws = Workspace(docs.sparkSession, "jaccard-kept")
    names = docs.columns
    place = {c: f"_c{i}" for i, c in enumerate(names)}
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in place.items()))
    key = F.col(place["doc_id"]).cast("long")
    repeated = not docs.where(key.isNotNull()).groupBy(key).count().where("count > 1").isEmpty()
    docs = ws.write(docs.withColumn("_row", F.monotonically_increasing_id()), "rows") if repeated else docs.withColumn("_row", F.lit(0).cast("long"))
    found = ws.write(_similar(docs.select(key.alias("doc_id"), F.col(place["text"]).alias("text"), "_row"), **options).where("doc_id = component_id"), "found")
    if repeated:
        with_words = found.where("n_shingles > 0").groupBy("component_key").agg(F.min("row").alias("id")).select("id")
        ids = with_words.union(found.where("n_shingles = 0").select("row"))
        kept = docs.join(ids.hint("shuffle_hash"), F.col("_row") == F.col("id"), "left_semi")
    else:
        kept = docs.join(found.select(F.col("doc_id").alias("id")).hint("shuffle_hash"), key == F.col("id"), "left_semi")
    return kept.where(key.isNotNull()).union(docs.where(key.isNull())).select(*(F.col(n).alias(c) for c, n in place.items()))
