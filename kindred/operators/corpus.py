"""Corpus statistics and ranked retrieval: BM25 and TF-IDF over a table of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.kernels import split_tokens
from kindred.functions.text import tokens
from kindred.runtime import Workspace

#: Queries of up to so many different terms in all are sent to the documents; more meet the postings in a join.
SENT = 200_000
#: So many of the most frequent terms have their weights sent to the documents; the others meet theirs in a join.
FREQUENT = 300_000
#: Scores, and terms, that a kernel holds at a time.
CELLS, TERMS = 1_000_000, 500_000
#: Bytes of text that are split at a time.
BYTES = 4 << 20


@dataclass(frozen=True)
class Params:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Index:
    """rows (doc_id, len, terms, tfs), one per document, of which docs (doc_id, len) and postings (doc_id, term, tf, len) are views; terms (term, df), stats (n, avgdl, total_tokens) in one row."""

    rows: DataFrame
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    params: Params


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", params: Params = Params(), tokenized: bool = False) -> Index:
    """Counts of a corpus; a NULL text has no tokens, and documents without tokens count for n and avgdl.

    Every row is a document, and ids are unique. Tokens are counted where they are made, without a shuffle, and the
    counts are written once to the shared folder, a row per document: whatever is asked of the index reads them there.
    """
    t, kind = F.col(text), docs.schema[key].dataType
    if tokenized:
        base = docs.select(F.col(key).alias("doc_id"), F.coalesce(t, F.array().cast("array<string>")).alias("toks"))
    else:  # lowered here, split where they are counted; the lower case of a sigma depends on where its token ends
        base = docs.select(F.col(key).alias("doc_id"), F.when(t.contains("\u03a3"), F.array_join(tokens(t), " ")).otherwise(F.lower(t)).alias("text"))
    ws = Workspace(docs.sparkSession, "index")
    made = T.StructType([T.StructField("doc_id", kind), T.StructField("len", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    rows = ws.write(base.mapInArrow(_counted if tokenized else _split, made), "rows")
    lengths = rows.select("doc_id", "len")
    postings = rows.select("doc_id", "len", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    terms = rows.select("terms").mapInArrow(_holding, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_tokens"))
    return Index(rows, lengths, postings, terms, stats, params)


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to `most` in all; a larger row is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = _sizes(batch.column("toks"))
        for at, stop in _slices(sizes, TERMS):
            some, n = batch.slice(at, stop - at), sizes[at:stop]
            words = some.column("toks").flatten().dictionary_encode()
            yield _row_counts(some.column("doc_id"), n, np.asarray(words.indices, dtype=np.int64), words.dictionary)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.string())
        for at, stop in _slices(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64), BYTES):
            yield _row_counts(batch.column("doc_id").slice(at, stop - at), *split_tokens(texts.slice(at, stop - at)))


def _row_counts(ids: pa.Array, n: np.ndarray, codes: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """Rows of the index, of documents of n tokens each."""
    span = max(len(words), 1)
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * span + codes, return_counts=True)
    per = np.bincount(key // span, minlength=len(n))
    lists = _lists(words.take(pa.array(key % span)), per), _lists(pa.array(tf.astype(np.int64)), per)
    return pa.RecordBatch.from_arrays([ids, pa.array(n), *lists], ["doc_id", "len", "terms", "tfs"])


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of so many postings at a time."""

    def counted() -> pa.RecordBatch:
        found = pa.concat_arrays(held).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["term", "df"])

    held: list[pa.Array] = []
    for batch in batches:
        held.append(batch.column("terms").flatten())
        if sum(map(len, held)) >= 4 * TERMS:
            yield counted()
            held.clear()
    if held:
        yield counted()


@dataclass(frozen=True)
class _Asked:
    """Queries for the kernels: their ids, their terms, and per term the queries that have it, with weights."""

    ids: pa.Array
    terms: pa.Array
    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    avgdl: float
    params: Params


def _asked(index: Index, queries: DataFrame, terms: DataFrame, key: str) -> _Asked | None:
    """None if the queries are too many to be sent."""
    if len(rows := terms.limit(SENT + 1).toArrow()) > SENT:
        return None
    ids = queries.select(F.col(key).alias("query_id")).distinct().toArrow().column("query_id").combine_chunks()
    words = rows.column("term").combine_chunks().cast(pa.string()).dictionary_encode()
    vocabulary = words.dictionary

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            found = pc.index_in(batch.column("terms").flatten(), value_set=vocabulary)
            df += np.bincount(np.asarray(found.drop_null(), dtype=np.int64), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    df = np.zeros(len(vocabulary))
    if len(vocabulary):
        for r in index.rows.select("terms").mapInArrow(holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
    n, avgdl, _ = index.stats.first()
    code = np.asarray(words.indices, dtype=np.int64)
    order = np.argsort(code, kind="stable")
    weight = np.asarray(rows.column("times"), dtype=np.float64) * np.log((n - df[code] + 0.5) / (df[code] + 0.5) + 1)
    query = np.asarray(pc.index_in(rows.column("query_id").combine_chunks(), value_set=ids), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(vocabulary)))]).astype(np.int64)
    return _Asked(ids, vocabulary, first, query[order], weight[order], float(avgdl), index.params)


def _tables(asked: _Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids of documents and their scores, a row per document and a column per query."""
    q, p = len(asked.ids), asked.params
    for batch in batches:
        for at, stop in _slices(np.full(batch.num_rows, max(q, 1)), CELLS):
            some = batch.slice(at, stop - at)
            sizes = _sizes(some.column("terms"))
            code = pc.index_in(some.column("terms").flatten(), value_set=asked.terms)
            has = np.asarray(code.is_valid())
            code, doc = np.asarray(code.drop_null(), dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)[has]
            tf = np.asarray(some.column("tfs").flatten(), dtype=np.float64)[has]
            size = np.asarray(some.column("len"), dtype=np.float64)[doc]
            part = tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * size / (asked.avgdl or 1.0)))
            times = asked.first[code + 1] - asked.first[code]
            score = np.zeros(len(sizes) * q)
            for lo, hi in _slices(times, 4 * CELLS):
                n = times[lo:hi]
                place = np.arange(n.sum()) + np.repeat(asked.first[code[lo:hi]] - (np.cumsum(n) - n), n)
                score += np.bincount(np.repeat(doc[lo:hi] * q, n) + asked.query[place], np.repeat(part[lo:hi], n) * asked.weight[place], len(score))
            yield some.column("doc_id"), score.reshape(-1, q)


def _scores(asked: _Asked, every: bool, best: int = 0, over: np.ndarray | None = None):
    """Scores where the documents are: of every query, or those above 0; with best, only what may be among so many best of a query.

    over: what the scores of each query are divided by; they are 0 where it is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = len(asked.ids)
        top = np.full((q, best), -np.inf)
        for docs, table in _tables(asked, batches):
            if best:
                top = np.sort(np.concatenate([top, table.T], axis=1), axis=1)[:, -best:]
                keep = np.flatnonzero((table > 0) & (table >= top[:, 0] - 1e-8))  # ties of rounded scores stay
            else:
                keep = np.arange(table.size) if every else np.flatnonzero(table > 0)
            if over is not None:
                table = table / np.where(over > 0, over, np.inf)
            if len(keep):
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(keep % q)), docs.take(pa.array(keep // q)), pa.array(table.ravel()[keep])], ["query_id", "doc_id", "score"])

    return run


def _best(asked: _Asked):
    """The best score of each query in a partition, by the query's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(len(asked.ids))
        for _, table in _tables(asked, batches):
            top = np.maximum(top, table.max(axis=0, initial=0.0))
        some = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(top[some])], ["query", "best"])

    return run


def _ranked(index: Index, queries: DataFrame, key: str, text: str, every: bool = False, best: int = 0, normal: bool = False) -> DataFrame | None:
    asked = _asked(index, queries, _terms(queries, key, text), key)
    if asked is None:
        return None
    over = None
    if normal:
        over = np.zeros(len(asked.ids))
        for r in index.rows.mapInArrow(_best(asked), "query long, best double").groupBy("query").agg(F.max("best").alias("best")).collect():
            over[r["query"]] = r["best"]
    kinds = T.StructType([T.StructField("query_id", queries.schema[key].dataType), T.StructField("doc_id", index.rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return index.rows.mapInArrow(_scores(asked, every, best, over), kinds)


def _terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    return queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(index: Index, queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """query_id, doc_id, score of the documents that share a term; a query's repeated terms count each time."""
    sent = _ranked(index, queries, key, text)
    return _joined(index, queries, key, text) if sent is None else sent


def _joined(index: Index, queries: DataFrame, key: str, text: str) -> DataFrame:
    """The same by a join of the terms, for very many queries."""
    terms = _terms(queries, key, text)
    p = index.params
    stats = F.broadcast(index.stats)  # one row
    # The postings are pruned to the queries' terms before the document frequencies are joined.
    wanted = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(df, "term").join(stats)
    weighted = weighted.select("query_id", "term", "avgdl", (F.col("times") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("w"))
    found = wanted.join(weighted, "term")
    norm = F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("len") / F.col("avgdl"))
    return found.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("tf") * (p.k1 + 1) / norm).alias("score"))


def bm25_one(index: Index, query: str, doc_id) -> DataFrame:
    """Score of one document for one query; 0 where they share nothing."""
    spark = index.docs.sparkSession
    q = spark.createDataFrame([(0, query)], "query_id long, query string")
    one = index.docs.where(F.col("doc_id") == F.lit(doc_id)).select("doc_id")
    return one.join(bm25(index, q).where(F.col("doc_id") == F.lit(doc_id)), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25_all(index: Index, queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """query_id, doc_id, score of every document for every query, zeros too: the stated queries against all rows."""
    sent = _ranked(index, queries, key, text, every=True)
    if sent is not None:
        return sent
    spark = index.docs.sparkSession
    blocks = max(2, 2 * spark.sparkContext.defaultParallelism)
    d = index.docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("_block"))
    q = queries.select(F.col(key).alias("query_id")).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return d.join(q, "_block").join(_joined(index, queries, key, text), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25_normalized(index: Index, queries: DataFrame, every: bool = False, key: str = "query_id", text: str = "query") -> DataFrame:
    """The scores of bm25, or of bm25_all, over the best of their query; only the best scores of partitions are compared, not all scores."""
    sent = _ranked(index, queries, key, text, every=every, normal=True)
    return normalized((bm25_all if every else bm25)(index, queries, key, text)) if sent is None else sent


def normalized(scores: DataFrame) -> DataFrame:
    """Scores over the best of their query; 0 where that is 0."""
    best = F.broadcast(scores.groupBy(F.col("query_id").alias("_query")).agg(F.max("score").alias("_best")))  # a row per query
    joined = scores.join(best, F.col("query_id").eqNullSafe(F.col("_query")))
    return joined.withColumn("score", F.when(F.col("_best") > 0, F.col("score") / F.col("_best")).otherwise(F.lit(0.0))).drop("_query", "_best")


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "query_id", text: str = "query") -> DataFrame:
    """query_id, rank, doc_id, score of the k best documents of each query; scores equal to 9 digits rank by id."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    sent = _ranked(index, queries, key, text, best=k)
    found = _joined(index, queries, key, text) if sent is None else sent
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def idf(index: Index) -> DataFrame:
    """(term, idf), smoothed and never below 1 for a term of the corpus."""
    return index.terms.join(F.broadcast(index.stats)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf_weights(index: Index, weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, w); a term that the weights do not have keeps weight 0."""
    known = idf(index) if weights is None else weights
    w = F.col("tf") / F.col("len") * F.coalesce("idf", F.lit(0.0))
    return index.postings.join(known, "term", "left").select("doc_id", "term", w.alias("w"))


def magnitudes(index: Index, weights: DataFrame) -> DataFrame:
    """(doc_id, magnitude) of every document, 0 for those without terms."""
    norms = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("magnitude"))
    return index.docs.join(norms, "doc_id", "left").select("doc_id", F.coalesce("magnitude", F.lit(0.0)).alias("magnitude"))


def _weighed(index: Index) -> DataFrame:
    """doc_id, terms, weights, n_terms, square of every document: the square sums the weights' squares.

    The idf of the most frequent terms is sent to the documents; only the other postings are shuffled, to their terms and back.
    What meets them there is what is asked for: without terms and weights the documents' rows stay small.
    """
    ws = Workspace(index.rows.sparkSession, "weights")
    index = replace(index, terms=ws.write(index.terms, "terms"))
    many = sorted(map(tuple, index.terms.groupBy("df").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    fit = [df for (df, _), total in zip(many, np.cumsum([n for _, n in many])) if total <= FREQUENT]
    top = index.terms.where(F.col("df") >= (fit[-1] if fit else many[0][0] + 1 if many else 0)).toArrow()
    n = index.stats.first()["n"]
    names, idfs = top.column("term").combine_chunks().cast(pa.string()), np.log((1.0 + n) / (1.0 + np.asarray(top.column("df"), dtype=np.float64))) + 1.0
    sent = index.rows.sparkSession.sparkContext.broadcast((names, idfs))

    def parts(batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[pa.RecordBatch]:
        names, idfs = sent.value
        for batch in batches:
            for at, stop in _slices(_sizes(batch.column("terms")), TERMS):
                some = batch.slice(at, stop - at)
                sizes = _sizes(some.column("terms"))
                words, doc = some.column("terms").flatten(), np.repeat(np.arange(len(sizes)), sizes)
                w = np.asarray(some.column("tfs").flatten(), dtype=np.float64) / np.asarray(some.column("len"), dtype=np.float64)[doc]
                code = pc.index_in(words, value_set=names)
                has = np.asarray(code.is_valid())
                if rest:
                    if not has.all():
                        yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(doc[~has])), words.filter(pa.array(~has)), pa.array(w[~has])], ["doc_id", "term", "tf"])
                    continue
                w, doc = w[has] * idfs[np.asarray(code.drop_null(), dtype=np.int64)], doc[has]
                per = np.bincount(doc, minlength=len(sizes))
                square = np.bincount(doc, w * w, len(sizes)).astype(np.float64)  # whole numbers if there is no term at all
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), _lists(words.filter(pa.array(has)), per), _lists(pa.array(w), per), pa.array(per.astype(np.int64)), pa.array(square)], ["doc_id", "terms", "weights", "n_terms", "square"])

    kind = index.rows.schema["doc_id"].dataType
    one = T.StructType([T.StructField("doc_id", kind), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("n_terms", T.LongType()), T.StructField("square", T.DoubleType())])
    often = index.rows.mapInArrow(lambda b: parts(b, False), one)
    if len(fit) == len(many):
        return often
    other = T.StructType([T.StructField("doc_id", kind), T.StructField("term", T.StringType()), T.StructField("tf", T.DoubleType())])
    rare = index.rows.mapInArrow(lambda b: parts(b, True), other).join(idf(index), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    rare = rare.groupBy("doc_id").agg(F.collect_list(F.struct("term", "w")).alias("_rare"), F.count(F.lit(1)).alias("_others"), F.sum(F.col("w") * F.col("w")).alias("_more"))

    def grown(all_: str, field: str) -> Column:
        return F.when(F.col("_rare").isNull(), F.col(all_)).otherwise(F.concat(all_, F.col(f"_rare.{field}"))).alias(all_)

    count = (F.col("n_terms") + F.coalesce("_others", F.lit(0))).alias("n_terms")
    return often.join(rare, "doc_id", "left").select("doc_id", grown("terms", "term"), grown("weights", "w"), count, (F.col("square") + F.coalesce("_more", F.lit(0.0))).alias("square"))


def vectors(index: Index) -> DataFrame:
    """(doc_id, weights map, n_terms, magnitude)."""
    return _weighed(index).select("doc_id", F.map_from_arrays("terms", "weights").alias("weights"), "n_terms", F.sqrt("square").alias("magnitude"))


def cosine_pairs(index: Index, pairs: DataFrame) -> DataFrame:
    """id_a, id_b, score of given pairs; two documents without terms are equal."""
    ws = Workspace(index.rows.sparkSession, "cosine")
    vec = ws.write(_weighed(index), "vectors")
    a, b = (vec.select(F.col("doc_id").alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("terms", "weights", "square"))) for s in "ab")
    joined = pairs.select("id_a", "id_b").join(a, "id_a").join(b, "id_b")
    both = (F.col("square_a") == 0) & (F.col("square_b") == 0)
    dot = F.arrow_udf(_dots, "double")("terms_a", "weights_a", "terms_b", "weights_b")
    norm = F.sqrt("square_a") * F.sqrt("square_b")
    made = joined.select("id_a", "id_b", both.alias("both"), norm.alias("norm"), dot.alias("dot"))
    return made.select("id_a", "id_b", F.when(F.col("both"), F.lit(1.0)).when(F.col("norm") > 0, F.col("dot") / F.col("norm")).otherwise(F.lit(0.0)).alias("score"))


def _dots(terms_a: pa.Array, weights_a: pa.Array, terms_b: pa.Array, weights_b: pa.Array) -> pa.Array:
    out = [np.zeros(0)]
    sizes_a, sizes_b = _sizes(terms_a), _sizes(terms_b)
    for at, stop in _slices(sizes_a + sizes_b, TERMS):
        (ta, wa), (tb, wb) = ((t.slice(at, stop - at).flatten(), np.asarray(w.slice(at, stop - at).flatten())) for t, w in ((terms_a, weights_a), (terms_b, weights_b)))
        codes = np.asarray(pa.concat_arrays([ta, tb]).dictionary_encode().indices, dtype=np.int64)
        span, rows = int(codes.max(initial=0)) + 1, np.arange(stop - at)
        ka, kb = np.repeat(rows, sizes_a[at:stop]) * span + codes[: len(ta)], np.repeat(rows, sizes_b[at:stop]) * span + codes[len(ta) :]
        key, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        out.append(np.bincount(key // span, wa[ia] * wb[ib], stop - at).astype(np.float64))
    return pa.array(np.concatenate(out))


def cosine_overlaps(index: Index) -> DataFrame:
    """id_a < id_b and score of all pairs that share a term."""
    w = tfidf_weights(index)
    unit = w.join(magnitudes(index, w), "doc_id").where("w > 0").select("doc_id", "term", (F.col("w") / F.col("magnitude")).alias("u"))
    a, b = (unit.select(F.col("doc_id").alias(f"id_{s}"), "term", F.col("u").alias(f"u_{s}")) for s in "ab")
    return a.join(b, "term").where("id_a < id_b").groupBy("id_a", "id_b").agg(F.sum(F.col("u_a") * F.col("u_b")).alias("score"))
