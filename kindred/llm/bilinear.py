r"""Log-bilinear language model, trained with noise-contrastive estimation, normalised by matrix products.

Units are what the model predicts: the end of a text, the most frequent words, and classes of the other words by how often
they occur (powers of two) and by their last letters. The two units before a position give a vector, C1 r(u1) + C2 r(u2),
and a unit w scores its product with q(w), plus b(w). Since the score is a sum over the two places, the sum of exp(score)
over all units, for all pairs of contexts at once, is one matrix product of exp(R C1' Q' + b) and exp(R C2' Q')'. A token
has its unit's normalised probability times its share of its class; new words have the share that Good-Turing estimates.

Corpus: each block of documents is encoded with its own dictionary; counts of words are summed over all blocks and go back
to each. Training: the documents are dealt to replicas by a hash of their ids; in each round every replica takes its share,
in the order of a hash, through noise-contrastive steps (shared noise per batch, Adagrad), and the models are averaged,
weighted by tokens, in a tree. Each training token is seen once. There are as many replicas as the square root of the
training tokens says, so their number and their work both grow with the corpus, and the scores depend on neither the
files nor the cluster.

Words are [^\x20\x09-\x0D]+ with A-Z lowered, and every text ends with one end token. Held out: documents with
crc32(doc_id as text) mod 5 = 1. Defined results: a null or empty text has the end token alone; a null id is trained on;
repeated rows count and are scored each; without any training document every token is new, and the base score is 0 a
token; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.hot import LEAST, hot_keys
from kindred.llm.textarrow import blocks, give_back, hashes, strings, word_codes
from kindred.runtime import Workspace

#: Bands reach to counts of 2**31, far beyond what the first word outside WORDS has in any corpus.
WORDS, BANDS, ENDINGS = 1791, 32, 8
UNITS = 1 + WORDS + BANDS * ENDINGS
WIDTH, NOISE, BATCH, ROUNDS = 24, 64, 1024, 2
#: Replicas are the square root of the training tokens over this; so many tokens are trained on at a time.
SPREAD, CHUNK = 2_000_000, 400_000
#: Models that are averaged at once.
FAN = 8
_ZSTD = pa.Codec("zstd", 1)


def _put(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _get(raw: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(_ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True))


@dataclass
class Model:
    """Parameters: input and output vectors of units, the two context matrices, biases."""

    r: np.ndarray
    q: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    b: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    @staticmethod
    def start(share: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        n, d = len(share), WIDTH
        eye = np.eye(d, dtype=np.float32)
        return Model(rng.normal(0, 0.3, (n, d)).astype(np.float32), rng.normal(0, 0.1, (n, d)).astype(np.float32), eye.copy(), 0.5 * eye, np.log(share).astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural logs: score by (u1, w) with bias, score by (u2, w), normaliser by (u1, u2)."""
        a = (self.r.astype(np.float64) @ self.c1.T) @ self.q.T + self.b
        b = (self.r.astype(np.float64) @ self.c2.T) @ self.q.T
        ma, mb = a.max(1), b.max(1)
        z = np.log(np.exp(a - ma[:, None]) @ np.exp(b - mb[:, None]).T) + ma[:, None] + mb[None, :]
        return a, b, z


def _scatter(size: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    some = at[order]
    first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
    out[some[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def nce(model: Model, state: list[np.ndarray], share: np.ndarray, u1: np.ndarray, u2: np.ndarray, w: np.ndarray, rng: np.random.Generator, rate: float = 0.06) -> None:
    """Noise-contrastive steps over these positions, in random order, in place."""
    size = len(share)
    log_noise = np.log(NOISE * share).astype(np.float32)
    cumulative = np.cumsum(share)
    cumulative /= cumulative[-1]
    order = rng.permutation(len(w))
    params = model.arrays()
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        x, y, t = u1[some], u2[some], w[some]
        noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), size - 1)
        rx, ry, qt, qn = model.r[x], model.r[y], model.q[t], model.q[noise]
        h = rx @ model.c1.T + ry @ model.c2.T
        pos = np.einsum("ij,ij->i", h, qt) + model.b[t] - log_noise[t]
        neg = h @ qn.T + (model.b[noise] - log_noise[noise])
        gp = 1 / (1 + np.exp(np.clip(pos, -30, 30)))
        gn = -1 / (1 + np.exp(-np.clip(neg, -30, 30)))
        gh = gp[:, None] * qt + gn @ qn
        gq = _scatter(size, np.concatenate([t, noise]), np.concatenate([gp[:, None] * h, gn.T @ h]))
        gr = _scatter(size, np.concatenate([x, y]), np.concatenate([gh @ model.c1, gh @ model.c2]))
        gb = np.bincount(np.concatenate([t, noise]), np.concatenate([gp, gn.sum(0)]), size)
        n = len(some)
        for p, s, g in zip(params, state, (gr, gq, gh.T @ rx, gh.T @ ry, gb)):
            g = g.astype(np.float32) / n
            s += g * g
            p += rate * g / (np.sqrt(s) + 1e-4)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a block with their counts in training documents, and the block in codes of these words."""
    block = TaskContext.get().partitionId() << 32
    schema = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("token", pa.string()), ("ending", pa.int8()), ("count", pa.int64()), ("payload", pa.binary())])
    for table in blocks(batches, 14_000_000):
        ids, held = table.column("doc_id"), np.asarray(table.column("held_out"), dtype=bool)
        texts = strings(table)
        del table  # a block's texts are held once, and only until its words are known
        per, codes, words = word_codes(texts)
        del texts
        end = len(words)
        codes = np.insert(codes, np.cumsum(per), end)
        per = per + 1
        trained, counts = np.repeat(~held, per), np.zeros(end + 1, np.int64)
        for at in range(0, len(codes), CHUNK):
            counts += np.bincount(codes[at : at + CHUNK][trained[at : at + CHUNK]], minlength=end + 1)
        names = words.cast(pa.large_string())
        tails = pc.utf8_slice_codeunits(names, -2).dictionary_encode()
        endings = (hashes(tails.dictionary) % np.uint64(ENDINGS)).astype(np.int8)[np.asarray(tails.indices)] if end else np.zeros(0, np.int8)
        n = end + 1
        yield from pa.Table.from_arrays(
            [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.chunked_array([names.cast(pa.string()), pa.array([""])]), pa.array(np.append(endings, 0).astype(np.int8)), pa.array(counts.astype(np.int64)), pa.nulls(n, pa.binary())],
            schema=schema,
        ).to_batches(max_chunksize=50_000)
        payload = _put(np.asarray(pc.fill_null(ids, 0), dtype=np.int64), np.asarray(pc.is_null(ids)), held, per, codes.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int8()), pa.nulls(1, pa.int64()), pa.array([payload], pa.binary())], schema=schema)
        block += 1
        del codes, words, trained, counts, names, tails, endings, payload
        give_back()


@dataclass
class Classes:
    """Shares within a class of words (log10), by band and ending."""

    mass: np.ndarray
    new: np.ndarray
    once: np.ndarray
    total: int
    types: int

    def of(self, c: np.ndarray, ending: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, log10 of the share in it) of words with these counts; top is the unit of a frequent one, else -1."""
        band = np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), BANDS - 1)
        cell = band * ENDINGS + ending
        share = np.log10((c + 0.5) / self.mass[cell])
        share = np.where(c == 1, self.once[ending], np.where(c == 0, self.new[ending], share))
        return np.where(top >= 0, top, 1 + WORDS + cell), np.where(top >= 0, 0.0, share)


def _units(classes):
    """A block's documents with everything the unigram counts give, and their tokens as units."""

    def run(key: tuple, blocks_: pa.Table, words: pa.Table) -> pa.Table:
        give_back()  # what the group before took
        shared: Classes = classes.value
        order = np.argsort(np.asarray(words.column("code"), dtype=np.int64))
        c, ending, top = (np.asarray(words.column(x), dtype=np.int64)[order] for x in ("c", "ending", "top"))
        unit, share = shared.of(c, ending, top)
        unit = unit.astype("<u2")
        base = np.log10((c + 0.5) / (shared.total + 0.5 * (shared.types + 1)))
        out = []
        for raw in blocks_.column("payload").to_pylist():
            ids, nulls, held, per, codes = _get(raw)
            starts = np.cumsum(per) - per
            sums = [np.add.reduceat(x[codes], starts) for x in (base, share, (c > 0).astype(np.int64))]
            bytes_ = memoryview(unit[codes]).cast("B")
            texts = pa.array([bytes_[2 * a : 2 * (a + n)] for a, n in zip(starts.tolist(), per.tolist())], pa.binary())
            out.append(pa.table({"doc_id": pa.array(ids, mask=nulls), "held_out": held, "n_tokens": per.astype(np.int64), "n_known": sums[2], "base": sums[0], "share": sums[1], "units": texts}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(("doc_id", "held_out", "n_tokens", "n_known", "base", "share", "units"), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))})

    return run


def _contexts(per: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two places before each; before a text stand ends."""
    u1, u2 = np.zeros_like(units), np.zeros_like(units)
    u1[1:], u2[2:] = units[:-1], units[:-2]
    starts = np.cumsum(per) - per
    u1[starts] = 0
    u2[starts] = 0
    u2[starts[per > 1] + 1] = 0
    return u1, u2


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, tokens per row, their units) of about `most` tokens; a longer document is a piece of its own."""
    for batch in batches:
        per = np.asarray(batch.column("n_tokens"), dtype=np.int64)
        ends = np.cumsum(per)
        at = 0
        while at < len(per):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            some = batch.slice(at, stop - at)
            units = np.frombuffer(b"".join(x.as_buffer() for x in some.column("units")), "<u2").astype(np.int64)
            yield some, per[at:stop], units
            at = stop


def _train(sent, seed: int):
    """A replica's documents, in their order, CHUNK tokens and more at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, state, share = pickle.loads(sent.value)
        node, seen, chunk = None, 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def train() -> None:
            nonlocal seen, chunk
            per, units = (np.concatenate(x) for x in zip(*held))
            held.clear()
            u1, u2 = _contexts(per, units)
            nce(model, state, share, u1, u2, units, np.random.default_rng([seed, node, chunk]))
            seen, chunk = seen + len(units), chunk + 1

        size = 0
        for some, per, units in _pieces(batches, CHUNK):
            node = some.column("replica")[0].as_py()
            doc = at = 0
            while doc < len(per):  # a chunk ends with the document that fills it, wherever batches end
                ends = np.cumsum(per[doc:])
                stop = min(doc + int(np.searchsorted(ends, CHUNK - size)) + 1, len(per))
                n = int(ends[stop - doc - 1])
                held.append((per[doc:stop], units[at : at + n]))
                doc, at, size = stop, at + n, size + n
                if size >= CHUNK:
                    train()
                    size = 0
        if held:
            train()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([float(seen)]), pa.array([_put(*model.arrays(), *state)], pa.binary())], ["node", "tokens", "payload"])

    return run


def _average(table: pa.Table) -> pa.Table:
    total, sums, first = 0.0, None, None
    for node, n, raw in sorted(zip(*(table.column(c).to_pylist() for c in ("node", "tokens", "payload")))):
        arrays = _get(raw)
        sums = [n * a.astype(np.float64) for a in arrays] if sums is None else [s + n * a for s, a in zip(sums, arrays)]
        total, first = total + n, node if first is None else first
    payload = _put(*((s / total).astype(np.float32) for s in sums))
    return pa.table({"node": pa.array([first // FAN], pa.int32()), "tokens": [total], "payload": pa.array([payload], pa.binary())})


def _score(sent, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, z = sent.value
        for some, per, units in _pieces(batches, CHUNK):
            u1, u2 = _contexts(per, units)
            log = a[u1, units] + b[u2, units] - z[u1, u2]
            score = np.add.reduceat(log.astype(np.float64), np.cumsum(per) - per) / np.log(10) + np.asarray(some.column("share"))
            names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names[:4]), pa.array(np.full(len(per), total, np.int64)), some.column("base"), pa.array(score)], names)

    return run


def _corpus(docs: DataFrame, hot_rows: int) -> tuple[DataFrame, int, np.ndarray]:
    """Documents as units with what the counts of words give; training tokens; shares of the units."""
    spark = docs.sparkSession
    ws = Workspace(spark, "bilinear")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    encoded = ws.write(given.mapInArrow(_encode, "block long, code int, token string, ending byte, count long, payload binary"), "encoded")

    # The counts of a word meet in one task, but those of the words that very many blocks hold, which are pre-aggregated.
    columns = ("block", "code", "token", "ending", "c", "first")
    given_words = encoded.where("payload is null").drop("payload")
    hot = hot_keys(given_words, "token", ("block", "code"), least=hot_rows)
    by_word = Window.partitionBy("token")
    words = given_words if hot is None else given_words.join(F.broadcast(hot), "token", "left_anti")
    words = words.withColumn("c", F.sum("count").over(by_word)).withColumn("first", F.row_number().over(by_word.orderBy("block")) == 1).select(*columns)
    known = None
    if hot is not None:
        many = given_words.join(F.broadcast(hot), "token", "left_semi")
        known = ws.write(many.groupBy("token").agg(F.min("ending").alias("ending"), F.sum("count").alias("c")), "hot")
        words = words.unionByName(many.join(F.broadcast(known.select("token", "c")), "token").withColumn("first", F.lit(False)).select(*columns))
    words = ws.write(words, "words")
    types = words.where("first and c > 0").select("token", "ending", "c")
    if known is not None:
        types = types.unionByName(known.where("c > 0").select("token", "ending", "c"))
    n, v = types.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = types.where("token <> ''").orderBy(F.col("c").desc(), "token").limit(WORDS).toArrow()
    ends = types.where("token = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    tops = spark.createDataFrame([("", 0)] + [(t, i + 1) for i, t in enumerate(frequent.column("token").to_pylist())], "token string, top int")
    band = F.least(F.floor(F.log2(F.col("c"))), F.lit(BANDS - 1)).cast("int")
    rest = types.join(F.broadcast(tops), "token", "left_anti").groupBy(F.when(F.col("c") < 3, F.col("c") - 3).otherwise(band).cast("int").alias("band"), "ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("types")).collect()
    cells = np.zeros((BANDS, ENDINGS, 2))
    small = {(r["band"] + 3, r["ending"]): r["types"] for r in rest if r["band"] < 0}
    for r in rest:
        cells[{-2: 0, -1: 1}.get(r["band"], r["band"]), r["ending"]] += (r["c"], r["types"])
    # Of the words of the lowest band a new one is as likely as the words that occur once, a known one as those that occur twice.
    once = np.array([small.get((1, e), 0) for e in range(ENDINGS)], float)
    twice = np.array([small.get((2, e), 0) for e in range(ENDINGS)], float)
    new = np.where(once + twice > 0, once / np.maximum(once + 2 * twice, 1), 1.0)
    new = np.where(once > 0, np.clip(new, 0.01, 0.99), 1.0)
    classes = Classes((cells[..., 0] + 0.5 * cells[..., 1] + 1e-300).ravel(), np.log10(new), np.log10(np.maximum(1 - new, 1e-300) / np.maximum(once, 1)), int(n), int(v))
    share = np.full(UNITS, 0.5)
    share[0] += ends
    share[1 : 1 + len(frequent)] += frequent.column("c").to_numpy()
    share[1 + WORDS :] += cells[..., 0].ravel()
    share[1 + len(frequent) : 1 + WORDS] = 1e-6
    share /= share.sum()

    sent = spark.sparkContext.broadcast(classes)
    given_words = words.join(F.broadcast(tops), "token", "left").select("block", "code", "c", "ending", F.coalesce("top", F.lit(-1)).alias("top"))
    payloads = encoded.where("payload is not null").select("block", "payload")
    tasks = max(1, math.ceil(payloads.count() / 2))  # as many as two blocks each need, whatever the session's setting
    units = payloads.repartition(tasks, "block").groupBy("block").cogroup(given_words.repartition(tasks, "block").groupBy("block"))
    units = ws.write(units.applyInArrow(_units(sent), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, units binary"), "units")
    ws.drop("encoded", "words", "hot")
    return units, int(n), share


def base(docs: DataFrame, *, hot_rows: int = LEAST) -> DataFrame:
    """The columns of score that do not depend on the model, which is not trained for them."""
    units, n, _ = _corpus(docs, hot_rows)
    return units.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"))


def score(docs: DataFrame, *, rounds: int = ROUNDS, hot_rows: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text)."""
    spark = docs.sparkSession
    units, n, share = _corpus(docs, hot_rows)
    model = Model.start(share)
    state = [np.full(x.shape, 1e-6, np.float32) for x in model.arrays()]
    replicas = max(1, math.ceil(math.sqrt(n / SPREAD)))
    place = F.xxhash64("doc_id", "units")
    trained = units.where(~F.col("held_out")).withColumn("place", place).withColumn("replica", F.pmod(F.xxhash64("place"), F.lit(replicas)).cast("int"))
    for k in range(rounds):
        now = spark.sparkContext.broadcast(pickle.dumps((model, state, share)))
        part = trained.where(F.pmod("place", F.lit(rounds)) == k).select("replica", "place", "doc_id", "n_tokens", "units")
        part = part.repartitionById(replicas, F.col("replica")).sortWithinPartitions("place", "doc_id", "units")
        tree = part.mapInArrow(_train(now, k), "node int, tokens double, payload binary")
        nodes = replicas
        while nodes > FAN:
            tree = tree.groupBy(F.floor(F.col("node") / FAN)).applyInArrow(_average, "node int, tokens double, payload binary")
            nodes = math.ceil(nodes / FAN)
        found = sorted(tree.collect(), key=lambda r: r["node"])
        if found:
            total = sum(r["tokens"] for r in found)
            arrays = [sum(r["tokens"] / total * a for r, a in zip(found, x)) for x in zip(*(_get(r["payload"]) for r in found))]
            arrays = [np.asarray(a, np.float32) for a in arrays]
            model, state = Model(*arrays[:5]), arrays[5:]
    tables = tuple(x.astype(np.float32) for x in model.tables())
    return units.mapInArrow(_score(spark.sparkContext.broadcast(tables), n), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
