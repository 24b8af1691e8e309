r"""Toxicity by a classifier chain.

The categories form a chain of linear models: each sees the text's features and the log-odds that the earlier models
give. To train a later model, the earlier ones' log-odds come from models that did not see the document (out of fold),
so it learns how far they can be trusted on new text; to score, the models fitted on all training documents are chained.

Features are the presence of words (A-Z lowered, punctuation trimmed) and of their first letters (4, 5 and 6), and a few
dense measures of the text. Per model and fold, all features enter whose presence differs between the classes beyond
chance (a chi-square style score, its bound raised with the number of features tested). Logistic loss, L2, Newton steps
solved by conjugate gradients on the sparse columns.

Training reads at most `sample` labelled documents of at most `most_bytes` of text together: in the order of the hashes
of their ids, each that still fits. Everything is scored, whole texts. Defined results: a null or empty text, or a table
without usable labels, has probability 0 and is not toxic; labels that are null or belong to no text are not used; of
label rows that share an id the smallest is used, and of documents the text that sorts first; ties at the threshold are
toxic; repeated documents are scored each; other columns are carried by clean() only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.textarrow import blocks, strings, word_codes
from kindred.runtime import ship

#: (category, label as SQL over the label table), in the order of the chain.
CATEGORIES = (("junk", "1 - quality"), ("toxic", "toxic"))
SAMPLE, MOST_BYTES = 8_000, 100_000_000
_TRIM = ".,;:!?*%&$#()[]{}<>\"'`~-_=+/\\|@^"
DENSE = 5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(text of each feature, its code, distinct features, dense measures); a feature counts once per text."""
    n = len(texts)
    per, codes, words = word_codes(texts)
    trimmed = pc.utf8_trim(words.cast(pa.large_string()), _TRIM)
    units = [trimmed, *(pc.binary_join_element_wise(pa.scalar(f"{k}:", pa.large_string()), pc.utf8_slice_codeunits(pc.if_else(pc.greater_equal(pc.utf8_length(trimmed), k), trimmed, pa.scalar("", pa.large_string())), 0, k), pa.scalar("", pa.large_string())) for k in (4, 5, 6))]
    encoded = pa.concat_arrays([u.cast(pa.large_string()) for u in units]).dictionary_encode()
    names, ids = encoded.dictionary.to_pylist(), np.asarray(encoded.indices, dtype=np.int64)
    blank = np.array([x in ("", "4:", "5:", "6:") for x in names], bool) if names else np.zeros(0, bool)
    owner = np.repeat(np.arange(n), per)
    key = owner * len(words) + codes if len(words) else owner
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    owner, code = (key // len(words), key % len(words)) if len(words) else (key, key)
    out = np.concatenate([owner * len(names) + ids[code + k * len(words)] for k in range(len(units))]) if len(words) else key
    out.sort()
    out = out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out
    owner, code = (out // len(names), out % len(names)) if names else (out, out)
    keep = ~blank[code] if names else np.ones(0, bool)
    length = np.asarray(pc.utf8_length(texts), dtype=np.float64)
    bare = np.asarray(pc.utf8_length(words.cast(pa.large_string())), np.float64) - np.asarray(pc.utf8_length(trimmed), np.float64) if len(words) else np.zeros(0)
    who = np.repeat(np.arange(n), per)
    some = np.maximum(per, 1)
    distinct = np.bincount(key // max(len(words), 1), minlength=n) if len(key) else np.zeros(n)
    dense = np.column_stack([np.log1p(per), distinct / some, np.bincount(who, bare[codes], n) / np.maximum(length, 1) * 10 if len(words) else np.zeros(n), np.bincount(who, (bare[codes] > 1), n) / some if len(words) else np.zeros(n), length / some / 10])
    return owner[keep], code[keep], names, dense


@dataclass
class Linear:
    """Log-odds = bias + sum of weights of present features + dense measures and earlier log-odds times theirs."""

    columns: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def logits(self, owner: np.ndarray, code: np.ndarray, dense: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.columns, code), max(len(self.columns) - 1, 0))
        hit = self.columns[at] == code if len(self.columns) else np.zeros(len(code), bool)
        return self.bias + dense @ self.dense + np.bincount(owner[hit], self.weights[at[hit]], minlength=len(dense))


def _solve(apply, right: np.ndarray, scale: np.ndarray, most: int = 60, share: float = 0.02) -> np.ndarray:
    """Conjugate gradients, preconditioned by the diagonal, down to a share of the first residual."""
    x, r = np.zeros_like(right), right.copy()
    z = r / scale
    p, rz = z.copy(), float(r @ z)
    stop = share * share * rz
    for _ in range(most):
        if rz <= stop or rz == 0:
            break
        ap = apply(p)
        a = rz / float(p @ ap)
        x += a * p
        r -= a * ap
        z = r / scale
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return x


def fit(owner: np.ndarray, code: np.ndarray, dense: np.ndarray, y: np.ndarray, use: np.ndarray, *, l2: float = 1.0, rounds: int = 12) -> Linear:
    """A model from the documents that use marks; y is 0 or 1."""
    size = int(code.max(initial=-1)) + 1
    pos = np.bincount(code[(use & (y > 0.5))[owner]], minlength=size).astype(float)
    all_ = np.bincount(code[use[owner]], minlength=size).astype(float)
    n, p = max(use.sum(), 1), y[use].sum()
    share = min(max(p / n, 1e-6), 1 - 1e-6)
    score = np.where(all_ >= 3, (pos - all_ * share) ** 2 / np.maximum(all_ * share * (1 - share), 1e-9), 0)
    columns = np.flatnonzero(score > max(8.0, 2 * np.log(max((all_ >= 3).sum(), 1))))
    rows = np.flatnonzero(use)
    place, of = np.full(len(use), -1, np.int32), np.full(size, -1, np.int32)
    place[rows], of[columns] = np.arange(len(rows)), np.arange(len(columns))
    hit = np.flatnonzero((of >= 0)[code] & use[owner])
    i, j, k = place[owner[hit]], of[code[hit]], len(columns)
    d = np.hstack([dense[rows], np.ones((len(rows), 1))])
    target = y[rows]

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(i, w[j], minlength=len(rows)) + d @ w[k:]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(j, r[i], minlength=k), d.T @ r])

    w, decay = np.zeros(k + d.shape[1]), np.full(k + d.shape[1], l2)
    w[-1], decay[-1] = np.log(share / (1 - share)), 1e-6
    for _ in range(rounds):  # each step moves a log-odds by a bounded amount
        q = 1 / (1 + np.exp(-np.clip(times(w), -15, 15)))
        curve = np.maximum(q * (1 - q), 1e-4)
        scale = np.concatenate([np.bincount(j, curve[i], minlength=k), (d * d).T @ curve]) + decay
        step = _solve(lambda v: back(curve * times(v)) + decay * v, back(q - target) + decay * w, scale)
        w = w - step * min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-9))
        if np.abs(step).max() < 3e-3:
            break
    return Linear(columns, w[:k], w[k:-1], float(w[-1]))


@dataclass
class Chain:
    """Models in order, over a shared list of features, with the scale of the dense measures."""

    names: tuple[str, ...]
    vocabulary: np.ndarray
    models: tuple[Linear, ...]
    center: np.ndarray
    scale: np.ndarray
    threshold: float
    held_out: dict[str, float]

    def logits(self, texts: pa.Array) -> np.ndarray:
        owner, code, names, dense = features(texts)
        known = pc.index_in(pa.array(names, pa.large_string()), pa.array(self.vocabulary, pa.large_string()))
        mapped = np.asarray(pc.fill_null(known, -1), dtype=np.int64)
        code = mapped[code] if len(names) else code
        keep = code >= 0
        owner, code = owner[keep], code[keep]
        dense = (dense - self.center) / self.scale
        out = np.zeros((len(texts), len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = model.logits(owner, code, np.hstack([dense, np.clip(out[:, :k], -8, 8)]))
        return out


def cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The probability at which held-out documents are told apart best (F1), in the middle of the widest such gap; 0.5 if none is."""
    order = np.argsort(logits, kind="stable")
    z, hits = logits[order], y[order]
    if len(z) < 2:
        return 0.5
    above = hits[::-1].cumsum()[::-1][1:]  # positives at or above each cut between neighbours
    f1 = np.where(z[1:] > z[:-1], 2 * above / (len(z) - np.arange(1, len(z)) + hits.sum()), -1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = best[np.argmax(z[best + 1] - z[best])]
    middle = (z[at] + z[at + 1]) / 2
    return float(np.clip(1 / (1 + np.exp(-middle)), 0.05, 0.95)) if f1[at] > 0 else 0.5


def gathered(texts: pa.Array, step: int = 500) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """features() of many texts, a few at a time."""
    known: dict[str, int] = {}
    owners, codes, denses = [], [], [np.zeros((0, DENSE))]
    for at in range(0, len(texts), step):
        owner, code, names, dense = features(texts.slice(at, step))
        mapped = np.fromiter((known.setdefault(x, len(known)) for x in names), np.int32, len(names))
        owners.append((owner + at).astype(np.int32))
        codes.append(mapped[code] if len(names) else code.astype(np.int32))
        denses.append(dense)
    none = [np.zeros(0, np.int32)]
    return np.concatenate(owners or none), np.concatenate(codes or none), list(known), np.concatenate(denses)


def train(texts: pa.Array, labels: dict[str, np.ndarray], ids: np.ndarray, folds: int = 4) -> Chain:
    """The chain of models of these documents; labels by category in the chain's order."""
    owner, code, names, dense = gathered(texts)
    df = np.bincount(code, minlength=len(names))
    keep = np.flatnonzero(df >= 3)  # no score counts rarer ones
    place = np.full(len(names), -1, np.int32)
    place[keep] = np.arange(len(keep))
    code = place[code] if len(names) else code
    inside = code >= 0
    owner, code = owner[inside], code[inside]
    center, scale = (dense.mean(0), np.maximum(dense.std(0), 1e-6)) if len(dense) else (np.zeros(DENSE), np.ones(DENSE))
    dense = (dense - center) / scale
    n = len(texts)
    with np.errstate(over="ignore"):
        fold = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % folds
    earlier = np.zeros((n, 0))
    models, quality, threshold = [], {}, 0.5
    for name, y in labels.items():
        x = np.hstack([dense, earlier])
        models.append(fit(owner, code, x, y, np.ones(n, bool)))
        out = np.zeros(n)
        for k in range(folds):
            test = fold == k
            if test.any():
                out[test] = fit(owner, code, x, y, ~test).logits(owner, code, x)[test]
        p = 1 / (1 + np.exp(-out))
        tp, fp, fn = (((p >= 0.5) & (y == 1)).sum(), ((p >= 0.5) & (y == 0)).sum(), ((p < 0.5) & (y == 1)).sum())
        quality[name] = float(2 * tp / max(2 * tp + fp + fn, 1))
        threshold = cut(out, y)
        earlier = np.hstack([earlier, np.clip(out, -8, 8)[:, None]])
    # Only features that a model uses are kept.
    used = np.unique(np.concatenate([m.columns for m in models])) if models else np.zeros(0, np.int64)
    for m in models:
        m.columns = np.searchsorted(used, m.columns)
    vocabulary = np.array([names[i] for i in keep[used]], dtype=object)
    return Chain(tuple(labels), vocabulary, tuple(models), center, scale, threshold, quality)


def labelled(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...], sample: int, most_bytes: int = MOST_BYTES) -> pa.Table:
    """The training documents, one row per id: of the labels that have a text, in the order of their ids' hashes, each that fits."""
    spark = docs.sparkSession
    names = [f"_{name}" for name, _ in categories]
    usable: Column = F.col("doc_id").isNotNull()
    for name in names:
        usable = usable & F.col(name).isNotNull()
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(f"cast({sql} as double)").alias(f"_{name}") for name, sql in categories))
    known = known.where(usable).groupBy("doc_id").agg(F.min(F.struct(*names)).alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")
    sizes = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).cast("long").alias("bytes"))
    first = sizes.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    chosen, held = [], 0
    for row in first:
        if held + row["bytes"] <= most_bytes:
            held += row["bytes"]
            chosen.append((row["doc_id"], *row["y"]))
    few = spark.createDataFrame(chosen, ", ".join(["doc_id long", *(f"{n} double" for n in names)]))
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text")).toArrow()


def classify(docs: DataFrame, labels: DataFrame, *, categories: tuple[tuple[str, str], ...] = CATEGORIES, sample: int = SAMPLE, most_bytes: int = MOST_BYTES, target: str = "toxic", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, p_<category> for each of the chain, toxic boolean; and the columns to carry as _c0, _c1 and so on, whatever their names."""
    spark = docs.sparkSession
    ship(spark)
    table = labelled(docs, labels, categories, sample, most_bytes)
    order = np.argsort(np.asarray(table.column("doc_id"), dtype=np.int64), kind="stable")
    table = table.take(pa.array(order))
    ys = {name: np.asarray(table.column(f"_{name}"), dtype=np.float64) for name, _ in categories}
    trained = len(order) > 0 and len(np.unique(ys[target])) > 1
    chain = train(strings(table), ys, np.asarray(table.column("doc_id"), dtype=np.int64)) if trained else None
    sent = spark.sparkContext.broadcast(chain)
    names = [name for name, _ in categories]
    others = [(f"_c{i}", docs.schema[name].dataType) for i, name in enumerate(carry)]
    extra = [f"{name} {kind.simpleString()}" for name, kind in others]
    fields = ", ".join(["doc_id long", *(f"p_{n} double" for n in names), "toxic boolean", *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for block in blocks(batches, 6_000_000):
            texts = strings(block)
            n = len(texts)
            p = 1 / (1 + np.exp(-np.clip(model.logits(texts), -500, 500))) if model else np.zeros((n, len(names)))
            empty = np.asarray(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(texts)), 0))
            p[empty] = 0
            flag = p[:, names.index(target)] >= (model.threshold if model else 2.0)
            arrays = {"doc_id": block.column("doc_id"), **{f"p_{c}": p[:, k] for k, c in enumerate(names)}, "toxic": flag}
            arrays |= {name: block.column(name) for name, _ in others}
            yield from pa.table(arrays).to_batches()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{name}`").alias(f"_c{i}") for i, name in enumerate(carry)))
    return given.mapInArrow(run, fields)


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not toxic, with the columns they came with."""
    found = classify(docs, labels, carry=tuple(docs.columns), **options)
    return found.where(~F.col("toxic")).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
