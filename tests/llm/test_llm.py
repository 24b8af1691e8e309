"""Every operator against a brute-force version on small tables, and on the awkward ones."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make themselves, which a table may bring along.
CLASHING = ("size", "source_size", "target", "copies", "toxic", "spans", "base", "n_email", "component_id", "node", "_id", "_key", "nth", "key", "p_toxic", "_k0", "_c0", "ids")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def vocabulary(r, n=300):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages, secrets, personal data, empty ones and a long one."""
    r = random.Random(seed)
    w = vocabulary(r)
    out = [" ".join(r.choice(w) for _ in range(r.randint(1, 120))) for _ in range(n)]
    passage = " ".join(r.choice(w) for _ in range(60))
    for i in range(0, n, 6):
        out.append(out[i])
        near = out[i].split(" ")
        near[-1] = "changed"
        out.append(" ".join(near))
        out.append(f"{r.choice(w)} {passage} {r.choice(w)}")
    out += ["", " \t\n", "One", "Two words", "ÜBER Straße", 'token = "0123456789abcdef0123456789abcdef" mail a.b@c.de +1 (499) 555-6503 10.0.0.1 4111 1111 1111 1111', "aaaa" * 100, " ".join(r.choice(w) for _ in range(9000)), "<|endoftext|> two  spaces   three \n\n x"]
    return out


def rows(texts):
    sources = ["s1", "s2", "s2", "s2", None, "ß"]
    return [(i, t, "en", sources[i % 6], len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(corpus()), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, ties, repeated rows, and columns of names that operators use."""
    base = rows(corpus(5, 12)) + [(7, "same id, other text " * 8, "en", "s1", 1), (None, "no id here " * 12, None, None, None), (None, None, None, None, None), (900, None, "en", "s1", None), (901, "", None, "s2", 0)]
    df = spark.createDataFrame(base + base[:3], SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(1).alias(c) for c in CLASHING)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def everything(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


# -- 1


def toxic_rows(seed=1, n=400):
    r = random.Random(seed)
    w = vocabulary(r)
    out, labels = [], []
    for i in range(n):
        t = [r.choice(w) for _ in range(r.randint(5, 80))]
        bad = i % 7 == 0
        if bad:
            for _ in range(3):
                t.insert(r.randint(0, len(t)), r.choice(["Idiot", "moron,", "scumbag", "trashy"]))
        out.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, int(i % 5 != 0), int(bad)))
    return out, labels


def test_toxicity(spark):
    from kindred.llm import toxicity

    docs, labels = toxic_rows()
    df = spark.createDataFrame(docs, SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] < 280] + [(None, 1, 1), (3, None, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.classify(df, known), "toxic", "p_toxic", "p_junk")
    unseen = [(bool(t), got[i][0]) for i, _, t in labels if i >= 280]
    assert sum(a == b for a, b in unseen) >= 0.97 * len(unseen)
    assert all(0 <= p <= 1 for _, p, q in got.values() for p in (p, q))
    kept = {r["doc_id"] for r in toxicity.clean(df, known).collect()}
    assert kept == {i for i, g in got.items() if not g[0]}


def test_toxicity_chain_uses_held_out_predictions():
    from kindred.llm import toxicity
    from kindred.llm.textarrow import strings

    import pyarrow as pa

    docs, labels = toxic_rows()
    chain = toxicity.train(strings(pa.table({"text": [d[1] for d in docs]})), {"junk": np.array([1.0 - x[1] for x in labels]), "toxic": np.array([float(x[2]) for x in labels])}, np.arange(len(docs)))
    assert len(chain.models[1].dense) == toxicity.DENSE + 1 and chain.held_out["toxic"] > 0.95


def test_toxicity_labels_without_text_use_up_nothing(spark):
    from kindred.llm import toxicity

    docs, labels = toxic_rows(n=100)
    df = spark.createDataFrame(docs + [(5000 + i, None, "en", "s", 0) for i in range(300)], SCHEMA)
    known = spark.createDataFrame(labels + [(5000 + i, 1, 0) for i in range(300)] + [(9000 + i, 1, 1) for i in range(300)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled(df, known, toxicity.CATEGORIES, 60).num_rows == 60
    # Neither rows that repeat an id nor long texts get past the bounds.
    again = df.union(df.where("doc_id = 3")).union(df.where("doc_id = 3"))
    assert toxicity.labelled(again, known.union(known.where("doc_id = 3")), toxicity.CATEGORIES, 1000).num_rows == 100
    some = toxicity.labelled(df, known, toxicity.CATEGORIES, 60, 3000)
    assert 0 < some.num_rows < 60 and sum(len(x.as_py().encode()) for x in some.column("text")) <= 3000


def test_toxicity_of_a_very_long_text(spark):
    from kindred.llm import toxicity

    docs, labels = toxic_rows()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    long_ = " ".join(d[1] for d in docs if d[0] % 7) * 20
    got = by_id(toxicity.classify(spark.createDataFrame(docs + [(8000, long_, "en", "s", 0)], SCHEMA), known), "toxic", "p_toxic")
    assert len(long_) > 1_000_000 and got[8000][1] is not None


def brute_chain(docs, labels):
    """The chain again, plainly: dense Newton on the presence of features, later models on out-of-fold log-odds."""
    from kindred.llm import toxicity as X
    from kindred.llm.textarrow import strings

    import pyarrow as pa

    owner, code, names, dense = X.features(strings(pa.table({"text": [d[1] for d in docs]})))
    n = len(docs)
    present = np.zeros((n, len(names)))
    present[owner, code] = 1
    dense = (dense - dense.mean(0)) / np.maximum(dense.std(0), 1e-6)
    fold = np.array([(i * 0x9E3779B97F4A7C15 % 2**64 >> 40) % 4 for i in range(n)])
    tested = (present.sum(0) >= 3).sum()

    def fit(x, y, use):
        share = y[use].mean()
        often = present[use].sum(0)
        score = np.where((often >= 3), ((present[use] * y[use][:, None]).sum(0) - often * share) ** 2 / np.maximum(often * share * (1 - share), 1e-9), 0)
        columns = np.flatnonzero(score > max(8, 2 * math.log((often >= 3).sum())))
        a = np.hstack([present[:, columns], x, np.ones((n, 1))])
        decay = np.append(np.ones(a.shape[1] - 1), 1e-6)
        w = np.zeros(a.shape[1])
        w[-1] = math.log(share / (1 - share))
        for _ in range(60):
            q = 1 / (1 + np.exp(-a[use] @ w))
            h = (a[use] * (q * (1 - q))[:, None]).T @ a[use] + np.diag(decay)
            w = w - np.linalg.solve(h, a[use].T @ (q - y[use]) + decay * w)
        return lambda x: np.hstack([present[:, columns], x, np.ones((n, 1))]) @ w

    assert tested > 0
    earlier_out, earlier_in = np.zeros((n, 0)), np.zeros((n, 0))
    for y in (np.array([1.0 - x[1] for x in labels]), np.array([float(x[2]) for x in labels])):
        x = np.hstack([dense, earlier_out])
        out = np.zeros(n)
        for k in range(4):
            out[fold == k] = fit(x, y, fold != k)(x)[fold == k]
        whole = fit(x, y, np.ones(n, bool))(np.hstack([dense, earlier_in]))
        earlier_out, earlier_in = np.hstack([earlier_out, np.clip(out, -8, 8)[:, None]]), np.hstack([earlier_in, np.clip(whole, -8, 8)[:, None]])
    return 1 / (1 + np.exp(-whole))


def test_toxicity_equals_a_plain_chain(spark):
    from kindred.llm import toxicity

    docs, labels = toxic_rows(seed=2, n=300)
    df, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.classify(df, known), "p_toxic")
    want = brute_chain(docs, labels)
    assert max(abs(got[i][0] - want[i]) for i in range(len(docs))) < 0.02


def test_toxicity_awkward(spark, awkward, empty):
    from kindred.llm import toxicity

    _, labels = toxic_rows()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for known in (none, spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, None, 0)], none.schema)):
        got = toxicity.clean(awkward, known)
        assert got.columns == awkward.columns and (known is not none or got.count() == awkward.count())
        assert toxicity.classify(empty, known).count() == 0
    blank = toxicity.classify(awkward, none).where("doc_id = 900").first()
    assert blank["p_toxic"] == 0 and not blank["toxic"]


# -- 2


def vectors(seed=2):
    r = np.random.default_rng(seed)
    base = r.normal(size=(150, 16))
    near = [base[i % 20] + r.normal(size=16) * 0.05 for i in range(60)]
    dense = [base[149] + r.normal(size=16) * 0.03 for _ in range(150)]
    return np.vstack([base, near, dense, base[3:5], 7 * base[8:9]])


def brute_links(x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[i], *label[s[i]], label[i]) if s[i].any() else label[i] for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return s.sum(1), label


def test_neighbours(spark):
    from kindred.llm import neighbours

    x = vectors()
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0, 2.0]), (1005, [1.0, 2.0]), (None, [1.0] * 16), (1006, [])]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, 1) for i, v in odd], "vec_id long, embedding array<double>, label int")
    from pyspark.sql import functions as F

    clashing = df.select("*", *(F.lit(1).alias(c) for c in ("id", "vec", "good", "h1", "dim", "links", "component", "node", "named", "copies")))
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(clashing, threshold=0.95, leaf=32, tile=64).collect()}
    links, label = brute_links(x, 0.95)
    assert len(got) == len(x) + len(odd)
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist() and [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(got[i]["kept"] == (label[i] == i) for i in range(len(x))) and neighbours.LAST_AUDIT["recall"] >= 0.98 and neighbours.LAST_AUDIT["probe_recall"] >= 0.98
    assert [got[i]["n_links"] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006)] == [0, 0, 0, 0, 1, 1, 0] and got[1005]["component_id"] == 1004 and not got[None]["kept"]
    assert neighbours.near_duplicates(df.limit(0)).count() == 0
    twice = {r["vec_id"]: r["n_links"] for r in neighbours.near_duplicates(df.where("vec_id in (50, 51)").union(df.where("vec_id = 50"))).collect()}
    assert twice == {50: 1, 51: 0}


def pairs_apart(n, pairs, seed=5):
    """Vectors with few links: near copies in pairs that have no other neighbour."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 32))
    x[n - pairs :] = x[:pairs] + r.normal(size=(pairs, 32)) * 0.2
    return x


def linked_of(df, **options):
    from kindred.llm import neighbours

    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("pairs,options", [(6, {}), (0, {}), (500, {"leaf": 8, "size": 2, "trees": 1, "rounds": 1, "batches": 1})])
def test_neighbours_whose_links_are_rare_or_missed(spark, pairs, options):
    from kindred.llm import neighbours

    x = pairs_apart(2000, pairs)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = linked_of(df, **options)
    links, label = brute_links(x.astype(np.float32).astype(float), 0.95)
    assert links.sum() >= pairs and {i: g for i, g in got.items() if g != (links[i], label[i])} == {}
    audit = neighbours.LAST_AUDIT  # measured on probes, whether or not the table has links
    assert audit["exact"] == bool(options) and audit["probes"] > 400 and (audit["probe_recall"] >= 0.98) != bool(options) and (pairs or "recall" not in audit)


@pytest.mark.parametrize("options", [{"sample": 32, "audit": 1.1, "batches": 1, "block": 100}, {"size": 4, "most": 8, "tile": 16}, {"size": 4, "most": 8}])
def test_neighbours_dense_or_by_exact_comparison(spark, options):
    from kindred.llm import neighbours

    x = np.vstack([vectors(), vectors()[149] + np.random.default_rng(5).normal(size=(120, 16)) * 0.35])  # with copies, a tight and a loose dense part
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1004, [1.0, 2.0]), (1005, [1.0, 2.1])], "vec_id long, embedding array<double>")
    links, label = brute_links(x, 0.95)
    want = {i: (links[i], label[i]) for i in range(len(x))} | {1004: (1, 1004), 1005: (1, 1004)}
    got = linked_of(df, **options)
    assert neighbours.LAST_AUDIT["exact"] == ("audit" in options)
    if "audit" in options:
        assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    # Short lists: what lies in a dense part is counted in full, a vector outside may be missed.
    assert all(got[i][0] <= want[i][0] for i in want) and sum(g for g, _ in got.values()) >= 0.98 * links.sum()
    assert sum(got[i] == want[i] for i in range(210, 360)) > 100


def test_neighbours_below_half(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(600, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links, label = brute_links(x, 0.4)
    assert linked_of(df, threshold=0.4) == {i: (links[i], label[i]) for i in range(600)}


# -- 3


def test_topk(spark):
    from kindred.llm.topk import exact_topk

    r = np.random.default_rng(4)
    x = r.integers(-3, 3, size=(130, 8)) / 4.0
    odd = [(500, None), (501, [float("inf")] * 8), (502, [None] * 8), (503, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd + [(7, x[7].tolist())], "vec_id long, embedding array<double>")
    q = np.floor(256 * x)
    want = set()
    pool = [(i, q[i]) for i in range(130)] + [(7, q[7])]
    for i in range(0, 130, 50):
        best = sorted((-int(q[i] @ v), j) for j, v in pool if j != i)[:5]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    for options in ({}, {"shard_rows": 16, "block_rows": 2, "fan": 3}):
        got = [tuple(r) for r in exact_topk(df, df.where("vec_id % 50 = 0"), **options).collect()]
        assert set(got) == want and len(got) == len(want)
    low = spark.createDataFrame([(0, [3500.0])] + [(i, [-3500.0 - i]) for i in range(1, 10)], "vec_id long, embedding array<float>")
    got = [tuple(r)[:3] for r in exact_topk(low, low.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, i, i) for i in range(1, 6)]  # scores far below zero
    from pyspark.sql import functions as F

    extra = df.select("*", *(F.lit(1).alias(c) for c in ("dim", "shard", "block", "list", "rank", "score", "query_id", "own")))
    assert {tuple(r) for r in exact_topk(extra, extra.where("vec_id % 50 = 0"), tile_bytes=2000).collect()} == want
    few = exact_topk(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert len(few) == 2 and exact_topk(df.limit(0), df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9]), (2, [2.0, 1.0]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_topk(big, big.where("vec_id = 0")).orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 3, 2] and got[0][3] == 2**63 - 1 and got[2][3] == 256_000_000_000 * 768


# -- 4


def levels(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / max(sum(weight[s] for s in names if s not in capped), 1e-9)
        new = {s for s in names if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not new:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= new


@pytest.mark.parametrize("small", [20_000, 0])
def test_mixing(spark, docs, small):
    from kindred.llm import mixing

    got = mixing.mix(docs, leaf_docs=7, small=small).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"]))
    want = levels(sizes)
    assert len(got) == docs.count() and all(abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] for r in got)
    texts = everything(docs)
    assert all(r["size"] == len(WORD.findall(texts[r["doc_id"]])) for r in got)
    for s in want:  # each source takes its target, however long its documents are
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want[s]) <= 0.51 and sum(r["part"] > 0 for r in got if r["source"] == s) <= 1
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["part"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5), leaf_docs=7).collect()), key=str)
    out = [(r["doc_id"], len(WORD.findall(r["text"])), r["n_chars"] == len(r["text"]), texts[r["doc_id"]].startswith(r["text"])) for r in mixing.apply(docs, leaf_docs=7, small=small).collect()]
    assert sorted(out) == sorted((r["doc_id"], n, True, True) for r in got for n in [r["size"]] * r["copies"] + [r["part"]] * (r["part"] > 0))


def test_targets_of_many_sources(spark):
    from kindred.llm import mixing
    from kindred.runtime import Workspace

    r = random.Random(13)
    sizes = {f"s{r.random()}": r.choice([0, 1, 5, 400, 90_000]) for _ in range(300)} | {None: 70}
    df = spark.createDataFrame([(k, n, 1) for k, n in sizes.items()], "source string, source_size long, source_docs long").repartition(7)
    want = levels(sizes)
    for small in (20_000, 0):
        got = {x["source"]: x["target"] for x in mixing.targets(Workspace(spark, "test"), df, small=small).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert mixing.targets(Workspace(spark, "test"), df.limit(0)).count() == 0


def test_pivot_keeps_words_and_expectation():
    from kindred.llm.mixing import pivot

    r = random.Random(6)
    for _ in range(200):
        p, w, q, v = r.random(), r.randint(1, 50), r.random(), r.randint(1, 50)
        mean, n = np.zeros(2), 400
        for k in range(n):
            a, b = pivot((p, w), (q, v), (k + 0.5) / n)
            assert min(a, 1 - a, b, 1 - b) < 1e-9 and abs(a * w + b * v - p * w - q * v) < 1e-6
            mean += (a, b)
        assert np.allclose(mean / n, (p, q), atol=0.01)


def test_mixing_awkward(awkward, empty):
    from kindred.llm import mixing

    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count() and mixing.mix(empty).count() == 0 and mixing.apply(empty).count() == 0
    sizes = {}
    for r in awkward.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    want = levels(sizes)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r["doc_id"]), len(WORD.findall(r["text"] or ""))) for r in awkward.collect())
    for s in want:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want[s]) <= 0.51
    out = mixing.apply(awkward).collect()
    assert mixing.apply(awkward).columns == awkward.columns
    for s in want:  # rows that share an id are told apart
        assert abs(sum(len(WORD.findall(r["text"] or "")) for r in out if r["source"] == s) - want[s]) <= 0.51


# -- 5 and 6


def brute_base(kind, text):
    if kind == "secrets":
        names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
        out = [("assign", *m.span()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
        out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


PIECES = {
    "secrets": ["token", "API_KEY", "password", " ", '"', "=", ":", "AKIA", "ABCDEFGH", "1234567890ab", "cafe0123" * 2, "deadbeef", "\n", "\n\n", "ſecret", "user=", "bob", "http://h.x/", "é", "'", "Zz9/"],
    "pii": ["@", "a", "b.c", "@x.y", ".", "1", "23", "4111 1111-1111 1111", "4", "+", "+1 ", "(", ")", " ", "-", "255", "256", "é", "\n", "x@y.z", "iban: ", "account no ", "http://", "日", "%"],
}


@pytest.mark.parametrize("kind", ["secrets", "pii"])
def test_spans(spark, kind, docs):
    from kindred.llm import pii, secrets

    module = {"secrets": secrets, "pii": pii}[kind]
    r = random.Random(8)
    texts = ["".join(r.choice(PIECES[kind]) for _ in range(r.randint(0, 24))) for _ in range(4000)] + list(everything(docs).values()) + ["7" * 5000, "1.1.1." * 500, "a" * 3000 + "@", "+1" * 2000]
    find = module.finder(False) if kind == "pii" else module.finder(400, 3.5, None)
    for t in texts:
        base, spans, _ = find(t)
        assert kind == "pii" or not spans or re.search(secrets.CUES, t)
        assert base == brute_base(kind, t) and set(base) <= set(spans) and all(0 <= a < b <= len(t) for _, a, b in spans)
    got = by_id(module.scan(docs), "base", "spans", *(f"n_{k}" for k in module.BASE))
    for i, t in everything(docs).items():
        base = brute_base(kind, t)
        assert got[i][0] == ",".join(f"{k}:{a}:{b}" for k, a, b in base) and got[i][2:] == tuple(sum(s[0] == k for s in base) for k in module.BASE)


def test_weak_parts_need_company():
    from kindred.llm.secrets import finder

    find = finder(400, 3.5, None)
    key = "Zk3vQ9xT7mB2nR8wL5yU"
    weak = lambda t: [s[0] for s in find(t)[1]]
    assert weak(f"see {key} here") == [] and weak("user = alice99") == []
    assert weak(f"user = alice99 and {key}") == ["ident", "key"]
    assert weak(f"user = alice99\n\n{key}") == [] and weak(f"user = alice99 {'x ' * 300}{key}") == []
    assert weak(f"https://host.example/api {key}") == ["endpoint", "key"]
    assert weak('token = "abcdefgh" host db.example.com:5432') == ["assign", "endpoint"]
    assert weak(f"user = alice99\r\n\r\n{key}") == [] and weak(f"user = alice99\r\n{key}") == ["ident", "key"]
    path = "user = alice99 https://host.example/Zk3vQ9xT7/mB2nR8wL5yU"
    assert weak(path) == [] and weak(f"https://host.example/a?{key}") == weak(f"https://bob:{key}@host.example/a") == ["endpoint", "key"]


def test_masking(spark, awkward, empty):
    from kindred.llm import pii

    assert pii.masked("x a@b.cd y", [("email", 2, 8)]) == "x <EMAIL> y" and pii.masked("abcdef", [("ip", 0, 3), ("card", 2, 5)]) == "<IP>f"
    for text, value in (("IBAN: DE44 5001 0517 5407 3249 31 end", "DE44 5001 0517 5407 3249 31"), ("iban = GB29 NWBK 6016 1331 9268 19 and", "GB29 NWBK 6016 1331 9268 19"), ("account no " + "1234 " * 9 + "then", ("1234 " * 9).strip()), ("Account: AB-12345 OK", "AB-12345")):
        assert [text[a:b] for k, a, b in pii.finder(False)(text)[1] if k == "account"] == [value]
    out = pii.mask(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count() and pii.mask(empty).count() == 0
    texts = [r["text"] for r in out.collect()]
    assert None in texts and any("<EMAIL>" in (t or "") for t in texts) and not any("a.b@c.de" in (t or "") for t in texts)
    assert all(r["n_chars"] == len(r["text"]) for r in out.where("text is not null").collect())


def test_scans_awkward(awkward, empty):
    from kindred.llm import pii, secrets

    for module, kind in ((pii, "pii"), (secrets, "secrets")):
        found = sorted((str(r["doc_id"]), r["base"]) for r in module.scan(awkward).collect())
        assert found == sorted((str(r["doc_id"]), ",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(kind, r["text"] or ""))) for r in awkward.collect())
        assert module.scan(empty).count() == 0


# -- 7


def words_of(text):
    return WORD.findall(lower(text)) + [""]


def test_bilinear(docs, awkward, empty):
    from kindred.llm import bilinear

    got = by_id(bilinear.score(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    texts = everything(docs)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = {}
    for i, t in texts.items():
        for w in words_of(t) if not held[i] else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens = words_of(t)
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert got[i][:4] == (held[i], len(tokens), sum(w in counts for w in tokens), n) and abs(got[i][4] - base) < 1e-9 * max(1, abs(base)) and got[i][5] < 0
    # The same scores whatever the partitions, and where the words of many rows are pre-aggregated.
    again = by_id(bilinear.score(docs.repartition(5), hot_rows=2), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert {i: (got[i], again[i]) for i in got if got[i][:4] != again[i][:4] or not np.allclose(got[i][4:], again[i][4:], rtol=1e-9)} == {}
    odd = bilinear.score(awkward).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in odd) == sorted((str(r["doc_id"]), len(words_of(r["text"] or ""))) for r in awkward.collect())
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in odd) and bilinear.score(empty).count() == 0


def test_bilinear_learns_and_is_normalised():
    from kindred.llm import bilinear as B

    r = np.random.default_rng(1)
    share = np.full(40, 1 / 40)
    text = [0]
    for _ in range(60_000):  # each unit is mostly followed by the next one
        text.append((text[-1] + 1) % 40 if r.random() < 0.8 else int(r.integers(40)))
    w = np.array(text[2:])
    u1, u2 = np.array(text[1:-1]), np.array(text[:-2])
    model = B.Model.start(share)
    state = [np.full(x.shape, 1e-6, np.float32) for x in model.arrays()]
    for k in range(3):
        B.nce(model, state, share, u1, u2, w, np.random.default_rng(k))
    a, b, z = model.tables()
    total = np.exp(a[:, None, :] + b[None, :, :] - z[:, :, None]).sum(2)
    assert np.allclose(total, 1)
    assert (a[u1, w] + b[u2, w] - z[u1, u2]).mean() > math.log(1 / 40) + 1.5


# -- 8


def brute_repeats(texts, length):
    seen, out = set(), {}
    for i, t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most,hot", [(3_000_000, 200_000), (0, 4)])
def test_repeats(spark, docs, most, hot):
    from kindred.llm import suffixes

    r = random.Random(9)
    a = "".join(r.choice("abcdé") for _ in range(400))
    extra = [a, "xy" + a[50:300] + "zz" + a[:260], a[100:199], a[100:200], "ab" * 200, "ab" * 90, "日" * 80, a[:150] + "!" + a[151:400]]
    texts = list(everything(docs).items()) + [(1000 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = by_id(suffixes.repeats(df, most_sent=most, hot_rows=hot), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute_repeats(sorted(texts), 100)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_repeats_awkward(spark, awkward, empty):
    from kindred.llm import suffixes

    out = suffixes.repeats(awkward).collect()
    # Each text but the first of equal ones goes whole where it has 100 bytes; null ids come first.
    texts = [(r["text"] or "").encode() for r in awkward.collect()]
    assert sorted(r["n_bytes"] for r in out) == sorted(map(len, texts)) and suffixes.repeats(empty).count() == 0
    assert {r["n_removed"] for r in out if r["n_bytes"] < 100} == {0}
    whole = [t for t in texts if len(t) >= 100]
    assert sum(r["n_removed"] == r["n_bytes"] for r in out if r["n_bytes"] >= 100) >= len(whole) - len(set(whole))
    r = random.Random(1)
    long_ = "".join(r.choice("abcdefgh") for _ in range(300))
    twice = spark.createDataFrame([(5, long_), (5, long_), (None, long_)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffixes.repeats(twice).collect()) == [0, 300, 300]


def test_repeats_names_that_share_32_bits(spark):
    from kindred.llm import suffixes

    passage = "buqougwizijkiuecxjfusttpzdujrwlzfsdebweeligjikqdoeotibzklazmscjarvifbvygluklvrszvfqqcctmzertacilhbjmgxzuemuxgmagednvpduq"
    heads = ["cqgrswlkhjodmrgfeuzjfqtskbsodbklvzrthtga", "vvehdnotsocnvpkcrtxmdszhqzmtiejlcfxelrad", "qnxlzipzqielmezwgcwrlkpqrykdmnmljukacfsm", "dwtsmdiqmajzchgvynpcunihaesgqtvbsmvkpqsw", "eksegwjsnrunxkhagmtptyonvhyqplarffwuwgkz", "vgefzvtmzbholcreibejrryhobuinriljywzokkh"]
    for k in (0, 2, 4):  # the runs that cross into the passage have one anchor and names of equal upper halves
        texts = [(i, heads[k + i] + passage) for i in range(2)]
        got = by_id(suffixes.repeats(spark.createDataFrame(texts, "doc_id long, text string")), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute_repeats(texts, 100)


def test_repeats_looks_only_at_open_rows(monkeypatch):
    import pyarrow as pa

    from kindred.llm import suffixes

    text = "".join(random.Random(3).choices("abcdefgh ", k=200_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([7, 8], pa.int64()), "nth": pa.array([0, 0], pa.int64()), "text": [text, "short"]})
    rows = pa.Table.from_batches(suffixes._rows(100, 0, None)(iter([batch]))).sort_by("first").to_pylist()
    assert [r["first"] for r in rows[1:]] == [r["last"] + 1 for r in rows[:-1]] and rows[-1]["last"] == 200_000 - 100
    seen, real = [], suffixes.identifiers
    monkeypatch.setattr(suffixes, "identifiers", lambda data: seen.append(len(data)) or real(data))
    some = whole = [(r["first"], r["last"]) for r in rows[5:6] + rows[40:42] + rows[-1:]]
    for level in (1, 2):
        open_ = batch.append_column("open", pa.array([[(f << 8) + e - f for f, e in some], []], pa.list_(pa.int64())))
        batches = list(suffixes._rows(100, level, None)(iter([open_])))
        assert 0 < sum(seen) < 5_000
        found = pa.Table.from_batches(batches).to_pylist()
        some = sorted((r["first"], r["last"]) for r in found)
        assert sorted(w for f, e in some for w in range(f, e + 1)) == [w for f, e in whole for w in range(f, e + 1)]
        assert max(e - f for f, e in some) < (8 if level == 1 else 1) and {r["doc_id"] for r in found} == {7}


# -- 9


def brute_similar(texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label, links = {i: i for i in sets}, dict.fromkeys(sets, 0)
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), links[i], label[i]) for i in sets}


@pytest.mark.parametrize("tile,sent,hot,cell", [(128, 1_000_000, 200_000, 1024), (2, 0, 10, 3)])
def test_similar(spark, docs, tile, sent, hot, cell, monkeypatch):
    from kindred.llm import jaccard

    monkeypatch.setattr(jaccard, "SENT", sent)
    r = random.Random(10)
    base = [f"w{r.randint(0, 999)}" for _ in range(100)]
    extra = []
    for i in range(40):  # around the threshold: a word changed costs five shingles
        t = list(base)
        for _ in range(r.randint(0, 2)):
            t[r.choice([0, 99, r.randint(0, 99)])] = f"n{i}"
        extra.append(" ".join(t))
    texts = list(everything(docs).items()) + [(1000 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = by_id(jaccard.similar(df, tile=tile, hot_rows=hot, cell=cell), "n_shingles", "n_similar", "component_id")
    want = brute_similar(texts)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_deduplicate(awkward, empty, docs):
    from kindred.llm import jaccard

    want = {i for i, x in brute_similar(list(everything(docs).items())).items() if x[2] == i}
    assert {r["doc_id"] for r in jaccard.deduplicate(docs).collect()} == want
    # Rows that share an id belong to the component of their own text each: brute force over rows, by id and then text.
    given = [(r["doc_id"], r["text"] or "") for r in awkward.collect() if r["doc_id"] is not None]
    found = brute_similar([((i, k), t) for k, (i, t) in enumerate(given)])
    blank = {x for x, f in found.items() if not f[0]}
    want = sorted((x[0], given[x[1]][1]) for x, f in found.items() if f[2] == x or x in blank)
    out = jaccard.deduplicate(awkward)
    assert out.columns == awkward.columns and sorted((r["doc_id"], r["text"] or "") for r in out.collect() if r["doc_id"] is not None) == want
    assert [i for i, _ in want].count(7) == 2 and sum(r["doc_id"] is None for r in out.collect()) == awkward.where("doc_id is null").count()
    size = {t: f[0] for (_, k), f in found.items() for t in [given[k][1]]}
    got = jaccard.similar(awkward).collect()
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] is not None) == sorted(size[t] for _, t in given) and len(got) == awkward.count()
    assert all(r["n_similar"] == 0 for r in got if r["doc_id"] is None) and jaccard.deduplicate(empty).count() == 0


def test_components(spark):
    from kindred.llm.graph import connected_components
    from kindred.runtime import Workspace

    r = random.Random(11)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    for limit in (2_000_000, 0):
        got = {r["node"]: r["component"] for r in connected_components(Workspace(spark, "test"), df, one_task=limit).collect()}
        assert got == label


# -- 10


def test_packing(docs, awkward, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from kindred.llm import packing

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(path)
    for block in (16_000_000, 3000):
        got = packing.pack(docs, path, block_bytes=block).collect()
        pieces = {}
        for r in got:
            pieces.setdefault(r["doc_id"], []).append(r)
        for i, t in everything(docs).items():
            ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
            mine = sorted(pieces[i], key=lambda r: r["start"])
            assert [x for r in mine for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in mine)
            assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in mine)
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 2048 and at & (at - 1) == 0  # no padding at all
    assert {r["doc_id"] for r in packing.pack(awkward, path).collect()} == {r["doc_id"] for r in awkward.collect()}
    assert packing.pack(empty, path).count() == 0


def test_encoder_is_lossless_in_white_space():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from kindred.llm.packing import Encoder

    encoder = Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    r = random.Random(12)
    pieces = [" ", " ", " ", "\u00a0", "\u00a0", "\n", "\t", "\r\n", "\u2003", "\u3000", "\x85", "\x1c", "\u180e", "\u200b", "a", "Zb", "7", "'s", ".", "é", "日"]
    texts = ["a \u00a0 \u00a0 b", "Name: \u00a0 \u00a0 \u00a0 x", "x \u00a0 ", "two  x", "end\n ", " "] + ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(20_000)]
    flat, counts = encoder.flat(pa.array(texts, pa.large_string()))
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert flat[at : at + n].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1], t
        at += n


def test_assignment_index_finds_the_cheapest_that_fits():
    from kindred.llm.packing import Sequences

    r = random.Random(14)
    index, plain = Sequences(30, 64), [(0.0, s, 64) for s in range(30)]
    while index.any():
        assert bool(plain)
        need = r.randint(1, 64)
        fits = [x for x in plain if x[2] >= need]
        assert index.any(need) == bool(fits)
        if not fits:
            need, fits = 1, plain
        cost, s, room = index.pop(need)
        assert (cost, s, room) == min(fits)
        plain.remove((cost, s, room))
        left = room - min(need, room) if r.random() < 0.7 else 0
        if left:
            index.push(cost + r.random(), s, left)
            plain = [*plain, (index.heaps[left][0] if len(index.heaps[left]) == 1 else next(x for x in index.heaps[left] if x[1] == s)) + (left,)]
    assert not plain


def brute_assign(counts, size, linear, quadratic):
    """Rests, longest first, to the cheapest sequence that holds them whole, else to the cheapest with any room."""
    rests = [(-(n % size), d, n - n % size) for d, n in enumerate(counts) if n % size]
    first = sum(n // size for n in counts)
    bins = [[0.0, first + s, size] for s in range(-sum(r[0] for r in rests) // size)]
    out = []
    while rests and any(b[2] for b in bins):
        rests.sort()
        n, d, at = rests.pop(0)
        n = -n
        b = min([b for b in bins if b[2] >= n] or [b for b in bins if b[2]], key=lambda b: (b[0], b[1]))
        took = min(n, b[2])
        out.append((d, at, took, b[1], size - b[2]))
        b[2] -= took
        b[0] += linear * took + quadratic * took * took
        if took < n:
            rests.append((took - n, d, at + took))
    return out


@pytest.mark.parametrize("high", [60, 300])
def test_assignment_equals_brute_force(high):
    from kindred.llm.packing import assign

    r = np.random.default_rng(8)
    counts = r.integers(1, high, 400)
    want = brute_assign(counts.tolist(), 128, 1.0, 1 / 256)
    got = assign(counts, 128, 1.0, 1 / 256)
    assert set(want) <= set(got) and sum(p[2] for p in got) == counts.sum()
    tail = {p[3] for p in set(got) - set(want)} & {p[3] for p in want}
    assert not tail


def test_assignment_balances_cost():
    from kindred.llm.packing import assign

    r = np.random.default_rng(3)
    counts = r.integers(1, 5000, 800)
    cost, size = {}, {}
    for _, _, n, s, _ in assign(counts, 2048, 1.0, 1 / 4096):
        cost[s] = cost.get(s, 0) + n + n * n / 4096
        size[s] = size.get(s, 0) + n
    mixed = [cost[s] for s in cost if size[s] == 2048 and cost[s] < 2048 + 1024]
    assert sum(size.values()) == counts.sum() and np.std(mixed) < 0.1 * np.mean(mixed)


# -- the pipeline


def test_pipeline(spark, tmp_path, awkward, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = toxic_rows()
    extra = rows(corpus())
    spark.createDataFrame(docs + [(1000 + i, *x[1:]) for i, x in enumerate(y for y in extra)] + [(None, None, None, None, None)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    bad = {x[0] for x in labels if x[2]}
    assert out and len(bad & {r["doc_id"] for r in out}) <= 0.05 * len(bad)
    for _, stage in pipeline.STAGES:
        for table in (awkward, empty):
            made = stage(spark, table, str(tmp_path))
            assert stage is pipeline.pack_sequences or tuple(made.columns) == pipeline.COLUMNS
            assert made.count() > 0 or table is empty
