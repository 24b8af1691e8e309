r"""Near duplicates among vectors: NN-descent on a neighbour graph, kept down to the edges of a cosine threshold.

Equal vectors are one class. First lists come from random-projection leaves: vectors with the same signs on random planes
meet in blocks of bounded size. NN-descent then joins the neighbours of each vector's neighbours, both ways, where some of
them are new, and keeps the best per list; a hub's neighbours are met in salted groups. A list holds the neighbours that may
share a link with the vector (twice the threshold's angle away, at most) and in any case the best few. A list whose every
entry reaches the threshold is saturated and is enlarged, doubling up to `most`. What is still saturated then lies in a dense
part of the graph, whose links are counted in full by pairs of tiles: a pair that bounds on the angles put wholly inside or
outside the threshold needs no vectors, the others a matrix product. Counts leave a tile, not pairs.

Recall is audited twice. Probes are vectors made at known angles to some of the table's, which take part in the search:
the share of them whose origin was found is measured however rare links are. And `sample` vectors are compared with all, by
brute force. While the graph has fewer than `audit` of either, or of a linked vector's links on average, further leaves and
rounds follow; if the last batch still has fewer, all vectors are compared with all, and links are exact. The last audit is
logged and kept in LAST_AUDIT; without links in the sample its recall is not measured and not reported.

Defined results: a vector that is null or zero, or holds null or non-finite components, links with nothing, and so does
a row without id (not kept, without component); vectors link within their dimension; repeated rows are vectors each and link with
one another; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.graph import connected_components
from kindred.runtime import Workspace

LAST_AUDIT: dict[str, float] = {}
#: Neighbours that a list holds whatever their cosine.
FEW = 4
_log = logging.getLogger(__name__)
_EDGES = "id long, nbr long, sim double"


def _unit(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    x = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # neither very large nor very small components overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"id": a, "nbr": b, "sim": s})


def _probes(threshold: float):
    """A vector at an angle within the threshold to each, named -1 - id."""

    def run(batches):
        for batch in batches:
            ids, dims = batch.column("id").to_numpy(), batch.column("dim").to_numpy()
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                mine, u = some.column("id").to_numpy(), _unit(some.column("vec"))
                rng = np.random.default_rng([int(d), len(ids), int(mine[0])])
                cos = threshold + (1 - threshold) * (0.02 + 0.48 * rng.random((len(mine), 1)))
                r = rng.normal(size=u.shape)
                r -= (r * u).sum(1, keepdims=True) * u
                r /= np.linalg.norm(r, axis=1, keepdims=True)
                v = cos * u + np.sqrt(1 - cos * cos) * r
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, int(d), dtype=np.int32)), pa.array(v.ravel())).cast(some.schema.field("vec").type)
                yield pa.RecordBatch.from_arrays([pa.array(-1 - mine), vec, some.column("dim")], ["id", "vec", "dim"])

    return run


def _planes(bits: int, seeds: list[int]):
    """The leaf of each vector in each tree: signs on `bits` random planes."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                x = _unit(some.column("vec"))
                for seed in seeds:
                    h = np.random.default_rng([seed, int(d)]).normal(size=(int(d), max(bits, 1)))
                    leaf = (x @ h > 0)[:, :bits] @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(some.num_rows, np.int64)
                    yield pa.RecordBatch.from_arrays([some.column("id"), some.column("vec"), some.column("dim"), pa.array(leaf.astype(np.int64)), pa.array(np.full(some.num_rows, seed, np.int32))], ["id", "vec", "dim", "leaf", "tree"])

    return run


def _leaf(size: int, floor: float):
    """The best neighbours of each vector within its block."""

    def run(table: pa.Table) -> pa.Table:
        ids, x = np.asarray(table.column("id"), dtype=np.int64), _unit(table.column("vec"))
        out = []
        for at in range(0, len(ids), 1024):
            s = x[at : at + 1024] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            k = min(size, len(ids) - 1)
            if k <= 0:
                continue
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            sim = np.take_along_axis(s, top, 1)
            order = np.argsort(-sim, axis=1)
            top, sim = np.take_along_axis(top, order, 1), np.take_along_axis(sim, order, 1)
            p, q = np.nonzero((sim >= floor) | (np.arange(k) < FEW)[None, :])
            out.append((ids[at + p], ids[top[p, q]], sim[p, q]))
        return _edges(*(np.concatenate(x) for x in zip(*out))) if out else _edges(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    return run


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(components of unit vectors in a row, where each vector starts), of any dimensions."""
    flat, sizes = np.asarray(lists.flatten(), dtype=np.float64), np.asarray(pc.list_value_length(lists), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), starts[:-1]), sizes)
    return flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts[:-1])), sizes), starts


def _meet(floor: float):
    """Pairs of a vector's neighbours, at least one of them new, that one of the two lists would take.

    Rows come sorted by (id, part); a group may go on in the next batch.
    """
    corners: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            ids, parts = table.column("id").to_numpy(), table.column("part").to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])) + 1
            if len(cuts):
                yield from meet(table.slice(0, cuts[-1]), np.concatenate([[0], cuts]))
                table = table.slice(cuts[-1])
            rest = table
        if rest is not None and rest.num_rows:
            yield from meet(rest, np.array([0, rest.num_rows]))

    def meet(table: pa.RecordBatch, cuts: np.ndarray):
        flat, starts = _rows(table.column("vec"))
        nbr, new, least, best = (table.column(c).to_numpy(zero_copy_only=False) for c in ("nbr", "new", "least", "best"))
        low = np.maximum(least, best)
        found = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            n = b - a
            if n not in corners:
                corners[n] = np.triu_indices(n, 1)
            i, j = corners[n]
            x = flat[starts[a] : starts[b]].reshape(n, -1)
            v = (x @ x.T)[i, j]
            i, j = i + a, j + a
            # A list takes what is better than its last entry, below the floor only what is among its best few.
            high = v >= floor
            keep = (new[i] | new[j]) & ((v > np.where(high, least[i], low[i])) | (v > np.where(high, least[j], low[j])))
            if keep.any():
                found.append((nbr[i[keep]], nbr[j[keep]], v[keep]))
        if found:
            i, j, v = (np.concatenate(x) for x in zip(*found))
            yield from _edges(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([v, v])).to_batches(max_chunksize=100_000)

    return run


def _ball(key: tuple, table: pa.Table) -> pa.Table:
    """A tile's centre, the angle of its farthest vector, and its size."""
    x = _unit(table.column("vec"))
    c = x.sum(0)
    n = np.linalg.norm(c)
    c = c / n if n > 0 else x[0]
    far = float(np.arccos(np.clip(x @ c, -1, 1)).max())
    return pa.table({"component": [key[0].as_py()], "tile": pa.array([key[1].as_py()], pa.int32()), "center": pa.array([c.tolist()], pa.list_(pa.float64())), "radius": [far], "size": pa.array([len(x)], pa.int64()), "copies": pa.array([int(np.asarray(table.column("copies")).sum())], pa.int64())})


def _count(threshold: float):
    """Links of each vector within a tile pair, to classes and weighted by copies; a tile with itself counts each pair once per end."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, ta, tb = (k.as_py() for k in key)
        ids, x = np.asarray(table.column("id"), dtype=np.int64), _unit(table.column("vec"))
        tile, copies = np.asarray(table.column("tile"), dtype=np.int64), np.asarray(table.column("copies"), dtype=np.float64)
        weights = np.column_stack([copies, np.ones(len(ids))])
        a, b = np.flatnonzero(tile == ta), np.flatnonzero(tile == tb)
        links = np.zeros((len(ids), 2))
        for at in range(0, len(a), 512):
            some = a[at : at + 512]
            hit = x[some] @ x[b].T >= threshold
            hit[some[:, None] == b[None, :]] = False
            links[some] += hit @ weights[b]
            if ta != tb:
                links[b] += hit.T @ weights[some]
        return pa.table({"id": ids, "links": links[:, 0].astype(np.int64), "ends": links[:, 1].astype(np.int64)})

    return run


def _beside(batches, sent):
    """(ids and copies of the vectors sent, ids of some others, which of them are which) by tiles of one dimension."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            if int(d) not in sent.value:
                continue
            ids, copies, y = sent.value[int(d)]
            some = batch.filter(pa.array(dims == d))
            mine, x = np.asarray(some.column("id"), dtype=np.int64), _unit(some.column("vec"))
            for at in range(0, len(mine), 512):
                yield ids, copies, mine[at : at + 512], y @ x[at : at + 512].T, ids[:, None] != mine[None, at : at + 512]


def _truth(threshold: float, sent):
    """Numbers of the classes that the vectors sent link to."""

    def run(batches):
        for ids, _, _, s, other in _beside(batches, sent):
            n = ((s >= threshold) & other).sum(1)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64))], ["id", "true"])

    return run


def _exact(threshold: float, sent):
    """Number of each vector's links to the vectors sent, and edges that join what these links join: no pairs."""

    def run(batches):
        for ids, copies, mine, s, other in _beside(batches, sent):
            hit = (s >= threshold) & other
            p, q = np.nonzero(hit)
            if not len(p):
                continue
            of_p, of_q = ids.copy(), mine.copy()
            while True:
                low = np.minimum(of_p[p], of_q[q])
                if (low == of_p[p]).all() and (low == of_q[q]).all():
                    break
                np.minimum.at(of_p, p, low)
                np.minimum.at(of_q, q, low)
            p, q = np.unique(p), np.unique(q)
            links = (copies @ hit[:, q]).astype(np.int64)
            a, b = np.concatenate([ids[p], mine[q]]), np.concatenate([of_p[p], of_q[q]])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(a, mine[q])), pa.array(np.append(b, mine[q])), pa.array(np.append(np.zeros(len(a), np.int64), links))], ["id", "nbr", "links"])

    return run


def near_duplicates(
    vectors: DataFrame,
    *,
    threshold: float = 0.95,
    size: int = 16,
    most: int = 64,
    leaf: int = 128,
    trees: int = 8,
    rounds: int = 3,
    audit: float = 0.98,
    sample: int = 1024,
    probes: int = 1024,
    batches: int = 6,
    tile: int = 4096,
    block: int = 4096,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id its links reach, itself included), kept."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "neighbours")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # shuffled as such, computed with as doubles
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    kind = "array<float>" if single else "array<double>"
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"), F.coalesce(good, F.lit(False)).alias("good"))
    h1, h2 = F.xxhash64("vec"), F.xxhash64(F.lit(1), F.col("vec"))
    rows = ws.write(rows.withColumn("h1", h1).withColumn("h2", h2), "rows")
    dim = F.size("vec").alias("dim")
    classes = rows.where("good").groupBy("h1", "h2", dim).agg(F.min("vec_id").alias("named"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = ws.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    place = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 40))

    def some(low: int, high: int) -> DataFrame:
        """About high - low of the classes, always the same ones."""
        at = lambda k: math.ceil((1 << 40) * min(1, k / max(n, 1)))
        return classes.where((place >= at(low)) & (place < at(high)))

    points = classes.select("id", "vec", "dim")
    asked = ws.write(some(0, probes).where("dim > 1").select("id", "vec", "dim").mapInArrow(_probes(threshold), f"id long, vec {kind}, dim int"), "probes")
    n_asked = asked.count()
    searched = points.unionByName(asked)
    bits = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    floor = min(0.5, 2 * threshold * threshold - 1) if threshold > 0 else -1.0

    def leaves(seeds: list[int]) -> DataFrame:
        placed = searched.mapInArrow(_planes(bits, seeds), f"id long, vec {kind}, dim int, leaf long, tree int")
        large = placed.groupBy("tree", "dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf)).alias("parts")).where("parts > 1")
        large = ws.write(large, f"large-{seeds[0]}")
        part = F.pmod(F.xxhash64("id", "tree"), F.coalesce("parts", F.lit(1)))
        blocks = placed.join(large, ["tree", "dim", "leaf"], "left").withColumn("part", part)
        return blocks.select("tree", "dim", "leaf", "part", "id", "vec").groupBy("tree", "dim", "leaf", "part").applyInArrow(_leaf(size, floor), _EDGES)

    def lists(found: DataFrame, old: DataFrame | None) -> DataFrame:
        """The best of old and found per vector, as many as its list takes; a saturated list takes twice as many."""
        all_ = found.select("id", "nbr", "sim", F.lit(True).alias("new"), F.lit(size).alias("takes"))
        if old is not None:
            all_ = all_.unionByName(old.select("id", "nbr", "sim", F.lit(False).alias("new"), "takes"))
        all_ = all_.repartition("id").groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("new").alias("new"), F.max("takes").alias("takes"))
        own = Window.partitionBy("id")
        all_ = all_.withColumn("takes", F.max("takes").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.col("sim").desc(), "nbr")))
        all_ = all_.where((F.col("rank") <= most) & ((F.col("sim") >= floor) | (F.col("rank") <= FEW))).withColumn("full", F.sum((F.col("sim") >= threshold).cast("int")).over(own))
        all_ = all_.withColumn("takes", F.when(F.col("full") >= F.col("takes"), F.least(F.col("takes") * 2, F.lit(most))).otherwise(F.col("takes")))
        return all_.where(F.col("rank") <= F.col("takes")).select("id", "nbr", "sim", "new", "takes", "rank", (F.col("full") >= most).alias("saturated"))

    def descend(graph: DataFrame) -> DataFrame:
        """Candidates from the neighbours of all vectors' neighbours, forward and reverse."""
        both = graph.select("id", "nbr", "new").union(graph.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "new"))
        both = both.repartition("id").groupBy("id", "nbr").agg(F.max("new").alias("new"))
        own = Window.partitionBy("id")
        # Vectors are attached where a pair can come of it: several neighbours, one of them new.
        both = both.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("any", F.max("new").over(own)).where("any and n > 1")
        both = both.withColumn("part", F.pmod(F.xxhash64("nbr", "id"), F.ceil(F.col("n") / (2 * most))))
        full = F.count(F.lit(1)) >= F.max("takes")
        worst = graph.groupBy("id").agg(F.when(full, F.min("sim")).otherwise(F.lit(-2.0)).alias("least"), F.coalesce(F.min(F.when(F.col("rank") == FEW, F.col("sim"))), F.lit(-2.0)).alias("best"))
        ends = searched.join(worst, "id").select(F.col("id").alias("nbr"), "vec", "least", "best")
        return both.join(ends, "nbr").select("id", "part", "nbr", "new", "vec", "least", "best").repartition("id", "part").sortWithinPartitions("id", "part").mapInArrow(_meet(floor), _EDGES)

    def beside(kernel, low: int, high: int, schema: str, name: str) -> DataFrame:
        """What the kernel finds for some vectors and all."""
        table = some(low, high).select("id", "copies", "vec", "dim").toArrow().combine_chunks()
        dims = table.column("dim").to_numpy()
        parts = {int(d): table.filter(pa.array(dims == d)) for d in np.unique(dims)}
        sent = {d: (np.asarray(t.column("id"), dtype=np.int64), np.asarray(t.column("copies"), dtype=np.float64), _unit(t.column("vec"))) for d, t in parts.items()}
        return ws.write(points.mapInArrow(kernel(threshold, spark.sparkContext.broadcast(sent)), schema), name)

    def counted(edges: DataFrame, components: DataFrame, graph: DataFrame, name: str) -> DataFrame:
        """id, links (with copies), ends (classes): in full inside dense parts, from the graph elsewhere."""
        copies = classes.select("id", "copies")
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("nbr")).union(edges.select("b", "a"))
        each = (F.sum("copies").cast("long").alias("links"), F.count(F.lit(1)).alias("ends"))
        dense = graph.where("saturated and id >= 0").select(F.col("id").alias("node")).distinct().join(components, "node").select("component").distinct()
        members = ws.write(components.join(dense, "component", "left_semi"), f"members-{name}")
        if members.isEmpty():
            return ws.write(both.join(copies.withColumnRenamed("id", "nbr"), "nbr").groupBy("id").agg(*each), name)
        both = both.join(members.select(F.col("node").alias("id")), "id", "left_anti")
        plain = both.join(copies.withColumnRenamed("id", "nbr"), "nbr").groupBy("id").agg(*each)
        tiles = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
        held = members.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumnRenamed("node", "id").drop("tiles")
        held = ws.write(held.join(classes.select("id", "vec", "copies"), "id"), f"held-{name}")
        balls = ws.write(held.select("component", "tile", "vec", "copies").groupBy("component", "tile").applyInArrow(_ball, "component long, tile int, center array<double>, radius double, size long, copies long"), f"balls-{name}")
        a, b = (balls.select("component", *(F.col(c).alias(f"{c}_{s}") for c in ("tile", "center", "radius", "size", "copies"))) for s in "ab")
        dot = F.aggregate(F.zip_with("center_a", "center_b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
        angle = F.when(F.col("tile_a") == F.col("tile_b"), 0.0).otherwise(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))
        limit, reach = math.acos(threshold), F.col("radius_a") + F.col("radius_b")
        pairs = a.join(b, "component").where("tile_a <= tile_b").withColumn("angle", angle)
        pairs = pairs.withColumn("inside", F.col("angle") + reach <= limit - 1e-6).where(F.col("inside") | (F.col("angle") - reach <= limit + 1e-6)).drop("center_a", "center_b")
        pairs = ws.write(pairs, f"pairs-{name}")
        # Of a tile wholly inside another's reach every vector is linked; with itself all but the vector and its copies.
        inside = pairs.where("inside")
        full = inside.select("component", F.col("tile_a").alias("tile"), F.col("copies_b").alias("links"), F.col("size_b").alias("ends"), (F.col("tile_a") == F.col("tile_b")).cast("int").alias("self"))
        full = full.union(inside.where("tile_a < tile_b").select("component", "tile_b", "copies_a", "size_a", F.lit(0)))
        full = full.groupBy("component", "tile").agg(*(F.sum(c).alias(c) for c in ("links", "ends", "self")))
        whole = held.select("component", "tile", "id", F.col("copies").alias("own")).join(full, ["component", "tile"]).select("id", (F.col("links") - F.col("self") * F.col("own")).cast("long").alias("links"), (F.col("ends") - F.col("self")).cast("long").alias("ends"))
        open_ = pairs.where("not inside").select("component", F.col("tile_a").alias("ta"), F.col("tile_b").alias("tb"))
        goes = open_.select("component", "ta", "tb", F.col("ta").alias("tile")).union(open_.where("ta < tb").select("component", "ta", "tb", "tb"))
        met = held.join(goes, ["component", "tile"]).select("component", "ta", "tb", "id", "vec", "tile", "copies")
        met = met.groupBy("component", "ta", "tb").applyInArrow(_count(threshold), "id long, links long, ends long")
        within = whole.union(met).groupBy("id").agg(F.sum("links").alias("links"), F.sum("ends").alias("ends"))
        return ws.write(within.union(plain), name)

    truth = ws.write(beside(_truth, 0, sample, "id long, true long", "truth").groupBy("id").agg(F.sum("true").alias("true")), "true")
    graph, k, exact = None, 0, False
    LAST_AUDIT.clear()
    for batch in range(batches if n else 1):
        graph = ws.write(lists(leaves([batch * trees + t for t in range(trees)]), graph), f"graph-{k}")
        for _ in range(rounds):
            k += 1
            graph = ws.write(lists(descend(graph), graph), f"graph-{k}")
            ws.drop(f"graph-{k - 1}")
            if graph.where("new and sim >= %r" % floor).isEmpty():
                break
        k += 1
        met = graph.where(F.col("sim") >= threshold)
        # Where a probe or its origin has a saturated list, links are counted in full and no single edge is needed.
        probe, ends = F.least("id", "nbr"), asked.select(F.col("id").alias("probe"), F.explode(F.array("id", -1 - F.col("id"))).alias("id"))
        seen = met.where((probe < 0) & (F.greatest("id", "nbr") == -1 - probe)).select(probe.alias("probe"), F.lit(1).alias("found"), F.lit(0).alias("dense"))
        full = graph.where("saturated").select("id").distinct().join(F.broadcast(ends), "id").select("probe", F.lit(0).alias("found"), F.lit(1).alias("dense"))
        dense, have = seen.union(full).groupBy("probe").agg(F.max("found").alias("found"), F.max("dense").alias("dense")).agg(F.coalesce(F.sum("dense"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("dense") == 0, 1)), F.lit(0))).first()
        measured = n_asked - dense
        LAST_AUDIT.update(probes=float(measured), probe_recall=have / max(measured, 1), batches=batch + 1.0, exact=0.0)
        exact = have < audit * measured
        if exact and batch < batches - 1:
            continue
        edges = met.where("id >= 0 and nbr >= 0").select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()
        edges = ws.write(edges, f"edges-{batch}")
        components = connected_components(ws, edges, f"components-{batch}")
        links = counted(edges, components, graph, f"links-{batch}")
        each = truth.join(links, "id", "left").select("true", F.coalesce("ends", F.lit(0)).alias("ends"))
        true, ends, mean = each.agg(F.coalesce(F.sum("true"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0)), F.avg(F.col("ends") / F.col("true"))).first()
        if true:
            LAST_AUDIT.update(recall=ends / true, mean_recall=mean, links=float(true))
            exact = exact or ends < audit * true or mean < audit
        _log.info("audit after %d batches: %s", batch + 1, LAST_AUDIT)
        if not exact:
            break
    if exact:
        LAST_AUDIT.update(exact=1.0)
        _log.warning("audit: below %.3f after the last batch; all vectors are compared with all", audit)
        parts = None
        for low in range(0, n, block):
            one = beside(_exact, low, low + block, "id long, nbr long, links long", f"exact-{low}")
            parts = one if parts is None else parts.union(one)
        edges = parts.where("id <> nbr").select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()
        components = connected_components(ws, ws.write(edges, "edges-exact"), "components-exact")
        links = ws.write(parts.groupBy("id").agg(F.sum("links").alias("links")), "links-exact")

    named = classes.select(F.col("id").alias("node"), "named")
    smallest = components.join(named, "node").groupBy("component").agg(F.min("named").alias("component_id"))
    of = components.join(smallest, "component").select(F.col("node").alias("id"), "component_id")
    known = classes.drop("vec").join(links.select("id", "links"), "id", "left").join(of, "id", "left")
    known = ws.write(known.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_id", "named").alias("component_id")).where("links > 0"), "known")
    slim = rows.select("vec_id", "good", F.when(F.col("good"), F.col("h1")).alias("h1"), F.when(F.col("good"), F.col("h2")).alias("h2"))
    out = slim.join(known, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
