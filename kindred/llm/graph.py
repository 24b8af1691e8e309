"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.runtime import Workspace

#: Up to so many edges (16 bytes each) are joined up in one task; more by rounds of star contraction.
ONE_TASK = 2_000_000


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes ascending, smallest node each can reach)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):  # hang the roots of both ends below the smaller label
            np.minimum.at(new, label[end], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    nodes, labels = union(*(table.column(c).to_numpy().astype(np.int64) for c in ("a", "b")))
    yield from pa.table({"node": nodes, "component": labels}).to_batches(max_chunksize=100_000)


def connected_components(ws: Workspace, edges: DataFrame, name: str = "components", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a long, b long).

    Beyond one_task edges, rounds of large-star and small-star contraction (Kiveris et al., 2014) run until nothing changes;
    each round is a written table. A hub's neighbours are never in one task: rounds use only minima per node and joins.
    """
    edges = edges.select("a", "b")
    if edges.count() <= one_task:
        return ws.write(edges.coalesce(1).mapInArrow(_one_task, "node long, component long"), name)
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = both.select(F.col("a").alias("node")).distinct()
    now = ws.write(edges.where("a <> b").distinct(), f"{name}-0")
    k = 0

    def star(df: DataFrame, large: bool) -> DataFrame:
        """Links of each node's neighbours to the smallest node of its neighbourhood."""
        if large:
            out = df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            out = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = out.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = out.join(low, "a")
        if large:
            return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = low.where("a <> m").select("a", F.col("m").alias("b"))
        return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).where("a <> b").distinct()

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = None
    while before != (after := digest(now)):
        before, k = after, k + 1
        half = ws.write(star(now, True), f"{name}-{k}-half")
        ws.drop(f"{name}-{k - 1}")
        now = ws.write(star(half, False), f"{name}-{k}")
        ws.drop(f"{name}-{k}-half")
    labels = now.groupBy("a").agg(F.min("b").alias("component"))
    out = nodes.join(labels, nodes["node"] == labels["a"], "left").select("node", F.coalesce("component", "node").alias("component"))
    return ws.write(out, name)
