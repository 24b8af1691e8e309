"""Exact top-k search by integer inner product: tiled matrix products, selection per tile, tree merging.

Rows are cut into shards by a hash of their places in the input, so that rows of one id are spread too, and queries into
blocks by a hash of their ids, both of bounded bytes; a tile is one shard against one block. A tile's product is taken in
sub-tiles, of which only the k best per query are kept, and the lists of a query are merged level by level, a fan of lists
at a time.

Defined results: a vector that is null, empty-valued (a null component) or not finite takes no part, nor does a row
without id; vectors meet those of their own dimension only; a query never meets rows of its own id; repeated rows are
candidates each, and a repeated query is asked once (its smallest vector); ties go to the smaller id; fewer than k
candidates are all returned, and no rows from an empty table; scores beyond a long saturate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.runtime import ship

_LONG = 2**63 - 1


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending, and their vectors as floor(256 x) in doubles."""
    ids = np.asarray(table.column("vec_id"), dtype=np.int64)
    lists = table.column("embedding").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.floor(256.0 * flat[order])


def _best(scores: np.ndarray, base: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores of each row, the earlier column on a tie; base breaks no tie, it only bounds columns."""
    n = scores.shape[1]
    if n <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    key = scores * n + base
    top = np.argpartition(key, n - k, axis=1)[:, n - k :]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1, kind="stable"), 1)


def tile(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int, side: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, row ids, scores): the k best rows of each query."""
    (qi, q), (ri, r) = queries, rows
    most = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(1, q.shape[1])  # no score is beyond
    exact = (most + 2) * (side + k + 2) < 2.0**53
    if not exact:
        q, r = (np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object) for x in (q, r))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(qi), 512):
        ids, held, scores = qi[a : a + 512], None, None
        for b in range(0, len(ri), side):
            some = ri[b : b + side]
            s = q[a : a + 512] @ r[b : b + side].T
            if exact:
                own = ids[:, None] == some[None, :]
                top = _best(np.where(own, -most - 1, s), np.arange(len(some), 0, -1, dtype=np.float64) - 1, k)
                s[own] = -np.inf
            else:
                s = np.where(ids[:, None] == some[None, :], -np.inf, s)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            s, c = np.take_along_axis(s, top, 1), some[top]
            if held is not None:
                s, c = np.hstack([scores, s]), np.hstack([held, c])
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                s, c = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
            held, scores = c, s
        if held is not None:
            real = np.array(scores > -np.inf, dtype=bool)
            whole = scores[real].astype(np.int64) if exact else np.array([max(-_LONG - 1, min(_LONG, x)) for x in scores[real]], dtype=np.int64)
            out.append((np.repeat(ids, real.sum(1)), held[real], whole))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def exact_topk(rows: DataFrame, queries: DataFrame, *, k: int = 5, shard_rows: int = 65_536, block_rows: int = 32_768, fan: int = 64, tile_bytes: int = 64_000_000) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of highest score for each query; both inputs have vec_id and embedding.

    A shard has about shard_rows rows and a block block_rows queries, and either at most about tile_bytes of doubles.
    """
    spark = rows.sparkSession
    ship(spark)

    def usable(df: DataFrame) -> DataFrame:
        single = df.schema["embedding"].dataType.simpleString() == "array<float>"  # shuffled as such; the same as doubles
        v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite).withColumn("dim", F.size("embedding"))

    rows = usable(rows)
    queries = usable(queries).groupBy("vec_id", "dim").agg(F.min("embedding").alias("embedding"))
    size = (F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0)))
    (n, of_n), (m, of_m) = rows.agg(*size).first(), queries.agg(*size).first()
    slots = spark.sparkContext.defaultParallelism
    shards = max(math.ceil(n / shard_rows), math.ceil(8 * of_n / tile_bytes), min(2 * slots, math.ceil(n / 2048)), 1)
    tiles = max(math.ceil(m / block_rows), math.ceil(8 * of_m / tile_bytes), 1)
    spread = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")).withColumn("shard", spread)

    def meet(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            found = (np.zeros(0, np.int64),) * 3
        else:
            found = tile(_matrix(block), _matrix(shard), k)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2], "list": np.full(len(found[0]), key[1].as_py(), np.int32)})

    keys = ("dim", "shard", "block")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long, list int")
    best = (F.col("score").desc(), F.col("vec_id"))
    while shards > fan:
        shards = math.ceil(shards / fan)
        lists = lists.withColumn("list", F.pmod("list", F.lit(shards)).cast("int"))
        w = Window.partitionBy("query_id", "list").orderBy(*best)
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy("query_id").orderBy(*best)
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
