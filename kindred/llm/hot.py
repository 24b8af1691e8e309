"""Keys that very many rows share. Only how their rows are grouped depends on it, never what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more rows than both is hot: its rows are pre-aggregated and spread, where others meet in one task each.
LEAST, SHARE = 200_000, 1e-4


def hot_keys(rows: DataFrame, key: str, by: tuple[str, ...], *, least: int = LEAST, one_in: int = 64) -> DataFrame | None:
    """The hot keys of a written table in a frame of one column, at most 2 / SHARE of them; None if there are none.

    They are found on every one_in-th row by a hash of the columns `by`; a key at half the bound counts too, so that none
    above it is missed for an uneven sample.
    """
    n = rows.count()
    bound = max(least, n * SHARE)
    if n <= bound:
        return None
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), *by), F.lit(one_in)) == 0) if bound >= 20 * one_in else rows.withColumn("one", F.lit(1))
    each = one_in if bound >= 20 * one_in else 1
    found = sample.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * each > bound / 2).select(key).toArrow()
    return rows.sparkSession.createDataFrame(found) if found.num_rows else None
