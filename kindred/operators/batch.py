"""Pairs, one-to-many and all-pairs scoring; no cleaning, and Hamming on unequal lengths scores 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.plans import algorithms as A
from kindred.plans.algorithms import Algorithm, Intent


@dataclass(frozen=True)
class Batch:
    """Frames have a key and a text column; a key takes the place of a list index."""

    algorithm: Algorithm
    per_pair: bool = False

    @staticmethod
    def of(algorithm: str | Algorithm, **options: int) -> Batch:
        return Batch(A.by_name(algorithm, **options))

    @staticmethod
    def for_intent(intent: str | Intent) -> Batch:
        return Batch(A.resolve(intent))

    @staticmethod
    def auto(per_pair: bool = False) -> Batch:
        """Hamming for all pairs; with per_pair, each pair's algorithm by its lengths."""
        return Batch(A.HAMMING, per_pair)

    def score(self, a: Column, b: Column) -> Column:
        if self.per_pair:
            choice = A.auto_choice(a, b)
            out: Column | None = None
            for algorithm in (A.HAMMING, A.JARO_WINKLER, A.BM25, A.simhash()):
                mine = choice == algorithm.name
                own = algorithm.score(F.when(mine, a), F.when(mine, b))
                out = F.when(mine, own) if out is None else out.when(mine, own)
            return out
        return self._floor(self.algorithm.score(a, b), a.isNotNull() & b.isNotNull())

    def _floor(self, score: Column, there: Column) -> Column:
        return F.when(there, F.coalesce(score, F.lit(0.0))) if self.algorithm is A.HAMMING else score

    def pairs(self, df: DataFrame, a: str = "a", b: str = "b", key: str = "index") -> DataFrame:
        """Scores of rows that hold both texts: index_a, index_b, score."""
        k = F.col(key).cast("long")
        return df.select(k.alias("index_a"), k.alias("index_b"), self.score(F.col(a), F.col(b)).alias("score"))

    def zip(self, left: DataFrame, right: DataFrame, key: str = "id", text: str = "text", strict: bool = True) -> DataFrame:
        """Scores of rows of equal keys; strict fails on a key that only one side has."""
        x = left.select(F.col(key).cast("long").alias("index_a"), F.col(text).alias("_a"))
        y = right.select(F.col(key).cast("long").alias("index_b"), F.col(text).alias("_b"))
        joined = x.join(y, F.col("index_a") == F.col("index_b"), "full" if strict else "inner")
        score = self.score(F.col("_a"), F.col("_b"))
        if strict:
            lone = F.col("index_a").isNull() | F.col("index_b").isNull()
            score = F.when(lone, F.raise_error(F.lit("the two sides have different keys")).cast("double")).otherwise(score)
        return joined.select("index_a", "index_b", score.alias("score"))

    def one_to_many(self, reference: str, candidates: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """Scores of one text against each row; index_a is 0."""
        return candidates.select(F.lit(0).cast("long").alias("index_a"), F.col(key).cast("long").alias("index_b"), self.score(F.lit(reference), F.col(text)).alias("score"))

    def matrix(self, left: DataFrame, right: DataFrame | None = None, key: str = "id", text: str = "text", keep: str = "all") -> DataFrame:
        """Scores of all pairs of the two frames (of one with itself); keep="upper" takes index_a < index_b only.

        The result has as many rows as the product of the two; where a threshold follows, similarity_join avoids that.
        Each side is prepared once per row. The rows of right, which is to be the smaller one, go to every block of left by
        an equi-join on a block number, so the work is spread evenly.
        """
        if keep not in ("all", "upper"):
            raise ValueError("keep is 'all' or 'upper'")
        right = left if right is None else right
        blocks = max(2, 2 * left.sparkSession.sparkContext.defaultParallelism)
        prepare = (lambda c: c) if self.per_pair else self.algorithm.prepare
        x = left.select(F.col(key).cast("long").alias("index_a"), prepare(F.col(text)).alias("_a")).withColumn("_block", F.pmod(F.xxhash64("index_a"), F.lit(blocks)))
        y = right.select(F.col(key).cast("long").alias("index_b"), prepare(F.col(text)).alias("_b")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        joined = x.join(y, "_block")
        if keep == "upper":
            joined = joined.where("index_a < index_b")
        a, b = F.col("_a"), F.col("_b")
        score = self.score(a, b) if self.per_pair else self._floor(self.algorithm.compare(a, b), a.isNotNull() & b.isNotNull())
        return joined.select("index_a", "index_b", score.alias("score"))
