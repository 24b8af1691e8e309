"""The row-wise operators on streams, and matching of new rows against a static corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.runtime import Workspace


def drain(spark: SparkSession, stream: DataFrame, label: str = "stream") -> DataFrame:
    """Runs a stream over what its source holds now and returns what it wrote, as a batch table."""
    ws = Workspace(spark, label)
    out = f"{ws.root}/out"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{ws.root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A Parquet folder as a stream, with the schema of a batch read of it."""
    return spark.readStream.schema(like.schema).parquet(path)


def drop_repeats(stream: DataFrame, time: str, text: str, within: str = "1 hour") -> DataFrame:
    """The first of equal texts within a time; the state is bounded by the watermark."""
    return stream.withColumn("_h", F.xxhash64(text)).withWatermark(time, within).dropDuplicatesWithinWatermark(["_h", text]).drop("_h")


def near_corpus(stream: DataFrame, corpus: DataFrame, key: str = "id", text: str = "text", most: int = 3) -> DataFrame:
    """New rows with each row of a static corpus whose SimHash differs in at most `most` bits: new_id, corpus_id, score.

    Bands of the fingerprint are the join keys; of the bands that a pair shares, only the first gives a row, so the
    stream needs no state.
    """
    bands = most + 1
    cuts = [(i * 64 // bands, (i + 1) * 64 // bands) for i in range(bands)]

    def band(p, i):
        lo, hi = cuts[i]
        return F.shiftrightunsigned(F.shiftleft(p, 64 - hi), 64 - hi + lo)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col(key).alias(name), T.simhash_fingerprint(text).alias(f"p_{name}"))
        p = F.col(f"p_{name}")
        return df.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), band(p, i).alias("v")) for i in range(bands)])))

    found = keyed(stream, "new_id").join(keyed(corpus, "corpus_id"), "_k")
    p, q = F.col("p_new_id"), F.col("p_corpus_id")
    first = F.lit(True)
    for i in range(bands - 1):
        first = first & ((F.col("_k.i") <= i) | (band(p, i) != band(q, i)))
    return found.where((T.fingerprint_distance(p, q) <= most) & first).select("new_id", "corpus_id", T.fingerprint_similarity(p, q).alias("score"))


def scored(stream: DataFrame, flow_compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream of pairs through a flow or any other projection."""
    return flow_compare(stream)
