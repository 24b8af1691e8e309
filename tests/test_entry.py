"""The driver's contract, sources and streams."""

import pytest

import __spark_entry__ as entry
from kindred.sources import tables


def test_catalogue():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    df = tables.read_table(spark, str(tmp_path), "t")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 1000


def test_bucketed_tables_join_without_a_shuffle(spark):
    tables.write_bucketed(spark.range(100).withColumnRenamed("id", "k"), "kindred_bucketed", "k", 4, mode="overwrite")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = spark.table("kindred_bucketed").alias("a"), spark.table("kindred_bucketed").alias("b")
        joined = a.join(b, "k")
        assert joined.count() == 100 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE kindred_bucketed")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], tables.DOCUMENTS)
    for kind in ("parquet", "orc", "json", "csv"):
        tables.write(df, str(tmp_path / kind), kind)
        assert sorted(map(tuple, tables.read(spark, str(tmp_path / kind), kind, tables.DOCUMENTS).collect())) == [(1, "a"), (2, "b")]
    for bad in (lambda: tables.read(spark, "x", "xml"), lambda: tables.read(spark, "x", "csv")):
        with pytest.raises(ValueError):
            bad()


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from kindred.plans.flow import Flow
    from kindred.streaming import scoring

    pairs = spark.createDataFrame([(1, "MARTHA", "MARHTA"), (2, "same", "same")], "i int, a string, b string")
    pairs.write.parquet(str(tmp_path / "pairs"))
    stream = scoring.scored(scoring.read_stream(spark, str(tmp_path / "pairs"), pairs), Flow.for_intent("names").compare)
    got = {r["i"]: round(r["s"], 6) for r in scoring.drain(spark, stream.select("i", F.col("result.score").alias("s"))).collect()}
    assert got == {1: 0.961111, 2: 1.0}
    timed = spark.createDataFrame([(1, "x", "2024-01-01 00:00:00"), (2, "x", "2024-01-01 00:00:01"), (3, "y", "2024-01-01 00:00:02")], "i int, t string, at string").withColumn("at", F.to_timestamp("at"))
    timed.write.parquet(str(tmp_path / "timed"))
    kept = scoring.drain(spark, scoring.drop_repeats(scoring.read_stream(spark, str(tmp_path / "timed"), timed), "at", "t"))
    assert sorted(r["t"] for r in kept.collect()) == ["x", "y"]
