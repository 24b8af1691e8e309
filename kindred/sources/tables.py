"""Reading and writing the tables of texts and pairs that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAIRS = T.StructType([T.StructField("index_a", T.LongType()), T.StructField("a", T.StringType()), T.StructField("index_b", T.LongType()), T.StructField("b", T.StringType())])
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A table of any built-in format; text formats need a schema, so that no pass over the data infers one."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    if schema is None and format in ("json", "csv"):
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


#: Tables below this many bytes may be read in fewer tasks than there are cores; they are dealt out.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table in as many partitions as there are cores; any other as it is.

    A file of one row group is read by one task, whatever its size, and so would be all that follows without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{directory}/{name}.parquet"))


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "errorifexists") -> None:
    """A table whose later joins on key need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
