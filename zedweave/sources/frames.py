"""Frames for inputs: tables, files, and change feeds with an operation or weight column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operation codes of common change feeds and their weights; an update comes as its old and its new row.
OPERATIONS = {"insert": 1, "i": 1, "c": 1, "+": 1, "+i": 1, "+u": 1, "update_postimage": 1, "delete": -1, "d": -1, "-": -1, "-d": -1, "-u": -1, "update_preimage": -1}


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any batch source that Spark reads (parquet, orc, csv, json, text, jdbc, ...)."""
    schema = options.pop("schema", None)
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path) if path else reader.load()


def stream_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A parquet table, a file or a folder of part files, as a stream of its files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    if store.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def change_feed(df: DataFrame, column: str, codes: Mapping[str, int] = OPERATIONS) -> DataFrame:
    """df with `_w` from its operation column; an unknown code raises when it is read."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    code = F.lower(F.col(column).cast("string"))
    w = F.coalesce(F.try_element_at(table, code), F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(code, F.lit("null")))).cast("int"))
    return df.withColumn("_w", w.cast("bigint")).drop(column)


def weighted(df: DataFrame, column: str) -> DataFrame:
    """df with `_w` from a column of its own."""
    return df.withColumnRenamed(column, "_w").withColumn("_w", F.col("_w").cast("bigint"))
