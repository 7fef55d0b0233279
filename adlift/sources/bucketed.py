"""Co-partitioned storage: tables bucketed alike on a key.

Two tables with the same number of buckets on a key join on it, and are grouped
by it, without a shuffle.  A NULL key never matches, and all NULL keys would fall
into one bucket, so rows without a key are kept in a table of their own beside it
and pass the join untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: buckets of the test and default layout; about a GB of a table each is usual
BUCKETS = 8


def _unkeyed(table: str) -> str:
    return f"{table}__unkeyed"


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int = BUCKETS) -> None:
    """``df`` as a catalog table bucketed and sorted on ``key``, one file for
    each bucket, and its rows without a key as ``<table>__unkeyed``."""
    keyed = df.where(F.col(key).isNotNull())
    keyed.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    df.where(F.col(key).isNull()).write.mode("overwrite").format("parquet").saveAsTable(_unkeyed(table))


def read_keyed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def read_unkeyed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(_unkeyed(table))


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return read_keyed(spark, table).unionByName(read_unkeyed(spark, table))


def bucketed_left_join(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` of two tables written with the same
    buckets: no exchange, and rows of ``left`` without a key are kept."""
    joined = read_keyed(spark, left).join(read_keyed(spark, right), key, "left")
    return joined.unionByName(read_unkeyed(spark, left), allowMissingColumns=True)
