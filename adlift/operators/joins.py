"""Join shapes that turn membership into columns.

No join here forces a broadcast: sides are de-duplicated first, and the
physical strategy (broadcast under the runtime size threshold, otherwise
sort-merge / shuffled hash, with skewed partitions split) is left to AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def absent_flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add boolean ``name``: no row of ``other`` has the same keys (a left
    join + ``IS NULL`` test kept as a column; every row of ``df`` stays)."""
    marks = other.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return df.join(marks, keys, "left").withColumn(name, F.col("__hit").isNull()).drop("__hit")


def anti_join_null_safe(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``; a NULL key matches a NULL id
    (set membership, not SQL ``NOT IN``)."""
    other = ids.select(F.col(key).alias("__k")).distinct()
    return df.join(other, df[key].eqNullSafe(other["__k"]), "left_anti")


#: salts of NULL keys, at the least
LEAST_SPREAD = 512


def null_spread(spark: SparkSession) -> int:
    """Salts for rows with a NULL key: as many as a shuffle has partitions."""
    return max(LEAST_SPREAD, int(spark.conf.get("spark.sql.shuffle.partitions")))


def left_join_nullable_key(df: DataFrame, right: DataFrame, key: str, spread: int | None = None) -> DataFrame:
    """``df LEFT JOIN right USING (key)`` that does not pile NULL keys into one
    task.

    In a shuffle join every NULL key hashes to the same partition, so a key
    that is often NULL would land in one task.  Rows with a NULL key get a
    salt in ``1..spread`` (``null_spread`` if not given) taken from a hash of their other columns
    (deterministic, so a retried task places them the same way); the right
    side has salt 0 (a frame with only the key column is salted by its input
    partition).  The join is on the one value ``struct(key, salt)``, which the
    optimizer cannot take apart into a filter on the left side: NULL rows still
    never match, but they are shuffled to many partitions.  Nothing is dropped.
    """
    spread = null_spread(df.sparkSession) if spread is None else spread
    others = [c for c in df.columns if c != key]
    # with no other column to hash, the input partition (stable across task
    # retries) spreads them instead
    basis = F.xxhash64(*others) if others else F.spark_partition_id().cast("bigint")
    salt = F.when(F.col(key).isNull(), F.lit(1) + F.pmod(basis, F.lit(spread))).otherwise(F.lit(0))
    left = df.withColumn("__key", F.struct(F.col(key).alias("key"), salt.cast("int").alias("salt")))
    other = right.withColumn("__key", F.struct(F.col(key).alias("key"), F.lit(0).alias("salt"))).drop(key)
    return left.join(other, "__key", "left").drop("__key")
