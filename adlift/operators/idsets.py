"""Mergeable exact sets of ids: bitmaps over dense codes.

An id gets a code once, in a stored dictionary whose codes are dense within
each written part, so a set is a few 4 KB bitmaps, one for each ``bucket`` of
32,768 codes.  Sets are rows ``(keys, bucket, bits)``: made by one aggregate,
merged over days, sites or categories by OR, and counted by population, so any
number of distinct counts and set differences comes from one pass, and a day's
sets are never counted from its rows again.  All is exact; NULL ids are in no set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: codes of one part of a dictionary begin at a multiple of this
PART_CODES = 1 << 33


def id_codes(ids: DataFrame, path: str, known: DataFrame | None = None) -> DataFrame:
    """``(id, code)`` for the distinct ids of a one-column frame, written under
    ``path``.  With ``known``, a dictionary read from elsewhere, its codes stay and
    only ids that it lacks get new ones, behind all of its own."""
    fresh = ids.toDF("id").where(F.col("id").isNotNull()).distinct()
    base = 0
    if known is not None:
        fresh = fresh.join(known.select("id"), "id", "left_anti")
        last = known.agg(F.max("code")).first()[0]
        base = 0 if last is None else (last // PART_CODES + 1) * PART_CODES
    coded = fresh.withColumn("code", F.monotonically_increasing_id() + F.lit(base))
    out = coded if known is None else known.select("id", "code").unionByName(coded)
    out.write.mode("errorifexists").parquet(path)
    return ids.sparkSession.read.parquet(path)


def with_code(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the code of an id column (NULL for a NULL id)."""
    side = codes.select(F.col("id").alias("__id"), F.col("code").alias(name))
    return df.join(side, F.col(column) == F.col("__id"), "left").drop("__id")


def id_sets(df: DataFrame, by: list[str], code: str = "code") -> DataFrame:
    """``(by, bucket, bits)``: the set of codes of each group."""
    some = df.where(F.col(code).isNotNull())
    # bit positions count from 1, codes from 0
    return some.groupBy(*by, F.bitmap_bucket_number(F.col(code) + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(code) + 1)).alias("bits")
    )


def merged(sets: DataFrame, by: list[str]) -> DataFrame:
    """The union of the sets of each group."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """``(by, name)``: ids in each group's set, for merged sets."""
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias(name))


def compared(sets: DataFrame, by: list[str], left, right) -> DataFrame:
    """``(by, n_left, n_right, n_both, n_only_left, n_only_right)`` for the union
    of the sets that the condition ``left`` names and of those of ``right``: one
    aggregate, as ``|A - B| = |A or B| - |B|``.  Groups that neither names are
    left out."""
    some = sets.where(F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)))
    per = some.groupBy(*by, "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("u"),
        F.bitmap_count(F.bitmap_or_agg(F.when(left, F.col("bits")))).alias("l"),
        F.bitmap_count(F.bitmap_or_agg(F.when(right, F.col("bits")))).alias("r"),
    )
    total = per.groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("u", "l", "r")])
    u, a, b = F.col("u"), F.col("l"), F.col("r")
    return total.select(
        *by, a.alias("n_left"), b.alias("n_right"), (a + b - u).alias("n_both"), (u - b).alias("n_only_left"), (u - a).alias("n_only_right")
    )
