"""Line deduplication by distinct-site spread (DataFrame functions only).

Each line's hash carries a HyperLogLog sketch of the sites that have it; the
sketches merge by aggregation.  Lines whose estimate is clear of the threshold
by ``SIGMAS`` standard errors are decided by it; those near the threshold get
exact distinct counts.  Lines on ``min_sites`` sites or more are boilerplate
and are cut from every document.

A line is compared without the spaces around it; blank lines are never
boilerplate.  A line that one site has a million times has a spread of one,
and reaches the shuffle as one sketch per task.

Cases: null text stays null with no lines; a null site counts as none; equal
documents are cleaned alike; a document of boilerplate alone keeps its row,
with an empty text; other columns are kept.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, without_clashes

MIN_SITES = 5
#: log2 of a sketch's registers; standard errors that count as near
REGISTERS, SIGMAS = 12, 4


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _hashes(docs: DataFrame, *columns: Column) -> DataFrame:
    """(..., line): the hash of each line that isn't blank."""
    rows = docs.where("text is not null").select(*columns, F.posexplode(_lines()).alias("place", "raw"))
    rows = rows.withColumn("raw", F.trim("raw")).where("raw <> ''")
    return rows.withColumn("line", F.xxhash64("raw")).drop("raw")


def spread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(line): hashes of the lines on ``min_sites`` sites or more."""
    rows = _hashes(docs, F.col(site).cast("string").alias("site")).where("site is not null").select("line", "site")
    spread = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS))).alias("sites"))
    error = SIGMAS * 1.04 / sqrt(1 << REGISTERS)
    least, most = min_sites * (1 - error), min_sites * (1 + error)
    spread = stored(spread.where(F.col("sites") >= F.lit(least)), "line-spread")
    near = spread.where(F.col("sites") <= F.lit(most)).select("line")
    exact = rows.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n"))
    sure = spread.where(F.col("sites") > F.lit(most)).select("line")
    return sure.unionByName(exact.where(F.col("n") >= min_sites).select("line"))


def without_spread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the boilerplate cut from ``text``, and the added columns
    n_lines and n_removed; a column of such a name is kept as ``<name>_input``."""
    docs = without_clashes(docs, ("n_lines", "n_removed"))
    bad = stored(spread_lines(docs, site, min_sites), "boilerplate-lines")
    key = F.xxhash64("text", F.length("text"))
    # what is cut follows from the text alone, so equal texts need one entry
    places = _hashes(docs, key.alias("__text")).join(bad, "line", "left_semi").select("__text", "place").distinct()
    cut = places.groupBy("__text").agg(F.collect_list("place").alias("__cut"))
    rows = docs.withColumn("__text", key).join(cut, "__text", "left")
    none = F.array().cast("array<int>")
    kept = F.array_join(F.filter(_lines(), lambda x, i: ~F.array_contains(F.coalesce("__cut", none), i)), "\n")
    rows = rows.select(
        *[docs[c] for c in docs.columns if c != "text"], F.col("text").alias("__old"), F.col("__cut"),
        F.when(F.col("__cut").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
    return rows.withColumns({
        "n_lines": F.when(F.col("__old").isNull(), 0).otherwise(F.size(F.split("__old", "\n", -1))).cast("long"),
        "n_removed": F.when(F.col("__cut").isNull(), 0).otherwise(F.size("__cut")).cast("long"),
    }).drop("__old", "__cut")
