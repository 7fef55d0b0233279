"""Creative formats parsed once: typed rows, inverted from format to line items.

``write`` reads the creatives' JSON a single time and stores three tables:

* ``creatives`` ``(type, creative_id, advertiser_id)``, a row for each format
  of a creative;
* ``items`` ``(type, line_item_id, advertiser_id)``, the line items that carry
  a creative of the format, with the creative's advertiser, so that any list
  of excluded advertisers can be applied later;
* ``forms`` ``(form, n_creatives)``, how many creatives hold an encoded array,
  other JSON, malformed text or nothing.

The first two are in ranges of ``(type, id)`` and sorted, so a format that
holds a third of all rows is in many files and the files of other formats are
skipped by their statistics.  Questions about any format read the index; no
JSON is parsed again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import json_array_form, json_array_types
from .registry import Sources


@dataclass(frozen=True)
class FormatIndex:
    spark: SparkSession
    root: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def write(self, src: Sources) -> FormatIndex:
        """Build the index of ``src`` in a folder that does not exist yet."""
        images = F.col("images").cast("string")
        parsed = src.creative.select("creative_id", "advertiser_id", json_array_form(images).alias("form"), json_array_types(images).alias("types"))
        parsed.write.parquet(f"{self.root}/parsed")
        parsed = self._table("parsed")
        parsed.groupBy("form").agg(F.count(F.lit(1)).alias("n_creatives")).write.parquet(f"{self.root}/forms")
        typed = parsed.select(F.explode("types").alias("type"), "creative_id", "advertiser_id")
        self._in_ranges(typed.distinct(), "creative_id", "creatives")
        links = src.line_item_creative.where(F.col("creative_id").isNotNull()).select(
            "creative_id", F.col("line_item_id").cast("bigint").alias("line_item_id")
        )
        items = typed.join(links, "creative_id").where(F.col("line_item_id").isNotNull())
        self._in_ranges(items.select("type", "line_item_id", "advertiser_id").distinct(), "line_item_id", "items")
        return self

    def _in_ranges(self, rows: DataFrame, key: str, name: str) -> None:
        rows.repartitionByRange("type", key).sortWithinPartitions("type", key).write.parquet(f"{self.root}/{name}")

    def forms(self) -> DataFrame:
        return self._table("forms")

    def items(self, format_type: str, excluded: Iterable[int] = ()) -> DataFrame:
        """Distinct ids of line items with a creative of the format from an
        advertiser not excluded (a NULL advertiser is, as with SQL ``NOT IN``
        when the list is not empty)."""
        rows = self._table("items").where(F.col("type") == format_type)
        excluded = list(excluded)
        if excluded:
            rows = rows.where(~F.col("advertiser_id").isin(*excluded))
        return rows.select("line_item_id").distinct()

    def formats(self) -> DataFrame:
        """``(type, n_creatives, n_line_items)`` of every format: two aggregates
        of distinct rows, joined on the format."""
        c = self._table("creatives").select("type", "creative_id").distinct().groupBy("type").agg(F.count("creative_id").alias("n_creatives"))
        i = self._table("items").select("type", "line_item_id").distinct().groupBy("type").agg(F.count("line_item_id").alias("n_line_items"))
        return c.join(i, "type", "left").select("type", "n_creatives", F.coalesce("n_line_items", F.lit(0).cast("bigint")).alias("n_line_items"))
