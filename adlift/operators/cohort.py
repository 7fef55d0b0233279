"""Line-item level dimensions derived once and shared by the extracts.

Each function returns a DataFrame keyed by ``line_item_id`` that is joined to
an already aggregated fact, never to raw fact rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import inventory_lenient, json_array_has_type
from ..sources.registry import Sources


def only_off_ids(line_item: DataFrame) -> DataFrame:
    """Distinct ids of line items sold as off-site only (``UPPER(inventory) = 'OFF'``)."""
    return (
        line_item.where(F.upper(F.col("inventory")) == C.INVENTORY_OFF)
        .select("line_item_id")
        .where(F.col("line_item_id").isNotNull())
        .distinct()
    )


def external_destination_items(src: Sources, candidates: DataFrame) -> DataFrame:
    """Ids among ``candidates`` that exist in the line-item master and have a
    creative whose destination subtype is external (ids may repeat).

    Written as a chain of semi joins starting from the (small) destination
    list, so the n:m link and the creative history are filtered, never
    multiplied: ``MAX`` over the left-join chain is 1 exactly when such a
    path exists.
    """
    ext_dest = (
        src.destination.where(F.upper(F.col("destination_subtype")).isin(*C.EXTERNAL_DESTINATION_SUBTYPES))
        .select(F.col("destination_id").alias("creative_destination_id"))
    )
    ext_creatives = src.creative_history.select("creative_id", "creative_destination_id").join(
        ext_dest, "creative_destination_id", "left_semi"
    )
    # both id filters first (same key, one partitioning), then the creative test
    links = (
        src.line_item_creative_rel.select("line_item_id", "creative_id")
        .join(candidates, "line_item_id", "left_semi")
        .join(src.line_item_master.select("line_item_id"), "line_item_id", "left_semi")
    )
    return links.join(ext_creatives, "creative_id", "left_semi").select("line_item_id")


def off_item_flags(src: Sources) -> DataFrame:
    """``(line_item_id, is_oo, has_ext)`` for every off-site-only line item:
    ``is_oo`` is always true, ``has_ext`` is 1 when the item has an external
    destination (0 otherwise).

    Both memberships are gathered as rows of one union and folded by a
    single aggregate on the id (one shuffle, duplicates absorbed), instead
    of two de-duplications and a join.
    """
    off = src.line_item.where(F.upper(F.col("inventory")) == C.INVENTORY_OFF).select("line_item_id").where(
        F.col("line_item_id").isNotNull()
    )
    ext = external_destination_items(src, off)
    marks = off.select("line_item_id", F.lit(1).alias("oo"), F.lit(0).alias("ext")).unionByName(
        ext.select("line_item_id", F.lit(0).alias("oo"), F.lit(1).alias("ext"))
    )
    return (
        marks.groupBy("line_item_id")
        .agg(F.max("oo").alias("oo"), F.max("ext").alias("has_ext"))
        .where(F.col("oo") == 1)
        .select("line_item_id", F.lit(True).alias("is_oo"), "has_ext")
    )


def inventory_multiplicity(line_item: DataFrame) -> DataFrame:
    """``(line_item_id, raw_inventory, n_rows)``: the dimension folded to one
    row per id and inventory text (NULL shown as '').  ``n_rows`` > 1 only
    when the dimension repeats an id; a join with it then scales sums exactly
    as a join with the raw dimension would."""
    return (
        line_item.where(F.col("line_item_id").isNotNull())
        .groupBy("line_item_id", F.coalesce(F.col("inventory"), F.lit("")).alias("raw_inventory"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def inventory_settings(line_item: DataFrame) -> DataFrame:
    """Distinct ``(line_item_id, inv_setting)`` under the lenient classifier."""
    return (
        line_item.where(F.col("line_item_id").isNotNull())
        .select("line_item_id", inventory_lenient(F.col("inventory")).alias("inv_setting"))
        .distinct()
    )


def creative_format_items(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Distinct line item ids with a creative of the configured format, from
    advertisers not excluded (a NULL advertiser is excluded, as with SQL
    ``NOT IN``)."""
    creatives = src.creative.where(
        ~F.col("advertiser_id").isin(*cfg.excluded_creative_advertisers)
        & json_array_has_type(F.col("images"), cfg.creative_format)
    ).select("creative_id")
    return (
        src.line_item_creative.join(creatives, "creative_id", "left_semi")
        .select(F.col("line_item_id").cast("bigint").alias("line_item_id"))
        .where(F.col("line_item_id").isNotNull())
        .distinct()
    )
