"""The two cohort extracts with fact rows filtered by cohort before the shuffle.

``ext_adopters`` and ``ext_first_time`` fold every group of both windows and
then keep the cohort.  Here the cohort, which the days after launch alone
decide, is found and stored first; the second pass drops rows of other groups
as it reads them (``operators.keyfilter``).  This pays where the cohort is a small part of the
groups and the window before launch is long: the days after launch are read
twice, and what is shuffled of the rest is the cohort's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import only_off_ids, positive_cost
from ..operators.keyfilter import KeyFilter, key_filter
from ..session import scratch_path
from ..sources.registry import Sources
from . import extracts as X

#: a sum may come out smaller in another order of its terms
SUM_SLACK = 1e-9


def _off_only_spend(rows: DataFrame, src: Sources, keys: list[str]) -> DataFrame:
    """(keys, spend) on off-site-only items; rows are folded per item first."""
    per_item = rows.where(F.col("line_item_id").isNotNull()).groupBy(*keys, "line_item_id").agg(F.sum("cost_usd").alias("spend"))
    off = per_item.join(only_off_ids(src.line_item), "line_item_id", "left_semi")
    return off.groupBy(*keys).agg(F.sum("spend").alias("spend"))


def adopter_filter(src: Sources, cfg: C.LaunchConfig, path: str) -> KeyFilter:
    """Groups with a qualifying row on an off-site-only item."""
    rows = X.adopter_rows(src, cfg).where(X._after(cfg) & positive_cost())
    keys = ["site", "advertiser_id", "strategy"]
    return key_filter(_off_only_spend(rows, src, keys).select(*keys), path)


def first_time_filter(src: Sources, cfg: C.LaunchConfig, path: str) -> KeyFilter:
    """Buyers that reach the minimum spend, up to rounding."""
    rows = X.first_time_rows(src, cfg).where(X._after(cfg))
    keys = ["site", "advertiser_id"]
    least = cfg.min_spend - abs(cfg.min_spend) * SUM_SLACK
    return key_filter(_off_only_spend(rows, src, keys).where(F.col("spend") >= least).select(*keys), path)


def prefiltered_adopters(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    keep = adopter_filter(src, cfg, scratch_path(src.daily_metrics.sparkSession, "adopter-keys"))
    return X.adopters_of(X.adopter_sums(keep.keep(X.adopter_rows(src, cfg)), cfg), src)


def prefiltered_first_time(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    keep = first_time_filter(src, cfg, scratch_path(src.daily_metrics.sparkSession, "buyer-keys"))
    return X.first_time_of(X.first_time_sums(keep.keep(X.first_time_rows(src, cfg)), cfg), src, cfg)
