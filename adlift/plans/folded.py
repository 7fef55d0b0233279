"""The five extracts from the daily fold: no scan of the fact.

Each first step equals its counterpart of ``plans.extracts`` with the fold's
sums in place of fact rows; the joins and last aggregates are the same
functions.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import strategy
from ..operators import in_window, target_allowed
from ..sources.fold import FoldStore
from ..sources.registry import Sources
from . import extracts as X


def fold_range(cfg: C.LaunchConfig) -> tuple[date, date]:
    """The days that the five extracts read."""
    starts = (cfg.before_start, cfg.history_start, cfg.launch_date)
    return min(starts), max(cfg.analysis_end, cfg.before_end, cfg.history_end)


def _after(cfg: C.LaunchConfig):
    return in_window(cfg.launch_date, cfg.analysis_end)


def network_items(fold: DataFrame, src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    rows = fold.where(_after(cfg) & F.col("in_scope") & F.col("paid") & target_allowed(C.TARGETS_NETWORK))
    rows = rows.withColumn("strategy", strategy(F.col("campaign_target"), C.STRATEGY_NETWORK))
    sums = {
        "rev_total": "cost", "rev_off": "cost_off", "rev_in": "cost_in", "prints_total": "prints", "prints_off": "prints_off",
        "prints_in": "prints_in", "clicks_total": "clicks",
    }
    per_item = rows.groupBy(*X.NETWORK_KEYS).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return X.network_items_of(per_item, src)


def display_population(fold: DataFrame, src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    rows = fold.where(_after(cfg) & F.col("in_scope") & F.col("paid") & target_allowed(C.TARGETS_POPULATION))
    name = strategy(F.col("campaign_target"), C.STRATEGY_POPULATION).alias("strategy")
    per_name = rows.groupBy("site", "advertiser_id", name, "advertiser_name", "vertical").agg(
        F.sum("cost").alias("rev"), F.max("has_off").alias("flag")
    )
    return X.population_of(per_name)


def adopters(fold: DataFrame, src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    after, before = _after(cfg), in_window(cfg.before_start, cfg.before_end)
    qual = after & F.col("paid")
    rows = fold.where(F.col("in_scope") & (after | before))
    per_item = rows.groupBy(
        "site",
        "advertiser_id",
        strategy(F.col("campaign_target"), C.STRATEGY_ADOPTERS).alias("strategy"),
        F.when(after, F.col("line_item_id")).alias("line_item_id"),
        F.when(qual, F.col("advertiser_name")).alias("advertiser_name"),
        F.when(qual, F.col("vertical")).alias("vertical"),
    ).agg(
        F.sum(F.when(before, F.col("cost"))).alias("b"),
        F.sum(F.when(after, F.col("cost"))).alias("a"),
        F.sum(F.when(after, F.col("cost_on"))).alias("a_in"),
        F.max(F.when(qual, F.lit(1)).otherwise(F.lit(0))).alias("q"),
    )
    return X.adopters_of(per_item, src)


def first_time(fold: DataFrame, src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    after, hist = _after(cfg), in_window(cfg.history_start, cfg.history_end)
    rows = fold.where(F.col("paid") & (after | hist))
    per_item = rows.groupBy("site", "advertiser_id", F.when(after, F.col("line_item_id")).alias("line_item_id")).agg(
        F.sum(F.when(after, F.col("cost"))).alias("a"),
        F.max(F.when(hist, F.lit(1)).otherwise(F.lit(0))).alias("h_dsp"),
        F.max(F.when(hist, F.col("has_off")).otherwise(F.lit(0))).alias("h_adx"),
    )
    return X.first_time_of(per_item, src, cfg)


def creative_adoption(fold: DataFrame, src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    rows = fold.where(_after(cfg) & F.col("in_scope") & F.col("paid") & target_allowed(C.TARGETS_CREATIVE))
    return X.creative_adoption_of(rows.select(*X.creative_keys()).distinct(), src, cfg)


FOLDED = {
    "enet": network_items,
    "aw_denom": display_population,
    "arpu": adopters,
    "nuevos": first_time,
    "iab": creative_adoption,
}


def refreshed(src: Sources, cfg: C.LaunchConfig, root: str, late_days: int = 0, restate: Iterable[date] = ()) -> tuple[DataFrame, list[date]]:
    """The fold of all days the extracts read, after folding those that the
    store under ``root`` lacks, and the days folded now."""
    store = FoldStore(src.daily_metrics.sparkSession, root)
    start, end = fold_range(cfg)
    days = store.refresh(src, start, end, late_days, restate)
    return store.read(start, end), days


def extracts_from(fold: DataFrame, src: Sources, cfg: C.LaunchConfig) -> dict[str, DataFrame]:
    """The five extracts, lazily, keyed by their cache names."""
    return {k: f(fold, src, cfg) for k, f in FOLDED.items()}
