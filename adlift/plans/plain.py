"""Plain forms of the multi-scan extracts.

The straightforward plan shape: every sub-result reads the fact on its own
(cohort, before window, after window; cohort, two histories), rows are
joined to the cohort before they are aggregated, and dimensions are joined
as they are.  They exist to be compared with the optimised forms in
``extracts`` — tests check equal rows, the benchmark times both — and are
not used by the report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import strategy
from ..operators import display_scope, in_window, is_offsite, is_onsite, only_off_ids, positive_cost
from ..sources.registry import Sources

KEYS3 = ["advertiser_id", "site", "strategy"]
KEYS2 = ["advertiser_id", "site"]


def _destination_flag(src: Sources, oo: DataFrame) -> DataFrame:
    """Per off-only item of the master: 1 when any creative along the
    link -> history -> destination left-join chain has an external subtype."""
    hist, dest = src.creative_history, src.destination
    chain = (
        src.line_item_master.select("line_item_id")
        .join(oo, "line_item_id", "left_semi")
        .join(src.line_item_creative_rel.select("line_item_id", "creative_id"), "line_item_id", "left")
        .join(hist.select("creative_id", "creative_destination_id"), "creative_id", "left")
        .join(dest, F.col("creative_destination_id") == dest["destination_id"], "left")
    )
    ext = F.upper(F.col("destination_subtype")).isin(*C.EXTERNAL_DESTINATION_SUBTYPES)
    return chain.groupBy("line_item_id").agg(F.max(F.when(ext, 1).otherwise(0)).alias("ext"))


def ext_adopters_plain(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Adopters with three fact scans and joins before aggregates."""
    md = src.daily_metrics.withColumn("strategy", strategy(F.col("campaign_target"), C.STRATEGY_ADOPTERS))
    oo = only_off_ids(src.line_item)
    after = in_window(cfg.launch_date, cfg.analysis_end)
    cohort = (
        md.where(after & display_scope() & positive_cost())
        .join(oo, "line_item_id", "left_semi")
        .join(_destination_flag(src, oo), "line_item_id", "left")
        .groupBy(*KEYS3)
        .agg(
            F.min("advertiser_name").alias("advertiser_name"),
            F.min("vertical").alias("vertical"),
            F.max(F.coalesce(F.col("ext"), F.lit(0))).alias("has_dot_com"),
        )
    )
    members = cohort.select(*KEYS3)
    cost = F.col("cost_usd")
    before = (
        md.where(in_window(cfg.before_start, cfg.before_end) & display_scope())
        .join(members, KEYS3)
        .groupBy(*KEYS3)
        .agg(F.sum(cost).alias("rev_before"))
    )
    oo_marks = oo.withColumn("is_oo", F.lit(True))
    after_sums = (
        md.where(after & display_scope())
        .join(members, KEYS3)
        .join(oo_marks, "line_item_id", "left")
        .groupBy(*KEYS3)
        .agg(
            F.sum(cost).alias("rev_after_total"),
            F.sum(F.when(F.col("is_oo"), cost).otherwise(0)).alias("rev_after_oo"),
            F.sum(F.when(is_onsite(), cost).otherwise(0)).alias("rev_after_in_meli"),
        )
    )
    out = cohort.join(before, KEYS3, "left").join(after_sums, KEYS3, "left")
    return out.select(
        "site",
        "advertiser_id",
        "advertiser_name",
        "vertical",
        "has_dot_com",
        "strategy",
        *[
            F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c)
            for c in ("rev_before", "rev_after_total", "rev_after_oo", "rev_after_in_meli")
        ],
    )


def ext_first_time_plain(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """First-time buyers with three fact scans (cohort, two histories)."""
    md = src.daily_metrics
    cohort = (
        md.where(in_window(cfg.launch_date, cfg.analysis_end) & positive_cost())
        .join(only_off_ids(src.line_item), "line_item_id", "left_semi")
        .groupBy(*KEYS2)
        .agg(F.sum("cost_usd").alias("spend"))
        .where(F.col("spend") >= F.lit(cfg.min_spend))
        .select(*KEYS2)
    )
    history = md.where(in_window(cfg.history_start, cfg.history_end) & positive_cost())
    seen_offsite = history.where(is_offsite()).join(cohort, KEYS2).select(*KEYS2).distinct()
    seen_any = history.join(cohort, KEYS2).select(*KEYS2).distinct()
    return (
        cohort.join(src.advertiser.select("advertiser_id", "advertiser_name"), "advertiser_id", "left")
        .join(seen_offsite.withColumn("h_adx", F.lit(True)), KEYS2, "left")
        .join(seen_any.withColumn("h_dsp", F.lit(True)), KEYS2, "left")
        .select(
            "site",
            "advertiser_id",
            "advertiser_name",
            F.col("h_adx").isNull().alias("nuevo_en_adx"),
            F.col("h_dsp").isNull().alias("nuevo_en_dsp"),
        )
    )


PLAIN = {"ext_adopters_plain": ext_adopters_plain, "ext_first_time_plain": ext_first_time_plain}
PLAIN_EXTRACT = {"ext_adopters_plain": "arpu", "ext_first_time_plain": "nuevos"}
