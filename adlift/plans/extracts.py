"""The five extracts: ``(Sources, LaunchConfig) -> DataFrame``.

Plan shape shared by all of them, chosen for a fact table far larger than any
dimension:

1. one scan of the fact per extract, restricted to the date range and the
   columns used (both reach the Parquet reader);
2. an aggregate at line-item grain *before* any join, so the shuffle carries
   one row per (keys, line item) per task instead of one per day and page,
   and a key holding a third of the rows is folded map-side;
3. joins of that reduced result with line-item level dimensions that were
   de-duplicated first (no fan-out, no forced broadcast);
4. a final aggregate at the output grain.

``ext_adopters`` and ``ext_first_time`` compute what the source job asked of
three and two separate fact scans in a single scan with conditional sums;
``plans.plain`` keeps the literal form for equivalence tests and the
benchmark baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import strategy
from ..operators import (
    any_flag,
    cond_sum,
    creative_format_items,
    display_scope,
    in_window,
    inventory_multiplicity,
    inventory_settings,
    is_offsite,
    is_onsite,
    left_join_nullable_key,
    off_item_flags,
    only_off_ids,
    pick_value,
    positive_cost,
    target_allowed,
)
from ..sources.registry import Sources



def _after(cfg: C.LaunchConfig):
    return in_window(cfg.launch_date, cfg.analysis_end)


# ---------------------------------------------------------------------------
# Q1  per line item revenue / prints / clicks, split by channel
# ---------------------------------------------------------------------------


NETWORK_KEYS = ("site", "advertiser_id", "advertiser_name", "vertical", "campaign_id", "line_item_id", "strategy")


def ext_network_items(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Grain: site, advertiser, name, vertical, campaign, line item, raw
    inventory, strategy.  Sums of cost / prints split into off-site and
    on-site (a NULL page is in neither)."""
    return network_items_of(network_sums(src, cfg), src)


def network_sums(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """The fact's sums per line item and strategy."""
    fact = src.daily_metrics.where(
        _after(cfg) & display_scope() & target_allowed(C.TARGETS_NETWORK) & positive_cost()
    ).withColumn("strategy", strategy(F.col("campaign_target"), C.STRATEGY_NETWORK))
    return fact.groupBy(*NETWORK_KEYS).agg(
        F.sum(F.col("cost_usd")).alias("rev_total"),
        cond_sum(is_offsite(), F.col("cost_usd")).alias("rev_off"),
        cond_sum(is_onsite(), F.col("cost_usd")).alias("rev_in"),
        F.sum(F.col("prints_qty")).alias("prints_total"),
        cond_sum(is_offsite(), F.col("prints_qty")).alias("prints_off"),
        cond_sum(is_onsite(), F.col("prints_qty")).alias("prints_in"),
        F.sum(F.col("clicks_qty")).alias("clicks_total"),
    )


def network_items_of(per_item: DataFrame, src: Sources) -> DataFrame:
    """Sums per line item joined with its inventory texts."""
    inv = inventory_multiplicity(src.line_item)
    return network_columns(left_join_nullable_key(per_item, inv, "line_item_id"))


def network_columns(j: DataFrame) -> DataFrame:
    """The extract's columns from sums joined with ``inventory_multiplicity``."""
    n = F.coalesce(F.col("n_rows"), F.lit(1))
    return j.select(
        "site",
        "advertiser_id",
        "advertiser_name",
        "vertical",
        "campaign_id",
        "line_item_id",
        F.coalesce(F.col("raw_inventory"), F.lit("")).alias("raw_inventory"),
        "strategy",
        *[(F.col(m) * n).alias(m) for m in ("rev_total", "rev_off", "rev_in")],
        *[(F.col(m) * n).alias(m) for m in ("prints_total", "prints_off", "prints_in", "clicks_total")],
    )


# ---------------------------------------------------------------------------
# Q2  eligible display population
# ---------------------------------------------------------------------------


def ext_display_population(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Grain: site, advertiser, strategy.  Revenue after launch and whether
    any of it was delivered off-site."""
    fact = src.daily_metrics.where(
        _after(cfg) & display_scope() & target_allowed(C.TARGETS_POPULATION) & positive_cost()
    )
    # name and vertical are grouping keys of the fact-side pass: a string in
    # an aggregation buffer (MIN) would force a sort-based aggregate of every
    # fact row; MIN runs only on the reduced rows of the final pass
    per_name = fact.groupBy(
        "site",
        "advertiser_id",
        strategy(F.col("campaign_target"), C.STRATEGY_POPULATION).alias("strategy"),
        "advertiser_name",
        "vertical",
    ).agg(F.sum(F.col("cost_usd")).alias("rev"), any_flag(is_offsite()).alias("flag"))
    return population_of(per_name)


def population_of(per_name: DataFrame) -> DataFrame:
    """Sums per name folded to site, advertiser, strategy."""
    return (
        per_name.groupBy("site", "advertiser_id", "strategy")
        .agg(
            pick_value(F.col("advertiser_name")).alias("advertiser_name"),
            pick_value(F.col("vertical")).alias("vertical"),
            F.sum("rev").alias("rev_total"),
            F.max("flag").alias("flag_adx"),
        )
        .select("site", "advertiser_id", "advertiser_name", "vertical", "rev_total", "flag_adx", "strategy")
    )


# ---------------------------------------------------------------------------
# Q3  adopters: revenue before vs after launch
# ---------------------------------------------------------------------------


def ext_adopters(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Grain: site, advertiser, strategy of every group that bought an
    off-site-only line item after launch (positive cost, display scope).

    Revenue columns cover *all* display-scope rows of the group (no positive
    cost filter): before window, after window, the off-site-only part of the
    after window and its on-site part.  A group with a NULL site or
    advertiser matches nothing and gets zeros.  One fact scan covers both
    windows (they are contiguous: the before window ends the day before
    launch).
    """
    return adopters_of(adopter_sums(adopter_rows(src, cfg), cfg), src)


def adopter_rows(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Display rows of both windows, with the strategy of the adopters' table."""
    lo = min(cfg.before_start, cfg.launch_date)
    hi = max(cfg.analysis_end, cfg.before_end)
    return src.daily_metrics.where(in_window(lo, hi) & display_scope()).withColumn(
        "strategy", strategy(F.col("campaign_target"), C.STRATEGY_ADOPTERS)
    )


def adopter_sums(fact: DataFrame, cfg: C.LaunchConfig) -> DataFrame:
    """``adopter_rows`` folded per line item."""
    after = _after(cfg)
    before = in_window(cfg.before_start, cfg.before_end)
    qual = after & positive_cost()
    # Keys of the fact-side pass: the line item only matters after launch
    # (for the off-only split), name and vertical only on qualifying rows;
    # elsewhere they are NULL, so the before window folds to one row per
    # group.  Name and vertical are keys, not MIN buffers, which keeps this
    # aggregate hash-based.
    return fact.groupBy(
        "site",
        "advertiser_id",
        "strategy",
        F.when(after, F.col("line_item_id")).alias("line_item_id"),
        F.when(qual, F.col("advertiser_name")).alias("advertiser_name"),
        F.when(qual, F.col("vertical")).alias("vertical"),
    ).agg(
        F.sum(F.when(before, F.col("cost_usd"))).alias("b"),
        F.sum(F.when(after, F.col("cost_usd"))).alias("a"),
        F.sum(F.when(after & is_onsite(), F.col("cost_usd"))).alias("a_in"),
        any_flag(qual).alias("q"),
    )


def adopters_of(per_item: DataFrame, src: Sources) -> DataFrame:
    """Sums per line item (before ``b``, after ``a``, on-site after ``a_in``,
    flag of a qualifying row ``q``) to one row per adopter group."""
    j = left_join_nullable_key(per_item, off_item_flags(src), "line_item_id")
    is_oo = F.coalesce(F.col("is_oo"), F.lit(False))
    adopt = is_oo & (F.col("q") == 1)
    # MIN of a string makes this a sort-based aggregate, but only over the
    # folded rows (about one per active line item), never over fact rows
    g = j.groupBy("site", "advertiser_id", "strategy").agg(
        F.max(adopt).alias("adopter"),
        F.min(F.when(adopt, F.col("advertiser_name"))).alias("advertiser_name"),
        F.min(F.when(adopt, F.col("vertical"))).alias("vertical"),
        F.max(F.when(adopt, F.col("has_ext"))).alias("has_dot_com"),
        F.sum("b").alias("rev_before"),
        F.sum("a").alias("rev_after_total"),
        F.sum(F.when(is_oo, F.col("a"))).alias("rev_after_oo"),
        F.sum("a_in").alias("rev_after_in_meli"),
    ).where(F.col("adopter"))
    keys_ok = F.col("site").isNotNull() & F.col("advertiser_id").isNotNull()

    def rev(c: str):
        return F.when(keys_ok, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0)).alias(c)

    return g.select(
        "site",
        "advertiser_id",
        "advertiser_name",
        "vertical",
        F.coalesce(F.col("has_dot_com"), F.lit(0)).alias("has_dot_com"),
        "strategy",
        rev("rev_before"),
        rev("rev_after_total"),
        rev("rev_after_oo"),
        rev("rev_after_in_meli"),
    )


# ---------------------------------------------------------------------------
# Q4  first-time buyers among adopters
# ---------------------------------------------------------------------------


def ext_first_time(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Grain: site, advertiser with at least ``min_spend`` of off-site-only
    spend (positive-cost rows) after launch.  ``nuevo_en_adx`` / ``nuevo_en_dsp``:
    no off-site / no positive-cost row at all in the history window (from
    ``history_start`` to the day before launch).  No display scope here.
    The name comes from the advertiser dimension (a repeated id repeats the
    row).  History and after window are read in one scan."""
    return first_time_of(first_time_sums(first_time_rows(src, cfg), cfg), src, cfg)


def first_time_rows(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Rows of positive cost from the history and after launch."""
    lo = min(cfg.history_start, cfg.launch_date)
    hi = max(cfg.analysis_end, cfg.history_end)
    return src.daily_metrics.where(in_window(lo, hi) & positive_cost())


def first_time_sums(fact: DataFrame, cfg: C.LaunchConfig) -> DataFrame:
    """``first_time_rows`` folded per line item."""
    after = _after(cfg)
    hist = in_window(cfg.history_start, cfg.history_end)
    # the line item is needed after launch only: history rows fold to one
    # row per (site, advertiser) before the shuffle
    return fact.groupBy("site", "advertiser_id", F.when(after, F.col("line_item_id")).alias("line_item_id")).agg(
        F.sum(F.when(after, F.col("cost_usd"))).alias("a"),
        any_flag(hist).alias("h_dsp"),
        any_flag(hist & is_offsite()).alias("h_adx"),
    )


def first_time_of(per_item: DataFrame, src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Sums per line item (spend after ``a``, flags of history rows) to the
    cohort with its two flags and names."""
    oo = only_off_ids(src.line_item).withColumn("is_oo", F.lit(True))
    j = left_join_nullable_key(per_item, oo, "line_item_id")
    is_oo = F.coalesce(F.col("is_oo"), F.lit(False))
    g = (
        j.groupBy("site", "advertiser_id")
        .agg(
            F.sum(F.when(is_oo, F.col("a"))).alias("oo_spend"),
            F.max("h_dsp").alias("h_dsp"),
            F.max("h_adx").alias("h_adx"),
        )
        .where(F.col("oo_spend") >= F.lit(cfg.min_spend))
    )
    keys_ok = F.col("site").isNotNull() & F.col("advertiser_id").isNotNull()
    cohort = g.select(
        "site",
        "advertiser_id",
        (~(keys_ok & (F.col("h_adx") == 1))).alias("nuevo_en_adx"),
        (~(keys_ok & (F.col("h_dsp") == 1))).alias("nuevo_en_dsp"),
    )
    names = src.advertiser.select("advertiser_id", "advertiser_name").where(F.col("advertiser_id").isNotNull())
    return cohort.join(names, "advertiser_id", "left").select(
        "site", "advertiser_id", "advertiser_name", "nuevo_en_adx", "nuevo_en_dsp"
    )


# ---------------------------------------------------------------------------
# Q5  creative format adoption
# ---------------------------------------------------------------------------


def ext_creative_adoption(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Distinct (site, campaign, line item, advertiser, inventory category,
    strategy) of display delivery after launch, with a flag for line items
    that carry a creative of the configured format."""
    return creative_adoption_of(creative_active(src, cfg), src, cfg)


def creative_active(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Distinct keys of display delivery after launch."""
    fact = src.daily_metrics.where(
        _after(cfg) & display_scope() & target_allowed(C.TARGETS_CREATIVE) & positive_cost()
    )
    return fact.select(*creative_keys()).distinct()


def creative_keys() -> list:
    return ["site", "campaign_id", "line_item_id", "advertiser_id", strategy(F.col("campaign_target"), C.STRATEGY_CREATIVE).alias("strategy")]


def creative_adoption_of(active: DataFrame, src: Sources, cfg: C.LaunchConfig, items: DataFrame | None = None) -> DataFrame:
    """Active keys joined with inventory categories and the format's mark (of
    the distinct line item ids ``items``, if they are known already)."""
    with_inv = left_join_nullable_key(active, inventory_settings(src.line_item), "line_item_id").withColumn(
        "inv_setting", F.coalesce(F.col("inv_setting"), F.lit(C.ONLY_IN))
    )
    items = creative_format_items(src, cfg) if items is None else items
    marks = items.withColumn("__hit", F.lit(True))
    return left_join_nullable_key(with_inv, marks, "line_item_id").select(
        "site",
        "campaign_id",
        "line_item_id",
        "advertiser_id",
        "inv_setting",
        "strategy",
        F.col("__hit").isNotNull().alias("has_iab_creative"),
    )


EXTRACTS = {
    "enet": ext_network_items,
    "aw_denom": ext_display_population,
    "arpu": ext_adopters,
    "nuevos": ext_first_time,
    "iab": ext_creative_adoption,
}


def all_extracts(src: Sources, cfg: C.LaunchConfig) -> dict[str, DataFrame]:
    """The five extracts, lazily, keyed by their cache names."""
    return {k: f(src, cfg) for k, f in EXTRACTS.items()}
