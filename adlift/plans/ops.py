"""Single-operator queries over the sources, one per inventory line.

Each isolates one operator of the extracts (a classifier, a join shape, an
aggregate shape) over the *whole* source tables, so it can be checked on
its own against the oracle.  They reuse the library's Column functions and
operators; none has logic of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import (
    inventory_lenient,
    inventory_strict,
    is_non_endemic,
    json_array_has_type,
    safe_ratio,
    site_label,
    strategy,
    to_number,
)
from ..operators import (
    absent_flag,
    anti_join_null_safe,
    any_flag,
    cond_sum,
    display_scope,
    in_window,
    inventory_multiplicity,
    is_offsite,
    is_onsite,
    left_join_nullable_key,
    off_item_flags,
    only_off_ids,
    pick_value,
    positive_cost,
)
from ..session import scratch_path
from ..sources.cache import read_extracts, write_extracts
from ..sources.registry import Sources
from .extracts import ext_adopters, ext_network_items


def _after(cfg: C.LaunchConfig):
    return in_window(cfg.launch_date, cfg.analysis_end)


def op_strategy_variants(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Every campaign target under the four strategy rule tables."""
    t = F.col("campaign_target")
    return src.daily_metrics.select(
        "campaign_target",
        strategy(t, C.STRATEGY_NETWORK).alias("strategy_network"),
        strategy(t, C.STRATEGY_POPULATION).alias("strategy_population"),
        strategy(t, C.STRATEGY_ADOPTERS).alias("strategy_adopters"),
        strategy(t, C.STRATEGY_CREATIVE).alias("strategy_creative"),
    ).distinct()


def op_inventory_variants(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Each inventory text under the lenient and the strict classifier."""
    inv = F.col("inventory")
    return src.line_item.groupBy(
        "inventory", inventory_lenient(inv).alias("lenient"), inventory_strict(inv).alias("strict")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def op_sector_flag(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Each vertical with its non-endemic flag."""
    return src.daily_metrics.select("vertical", is_non_endemic(F.col("vertical"), cfg.non_endemic_verticals).alias("non_endemic")).distinct()


def op_site_label(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Each site with its label (the code itself when unknown)."""
    return src.daily_metrics.select("site").distinct().select(
        F.col("site").cast("string").alias("site"), site_label(F.col("site"), cfg.site_labels).alias("site_label")
    )


def op_null_default(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Fact rows after launch per inventory text of their line item, a
    missing line item or NULL inventory shown as ''.  Rows are counted per
    line item before the join, then scaled by the dimension's multiplicity."""
    per_item = src.daily_metrics.where(_after(cfg)).groupBy("line_item_id").agg(F.count(F.lit(1)).alias("n"))
    j = per_item.join(inventory_multiplicity(src.line_item), "line_item_id", "left")
    return j.groupBy(F.coalesce(F.col("raw_inventory"), F.lit("")).alias("raw_inventory")).agg(
        F.sum(F.col("n") * F.coalesce(F.col("n_rows"), F.lit(1))).alias("n_rows")
    )


def op_date_window(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Rows and cost in the before, after and history windows, one pass."""
    cost = F.col("cost_usd")
    before = in_window(cfg.before_start, cfg.before_end)
    after = _after(cfg)
    hist = in_window(cfg.history_start, cfg.history_end)
    return src.daily_metrics.agg(
        F.count_if(before).alias("n_before"),
        F.coalesce(F.sum(F.when(before, cost)), F.lit(0.0)).alias("cost_before"),
        F.count_if(after).alias("n_after"),
        F.coalesce(F.sum(F.when(after, cost)), F.lit(0.0)).alias("cost_after"),
        F.count_if(hist).alias("n_history"),
        F.coalesce(F.sum(F.when(hist, cost)), F.lit(0.0)).alias("cost_history"),
    )


def op_display_scope(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Rows per campaign type, product type and line item type, with
    whether the combination is in the display scope (a NULL type is not)."""
    return src.daily_metrics.groupBy(
        "campaign_type", "product_type", "line_item_type", F.coalesce(display_scope(), F.lit(False)).alias("in_scope")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def op_destination_flag(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Off-site-only line items of the master with their external-destination flag."""
    return (
        off_item_flags(src)
        .join(src.line_item_master.select("line_item_id"), "line_item_id", "left_semi")
        .select("line_item_id", F.col("has_ext").alias("has_ext_destination"))
    )


def op_semi_join(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Advertiser x site pairs that bought an off-site-only line item after
    launch (``IN (SELECT ...)`` as a semi join on distinct ids)."""
    f = src.daily_metrics.where(_after(cfg) & positive_cost())
    per_item = f.groupBy("advertiser_id", "site", "line_item_id").agg(F.count(F.lit(1)).alias("n"))
    return per_item.join(only_off_ids(src.line_item), "line_item_id", "left_semi").select("advertiser_id", "site").distinct()


def op_having(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Advertiser x site pairs whose off-site-only spend after launch reaches
    the minimum (``GROUP BY ... HAVING SUM(...) >= min``)."""
    f = src.daily_metrics.where(_after(cfg) & positive_cost())
    per_item = f.groupBy("advertiser_id", "site", "line_item_id").agg(F.sum("cost_usd").alias("spend"))
    j = per_item.join(only_off_ids(src.line_item), "line_item_id", "left_semi")
    return (
        j.groupBy("advertiser_id", "site")
        .agg(F.sum("spend").alias("oo_spend"))
        .where(F.col("oo_spend") >= F.lit(cfg.min_spend))
    )


def op_distinct_keys(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Advertiser x site pairs with positive-cost delivery in the history window."""
    f = src.daily_metrics.where(in_window(cfg.history_start, cfg.history_end) & positive_cost())
    return f.select("advertiser_id", "site").distinct()


def op_inner_join(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Line item links per creative advertiser (creative JOIN link table)."""
    j = src.creative.select("creative_id", "advertiser_id").join(src.line_item_creative, "creative_id")
    return j.groupBy("advertiser_id").agg(F.count(F.lit(1)).alias("n_links"))


def op_array_exists(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Each creative with whether its encoded images array holds the format."""
    return src.creative.select("creative_id", json_array_has_type(F.col("images"), cfg.creative_format).alias("has_format"))


def op_conditional_sum(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Per site after launch: total, off-site and on-site cost (0, not NULL,
    when a part is empty; a NULL page is in neither part)."""
    f = src.daily_metrics.where(_after(cfg))
    cost = F.col("cost_usd")
    return f.groupBy("site").agg(
        F.sum(cost).alias("cost_total"),
        cond_sum(is_offsite(), cost).alias("cost_off"),
        cond_sum(is_onsite(), cost).alias("cost_in"),
    )


def op_any_flag(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Per advertiser after launch: 1 when any delivery was off-site."""
    return src.daily_metrics.where(_after(cfg)).groupBy("advertiser_id").agg(any_flag(is_offsite()).alias("any_offsite"))


def op_safe_ratio(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Off-site CPM per network item; NULL when nothing was printed off-site."""
    e = ext_network_items(src, cfg)
    return e.select(
        "site",
        "advertiser_id",
        "advertiser_name",
        "vertical",
        "campaign_id",
        "line_item_id",
        "raw_inventory",
        "strategy",
        safe_ratio(F.col("rev_off"), F.col("prints_off"), 1000).alias("cpm_off"),
    )


def op_not_in_null(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Rows per line item type kept by ``UPPER(type) NOT IN ('VIDEO', 'SOCIAL')``
    (a NULL type is not kept)."""
    kept = ~F.upper(F.col("line_item_type")).isin(*C.SCOPE_EXCLUDED_LINE_TYPES)
    return src.daily_metrics.where(kept).groupBy("line_item_type").agg(F.count(F.lit(1)).alias("n_rows"))


def op_left_join(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Line items delivered after launch with their inventory (NULL when the
    dimension has no row; every dimension row of the item is kept)."""
    items = src.daily_metrics.where(_after(cfg)).select("line_item_id").distinct()
    dim = src.line_item.select("line_item_id", "inventory")
    return left_join_nullable_key(items, dim, "line_item_id").distinct()


def op_cohort_restrict(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Positive-cost history rows of the first-timer cohort, per advertiser x
    site (the fact restricted to a composite-key cohort)."""
    cohort = op_having(src, cfg).select("advertiser_id", "site")
    hist = src.daily_metrics.where(in_window(cfg.history_start, cfg.history_end) & positive_cost())
    per_key = hist.groupBy("advertiser_id", "site").agg(F.count(F.lit(1)).alias("n_rows"))
    return per_key.join(cohort, ["advertiser_id", "site"])


def op_computed_key_join(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Before-window revenue of each adopter group, matched on advertiser,
    site and the strategy computed from the row's target."""
    groups = ext_adopters(src, cfg).select("advertiser_id", "site", "strategy")
    rows = src.daily_metrics.where(in_window(cfg.before_start, cfg.before_end) & display_scope())
    keyed = rows.groupBy(
        "advertiser_id", "site", strategy(F.col("campaign_target"), C.STRATEGY_ADOPTERS).alias("strategy")
    ).agg(F.sum("cost_usd").alias("rev_before"))
    return keyed.join(groups, ["advertiser_id", "site", "strategy"])


def op_existence_in_aggregate(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Per advertiser x site x strategy after launch: total cost and the part
    on off-only line items (``SUM(CASE WHEN id IN (...) ...)``)."""
    rows = src.daily_metrics.where(_after(cfg) & display_scope())
    per_item = rows.groupBy(
        "advertiser_id",
        "site",
        strategy(F.col("campaign_target"), C.STRATEGY_ADOPTERS).alias("strategy"),
        "line_item_id",
    ).agg(F.sum("cost_usd").alias("cost"))
    marks = only_off_ids(src.line_item).withColumn("is_oo", F.lit(True))
    j = left_join_nullable_key(per_item, marks, "line_item_id")
    return j.groupBy("advertiser_id", "site", "strategy").agg(
        F.sum("cost").alias("cost_total"),
        F.coalesce(F.sum(F.when(F.col("is_oo"), F.col("cost"))), F.lit(0.0)).alias("cost_oo"),
    )


def op_anti_flag(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Every master line item with whether it has no creative link (all rows kept)."""
    return absent_flag(
        src.line_item_master.select("line_item_id"), src.line_item_creative_rel, ["line_item_id"], "no_creative"
    )


def op_anti_join(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Advertisers of the dimension with no delivery after launch."""
    active = src.daily_metrics.where(_after(cfg)).select("advertiser_id")
    return anti_join_null_safe(src.advertiser.select("advertiser_id", "advertiser_name"), active, "advertiser_id")


def op_any_value(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """One name per advertiser x site after launch (the smallest: a
    deterministic ``ANY_VALUE``), folded by name first so the pass over the
    fact stays hash-based."""
    per_name = src.daily_metrics.where(_after(cfg)).groupBy("site", "advertiser_id", "advertiser_name").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_name.groupBy("site", "advertiser_id").agg(pick_value(F.col("advertiser_name")).alias("advertiser_name"))


def op_group_by_expression(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Rows and cost after launch grouped by the strategy computed from the
    target (population rules)."""
    rows = src.daily_metrics.where(_after(cfg))
    return rows.groupBy(strategy(F.col("campaign_target"), C.STRATEGY_POPULATION).alias("strategy")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("cost_usd").alias("cost")
    )


def op_numeric_coercion(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Numbers read from text: each fact row's cost and line item as text,
    written in one of nine ways (some no numbers: 0), with rows per value."""
    cost, item = F.col("cost_usd").cast("bigint").cast("string"), F.col("line_item_id").cast("string")
    texts = [
        cost, F.concat(F.lit(" -"), item, F.lit(".5 ")), F.lit(""), F.lit("abc"), F.concat(item, F.lit(",000")),
        F.concat(item, F.lit("d")), F.lit("nan"), F.lit(None).cast("string"), F.concat(item, F.lit("e2")),
    ]
    text = F.element_at(F.array(*texts), (F.col("line_item_id") % len(texts) + 1).cast("int"))
    rows = src.daily_metrics.select(text.alias("text"))
    return rows.groupBy("text", to_number(F.col("text")).alias("number")).agg(F.count(F.lit(1)).alias("n_rows"))


def csv_replay(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Adopters written as CSV to the shared folder and read back with the
    live schema: the replayed rows must equal the live ones."""
    live = ext_adopters(src, cfg)
    root = scratch_path(live.sparkSession, "csv-replay")
    write_extracts({"arpu": live}, root, fmt="csv")
    return read_extracts(live.sparkSession, root, fmt="csv", schemas={"arpu": live.schema}, names=("arpu",))["arpu"]


OPS = {
    "op_strategy_variants": op_strategy_variants,
    "op_inventory_variants": op_inventory_variants,
    "op_sector_flag": op_sector_flag,
    "op_site_label": op_site_label,
    "op_null_default": op_null_default,
    "op_date_window": op_date_window,
    "op_display_scope": op_display_scope,
    "op_destination_flag": op_destination_flag,
    "op_semi_join": op_semi_join,
    "op_having": op_having,
    "op_distinct_keys": op_distinct_keys,
    "op_inner_join": op_inner_join,
    "op_array_exists": op_array_exists,
    "op_conditional_sum": op_conditional_sum,
    "op_any_flag": op_any_flag,
    "op_safe_ratio": op_safe_ratio,
    "op_not_in_null": op_not_in_null,
    "op_left_join": op_left_join,
    "op_cohort_restrict": op_cohort_restrict,
    "op_computed_key_join": op_computed_key_join,
    "op_existence_in_aggregate": op_existence_in_aggregate,
    "op_anti_flag": op_anti_flag,
    "op_anti_join": op_anti_join,
    "op_any_value": op_any_value,
    "op_group_by_expression": op_group_by_expression,
    "op_numeric_coercion": op_numeric_coercion,
}
