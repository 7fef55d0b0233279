"""KPI tables: ``(extract DataFrames, LaunchConfig) -> DataFrame``.

Everything stays a lazy distributed plan; a global KPI is a one-row
aggregate, never a driver-side loop.  Ratios are published unrounded (the
rounded value is a display concern, see ``report.tbl_adoption``); a zero or
missing denominator gives NULL for row-level ratios and 0 for KPI shares,
as in the job being reproduced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import (
    inventory_label,
    inventory_priority,
    inventory_strict,
    is_non_endemic,
    priority_category,
    ratio_or_zero,
    safe_ratio,
    to_numbers,
)
from ..operators import anti_join_null_safe, distinct_counts

ENET_NUMERIC = ("rev_total", "rev_off", "rev_in", "prints_total", "clicks_total")
DENOM_NUMERIC = ("rev_total", "flag_adx")
ARPU_NUMERIC = ("rev_before", "rev_after_total", "rev_after_oo", "rev_after_in_meli")


def _scalars(one_row: DataFrame):
    """The row of a global aggregate as one struct, a scalar subquery: no
    join, and evaluated once however many of its fields are used (a subquery
    for each column would be pruned to a plan of its own)."""
    return one_row.select(F.struct("*").alias("row")).scalar()


def _endemic(cfg: C.LaunchConfig | None):
    """The sector flag by the run's own sector list."""
    sectors = C.NON_ENDEMIC_VERTICALS if cfg is None else cfg.non_endemic_verticals
    return ~is_non_endemic(F.col("vertical"), sectors)


# --- preparation of each extract -------------------------------------------


def classified_network_items(enet: DataFrame) -> DataFrame:
    """Network items with coerced measures, the strict inventory category
    (rows of unknown inventory kept, with NULL) and its priority."""
    e = to_numbers(enet, ENET_NUMERIC)
    return e.withColumn("inv_setting", inventory_strict(F.col("raw_inventory"))).withColumn(
        "inv_pri", inventory_priority(F.col("inv_setting"))
    )


def network_items(enet: DataFrame) -> DataFrame:
    """Network items of known inventory (unknown ones are reported by the
    quality checks and left out of every KPI)."""
    return classified_network_items(enet).where(F.col("inv_setting").isNotNull())


def population(denom: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    return to_numbers(denom, DENOM_NUMERIC).withColumn("is_endemic", _endemic(cfg))


def adopter_deltas(arpu: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    """Adopters with the sector flag and the delta columns."""
    a = to_numbers(arpu, ARPU_NUMERIC)
    if "has_dot_com" in a.columns:
        a = a.withColumn("has_dot_com", F.col("has_dot_com").cast("boolean"))
    else:
        a = a.withColumn("has_dot_com", F.lit(False))
    before, after = F.col("rev_before"), F.col("rev_after_total")
    return (
        a.withColumn("is_endemic", _endemic(cfg))
        .withColumn("arpu_delta", after - before)
        .withColumn("arpu_delta_pct", safe_ratio(after - before, before, 100))
        # on-site revenue after launch against *total* revenue before it
        .withColumn("in_meli_delta_pct", safe_ratio(F.col("rev_after_in_meli") - before, before, 100))
        .withColumn("oo_incremental_pct", safe_ratio(F.col("rev_after_oo"), after, 100))
    )


# --- network items -----------------------------------------------------------


def kpi_advertiser_summary(enet: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    """Per advertiser: name, vertical, highest inventory category, sums,
    distinct line items, endemic flag.  NULL advertisers are left out."""
    e = network_items(enet).where(F.col("advertiser_id").isNotNull())
    g = e.groupBy("advertiser_id").agg(
        F.min("advertiser_name").alias("advertiser_name"),
        F.min("vertical").alias("vertical"),
        F.max("inv_pri").alias("max_inv_pri"),
        F.sum("rev_total").alias("rev_total"),
        F.sum("rev_off").alias("rev_off"),
        F.sum("rev_in").alias("rev_in"),
        F.sum("prints_total").alias("prints_total"),
        F.sum("clicks_total").alias("clicks_total"),
        F.countDistinct("line_item_id").alias("n_li"),
    )
    return g.withColumn("inv_category", priority_category(F.col("max_inv_pri"))).withColumn(
        "is_endemic", _endemic(cfg)
    )


def kpi_volume_by_inventory(enet: DataFrame) -> DataFrame:
    """Per inventory category: advertisers, line items, revenue, prints, CPM
    and label, highest priority first.  An advertiser may count in several
    categories, so shares need not add up to 100."""
    # both distinct counts and the sums from one read and one shuffle: each row
    # is asked once by its advertiser (with its measures) and once by its line
    # item, and folded by both in every task before rows move
    sums = {"rev": "rev_total", "rev_off": "rev_off", "rev_in": "rev_in", "prints_total": "prints_total"}
    by_adv = F.col("by_adv")
    rows = network_items(enet).withColumn("by_adv", F.explode(F.array(F.lit(True), F.lit(False))))
    per_id = rows.groupBy(
        "inv_setting", "by_adv", F.when(by_adv, F.col("advertiser_id")).alias("adv"), F.when(~by_adv, F.col("line_item_id")).alias("item")
    ).agg(*[F.sum(F.when(by_adv, F.col(c))).alias(n) for n, c in sums.items()])
    g = per_id.groupBy("inv_setting").agg(F.count("adv").alias("n_adv"), F.count("item").alias("n_li"), *[F.sum(n).alias(n) for n in sums])
    return (
        g.withColumn("cpm", safe_ratio(F.col("rev"), F.col("prints_total"), 1000))
        .withColumn("inv_label", inventory_label(F.col("inv_setting")))
        .withColumn("inv_priority", inventory_priority(F.col("inv_setting")))
        # at most three rows (one per category): sorted in one partition,
        # without the sampling job of a global sort
        .coalesce(1)
        .sortWithinPartitions(F.desc("inv_priority"))
    )


# --- population --------------------------------------------------------------


def population_totals(denom: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    """One row: distinct advertisers and revenue of the population, and the
    distinct non-endemic advertisers, also those with off-site delivery.
    Distinct counts are done in two steps (per advertiser, then summed)."""
    d = population(denom, cfg)
    non_end = ~F.col("is_endemic")
    per_adv = d.groupBy("advertiser_id").agg(
        F.sum("rev_total").alias("rev"),
        F.max(non_end).alias("ne"),
        F.max(non_end & (F.col("flag_adx") == 1)).alias("ne_adx"),
    )
    known = F.col("advertiser_id").isNotNull()
    return per_adv.agg(
        F.count_if(known).alias("total_adv"),
        F.coalesce(F.sum("rev"), F.lit(0.0)).alias("total_rev"),
        F.count_if(known & F.col("ne")).alias("non_endemic_adv"),
        F.count_if(known & F.col("ne_adx")).alias("non_endemic_adx_adv"),
    )


def kpi_population_totals(denom: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    return population_totals(denom, cfg)


def kpi_adoption_rates(enet: DataFrame, denom: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    """The three inventory categories in fixed order, each with advertisers
    and revenue (0 when absent) and their share of the population (0 when
    the population is empty).  Shares may exceed 100: the population has a
    narrower target list than the network items.

    All three categories come from one two-step aggregate (per advertiser,
    then global; no ``Expand``, no join); its single row is unfolded into
    the three category rows."""
    e = network_items(enet)
    inv = F.col("inv_setting")
    per_adv = e.groupBy("advertiser_id").agg(
        *[F.max(inv == c).alias(f"in_{i}") for i, c in enumerate(C.INV_ORDER)],
        *[F.sum(F.when(inv == c, F.col("rev_total"))).alias(f"rev_{i}") for i, c in enumerate(C.INV_ORDER)],
    )
    known = F.col("advertiser_id").isNotNull()
    one = per_adv.agg(
        *[F.count_if(known & F.col(f"in_{i}")).alias(f"n_{i}") for i in range(len(C.INV_ORDER))],
        *[F.coalesce(F.sum(f"rev_{i}"), F.lit(0.0)).alias(f"r_{i}") for i in range(len(C.INV_ORDER))],
    )
    rows = one.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("inv_setting"),
                        F.lit(C.INV_LABELS[c]).alias("category"),
                        F.lit(i).alias("ord"),
                        F.col(f"n_{i}").cast("bigint").alias("n_adv"),
                        F.col(f"r_{i}").alias("rev"),
                    )
                    for i, c in enumerate(C.INV_ORDER)
                ]
            )
        ).alias("x")
    ).select("x.*")
    rows = rows.withColumn("pop", _scalars(population_totals(denom, cfg)))
    return (
        rows.select(
            "inv_setting",
            "category",
            "n_adv",
            "rev",
            ratio_or_zero(F.col("n_adv"), F.col("pop.total_adv")).alias("adv_pct"),
            ratio_or_zero(F.col("rev"), F.col("pop.total_rev")).alias("rev_pct"),
            "ord",
        )
        .coalesce(1)
        .sortWithinPartitions("ord")
        .drop("ord")
    )


# --- adopters ----------------------------------------------------------------


def kpi_adopter_deltas(arpu: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    return adopter_deltas(arpu, cfg)


def endemic_adopters(arpu: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    return adopter_deltas(arpu, cfg).where(F.col("is_endemic"))


def non_endemic_adopters(arpu: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    return adopter_deltas(arpu, cfg).where(~F.col("is_endemic"))


def kpi_endemic_arpu(arpu: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    """One row: endemic adopter rows, revenue before / after and the average
    per row (divisor at least 1).  Rows are site x advertiser x strategy."""
    e = endemic_adopters(arpu, cfg)
    g = e.agg(
        F.count(F.lit(1)).alias("n_endemic"),
        F.coalesce(F.sum("rev_before"), F.lit(0.0)).alias("total_before"),
        F.coalesce(F.sum("rev_after_total"), F.lit(0.0)).alias("total_after"),
    )
    n = F.greatest(F.col("n_endemic"), F.lit(1))
    return g.withColumn("arpu_before", F.col("total_before") / n).withColumn("arpu_after", F.col("total_after") / n)


def kpi_endemic_incremental(arpu: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    """Endemic adopters whose revenue grew and that have an external destination."""
    return endemic_adopters(arpu, cfg).where((F.col("rev_after_total") > F.col("rev_before")) & F.col("has_dot_com"))


def kpi_endemic_cannibalised(arpu: DataFrame, cfg: C.LaunchConfig) -> DataFrame:
    """Endemic adopters whose on-site revenue fell below the threshold."""
    d = F.col("in_meli_delta_pct")
    return endemic_adopters(arpu, cfg).where(d.isNotNull() & (d < F.lit(cfg.cannibalisation_pct)))


def kpi_nonendemic_opportunity(arpu: DataFrame, denom: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    """Non-endemic population rows of advertisers that adopted nowhere (the
    adopter set is by advertiser only: all its sites and strategies go)."""
    pop = population(denom, cfg).where(~F.col("is_endemic"))
    return anti_join_null_safe(pop, non_endemic_adopters(arpu, cfg).select("advertiser_id"), "advertiser_id")


def kpi_nonendemic_adoption(arpu: DataFrame, denom: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    """One row: distinct non-endemic adopters against the non-endemic
    population and its off-site part (shares 0 when a base is empty)."""
    ids = non_endemic_adopters(arpu, cfg).groupBy("advertiser_id").agg(F.lit(1).alias("x"))
    # a missing id counts once, as one element of a set
    n = ids.agg(F.count(F.lit(1)).alias("n_adopters"))
    n = n.withColumn("pop", _scalars(population_totals(denom, cfg)))
    base = n.select("n_adopters", "pop.non_endemic_adv", "pop.non_endemic_adx_adv")
    return base.select(
        "*",
        ratio_or_zero(F.col("n_adopters"), F.col("non_endemic_adv")).alias("adoption_pct_display"),
        ratio_or_zero(F.col("n_adopters"), F.col("non_endemic_adx_adv")).alias("adoption_pct_adx"),
    )


# --- first-timers ------------------------------------------------------------


def kpi_first_time_counts(nuevos: DataFrame) -> DataFrame:
    """One row: adopters new to the off-site channel, new to the platform,
    and all adopters (zeros when there are none)."""
    cols = nuevos.columns
    adx = F.col("nuevo_en_adx").cast("boolean") if "nuevo_en_adx" in cols else F.lit(False)
    dsp = F.col("nuevo_en_dsp").cast("boolean") if "nuevo_en_dsp" in cols else F.lit(False)
    return nuevos.agg(
        F.count_if(F.coalesce(adx, F.lit(False))).alias("n_new_adx"),
        F.count_if(F.coalesce(dsp, F.lit(False))).alias("n_new_dsp"),
        F.count(F.lit(1)).alias("n_adopters"),
    )


# --- creative format -----------------------------------------------------------


def kpi_creative_adoption(iab: DataFrame) -> DataFrame:
    """One row: distinct campaigns with network inventory (in+off or off
    only) and with off-only inventory, those of them with the creative
    format, and the two adoption shares (0 when a base is empty)."""
    inv = F.col("inv_setting")
    has = F.coalesce(F.col("has_iab_creative").cast("boolean"), F.lit(False))
    enet = inv.isin(C.IN_PLUS_OFF, C.ONLY_OFF)
    oo = inv == C.ONLY_OFF
    counts = distinct_counts(
        iab,
        "campaign_id",
        {
            "campaigns_enet": enet,
            "campaigns_oo": oo,
            "campaigns_enet_with_format": enet & has,
            "campaigns_oo_with_format": oo & has,
        },
    )
    return counts.select(
        "*",
        ratio_or_zero(F.col("campaigns_enet_with_format"), F.col("campaigns_enet")).alias("adoption_pct_enet"),
        ratio_or_zero(F.col("campaigns_oo_with_format"), F.col("campaigns_oo")).alias("adoption_pct_oo"),
    )
