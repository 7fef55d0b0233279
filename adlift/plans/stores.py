"""Queries over stored forms: daily fold, manifest, rejects, id sets, buckets.

Each one writes its store from the sources into a fresh folder (or table) and
answers from the store.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import in_window, inventory_multiplicity, positive_cost
from ..operators.idsets import compared, id_codes, id_sets, merged, sizes, with_code
from ..session import scratch_path
from ..sources import manifest
from ..sources.bucketed import bucketed_left_join, write_bucketed
from ..sources.cache import CSV_OPTIONS, read_extracts, rejected_records, write_extracts
from ..sources.fold import FoldStore
from ..sources.format_index import FormatIndex
from ..sources.registry import Sources
from . import extracts as X
from . import folded, kpis, sqlfunctions
from .prefiltered import prefiltered_adopters, prefiltered_first_time


def two_step_fold(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """The fold as a daily job keeps it: history first, then the days from
    launch on with the last days of history folded again."""
    spark = src.daily_metrics.sparkSession
    store = FoldStore(spark, scratch_path(spark, "fold-store"))
    start, end = folded.fold_range(cfg)
    store.refresh(src, start, cfg.history_end)
    store.refresh(src, start, end, restate=[cfg.history_end - timedelta(days=i) for i in range(3)])
    return store.read(start, end)


def cache_manifest(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """The manifest of a cache just written: rows, settings, columns and
    whether files are recorded, per extract."""
    spark = src.daily_metrics.sparkSession
    root = scratch_path(spark, "manifest-cache")
    live = X.all_extracts(src, cfg)
    manifest.begin(spark, root, "parquet", cfg)
    write_extracts(live, root)
    back = read_extracts(spark, root)
    # Parquet counts come from the files' footers
    rows = {n: df.count() for n, df in back.items()}
    manifest.publish(spark, root, "parquet", cfg, {n: df.schema.simpleString() for n, df in back.items()}, rows)
    checked = manifest.check(spark, root, "parquet", cfg, back)
    table = manifest.manifest_table(spark, root).where(F.col("extract").isin(*checked))
    return table.select("extract", "format", "finished", "config_hash", "n_rows", (F.col("n_files") > 0).alias("has_files"))


def csv_rejects(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Spend per site and advertiser, as text in which every seventh advertiser
    is written ``12x`` and every eleventh site's spend ``n/a``, read back by type:
    per site the good rows, their spend, and the rejected records."""
    spark = src.daily_metrics.sparkSession
    spend = src.daily_metrics.where(X._after(cfg)).groupBy("site", "advertiser_id").agg(F.sum("cost_usd").cast("bigint").alias("spend"))
    text = spend.select(
        F.col("site").cast("string").alias("site"),
        F.concat(F.col("advertiser_id").cast("string"), F.when(F.col("advertiser_id") % 7 == 0, F.lit("x")).otherwise(F.lit(""))).alias("advertiser_id"),
        F.when(F.col("site") % 11 == 0, F.lit("n/a")).otherwise(F.col("spend").cast("string")).alias("spend"),
    )
    root = scratch_path(spark, "reject-cache")
    text.write.options(**CSV_OPTIONS).csv(f"{root}/spend")
    schemas = {"spend": spark.createDataFrame([], "site string, advertiser_id bigint, spend bigint").schema}
    good = read_extracts(spark, root, "csv", schemas, ("spend",), on_reject="drop")["spend"]
    bad = rejected_records(spark, root, "csv", schemas, ("spend",)).select(F.substring_index("record", ",", 1).alias("site"))
    per = good.groupBy("site").agg(F.count(F.lit(1)).alias("n_good"), F.sum("spend").alias("spend")).withColumn("n_rejected", F.lit(0).cast("bigint"))
    per = per.unionByName(bad.groupBy("site").agg(F.count(F.lit(1)).alias("n_rejected")), allowMissingColumns=True)
    return per.groupBy("site").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_good", "spend", "n_rejected")])


def inventory_sets(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Per inventory category: distinct advertisers and line items, and the
    advertisers that are in no other category, from one pass over the items."""
    spark = src.daily_metrics.sparkSession
    root = scratch_path(spark, "id-codes")
    X.ext_network_items(src, cfg).write.parquet(f"{root}/items")
    items = kpis.network_items(spark.read.parquet(f"{root}/items")).select("inv_setting", "advertiser_id", "line_item_id")
    adv = id_codes(items.select("advertiser_id"), f"{root}/advertisers")
    item = id_codes(items.select("line_item_id"), f"{root}/line_items")
    coded = with_code(with_code(items, adv, "advertiser_id", "adv"), item, "line_item_id", "item")
    two = F.array(F.struct(F.lit("adv").alias("kind"), F.col("adv").alias("code")), F.struct(F.lit("item").alias("kind"), F.col("item").alias("code")))
    rows = coded.select("inv_setting", F.inline(two))
    id_sets(rows, ["kind", "inv_setting"]).write.parquet(f"{root}/sets")
    sets = spark.read.parquet(f"{root}/sets")
    n = sizes(sets, ["kind", "inv_setting"])
    wide = n.groupBy("inv_setting").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("bigint").alias(c) for k, c in (("adv", "n_adv"), ("item", "n_li"))])
    own = None
    for c in C.INV_ORDER:
        one = compared(sets.where(F.col("kind") == "adv").withColumn("all", F.lit(c)), ["all"], F.col("inv_setting") == c, F.col("inv_setting") != c)
        one = one.select(F.col("all").alias("inv_setting"), F.col("n_only_left").alias("n_adv_only"))
        own = one if own is None else own.unionByName(one)
    return wide.join(own, "inv_setting", "left").select("inv_setting", "n_adv", "n_li", F.coalesce("n_adv_only", F.lit(0)).cast("bigint").alias("n_adv_only"))


def window_sets(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Per site the advertisers with spend after launch, in the history, in
    both and in one only, from daily sets that are merged over the windows."""
    spark = src.daily_metrics.sparkSession
    root = scratch_path(spark, "daily-sets")
    start, end = folded.fold_range(cfg)
    rows = src.daily_metrics.where(in_window(start, end) & positive_cost()).select("event_local_dt", "site", "advertiser_id")
    codes = id_codes(rows.select("advertiser_id"), f"{root}/codes")
    # the fact is reduced before codes are joined: a row for each day, site and id
    daily = id_sets(with_code(rows.distinct(), codes, "advertiser_id", "code"), ["event_local_dt", "site"])
    daily.write.parquet(f"{root}/sets")
    after, before = in_window(cfg.launch_date, cfg.analysis_end), in_window(cfg.history_start, cfg.history_end)
    sets = spark.read.parquet(f"{root}/sets").withColumn("window", F.when(after, F.lit("after")).when(before, F.lit("history")))
    months = merged(sets.where("window is not null"), ["window", "site"])
    out = compared(months, ["site"], F.col("window") == "after", F.col("window") == "history")
    names = {"n_left": "n_after", "n_right": "n_history", "n_both": "n_both", "n_only_left": "n_new", "n_only_right": "n_gone"}
    return out.select("site", *[F.col(a).alias(b) for a, b in names.items()])


def bucketed_network_items(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Network items from per-item sums and inventory texts stored in the same
    buckets: the join needs no exchange."""
    spark = src.daily_metrics.sparkSession
    tag = uuid.uuid4().hex[:12]
    left, right = f"adlift_items_{tag}", f"adlift_inventory_{tag}"
    write_bucketed(X.network_sums(src, cfg), left, "line_item_id")
    write_bucketed(inventory_multiplicity(src.line_item), right, "line_item_id")
    return X.network_columns(bucketed_left_join(spark, left, right, "line_item_id"))


def _format_index(src: Sources) -> FormatIndex:
    spark = src.creative.sparkSession
    return FormatIndex(spark, scratch_path(spark, "format-index")).write(src)


def indexed_creative_adoption(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Creative adoption with the format's line items taken from the index."""
    items = _format_index(src).items(cfg.creative_format, cfg.excluded_creative_advertisers)
    return X.creative_adoption_of(X.creative_active(src, cfg), src, cfg, items)


def format_counts(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Creatives and line items of every format, from the index."""
    return _format_index(src).formats()


def format_forms(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
    """Creatives by what their images hold, malformed ones included."""
    return _format_index(src).forms()


def sql_extract(name: str):
    """An extract by its SQL table function, named parameters bound."""

    def run(src: Sources, cfg: C.LaunchConfig) -> DataFrame:
        spark = src.daily_metrics.sparkSession
        sqlfunctions.register(spark, src)
        return sqlfunctions.call(spark, name, cfg)

    return run


_SHARED: dict[tuple[str, str], DataFrame] = {}


def folded_extract(name: str):
    """An extract from a fold store that the queries of one session share."""

    def run(spark, sf: str, sources, cfg: C.LaunchConfig) -> DataFrame:
        src = sources(spark, sf)
        key = (spark.sparkContext.applicationId, sf)
        if key not in _SHARED:
            _SHARED[key] = two_step_fold(src, cfg)
        return folded.FOLDED[name](_SHARED[key], src, cfg)

    return run


STORES = {
    "io_cache_manifest": cache_manifest,
    "io_csv_rejects": csv_rejects,
    "set_inventory_counts": inventory_sets,
    "set_window_advertisers": window_sets,
    "bucketed_network_items": bucketed_network_items,
    "prefiltered_adopters": prefiltered_adopters,
    "prefiltered_first_time": prefiltered_first_time,
    "index_creative_adoption": indexed_creative_adoption,
    "index_format_counts": format_counts,
    "index_image_forms": format_forms,
    **{f"sql_{function}": sql_extract(name) for name, function in sqlfunctions.FUNCTION_OF.items()},
}

FOLD_KEYS = {
    "fold_network_items": "enet",
    "fold_display_population": "aw_denom",
    "fold_adopters": "arpu",
    "fold_first_time": "nuevos",
    "fold_creative_adoption": "iab",
}
