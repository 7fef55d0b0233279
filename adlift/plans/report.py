"""Report tables, quality checks and the JSON bundle.

Top-N tables use ``orderBy(...).limit(n)``, which Spark plans as
``TakeOrderedAndProject``: every task keeps its own n best rows and only
those are merged, so no full sort or single-task gather of the input
happens.  Tie keys make the choice deterministic.  The bundle is written by
executors (one folder per record set); nothing whole passes through the
driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import config as C
from ..functions import inventory_strict, round_half_even_exact
from ..sources import manifest
from ..sources.cache import read_extracts, write_extracts
from ..sources.registry import Sources
from . import kpis
from .folded import extracts_from, refreshed

ADOPTER_TIES = ("advertiser_id", "site", "strategy")


def _top(df: DataFrame, by: str, n: int, ties=ADOPTER_TIES) -> DataFrame:
    return df.orderBy(F.desc(by), *[F.asc(c) for c in ties]).limit(n)


# --- top-N tables ----------------------------------------------------------------


def top_endemic_adopters(arpu: DataFrame, cfg: C.LaunchConfig, n: int = C.TOP_ENDEMIC) -> DataFrame:
    """Endemic adopters with the highest revenue after launch, raw numbers and
    the two status classes (a missing change counts as 'neg')."""
    d = kpis.endemic_adopters(arpu, cfg)
    pct, can = F.col("arpu_delta_pct"), F.col("in_meli_delta_pct")
    return _top(d, "rev_after_total", n).select(
        "site",
        "advertiser_id",
        "advertiser_name",
        "strategy",
        "has_dot_com",
        "rev_before",
        "rev_after_total",
        "arpu_delta_pct",
        "in_meli_delta_pct",
        "oo_incremental_pct",
        F.when(pct.isNotNull() & (pct > 0), F.lit("pos")).otherwise(F.lit("neg")).alias("delta_class"),
        F.when(can.isNotNull() & (can < F.lit(cfg.cannibalisation_pct)), F.lit("neg"))
        .otherwise(F.lit(""))
        .alias("cannibal_class"),
    )


def top_opportunities(arpu: DataFrame, denom: DataFrame, cfg: C.LaunchConfig | None = None, n: int = C.TOP_OPPORTUNITIES) -> DataFrame:
    """Non-endemic population rows (site x advertiser x strategy) with the
    highest revenue among advertisers that did not adopt."""
    opp = kpis.kpi_nonendemic_opportunity(arpu, denom, cfg)
    return _top(opp, "rev_total", n).select("site", "advertiser_id", "advertiser_name", "vertical", "strategy", "rev_total")


def top_nonendemic_adopters(arpu: DataFrame, cfg: C.LaunchConfig | None = None, n: int = C.TOP_NON_ENDEMIC) -> DataFrame:
    d = kpis.non_endemic_adopters(arpu, cfg)
    return _top(d, "rev_after_total", n).select(
        "site", "advertiser_id", "advertiser_name", "vertical", "strategy", "rev_after_oo", "rev_after_total"
    )


def _first_time(nuevos: DataFrame, flag: str) -> DataFrame:
    return (
        nuevos.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
        .select("advertiser_name", "site", "advertiser_id")
        .orderBy(F.asc_nulls_last("advertiser_name"), "advertiser_id", "site")
    )


def list_first_time_adx(nuevos: DataFrame) -> DataFrame:
    """Adopters new to the off-site channel, by name (missing names last)."""
    return _first_time(nuevos, "nuevo_en_adx")


def list_first_time_dsp(nuevos: DataFrame) -> DataFrame:
    """Adopters new to the platform, by name (missing names last)."""
    return _first_time(nuevos, "nuevo_en_dsp")


# --- display tables ------------------------------------------------------------------


def tbl_volume(enet: DataFrame) -> DataFrame:
    """Volume table rows: label, advertisers, line items, revenue, CPM."""
    return kpis.kpi_volume_by_inventory(enet).select("inv_setting", "inv_label", "n_adv", "n_li", "rev", "cpm")


def tbl_adoption(enet: DataFrame, denom: DataFrame, cfg: C.LaunchConfig | None = None) -> DataFrame:
    """Adoption table rows with shares rounded to one decimal for display,
    half to even on the exact value like Python's ``round``."""
    a = kpis.kpi_adoption_rates(enet, denom, cfg)
    return a.select(
        "category",
        "n_adv",
        round_half_even_exact(F.col("adv_pct"), 1).alias("adv_pct"),
        "rev",
        round_half_even_exact(F.col("rev_pct"), 1).alias("rev_pct"),
    )


# --- quality checks ---------------------------------------------------------------------


def qc_unknown_inventory(enet: DataFrame) -> DataFrame:
    """One row: network items whose inventory is missing or unknown — rows,
    distinct advertisers, revenue."""
    u = kpis.classified_network_items(enet).where(F.col("inv_setting").isNull())
    return u.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("advertiser_id").alias("n_advertisers"),
        F.coalesce(F.sum("rev_total"), F.lit(0.0)).alias("rev_total"),
    )


def qc_unknown_inventory_values(enet: DataFrame) -> DataFrame:
    """Frequency of each raw inventory text among unknown rows, most frequent first."""
    u = enet.where(inventory_strict(F.col("raw_inventory")).isNull())
    return u.groupBy("raw_inventory").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "raw_inventory")


def qc_duplicate_keys(src: Sources) -> DataFrame:
    """Dimension keys that repeat (a join on them multiplies fact rows)."""

    def dups(df: DataFrame, table: str, key: str) -> DataFrame:
        return (
            df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1)
            .select(F.lit(table).alias("table_name"), F.col(key).cast("bigint").alias("key_value"), "n_rows")
        )

    return dups(src.line_item, "line_item", "line_item_id").unionByName(
        dups(src.advertiser, "advertiser", "advertiser_id")
    )


# --- extract registry / records / bundle ---------------------------------------------------


def io_extract_counts(extracts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per extract (one small aggregate per extract, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("extract"), "n_rows") for k, df in extracts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# record sets of the bundle: extract-derived frame and the columns it keeps
RECORD_COLUMNS = {
    "enet": [
        "site", "advertiser_id", "advertiser_name", "vertical", "campaign_id", "line_item_id", "inv_setting",
        "strategy", "rev_total", "rev_off", "rev_in", "prints_total", "prints_off", "prints_in", "clicks_total",
    ],
    "denom": ["site", "advertiser_id", "vertical", "rev_total", "flag_adx", "is_endemic", "strategy"],
    "arpu": [
        "site", "advertiser_id", "advertiser_name", "vertical", "has_dot_com", "strategy", "rev_before",
        "rev_after_total", "rev_after_oo", "rev_after_in_meli", "arpu_delta_pct", "in_meli_delta_pct",
        "oo_incremental_pct",
    ],
    "nuevos": ["site", "advertiser_id", "advertiser_name", "nuevo_en_adx", "nuevo_en_dsp"],
    "iab": ["site", "campaign_id", "line_item_id", "advertiser_id", "inv_setting", "strategy", "has_iab_creative"],
}


def json_records(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One JSON object per row (column ``record``) holding the listed columns
    that exist; NULL fields are kept as ``null``."""
    keep = [c for c in (cols or df.columns) if c in df.columns]
    return df.select(F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}).alias("record"))


def record_frames(extracts: Mapping[str, DataFrame], cfg: C.LaunchConfig | None = None) -> dict[str, DataFrame]:
    """The five record sets of the report, derived from the extracts."""
    return {
        "enet": kpis.network_items(extracts["enet"]),
        "denom": kpis.population(extracts["aw_denom"], cfg),
        "arpu": kpis.adopter_deltas(extracts["arpu"], cfg),
        "nuevos": extracts["nuevos"],
        "iab": extracts["iab"],
    }


def report_bundle(extracts: Mapping[str, DataFrame], cfg: C.LaunchConfig) -> DataFrame:
    """``(record_set, record)`` rows: every record of the five sets as JSON,
    plus one ``config`` record (dates, thresholds, sorted sector list, site
    labels)."""
    frames = record_frames(extracts, cfg)
    parts = [
        json_records(frames[k], RECORD_COLUMNS[k]).select(F.lit(k).alias("record_set"), "record") for k in RECORD_COLUMNS
    ]
    spark = frames["enet"].sparkSession
    config = spark.createDataFrame([("config", json.dumps(cfg.as_record(), ensure_ascii=False))], "record_set string, record string")
    out = parts[0]
    for p in parts[1:] + [config]:
        out = out.unionByName(p)
    return out


CONFIG_FIELDS = (
    "oo_start string, analysis_end string, before_start string, before_end string, days_after bigint, "
    "adx_min_usd double, history_start string, non_endemic array<string>, sites_lbl map<string,string>"
)


def parsed_records(records: DataFrame, frame: DataFrame, cols: list[str]) -> DataFrame:
    """JSON records read back into the typed columns they were made of."""
    shape = frame.select([c for c in cols if c in frame.columns]).schema
    return records.select(F.from_json("record", shape).alias("r")).select("r.*")


def parsed_bundle(extracts: Mapping[str, DataFrame], cfg: C.LaunchConfig) -> DataFrame:
    """The bundle read back: a row per record, with the fields of every
    record set (NULL where a set lacks one); lists of the config as text."""
    bundle, frames = report_bundle(extracts, cfg), record_frames(extracts, cfg)
    of = lambda k: bundle.where(F.col("record_set") == k)
    parts = [parsed_records(of(k), frames[k], c).withColumn("record_set", F.lit(k)) for k, c in RECORD_COLUMNS.items()]
    config = of("config").select("record_set", F.from_json("record", CONFIG_FIELDS).alias("r")).select("record_set", "r.*")
    labels = F.transform(F.map_entries("sites_lbl"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    out = config.withColumns({"non_endemic": F.array_join("non_endemic", ","), "sites_lbl": F.array_join(labels, ",")})
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_report_bundle(bundle: DataFrame, out_dir: str) -> None:
    """JSON-lines text, one folder per record set (``record_set=<name>``)."""
    bundle.write.mode("overwrite").partitionBy("record_set").text(out_dir)


def run_report(
    src: Sources | None,
    cfg: C.LaunchConfig,
    out_dir: str,
    cache_format: str = "parquet",
    replay_from: str | None = None,
    fold_root: str | None = None,
    late_days: int = 0,
    restate: Iterable[date] = (),
) -> dict:
    """The whole job: daily fold -> extracts -> cache (cuts lineage: KPIs
    re-read small files, a lost executor never re-runs a fact scan) -> KPI
    tables and the bundle, written under ``out_dir``.

    The fact is scanned once, for the days that the fold store under
    ``fold_root`` (``out_dir/fold`` if none is given) lacks, its last
    ``late_days`` days and the days ``restate``; a store kept between runs makes
    the daily job read new days only.  The extracts derive from the fold.

    ``replay_from`` names a folder of cached extracts to use instead of the
    sources.  It stops, naming every missing extract, when one is absent, and
    refuses (``ReplayRefused``) a cache that is half written, of other dates
    or thresholds, or changed.  Returns ``{"paths": {name: path}, "rows":
    {extract: row count}, "folded": [days]}``; live counts are observed while
    the cache is written (no extra job), replayed ones come from the manifest.
    """
    root = out_dir.rstrip("/")
    folded: list[date] = []
    if replay_from:
        if src is not None:
            spark = src.daily_metrics.sparkSession
        else:
            from pyspark.sql import SparkSession

            spark = SparkSession.getActiveSession()
        cache = replay_from
        ext = read_extracts(spark, cache, fmt=cache_format)
        rows = manifest.check(spark, cache, cache_format, cfg, ext)
    else:
        if src is None:
            raise ValueError("sources are needed unless replaying cached extracts")
        spark = src.daily_metrics.sparkSession
        cache = f"{root}/extracts"
        fold, folded = refreshed(src, cfg, fold_root or f"{root}/fold", late_days, restate)
        observed, frames = {}, {}
        for name, df in extracts_from(fold, src, cfg).items():
            observed[name] = Observation(f"rows_{name}")
            frames[name] = df.observe(observed[name], F.count(F.lit(1)).alias("rows"))
        manifest.begin(spark, cache, cache_format, cfg)
        write_extracts(frames, cache, fmt=cache_format)
        rows = {name: int(o.get["rows"]) for name, o in observed.items()}
        ext = read_extracts(spark, cache, fmt=cache_format)
        manifest.publish(spark, cache, cache_format, cfg, {n: v.schema.simpleString() for n, v in ext.items()}, rows)
    # each cached extract feeds several tables: keep it once in executor
    # memory (spilling to disk); a lost block is re-read from the cache files
    ext = {k: v.persist(StorageLevel.MEMORY_AND_DISK) for k, v in ext.items()}
    tables = {
        "kpi_advertiser_summary": kpis.kpi_advertiser_summary(ext["enet"], cfg),
        "kpi_volume_by_inventory": kpis.kpi_volume_by_inventory(ext["enet"]),
        "kpi_population_totals": kpis.kpi_population_totals(ext["aw_denom"], cfg),
        "kpi_adoption_rates": kpis.kpi_adoption_rates(ext["enet"], ext["aw_denom"], cfg),
        "kpi_endemic_arpu": kpis.kpi_endemic_arpu(ext["arpu"], cfg),
        "kpi_endemic_incremental": kpis.kpi_endemic_incremental(ext["arpu"], cfg),
        "kpi_endemic_cannibalised": kpis.kpi_endemic_cannibalised(ext["arpu"], cfg),
        "kpi_nonendemic_opportunity": kpis.kpi_nonendemic_opportunity(ext["arpu"], ext["aw_denom"], cfg),
        "kpi_nonendemic_adoption": kpis.kpi_nonendemic_adoption(ext["arpu"], ext["aw_denom"], cfg),
        "kpi_first_time_counts": kpis.kpi_first_time_counts(ext["nuevos"]),
        "kpi_creative_adoption": kpis.kpi_creative_adoption(ext["iab"]),
        "top_endemic_adopters": top_endemic_adopters(ext["arpu"], cfg),
        "top_opportunities": top_opportunities(ext["arpu"], ext["aw_denom"], cfg),
        "top_nonendemic_adopters": top_nonendemic_adopters(ext["arpu"], cfg),
        "list_first_time_adx": list_first_time_adx(ext["nuevos"]),
        "list_first_time_dsp": list_first_time_dsp(ext["nuevos"]),
        "tbl_volume": tbl_volume(ext["enet"]),
        "tbl_adoption": tbl_adoption(ext["enet"], ext["aw_denom"], cfg),
        "qc_unknown_inventory": qc_unknown_inventory(ext["enet"]),
        "qc_unknown_inventory_values": qc_unknown_inventory_values(ext["enet"]),
    }
    if src is not None:
        tables["qc_duplicate_keys"] = qc_duplicate_keys(src)
    paths = {"extracts": cache}
    try:
        for name, df in tables.items():
            p = f"{root}/tables/{name}"
            df.write.mode("overwrite").option("ignoreNullFields", False).json(p)
            paths[name] = p
        paths["bundle"] = f"{root}/bundle"
        write_report_bundle(report_bundle(ext, cfg), paths["bundle"])
    finally:
        for v in ext.values():
            v.unpersist()
    return {"paths": paths, "rows": rows, "folded": [d.isoformat() for d in folded]}
