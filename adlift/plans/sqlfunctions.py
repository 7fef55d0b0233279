"""The five extracts as SQL table functions.

``register`` puts the sources into a session as temporary views and defines a
temporary table function for each extract, so that an analyst asks in SQL::

    register(spark, src)
    spark.sql("SELECT * FROM adlift_network_items(:launch, :until) WHERE rev_off > 0",
              args={"launch": date(2026, 3, 18), "until": date(2026, 4, 30)})

Dates, thresholds and lists are named parameter markers, never text put into
a query; Spark inlines the function's body, so a window still prunes days and reaches the
Parquet reader, and a filter on the result moves into it.  Results equal those
of ``plans.extracts``; rows are folded before they meet a dimension there and
here, and NULL line items are spread by a salt in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators.joins import null_spread
from ..sources.registry import Sources

PREFIX = "adlift"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _strategy(rules: C.StrategyRules) -> str:
    key = "upper(target)" if rules.upper else "target"
    cases = " ".join(f"WHEN {key} IN {_list(values)} THEN {_text(label)}" for label, values in rules.groups)
    return f"CASE {cases} ELSE {'target' if rules.default is None else _text(rules.default)} END"


#: strategy functions of one target, by extract
STRATEGIES = {
    "strategy_network": C.STRATEGY_NETWORK,
    "strategy_population": C.STRATEGY_POPULATION,
    "strategy_adopters": C.STRATEGY_ADOPTERS,
    "strategy_creative": C.STRATEGY_CREATIVE,
}

_DISPLAY = (
    f"campaign_type = {_text(C.SCOPE_CAMPAIGN_TYPE)} AND product_type = {_text(C.SCOPE_PRODUCT_TYPE)} "
    f"AND upper(line_item_type) NOT IN {_list(C.SCOPE_EXCLUDED_LINE_TYPES)}"
)
_OFF_PAGE, _ON_PAGE = f"page_name = {_text(C.OFFSITE_PAGE)}", f"page_name <> {_text(C.OFFSITE_PAGE)}"
_AFTER = "event_local_dt BETWEEN launch AND until"
_OFF_ITEMS = f"SELECT line_item_id FROM {{p}}_line_item WHERE upper(inventory) = {_text(C.INVENTORY_OFF)} AND line_item_id IS NOT NULL"


def _salted(alias: str, *columns: str) -> str:
    """The join key of rows whose line item may be NULL."""
    basis = ", ".join(f"{alias}.{c}" for c in columns)
    salt = f"CAST(if({alias}.line_item_id IS NULL, 1 + pmod(xxhash64({basis}), {{spread}}), 0) AS INT)"
    return f"named_struct('key', {alias}.line_item_id, 'salt', {salt}) AS item_key"


_ITEM_KEY = "named_struct('key', line_item_id, 'salt', CAST(0 AS INT)) AS item_key"

#: name -> (parameters, body); ``{p}`` stands for the prefix of views and functions,
#: ``{spread}`` for the salts of rows without a line item
FUNCTIONS = {
    "network_items": (
        "launch DATE, until DATE",
        f"""WITH sums AS (
  SELECT site, advertiser_id, advertiser_name, vertical, campaign_id, line_item_id, {{p}}_strategy_network(campaign_target) AS strategy,
         sum(cost_usd) AS rev_total, sum(CASE WHEN {_OFF_PAGE} THEN cost_usd ELSE 0 END) AS rev_off,
         sum(CASE WHEN {_ON_PAGE} THEN cost_usd ELSE 0 END) AS rev_in, sum(prints_qty) AS prints_total,
         sum(CASE WHEN {_OFF_PAGE} THEN prints_qty ELSE 0 END) AS prints_off,
         sum(CASE WHEN {_ON_PAGE} THEN prints_qty ELSE 0 END) AS prints_in, sum(clicks_qty) AS clicks_total
  FROM {{p}}_daily_metrics
  WHERE {_AFTER} AND {_DISPLAY} AND campaign_target IN {_list(C.TARGETS_NETWORK)} AND cost_usd > 0
  GROUP BY site, advertiser_id, advertiser_name, vertical, campaign_id, line_item_id, {{p}}_strategy_network(campaign_target)
),
inventory AS (
  SELECT {_ITEM_KEY}, coalesce(inventory, '') AS raw_inventory, count(*) AS n_rows
  FROM {{p}}_line_item WHERE line_item_id IS NOT NULL GROUP BY line_item_id, coalesce(inventory, '')
)
SELECT site, advertiser_id, advertiser_name, vertical, campaign_id, line_item_id, coalesce(raw_inventory, '') AS raw_inventory, strategy,
       rev_total * coalesce(n_rows, 1) AS rev_total, rev_off * coalesce(n_rows, 1) AS rev_off, rev_in * coalesce(n_rows, 1) AS rev_in,
       prints_total * coalesce(n_rows, 1) AS prints_total, prints_off * coalesce(n_rows, 1) AS prints_off,
       prints_in * coalesce(n_rows, 1) AS prints_in, clicks_total * coalesce(n_rows, 1) AS clicks_total
FROM (SELECT *, {_salted("s", "site", "advertiser_id", "campaign_id", "strategy")} FROM sums s) LEFT JOIN inventory USING (item_key)""",
    ),
    "display_population": (
        "launch DATE, until DATE",
        f"""SELECT site, advertiser_id, min(advertiser_name) AS advertiser_name, min(vertical) AS vertical, sum(rev) AS rev_total,
       max(flag) AS flag_adx, strategy
FROM (SELECT site, advertiser_id, {{p}}_strategy_population(campaign_target) AS strategy, advertiser_name, vertical,
             sum(cost_usd) AS rev, max(CASE WHEN {_OFF_PAGE} THEN 1 ELSE 0 END) AS flag
      FROM {{p}}_daily_metrics
      WHERE {_AFTER} AND {_DISPLAY} AND campaign_target IN {_list(C.TARGETS_POPULATION)} AND cost_usd > 0
      GROUP BY site, advertiser_id, {{p}}_strategy_population(campaign_target), advertiser_name, vertical)
GROUP BY site, advertiser_id, strategy""",
    ),
    "adopters": (
        "launch DATE, until DATE, before_start DATE, before_end DATE",
        f"""WITH off_ids AS ({_OFF_ITEMS}),
outside AS (
  SELECT c.creative_id FROM {{p}}_creative_history c LEFT SEMI JOIN {{p}}_destination d
  ON d.destination_id = c.creative_destination_id AND upper(d.destination_subtype) IN {_list(C.EXTERNAL_DESTINATION_SUBTYPES)}
),
marks AS (
  SELECT line_item_id, 1 AS oo, 0 AS ext FROM off_ids
  UNION ALL
  SELECT r.line_item_id, 0 AS oo, 1 AS ext FROM {{p}}_line_item_creative_rel r
  LEFT SEMI JOIN off_ids o ON o.line_item_id = r.line_item_id
  LEFT SEMI JOIN {{p}}_line_item_master m ON m.line_item_id = r.line_item_id
  LEFT SEMI JOIN outside c ON c.creative_id = r.creative_id
),
items AS (SELECT {_ITEM_KEY}, max(ext) AS has_ext FROM marks GROUP BY line_item_id HAVING max(oo) = 1),
delivery AS (
  SELECT *, {_AFTER} AS is_after, event_local_dt BETWEEN before_start AND before_end AS is_before
  FROM {{p}}_daily_metrics
  WHERE event_local_dt BETWEEN least(before_start, launch) AND greatest(until, before_end) AND {_DISPLAY}
),
sums AS (
  SELECT site, advertiser_id, {{p}}_strategy_adopters(campaign_target) AS strategy,
         CASE WHEN is_after THEN line_item_id END AS line_item_id,
         CASE WHEN is_after AND cost_usd > 0 THEN advertiser_name END AS advertiser_name,
         CASE WHEN is_after AND cost_usd > 0 THEN vertical END AS vertical,
         sum(CASE WHEN is_before THEN cost_usd END) AS b, sum(CASE WHEN is_after THEN cost_usd END) AS a,
         sum(CASE WHEN is_after AND {_ON_PAGE} THEN cost_usd END) AS a_in,
         max(CASE WHEN is_after AND cost_usd > 0 THEN 1 ELSE 0 END) AS q
  FROM delivery GROUP BY 1, 2, 3, 4, 5, 6
),
per_group AS (
  SELECT site, advertiser_id, strategy, max(has_ext IS NOT NULL AND q = 1) AS adopter,
         min(CASE WHEN has_ext IS NOT NULL AND q = 1 THEN advertiser_name END) AS advertiser_name,
         min(CASE WHEN has_ext IS NOT NULL AND q = 1 THEN vertical END) AS vertical,
         max(CASE WHEN has_ext IS NOT NULL AND q = 1 THEN has_ext END) AS has_dot_com,
         sum(b) AS rev_before, sum(a) AS rev_after_total, sum(CASE WHEN has_ext IS NOT NULL THEN a END) AS rev_after_oo,
         sum(a_in) AS rev_after_in_meli, site IS NOT NULL AND advertiser_id IS NOT NULL AS known
  FROM (SELECT *, {_salted("s", "site", "advertiser_id", "strategy", "advertiser_name")} FROM sums s) LEFT JOIN items USING (item_key)
  GROUP BY site, advertiser_id, strategy
)
SELECT site, advertiser_id, advertiser_name, vertical, coalesce(has_dot_com, 0) AS has_dot_com, strategy,
       CASE WHEN known THEN coalesce(rev_before, 0D) ELSE 0D END AS rev_before,
       CASE WHEN known THEN coalesce(rev_after_total, 0D) ELSE 0D END AS rev_after_total,
       CASE WHEN known THEN coalesce(rev_after_oo, 0D) ELSE 0D END AS rev_after_oo,
       CASE WHEN known THEN coalesce(rev_after_in_meli, 0D) ELSE 0D END AS rev_after_in_meli
FROM per_group WHERE adopter""",
    ),
    "first_time": (
        "launch DATE, until DATE, history_start DATE, history_end DATE, min_spend DOUBLE",
        f"""WITH items AS (SELECT DISTINCT {_ITEM_KEY}, true AS is_oo FROM ({_OFF_ITEMS})),
delivery AS (
  SELECT *, {_AFTER} AS is_after, event_local_dt BETWEEN history_start AND history_end AS is_history
  FROM {{p}}_daily_metrics
  WHERE event_local_dt BETWEEN least(history_start, launch) AND greatest(until, history_end) AND cost_usd > 0
),
sums AS (
  SELECT site, advertiser_id, CASE WHEN is_after THEN line_item_id END AS line_item_id,
         sum(CASE WHEN is_after THEN cost_usd END) AS a, max(CASE WHEN is_history THEN 1 ELSE 0 END) AS h_dsp,
         max(CASE WHEN is_history AND {_OFF_PAGE} THEN 1 ELSE 0 END) AS h_adx
  FROM delivery GROUP BY 1, 2, 3
),
buyers AS (
  SELECT site, advertiser_id, sum(CASE WHEN is_oo THEN a END) AS spend, max(h_dsp) AS h_dsp, max(h_adx) AS h_adx
  FROM (SELECT *, {_salted("s", "site", "advertiser_id")} FROM sums s) LEFT JOIN items USING (item_key)
  GROUP BY site, advertiser_id
)
SELECT b.site, b.advertiser_id, n.advertiser_name,
       NOT (b.site IS NOT NULL AND b.advertiser_id IS NOT NULL AND h_adx = 1) AS nuevo_en_adx,
       NOT (b.site IS NOT NULL AND b.advertiser_id IS NOT NULL AND h_dsp = 1) AS nuevo_en_dsp
FROM buyers b LEFT JOIN {{p}}_advertiser n ON n.advertiser_id = b.advertiser_id
WHERE b.spend >= min_spend""",
    ),
    "creative_adoption": (
        "launch DATE, until DATE, format STRING, excluded ARRAY<BIGINT>",
        f"""WITH active AS (
  SELECT DISTINCT site, campaign_id, line_item_id, advertiser_id, {{p}}_strategy_creative(campaign_target) AS strategy
  FROM {{p}}_daily_metrics
  WHERE {_AFTER} AND {_DISPLAY} AND campaign_target IN {_list(C.TARGETS_CREATIVE)} AND cost_usd > 0
),
settings AS (
  SELECT DISTINCT {_ITEM_KEY}, CASE WHEN upper(inventory) = {_text(C.INVENTORY_OFF)} THEN {_text(C.ONLY_OFF)}
         WHEN upper(inventory) = {_text(C.INVENTORY_IN_PLUS_OFF)} THEN {_text(C.IN_PLUS_OFF)} ELSE {_text(C.ONLY_IN)} END AS inv_setting
  FROM {{p}}_line_item WHERE line_item_id IS NOT NULL
),
creatives AS (
  SELECT creative_id FROM {{p}}_creative
  WHERE NOT array_contains(excluded, advertiser_id) AND array_contains(transform(
    try_variant_get(try_parse_json(CASE WHEN left(ltrim(images), 1) = '"' THEN get_json_object(images, '$') END), '$', 'array<variant>'),
    v -> try_variant_get(v, '$.type', 'string')), format)
),
marked AS (
  SELECT DISTINCT named_struct('key', CAST(l.line_item_id AS BIGINT), 'salt', CAST(0 AS INT)) AS item_key, true AS hit
  FROM {{p}}_line_item_creative l LEFT SEMI JOIN creatives c ON c.creative_id = l.creative_id WHERE l.line_item_id IS NOT NULL
)
SELECT site, campaign_id, line_item_id, advertiser_id, coalesce(inv_setting, {_text(C.ONLY_IN)}) AS inv_setting, strategy,
       hit IS NOT NULL AS has_iab_creative
FROM (SELECT *, {_salted("s", "site", "campaign_id", "advertiser_id", "strategy")} FROM active s)
LEFT JOIN settings USING (item_key) LEFT JOIN marked USING (item_key)""",
    ),
}

#: extract name -> function
FUNCTION_OF = {
    "enet": "network_items",
    "aw_denom": "display_population",
    "arpu": "adopters",
    "nuevos": "first_time",
    "iab": "creative_adoption",
}


def register(spark: SparkSession, src: Sources, prefix: str = PREFIX) -> list[str]:
    """Define the views and functions of ``src`` in a session, under names that
    begin with ``prefix``; returns the names of the table functions."""
    if not prefix.isidentifier():
        raise ValueError(f"a prefix is letters, digits and underscores, not {prefix!r}")
    for name in Sources.names():
        getattr(src, name).createOrReplaceTempView(f"{prefix}_{name}")
    for name, rules in STRATEGIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}(target STRING) RETURNS STRING RETURN {_strategy(rules)}")
    for name, (parameters, body) in FUNCTIONS.items():
        # a body is text of this module; only the checked prefix and a number are put in
        text = body.replace("{p}", prefix).replace("{spread}", str(null_spread(spark)))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}({parameters}) RETURNS TABLE RETURN {text}")
    return [f"{prefix}_{name}" for name in FUNCTIONS]


def arguments(cfg: C.LaunchConfig) -> dict:
    """A run's settings by the functions' parameter names."""
    return {
        "launch": cfg.launch_date,
        "until": cfg.analysis_end,
        "before_start": cfg.before_start,
        "before_end": cfg.before_end,
        "history_start": cfg.history_start,
        "history_end": cfg.history_end,
        "min_spend": float(cfg.min_spend),
        "format": cfg.creative_format,
        "excluded": list(cfg.excluded_creative_advertisers),
    }


def call(spark: SparkSession, extract: str, cfg: C.LaunchConfig, prefix: str = PREFIX) -> DataFrame:
    """An extract from its registered function."""
    name = FUNCTION_OF[extract]
    wanted = [p.split()[0] for p in FUNCTIONS[name][0].split(", ")]
    markers = ", ".join(f":{p}" for p in wanted)
    every = arguments(cfg)
    return spark.sql(f"SELECT * FROM {prefix}_{name}({markers})", args={p: every[p] for p in wanted})
