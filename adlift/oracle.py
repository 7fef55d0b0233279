"""DuckDB reference SQL for the registered queries (the correctness gate).

Each text starts with the fixture CTEs (DuckDB sees only the base tables)
and then states the query directly from its definition — predicates,
``IN`` / ``EXISTS`` membership, correlated sums — independently of how the
Spark side plans it, so equal results check both the semantics and the
Spark rewrites.  Sums are cast (DuckDB widens integer sums).
"""

from __future__ import annotations

from . import config as C
from .sources.fixtures import oracle

CFG = C.FIXTURE_CONFIG


def _d(x) -> str:
    return f"DATE '{x.isoformat()}'"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _strategy(col: str, rules: C.StrategyRules) -> str:
    key = f"UPPER({col})" if rules.upper else col
    arms = " ".join(f"WHEN {key} IN {_in(vals)} THEN '{label}'" for label, vals in rules.groups)
    other = col if rules.default is None else f"'{rules.default}'"
    return f"CASE {arms} ELSE {other} END"


AFTER = f"md.event_local_dt BETWEEN {_d(CFG.launch_date)} AND {_d(CFG.analysis_end)}"
BEFORE = f"md.event_local_dt BETWEEN {_d(CFG.before_start)} AND {_d(CFG.before_end)}"
HISTORY = f"md.event_local_dt BETWEEN {_d(CFG.history_start)} AND {_d(CFG.history_end)}"
SCOPE = (
    f"md.campaign_type = '{C.SCOPE_CAMPAIGN_TYPE}' AND md.product_type = '{C.SCOPE_PRODUCT_TYPE}' "
    f"AND UPPER(md.line_item_type) NOT IN {_in(C.SCOPE_EXCLUDED_LINE_TYPES)}"
)
OFF = f"md.page_name = '{C.OFFSITE_PAGE}'"
ON = f"md.page_name != '{C.OFFSITE_PAGE}'"
OO_IDS = "SELECT line_item_id FROM line_item WHERE UPPER(inventory) = 'OFF'"
S1 = _strategy("md.campaign_target", C.STRATEGY_NETWORK)
S2 = _strategy("md.campaign_target", C.STRATEGY_POPULATION)
S3 = _strategy("md.campaign_target", C.STRATEGY_ADOPTERS)
S5 = _strategy("md.campaign_target", C.STRATEGY_CREATIVE)

# --- extracts (plain shape) --------------------------------------------------

ENET = f"""enet AS (
  SELECT md.site, md.advertiser_id, md.advertiser_name, md.vertical, md.campaign_id, md.line_item_id,
         COALESCE(li.inventory, '') AS raw_inventory,
         {S1} AS strategy,
         CAST(SUM(md.cost_usd) AS DOUBLE) AS rev_total,
         CAST(SUM(CASE WHEN {OFF} THEN md.cost_usd ELSE 0 END) AS DOUBLE) AS rev_off,
         CAST(SUM(CASE WHEN {ON} THEN md.cost_usd ELSE 0 END) AS DOUBLE) AS rev_in,
         CAST(SUM(md.prints_qty) AS BIGINT) AS prints_total,
         CAST(SUM(CASE WHEN {OFF} THEN md.prints_qty ELSE 0 END) AS BIGINT) AS prints_off,
         CAST(SUM(CASE WHEN {ON} THEN md.prints_qty ELSE 0 END) AS BIGINT) AS prints_in,
         CAST(SUM(md.clicks_qty) AS BIGINT) AS clicks_total
  FROM daily_metrics md LEFT JOIN line_item li ON li.line_item_id = md.line_item_id
  WHERE {AFTER} AND {SCOPE} AND md.campaign_target IN {_in(C.TARGETS_NETWORK)} AND md.cost_usd > 0
  GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
)"""

DENOM = f"""aw_denom AS (
  SELECT md.site, md.advertiser_id, MIN(md.advertiser_name) AS advertiser_name, MIN(md.vertical) AS vertical,
         CAST(SUM(md.cost_usd) AS DOUBLE) AS rev_total,
         MAX(CASE WHEN {OFF} THEN 1 ELSE 0 END) AS flag_adx,
         {S2} AS strategy
  FROM daily_metrics md
  WHERE {AFTER} AND {SCOPE} AND md.campaign_target IN {_in(C.TARGETS_POPULATION)} AND md.cost_usd > 0
  GROUP BY md.site, md.advertiser_id, {S2}
)"""

def _win(alias: str, start, end) -> str:
    return f"{alias}.event_local_dt BETWEEN {_d(start)} AND {_d(end)}"


def _scope(alias: str) -> str:
    return SCOPE.replace("md.", f"{alias}.")


# Adopters, stated with predicates and correlated sums: a group adopts when an
# off-only item has qualifying delivery after launch; each revenue figure is
# a correlated sum over the group's display-scope rows of one window.
ARPU = f"""oo_ids AS (SELECT DISTINCT line_item_id FROM line_item WHERE UPPER(inventory) = 'OFF'),
ext_items AS (
  SELECT DISTINCT r.line_item_id
  FROM line_item_creative_rel r
  JOIN creative_history h ON h.creative_id = r.creative_id
  JOIN destination d ON d.destination_id = h.creative_destination_id
  WHERE UPPER(d.destination_subtype) IN {_in(C.EXTERNAL_DESTINATION_SUBTYPES)}
    AND r.line_item_id IN (SELECT line_item_id FROM line_item_master)
),
destination_flag AS (
  SELECT m.line_item_id, MAX(CASE WHEN m.line_item_id IN (SELECT line_item_id FROM ext_items) THEN 1 ELSE 0 END)
           AS has_ext_destination
  FROM line_item_master m WHERE m.line_item_id IN (SELECT line_item_id FROM oo_ids) GROUP BY m.line_item_id
),
scoped AS (
  SELECT md.*, {S3} AS strategy, md.line_item_id IN (SELECT line_item_id FROM oo_ids) AS is_oo
  FROM daily_metrics md WHERE {SCOPE}
),
adopter_groups AS (
  SELECT s.site, s.advertiser_id, s.strategy, MIN(s.advertiser_name) AS advertiser_name,
         MIN(s.vertical) AS vertical,
         MAX(CASE WHEN s.line_item_id IN (SELECT line_item_id FROM ext_items) THEN 1 ELSE 0 END) AS has_dot_com
  FROM scoped s WHERE s.is_oo AND {_win("s", CFG.launch_date, CFG.analysis_end)} AND s.cost_usd > 0
  GROUP BY s.site, s.advertiser_id, s.strategy
),
arpu AS (
  SELECT g.site, g.advertiser_id, g.advertiser_name, g.vertical, g.has_dot_com, g.strategy,
    CAST(COALESCE((SELECT SUM(x.cost_usd) FROM scoped x
                   WHERE x.site = g.site AND x.advertiser_id = g.advertiser_id AND x.strategy = g.strategy
                     AND {_win("x", CFG.before_start, CFG.before_end)}), 0) AS DOUBLE) AS rev_before,
    CAST(COALESCE((SELECT SUM(x.cost_usd) FROM scoped x
                   WHERE x.site = g.site AND x.advertiser_id = g.advertiser_id AND x.strategy = g.strategy
                     AND {_win("x", CFG.launch_date, CFG.analysis_end)}), 0) AS DOUBLE) AS rev_after_total,
    CAST(COALESCE((SELECT SUM(x.cost_usd) FROM scoped x
                   WHERE x.site = g.site AND x.advertiser_id = g.advertiser_id AND x.strategy = g.strategy
                     AND x.is_oo AND {_win("x", CFG.launch_date, CFG.analysis_end)}), 0) AS DOUBLE) AS rev_after_oo,
    CAST(COALESCE((SELECT SUM(x.cost_usd) FROM scoped x
                   WHERE x.site = g.site AND x.advertiser_id = g.advertiser_id AND x.strategy = g.strategy
                     AND x.page_name != '{C.OFFSITE_PAGE}' AND {_win("x", CFG.launch_date, CFG.analysis_end)}), 0)
         AS DOUBLE) AS rev_after_in_meli
  FROM adopter_groups g
)"""

# First-timers: buyers of off-only items reaching the minimum spend; "new"
# means no matching positive-cost row exists in the history window.
NUEVOS = f"""buyers AS (
  SELECT md.site, md.advertiser_id
  FROM daily_metrics md
  WHERE md.line_item_id IN ({OO_IDS}) AND {AFTER} AND md.cost_usd > 0
  GROUP BY md.site, md.advertiser_id
  HAVING SUM(md.cost_usd) >= {CFG.min_spend}
),
nuevos AS (
  SELECT b.site, b.advertiser_id, a.advertiser_name,
    NOT EXISTS (SELECT 1 FROM daily_metrics h
                WHERE h.advertiser_id = b.advertiser_id AND h.site = b.site AND h.cost_usd > 0
                  AND h.page_name = '{C.OFFSITE_PAGE}' AND {_win("h", CFG.history_start, CFG.history_end)}) AS nuevo_en_adx,
    NOT EXISTS (SELECT 1 FROM daily_metrics h
                WHERE h.advertiser_id = b.advertiser_id AND h.site = b.site AND h.cost_usd > 0
                  AND {_win("h", CFG.history_start, CFG.history_end)}) AS nuevo_en_dsp
  FROM buyers b LEFT JOIN advertiser a ON a.advertiser_id = b.advertiser_id
)"""

_EXCLUDED = ", ".join(str(x) for x in CFG.excluded_creative_advertisers)
_HAS_FORMAT = (
    "json_type(c.images) = 'VARCHAR' AND list_contains(json_extract_string(json_extract_string(c.images, '$'), "
    f"'$[*].type'), '{CFG.creative_format}')"
)

# Creative format: the flag is a membership predicate on the line item.
IAB = f"""format_items AS (
  SELECT DISTINCT CAST(lic.line_item_id AS BIGINT) AS line_item_id
  FROM line_item_creative lic
  WHERE EXISTS (SELECT 1 FROM creative c
                WHERE c.creative_id = lic.creative_id AND c.advertiser_id NOT IN ({_EXCLUDED}) AND {_HAS_FORMAT})
),
iab AS (
  SELECT DISTINCT md.site, md.campaign_id, md.line_item_id, md.advertiser_id,
         CASE UPPER(li.inventory) WHEN 'OFF' THEN 'ONLY_OFF' WHEN 'MELI_OFF' THEN 'IN_PLUS_OFF' ELSE 'ONLY_IN' END
           AS inv_setting,
         {S5} AS strategy,
         COALESCE(md.line_item_id IN (SELECT line_item_id FROM format_items), FALSE) AS has_iab_creative
  FROM daily_metrics md LEFT JOIN line_item li ON li.line_item_id = md.line_item_id
  WHERE {AFTER} AND {SCOPE} AND md.campaign_target IN {_in(C.TARGETS_CREATIVE)} AND md.cost_usd > 0
)"""

EXTRACT_CTES = {"enet": ENET, "aw_denom": DENOM, "arpu": ARPU, "nuevos": NUEVOS, "iab": IAB}


def extract_sql(name: str) -> str:
    return oracle(EXTRACT_CTES[name], f"SELECT * FROM {name}")


def with_extracts(names: list[str], select: str, extra_ctes: str = "") -> str:
    ctes = ",\n".join(EXTRACT_CTES[n] for n in names)
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return oracle(ctes, select)


# --- KPI layer ---------------------------------------------------------------

WS = r"'^\s+|\s+$'"


def _strip_upper(col: str) -> str:
    return f"regexp_replace(UPPER({col}), {WS}, '', 'g')"


def _non_endemic(col: str) -> str:
    listed = C.NO_INFO_VERTICALS + tuple(s.upper() for s in C.NON_ENDEMIC_VERTICALS)
    n = _strip_upper(col)
    return f"(CASE WHEN {col} IS NULL THEN TRUE ELSE ({n} IN {_in(listed)} OR starts_with({n}, '{C.NON_ENDEMIC_PREFIX}')) END)"


def _strict(col: str) -> str:
    u = _strip_upper(col)
    return (
        f"(CASE WHEN {u} = 'OFF' THEN 'ONLY_OFF' WHEN {u} = 'MELI_OFF' THEN 'IN_PLUS_OFF' "
        f"WHEN {u} IN ('IN', 'MELI') THEN 'ONLY_IN' END)"
    )


_PRI = "(CASE inv_setting WHEN 'ONLY_OFF' THEN 2 WHEN 'IN_PLUS_OFF' THEN 1 WHEN 'ONLY_IN' THEN 0 ELSE 0 END)"
_LABEL = "(CASE inv_setting " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.INV_LABELS.items()) + " END)"

ENET_C = f"""enet_c AS (
  SELECT site, advertiser_id, advertiser_name, vertical, campaign_id, line_item_id, raw_inventory, strategy,
         CAST(COALESCE(rev_total, 0) AS DOUBLE) AS rev_total, CAST(COALESCE(rev_off, 0) AS DOUBLE) AS rev_off,
         CAST(COALESCE(rev_in, 0) AS DOUBLE) AS rev_in, CAST(COALESCE(prints_total, 0) AS DOUBLE) AS prints_total,
         prints_off, prints_in, CAST(COALESCE(clicks_total, 0) AS DOUBLE) AS clicks_total,
         {_strict('raw_inventory')} AS inv_setting
  FROM enet
),
enet_k AS (SELECT *, {_PRI} AS inv_pri FROM enet_c WHERE inv_setting IS NOT NULL)"""

VOLUME = """volume AS (
  SELECT inv_setting, COUNT(DISTINCT advertiser_id) AS n_adv, COUNT(DISTINCT line_item_id) AS n_li,
         CAST(SUM(rev_total) AS DOUBLE) AS rev, CAST(SUM(rev_off) AS DOUBLE) AS rev_off,
         CAST(SUM(rev_in) AS DOUBLE) AS rev_in, CAST(SUM(prints_total) AS DOUBLE) AS prints_total
  FROM enet_k GROUP BY inv_setting
)"""

POP = f"""pop AS (
  SELECT site, advertiser_id, advertiser_name, vertical, CAST(COALESCE(rev_total, 0) AS DOUBLE) AS rev_total,
         CAST(COALESCE(flag_adx, 0) AS DOUBLE) AS flag_adx, strategy, NOT {_non_endemic('vertical')} AS is_endemic
  FROM aw_denom
),
pop_tot AS (
  SELECT COUNT(DISTINCT advertiser_id) AS total_adv, CAST(COALESCE(SUM(rev_total), 0) AS DOUBLE) AS total_rev,
         COUNT(DISTINCT CASE WHEN NOT is_endemic THEN advertiser_id END) AS non_endemic_adv,
         COUNT(DISTINCT CASE WHEN NOT is_endemic AND flag_adx = 1 THEN advertiser_id END) AS non_endemic_adx_adv
  FROM pop
)"""

DELTAS = f"""deltas AS (
  SELECT site, advertiser_id, advertiser_name, vertical, CAST(has_dot_com AS BOOLEAN) AS has_dot_com, strategy,
         rb AS rev_before, ra AS rev_after_total, ro AS rev_after_oo, ri AS rev_after_in_meli,
         NOT {_non_endemic('vertical')} AS is_endemic,
         ra - rb AS arpu_delta,
         CASE WHEN rb != 0 THEN (ra - rb) / rb * 100 END AS arpu_delta_pct,
         CASE WHEN rb != 0 THEN (ri - rb) / rb * 100 END AS in_meli_delta_pct,
         CASE WHEN ra != 0 THEN ro / ra * 100 END AS oo_incremental_pct
  FROM (SELECT *, CAST(COALESCE(rev_before, 0) AS DOUBLE) AS rb, CAST(COALESCE(rev_after_total, 0) AS DOUBLE) AS ra,
               CAST(COALESCE(rev_after_oo, 0) AS DOUBLE) AS ro, CAST(COALESCE(rev_after_in_meli, 0) AS DOUBLE) AS ri
        FROM arpu) x
)"""

DELTA_COLS = (
    "site, advertiser_id, advertiser_name, vertical, has_dot_com, strategy, rev_before, rev_after_total, "
    "rev_after_oo, rev_after_in_meli, is_endemic, arpu_delta, arpu_delta_pct, in_meli_delta_pct, oo_incremental_pct"
)

ADOPTION = f"""cats AS (
  SELECT * FROM (VALUES {", ".join(f"('{c}', '{C.INV_LABELS[c]}', {i})" for i, c in enumerate(C.INV_ORDER))})
    AS t(inv_setting, category, ord)
),
adoption AS (
  SELECT c.inv_setting, c.category, CAST(COALESCE(v.n_adv, 0) AS BIGINT) AS n_adv,
         CAST(COALESCE(v.rev, 0) AS DOUBLE) AS rev,
         CASE WHEN t.total_adv != 0 THEN COALESCE(v.n_adv, 0) / t.total_adv * 100 ELSE 0.0 END AS adv_pct,
         CASE WHEN t.total_rev != 0 THEN COALESCE(v.rev, 0) / t.total_rev * 100 ELSE 0.0 END AS rev_pct
  FROM cats c LEFT JOIN volume v ON v.inv_setting = c.inv_setting CROSS JOIN pop_tot t
)"""

NE_ADOPTERS = "ne_ids AS (SELECT DISTINCT advertiser_id FROM deltas WHERE NOT is_endemic)"
OPPORTUNITY = f"""{NE_ADOPTERS},
opportunity AS (
  SELECT p.* FROM pop p
  WHERE NOT p.is_endemic AND NOT EXISTS (SELECT 1 FROM ne_ids i WHERE i.advertiser_id IS NOT DISTINCT FROM p.advertiser_id)
)"""

IAB_FLAGS = """iab_f AS (
  SELECT campaign_id, inv_setting IN ('IN_PLUS_OFF', 'ONLY_OFF') AS is_enet, inv_setting = 'ONLY_OFF' AS is_oo,
         COALESCE(CAST(has_iab_creative AS BOOLEAN), FALSE) AS has
  FROM iab
),
iab_counts AS (
  SELECT COUNT(DISTINCT CASE WHEN is_enet THEN campaign_id END) AS campaigns_enet,
         COUNT(DISTINCT CASE WHEN is_oo THEN campaign_id END) AS campaigns_oo,
         COUNT(DISTINCT CASE WHEN is_enet AND has THEN campaign_id END) AS campaigns_enet_with_format,
         COUNT(DISTINCT CASE WHEN is_oo AND has THEN campaign_id END) AS campaigns_oo_with_format
  FROM iab_f
)"""

TIES = "advertiser_id, site, strategy"
CANNIBAL = CFG.cannibalisation_pct


def _rnd(x: str) -> str:
    return f"CAST(printf('%.1f', {x}) AS DOUBLE)"


KPI_SQL = {
    "kpi_advertiser_summary": (
        ["enet"],
        ENET_C,
        f"""SELECT advertiser_id, MIN(advertiser_name) AS advertiser_name, MIN(vertical) AS vertical,
               MAX(inv_pri) AS max_inv_pri, SUM(rev_total) AS rev_total, SUM(rev_off) AS rev_off, SUM(rev_in) AS rev_in,
               SUM(prints_total) AS prints_total, SUM(clicks_total) AS clicks_total,
               COUNT(DISTINCT line_item_id) AS n_li,
               CASE MAX(inv_pri) WHEN 2 THEN 'ONLY_OFF' WHEN 1 THEN 'IN_PLUS_OFF' WHEN 0 THEN 'ONLY_IN' END AS inv_category,
               NOT {_non_endemic('MIN(vertical)')} AS is_endemic
            FROM enet_k WHERE advertiser_id IS NOT NULL GROUP BY advertiser_id""",
    ),
    "kpi_volume_by_inventory": (
        ["enet"],
        f"{ENET_C},\n{VOLUME}",
        f"""SELECT *, CASE WHEN prints_total != 0 THEN rev / prints_total * 1000 END AS cpm, {_LABEL} AS inv_label,
                   {_PRI} AS inv_priority FROM volume""",
    ),
    "kpi_population_totals": (["aw_denom"], POP, "SELECT * FROM pop_tot"),
    "kpi_adoption_rates": (
        ["enet", "aw_denom"],
        f"{ENET_C},\n{VOLUME},\n{POP},\n{ADOPTION}",
        "SELECT * FROM adoption",
    ),
    "kpi_adopter_deltas": (["arpu"], DELTAS, "SELECT * FROM deltas"),
    "kpi_endemic_arpu": (
        ["arpu"],
        DELTAS,
        """SELECT n_endemic, total_before, total_after, total_before / GREATEST(n_endemic, 1) AS arpu_before,
                  total_after / GREATEST(n_endemic, 1) AS arpu_after
           FROM (SELECT COUNT(*) AS n_endemic, CAST(COALESCE(SUM(rev_before), 0) AS DOUBLE) AS total_before,
                        CAST(COALESCE(SUM(rev_after_total), 0) AS DOUBLE) AS total_after
                 FROM deltas WHERE is_endemic) x""",
    ),
    "kpi_endemic_incremental": (
        ["arpu"],
        DELTAS,
        "SELECT * FROM deltas WHERE is_endemic AND rev_after_total > rev_before AND has_dot_com",
    ),
    "kpi_endemic_cannibalised": (
        ["arpu"],
        DELTAS,
        f"SELECT * FROM deltas WHERE is_endemic AND in_meli_delta_pct IS NOT NULL AND in_meli_delta_pct < {CANNIBAL}",
    ),
    "kpi_nonendemic_opportunity": (["arpu", "aw_denom"], f"{DELTAS},\n{POP},\n{OPPORTUNITY}", "SELECT * FROM opportunity"),
    "kpi_nonendemic_adoption": (
        ["arpu", "aw_denom"],
        f"{DELTAS},\n{POP},\n{NE_ADOPTERS}",
        """SELECT n_adopters, non_endemic_adv, non_endemic_adx_adv,
                  CASE WHEN non_endemic_adv != 0 THEN n_adopters / non_endemic_adv * 100 ELSE 0.0 END AS adoption_pct_display,
                  CASE WHEN non_endemic_adx_adv != 0 THEN n_adopters / non_endemic_adx_adv * 100 ELSE 0.0 END AS adoption_pct_adx
           FROM (SELECT COUNT(*) AS n_adopters FROM ne_ids) n CROSS JOIN pop_tot""",
    ),
    "kpi_first_time_counts": (
        ["nuevos"],
        "",
        """SELECT COUNT(*) FILTER (WHERE COALESCE(nuevo_en_adx, FALSE)) AS n_new_adx,
                  COUNT(*) FILTER (WHERE COALESCE(nuevo_en_dsp, FALSE)) AS n_new_dsp, COUNT(*) AS n_adopters FROM nuevos""",
    ),
    "kpi_creative_adoption": (
        ["iab"],
        IAB_FLAGS,
        """SELECT *,
                  CASE WHEN campaigns_enet != 0 THEN campaigns_enet_with_format / campaigns_enet * 100 ELSE 0.0 END
                    AS adoption_pct_enet,
                  CASE WHEN campaigns_oo != 0 THEN campaigns_oo_with_format / campaigns_oo * 100 ELSE 0.0 END
                    AS adoption_pct_oo
           FROM iab_counts""",
    ),
    "top_endemic_adopters": (
        ["arpu"],
        DELTAS,
        f"""SELECT site, advertiser_id, advertiser_name, strategy, has_dot_com, rev_before, rev_after_total,
                   arpu_delta_pct, in_meli_delta_pct, oo_incremental_pct,
                   CASE WHEN arpu_delta_pct IS NOT NULL AND arpu_delta_pct > 0 THEN 'pos' ELSE 'neg' END AS delta_class,
                   CASE WHEN in_meli_delta_pct IS NOT NULL AND in_meli_delta_pct < {CANNIBAL} THEN 'neg' ELSE '' END
                     AS cannibal_class
            FROM deltas WHERE is_endemic ORDER BY rev_after_total DESC, {TIES} LIMIT {C.TOP_ENDEMIC}""",
    ),
    "top_opportunities": (
        ["arpu", "aw_denom"],
        f"{DELTAS},\n{POP},\n{OPPORTUNITY}",
        f"""SELECT site, advertiser_id, advertiser_name, vertical, strategy, rev_total FROM opportunity
            ORDER BY rev_total DESC, {TIES} LIMIT {C.TOP_OPPORTUNITIES}""",
    ),
    "top_nonendemic_adopters": (
        ["arpu"],
        DELTAS,
        f"""SELECT site, advertiser_id, advertiser_name, vertical, strategy, rev_after_oo, rev_after_total
            FROM deltas WHERE NOT is_endemic ORDER BY rev_after_total DESC, {TIES} LIMIT {C.TOP_NON_ENDEMIC}""",
    ),
    "list_first_time_adx": (
        ["nuevos"],
        "",
        "SELECT advertiser_name, site, advertiser_id FROM nuevos WHERE COALESCE(nuevo_en_adx, FALSE)",
    ),
    "list_first_time_dsp": (
        ["nuevos"],
        "",
        "SELECT advertiser_name, site, advertiser_id FROM nuevos WHERE COALESCE(nuevo_en_dsp, FALSE)",
    ),
    "tbl_volume": (
        ["enet"],
        f"{ENET_C},\n{VOLUME}",
        f"""SELECT inv_setting, {_LABEL} AS inv_label, n_adv, n_li, rev,
                   CASE WHEN prints_total != 0 THEN rev / prints_total * 1000 END AS cpm FROM volume""",
    ),
    "tbl_adoption": (
        ["enet", "aw_denom"],
        f"{ENET_C},\n{VOLUME},\n{POP},\n{ADOPTION}",
        f"SELECT category, n_adv, {_rnd('adv_pct')} AS adv_pct, rev, {_rnd('rev_pct')} AS rev_pct FROM adoption",
    ),
    "qc_unknown_inventory": (
        ["enet"],
        ENET_C,
        """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT advertiser_id) AS n_advertisers,
                  CAST(COALESCE(SUM(rev_total), 0) AS DOUBLE) AS rev_total
           FROM enet_c WHERE inv_setting IS NULL""",
    ),
    "qc_unknown_inventory_values": (
        ["enet"],
        ENET_C,
        "SELECT raw_inventory, COUNT(*) AS n_rows FROM enet_c WHERE inv_setting IS NULL GROUP BY raw_inventory",
    ),
}


def kpi_sql(name: str) -> str:
    exts, ctes, select = KPI_SQL[name]
    return with_extracts(exts, select, ctes)


# --- single-operator queries ---------------------------------------------------

_FACT = "daily_metrics md"

OPS_SQL = {
    "op_strategy_variants": oracle(
        "",
        f"""SELECT DISTINCT md.campaign_target, {S1} AS strategy_network, {S2} AS strategy_population,
                   {S3} AS strategy_adopters, {S5} AS strategy_creative FROM {_FACT}""",
    ),
    "op_inventory_variants": oracle(
        "",
        f"""SELECT inventory,
                   CASE WHEN UPPER(inventory) = 'OFF' THEN 'ONLY_OFF' WHEN UPPER(inventory) = 'MELI_OFF' THEN 'IN_PLUS_OFF'
                        ELSE 'ONLY_IN' END AS lenient,
                   {_strict('inventory')} AS strict, COUNT(*) AS n_rows
            FROM line_item GROUP BY 1, 2, 3""",
    ),
    "op_sector_flag": oracle("", f"SELECT DISTINCT vertical, {_non_endemic('vertical')} AS non_endemic FROM daily_metrics"),
    "op_site_label": oracle(
        "",
        "SELECT DISTINCT CAST(site AS VARCHAR) AS site, COALESCE(CASE CAST(site AS VARCHAR) "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SITE_LABELS.items())
        + " END, CAST(site AS VARCHAR)) AS site_label FROM daily_metrics",
    ),
    "op_null_default": oracle(
        "",
        f"""SELECT COALESCE(li.inventory, '') AS raw_inventory, COUNT(*) AS n_rows
            FROM {_FACT} LEFT JOIN line_item li ON li.line_item_id = md.line_item_id
            WHERE {AFTER} GROUP BY 1""",
    ),
    "op_date_window": oracle(
        "",
        f"""SELECT COUNT(*) FILTER (WHERE {BEFORE}) AS n_before,
                   CAST(COALESCE(SUM(md.cost_usd) FILTER (WHERE {BEFORE}), 0) AS DOUBLE) AS cost_before,
                   COUNT(*) FILTER (WHERE {AFTER}) AS n_after,
                   CAST(COALESCE(SUM(md.cost_usd) FILTER (WHERE {AFTER}), 0) AS DOUBLE) AS cost_after,
                   COUNT(*) FILTER (WHERE {HISTORY}) AS n_history,
                   CAST(COALESCE(SUM(md.cost_usd) FILTER (WHERE {HISTORY}), 0) AS DOUBLE) AS cost_history
            FROM {_FACT}""",
    ),
    "op_display_scope": oracle(
        "",
        f"""SELECT md.campaign_type, md.product_type, md.line_item_type, COALESCE({SCOPE}, FALSE) AS in_scope,
                   COUNT(*) AS n_rows
            FROM {_FACT} GROUP BY 1, 2, 3, 4""",
    ),
    "op_destination_flag": oracle(
        ARPU.split(",\nscoped AS")[0], "SELECT line_item_id, has_ext_destination FROM destination_flag"
    ),
    "op_semi_join": oracle(
        "",
        f"""SELECT DISTINCT md.advertiser_id, md.site FROM {_FACT}
            WHERE md.line_item_id IN ({OO_IDS}) AND {AFTER} AND md.cost_usd > 0""",
    ),
    "op_having": oracle(
        "",
        f"""SELECT md.advertiser_id, md.site, CAST(SUM(md.cost_usd) AS DOUBLE) AS oo_spend FROM {_FACT}
            WHERE md.line_item_id IN ({OO_IDS}) AND {AFTER} AND md.cost_usd > 0
            GROUP BY 1, 2 HAVING SUM(md.cost_usd) >= {CFG.min_spend}""",
    ),
    "op_distinct_keys": oracle(
        "", f"SELECT DISTINCT md.advertiser_id, md.site FROM {_FACT} WHERE {HISTORY} AND md.cost_usd > 0"
    ),
    "op_inner_join": oracle(
        "",
        """SELECT c.advertiser_id, COUNT(*) AS n_links
           FROM creative c JOIN line_item_creative lic ON c.creative_id = lic.creative_id GROUP BY 1""",
    ),
    "op_array_exists": oracle(
        "",
        f"""SELECT creative_id,
                   COALESCE(json_type(images) = 'VARCHAR'
                            AND list_contains(json_extract_string(json_extract_string(images, '$'), '$[*].type'),
                                              '{CFG.creative_format}'), FALSE) AS has_format
            FROM creative""",
    ),
    "op_conditional_sum": oracle(
        "",
        f"""SELECT md.site, CAST(SUM(md.cost_usd) AS DOUBLE) AS cost_total,
                   CAST(SUM(CASE WHEN {OFF} THEN md.cost_usd ELSE 0 END) AS DOUBLE) AS cost_off,
                   CAST(SUM(CASE WHEN {ON} THEN md.cost_usd ELSE 0 END) AS DOUBLE) AS cost_in
            FROM {_FACT} WHERE {AFTER} GROUP BY 1""",
    ),
    "op_any_flag": oracle(
        "",
        f"""SELECT md.advertiser_id, MAX(CASE WHEN {OFF} THEN 1 ELSE 0 END) AS any_offsite
            FROM {_FACT} WHERE {AFTER} GROUP BY 1""",
    ),
    "op_safe_ratio": with_extracts(
        ["enet"],
        """SELECT site, advertiser_id, advertiser_name, vertical, campaign_id, line_item_id, raw_inventory, strategy,
                  CASE WHEN prints_off != 0 THEN rev_off / prints_off * 1000 END AS cpm_off FROM enet""",
    ),
}

_ADOPTER_KEYS = ARPU.split(",\narpu AS")[0]

OPS_SQL.update({
    "op_not_in_null": oracle(
        "",
        f"""SELECT md.line_item_type, COUNT(*) AS n_rows FROM {_FACT}
            WHERE UPPER(md.line_item_type) NOT IN {_in(C.SCOPE_EXCLUDED_LINE_TYPES)} GROUP BY 1""",
    ),
    "op_left_join": oracle(
        "",
        f"""SELECT DISTINCT md.line_item_id, li.inventory
            FROM {_FACT} LEFT JOIN line_item li ON li.line_item_id = md.line_item_id WHERE {AFTER}""",
    ),
    "op_cohort_restrict": oracle(
        f"""buyers AS (
              SELECT md.advertiser_id, md.site FROM {_FACT}
              WHERE md.line_item_id IN ({OO_IDS}) AND {AFTER} AND md.cost_usd > 0
              GROUP BY 1, 2 HAVING SUM(md.cost_usd) >= {CFG.min_spend})""",
        f"""SELECT b.advertiser_id, b.site, COUNT(*) AS n_rows
            FROM buyers b JOIN daily_metrics h ON h.advertiser_id = b.advertiser_id AND h.site = b.site
            WHERE {_win("h", CFG.history_start, CFG.history_end)} AND h.cost_usd > 0 GROUP BY 1, 2""",
    ),
    "op_computed_key_join": oracle(
        _ADOPTER_KEYS,
        f"""SELECT g.advertiser_id, g.site, g.strategy, CAST(SUM(x.cost_usd) AS DOUBLE) AS rev_before
            FROM adopter_groups g
            JOIN scoped x ON x.advertiser_id = g.advertiser_id AND x.site = g.site AND x.strategy = g.strategy
            WHERE {_win("x", CFG.before_start, CFG.before_end)} GROUP BY 1, 2, 3""",
    ),
    "op_existence_in_aggregate": oracle(
        "",
        f"""SELECT md.advertiser_id, md.site, {S3} AS strategy, CAST(SUM(md.cost_usd) AS DOUBLE) AS cost_total,
                   CAST(SUM(CASE WHEN md.line_item_id IN ({OO_IDS}) THEN md.cost_usd ELSE 0 END) AS DOUBLE) AS cost_oo
            FROM {_FACT} WHERE {AFTER} AND {SCOPE} GROUP BY 1, 2, 3""",
    ),
    "op_anti_flag": oracle(
        "",
        """SELECT m.line_item_id,
                  NOT EXISTS (SELECT 1 FROM line_item_creative_rel r WHERE r.line_item_id = m.line_item_id) AS no_creative
           FROM line_item_master m""",
    ),
    "op_anti_join": oracle(
        "",
        f"""SELECT a.advertiser_id, a.advertiser_name FROM advertiser a
            WHERE NOT EXISTS (SELECT 1 FROM {_FACT} WHERE {AFTER} AND md.advertiser_id IS NOT DISTINCT FROM a.advertiser_id)""",
    ),
    "op_any_value": oracle(
        "", f"SELECT md.site, md.advertiser_id, MIN(md.advertiser_name) AS advertiser_name FROM {_FACT} WHERE {AFTER} GROUP BY 1, 2"
    ),
    "op_group_by_expression": oracle(
        "",
        f"""SELECT {S2} AS strategy, COUNT(*) AS n_rows, CAST(SUM(md.cost_usd) AS DOUBLE) AS cost
            FROM {_FACT} WHERE {AFTER} GROUP BY 1""",
    ),
})


QC_DUPLICATES = oracle(
    "",
    """SELECT 'line_item' AS table_name, CAST(line_item_id AS BIGINT) AS key_value, COUNT(*) AS n_rows
       FROM line_item GROUP BY line_item_id HAVING COUNT(*) > 1
       UNION ALL
       SELECT 'advertiser', CAST(advertiser_id AS BIGINT), COUNT(*)
       FROM advertiser GROUP BY advertiser_id HAVING COUNT(*) > 1""",
)

EXTRACT_COUNTS = with_extracts(
    ["enet", "aw_denom", "arpu", "nuevos", "iab"],
    """SELECT 'enet' AS extract, COUNT(*) AS n_rows FROM enet
       UNION ALL SELECT 'aw_denom', COUNT(*) FROM aw_denom
       UNION ALL SELECT 'arpu', COUNT(*) FROM arpu
       UNION ALL SELECT 'nuevos', COUNT(*) FROM nuevos
       UNION ALL SELECT 'iab', COUNT(*) FROM iab""",
)

# Records read back from JSON text: the columns that went in.
_RECORDS = {
    "enet": (
        "enet_k",
        "site, advertiser_id, advertiser_name, vertical, campaign_id, line_item_id, inv_setting, strategy, rev_total, "
        "rev_off, rev_in, prints_total, prints_off, prints_in, clicks_total",
    ),
    "denom": ("pop", "site, advertiser_id, vertical, rev_total, flag_adx, is_endemic, strategy"),
    "arpu": (
        "deltas",
        "site, advertiser_id, advertiser_name, vertical, has_dot_com, strategy, rev_before, rev_after_total, rev_after_oo, "
        "rev_after_in_meli, arpu_delta_pct, in_meli_delta_pct, oo_incremental_pct",
    ),
    "nuevos": ("nuevos", "site, advertiser_id, advertiser_name, nuevo_en_adx, nuevo_en_dsp"),
    "iab": ("iab", "site, campaign_id, line_item_id, advertiser_id, inv_setting, strategy, has_iab_creative"),
}
JSON_RECORDS = with_extracts(["arpu"], f"SELECT {_RECORDS['arpu'][1]} FROM deltas", DELTAS)
REPORT_BUNDLE = with_extracts(
    ["enet", "aw_denom", "arpu", "nuevos", "iab"],
    """SELECT 'config' AS record_set, '1999-07-01' AS oo_start, '1999-12-31' AS analysis_end, '1998-12-30' AS before_start,
              '1999-06-30' AS before_end, 183 AS days_after, 100.0::DOUBLE AS adx_min_usd, '1998-07-01' AS history_start,
              'BUSINESS_SERVICES,EDUCATION_AND_TRAINING,ENTERTAINMENT,ENTERTAINMENT_AND_MEDIA,FINANCIAL_SERVICES,'
              || 'GOVERNMENT,TELECOMMUNICATIONS,TRAVEL_AND_LEISURE,VIS,VIS_MOTORS,VIS_RE,VIS_RE_DEVELOPMENTS,'
              || 'VIS_RE_REALTORS,VIS_VEHICLE_PARTS_AND_ACCESSORIES' AS non_endemic,
              'MLA=Argentina,MLB=Brasil,MLC=Chile,MLM=México,MCO=Colombia,MLU=Uruguay,MPE=Perú' AS sites_lbl
    """
    + "".join(f" UNION ALL BY NAME SELECT '{k}' AS record_set, {cols} FROM {t}" for k, (t, cols) in _RECORDS.items()),
    f"{ENET_C},\n{POP},\n{DELTAS}",
)

OPS_SQL["op_numeric_coercion"] = oracle(
    "",
    f"""SELECT text, CASE WHEN v IS NULL OR isnan(v) THEN 0.0 ELSE v END AS number, COUNT(*) AS n_rows
        FROM (SELECT text, TRY_CAST(text AS DOUBLE) AS v
              FROM (SELECT CASE md.line_item_id % 9
                             WHEN 0 THEN CAST(CAST(md.cost_usd AS BIGINT) AS VARCHAR)
                             WHEN 1 THEN ' -' || md.line_item_id || '.5 '
                             WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN md.line_item_id || ',000'
                             WHEN 5 THEN md.line_item_id || 'd' WHEN 6 THEN 'nan'
                             WHEN 8 THEN md.line_item_id || 'e2' END AS text FROM {_FACT}) t) x
        GROUP BY 1, 2""",
)

# --- stored forms --------------------------------------------------------------------

#: settings recorded by the manifest of the fixture run, written out
_MANIFEST_CONFIG = (
    '{"analysis_end": "1999-12-31", "before_start": "1998-12-30", "creative_format": "iab_picture", '
    '"excluded_creative_advertisers": [710], "history_start": "1998-07-01", "launch_date": "1999-07-01", "min_spend": 100.0}'
)
STORES_SQL = {
    "io_cache_manifest": with_extracts(
        ["enet", "aw_denom", "arpu", "nuevos", "iab"],
        f"""SELECT extract, 'parquet' AS format, TRUE AS finished, sha256('{_MANIFEST_CONFIG}') AS config_hash, n_rows, TRUE AS has_files
       FROM (SELECT 'enet' AS extract, COUNT(*) AS n_rows FROM enet
       UNION ALL SELECT 'aw_denom', COUNT(*) FROM aw_denom
       UNION ALL SELECT 'arpu', COUNT(*) FROM arpu
       UNION ALL SELECT 'nuevos', COUNT(*) FROM nuevos
       UNION ALL SELECT 'iab', COUNT(*) FROM iab)""",
    ),
    "io_csv_rejects": oracle(
        """spend AS (
  SELECT site, advertiser_id, CAST(SUM(cost_usd) AS BIGINT) AS spend,
         advertiser_id % 7 = 0 OR site % 11 = 0 AS bad
  FROM daily_metrics WHERE event_local_dt BETWEEN DATE '1999-07-01' AND DATE '1999-12-31' GROUP BY site, advertiser_id)""",
        """SELECT CAST(site AS VARCHAR) AS site, COUNT(*) FILTER (NOT bad) AS n_good,
       CAST(COALESCE(SUM(spend) FILTER (NOT bad), 0) AS BIGINT) AS spend, COUNT(*) FILTER (bad) AS n_rejected
FROM spend GROUP BY site""",
    ),
    "set_inventory_counts": with_extracts(
        ["enet"],
        """SELECT inv_setting, COUNT(DISTINCT advertiser_id) AS n_adv, COUNT(DISTINCT line_item_id) AS n_li,
       COUNT(DISTINCT advertiser_id) FILTER (NOT EXISTS (
         SELECT 1 FROM enet_c o WHERE o.advertiser_id = e.advertiser_id AND o.inv_setting <> e.inv_setting)) AS n_adv_only
FROM enet_c e WHERE inv_setting IS NOT NULL GROUP BY inv_setting""",
        ENET_C,
    ),
    "set_window_advertisers": oracle(
        """buys AS (
  SELECT site, advertiser_id,
         BOOL_OR(event_local_dt BETWEEN DATE '1999-07-01' AND DATE '1999-12-31') AS a,
         BOOL_OR(event_local_dt BETWEEN DATE '1998-07-01' AND DATE '1999-06-30') AS h
  FROM daily_metrics
  WHERE cost_usd > 0 AND event_local_dt BETWEEN DATE '1998-07-01' AND DATE '1999-12-31' GROUP BY site, advertiser_id)""",
        """SELECT site, COUNT(*) FILTER (a) AS n_after, COUNT(*) FILTER (h) AS n_history, COUNT(*) FILTER (a AND h) AS n_both,
       COUNT(*) FILTER (a AND NOT h) AS n_new, COUNT(*) FILTER (h AND NOT a) AS n_gone
FROM buys GROUP BY site""",
    ),
    "bucketed_network_items": extract_sql("enet"),
    "sql_network_items": extract_sql("enet"),
    "sql_display_population": extract_sql("aw_denom"),
    "sql_adopters": extract_sql("arpu"),
    "sql_first_time": extract_sql("nuevos"),
    "sql_creative_adoption": extract_sql("iab"),
    "prefiltered_adopters": extract_sql("arpu"),
    "prefiltered_first_time": extract_sql("nuevos"),
    "index_creative_adoption": extract_sql("iab"),
    "index_format_counts": oracle(
        """typed AS (
  SELECT creative_id, UNNEST(json_extract_string(json_extract_string(images, '$'), '$[*].type')) AS type
  FROM creative WHERE json_type(images) = 'VARCHAR')""",
        """SELECT t.type, COUNT(DISTINCT t.creative_id) AS n_creatives, COUNT(DISTINCT l.line_item_id) AS n_line_items
FROM typed t LEFT JOIN line_item_creative l ON l.creative_id = t.creative_id WHERE t.type IS NOT NULL GROUP BY t.type""",
    ),
    "index_image_forms": oracle(
        "",
        """SELECT CASE WHEN images IS NULL THEN 'missing'
            WHEN NOT json_valid(images) THEN 'malformed'
            WHEN json_type(images) <> 'VARCHAR' THEN 'other_json'
            WHEN NOT json_valid(json_extract_string(images, '$')) THEN 'malformed'
            WHEN json_type(json_extract_string(images, '$')) = 'ARRAY' THEN 'encoded_array'
            ELSE 'other_json' END AS form, COUNT(*) AS n_creatives
FROM creative GROUP BY 1""",
    ),
}
