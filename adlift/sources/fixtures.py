"""Test fixtures: the provided TPC-H-like tables mapped onto the source shape.

The mapping (FIXTURES.md §2) exists twice: as DataFrame code for Spark, and
as SQL text (common table expressions) for the DuckDB oracle, which only
sees the base tables.  Both must stay in step; ``tests/test_fixtures.py``
compares them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Sources

BASE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")

# images by s_suppkey % 5, as stored (a JSON string holding JSON text, a
# plain array, an encoded array without the format, an encoded empty array,
# NULL)
IMAGES_BY_MOD5 = (
    '"[{\\"type\\":\\"iab_picture\\"},{\\"type\\":\\"logo\\"}]"',
    '[{"type":"iab_picture"}]',
    '"[{\\"type\\":\\"logo\\"}]"',
    '"[]"',
    None,
)


def _case(c: Column, pairs: list[tuple[object, object]], default: object = None) -> Column:
    expr = None
    for k, v in pairs:
        lit_v = F.lit(v)
        expr = F.when(c == k, lit_v) if expr is None else expr.when(c == k, lit_v)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def fixture_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    base = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in BASE_TABLES}
    l, o, c, p = base["lineitem"], base["orders"], base["customer"], base["part"]
    s, n = base["supplier"], base["nation"]

    fact = (
        l.join(o, l.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(p, l.l_partkey == p.p_partkey)
        .select(
            F.col("l_shipdate").cast("date").alias("event_local_dt"),
            F.col("c_nationkey").alias("site"),
            F.col("c_custkey").alias("advertiser_id"),
            F.col("c_name").alias("advertiser_name"),
            _case(
                F.col("c_mktsegment"),
                [
                    ("BUILDING", "FINANCIAL_SERVICES"),
                    ("MACHINERY", " vis_motors "),
                    ("FURNITURE", "HOME"),
                    ("AUTOMOBILE", "AUTO"),
                ],
            ).alias("vertical"),
            F.col("l_orderkey").alias("campaign_id"),
            F.col("l_partkey").alias("line_item_id"),
            F.when(F.col("o_orderstatus") == "P", "GUARANTEED").otherwise("PROGRAMMATIC").alias("campaign_type"),
            F.when(F.col("l_linenumber") == 7, "OTHER").otherwise("DSP_SELFSERVICE").alias("product_type"),
            F.when(F.col("p_type") == "SMALL", F.lit("video"))
            .when(F.col("p_type") == "MEDIUM", F.lit("Social"))
            .when(F.col("p_type") == "LARGE", F.lit(None).cast("string"))
            .otherwise(F.lit("Display"))
            .alias("line_item_type"),
            _case(
                F.col("o_orderpriority"),
                [("1-URGENT", "REACH"), ("2-HIGH", "CPC"), ("3-MEDIUM", "CPA"), ("4-NOT SPECIFIED", "ROAS")],
                default="CPL",
            ).alias("campaign_target"),
            _case(F.col("l_returnflag"), [("R", "adx-display"), ("N", "home")]).alias("page_name"),
            F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("double").alias("cost_usd"),
            F.col("l_quantity").cast("bigint").alias("prints_qty"),
            F.col("l_linenumber").cast("bigint").alias("clicks_qty"),
        )
    )
    line_item = p.where(F.col("p_partkey") % 11 != 0).select(
        F.col("p_partkey").alias("line_item_id"),
        _case(F.col("p_partkey") % 6, [(0, "off"), (1, "MELI_OFF"), (2, " in "), (3, "MELI"), (4, "OTHER")]).alias(
            "inventory"
        ),
    )
    master = p.select(F.col("p_partkey").alias("line_item_id"))
    li_creative = (
        l.where((F.col("l_partkey") % 5 < 2) & (F.col("l_linenumber") <= 2))
        .select(F.col("l_partkey").alias("line_item_id"), F.col("l_suppkey").alias("creative_id"))
        .distinct()
    )
    creative_history = s.select(
        F.col("s_suppkey").alias("creative_id"), F.col("s_nationkey").cast("bigint").alias("creative_destination_id")
    )
    destination = n.select(
        F.col("n_nationkey").cast("bigint").alias("destination_id"),
        F.when(F.col("n_regionkey") == 0, "click_off")
        .when(F.col("n_regionkey") == 1, "CLICK_OFF_SAFE")
        .otherwise("CLICK_IN")
        .alias("destination_subtype"),
    )
    advertiser = c.select(F.col("c_custkey").alias("advertiser_id"), F.col("c_name").alias("advertiser_name"))
    sk = F.col("s_suppkey")
    creative = s.select(
        sk.alias("creative_id"),
        F.when(sk == 10, F.lit(710).cast("bigint"))
        .when(sk == 15, F.lit(None).cast("bigint"))
        .otherwise(sk)
        .alias("advertiser_id"),
        _case(sk % 5, [(i, v) for i, v in enumerate(IMAGES_BY_MOD5) if v is not None]).alias("images"),
    )
    return {
        "daily_metrics": fact,
        "line_item": line_item,
        "line_item_master": master,
        "line_item_creative_rel": li_creative,
        "creative_history": creative_history,
        "destination": destination,
        "advertiser": advertiser,
        "creative": creative,
        "line_item_creative": li_creative,
    }


def fixture_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """Sources built from the provided test tables under ``sf_dir``."""
    return Sources.from_frames(fixture_frames(spark, sf_dir))


# ---------------------------------------------------------------------------
# The same mapping as DuckDB SQL (oracle side). DuckDB string literals do not
# treat the backslash as an escape, so the stored images text is written as is.
# ---------------------------------------------------------------------------

FIXTURE_CTES = """WITH daily_metrics AS (
  SELECT CAST(l.l_shipdate AS DATE) AS event_local_dt,
         c.c_nationkey AS site,
         c.c_custkey AS advertiser_id,
         c.c_name AS advertiser_name,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'FINANCIAL_SERVICES' WHEN 'MACHINERY' THEN ' vis_motors '
              WHEN 'FURNITURE' THEN 'HOME' WHEN 'AUTOMOBILE' THEN 'AUTO' END AS vertical,
         l.l_orderkey AS campaign_id,
         l.l_partkey AS line_item_id,
         CASE WHEN o.o_orderstatus = 'P' THEN 'GUARANTEED' ELSE 'PROGRAMMATIC' END AS campaign_type,
         CASE WHEN l.l_linenumber = 7 THEN 'OTHER' ELSE 'DSP_SELFSERVICE' END AS product_type,
         CASE p.p_type WHEN 'SMALL' THEN 'video' WHEN 'MEDIUM' THEN 'Social' WHEN 'LARGE' THEN NULL
              ELSE 'Display' END AS line_item_type,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'REACH' WHEN '2-HIGH' THEN 'CPC' WHEN '3-MEDIUM' THEN 'CPA'
              WHEN '4-NOT SPECIFIED' THEN 'ROAS' ELSE 'CPL' END AS campaign_target,
         CASE l.l_returnflag WHEN 'R' THEN 'adx-display' WHEN 'N' THEN 'home' END AS page_name,
         CAST(FLOOR(l.l_extendedprice * l.l_discount) AS DOUBLE) AS cost_usd,
         CAST(l.l_quantity AS BIGINT) AS prints_qty,
         CAST(l.l_linenumber AS BIGINT) AS clicks_qty
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
line_item AS (
  SELECT p_partkey AS line_item_id,
         CASE p_partkey % 6 WHEN 0 THEN 'off' WHEN 1 THEN 'MELI_OFF' WHEN 2 THEN ' in ' WHEN 3 THEN 'MELI'
              WHEN 4 THEN 'OTHER' END AS inventory
  FROM part WHERE p_partkey % 11 <> 0
),
line_item_master AS (SELECT p_partkey AS line_item_id FROM part),
line_item_creative AS (
  SELECT DISTINCT l_partkey AS line_item_id, l_suppkey AS creative_id
  FROM lineitem WHERE l_partkey % 5 < 2 AND l_linenumber <= 2
),
line_item_creative_rel AS (SELECT * FROM line_item_creative),
creative_history AS (
  SELECT s_suppkey AS creative_id, CAST(s_nationkey AS BIGINT) AS creative_destination_id FROM supplier
),
destination AS (
  SELECT CAST(n_nationkey AS BIGINT) AS destination_id,
         CASE n_regionkey WHEN 0 THEN 'click_off' WHEN 1 THEN 'CLICK_OFF_SAFE' ELSE 'CLICK_IN' END
           AS destination_subtype
  FROM nation
),
advertiser AS (SELECT c_custkey AS advertiser_id, c_name AS advertiser_name FROM customer),
creative AS (
  SELECT s_suppkey AS creative_id,
         CASE WHEN s_suppkey = 10 THEN CAST(710 AS BIGINT) WHEN s_suppkey = 15 THEN CAST(NULL AS BIGINT)
              ELSE s_suppkey END AS advertiser_id,
         CASE s_suppkey % 5
              WHEN 0 THEN '"[{\\"type\\":\\"iab_picture\\"},{\\"type\\":\\"logo\\"}]"'
              WHEN 1 THEN '[{"type":"iab_picture"}]'
              WHEN 2 THEN '"[{\\"type\\":\\"logo\\"}]"'
              WHEN 3 THEN '"[]"'
         END AS images
  FROM supplier
)"""


def oracle(ctes: str = "", select: str = "") -> str:
    """Oracle SQL text: fixture CTEs, then extra CTEs (``name AS (...)`` items
    separated by commas), then the final SELECT."""
    extra = f",\n{ctes.strip()}" if ctes.strip() else ""
    return f"{FIXTURE_CTES}{extra}\n{select.strip()}"
