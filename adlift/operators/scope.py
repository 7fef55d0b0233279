"""Row scopes: date windows and the display-campaign scope.

All predicates are plain comparisons on source columns, so Catalyst pushes
them into the Parquet scan (``PushedFilters``) and, when the fact is stored
partitioned by date, prunes partitions from the date literals.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

DATE_COL = "event_local_dt"


def in_window(start: date, end: date, col: str = DATE_COL) -> Column:
    """Inclusive ``start <= col <= end``; empty when start > end.  The column
    is a date (``Sources`` refuses other types: a timestamp would lose its last
    day after midnight)."""
    return F.col(col).between(F.lit(start), F.lit(end))


def display_scope() -> Column:
    """Programmatic self-service display: campaign type, product type, and a
    line item type that is not video / social (case-insensitive; a NULL type
    is out, as in SQL ``NOT IN``)."""
    return (
        (F.col("campaign_type") == C.SCOPE_CAMPAIGN_TYPE)
        & (F.col("product_type") == C.SCOPE_PRODUCT_TYPE)
        & ~F.upper(F.col("line_item_type")).isin(*C.SCOPE_EXCLUDED_LINE_TYPES)
    )


def target_allowed(targets: tuple[str, ...]) -> Column:
    return F.col("campaign_target").isin(*targets)


def positive_cost() -> Column:
    return F.col("cost_usd") > 0


def is_offsite() -> Column:
    """Row delivered off-site; NULL page is neither off-site nor on-site."""
    return F.col("page_name") == C.OFFSITE_PAGE


def is_onsite() -> Column:
    return F.col("page_name") != C.OFFSITE_PAGE
