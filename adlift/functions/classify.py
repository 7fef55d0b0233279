"""Rule-based classifiers as native Column expressions (no Python UDFs).

Each function returns a Column built from ``when`` / ``isin`` / string
functions, so it stays inside whole-stage codegen next to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import strip_ws


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strategy(target: Column | str, rules: C.StrategyRules) -> Column:
    """Campaign target -> strategy under one rule table (``CASE WHEN ... IN``)."""
    t = _col(target)
    key = F.upper(t) if rules.upper else t
    expr = None
    for label, values in rules.groups:
        cond = key.isin(*values)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    other = t if rules.default is None else F.lit(rules.default)
    return expr.otherwise(other)


def inventory_lenient(inventory: Column | str) -> Column:
    """Inventory setting -> category; anything that is not OFF / MELI_OFF
    (NULL included, no trimming) is ONLY_IN."""
    u = F.upper(_col(inventory))
    return (
        F.when(u == C.INVENTORY_OFF, F.lit(C.ONLY_OFF))
        .when(u == C.INVENTORY_IN_PLUS_OFF, F.lit(C.IN_PLUS_OFF))
        .otherwise(F.lit(C.ONLY_IN))
    )


def inventory_strict(inventory: Column | str) -> Column:
    """Inventory setting -> category after upper-casing and stripping all
    whitespace; only IN / MELI are ONLY_IN, anything else is NULL."""
    u = strip_ws(F.upper(_col(inventory)))
    return (
        F.when(u == C.INVENTORY_OFF, F.lit(C.ONLY_OFF))
        .when(u == C.INVENTORY_IN_PLUS_OFF, F.lit(C.IN_PLUS_OFF))
        .when(u.isin(*C.INVENTORY_IN), F.lit(C.ONLY_IN))
    )


def inventory_priority(category: Column | str) -> Column:
    """Category -> priority (ONLY_OFF 2, IN_PLUS_OFF 1, ONLY_IN 0); unknown -> 0."""
    c = _col(category)
    expr = None
    for cat, pri in C.INV_PRIORITY.items():
        expr = F.when(c == cat, F.lit(pri)) if expr is None else expr.when(c == cat, F.lit(pri))
    return expr.otherwise(F.lit(0)).cast("int")


def priority_category(priority: Column | str) -> Column:
    """Priority -> category (inverse of :func:`inventory_priority`); unknown -> NULL."""
    p = _col(priority)
    expr = None
    for cat, pri in C.INV_PRIORITY.items():
        expr = F.when(p == pri, F.lit(cat)) if expr is None else expr.when(p == pri, F.lit(cat))
    return expr


def inventory_label(category: Column | str) -> Column:
    """Category -> display label; unknown -> NULL."""
    return _lookup(_col(category), C.INV_LABELS)


def is_non_endemic(
    vertical: Column | str,
    sectors: Iterable[str] = C.NON_ENDEMIC_VERTICALS,
    unknown_words: Iterable[str] = C.NO_INFO_VERTICALS,
    prefix: str = C.NON_ENDEMIC_PREFIX,
) -> Column:
    """True when the vertical is missing, means "no information", is one of
    the non-endemic sectors, or starts with the prefix.  Never NULL."""
    v = _col(vertical)
    n = strip_ws(F.upper(v))
    listed = tuple(unknown_words) + tuple(s.upper() for s in sectors)
    return F.when(v.isNull(), F.lit(True)).otherwise(n.isin(*listed) | n.startswith(prefix))


def is_endemic(vertical: Column | str, **kw) -> Column:
    return ~is_non_endemic(vertical, **kw)


def site_label(site: Column | str, labels: Mapping[str, str] = C.SITE_LABELS) -> Column:
    """Site code -> label; an unknown code is returned as it is (as text)."""
    s = _col(site).cast("string")
    return F.coalesce(_lookup(s, labels), s)


def _lookup(key: Column, mapping: Mapping[str, str]) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr
