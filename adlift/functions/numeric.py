"""Numeric coercion and ratio helpers (NULL, never NaN)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number: optional sign, digits with an optional fraction,
# optional exponent, surrounding whitespace allowed; also inf / infinity.
# Anything else (e.g. '1,000', '12d', 'abc', '') becomes 0.
_NUMBER_TEXT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def to_number(c: Column, is_text: bool = True) -> Column:
    """Coerce to double: unparsable, NULL or NaN -> 0.0."""
    if is_text:
        s = F.trim(c.cast("string"))
        num = F.when(s.rlike(_NUMBER_TEXT), s.try_cast("double"))
    else:
        num = c.cast("double")
    return F.coalesce(F.nanvl(num, F.lit(None).cast("double")), F.lit(0.0))


def to_numbers(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Coerce the listed columns that exist in ``df`` (others are ignored)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    exprs = {}
    for c in cols:
        if c in fields:
            exprs[c] = to_number(F.col(c), is_text=isinstance(fields[c], T.StringType))
    return df.withColumns(exprs) if exprs else df


def safe_ratio(a: Column, b: Column, mult: float = 1) -> Column:
    """``a / b * mult``; NULL when ``b`` is 0 or NULL."""
    return F.when(b != 0, a / b * F.lit(mult))


def ratio_or_zero(n: Column, d: Column, mult: float = 100) -> Column:
    """``n / d * mult``; 0 when ``d`` is 0 or NULL (a KPI shown as 0 %)."""
    return F.when(d != 0, n / d * F.lit(mult)).otherwise(F.lit(0.0))


def round_half_even_exact(c: Column, digits: int = 1) -> Column:
    """Round a double the way Python's ``round(x, digits)`` does: half to
    even on the exact binary value (0.25 -> 0.2, 0.15 -> 0.1, 0.35 -> 0.3).

    Spark's ``round`` / ``bround`` round the shortest decimal text instead,
    so they differ on such values.  ``format_number`` formats the exact
    value with HALF_EVEN rounding; the text is read back as a double.
    """
    txt = F.regexp_replace(F.format_number(c, digits), ",", "")
    return F.when(F.isnan(c), c).otherwise(txt.try_cast("double"))
