"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every Unicode whitespace character and the
# separators \x1c-\x1f; Spark's trim() removes spaces only.
_WS = r"[\s\x{1c}-\x{1f}]"
_EDGE_WS = rf"(?U)^{_WS}+|{_WS}+$"


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace the way Python's ``str.strip`` does."""
    return F.regexp_replace(c, _EDGE_WS, "")
