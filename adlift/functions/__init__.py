"""Column functions: classifiers, coercion, ratios, JSON membership."""

from .classify import (
    inventory_label,
    inventory_lenient,
    inventory_priority,
    inventory_strict,
    is_endemic,
    is_non_endemic,
    priority_category,
    site_label,
    strategy,
)
from .json import json_array_has_type
from .numeric import ratio_or_zero, round_half_even_exact, safe_ratio, to_number, to_numbers
from .text import strip_ws

__all__ = [
    "inventory_label",
    "inventory_lenient",
    "inventory_priority",
    "inventory_strict",
    "is_endemic",
    "is_non_endemic",
    "json_array_has_type",
    "priority_category",
    "ratio_or_zero",
    "round_half_even_exact",
    "safe_ratio",
    "site_label",
    "strategy",
    "strip_ws",
    "to_number",
    "to_numbers",
]
