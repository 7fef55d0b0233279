"""Reusable relational steps: scopes, cohorts, flag joins, aggregates."""

from .aggregates import any_flag, cond_sum, distinct_counts, pick_value
from .cohort import (
    creative_format_items,
    external_destination_items,
    inventory_multiplicity,
    inventory_settings,
    off_item_flags,
    only_off_ids,
)
from .joins import absent_flag, anti_join_null_safe, left_join_nullable_key
from .scope import display_scope, in_window, is_offsite, is_onsite, positive_cost, target_allowed

__all__ = [
    "absent_flag",
    "anti_join_null_safe",
    "any_flag",
    "cond_sum",
    "creative_format_items",
    "display_scope",
    "distinct_counts",
    "external_destination_items",
    "in_window",
    "inventory_multiplicity",
    "inventory_settings",
    "is_offsite",
    "is_onsite",
    "left_join_nullable_key",
    "off_item_flags",
    "only_off_ids",
    "pick_value",
    "positive_cost",
    "target_allowed",
]
