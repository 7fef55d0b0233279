"""Declared schemas of the source tables and of the five extracts."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I, _B, _DT = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.DateType()


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SOURCE_SCHEMAS: dict[str, T.StructType] = {
    "daily_metrics": _struct(
        ("event_local_dt", _DT),
        ("site", _S),
        ("advertiser_id", _L),
        ("advertiser_name", _S),
        ("vertical", _S),
        ("campaign_id", _L),
        ("line_item_id", _L),
        ("campaign_type", _S),
        ("product_type", _S),
        ("line_item_type", _S),
        ("campaign_target", _S),
        ("page_name", _S),
        ("cost_usd", _D),
        ("prints_qty", _L),
        ("clicks_qty", _L),
    ),
    "line_item": _struct(("line_item_id", _L), ("inventory", _S)),
    "line_item_master": _struct(("line_item_id", _L)),
    "line_item_creative_rel": _struct(("line_item_id", _L), ("creative_id", _L)),
    "creative_history": _struct(("creative_id", _L), ("creative_destination_id", _L)),
    "destination": _struct(("destination_id", _L), ("destination_subtype", _S)),
    "advertiser": _struct(("advertiser_id", _L), ("advertiser_name", _S)),
    "creative": _struct(("creative_id", _L), ("advertiser_id", _L), ("images", _S)),
    "line_item_creative": _struct(("line_item_id", _S), ("creative_id", _L)),
}

#: columns each source must provide (types may differ, e.g. an int site)
SOURCE_COLUMNS: dict[str, tuple[str, ...]] = {k: tuple(s.names) for k, s in SOURCE_SCHEMAS.items()}


def extract_schemas(site_type: T.DataType = _S) -> dict[str, T.StructType]:
    """Schemas of the five extracts (CSV / JSON replay reads with these)."""
    return {
        "enet": _struct(
            ("site", site_type),
            ("advertiser_id", _L),
            ("advertiser_name", _S),
            ("vertical", _S),
            ("campaign_id", _L),
            ("line_item_id", _L),
            ("raw_inventory", _S),
            ("strategy", _S),
            ("rev_total", _D),
            ("rev_off", _D),
            ("rev_in", _D),
            ("prints_total", _L),
            ("prints_off", _L),
            ("prints_in", _L),
            ("clicks_total", _L),
        ),
        "aw_denom": _struct(
            ("site", site_type),
            ("advertiser_id", _L),
            ("advertiser_name", _S),
            ("vertical", _S),
            ("rev_total", _D),
            ("flag_adx", _I),
            ("strategy", _S),
        ),
        "arpu": _struct(
            ("site", site_type),
            ("advertiser_id", _L),
            ("advertiser_name", _S),
            ("vertical", _S),
            ("has_dot_com", _I),
            ("strategy", _S),
            ("rev_before", _D),
            ("rev_after_total", _D),
            ("rev_after_oo", _D),
            ("rev_after_in_meli", _D),
        ),
        "nuevos": _struct(
            ("site", site_type),
            ("advertiser_id", _L),
            ("advertiser_name", _S),
            ("nuevo_en_adx", _B),
            ("nuevo_en_dsp", _B),
        ),
        "iab": _struct(
            ("site", site_type),
            ("campaign_id", _L),
            ("line_item_id", _L),
            ("advertiser_id", _L),
            ("inv_setting", _S),
            ("strategy", _S),
            ("has_iab_creative", _B),
        ),
    }


EXTRACT_NAMES = ("enet", "aw_denom", "arpu", "nuevos", "iab")
