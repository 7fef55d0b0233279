"""Column functions on hand-made rows (traps T3, T5, T15, T18, T19, T20)."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from adlift import config as C
from adlift.functions import (
    inventory_label,
    inventory_lenient,
    inventory_priority,
    inventory_strict,
    is_non_endemic,
    json_array_has_type,
    priority_category,
    ratio_or_zero,
    round_half_even_exact,
    safe_ratio,
    site_label,
    strategy,
    strip_ws,
    to_number,
)


def _one_col(spark, values, typ="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")


def _apply(spark, values, fn, typ="string"):
    df = _one_col(spark, values, typ)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


TARGETS = [
    "REACH", "IMPRESSION", "IMPRESSIONS", "CPC", "CPA", "CONVERSION", "CONVERSIONS", "ROAS", "CPL", "reach",
    "OTHER", None,
]


def test_strategy_rule_tables_disagree(spark):
    net = _apply(spark, TARGETS, lambda c: strategy(c, C.STRATEGY_NETWORK))
    pop = _apply(spark, TARGETS, lambda c: strategy(c, C.STRATEGY_POPULATION))
    adp = _apply(spark, TARGETS, lambda c: strategy(c, C.STRATEGY_ADOPTERS))
    cre = _apply(spark, TARGETS, lambda c: strategy(c, C.STRATEGY_CREATIVE))
    A, S, V = "AWARENESS", "CONSIDERACION", "CONVERSION"
    assert net == [A, A, A, S, V, V, V, V, V, "reach", "OTHER", None]
    # ROAS is kept as itself in the population rules, CPL is a conversion
    assert pop == [A, A, A, S, V, V, V, "ROAS", V, "reach", "OTHER", None]
    # upper-cased; everything else (NULL too) is CONSIDERACION
    assert adp == [A, A, A, S, V, V, V, S, S, A, S, S]
    # CPL kept as itself
    assert cre == [A, A, A, S, V, V, V, V, "CPL", "reach", "OTHER", None]


INVENTORIES = ["OFF", " off ", "off", "MELI_OFF", "IN", "MELI", "", "X", None, " in "]


def test_inventory_classifiers(spark):
    lenient = _apply(spark, INVENTORIES, inventory_lenient)
    strict = _apply(spark, INVENTORIES, inventory_strict)
    assert lenient == [
        "ONLY_OFF", "ONLY_IN", "ONLY_OFF", "IN_PLUS_OFF", "ONLY_IN", "ONLY_IN", "ONLY_IN", "ONLY_IN", "ONLY_IN",
        "ONLY_IN",
    ]
    assert strict == ["ONLY_OFF", "ONLY_OFF", "ONLY_OFF", "IN_PLUS_OFF", "ONLY_IN", "ONLY_IN", None, None, None, "ONLY_IN"]


def test_priority_round_trip(spark):
    cats = ["ONLY_OFF", "IN_PLUS_OFF", "ONLY_IN", None, "??"]
    assert _apply(spark, cats, inventory_priority) == [2, 1, 0, 0, 0]
    assert _apply(spark, [2, 1, 0, 5], priority_category, "int") == ["ONLY_OFF", "IN_PLUS_OFF", "ONLY_IN", None]
    assert _apply(spark, cats[:3], inventory_label) == ["Solo Off", "In + Off", "Solo In-MELI"]


VERTICALS = [
    None, "", "None", "unknown", "OTROS", "No Informado", "VIS", "VIS_X", "VISION", "\tVIS_MOTORS\n", " vis_motors ",
    "FINANCIAL_SERVICES", "HOME", "AUTO", "travel_and_leisure",
]


def test_sector_flag_strips_all_whitespace(spark):
    got = _apply(spark, VERTICALS, is_non_endemic)
    assert got == [True, True, True, True, True, True, True, True, False, True, True, True, False, False, True]


def test_strip_matches_python(spark):
    texts = ["\t a \n", "\x0b\x0cb\r", "\xa0c ", "\x1cd\x1f", "e", ""]
    assert _apply(spark, texts, strip_ws) == [t.strip() for t in texts]


def test_numeric_coercion(spark):
    vals = ["abc", "", " 12 ", "nan", "1,000", "12d", None, "3.5", "1e3", "-2", ".5", "+4."]
    got = _apply(spark, vals, to_number)
    assert got == [0.0, 0.0, 12.0, 0.0, 0.0, 0.0, 0.0, 3.5, 1000.0, -2.0, 0.5, 4.0]
    num = _apply(spark, [1.5, None, float("nan")], lambda c: to_number(c, is_text=False), "double")
    assert num == [1.5, 0.0, 0.0]


def test_safe_ratio_null_never_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None), (None, 2.0), (0.0, -0.0)], "a double, b double")
    got = [r[0] for r in df.select(safe_ratio(F.col("a"), F.col("b"), 100)).collect()]
    assert got == [50.0, None, None, None, None]
    got0 = [r[0] for r in df.select(ratio_or_zero(F.col("a"), F.col("b"))).collect()]
    assert got0 == [50.0, 0.0, 0.0, None, 0.0]


@pytest.mark.parametrize("x", [0.25, 0.15, 0.35, 0.45, 2.675, 12.25, 99.95, 1 / 3 * 100, 0.0, 150.05])
def test_rounding_like_python(spark, x):
    got = _apply(spark, [x], lambda c: round_half_even_exact(c, 1), "double")[0]
    assert got == round(x, 1)


def test_rounding_nan_passes_through(spark):
    got = _apply(spark, [float("nan")], lambda c: round_half_even_exact(c, 1), "double")[0]
    assert math.isnan(got)


IMAGES = [
    ('"[{\\"type\\":\\"iab_picture\\"},{\\"type\\":\\"logo\\"}]"', True),  # encoded array with the format
    ('[{"type":"iab_picture"}]', False),  # plain array: not a JSON string
    ('{"type":"iab_picture"}', False),  # bare object
    ('"{\\"type\\":\\"iab_picture\\"}"', False),  # encoded object, not an array
    ("not json", False),
    (None, False),
    ('"[]"', False),
    ('"[{\\"kind\\":\\"iab_picture\\"}]"', False),  # element without type
    ('"[5,{\\"type\\":1},{\\"type\\":\\"iab_picture\\"}]"', True),  # mixed elements
    ('"[{\\"type\\":[\\"iab_picture\\"]}]"', False),  # array-valued type
    ('"[{\\"type\\":\\"IAB_PICTURE\\"}]"', False),  # case matters
    ('  "[{\\"type\\":\\"iab_picture\\"}]"', True),  # leading spaces
    ('"not json inside"', False),
]


def test_json_array_has_type(spark):
    got = _apply(spark, [v for v, _ in IMAGES], lambda c: json_array_has_type(c, "iab_picture"))
    assert got == [e for _, e in IMAGES]


def test_site_label(spark):
    got = _apply(spark, ["MLA", "MLB", "MPE", "XYZ", None], site_label)
    assert got == ["Argentina", "Brasil", "Perú", "XYZ", None]
    assert _apply(spark, [3], site_label, "int") == ["3"]
