"""JSON membership test for the creative ``images`` column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_array_has_type(images: Column, type_name: str) -> Column:
    """True when ``images`` is a JSON *string* whose text is a JSON array
    holding an element whose ``type`` is ``type_name``.

    The column is double-encoded: the outer JSON value is a string, and the
    array lives inside that string.  A plain (not encoded) array, a bare
    object, invalid text, NULL, an element without ``type`` and an array- or
    object-valued ``type`` all give False.  A scalar ``type`` is compared as
    text.  Built from native variant functions: one bad element does not
    hide the others, and nothing leaves the JVM.
    """
    hit = F.exists(
        _decoded_array(images),
        lambda v: F.coalesce(F.try_variant_get(v, "$.type", "string") == F.lit(type_name), F.lit(False)),
    )
    return F.coalesce(hit, F.lit(False))


def _decoded_text(images: Column) -> Column:
    """The text inside a JSON string; NULL for any other JSON value."""
    return F.when(F.left(F.ltrim(images), F.lit(1)) == F.lit('"'), F.get_json_object(images, "$"))


def _decoded_array(images: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(_decoded_text(images)), "$", "array<variant>")


def json_array_types(images: Column) -> Column:
    """The distinct scalar ``type`` texts of the array that
    ``json_array_has_type`` looks into; empty when there is no such array."""
    types = F.transform(_decoded_array(images), lambda v: F.try_variant_get(v, "$.type", "string"))
    return F.coalesce(F.array_distinct(F.array_compact(types)), F.array().cast("array<string>"))


#: what ``images`` holds: an encoded array (the only form that is read), JSON of another form, no JSON, or nothing
ENCODED, OTHER_JSON, MALFORMED, MISSING = "encoded_array", "other_json", "malformed", "missing"


def json_array_form(images: Column) -> Column:
    """Which of the four forms a value of ``images`` has.  A string that does
    not hold JSON is malformed, one that holds JSON other than an array is not."""
    text = _decoded_text(images)
    return (
        F.when(images.isNull(), F.lit(MISSING))
        .when(_decoded_array(images).isNotNull(), F.lit(ENCODED))
        .when(F.try_parse_json(images).isNull() | (text.isNotNull() & F.try_parse_json(text).isNull()), F.lit(MALFORMED))
        .otherwise(F.lit(OTHER_JSON))
    )
