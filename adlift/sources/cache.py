"""Extract cache: write the five extracts once, replay them later.

Writing the extracts to a shared folder also cuts the lineage: every KPI
then reads a few small files instead of re-running a scan of the fact, and a
lost executor only costs the tasks of the current stage.

CSV and JSON lines hold one record to a line, so a file is read by many tasks.
In CSV, NULL is written as ``\\N``; in a text, ``\\b``, ``\\n`` and ``\\r`` stand for
a backslash and the line breaks, so every text comes back exactly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from .schemas import EXTRACT_NAMES, extract_schemas

FORMATS = ("parquet", "csv", "json")
CSV_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\\N",
    "escape": '"',
}
#: the text of a record with a cell that is not of its column's type, or with
#: too few or too many cells
CORRUPT = "_corrupt_record"
#: a cell is judged whether a query uses its column or not
REJECT_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"}
ON_REJECT = ("fail", "null", "drop")

_ESCAPES = (("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r"))


def cache_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _texts(df: DataFrame, pairs) -> DataFrame:
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and f.name != CORRUPT:
            c = F.col(f"`{f.name}`")
            for a, b in pairs:
                c = F.replace(c, F.lit(a), F.lit(b))
            out = out.withColumn(f.name, c)
    return out


def _escaped(df: DataFrame) -> DataFrame:
    return _texts(df, _ESCAPES)


def _unescaped(df: DataFrame) -> DataFrame:
    # each backslash of the file begins an escape; the backslash's own is last
    return _texts(df, [(b, a) for a, b in reversed(_ESCAPES)])


def write_extracts(extracts: Mapping[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per extract under ``root``; CSV gets a header row."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    for name, df in extracts.items():
        w = df.write.mode(mode)
        if fmt == "csv":
            # keep text exactly: no trimming, NULL and '' stay apart
            _escaped(df).write.mode(mode).options(**CSV_OPTIONS).csv(cache_path(root, name))
        elif fmt == "json":
            w.option("ignoreNullFields", False).json(cache_path(root, name))
        else:
            w.parquet(cache_path(root, name))


def _with_rejects(spark: SparkSession, fmt: str, path: str, schema: T.StructType) -> DataFrame:
    """The rows, malformed cells as NULL, with the text of malformed records."""
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).options(**REJECT_OPTIONS)
    if fmt == "csv":
        return _unescaped(reader.options(**CSV_OPTIONS).csv(path))
    return reader.json(path)


def _cells(schema: T.StructType) -> Column:
    return F.to_json(F.struct(*schema.names), {"ignoreNullFields": "false"})


def _is_bad(schema: T.StructType) -> Column:
    """The record is malformed; the corrupt record cannot be read alone, so the
    cells are asked for, too."""
    return F.col(CORRUPT).isNotNull() & (F.length(_cells(schema)) > 0)


def rejected_records(spark: SparkSession, root: str, fmt: str, schemas: Mapping[str, T.StructType] | None = None, names=EXTRACT_NAMES) -> DataFrame:
    """(extract, record, cells): the malformed records of a CSV or JSON cache,
    as written and as read (malformed cells NULL)."""
    schemas = dict(schemas or extract_schemas())
    out = None
    for n in names:
        rows = _with_rejects(spark, fmt, cache_path(root, n), schemas[n])
        bad = rows.where(_is_bad(schemas[n])).select(F.lit(n).alias("extract"), F.col(CORRUPT).alias("record"), _cells(schemas[n]).alias("cells"))
        out = bad if out is None else out.unionByName(bad)
    return out


def _read(spark: SparkSession, fmt: str, path: str, schema: T.StructType | None, on_reject: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    rows = _with_rejects(spark, fmt, path, schema)
    if on_reject == "drop":
        rows = rows.where(~_is_bad(schema))
    elif on_reject == "fail":
        # the corrupt record cannot be read alone, so all cells are asked for
        first = rows.agg(F.count(CORRUPT).alias("n"), F.min(CORRUPT).alias("text"), F.max(F.xxhash64(*schema.names))).first()
        if first["n"]:
            raise ValueError(f"{first['n']} malformed records under {path}, such as {first['text'][:200]!r}")
    return rows.drop(CORRUPT)


def missing_extracts(
    spark: SparkSession, root: str, fmt: str = "parquet", names=EXTRACT_NAMES, schemas: Mapping[str, T.StructType] | None = None
) -> list[str]:
    """Names whose folder cannot be read under ``root``."""
    schemas = dict(schemas or extract_schemas())
    out = []
    for n in names:
        try:
            _read(spark, fmt, cache_path(root, n), schemas.get(n), "null")
        except AnalysisException:
            out.append(n)
    return out


def read_extracts(
    spark: SparkSession,
    root: str,
    fmt: str = "parquet",
    schemas: Mapping[str, T.StructType] | None = None,
    names=EXTRACT_NAMES,
    on_reject: str = "fail",
) -> dict[str, DataFrame]:
    """Read cached extracts back; stops naming every missing one.

    CSV and JSON are read with declared schemas (never inferred), so a
    replay yields the same types as the live run.  Malformed records stop the
    replay (``on_reject="fail"``, with their number), keep their other cells
    (``"null"``) or are left out (``"drop"``); ``rejected_records`` lists them.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if on_reject not in ON_REJECT:
        raise ValueError(f"on_reject must be one of {ON_REJECT}")
    schemas = dict(schemas or extract_schemas())
    missing = missing_extracts(spark, root, fmt, names, schemas)
    if missing:
        raise FileNotFoundError(f"missing cached extracts under {root}: {missing}")
    return {n: _read(spark, fmt, cache_path(root, n), schemas.get(n), on_reject) for n in names}
