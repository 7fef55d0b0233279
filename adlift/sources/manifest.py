"""The manifest of an extract cache: what a replay must find.

A cache is several folders, so it can be half written, belong to another run, or
be changed afterwards.  The manifest (a JSON line per extract in the folder
``manifest`` beside them) records the settings the extracts depend on, each
extract's schema, row count and files with their sizes.  It is marked unfinished
before the first extract is written, and replaced by the finished one last, as a
single file that the committer renames into place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LaunchConfig
from .cache import cache_path
from .schemas import EXTRACT_NAMES

FIELDS = (
    "extract string, format string, finished boolean, config string, config_hash string, n_rows bigint, "
    "columns string, files array<struct<name: string, bytes: bigint>>"
)
FOLDER = "manifest"


class ReplayRefused(ValueError):
    """A cache that is not the finished, unchanged cache of this run."""


def config_text(cfg: LaunchConfig) -> str:
    """The settings that the extracts depend on, as JSON with sorted keys."""
    return json.dumps(cfg.extract_record(), sort_keys=True)


def config_hash(cfg: LaunchConfig) -> str:
    return hashlib.sha256(config_text(cfg).encode()).hexdigest()


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the data files of one extract (not their content)."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    return sorted((r["path"].rsplit("/", 1)[1], int(r["length"])) for r in rows)


def _write(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    df = spark.createDataFrame(rows, FIELDS).coalesce(1)
    df.write.mode("overwrite").option("ignoreNullFields", False).json(cache_path(root, FOLDER))


def begin(spark: SparkSession, root: str, fmt: str, cfg: LaunchConfig, names=EXTRACT_NAMES) -> None:
    """Mark the cache as unfinished; called before anything is overwritten."""
    _write(spark, root, [(n, fmt, False, config_text(cfg), config_hash(cfg), None, None, []) for n in names])


def publish(spark: SparkSession, root: str, fmt: str, cfg: LaunchConfig, schemas: Mapping[str, str], rows: Mapping[str, int]) -> None:
    """Record the written extracts; called last.  ``schemas`` are the simple
    strings of the extracts' types."""
    out = []
    for name in schemas:
        files = files_of(spark, cache_path(root, name))
        out.append((name, fmt, True, config_text(cfg), config_hash(cfg), int(rows[name]), schemas[name], files))
    _write(spark, root, out)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row per extract; refused if there is none."""
    try:
        rows = spark.read.schema(FIELDS).json(cache_path(root, FOLDER))
        empty = rows.isEmpty()
    except AnalysisException:
        empty = True
    if empty:
        raise ReplayRefused(f"no manifest under {root}: half written, or not written by this library")
    return rows


def check(spark: SparkSession, root: str, fmt: str, cfg: LaunchConfig, extracts: Mapping[str, DataFrame]) -> dict[str, int]:
    """Refuse a cache that is unfinished, of other settings or changed, with
    every reason; else the recorded row counts."""
    recorded = {r["extract"]: r for r in read_manifest(spark, root).collect()}
    reasons, mine = [], cfg.extract_record()
    for name, df in extracts.items():
        r = recorded.get(name)
        if r is None:
            reasons.append(f"{name}: not in the manifest")
            continue
        if not r["finished"]:
            reasons.append(f"{name}: half written")
            continue
        theirs = json.loads(r["config"])
        other = sorted(k for k in {*mine, *theirs} if mine.get(k) != theirs.get(k))
        if other:
            reasons.append(f"{name}: of another run ({', '.join(f'{k} {theirs.get(k)!r}, asked {mine.get(k)!r}' for k in other)})")
        if r["format"] != fmt:
            reasons.append(f"{name}: written as {r['format']}, asked as {fmt}")
            continue
        if r["columns"] != df.schema.simpleString():
            reasons.append(f"{name}: columns {df.schema.simpleString()}, written {r['columns']}")
        then, now = {(f["name"], f["bytes"]) for f in r["files"]}, set(files_of(spark, cache_path(root, name)))
        if then != now:
            changed = sorted({n for n, _ in then ^ now})
            reasons.append(f"{name}: {len(changed)} files changed, added or gone, first {changed[0]}")
    if reasons:
        raise ReplayRefused(f"cache under {root} refused: " + "; ".join(reasons))
    return {name: int(recorded[name]["n_rows"]) for name in extracts}


def manifest_table(spark: SparkSession, root: str) -> DataFrame:
    """The manifest for reports: files as their number and bytes."""
    return read_manifest(spark, root).select(
        "extract", "format", "finished", "config_hash", "n_rows", "columns",
        F.size("files").cast("bigint").alias("n_files"),
        F.aggregate("files", F.lit(0).cast("bigint"), lambda a, f: a + f["bytes"]).alias("bytes"),
    )
