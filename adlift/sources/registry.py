"""The set of source tables an analysis reads."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .schemas import SOURCE_COLUMNS


@dataclass(frozen=True)
class Sources:
    """Lazy DataFrames of the nine source tables.

    ``daily_metrics`` is the fact (one row per day x line item x page at
    least); the others are dimensions and link tables.  In production the
    fact is stored partitioned by ``event_local_dt`` so every date window
    prunes partitions; nothing here assumes it fits anywhere.
    """

    daily_metrics: DataFrame
    line_item: DataFrame
    line_item_master: DataFrame
    line_item_creative_rel: DataFrame
    creative_history: DataFrame
    destination: DataFrame
    advertiser: DataFrame
    creative: DataFrame
    line_item_creative: DataFrame

    @classmethod
    def names(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Sources:
        missing = [n for n in cls.names() if n not in frames]
        if missing:
            raise ValueError(f"missing source tables: {missing}")
        src = cls(**{n: frames[n] for n in cls.names()})
        src.validate()
        return src

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: Mapping[str, str]) -> Sources:
        """Catalog tables, e.g. ``{"daily_metrics": "db.metrics_daily", ...}``."""
        return cls.from_frames({n: spark.table(t) for n, t in tables.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Sources:
        """One Parquet folder per source under ``root`` (``root/<name>``)."""
        return cls.from_frames({n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in cls.names()})

    def validate(self) -> None:
        """Fail early (at plan time) when a source lacks a column, or the
        fact's day is not a date (a timestamp would lose its last day)."""
        problems = []
        for name in self.names():
            have = set(getattr(self, name).columns)
            lacking = [c for c in SOURCE_COLUMNS[name] if c not in have]
            if lacking:
                problems.append(f"{name}: {lacking}")
        if problems:
            raise ValueError("sources lack columns: " + "; ".join(problems))
        day = self.daily_metrics.schema["event_local_dt"].dataType
        if not isinstance(day, T.DateType):
            raise ValueError(f"daily_metrics.event_local_dt must be a date, not {day.simpleString()}: cast it with to_date")

    def replace(self, **frames: DataFrame) -> Sources:
        cur = {n: getattr(self, n) for n in self.names()}
        cur.update(frames)
        return Sources.from_frames(cur)
