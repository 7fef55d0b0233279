"""Daily fold store: the fact reduced once per day, kept and extended.

Every extract is a sum or a maximum over fact rows of some days, scopes and
channels, so the fact can be folded day by day, before any launch date is
known.  ``daily_fold`` keeps, per day and (site, advertiser, name, vertical,
campaign, line item, target, scope, paid), sums of cost, prints and clicks by
channel.  All measures are additive: a window is the sum of its days.

* Rows that are neither of the display scope nor of positive cost serve no
  extract and are left out; rows of positive cost outside the scope stay (the
  first-timer extract has no scope), and rows without positive cost inside it
  (the before / after sums of adopters count adjustments).
* Names, verticals and campaigns are asked of paid display rows only, targets of
  display rows only; elsewhere they are NULL, which keeps the fold small.

``FoldStore`` keeps the fold as Parquet, a folder for each day.  ``refresh``
reads the fact for days that the store lacks, for the last ``late_days`` days of
the range, and for days given as ``restate``, and overwrites just these folders.
A marker row in each folder says that the day was folded, so a day without rows
is known, and a day that lost its rows is emptied.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import any_flag, cond_sum
from ..operators.scope import DATE_COL, display_scope, in_window, is_offsite, is_onsite, positive_cost
from .registry import Sources

KEYS = (
    DATE_COL, "site", "advertiser_id", "advertiser_name", "vertical", "campaign_id", "line_item_id", "campaign_target",
    "in_scope", "paid",
)
#: sums; cost_on is NULL without an on-site row, cost_in then 0
MEASURES = ("cost", "cost_off", "cost_in", "cost_on", "prints", "prints_off", "prints_in", "clicks", "has_off")
MARKER = "is_marker"


def daily_fold(fact: DataFrame) -> DataFrame:
    """The fact's rows folded per day (see the module's text)."""
    scope, paid = F.coalesce(display_scope(), F.lit(False)), F.coalesce(positive_cost(), F.lit(False))
    cost, prints = F.col("cost_usd"), F.col("prints_qty")
    both = scope & paid
    return fact.where(scope | paid).groupBy(
        DATE_COL,
        "site",
        "advertiser_id",
        F.when(both, F.col("advertiser_name")).alias("advertiser_name"),
        F.when(both, F.col("vertical")).alias("vertical"),
        F.when(both, F.col("campaign_id")).alias("campaign_id"),
        "line_item_id",
        F.when(scope, F.col("campaign_target")).alias("campaign_target"),
        scope.alias("in_scope"),
        paid.alias("paid"),
    ).agg(
        F.sum(cost).alias("cost"),
        cond_sum(is_offsite(), cost).alias("cost_off"),
        cond_sum(is_onsite(), cost).alias("cost_in"),
        F.sum(F.when(is_onsite(), cost)).alias("cost_on"),
        F.sum(prints).alias("prints"),
        cond_sum(is_offsite(), prints).alias("prints_off"),
        cond_sum(is_onsite(), prints).alias("prints_in"),
        F.sum("clicks_qty").alias("clicks"),
        any_flag(is_offsite()).alias("has_off"),
    )


def _ranges(days: Iterable[date]) -> list[tuple[date, date]]:
    """Days as inclusive ranges, ascending."""
    out: list[tuple[date, date]] = []
    for d in sorted(set(days)):
        if out and out[-1][1] + timedelta(days=1) == d:
            out[-1] = (out[-1][0], d)
        else:
            out.append((d, d))
    return out


def of_days(days: Iterable[date]) -> Column:
    """The rows of some days: one comparison of bounds for each range, which
    prunes the partitions of the fact."""
    return reduce(lambda x, y: x | y, [in_window(a, b) for a, b in _ranges(days)], F.lit(False))


class FoldStore:
    """A fold per day under ``root`` (a shared folder)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self) -> DataFrame | None:
        try:
            # the types come from the files, the day's from the folder names
            rows = self.spark.read.option("mergeSchema", "false").parquet(self.root)
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return rows.withColumn(DATE_COL, F.col(DATE_COL).cast(T.DateType()))

    def days(self) -> list[date]:
        """The days folded so far, ascending: those with a folder, as each one
        holds a marker at least.  A listing, no job."""
        rows = self._read()
        found = re.findall(rf"/{DATE_COL}=(\d{{4}}-\d\d-\d\d)/", "\n".join(rows.inputFiles()) if rows is not None else "")
        return sorted({date.fromisoformat(d) for d in found})

    def due(self, start: date, end: date, late_days: int = 0, restate: Iterable[date] = ()) -> list[date]:
        """The days of ``start .. end`` that a refresh would fold."""
        every = [start + timedelta(days=i) for i in range((end - start).days + 1)]
        have, again = set(self.days()), set(restate)
        late = set(every[len(every) - late_days :]) if late_days else set()
        return [d for d in every if d not in have or d in again or d in late]

    def refresh(self, src: Sources, start: date, end: date, late_days: int = 0, restate: Iterable[date] = ()) -> list[date]:
        """Fold the days that are due, in one scan of the fact, and return them."""
        days = self.due(start, end, late_days, restate)
        if days:
            self.folded(src, days).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE_COL).parquet(self.root)
        return days

    def folded(self, src: Sources, days: list[date]) -> DataFrame:
        """The rows that a refresh of these days writes."""
        rows = daily_fold(src.daily_metrics.where(of_days(days))).withColumn(MARKER, F.lit(False))
        marks = self.spark.createDataFrame([(d,) for d in days], f"{DATE_COL} date").withColumn(MARKER, F.lit(True))
        # few files for each day; a day of many rows is split
        return rows.unionByName(marks, allowMissingColumns=True).hint("rebalance", DATE_COL)

    def read(self, start: date, end: date) -> DataFrame:
        """The fold of ``start .. end``; every day must have been folded."""
        have = set(self.days())
        lacking = [d for d in (start + timedelta(days=i) for i in range((end - start).days + 1)) if d not in have]
        if lacking:
            raise ValueError(f"{len(lacking)} days are not folded under {self.root}, from {lacking[0]} on")
        rows = self._read()
        if rows is None:
            raise ValueError(f"nothing is folded under {self.root}")
        return rows.where(~F.col(MARKER) & in_window(start, end)).drop(MARKER)
