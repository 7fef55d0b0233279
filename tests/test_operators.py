"""Relational helpers on hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlift.operators import absent_flag, anti_join_null_safe, distinct_counts, left_join_nullable_key
from conftest import SF0001


def _rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_left_join_nullable_key_equals_left_join(spark):
    left = spark.createDataFrame(
        [(None, "a", 1), (None, "b", 2), (1, "c", 3), (2, "d", 4), (None, "a", 1), (3, None, 5)] * 3,
        "k bigint, s string, v int",
    )
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k bigint, r string")
    assert _rows(left_join_nullable_key(left, right, "k")) == _rows(left.join(right, "k", "left"))


def test_null_keys_are_spread_over_partitions(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 8).alias("k"), F.col("id"))
    right = spark.createDataFrame([(0, "x"), (4, "y"), (None, "n")], "k bigint, r string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = left_join_nullable_key(left, right, "k").withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    nulls = [r for r in rows if r.k is None]
    assert len(rows) == 4000 and len(nulls) == 3000 and all(r.r is None for r in nulls)
    assert all(r.r is not None for r in rows if r.k is not None)
    counts = [sum(r.p == p for r in nulls) for p in {r.p for r in nulls}]
    assert len(counts) > 4 and max(counts) < 1000


def test_a_timestamp_fact_is_refused(spark):
    import pytest

    from adlift.sources import fixture_sources

    src = fixture_sources(spark, "/root/testdata/sf0.001")
    noon = src.daily_metrics.withColumn("event_local_dt", F.col("event_local_dt").cast("timestamp"))
    with pytest.raises(ValueError, match="must be a date"):
        src.replace(daily_metrics=noon)


def test_flags_and_anti_join(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k bigint, s string")
    ids = spark.createDataFrame([(1,), (1,), (None,)], "k bigint")
    a = {r.s: r.new for r in absent_flag(df, ids, ["k"], "new").collect()}
    assert a == {"a": False, "b": True, "c": True}
    # set membership: a NULL id removes the NULL key too
    assert sorted(r.s for r in anti_join_null_safe(df, ids, "k").collect()) == ["b"]


def test_distinct_counts_two_step(spark):
    df = spark.createDataFrame(
        [(1, True, False), (1, True, True), (2, False, True), (None, True, True), (3, False, False)],
        "c bigint, x boolean, y boolean",
    )
    got = distinct_counts(df, "c", {"nx": F.col("x"), "ny": F.col("y"), "nxy": F.col("x") & F.col("y")}).first()
    assert (got.nx, got.ny, got.nxy) == (1, 2, 1)


def test_left_join_nullable_key_with_only_the_key_column(spark):
    left = spark.createDataFrame([(None,), (1,), (None,), (2,)], "k bigint").repartition(3)
    right = spark.createDataFrame([(1, "x")], "k bigint, r string")
    assert _rows(left_join_nullable_key(left, right, "k")) == _rows(left.join(right, "k", "left"))


def test_sector_list_and_site_labels_of_the_run_take_effect(spark):
    from dataclasses import replace

    from adlift.config import FIXTURE_CONFIG
    from adlift.plans import kpis, ops, report
    from adlift.plans.extracts import all_extracts
    from adlift.sources import fixture_sources

    src = fixture_sources(spark, SF0001)
    cfg = replace(FIXTURE_CONFIG, non_endemic_verticals=("HOME",), site_labels={"3": "Third"})
    ext = all_extracts(src, cfg)
    for frame in (kpis.kpi_adopter_deltas(ext["arpu"], cfg), kpis.population(ext["aw_denom"], cfg)):
        flags = {r["vertical"]: r["is_endemic"] for r in frame.select("vertical", "is_endemic").distinct().collect()}
        assert flags["HOME"] is False and flags["FINANCIAL_SERVICES"] is True
    base = kpis.kpi_population_totals(ext["aw_denom"], FIXTURE_CONFIG).first()["non_endemic_adv"]
    assert kpis.kpi_population_totals(ext["aw_denom"], cfg).first()["non_endemic_adv"] != base
    bundle = report.parsed_bundle(ext, cfg).where("record_set = 'denom' and vertical = 'HOME'")
    assert {r["is_endemic"] for r in bundle.select("is_endemic").distinct().collect()} == {False}
    labels = {r["site"]: r["site_label"] for r in ops.op_site_label(src, cfg).collect()}
    assert labels["3"] == "Third" and labels["4"] == "4"
