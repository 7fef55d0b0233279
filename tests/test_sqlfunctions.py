"""The extracts as SQL table functions."""

from __future__ import annotations

import re

import pytest
from conftest import SF0001
from edge_sources import spark_sources
from test_plans import fact_scans, plan_text
from test_stores import _sorted

from adlift.config import FIXTURE_CONFIG as CFG
from adlift.plans import sqlfunctions as Q
from adlift.plans.extracts import EXTRACTS
from adlift.session import scratch_path
from adlift.sources import fixture_frames
from adlift.sources.registry import Sources


@pytest.fixture(scope="module")
def src(spark):
    frames = fixture_frames(spark, SF0001)
    path = scratch_path(spark, "plan-fact")
    frames["daily_metrics"].write.partitionBy("event_local_dt").parquet(path)
    frames["daily_metrics"] = spark.read.parquet(path)
    return Sources.from_frames(frames)


@pytest.mark.parametrize("name", list(EXTRACTS))
def test_functions_equal_the_dataframe_forms_on_edge_rows(spark, name):
    edge = spark_sources(spark)
    Q.register(spark, edge, "edge")
    got, live = Q.call(spark, name, CFG, "edge"), EXTRACTS[name](edge, CFG)
    assert _sorted(got) == _sorted(live)
    assert [(c, t) for c, t in got.dtypes] == [(c, t) for c, t in live.dtypes]


@pytest.mark.parametrize("name", list(EXTRACTS))
def test_one_scan_with_pruned_days(spark, src, name):
    Q.register(spark, src, "pruned")
    scans = fact_scans(plan_text(Q.call(spark, name, CFG, "pruned")))
    assert len(scans) == 1
    days = re.search(r"PartitionFilters: \[(.*)\]", scans[0]).group(1)
    assert "event_local_dt" in days and ">=" in days and "<=" in days


def test_a_filter_on_the_result_reaches_the_reader(spark, src):
    Q.register(spark, src, "narrow")
    df = spark.sql("SELECT campaign_id, rev_off FROM narrow_network_items(:a, :b) WHERE site = 3", args={"a": CFG.launch_date, "b": CFG.analysis_end})
    scan = fact_scans(plan_text(df))[0]
    assert "EqualTo(site,3)" in scan and "clicks_qty" not in scan and "prints_qty" not in scan


def test_prefix_is_a_name(spark, src):
    with pytest.raises(ValueError):
        Q.register(spark, src, "x; DROP")
