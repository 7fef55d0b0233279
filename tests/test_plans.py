"""Plan shape: pushed filters, pruned columns, one fact scan per extract,
hash-based aggregation next to the scan, no Python UDF, no cartesian join."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from conftest import SF0001

from adlift.config import FIXTURE_CONFIG as CFG
from adlift.plans import kpis, plain, report
from adlift.plans.extracts import EXTRACTS
from adlift.session import scratch_path
from adlift.sources import fixture_frames
from adlift.sources.registry import Sources

FACT_TAG = "plan-fact"


@pytest.fixture(scope="module")
def src(spark):
    frames = fixture_frames(spark, SF0001)
    path = scratch_path(spark, FACT_TAG)
    frames["daily_metrics"].write.partitionBy("event_local_dt").parquet(path)
    frames["daily_metrics"] = spark.read.parquet(path)
    return Sources.from_frames(frames)


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def fact_scans(text: str) -> list[str]:
    """Detail blocks of the scans of the fact table."""
    blocks = text.split("\n\n")
    return [b for b in blocks if re.match(r"\(\d+\) Scan parquet", b.strip()) and FACT_TAG in b]


@pytest.mark.parametrize("name", list(EXTRACTS))
def test_one_fact_scan_per_extract(src, name):
    assert len(fact_scans(plan_text(EXTRACTS[name](src, CFG)))) == 1


def test_plain_forms_scan_the_fact_several_times(src):
    assert len(fact_scans(plan_text(plain.ext_adopters_plain(src, CFG)))) >= 3
    assert len(fact_scans(plan_text(plain.ext_first_time_plain(src, CFG)))) >= 3


@pytest.mark.parametrize("name", list(EXTRACTS))
def test_date_window_prunes_partitions(src, name):
    scan = fact_scans(plan_text(EXTRACTS[name](src, CFG)))[0]
    assert "PartitionFilters: [" in scan
    pf = re.search(r"PartitionFilters: \[(.*)\]", scan).group(1)
    assert "event_local_dt" in pf and ">=" in pf and "<=" in pf


def test_scope_filters_pushed_and_columns_pruned(src):
    scan = fact_scans(plan_text(EXTRACTS["aw_denom"](src, CFG)))[0]
    pushed = re.search(r"PushedFilters: \[(.*)\]", scan).group(1)
    assert "EqualTo(campaign_type,PROGRAMMATIC)" in pushed
    assert "EqualTo(product_type,DSP_SELFSERVICE)" in pushed
    assert "GreaterThan(cost_usd,0.0)" in pushed
    schema = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
    for unused in ("prints_qty", "clicks_qty", "campaign_id", "line_item_id"):
        assert unused not in schema


def _tree(text: str) -> list[str]:
    return text.split("\n\n")[0].splitlines()


@pytest.mark.parametrize("name", list(EXTRACTS))
def test_aggregate_next_to_the_scan_is_hash_based(src, name):
    """Between the fact scan and the first exchange there is no sort: the
    partial aggregate over every fact row is hash-based."""
    text = plan_text(EXTRACTS[name](src, CFG))
    scan_id = re.match(r"\((\d+)\)", fact_scans(text)[0].strip()).group(1)
    lines = _tree(text)
    idx = next(i for i, line in enumerate(lines) if re.search(rf"Scan parquet\s+\({scan_id}\)", line))
    indent = len(lines[idx]) - len(lines[idx].lstrip(" :|+-"))
    chain = []
    for line in reversed(lines[:idx]):
        ind = len(line) - len(line.lstrip(" :|+-"))
        if ind < indent:
            chain.append(line.strip(" :|+-"))
            indent = ind
            if line.strip(" :|+-").startswith("Exchange"):
                break
    assert any(c.startswith("HashAggregate") for c in chain), chain
    assert not any(c.startswith(("Sort ", "SortAggregate")) for c in chain), chain


def _all_outputs(src):
    ext = {k: f(src, CFG) for k, f in EXTRACTS.items()}
    e, d, a, n, i = ext["enet"], ext["aw_denom"], ext["arpu"], ext["nuevos"], ext["iab"]
    return {
        **ext,
        "kpi_adoption_rates": kpis.kpi_adoption_rates(e, d),
        "kpi_nonendemic_adoption": kpis.kpi_nonendemic_adoption(a, d),
        "kpi_nonendemic_opportunity": kpis.kpi_nonendemic_opportunity(a, d),
        "kpi_creative_adoption": kpis.kpi_creative_adoption(i),
        "kpi_advertiser_summary": kpis.kpi_advertiser_summary(e),
        "top_endemic_adopters": report.top_endemic_adopters(a, CFG),
        "list_first_time_adx": report.list_first_time_adx(n),
        "bundle": report.report_bundle(ext, CFG),
    }


def test_no_python_udf_and_no_cartesian_join(src):
    for name, df in _all_outputs(src).items():
        text = plan_text(df)
        for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "InPandas", "CartesianProduct",
                    "BroadcastNestedLoopJoin"):
            assert bad not in text, (name, bad)


def test_top_n_is_take_ordered(src):
    text = plan_text(report.top_endemic_adopters(EXTRACTS["arpu"](src, CFG), CFG))
    assert "TakeOrderedAndProject" in text


def test_creative_adoption_counts_without_expand(src):
    text = plan_text(kpis.kpi_creative_adoption(EXTRACTS["iab"](src, CFG)))
    assert "Expand" not in text


def test_population_is_aggregated_once(src):
    ext = {k: EXTRACTS[k](src, CFG) for k in ("enet", "aw_denom", "arpu")}
    for df in (kpis.kpi_adoption_rates(ext["enet"], ext["aw_denom"]), kpis.kpi_nonendemic_adoption(ext["arpu"], ext["aw_denom"])):
        assert len(fact_scans(plan_text(df))) == 2


def test_volume_counts_without_expand(src):
    text = plan_text(kpis.kpi_volume_by_inventory(EXTRACTS["enet"](src, CFG)))
    assert "Expand" not in text and "SortAggregate" not in text
