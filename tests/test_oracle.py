"""Every registered query against its DuckDB oracle (the driver's gate)."""

from __future__ import annotations

import pytest
from conftest import SF001, SF0001

import __spark_entry__ as E
from compare import diff, duck

QUERIES = E.queries()
ORACLES = E.oracle_sql()
WITH_ORACLE = sorted(k for k in QUERIES if k in ORACLES)
ROWS_ONLY = sorted(k for k in QUERIES if k not in ORACLES)
EXTRACT_KEYS = ["ext_network_items", "ext_display_population", "ext_adopters", "ext_first_time", "ext_creative_adoption"]


@pytest.fixture(scope="module")
def con0001():
    return duck(SF0001)


@pytest.fixture(scope="module")
def con001():
    return duck(SF001)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", WITH_ORACLE)
def test_query_matches_oracle_sf0001(spark, con0001, key):
    assert diff(QUERIES[key](spark, SF0001), con0001, ORACLES[key]) is None


@pytest.mark.parametrize("key", EXTRACT_KEYS + ["ext_adopters_plain", "ext_first_time_plain", "kpi_adoption_rates"])
def test_extract_matches_oracle_sf001(spark, con001, key):
    assert diff(QUERIES[key](spark, SF001), con001, ORACLES[key]) is None


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_rows_only_queries_run(spark, key):
    df = QUERIES[key](spark, SF0001)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 22
    assert "arpu_delta_pct" in df.columns


def test_fixture_row_counts_sf001(spark):
    expected = {"ext_network_items": 1121, "ext_display_population": 775, "ext_adopters": 153, "ext_first_time": 495,
                "ext_creative_adoption": 892}
    for k, n in expected.items():
        assert QUERIES[k](spark, SF001).count() == n, k
