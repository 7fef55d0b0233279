"""The Spark and DuckDB texts of the fixture mapping give the same tables."""

from __future__ import annotations

import pytest
from compare import diff, duck
from conftest import SF0001

from adlift.sources import FIXTURE_CTES, fixture_frames
from adlift.sources.registry import Sources


@pytest.fixture(scope="module")
def frames(spark):
    return fixture_frames(spark, SF0001)


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", Sources.names())
def test_fixture_table_matches_duckdb(frames, con, name):
    assert diff(frames[name], con, f"{FIXTURE_CTES}\nSELECT * FROM {name}") is None
