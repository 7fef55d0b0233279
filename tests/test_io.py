"""Extract cache (Parquet / CSV / JSON replay), JSON records, report bundle,
and the whole job end to end."""

from __future__ import annotations

import json

import pytest
from compare import rows_of_spark
from conftest import SF0001

from adlift.config import FIXTURE_CONFIG as CFG
from adlift.plans import report
from adlift.plans.extracts import all_extracts
from adlift.session import scratch_path
from adlift.sources import extract_schemas, fixture_sources, read_extracts, write_extracts
from edge_sources import spark_sources


def _sorted(df):
    cols, data = rows_of_spark(df)
    return cols, sorted(data, key=repr)


@pytest.fixture(scope="module")
def edge_extracts(spark):
    return all_extracts(spark_sources(spark), CFG)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_replay_gives_the_same_rows(spark, edge_extracts, fmt):
    root = scratch_path(spark, f"replay-{fmt}")
    write_extracts(edge_extracts, root, fmt=fmt)
    back = read_extracts(spark, root, fmt=fmt, schemas=extract_schemas())
    for name, df in edge_extracts.items():
        assert _sorted(back[name]) == _sorted(df), name
        assert back[name].schema.simpleString() == df.schema.simpleString(), name


def test_replay_names_every_missing_extract(spark, edge_extracts):
    root = scratch_path(spark, "replay-missing")
    write_extracts({"enet": edge_extracts["enet"]}, root)
    with pytest.raises(FileNotFoundError) as e:
        read_extracts(spark, root)
    for name in ("aw_denom", "arpu", "nuevos", "iab"):
        assert name in str(e.value)


def test_json_records_keep_null_fields(spark, edge_extracts):
    recs = report.json_records(edge_extracts["arpu"], ["advertiser_id", "advertiser_name", "missing_col"])
    rows = [json.loads(r.record) for r in recs.collect()]
    assert all(set(r) == {"advertiser_id", "advertiser_name"} for r in rows)
    assert any(r["advertiser_id"] is None for r in rows)


def test_bundle_written_per_record_set(spark, edge_extracts):
    out = scratch_path(spark, "bundle")
    report.write_report_bundle(report.report_bundle(edge_extracts, CFG), out)
    back = spark.read.text(out)
    counts = {r.record_set: r["count"] for r in back.groupBy("record_set").count().collect()}
    assert counts["config"] == 1
    assert counts["arpu"] == edge_extracts["arpu"].count()
    assert counts["nuevos"] == edge_extracts["nuevos"].count()
    cfg = json.loads(back.where("record_set = 'config'").first().value)
    assert cfg["oo_start"] == "1999-07-01" and cfg["non_endemic"] == sorted(cfg["non_endemic"])
    enet = [json.loads(r.value) for r in back.where("record_set = 'enet'").collect()]
    assert all("inv_setting" in r and "raw_inventory" not in r for r in enet)


def test_run_report_end_to_end(spark):
    out = scratch_path(spark, "report")
    result = report.run_report(fixture_sources(spark, SF0001), CFG, out)
    paths = result["paths"]
    assert result["rows"] == {"enet": 138, "aw_denom": 96, "arpu": 22, "nuevos": 50, "iab": 111}
    assert spark.read.json(paths["kpi_first_time_counts"]).count() == 1
    assert spark.read.json(paths["top_endemic_adopters"]).count() <= 15
    assert spark.read.parquet(f"{paths['extracts']}/arpu").count() == 22
    assert spark.read.text(paths["bundle"]).where("record_set = 'config'").count() == 1


def test_cli_run_and_replay(spark):
    from adlift.cli import main
    from adlift.sources import fixture_frames

    root = scratch_path(spark, "cli-sources")
    for name, df in fixture_frames(spark, SF0001).items():
        df.write.parquet(f"{root}/{name}")
    dates = ["--launch", "1999-07-01", "--end", "1999-12-31", "--history-start", "1998-07-01"]
    out = scratch_path(spark, "cli-run")
    live = main(dates + ["--sources-root", root, "--out", out, "--cache-format", "csv"])
    assert live["rows"]["arpu"] == 22
    again = main(dates + ["--from-cache", live["paths"]["extracts"], "--out", scratch_path(spark, "cli-replay"),
                          "--cache-format", "csv"])
    a = spark.read.json(live["paths"]["kpi_endemic_arpu"]).collect()
    b = spark.read.json(again["paths"]["kpi_endemic_arpu"]).collect()
    assert a == b
    with pytest.raises(FileNotFoundError):
        main(dates + ["--from-cache", scratch_path(spark, "nothing"), "--out", scratch_path(spark, "cli-x")])


def test_csv_keeps_a_text_that_looks_like_the_null_marker(spark, tmp_path):
    from adlift.sources.cache import read_extracts, write_extracts

    df = spark.createDataFrame([(1, "\\N"), (2, None), (3, ""), (4, "\\\\N"), (5, "a\\b")], "k int, t string")
    write_extracts({"x": df}, str(tmp_path), "csv")
    back = read_extracts(spark, str(tmp_path), "csv", {"x": df.schema}, ("x",))["x"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
