"""Daily fold, cache manifest, reject channel, id sets and bucketed tables."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from compare import rows_of_spark
from conftest import SF0001
from edge_sources import spark_sources
from pyspark.sql import functions as F
from test_plans import plan_text

from adlift.config import FIXTURE_CONFIG, LaunchConfig
from adlift.operators.idsets import compared, id_codes, id_sets, merged, sizes, with_code
from adlift.plans import folded, kpis, report
from adlift.plans.extracts import EXTRACTS, all_extracts
from adlift.session import scratch_path
from adlift.sources import FoldStore, ReplayRefused, Sources, fixture_frames, read_extracts, rejected_records, write_extracts
from adlift.sources.bucketed import bucketed_left_join, read_bucketed, write_bucketed
from adlift.sources.manifest import check, read_manifest

#: a short history keeps the number of day folders small
CFG = LaunchConfig("1999-07-01", "1999-07-14", "1999-06-10", min_spend=100)


def _sorted(df):
    cols, data = rows_of_spark(df)
    return cols, sorted(data, key=repr)


@pytest.fixture(scope="module")
def src(spark):
    frames = fixture_frames(spark, SF0001)
    path = scratch_path(spark, "fold-fact")
    frames["daily_metrics"].where(F.col("event_local_dt").between("1999-06-01", "1999-07-20")).write.partitionBy("event_local_dt").parquet(path)
    frames["daily_metrics"] = spark.read.parquet(path)
    return Sources.from_frames(frames)


def _same_extracts(fold, src, cfg):
    for name, df in folded.extracts_from(fold, src, cfg).items():
        live = EXTRACTS[name](src, cfg)
        assert _sorted(df) == _sorted(live), name
        assert df.dtypes == live.dtypes, name


def test_extracts_from_the_fold(spark, src):
    fold, days = folded.refreshed(src, CFG, scratch_path(spark, "fold"))
    assert len(days) == 35
    assert fold.agg(F.max("paid").alias("p"), F.min("in_scope").alias("s")).first().p is True
    _same_extracts(fold, src, CFG)


def test_edge_rows_from_the_fold(spark):
    cfg = LaunchConfig(FIXTURE_CONFIG.launch_date, date(1999, 7, 20), date(1999, 6, 20), min_spend=100)
    edge = spark_sources(spark)
    _same_extracts(folded.refreshed(edge, cfg, scratch_path(spark, "edge-fold"))[0], edge, cfg)


def test_refresh_reads_only_days_that_are_due(spark, src):
    store = FoldStore(spark, scratch_path(spark, "fold-days"))
    first, last = date(1999, 6, 25), date(1999, 7, 2)
    assert store.days() == []
    assert len(store.refresh(src, first, last - timedelta(days=1))) == 7
    assert store.refresh(src, first, last) == [last]
    assert store.refresh(src, first, last) == []
    assert store.due(first, last, late_days=2) == [last - timedelta(days=1), last]
    text = plan_text(store.folded(src, [date(1999, 6, 28), date(1999, 6, 29), date(1999, 7, 2)]))
    scans = [b for b in text.split("\n\n") if "fold-fact" in b]
    assert len(scans) == 1 and "PartitionFilters" in scans[0] and "1999-06-28" in scans[0] and "1999-07-02" in scans[0]
    with pytest.raises(ValueError, match="not folded"):
        store.read(first, last + timedelta(days=1))


def test_extracts_of_a_fold_do_not_scan_the_fact(spark, src):
    fold, _ = folded.refreshed(src, CFG, scratch_path(spark, "fold-plan"))
    for name, df in folded.extracts_from(fold, src, CFG).items():
        text = plan_text(df)
        assert "fold-fact" not in text, name
        assert text.count("fold-plan") == 1, name


def test_late_rows_and_a_day_that_loses_its_rows(spark, src):
    root = scratch_path(spark, "fold-late")
    folded.refreshed(src, CFG, root)
    fact = src.daily_metrics
    late, gone = date(1999, 6, 20), date(1999, 7, 5)
    extra = fact.where(F.col("event_local_dt") == "1999-07-07").withColumn("event_local_dt", F.lit(late))
    changed = src.replace(daily_metrics=fact.where(F.col("event_local_dt") != F.lit(gone)).unionByName(extra))
    fold, days = folded.refreshed(changed, CFG, root, restate=[late, gone])
    assert days == [late, gone]
    assert fold.where(F.col("event_local_dt") == F.lit(gone)).isEmpty() and gone in FoldStore(spark, root).days()
    _same_extracts(fold, changed, CFG)


@pytest.fixture(scope="module")
def run(spark, src):
    out = scratch_path(spark, "stores-run")
    return report.run_report(src, CFG, out), out


def test_replay_of_its_own_run(spark, src, run):
    live, out = run
    again = report.run_report(src, CFG, scratch_path(spark, "stores-replay"), replay_from=f"{out}/extracts")
    assert again["rows"] == live["rows"] and len(live["folded"]) == 35 and again["folded"] == []
    a, b = (spark.read.json(r["paths"]["kpi_endemic_arpu"]).collect() for r in (live, again))
    assert a == b
    # settings that only change the tables do not make it another run
    other = LaunchConfig("1999-07-01", "1999-07-14", "1999-06-10", min_spend=100, cannibalisation_pct=-1.0)
    ext = read_extracts(spark, f"{out}/extracts")
    assert check(spark, f"{out}/extracts", "parquet", other, ext) == live["rows"]


def test_replay_refuses_another_run(spark, src, run):
    for cfg, field in ((LaunchConfig("1999-07-01", "1999-07-13", "1999-06-10", min_spend=100), "analysis_end"), (LaunchConfig("1999-07-01", "1999-07-14", "1999-06-10", min_spend=5), "min_spend")):
        with pytest.raises(ReplayRefused, match=field):
            report.run_report(src, cfg, scratch_path(spark, "x"), replay_from=f"{run[1]}/extracts")


def test_replay_refuses_half_written_and_changed_caches(spark, src):
    from adlift.sources import manifest

    live = all_extracts(src, CFG)
    root = scratch_path(spark, "half-cache")
    write_extracts(live, root)
    with pytest.raises(ReplayRefused, match="no manifest"):
        report.run_report(src, CFG, scratch_path(spark, "x"), replay_from=root)
    manifest.begin(spark, root, "parquet", CFG)
    with pytest.raises(ReplayRefused, match="half written"):
        report.run_report(src, CFG, scratch_path(spark, "x"), replay_from=root)
    back = read_extracts(spark, root)
    manifest.publish(spark, root, "parquet", CFG, {n: df.schema.simpleString() for n, df in back.items()}, {n: df.count() for n, df in back.items()})
    assert check(spark, root, "parquet", CFG, back)["arpu"] == live["arpu"].count()
    assert {r.extract for r in read_manifest(spark, root).collect()} == set(live)
    live["arpu"].limit(1).write.mode("append").parquet(f"{root}/arpu")
    with pytest.raises(ReplayRefused, match="arpu: 1 files changed"):
        report.run_report(src, CFG, scratch_path(spark, "x"), replay_from=root)
    with pytest.raises(ReplayRefused, match="columns"):
        check(spark, root, "parquet", CFG, {"arpu": back["arpu"].drop("site")})


def test_rejected_cells_are_counted(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text('id,flag,name\n1,true,a\n12x,true,b\n3,maybe,"c, ""d"""\n4,false,\\N\n5,true\n6,true,"","more"\n')
    schema = spark.createDataFrame([], "id bigint, flag boolean, name string").schema
    args = (spark, str(tmp_path), "csv", {"x": schema}, ("x",))
    with pytest.raises(ValueError, match="4 malformed records"):
        read_extracts(*args)
    kept = {tuple(r) for r in read_extracts(*args, on_reject="null")["x"].collect()}
    assert {(1, True, "a"), (None, True, "b"), (3, None, 'c, "d"'), (4, False, None)} < kept and len(kept) == 6
    assert {tuple(r) for r in read_extracts(*args, on_reject="drop")["x"].collect()} == {(1, True, "a"), (4, False, None)}
    bad = rejected_records(*args).collect()
    assert sorted(r.record.split(",")[0] for r in bad) == ["12x", "3", "5", "6"] and all(r.cells for r in bad)
    assert rejected_records(*args).select("extract").count() == 4


def test_csv_records_are_lines(spark, tmp_path):
    texts = ["a\nb", "\r\n", "\\", "\\n", "\\N", "", None, ' "q", ', "tail\\", "\\b\\r"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    write_extracts({"x": df.coalesce(1)}, str(tmp_path), "csv")
    lines = sum(len(f.read_bytes().splitlines()) for f in (tmp_path / "x").glob("part-*"))
    assert lines == len(texts) + 1
    back = read_extracts(spark, str(tmp_path), "csv", {"x": df.schema}, ("x",))["x"]
    assert sorted(map(tuple, back.collect())) == list(enumerate(texts))
    # a file is read by several tasks
    many = spark.range(4000).selectExpr("id AS k", "concat('line\n', id) AS t").coalesce(1)
    write_extracts({"y": many}, str(tmp_path), "csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        back = read_extracts(spark, str(tmp_path), "csv", {"y": many.schema}, ("y",), on_reject="drop")["y"]
        assert back.rdd.getNumPartitions() > 3 and back.where("t = concat('line\n', k)").count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_id_sets_count_and_merge(spark):
    rows = [(d, i) for d in range(5) for i in range(d * 10, d * 10 + 25)] + [(0, None), (6, None)]
    ids = spark.createDataFrame(rows, "day long, id long").repartition(4)
    codes = id_codes(ids.select("id").where("day < 3"), scratch_path(spark, "codes"))
    more = id_codes(ids.select("id"), scratch_path(spark, "codes"), codes)
    old = {r.id: r.code for r in codes.collect()}
    new = {r.id: r.code for r in more.collect()}
    assert set(new) == set(range(65)) and len(set(new.values())) == 65 and all(new[k] == v for k, v in old.items())
    sets = id_sets(with_code(ids, more, "id", "code"), ["day"])
    assert {r.day: r.n for r in sizes(sets, ["day"]).collect()} == {d: 25 for d in range(5)}
    half = merged(sets.withColumn("half", F.col("day") > 1), ["half"])
    assert {r.half: r.n for r in sizes(half, ["half"]).collect()} == {False: 35, True: 45}
    r = compared(sets.withColumn("all", F.lit(1)), ["all"], F.col("day") <= 1, F.col("day") >= 1).first()
    assert tuple(r)[1:] == (35, 55, 25, 10, 30)
    assert compared(sets, [], F.col("day") == 9, F.col("day") == 8).first().n_left is None


def test_volume_reads_its_extract_once(spark, src):
    path = scratch_path(spark, "volume-items")
    EXTRACTS["enet"](src, CFG).write.parquet(path)
    text = plan_text(kpis.kpi_volume_by_inventory(spark.read.parquet(path)))
    assert text.count("volume-items") == 1 and "Expand" not in text and "SortAggregate" not in text


def test_bucketed_join_has_no_exchange(spark):
    left = spark.createDataFrame([(i % 50 if i % 3 else None, i) for i in range(200)], "k bigint, v long")
    right = spark.createDataFrame([(i, f"t{i}") for i in range(0, 60, 2)] + [(None, "never")], "k bigint, t string")
    for name, df in (("stores_left", left), ("stores_right", right)):
        write_bucketed(df, name, "k", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = bucketed_left_join(spark, "stores_left", "stores_right", "k")
        text = plan_text(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert "Exchange" not in plan_text(spark.table("stores_left").groupBy("k").agg(F.sum("v").alias("v")).join(spark.table("stores_right"), "k", "left"))
        assert _sorted(joined) == _sorted(left.join(right, "k", "left"))
        assert _sorted(read_bucketed(spark, "stores_left")) == _sorted(left)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        for name in ("stores_left", "stores_right"):
            spark.sql(f"DROP TABLE {name}")
            spark.sql(f"DROP TABLE {name}__unkeyed")
