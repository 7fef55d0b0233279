"""Cohort bit filter and format index."""

from __future__ import annotations

import pytest
from conftest import SF0001
from edge_sources import spark_sources
from pyspark.sql import functions as F
from test_plans import fact_scans, plan_text
from test_stores import _sorted

from adlift.config import FIXTURE_CONFIG as CFG
from adlift.operators import creative_format_items
from adlift.operators.keyfilter import BITS_PER_KEY, LEAST_BITS_PER_KEY, MAX_BITS, filter_bits, key_filter
from adlift.plans import extracts as X
from adlift.plans import prefiltered, stores
from adlift.session import scratch_path
from adlift.sources import fixture_frames, fixture_sources
from adlift.sources.format_index import FormatIndex
from adlift.sources.registry import Sources


@pytest.fixture(scope="module")
def src(spark):
    frames = fixture_frames(spark, SF0001)
    path = scratch_path(spark, "plan-fact")
    frames["daily_metrics"].write.parquet(path)
    frames["daily_metrics"] = spark.read.parquet(path)
    return Sources.from_frames(frames)


def test_filter_size_is_bounded():
    assert filter_bits(0) == 64 and filter_bits(1) == 64
    assert filter_bits(1000) == 1 << 16
    assert all(filter_bits(n) <= MAX_BITS for n in (MAX_BITS // BITS_PER_KEY, MAX_BITS // LEAST_BITS_PER_KEY))
    assert filter_bits(MAX_BITS // LEAST_BITS_PER_KEY + 1) is None


def test_keys_pass_and_most_others_do_not(spark):
    rows = spark.range(100_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("site"), F.when(F.col("id") != 7, F.col("id")).alias("adv")
    )
    keys = rows.where("adv is null or adv % 100 = 0")
    kept = key_filter(keys, scratch_path(spark, "keys")).keep(rows)
    assert kept.columns == ["site", "adv"]
    assert kept.where("adv is null or adv % 100 = 0").count() == 1001
    assert kept.count() < 1001 + 100_000 * 2 / BITS_PER_KEY


def test_no_keys_and_too_many_keys(spark, monkeypatch):
    rows = spark.range(10)
    assert key_filter(rows.where("id < 0"), scratch_path(spark, "keys")).keep(rows).count() == 0
    monkeypatch.setattr("adlift.operators.keyfilter.MAX_BITS", 16)
    open_filter = key_filter(rows, scratch_path(spark, "keys"))
    assert open_filter.words is None and open_filter.keep(rows).count() == 10


def test_same_rows_on_edge_rows(spark):
    edge = spark_sources(spark)
    for name, filtered in (("arpu", prefiltered.prefiltered_adopters), ("nuevos", prefiltered.prefiltered_first_time)):
        assert _sorted(filtered(edge, CFG)) == _sorted(X.EXTRACTS[name](edge, CFG)), name


def test_fewer_rows_are_shuffled(spark, src):
    keep = prefiltered.adopter_filter(src, CFG, scratch_path(spark, "keys"))
    rows = X.adopter_rows(src, CFG)
    assert keep.keep(rows).count() < rows.count() / 2
    assert X.adopter_sums(keep.keep(rows), CFG).count() < X.adopter_sums(rows, CFG).count() / 2


def test_filter_runs_where_the_fact_is_read(spark, src):
    text = plan_text(prefiltered.prefiltered_adopters(src, CFG))
    tree = text[: text.index("(1) ")]
    lines = [x for x in tree.splitlines() if x.strip()]
    # plan trees print the consumer first: below the semi join there is no exchange before the fact's scan
    at = next(i for i, x in enumerate(lines) if "BroadcastHashJoin LeftSemi" in x)
    below = next(i for i in range(at, len(lines)) if "Scan parquet" in lines[i])
    assert not any("Exchange hashpartitioning" in x or x.strip(" :+-*").startswith("Exchange") for x in lines[at:below])
    assert len(fact_scans(text)) == 1


IMAGES = [
    (1, 1, '"[{\\"type\\":\\"iab_picture\\"},{\\"type\\":\\"iab_picture\\"},{\\"type\\":7},{\\"x\\":1},3]"', "encoded_array"),
    (2, 710, '"[{\\"type\\":\\"iab_picture\\"}]"', "encoded_array"),
    (3, None, '"[{\\"type\\":\\"iab_picture\\"}]"', "encoded_array"),
    (4, 4, '[{"type":"iab_picture"}]', "other_json"),
    (5, 5, '"[{\\"type\\":"', "malformed"),
    (6, 6, '"[{\\"type\\":\\"iab_picture\\"}', "malformed"),
    (7, 7, "", "malformed"),
    (8, 8, None, "missing"),
    (9, 9, '"{\\"type\\":\\"iab_picture\\"}"', "other_json"),
    (10, 10, '"[]"', "encoded_array"),
]


def test_format_index_on_odd_json(spark):
    links = [(100 + c, c) for c, *_ in IMAGES] + [(101, 1), (102, 1), (None, 1), (50, None)]
    s = spark_sources(spark).replace(
        creative=spark.createDataFrame([x[:3] for x in IMAGES], "creative_id bigint, advertiser_id bigint, images string"),
        line_item_creative=spark.createDataFrame(links, "line_item_id bigint, creative_id bigint"),
    )
    index = FormatIndex(spark, scratch_path(spark, "format-index")).write(s)
    forms = {r.form: r.n_creatives for r in index.forms().collect()}
    expected = [f for *_, f in IMAGES]
    assert forms == {f: expected.count(f) for f in set(expected)}
    got = {(r.type, r.n_creatives, r.n_line_items) for r in index.formats().collect()}
    assert got == {("iab_picture", 3, 3), ("7", 1, 2)}
    for fmt in ("iab_picture", "7", "none"):
        for out in ((710,), (1, 710)):
            cfg = type(CFG)(CFG.launch_date, CFG.analysis_end, CFG.history_start, creative_format=fmt, excluded_creative_advertisers=out)
            assert _sorted(index.items(fmt, out)) == _sorted(creative_format_items(s, cfg)), (fmt, out)


def test_indexed_adoption_parses_no_json_and_skips_other_formats(spark):
    s = fixture_sources(spark, SF0001)
    index = FormatIndex(spark, scratch_path(spark, "format-index")).write(s)
    items = index.items(CFG.creative_format, CFG.excluded_creative_advertisers)
    df = X.creative_adoption_of(X.creative_active(s, CFG), s, CFG, items)
    text = plan_text(df)
    assert "parse_json" not in text and "get_json_object" not in text
    assert "EqualTo(type,iab_picture)" in text
    assert _sorted(df) == _sorted(X.ext_creative_adoption(s, CFG))


def test_index_of_no_creatives(spark):
    s = fixture_sources(spark, SF0001)
    s = s.replace(creative=s.creative.limit(0))
    assert stores.format_counts(s, CFG).count() == 0 and stores.format_forms(s, CFG).count() == 0
