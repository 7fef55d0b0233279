"""The pipeline over a small whole input, stage by stage."""

import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from adlift.llm import mixing, ngram_join
from adlift.llm.common import WORD_BPE, stored
from adlift.llm.components import components as components_of

from .test_operators import components, split

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "decontaminate", "mix", "token_ids"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count()
    before, after = ([(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in stages[1][1:])
    _, root = components([t for _, t in before])
    first = {}
    for (i, _), r in zip(before, root):
        first[r] = min(i, first.get(r, i))
    assert sorted(i for i, _ in after) == sorted(first.values())


def test_digests(stages):
    _, before, after = stages[-1]
    encode = Tokenizer.from_file(WORD_BPE).encode
    rows = sorted(after.collect(), key=lambda r: r.start)
    texts = sorted((r.doc_id, r.text) for r in before.select("doc_id", "text").collect())
    assert [r.doc_id for r in rows] == [i for i, _ in texts] and sum(len(split(t)) for _, t in texts) > 0
    start = 0
    for r, (_, text) in zip(rows, texts):
        ids = np.array([*encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_decontaminate_by_row(spark):
    """A contaminated row takes no clean row of its id, or of no id, with it."""
    passage = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 12)
    rows = [(None, passage, 1), (None, "clean words alone", 2), (None, None, 3), (5, "before " + passage, 4), (5, "clean too", 5), (6, passage, 6), (7, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid int").repartition(3)
    after = corpus_pipeline.decontaminate_stage(spark, docs, SF)
    assert after.columns == docs.columns
    assert sorted(r.uid for r in after.collect()) == [2, 3, 5, 7]


def test_edges_are_made_once(spark):
    """What makes the edges runs once, however often a round reads them."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(90, 95), (95, 91), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components_of(rows.mapInArrow(run, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 91: 90, 95: 90}
    assert made.value == 43


def test_levels_alone_on_the_driver(spark):
    """The driver holds a byte for each counter of the frequency sketch."""
    counters = 1 << 22
    size = counters // ngram_join.BLOCKS
    counts = np.random.default_rng(3).integers(0, 4, size).astype(np.uint16)
    counts[7] = 9_000
    packed = zlib.compress(counts.tobytes(), 1)
    rows = [(block, task, packed) for block in range(0, ngram_join.BLOCKS, 2) for task in range(2)]
    rows = spark.createDataFrame(rows, "block int, task int, counts binary")
    tracemalloc.start()
    levels = ngram_join._frequency_levels(rows, counters)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = np.concatenate([2 * counts * (b % 2 == 0) for b in range(ngram_join.BLOCKS)]).astype(float)
    want = np.ceil(np.log2(np.maximum(whole / max(1.0, 2 * whole.mean()), 1.0)))
    assert levels.dtype == np.uint8 and (levels == want).all() and levels.max() > 8
    assert peak < 2 * counters


def test_plan_of_the_mix_without_python_workers(spark):
    """A worker started for the plan's few rows would stay beside the next stage's."""
    rows = [("a", 5, 2.5, 0.5), (None, 0, 0.0, 0.0)]
    frame = mixing._frame(spark, rows)
    assert [tuple(r) for r in frame.collect()] == rows
    assert frame.schema.simpleString() == "struct<source:string,source_size:bigint,target:double,scale:double>"
    assert mixing._frame(spark, []).count() == 0 and mixing._frame(spark, []).schema == frame.schema
    # rows that Python workers deserialize come as an existing RDD
    assert "ExistingRDD" not in frame._jdf.queryExecution().executedPlan().toString()
