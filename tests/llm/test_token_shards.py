"""The stored form of token shards."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adlift.llm import token_ids
from adlift.llm.common import WORD_BPE


def test_shards_are_packed(spark, tmp_path):
    """Numbers take the bytes that they need; ids at any place are the library's."""
    rng = random.Random(5)
    parts = ["an", "tion", "re", "the", "er", "ou", "sh", "è", "in", "ble", "of", "st"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(3_000)]
    rows = [(i, " ".join(rng.choices(words, k=400))) for i in range(300)]
    path = str(tmp_path / "shards")
    token_ids.write_shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, WORD_BPE)
    shards = spark.read.parquet(path)
    # 4 bytes a symbol and 12 a rule are what the numbers take unpacked
    plain = sum(r.n * r.width + 12 * r.k for r in shards.select("width", (F.length("symbols") / F.col("width")).alias("n"), (F.length("rules") / 8).alias("k")).collect())
    assert plain > 200_000
    assert sum(f.stat().st_size for f in Path(path).glob("*.parquet")) < 0.65 * plain
    encode = Tokenizer.from_file(WORD_BPE).encode
    ids = np.array([x for _, t in rows for x in [*encode(t, add_special_tokens=False).ids, token_ids.END_ID]])
    found = [token_ids.read_ids(spark, path, r.part, 0, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()]
    assert np.array_equal(np.concatenate(found), ids)
    part, size = int(shards.select(F.min("part")).first()[0]), len(found[0])
    for a, b in ((0, 1), (size // 3, size // 2), (size - 9, size)):
        assert np.array_equal(token_ids.read_ids(spark, path, part, a, b), found[0][a:b])


def test_pairs_that_share_a_counter(monkeypatch):
    """The grammar does not depend on the counters; long rules decode, too."""
    rng = np.random.default_rng(4)
    copy = rng.integers(2, 300, 2_000)
    ids = np.concatenate([copy, [1], copy, [1], rng.integers(2, 30, 5_000), np.full(900, 7), copy]).astype("<u4")
    for base in (300, 65_000, 70_000):
        symbols, rules = token_ids.compress(ids, base)
        with monkeypatch.context() as m:
            m.setattr(token_ids, "SLOT_BITS", 4)
            again = token_ids.compress(ids, base)
        assert np.array_equal(symbols, again[0]) and np.array_equal(rules, again[1])
        lengths = token_ids.rule_lengths(rules, base)
        assert lengths.max() > token_ids.SHORT
        for short in (1, 3, token_ids.SHORT):
            monkeypatch.setattr(token_ids, "SHORT", short)
            assert np.array_equal(token_ids.expand(symbols, rules, base, lengths), ids)


def test_rounds_look_at_frequent_pairs(monkeypatch):
    """Symbols are numbered from those that occur, so that pairs stay small
    numbers, and rounds sort the places of frequent pairs alone; the grammar is
    that of rounds that look at all pairs one by one."""
    rng = np.random.default_rng(6)
    ids = np.concatenate([np.minimum(rng.zipf(1.2, 60_000), 9_000), [1], np.repeat(rng.integers(2, 99, 2_000), 5)]).astype("<u4") * 9 + 1
    monkeypatch.setattr(token_ids, "ROUND_RULES", 100)
    looked, sizes = token_ids._frequent, []

    def all_pairs(keys, tally):
        pairs, counts = np.unique(keys[tally > 0], return_counts=True)
        return pairs[counts >= token_ids.LEAST], counts[counts >= token_ids.LEAST]

    def compared(keys, tally):
        pairs, counts = looked(keys, tally)
        every = all_pairs(keys, tally)
        sizes.append((keys.itemsize, len(pairs) / max(1, len(every[0]))))
        n = len(pairs)
        assert n == len(every[0]) or n >= 4 * token_ids._limit(counts)
        kept = every[1] >= (counts.min() if n else 0)
        assert n == len(every[0]) or (np.array_equal(pairs, every[0][kept]) and np.array_equal(counts, every[1][kept]))
        return pairs, counts

    monkeypatch.setattr(token_ids, "_frequent", compared)
    symbols, rules = token_ids.compress(ids, 90_000)
    assert {x for x, _ in sizes} == {4} and min(x for _, x in sizes) < 0.5
    monkeypatch.setattr(token_ids, "_frequent", all_pairs)
    monkeypatch.setattr(token_ids, "STEPS", 0)
    again = token_ids.compress(ids, 90_000)
    assert np.array_equal(symbols, again[0]) and np.array_equal(rules, again[1])
    assert np.array_equal(token_ids.expand(symbols, rules, 90_000), ids)
