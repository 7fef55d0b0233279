"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from adlift.llm import ranked_search as R

from .conftest import ROWS

AZ = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, text in items:
        found = []
        for (i, bag), size in zip(bags, sizes):
            m = 100 - 90 + (90 * size * n) // total if total else 0
            w = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) for x in set(terms(text)) if bag[x]}
            score = sum(w[x] * (10**9 * bag[x] // (1000 * bag[x] + 8 * m)) for x in w)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


def result(frame):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in frame.collect())


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    pick = lambda m: " ".join(vocabulary[min(59, int(rng.expovariate(0.12)))] for _ in range(m))
    rows = [(i, pick(rng.randint(0, 60))) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(30)] + [(None, rows[3][1]), (None, "w1 w2"), (5, "w50 W51"), (5, None), (6, " .,; ")], pick


@pytest.mark.parametrize("segment_docs, block_terms", [(1 << 16, 1 << 18), (7, 1 << 18), (40, 9)])
def test_search_equals_scoring_all(spark, monkeypatch, segment_docs, block_terms):
    monkeypatch.setattr(R, "SEGMENT_DOCS", segment_docs)
    monkeypatch.setattr(R, "BLOCK_TERMS", block_terms)
    rng = random.Random(11)
    rows, pick = corpus(rng, 300)
    items = [(i, pick(rng.randint(1, 25))) for i in range(8)] + [(3, rows[3][1]), (3, rows[3][1]), (20, None), (21, "nowhere"), (None, "W50 w51-w50")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    for k in (1, 10):
        assert result(R.ranked_search(docs, asked, k)) == brute(rows, items, k)


def test_edge_rows(docs, no_docs, spark):
    items = [("a", "few words"), ("b", "täxt w5x5 ONE"), ("b", "täxt w5x5 ONE")]
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert result(R.ranked_search(docs, asked)) == brute([(i, t) for i, t, _ in ROWS], items)
    assert R.ranked_search(no_docs, asked).count() == 0
    assert R.ranked_search(docs, asked.limit(0)).count() == 0
    assert R.ranked_search(docs.where("text is null"), asked).count() == 0


def test_index_holds_all_terms(docs):
    rows = R.build_index(docs).collect()
    lengths = [len(terms(t)) for _, t, _ in ROWS]
    assert sum(r.n_docs for r in rows) == sum(n > 0 for n in lengths) and sum(r.n_terms for r in rows) == sum(lengths)
    for r in rows:
        tf, df = R.from_planes(r.tfs, np.uint32), R.from_planes(r.dfs, np.uint32)
        assert tf.sum() == r.n_terms and df.sum() == len(tf) and len(r.terms) == 8 * len(df)
        ids = [x for x in r.doc_ids if x is not None]
        assert ids == sorted(ids)


def test_large_products_stay_exact():
    tf, length = np.array([3, 7], dtype=np.uint32), np.array([10**7, 3], dtype=np.int64)
    n_docs, n_terms = 3 * 10**10, 10**13
    want = [10**9 * t // (1000 * t + 8 * (10 + 90 * n * n_docs // n_terms)) for t, n in zip([3, 7], [10**7, 3])]
    assert R.impacts(tf, length, n_docs, n_terms).tolist() == want
