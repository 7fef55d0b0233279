"""Near-duplicate groups against brute force, and the sketches' figures."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlift.llm import odd_sketch as O

from .conftest import ROWS

AZ = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        names.setdefault(find(i), []).append(doc_id)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in names.items()}
    return sorted(str((d, len(s), least[find(i)], d == least[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def result(frame):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in frame.collect())


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("sizes", [{}, {"PART": 4, "BLOCK": 6, "BLOCK_TOKENS": 900, "CALL_ROWS": 500, "CALL_TOKENS": 3000}])
def test_groups_equal_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(O, name, value)
    rng = random.Random(4)
    texts = []
    for k, (n, most) in enumerate([(60, 9), (40, 14), (25, 4), (3, 1)]):
        base = [f"b{k}w{rng.randrange(400)}" for _ in range(120 + 40 * k)]
        texts += near_copies(rng, base, n, most)
    shared = [f"p{i}" for i in range(40)]  # a passage of many documents
    texts += [" ".join(shared + [f"q{rng.randrange(10**6)}" for _ in range(rng.randint(20, 60))]) for _ in range(40)]
    texts += [texts[0]] * 20 + [None, "", " \t", "one", "ONE", "one two", "one two three four"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(5, texts[9]), (None, texts[1]), (None, "alone without an id here"), (None, None)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, cls string").repartition(3)
    assert result(O.near_groups(frame)) == brute(rows)


def test_edge_rows(docs, no_docs):
    assert result(O.near_groups(docs)) == brute([(i, t) for i, t, _ in ROWS])
    assert O.near_groups(no_docs).count() == 0


def test_sketches_estimate_similarity(spark):
    rng = np.random.default_rng(2)
    for shared in (950, 900, 800):
        errors, counts, keys = [], [], []
        for _ in range(200):
            both = rng.integers(0, 2**63, 1000, dtype=np.uint64)
            a, b = both[: 1000 - (1000 - shared) // 2], both[(1000 - shared) // 2 :]
            samples = np.array([O.min_hashes(a), O.min_hashes(b)])
            sketch = O.odd_sketches(samples)
            count = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
            counts.append(count)
            errors.append(1 + O.BITS / (4 * O.SAMPLES) * np.log(1 - 2 * count / O.BITS) - shared / 1000)
            keys.append(int((O.band_keys(samples)[0] == O.band_keys(samples)[1]).sum()))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
        assert max(counts) <= O.xor_limit(80) and min(keys) > 0
    row = spark.createDataFrame([([int(x) for x in sketch[0].view(np.int64)], [int(x) for x in sketch[1].view(np.int64)])], "a array<bigint>, b array<bigint>")
    count_column = O.xor_count(F.col("a"), F.col("b"))
    got = row.select(count_column.alias("n"), O.similarity(count_column).alias("s"), O.xor_count(F.col("a"), F.col("a")).alias("zero")).first()
    assert got.n == count and abs(got.s - (errors[-1] + 0.8)) < 1e-9 and got.zero == 0
