"""All links of the n-gram join, against brute force."""

import numpy as np

from adlift.llm import ngram_join

from .test_operators import shingles


def test_all_links_of_near_copies(spark):
    rng = np.random.default_rng(4)
    texts = ["", None, "too few words"]
    for family in range(3):
        base = [f"f{family}w{rng.integers(500)}" for _ in range(80)]
        for _ in range(20):
            own = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 5)):
                own[at] = f"edit{rng.integers(10_000)}"
            texts.append(" ".join(own))
    sets = [frozenset(shingles(t or "")) for t in texts]
    distinct = sorted(set(sets) - {frozenset()}, key=sorted)
    linked = {x: {y for y in distinct if x != y and 100 * len(x & y) >= 75 * len(x | y)} for x in distinct}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, members = ngram_join.jaccard_links(docs)
    rows = {r.doc_id: r for r in members.collect()}
    assert {k: (r.n_shingles, r.n_links) for k, r in rows.items()} == {k: (len(s), len(linked.get(s, ()))) for k, s in enumerate(sets)}
    of = {rows[k].cls: s for k, s in enumerate(sets)}
    got = [frozenset((of[a], of[b])) for a, b in links.collect()]
    want = {frozenset((x, y)) for x in distinct for y in linked[x]}
    assert len(got) == len(want) > 50 and set(got) == want
