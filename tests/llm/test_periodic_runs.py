"""Run detection against brute force, and its query's digests."""

import hashlib
import random
import zlib

import pytest

from adlift.llm import periodic_runs as P

from .conftest import ROWS


def brute_runs(w, min_length=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q))
            if j > i and length >= max(min_length, exponent * q) and not smaller:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in drop)


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        n, letters = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 4])
        w = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if n > 8 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 6)
            w = [w[min(n - 1, a + (i - a) % p)] if i >= a else w[i] for i in range(n)]
        for exponent, least in ((2, 2), (3, 6), (4, 6)):
            assert P.word_runs(w, least, exponent) == brute_runs(w, least, exponent)


def test_runs_that_overlap_and_nest():
    inner = [b"a", b"a", b"a", b"a", b"a", b"a", b"b"]
    w = inner * 4 + [b"c"] + [b"x", b"y"] * 4 + [b"x"] + [b"z"]
    runs = P.word_runs(w)
    assert runs == brute_runs(w) and (0, 28, 7) in runs and (0, 6, 1) in runs and (29, 9, 2) in runs
    assert P.word_runs([b"q"] * 50_000) == [(0, 50_000, 1)]


def test_words_that_a_polynomial_hash_confuses():
    """Words are compared as bytes: these two have one hash modulo 2**64."""
    one = bytes(97 + bin(i).count("1") % 2 for i in range(2048))
    two = one.translate(bytes.maketrans(b"ab", b"ba"))
    assert P.word_runs([one, two] * 4) == [(0, 8, 2)]


def test_find_runs(docs, no_docs, spark):
    rows = P.find_runs(docs).collect()
    assert len(rows) == len(ROWS)
    assert set(docs.columns) < set(P.find_runs(docs).columns) and P.find_runs(no_docs).count() == 0
    texts = {t: (t or "").encode().split() for _, t, _ in ROWS}
    for r in rows:
        w = texts[r.text]
        assert r.n_words == len(w) and r.source in {s for i, t, s in ROWS if i == r.doc_id and t == r.text}
        if len(w) < 1000:
            assert [tuple(x) for x in r.runs] == brute_runs(w) and r.collapsed.encode() == brute_collapsed(w, brute_runs(w))
    own = spark.createDataFrame([(1, "the end the end the end the end . x")], "doc_id long, text string")
    assert P.find_runs(own).first().collapsed == "the end . x"
    with pytest.raises(ValueError):
        P.find_runs(own, exponent=1)
    clash = P.find_runs(own.withColumns({"RUNS": own.doc_id, "runs_input": own.doc_id + 1})).first()
    assert clash.RUNS_input_input == 1 and clash.runs_input == 2 and clash.runs[0].period == 2


def test_digests(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(None, "a " * 9), (7, None), (7, "a\x0ba\x0ca\x1ca\na\ta\ra"), (301, ""), (302, " é é é é é é ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(map(str, r)) for r in P.run_digests(P.find_runs(P.with_tail_periods(frame))).collect())
    want = []
    for i, t in rows:
        w = edited(i, (t or "").encode().split())
        runs = brute_runs(w)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *four, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(brute_collapsed(w, runs)).hexdigest()))
    assert got == sorted(tuple(map(str, r)) for r in want)
