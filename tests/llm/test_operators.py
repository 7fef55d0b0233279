"""Every operator against a brute-force version, over rows with nulls, empty
and very long texts, ties, repeated rows and clashing extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adlift.llm import decontaminate, fingerprints, line_spread, lm_scoring, mixing, ngram_join, text_hash, token_counts, token_ids, toxicity, url_filters
from adlift.llm.common import WORD_BPE

from .conftest import ROWS

AZ = {c: c + 32 for c in range(65, 91)}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def library_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def tokenizer(kept=[]):
    if not kept:
        kept.append(Tokenizer.from_file(WORD_BPE))
    return kept[0]


def shingles(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_word_hashes():
    texts = [b"", b" a", b"A b", b"x" * 300_000 + b" y", b"b a " * 100_000]
    for text, h in zip(texts, text_hash.hash_texts(texts, text_hash.SPACES)):
        words = text.lower().split()
        names = {}
        assert len(h) == len(words) and all(names.setdefault(w, x) == x for w, x in zip(words, h.tolist()))
        assert len(set(names.values())) == len(names)


def test_long_words_that_a_polynomial_confuses():
    """A Thue-Morse word and its complement, above and below the long words."""
    for n in (16, 32, 64, 1024, 2048):
        one = bytes(97 + bin(i).count("1") % 2 for i in range(n))
        two = one.translate(bytes.maketrans(b"ab", b"ba"))
        h = text_hash.hash_texts([one + b" " + two, one.upper()], text_hash.SPACES)
        assert h[0][0] != h[0][1] and h[1][0] == h[0][0], n


def test_token_counts(docs, no_docs):
    lengths = [len(library_ids(t)) for _, t, _ in ROWS]
    hist = token_counts.length_histogram(docs, WORD_BPE).cache()
    rows = hist.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        assert r.docs_over == sum(x > r.n_tokens for x in lengths) and r.tokens_over == sum(x for x in lengths if x > r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
    assert token_counts.truncated_total(hist, 50).first()[0] == sum(min(x, 50) for x in lengths)
    assert token_counts.quantile(hist, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]
    assert token_counts.length_histogram(no_docs, WORD_BPE).count() == 0


URLS = [
    None, "", "no scheme", "http://example.org", "https://EXAMPLE.org/es/x", "https://a.example.org/en/123?q#f", "http://example.org/en/2", "http://x.com/fr/1#t", "http://com/de/",
    "http://notexample.org/es/", "http://casino-win.example.net/x", "http://www.free-bets.net/", "http://blog.a.net/en/x.php", "http://a.net/en/x.php?y", "http://a.net/ads/1", "http://a.net/x?utm_source=spam", "http://a.net/x?utm_source=spammer",
    "http://example.org?://example.com/de/", "http://a.org/ES/ü",
]


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    rules = url_filters.rule_set()
    every = url_filters.Index([], {})
    every.always = [(r, re.compile(r.regex(), re.DOTALL)) for r in rules]  # no index: all rules run
    got = url_filters.judge_urls(pages).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert tuple(r)[1:] == every.judge(URLS[r.page_id % len(URLS)], "allow")
    by = {URLS[r.page_id % len(URLS)]: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[None] == ("", "", None, "allow") and by["http://example.org"] == ("example.org", "", None, "allow")
    assert by["https://EXAMPLE.org/es/x"] == ("example.org", "/es/x", "example.org/es/", "block")
    assert by["https://a.example.org/en/123?q#f"][2:] == ("example.org/en/1", "block")
    assert by["http://notexample.org/es/"][2:] == ("org/", "allow")
    assert by["http://a.net/en/x.php?y"][3] == "block" and by["http://blog.a.net/en/x.php"][3] == "allow"
    assert by["http://a.net/x?utm_source=spam"][3] == "block" and by["http://a.net/x?utm_source=spammer"][3] == "allow"
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_line_spread(docs, no_docs, spark):
    rows = [(i, f"shared line\nown {i}\n  two sites {i % 2}  ", f"s{i % 4}") for i in range(8)] + [(8, None, "s0"), (9, "shared line", None), (9, "shared line", None)]
    got = line_spread.without_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=3).collect()
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got} == {(i, f"own {i}\n  two sites {i % 2}  ", 3, 1) for i in range(8)} | {(8, None, 0, 0), (9, "", 1, 1)}
    assert len(got) == len(rows)
    out = line_spread.without_spread_lines(docs, min_sites=2)
    assert out.count() == len(ROWS) and set(docs.columns) < set(out.columns)
    assert line_spread.without_spread_lines(no_docs).count() == 0
    clash = line_spread.without_spread_lines(docs.withColumn("n_lines", F.lit("mine")), min_sites=2)
    assert {r.n_lines_input for r in clash.collect()} == {"mine"} and clash.schema["n_lines"].dataType.simpleString() == "bigint"


def test_toxicity(docs, no_docs, spark):
    clean = [f"the cat {i} sat. it was fine {i}" for i in range(60)]
    texts = clean + [c + ". you vile scum here" for c in clean[:20]]
    model = toxicity.fit([t.encode() for t in texts], [0] * 60 + [1] * 20)
    assert all(model.score(t.encode()) < 0.7 for t in clean) and model.score(b"Lovely day. Vile scum! Bye.") >= 0.7
    assert model.score(b"") == 0.0
    bad = spark.createDataFrame([(1, "Lovely day. Vile scum! Bye."), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.place, r.sentence) for r in toxicity.offending_sentences(bad, model).collect()] == [(1, 1, "Vile scum")]
    table = toxicity.score(docs, model).collect()
    assert len(table) == len(ROWS) and all(0 <= r.score <= 1 for r in table)
    for r in table:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    labels = spark.createDataFrame([(1, None), (99, 1), (4, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, labels).collect()} == {0.0}
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_toxicity_is_a_noisy_or():
    """Scores equal the product over sentences, and clean sentences of any
    number do not add up to a rejection."""
    clean = ["the mill stood by the river. it was quiet there", "we read a book about trains. nobody hurried"]
    texts = [f"{clean[i % 2]} item{i}" for i in range(200)] + [f"{clean[i % 2]}. you vile fool. item{i}" for i in range(60)]
    model = toxicity.fit([t.encode() for t in texts], [0] * 200 + [1] * 60)
    assert 1 < model.span < float("inf")
    for text in (*texts[::37], "Vile fool! " * 3, ". ? !", "one sentence", "\n".join(texts[:200]) * 40):
        logits = model.sentence_logits(text.encode())
        less = max(0.0, float(np.log(max(1, len(logits)) / model.span)))
        stay = 1.0
        for z in logits:
            stay *= 1 - 1 / (1 + float(np.exp(less - z)))
        assert model.score(text.encode()) == pytest.approx(1 - stay, abs=1e-9)
    long = ". ".join(texts[:200]) + ". "
    assert len(long) * 110 > 1_000_000
    assert all(model.score((long * k).encode()) < toxicity.THRESHOLD for k in (1, 11, 110))
    assert model.score((long * 11 + "you vile fool").encode()) >= toxicity.THRESHOLD


def test_toxicity_samples_long_documents(spark, monkeypatch):
    """Long clean documents teach by a part, long toxic ones do not; the
    characters brought together are bounded."""
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 400)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append(list(zip(texts, y))) or toxicity.Model({}, 0.0))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[0], "short"), (ids[1], "a long one. " * 500), (ids[2], "a bad one. " * 500), (ids[3], "bad"), (ids[4], None), (ids[5], "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k in (2, 3)) for k, (i, _) in enumerate(rows)], "doc_id long, toxic boolean")
    toxicity.train(docs, labels)
    assert sorted(y for _, y in seen[0]) == [0, 0, 0, 0, 1] and (b"bad", 1) in seen[0]
    assert all(len(t) <= 400 for t, _ in seen[0]) and any(b"a long one\na long one" in t for t, _ in seen[0])
    monkeypatch.setattr(toxicity, "SAMPLE_TOTAL", 10)
    toxicity.train(docs, labels)
    assert sum(len(t) for t, y in seen[1] if not y) <= 10 and len(seen[1]) < len(seen[0])


def test_toxicity_reads_whole_runs():
    """Text without ASCII spaces counts to its end, in training and scoring."""
    fill = ["今日は天気がとても良いので散歩に行きました", "私たちは新しい図書館で本をたくさん読みました", "彼女は市場で野菜と果物を買って家に帰りました"]
    clean = ["".join(fill[(i + k) % 3] for k in range(3)) + f"第{i}回" for i in range(60)]
    bad = [c + "この馬鹿野郎め" + fill[i % 3] for i, c in enumerate(clean[:30])]
    model = toxicity.fit([t.encode() for t in clean + bad], [0] * 60 + [1] * 30)
    late = "".join(fill) * 5 + "馬鹿野郎" + "".join(fill)
    assert model.score(late.encode()) >= 0.7 > model.score(("".join(fill) * 6).encode())
    assert [s.decode() for s in toxicity.sentences("良い！悪い？本。a.b\u2028c".encode())] == ["良い", "悪い", "本", "a", "b", "c"]
    assert toxicity.words("vile\u00a0scum\u3000you「人」，x".encode()) == [b"vile", b"scum", b"you", "人".encode(), b"x"]
    run = b"x" * 80 + b"scum" + b"y" * 80
    assert "scum~" in set(toxicity.features(run)) and "scum" in set(toxicity.features(b"scum"))


def test_re_pair():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 12, 30_000), [1] * 50, np.tile([5, 5, 5, 7], 4_000)]).astype("<u4")
    for base in (12, 70_000):
        symbols, rules = token_ids.compress(ids, base)
        assert len(symbols) < len(ids) * 0.7 and (token_ids.expand(symbols, rules, base) == ids).all()
        lengths = token_ids.rule_lengths(rules, base)
        for a, b in ((0, 1), (17, 17), (29_990, 30_060), (len(ids) - 5, len(ids))):
            assert (token_ids.decode_range(symbols, rules, lengths, base, a, b) == ids[a:b]).all()
    x, y = b"some bytes", b"and more" * 9
    assert token_ids._combined(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


def test_re_pair_to_the_end():
    """No pair that occurs twice is left, in runs of one id neither."""
    rng = np.random.default_rng(2)
    copy = rng.integers(2, 5_000, 3_000)
    for ids in (np.full(1_000, 7), np.tile([9, 9, 9, 8], 500), np.concatenate([copy, [1], copy, [1], copy, [1]]), rng.integers(0, 9, 20_000), np.full(5, 1), np.empty(0)):
        ids = ids.astype("<u4")
        for base in (5_000, 70_000):
            symbols, rules = token_ids.compress(ids, base)
            assert (token_ids.expand(symbols, rules, base) == ids).all()
            seen, last = Counter(), None
            for pair in zip(symbols.tolist(), symbols.tolist()[1:]):
                last = None if pair[0] == pair[1] and pair == last else pair  # in a run, every other one
                if last and 1 not in pair:
                    seen[pair] += 1
            assert max(seen.values(), default=0) < 2
    symbols, rules = token_ids.compress(np.full(1 << 12, 7, dtype="<u4"), 10)
    assert len(symbols) <= 3 and token_ids.rule_lengths(rules, 10).max() > 16


@pytest.mark.parametrize("shard_ids", [token_ids.SHARD_IDS, 64])
def test_token_ids(docs, no_docs, spark, tmp_path, shard_ids):
    path = str(tmp_path / "shards")
    token_ids.write_shards(docs, path, WORD_BPE, shard_ids)
    got = token_ids.read_documents(spark, path).collect()
    start, want = 0, []
    for i, text in sorted(((i, t) for i, t, _ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library_ids(text), 1], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    if shard_ids == 64:
        assert token_ids.token_ids(no_docs, WORD_BPE).count() == 0


def components(texts, percent=75):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return sets, root


def test_ngram_join(docs, no_docs):
    texts = [t for _, t, _ in ROWS]
    sets, root = components(texts)
    want = []
    for k, (i, _, _) in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if root[j] == root[k] and sets[k] and ROWS[j][0] is not None]
        want.append((i, len(sets[k]), min(ids) if ids else i))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ngram_join.jaccard_components(no_docs).count() == 0
    kept = ngram_join.group_keepers(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 1, 4, 6, 7, 8, 9, 10, 12, 13]


def test_near_copies_link_like_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for family in range(6):
        base = [f"f{family}w{rng.integers(500)}" for _ in range(80)]
        for _ in range(25):
            own = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 7)):
                own[at] = f"edit{rng.integers(10_000)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, root = components(texts)
    first = {}
    for k, r in enumerate(root):
        first.setdefault(r, k)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {k: first[r] for k, r in enumerate(root)}


def brute_backoff(texts, order=3, alpha=0.4):
    words = [split(t) for t in texts]
    own = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    every, total = sum(own, Counter()), sum(map(len, words))
    out = []
    for w, mine in zip(words, own):
        count = lambda g: every[g] - mine[g]  # noqa: B023, E731
        log = 0.0
        for i in range(len(w)):
            n, factor = min(order, i + 1), 1.0
            while n > 1 and not count(tuple(w[i - n + 1 : i + 1])):
                n, factor = n - 1, factor * alpha
            g, rest = tuple(w[i - n + 1 : i + 1]), total - len(w)
            s = count(g) / count(g[:-1]) if n > 1 else count(g) / rest if count(g) else 1 / (rest + 1)
            log += math.log(factor * s)
        out.append((len(w), log))
    return out


def test_backoff_scores(docs, no_docs):
    want = sorted((i or 0, n, round(s, 6)) for (i, _, _), (n, s) in zip(ROWS, brute_backoff([t for _, t, _ in ROWS])))
    got = lm_scoring.backoff_scores(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, round(r.log_score, 6)) for r in got) == want
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert lm_scoring.backoff_scores(no_docs).count() == 0


def test_totals_above_32_bits():
    grams = np.array([1 << 8, 2 << 8, 3 << 8], dtype=np.uint64)
    hashes = text_hash.planes(np.diff(grams >> np.uint64(8), prepend=np.uint64(0)))
    counts = [[3_000_000_000, 1, 4_294_967_295], [2_000_000_000, 2, 1]]
    t = pa.table({"range": [0, 0], "batch": [0, 1], "hashes": [hashes] * 2, "counts": [lm_scoring._packed(np.array(c)) for c in counts]})
    for x in lm_scoring.range_totals(t).column("totals").to_pylist():
        assert lm_scoring.batch_totals([x]).tolist() == [5_000_000_000, 3, 4_294_967_296]
    assert lm_scoring.batch_totals([]).tolist() == []


def test_decontaminate(docs, no_docs, spark):
    alpha = BASE_WORDS = ROWS[0][1].split()
    items = [("i1", " ".join(alpha[5:25])), ("i1", " ".join(alpha[5:25])), ("i2", "FEW, words"), ("i3", None), ("i4", "... !"), (None, " ".join(BASE_WORDS[60:75])), ("i5", "w5x5 w6x6 w7x7 absent")]
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id string, text string, n_words string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    want = []
    for i, text, _ in ROWS:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            x = words(t)
            n = min(10, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p] == x[k] and w[p : p + n] == x[k : k + n]:
                        hit.update(range(p, p + n))
                        found |= {item} - {None}
        want.append((i or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = [(r.doc_id or 0, *tuple(r)[1:]) for r in decontaminate.decontaminate(docs, bench).collect()]
    assert sorted(got) == sorted(want) and any(x[-1] for x in want)
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_winnowing_keeps_a_print_in_every_window():
    grams = np.random.default_rng(2).integers(0, 9, 500).astype(np.uint64)
    at = decontaminate.winnow(grams, 6)
    for i in range(len(grams) - 5):
        low = min(grams[i : i + 6])
        assert max(j for j in range(i, i + 6) if grams[j] == low) in at


def test_targets_share_everything():
    plan = mixing.targets([("b", 100), (None, 10), ("a", 4), ("c", 0)])
    by = {p.source: p.target for p in plan}
    assert [p.source for p in plan] == ["a", "b", "c", None] and by["a"] == 12 and by["c"] == 0
    assert abs(sum(by.values()) - 114) < 1e-9 and by[None] == 30 and by["b"] == pytest.approx(72)


def test_mix(docs, no_docs, spark):
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    weight = F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)
    for importance in (None, weight):
        rows = mixing.mix(many, importance).collect()
        for s in {r.source for r in rows}:
            own = [r for r in rows if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 7
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in rows)
        assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(many.repartition(5), importance).collect()))
    even = [r.copies for r in rows if r.doc_id % 2 == 0 and r.source == "s1"]
    odd = [r.copies for r in rows if r.doc_id % 2 == 1 and r.source == "s1"]
    assert sum(even) / len(even) > 2 * sum(odd) / len(odd)
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len(split(t))) for i, t, _ in ROWS)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def sorted_mix(df):
    return sorted(map(str, df.collect()))


def test_mix_of_equal_rows_and_null_ids(spark, monkeypatch):
    """A third of all rows equal, ids null or repeated: the targets are met,
    and the length of a text has no part in the draw."""
    kind = "doc_id long, text string, source string, uid int"
    equal = [(None, "one two three four five six seven eight", "a", i) for i in range(3000)]
    lengths = [(None, " ".join(f"w{i}" for _ in range(1 + i % 50)), "b", i) for i in range(3000)]
    ids = [(7, "x y z " * (1 + i % 3), "c", i) for i in range(3000)]
    docs = spark.createDataFrame(equal + lengths + ids + [(None, None, None, 1)] * 50 + [(1, "w " * 40000, "d", 1)], kind)
    results = []
    for limit, parts in ((mixing.BROADCAST_REPEATS, 3), (mixing.BROADCAST_REPEATS, 17), (10, 5)):
        monkeypatch.setattr(mixing, "BROADCAST_REPEATS", limit)
        rows = mixing.mix(docs.repartition(parts)).cache()
        results.append(sorted_mix(rows))
        for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("size").alias("most"), F.first("target").alias("target")).collect():
            assert abs(r.taken - r.target) <= r.most, r
    assert results[0] == results[1] == results[2]
    own = rows.where("source = 'b'").groupBy((F.col("size") > 25).alias("long")).agg(F.avg("copies").alias("c")).collect()
    assert abs(own[0].c - own[1].c) < 0.1
    mixed = mixing.mixed_documents(docs.repartition(4))
    assert mixed.columns == docs.columns
    taken = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("copies").alias("n")).collect() if r.n}
    assert {r.source: r["count"] for r in mixed.groupBy("source").count().collect()} == taken


def test_fingerprints(docs, no_docs, spark):
    one = [(i, t) for i, t, _ in ROWS if i != 11]
    unique = docs.where("doc_id is null or doc_id <> 11")
    order = sorted(one, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(unique).collect()}
    assert len(got) == len(one)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u, r = t or "", u or "", got[i]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(shingles(t), shingles(edited)), abs=0.12)
        assert r.near_next == pytest.approx(like(shingles(t), shingles(u)), abs=0.12)
    assert got[1].fingerprint == got[2].fingerprint
    assert fingerprints.edited_fingerprints(docs).count() == len(ROWS)
    assert fingerprints.edited_fingerprints(no_docs).count() == 0
    rows = fingerprints.sketches(docs, size=16)
    whole = fingerprints.merge_sketches(rows.withColumn("g", F.lit(None).cast("string")), ["g"], size=16).first().fingerprint
    prints = [fingerprints.from_text(r.fingerprint) for r in rows.collect()]
    union = np.unique(np.concatenate(prints))[:16]
    assert (fingerprints.from_text(whole) == union).all()
    a, b = (fingerprints.sketch_of(text_hash.word_hashes(t.encode(), text_hash.SPACES)) for t in (ROWS[0][1], ROWS[2][1]))
    assert fingerprints.containment(a, b) == 1.0 and fingerprints.resemblance(a, b) == pytest.approx(76 / 77)


def test_components_of_separate_graphs(spark):
    from adlift.llm.components import components as found

    rows = [("x", 5, 4), ("x", 4, 3), ("x", 3, 5), ("y", 5, 9), ("y", 9, 5), ("y", 7, 7), ("x", 8, 9)]
    got = found(spark.createDataFrame(rows, "graph string, a bigint, b bigint"), "graph")
    assert sorted(tuple(r) for r in got.select("graph", "node", "root").collect()) == [
        ("x", 3, 3), ("x", 4, 3), ("x", 5, 3), ("x", 8, 8), ("x", 9, 8), ("y", 5, 5), ("y", 9, 5)]
