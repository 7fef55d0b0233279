"""Language-model scores by stupid backoff, from counts of the whole corpus.

The words of a document are scored one by one: if the n-gram that ends there
was seen, its count over its context's count; else ``ALPHA`` times the score
of the next shorter n-gram; a single word has its count over all words, and an
unseen one counts as one of one word more.  All counts leave out the document
itself, so a document does not vouch for its own n-grams.

The n-gram counts of the corpus are a table partitioned by hash.  Documents are
dealt into batches; a batch sends its distinct n-grams (64-bit hashes with
counts, packed by hash range) to the table and gets their totals back, and each
document then sums the scores of its n-grams.  What is shuffled is one entry
for each distinct n-gram of a batch, so a frequent n-gram is counted where it
occurs first and is no hot key.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z.

Cases: null and empty texts have no words, log score 0 and no mean; a lone
document's words are all unseen; repeated rows are documents of their own and
count for each other; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import conf_partitions, utf8
from .text_hash import SPACES, U64, from_planes, hash_texts, ngram_hashes, planes

ORDER, ALPHA = 3, 0.4
#: the bits of an n-gram's hash that name it: 56, since a further byte per entry
#: of the table would buy little (10**9 distinct n-grams: 7 in 10**9 collide)
KEY = U64(0xFFFFFFFFFFFFFF00)
#: bytes of text in a batch, and of the corpus for each range of the table, about
BATCH_BYTES, RANGE_BYTES = 8_000_000, 12_000_000


def _ngrams(words: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct n-grams of a batch (sorted), their counts, and for each
    length the place among them of each n-gram, document after document."""
    grams = [np.concatenate([ngram_hashes(w, n) for w in words] or [np.empty(0, U64)]) for n in range(1, order + 1)]
    grams = [g & KEY for g in grams]
    distinct, place, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    return distinct, counts, np.split(place.astype(np.int32), np.cumsum([len(g) for g in grams])[:-1])


def _range_ends(distinct: np.ndarray, ranges: int) -> np.ndarray:
    """Where the hash ranges end in sorted hashes."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=U64)
    return np.append(np.searchsorted(distinct, edges), len(distinct))


def _packed(counts: np.ndarray) -> bytes:
    """Counts as byte planes, of 4 bytes each or of 8 if one needs them."""
    wide = len(counts) and counts.max() >= 1 << 32
    return b"\x08" + planes(counts.astype(U64)) if wide else b"\x04" + planes(counts.astype(np.uint32))


def _unpacked(data: bytes) -> np.ndarray:
    return from_planes(data[1:], U64 if data[0] == 8 else np.uint32).astype(np.int64)


def range_totals(t: pa.Table) -> pa.Table:
    """For each batch, the corpus counts of its n-grams in a hash range."""
    hashes = [np.cumsum(from_planes(x, U64)) << U64(8) for x in t.column("hashes").to_pylist()]
    counts = np.concatenate([_unpacked(x) for x in t.column("counts").to_pylist()])
    ends = np.cumsum([len(h) for h in hashes])
    every = np.concatenate(hashes)
    del hashes
    order = np.argsort(every, kind="stable")
    every, counts = every[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    sums = np.add.reduceat(counts, first)
    back = np.empty(len(every), dtype=np.int64)
    back[order] = np.repeat(sums, np.diff(np.append(first, len(every))))
    packed = [zlib.compress(_packed(x), 4) for x in np.split(back, ends[:-1])]
    return pa.table({"range": t.column("range"), "batch": t.column("batch"), "totals": pa.array(packed, pa.binary())})


def batch_totals(packed: list[bytes]) -> np.ndarray:
    """The corpus counts of a batch's n-grams, from its answers by range."""
    return np.concatenate([_unpacked(zlib.decompress(x)) for x in packed] or [np.empty(0, np.int64)])


def _own_counts(places: np.ndarray) -> np.ndarray:
    """For each n-gram of one document, how often the document has it."""
    _, inverse, counts = np.unique(places, return_inverse=True, return_counts=True)
    return counts[inverse]


def document_score(places: list[np.ndarray], totals: np.ndarray, n_all: int, alpha: float) -> float:
    """Sum of the log scores; ``places[n - 1]`` are the document's n-grams of
    ``n`` words, ``totals`` the corpus counts by place."""
    n = len(places[0])
    others = [totals[p] - _own_counts(p) for p in places]  # without the document itself
    rest = n_all - n
    score = np.where(others[0] > 0, others[0] / max(rest, 1), 1.0 / (rest + 1))
    for k in range(1, len(places)):
        if n > k:
            seen, context = others[k], others[k - 1][:-1][: n - k]
            higher = np.divide(seen, context, out=np.zeros(n - k), where=seen > 0)
            score[k:] = np.where(seen > 0, higher, alpha * score[k:])
    return float(np.log(score).sum())


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score), a row for each document."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", utf8().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = conf_partitions(spark)
    batches, ranges = max(parts, size // BATCH_BYTES + 1), max(parts, size // RANGE_BYTES + 1)
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int"))

    def count(t: pa.Table) -> pa.Table:
        words = hash_texts(t.column("text").to_pylist(), SPACES)
        distinct, counts, _ = _ngrams(words, order)
        out, start = {"range": [], "batch": [], "hashes": [], "counts": []}, 0
        for r, end in enumerate(_range_ends(distinct, ranges)):
            if end > start:
                part = distinct[start:end]
                out["range"].append(r)
                out["batch"].append(t.column("batch")[0].as_py())
                out["hashes"].append(planes(np.diff(part >> U64(8), prepend=U64(0))))
                out["counts"].append(_packed(counts[start:end]))
                start = end
        return pa.table(out, pa.schema([("range", pa.int32()), ("batch", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        words = hash_texts(t.column("text").to_pylist(), SPACES)
        _, _, places = _ngrams(words, order)
        parts = sorted(zip(answers.column("range").to_pylist(), answers.column("totals").to_pylist()))
        totals = batch_totals([x for _, x in parts])
        n = np.array([len(w) for w in words])
        ends = [np.cumsum(np.maximum(n - k, 0)) for k in range(order)]
        scores = [
            document_score([p[e[i] - max(n[i] - k, 0) : e[i]] for k, (p, e) in enumerate(zip(places, ends))], totals, n_all, alpha)
            for i in range(len(n))
        ]
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(n.astype(np.int64)), "log_score": pa.array(scores, pa.float64())})

    n_all = int(rows.select(_word_count().alias("n")).agg(F.sum("n")).first()[0] or 0)
    table = dealt.groupBy("batch").applyInArrow(count, "range int, batch int, hashes binary, counts binary")
    answers = table.groupBy("range").applyInArrow(range_totals, "range int, batch int, totals binary")
    answers = answers.select("range", F.col("batch").alias("batch"), "totals")
    scored = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, f"doc_id {kind}, n_words bigint, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def _word_count():
    return F.regexp_count(F.col("text").cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
