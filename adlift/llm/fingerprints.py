"""Document fingerprints: bottom-k sketches of shingle hashes.

A document's sketch holds the k smallest distinct 64-bit hashes of its
five-word shingles.  Sketches merge: the k smallest hashes of the union of two
sketches are the sketch of the union.  Two sketches estimate resemblance (of
the k smallest of the union, the share found in both), containment and the
number of distinct shingles; up to k shingles these are exact.

As text a sketch is base64 of its ascending big-endian hashes, so equal sets
have equal text.

Cases: null text is empty; an empty text (no words) has the empty sketch;
fewer than five words are one shingle; two empty sketches resemble each other
by 1, an empty and another by 0; repeated documents each give their rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import conf_partitions, utf8
from .text_hash import SPACES, U64, hash_texts, shingle_set

SHINGLE, SIZE = 5, 256


def sketch_of(words: np.ndarray, size: int = SIZE, shingle: int = SHINGLE) -> np.ndarray:
    """The bottom-k sketch of a word sequence, ascending."""
    return shingle_set(words, shingle)[:size]


def as_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=">u8").astype(U64)


def merged(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.union1d(a, b)[:size]


def distinct_count(sketch: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact below ``size``."""
    if len(sketch) < size:
        return float(len(sketch))
    return (size - 1) / ((float(sketch[size - 1]) + 1.0) / 2.0**64)


def _shared(a: np.ndarray, b: np.ndarray, size: int) -> tuple[int, int]:
    union = merged(a, b, size)
    if not len(union):
        return 0, 0
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(both, union[-1], side="right")), len(union)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated |A and B| / |A or B|."""
    n, of = _shared(a, b, size)
    return n / of if of else 1.0


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated |A and B| / |A|."""
    if not len(a):
        return 1.0
    union = distinct_count(merged(a, b, size), size)
    return min(1.0, resemblance(a, b, size) * union / distinct_count(a, size))


def sketches(docs: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, distinct_shingles) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sketch_of(w, size, shingle) for w in hash_texts(b.column("text").to_pylist(), SPACES)]
            out = [b.column("doc_id"), pa.array([as_text(x) for x in own], pa.string()), pa.array([distinct_count(x, size) for x in own], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "fingerprint", "distinct_shingles"])

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string, distinct_shingles double")


def merge_sketches(rows: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """The sketch of each group's union, from its members' ``fingerprint``.

    Only the smallest ``size`` hashes of each group leave a task, so a group
    with most of the rows costs no more than another.
    """
    code = F.hex(F.unbase64("fingerprint"))
    hashes = F.expr("transform(sequence(1, length(__h), 16), i -> substring(__h, i, 16))")
    one = rows.select(*by, code.alias("__h")).where("length(__h) > 0").select(*by, F.explode(hashes).alias("__x")).distinct()
    first = one.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("__x"))).where(F.col("__k") <= size)
    merged_rows = first.groupBy(*by).agg(F.base64(F.unhex(F.array_join(F.array_sort(F.collect_list("__x")), ""))).alias("fingerprint"))
    keys = rows.select(*by).distinct()
    same = [keys[c].eqNullSafe(merged_rows[c]) for c in by]
    return keys.join(merged_rows, same, "left").select(*[keys[c] for c in by], F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def _chars(text: bytes) -> np.ndarray:
    """The places where code points begin."""
    return np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)


def edited_text(own: bytes, after: bytes) -> bytes:
    """The last half of the code points replaced by the first as many (or
    all) of the next text."""
    at, cut = _chars(own), len(_chars(own)) // 2
    keep = own[: at[len(at) - cut]] if cut else own
    other = _chars(after)
    return keep + (after[: other[cut]] if cut < len(other) else after if cut else b"")


class _Row:
    """A document with its sketch."""

    def __init__(self, doc_id, text: bytes, words: np.ndarray, size: int, shingle: int):
        self.doc_id, self.text, self.sketch = doc_id, text, sketch_of(words, size, shingle)


def _compared(pairs: list[tuple[_Row, _Row]], size: int, shingle: int, like: pa.DataType) -> pa.RecordBatch:
    """The output of each document, from it and its successor."""
    texts = [edited_text(a.text, b.text) for a, b in pairs]
    rows = []
    for (a, b), text, words in zip(pairs, texts, hash_texts(texts, SPACES)):
        new = sketch_of(words, size, shingle)
        rows.append((
            a.doc_id, len(_chars(a.text)), hashlib.sha256(text).hexdigest(), as_text(a.sketch), as_text(new),
            resemblance(a.sketch, new, size), resemblance(a.sketch, b.sketch, size), distinct_count(a.sketch, size),
        ))
    kinds = [like, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


_OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double"
_NAMES = ["doc_id", *[f.split()[0] for f in _OUT.split(", ")]]


def _key(doc_id, tie) -> tuple:
    return (doc_id is not None, doc_id, tie) if doc_id is not None else (False, 0, tie)


def _first_keys(keys: DataFrame, ranges: int) -> list[tuple]:
    """The first (doc_id, tie) of each of about ``ranges`` ranges of the
    documents: a row for each range, not for each document."""
    first = keys.repartitionByRange(ranges, "doc_id", "tie").groupBy(F.spark_partition_id()).agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("k")
    )
    return sorted(_key(r["k"]["doc_id"], r["k"]["tie"]) for r in first.collect())


def edited_fingerprints(docs: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Each document beside its edited text and the document after it.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, distinct_shingles), ascending doc_id deciding which
    document is next (null first, equal ids by text hash); after the last
    comes the first.  The texts are shuffled once, by ranges of doc_id; the
    first document of each range is also sent to the range before it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", utf8().alias("text"), F.xxhash64("text").alias("tie"))
    parts = conf_partitions(docs.sparkSession)
    firsts = _first_keys(rows.select("doc_id", "tie"), 4 * parts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_key(*k) for k in zip(b.column("doc_id").to_pylist(), b.column("tie").to_pylist())]
            ranges = [bisect_right(firsts, k) - 1 for k in keys]
            heads = [i for i, (k, r) in enumerate(zip(keys, ranges)) if firsts[r] == k]
            ends = [0] * len(keys) + [1] * len(heads)
            ranges += [(ranges[i] - 1) % len(firsts) for i in heads]
            out = b.take(pa.array([*range(len(keys)), *heads], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(ends, pa.int32()), *out.columns], names=["range", "end", *out.schema.names])

    dealt_rows = rows.mapInArrow(dealt, f"range int, end int, doc_id {kind}, text binary, tie bigint")
    ordered = dealt_rows.repartition(parts, "range").sortWithinPartitions("range", "end", "doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at, open_range = None, None, False
        for b in batches:
            like, texts, pairs = b.column("doc_id").type, b.column("text").to_pylist(), []
            words = hash_texts(texts, SPACES)
            for r, end, doc_id, text, w in zip(b.column("range").to_pylist(), b.column("end").to_pylist(), b.column("doc_id").to_pylist(), texts, words):
                row = _Row(doc_id, text, w, size, shingle)
                if r == at and open_range:
                    pairs.append((before, row))
                elif r == at:  # a further copy of the range's end
                    continue
                before, at, open_range = row, r, not end
            if pairs:
                yield _compared(pairs, size, shingle, like)

    return ordered.select("range", "end", "doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_OUT}")
