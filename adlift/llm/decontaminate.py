"""Benchmark decontamination by winnowing.

Of every ``span - k + 1`` consecutive k-gram hashes of a text the smallest
(rightmost among equals) is kept as a fingerprint, so two texts that share
``span`` words in a row always share a fingerprint inside that run.  Training
and benchmark fingerprints are joined, and each hit is extended word by word
to both sides; a run of ``span`` equal words or more is a shared passage.  An
item shorter than ``span`` words is one window, met by its whole-sequence hash.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased;
they are compared by 64-bit hash.

Cases: a null text has no words and is clean; an item without words occurs
nowhere; items with a null id hit words but are not listed; repeated items are
one item; repeated documents each give their row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8
from .text_hash import NON_ALNUM, U64, hash_texts, ngram_hashes

SPAN, K = 10, 5
#: bits of the filter that documents' fingerprints pass before the join: 64
#: for each benchmark fingerprint, within these bounds (16 MB at most)
FILTER_BITS = (1 << 16, 1 << 27)

_SEED = "struct<start:int,n:int,h:bigint,words:binary>"


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """The places of the kept fingerprints, ascending."""
    if len(grams) < width:
        return np.empty(0, dtype=np.int64)
    # the smallest of each window by doubling comparisons; ties go right
    best = np.arange(len(grams) - width + 1)
    for step in range(1, width):
        other = np.arange(step, step + len(best))
        best = np.where(grams[other] <= grams[best], other, best)
    return best[np.concatenate(([True], best[1:] != best[:-1]))]


def _around(words: np.ndarray, starts: np.ndarray, k: int, span: int, outside: int) -> np.ndarray:
    """For each k-gram, its words with ``span - k`` more on each side."""
    side = span - k
    padded = np.concatenate([np.full(side, outside, U64), words, np.full(side, outside, U64)])
    return padded[starts[:, None] + np.arange(k + 2 * side)]


def fingerprints(words: np.ndarray, span: int, k: int, outside: int):
    """(place, hash, surrounding words) of the kept k-grams."""
    grams = ngram_hashes(words, k)
    at = winnow(grams, span - k + 1)
    return at, grams[at], _around(words, at, k, span, outside)


def item_fingerprints(items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(item_id string, n, h, words): a row for each fingerprint of each
    item; n < span marks an item of so few words, with its whole hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), ([], [], [], [])
            for item, words in zip(ids, hash_texts(b.column(1).to_pylist(), NON_ALNUM)):
                if 0 < len(words) < span:
                    rows = [(len(words), ngram_hashes(words, len(words))[0], b"")]
                else:
                    _, h, around = fingerprints(words, span, k, 1)
                    rows = [(span, x, y.tobytes()) for x, y in zip(h, around)]
                for n, h, y in rows:
                    for c, v in zip(out, (item, n, int(h.view(np.int64)), y)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                names=["item_id", "n", "h", "words"],
            )

    it = items.select(F.col("item_id").cast("string").alias("item_id"), utf8().alias("text"))
    return it.mapInArrow(run, "item_id string, n int, h bigint, words binary").distinct()


def _filter(prints: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """A bit filter of the benchmark's hashes (of bounded size, whatever the
    benchmark's), its shift, and the short lengths that occur."""
    count = max(1, prints.count())
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (64 * count - 1).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    slot = F.shiftrightunsigned("h", shift) + 1  # bit positions count from one
    rows = (
        prints.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
        .collect()
    )
    table = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bitmap"]), dtype=np.uint8)
        table[(r["bucket"] - 1) * len(part) :][: len(part)] = part
    lengths = [r[0] for r in prints.select("n").distinct().collect()]
    return table, shift, sorted(lengths)


def _document_seeds(docs: DataFrame, bits, shift: int, lengths: list[int], span: int, k: int, row: str | None) -> DataFrame:
    """(uid, doc_id, n_words, seeds): every document, with the fingerprints
    that pass the filter; uid is column ``row`` if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema(
        [("uid", pa.int64()), ("n_words", pa.int64()), ("seeds", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("words", pa.binary())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, uid = shared.value, TaskContext.get().partitionId() << 33

        def passing(h):
            slot = (h >> U64(shift)).astype(np.int64)
            return np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)

        for b in batches:
            n_words, seeds = [], []
            for words in hash_texts(b.column("text").to_pylist(), NON_ALNUM):
                own = []
                for n in lengths:
                    if n < span:
                        h = ngram_hashes(words, n)
                        hit = passing(h)
                        own += [{"start": int(i), "n": n, "h": int(h[i].view(np.int64)), "words": b""} for i in hit]
                if span in lengths and len(words) >= span:
                    grams = ngram_hashes(words, k)
                    at = winnow(grams, span - k + 1)
                    at = at[passing(grams[at])]
                    around = _around(words, at, k, span, 0)
                    own += [{"start": int(i), "n": span, "h": int(grams[i].view(np.int64)), "words": w.tobytes()} for i, w in zip(at, around)]
                n_words.append(len(words))
                seeds.append(own)
            uids = b.column("uid") if row else pa.array(np.arange(uid, uid + len(n_words)))
            uid += len(n_words)
            cols = [uids, b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(seeds, schema.field("seeds").type)]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "doc_id", "n_words", "seeds"])

    own = [F.col(row).alias("uid")] if row else []
    return docs.select("doc_id", utf8().alias("text"), *own).mapInArrow(run, f"uid bigint, doc_id {kind.simpleString()}, n_words bigint, seeds array<{_SEED}>")


def _extended(pairs: DataFrame, span: int, k: int) -> DataFrame:
    """(uid, item_id, start, stop) of the seeds whose run of equal words, as
    far as it can matter to windows over the seed, has ``span`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = span - k
        for b in batches:
            start = b.column("start").to_numpy(zero_copy_only=False).astype(np.int64)
            stop = start + b.column("n").to_numpy(zero_copy_only=False)
            ok = np.ones(len(start), dtype=bool)
            full = np.flatnonzero(stop - start == span)
            if len(full):
                ours, theirs = (
                    np.frombuffer(b"".join(b.column(c).take(pa.array(full)).to_pylist()), dtype=U64).reshape(len(full), -1) for c in ("words", "item_words")
                )
                same = ours == theirs
                left = np.minimum.accumulate(same[:, :side][:, ::-1], axis=1).sum(axis=1)
                right = np.minimum.accumulate(same[:, side + k :], axis=1).sum(axis=1)
                ok[full] = same[:, side : side + k].all(axis=1) & (left + k + right >= span)
                stop[full] = start[full] + k + right
                start[full] -= left
            out = [b.column("uid"), b.column("item_id"), pa.array(start), pa.array(stop)]
            yield pa.RecordBatch.from_arrays(out, names=["uid", "item_id", "start", "stop"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, "uid bigint, item_id string, start bigint, stop bigint")


def _marks(docs: DataFrame, items: DataFrame, span: int, k: int, row: str | None = None) -> DataFrame:
    """(uid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated): a
    row for each document.

    One pass over the texts; what is shuffled are the fingerprints that the
    benchmark may have, not texts.
    """
    spark = docs.sparkSession
    prints = stored(item_fingerprints(items, span, k), "benchmark-prints")
    seeds = stored(_document_seeds(docs, *_filter(prints), span, k, row), "document-seeds")
    hits = seeds.select("uid", F.inline("seeds")).join(prints.withColumnRenamed("words", "item_words"), ["h", "n"])
    hits = stored(_extended(hits.select("uid", "start", "n", "words", "item_id", "item_words"), span, k), "shared-passages")
    words = (
        hits.select("uid", "start", "stop").distinct()
        .select("uid", F.explode(F.sequence("start", F.col("stop") - 1)).alias("place"))
        .distinct().groupBy("uid").agg(F.count("*").alias("n_hit"))
    )
    found = (
        hits.where("item_id is not null").select("uid", "item_id").distinct()
        .groupBy("uid").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
        .select("uid", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("ids"))
    )
    marks = words.join(found, "uid", "left")
    return seeds.select("uid", "doc_id", "n_words").join(marks, "uid", "left").select(
        "uid",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): a row
    for each document."""
    return _marks(docs, items, span, k).drop("uid")


def clean_documents(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated themselves,
    whatever their ids: rows are written with an id of their own first."""
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "document-rows")
    bad = _marks(rows, items, span, k, "__row").where("contaminated").select(F.col("uid").alias("__row"))
    return rows.join(bad, "__row", "left_anti").select(*docs.columns)
