"""Ranked lexical search: the best documents for each query text.

A document's score is the sum over the query's distinct terms of
``w * ((10**9 * tf) div (1000 * tf + K1 * m))`` with
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and
``m = 100 - B + (B * n * N) div L``: a BM25 score in integers.  ``N`` counts the
documents with a term, ``L`` all terms, ``n`` the document's; terms are runs of
letters, digits and bytes above 0x7F, A-Z taken as a-z.

1. ``build_index`` packs documents into segments of about ``SEGMENT_WORDS``
   words: a row for each, with the ids in ascending order, the lengths, and the
   posting lists (document, tf) of all terms.  It depends on no query.
2. ``search`` sums the document frequencies of the queries' terms over the
   segments, then takes each segment by itself.  The impacts of each posting
   list get a sparse table of range maxima, so the greatest impact of a term
   among any documents ``lo .. hi - 1`` is the greater of two entries.
3. For each query the documents of a segment are one interval.  The sum of its
   terms' range maxima bounds the score of every document inside.  Intervals
   with the best bounds are split at their document of greatest single impact;
   it is scored, and both sides get bounds of their own.  An interval whose
   bound cannot enter the best ``k`` any more is dropped.  The best found in a
   task's earlier segments count from the start.
4. The ``k`` best of each task are ranked per query.

Queries are taken in blocks of about ``BLOCK_TERMS`` terms, each block against
all segments, so what is broadcast stays bounded.

Cases: a null text and one without terms give no postings and count nowhere; a
query without terms, or without a hit, has no rows; equal scores go by ascending
doc_id, null last; rows of one doc_id are documents of their own, and rows of one
item_id queries of their own; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, utf8
from .text_hash import NON_ALNUM, U64, from_planes, hash_texts, planes

#: documents returned for a query
TOP = 10
#: length normalisation in hundredths, and saturation in tenths
B, K1 = 90, 8
#: words and documents of a segment, about
SEGMENT_WORDS, SEGMENT_DOCS = 1 << 20, 1 << 16
#: distinct terms of a block of queries, about
BLOCK_TERMS = 1 << 18
#: intervals split in one step
STEP = 64


def _segment(ids: pa.Array, words: list[np.ndarray]) -> dict:
    """The row of a segment from its documents' ids and word hashes."""
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    length = np.array([len(w) for w in words], dtype=np.int64)
    order = order[length[order] > 0]
    doc = np.empty(len(words), dtype=np.uint32)
    doc[order] = np.arange(len(order), dtype=np.uint32)
    term = np.concatenate(words)
    doc = np.repeat(doc, length)
    by = np.lexsort((doc, term))
    term, doc = term[by], doc[by]
    new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))
    tf = np.diff(np.append(new, len(term))).astype(np.uint32)
    term, doc = term[new], doc[new]
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    return {
        "n_docs": len(order),
        "n_terms": int(length.sum()),
        "doc_ids": ids.take(pa.array(order)),
        "lengths": planes(length[order]),
        "terms": term[first].tobytes(),
        "dfs": planes(np.diff(np.append(first, len(term))).astype(np.uint32)),
        "docs": planes(doc),
        "tfs": planes(tf),
    }


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of all documents, as a stored table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = {"n_docs": pa.int64(), "n_terms": pa.int64(), "doc_ids": None, "lengths": pa.binary(), "terms": pa.binary(), "dfs": pa.binary(), "docs": pa.binary(), "tfs": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, size = [], [], 0

        def flush():
            row = _segment(pa.chunked_array(ids).combine_chunks(), words)
            like = pa.list_(ids[0].type)
            out = [pa.array([row[n]], like if t is None else t) if n != "doc_ids" else pa.ListArray.from_arrays([0, len(row[n])], row[n]) for n, t in names.items()]
            return pa.RecordBatch.from_arrays(out, names=list(names))

        for b in batches:
            hashed = hash_texts(b.column("text").to_pylist(), NON_ALNUM)
            start = 0
            for k, w in enumerate(hashed):
                words.append(w)
                size += len(w)
                if size >= SEGMENT_WORDS or len(words) >= SEGMENT_DOCS:
                    ids.append(b.column("doc_id").slice(start, k + 1 - start))
                    if size:
                        yield flush()
                    ids, words, size, start = [], [], 0, k + 1
            if start < len(hashed):
                ids.append(b.column("doc_id").slice(start))
        if size:
            yield flush()

    rows = docs.select("doc_id", utf8().alias("text")).mapInArrow(
        run, f"n_docs bigint, n_terms bigint, doc_ids array<{kind}>, lengths binary, terms binary, dfs binary, docs binary, tfs binary"
    )
    return stored(rows, "search-index")


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct term hashes of each query row."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [np.unique(w).view(np.int64).tolist() for w in hash_texts(b.column("text").to_pylist(), NON_ALNUM)]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "terms"])

    return items.select("item_id", utf8().alias("text")).mapInArrow(run, f"item_id {kind}, terms array<bigint>")


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents that hold each of the (sorted) terms."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = shared.value, np.zeros(len(shared.value), dtype=np.int64)
        for b in batches:
            for own, df in zip(b.column("terms").to_pylist(), b.column("dfs").to_pylist()):
                own = np.frombuffer(own, dtype=U64)
                at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                total += np.where(own[at] == wanted, from_planes(df, np.uint32)[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    rows = index.select("terms", "dfs").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(len(terms), dtype=np.int64)
    for r in rows:
        out[r["term"]] = r["df"]
    return out


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a posting's score that its term's weight multiplies."""
    if len(length) and B * int(length.max()) * n_docs >= 2**63:
        norm = np.array([B * n * n_docs // n_terms for n in length.tolist()], dtype=np.int64)
    else:
        norm = B * length * n_docs // n_terms
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + K1 * (100 - B + norm))


class _Postings:
    """The posting lists of a segment's share of the wanted terms, one after
    the other, with range-maximum tables over them."""

    def __init__(self, row: dict, wanted: np.ndarray, n_docs: int, n_terms: int):
        own = np.frombuffer(row["terms"], dtype=U64)
        df = from_planes(row["dfs"], np.uint32).astype(np.int64)
        ends = np.cumsum(df)
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        self.here = np.flatnonzero(own[at] == wanted)
        at = at[self.here]
        count = df[at]
        self.ends = np.cumsum(count)
        self.starts = self.ends - count
        places = np.repeat(ends[at] - count - self.starts, count) + np.arange(count.sum())
        self.doc = from_planes(row["docs"], np.uint32)[places].astype(np.int64)
        tf = from_planes(row["tfs"], np.uint32)[places]
        self.size = row["n_docs"]
        self.impact = impacts(tf, from_planes(row["lengths"], np.int64)[self.doc], n_docs, n_terms)
        #: term and document of each posting in one ascending number
        self.key = np.repeat(np.arange(len(at)), count) * self.size + self.doc
        self.table = self._tables(int(count.max(initial=0)))
        self.log = np.zeros(int(count.max(initial=0)) + 1, dtype=np.int64)
        for k in range(1, len(self.table)):
            self.log[1 << k :] = k

    def _tables(self, longest: int) -> np.ndarray:
        """Row k: for each posting, the place of the greatest impact among it
        and the next 2**k - 1, the first of equals."""
        n = len(self.impact)
        rows = [np.arange(n, dtype=np.int32)]
        while 1 << len(rows) <= longest:
            last, half = rows[-1], 1 << len(rows) - 1
            other = last[np.minimum(np.arange(half, n + half), n - 1)]
            rows.append(np.where(self.impact[other] > self.impact[last], other, last))
        return np.array(rows)

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the greatest impact in a .. b - 1; -1 where empty."""
        k = self.log[np.maximum(b - a, 0)]
        some = b > a
        one = self.table[k, np.where(some, a, 0)]
        two = self.table[k, np.where(some, b - (1 << k), 0)]
        return np.where(some, np.where(self.impact[two] > self.impact[one], two, one), -1)


def best_documents(seg: _Postings, terms: np.ndarray, weight: np.ndarray, k: int, floor: int, before: int) -> list[tuple[int, int]]:
    """(score, document) of the best ``k`` of a segment, best first, equal
    scores by place.  Only those above ``floor`` count, and those of that score
    at places below ``before``.  ``terms`` are places in ``seg.here``."""
    best_score, best_doc = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    base = terms * seg.size

    def bounded(lo, hi, a, b):
        place = seg.maxima(a, b)
        value = np.where(place >= 0, seg.impact[place] * weight, 0)
        split = seg.doc[place[np.arange(len(a)), value.argmax(axis=1)]]
        bound = value.sum(axis=1)
        keep = (bound > floor) | (bound == floor) & (lo < before)
        return [x[keep] for x in (lo, hi, a, b, bound, split)]

    one = np.zeros(1, dtype=np.int64)
    front = bounded(one, one + seg.size, seg.starts[terms][None, :], seg.ends[terms][None, :])
    while len(front[0]):
        bound = front[4]
        chosen = np.ones(len(bound), dtype=bool)
        if len(bound) > STEP:
            chosen[:] = False
            chosen[np.argpartition(-bound, STEP)[:STEP]] = True
        lo, hi, a, b, _, split = (x[chosen] for x in front)
        key = base[None, :] + split[:, None]
        at = np.searchsorted(seg.key, key)
        at_most = np.minimum(at, len(seg.key) - 1)
        present = seg.key[at_most] == key
        score = np.where(present, seg.impact[at_most] * weight, 0).sum(axis=1)
        best_score, best_doc = np.append(best_score, score), np.append(best_doc, split)
        order = np.lexsort((best_doc, -best_score))[:k]
        best_score, best_doc = best_score[order], best_doc[order]
        if len(order) == k and (best_score[-1] > floor or best_score[-1] == floor and best_doc[-1] < before):
            floor, before = int(best_score[-1]), int(best_doc[-1])
        sides = bounded(np.append(lo, split + 1), np.append(split, hi), np.concatenate((a, at + present)), np.concatenate((at, b)))
        rest = ~chosen & ((bound > floor) | (bound == floor) & (front[0] < before))
        front = [np.concatenate((x[rest], y)) for x, y in zip(front, sides)]
    return [(s, d) for s, d in zip(best_score.tolist(), best_doc.tolist()) if s > floor or s == floor and d <= before]


def _block_results(index: DataFrame, queries: list, k: int, n_docs: int, n_terms: int, item_kind: str) -> DataFrame:
    """(q, item_id, doc_id, score) of the best documents of each task."""
    terms = np.unique(np.concatenate([np.array(q["terms"], dtype=np.int64).view(U64) for q in queries]))
    df = _frequencies(index, terms)
    weight = np.array([term_weight(n_docs, int(x)) if x else 0 for x in df], dtype=np.int64)
    terms, weight = terms[weight > 0], weight[weight > 0]
    of = [np.searchsorted(terms, own[np.isin(own, terms)]) for own in (np.array(q["terms"], dtype=np.int64).view(U64) for q in queries)]
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((terms, weight, of, [q["item_id"] for q in queries]))
    doc_kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, of, items = shared.value
        top: list[list] = [[] for _ in of]  # (-score, null, doc_id) of each query, ascending
        like, item_like = None, None
        for b in batches:
            like = b.schema.field("doc_ids").type.value_type
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in ("n_docs", "lengths", "terms", "dfs", "docs", "tfs")}
                ids = b.column("doc_ids")[i].values.to_pylist()
                seg = _Postings(row, terms, n_docs, n_terms)
                names = [(x is None, x) for x in ids]
                where = np.full(len(terms), -1, dtype=np.int64)
                where[seg.here] = np.arange(len(seg.here))
                for q, own in enumerate(of):
                    here = own[where[own] >= 0]
                    if not len(here):
                        continue
                    floor, before = 0, 0
                    if len(top[q]) == k:
                        worst = top[q][-1]
                        floor, before = -worst[0], _places_below(names, worst[1:])
                    found = best_documents(seg, where[here], weight[here], k, floor, before)
                    if found:
                        top[q] = sorted(top[q] + [(-s, *names[d]) for s, d in found], key=_order)[:k]
        rows = [(q, items[q], x[2], -x[0]) for q, best in enumerate(top) for x in best]
        if rows:
            q, item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(item), pa.array(doc, like), pa.array(score, pa.int64())], names=["q", "item_id", "doc_id", "score"])

    return index.drop("n_terms").mapInArrow(run, f"q int, item_id {item_kind}, doc_id {doc_kind}, score bigint")


def _order(x: tuple) -> tuple:
    return x[:2] if x[1] else x  # a null id is not compared


def _places_below(names: list, worst: tuple) -> int:
    """How many of a segment's (ascending) ids come before ``worst``."""
    low, high = 0, len(names)
    while low < high:
        mid = (low + high) // 2
        if _order((0, *names[mid])) < _order((0, *worst)):
            low = mid + 1
        else:
            high = mid
    return low


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    kind = items.schema["item_id"].dataType.simpleString()
    doc_kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    queries = stored(query_terms(items).where(F.size("terms") > 0), "search-queries")
    size = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks = int(size) // BLOCK_TERMS + 1
    block = F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks))
    out = []
    for i in range(blocks if totals["n"] else 0):
        own = queries.where(block == i).collect()  # a block of bounded size
        if own:
            found = _block_results(index, own, k, totals["n"], totals["l"], kind)
            found = found if blocks == 1 else stored(found, "search-block")
            out.append(found.select(F.lit(i).alias("block"), "*"))
    if not out:
        return index.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score bigint")
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    best = Window.partitionBy("block", "q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    return search(build_index(docs), items, k)
