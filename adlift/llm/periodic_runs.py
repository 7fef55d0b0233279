"""Runs: maximal periodic stretches of words in a document.

A run is a stretch of consecutive words whose smallest period is ``q``, of at
least ``max(min_length, exponent * q)`` words, that no neighbouring word extends
keeping that period.  Runs are found by a suffix automaton with link-cut access:

1. Words become numbers.  A word of a run occurs ``exponent`` times in it, so
   words that occur less often cut the document into stretches, and these
   again; what is left goes through the automaton, stretch by stretch.
2. The suffix automaton of a stretch is built word by word.  The suffix links
   make a tree; the states on the path from a prefix's state to the root are
   the suffixes of the prefix.
3. Each state is coloured with the end of its last occurrence.  When word ``i``
   is appended, the access of its prefix recolours the path to ``i``.  The path
   falls into segments of one colour: the longest suffix of a segment, of ``s``
   words, ended last at ``e``, and no longer one ended there.  If the distance
   ``d = i - e`` is within ``s``, the last ``s + d`` words have the smallest
   period ``d`` and cannot be extended to the left: a square that ends at ``i``,
   and the part up to ``i`` of one run.  The last ``i`` that finds a run is its
   end.
4. The access is that of a link-cut tree: its amortised number of recoloured
   segments is ``O(log n)`` a word.  The preferred paths are kept as stacks of
   segments along the heavy chains of the finished tree, without rotations.

Cases: null and empty text have no words and no runs; equal ids stay separate
rows; a null id is an ordinary row; ties in length go to the smaller start, then
to the smaller period; other columns are kept, those named like a result column
as ``<name>_input``.  Memory grows with the longest
stretch that is left of a single text, by some hundred bytes a word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, without_clashes

#: a run has so many words at least, and so many times its period
MIN_LENGTH, EXPONENT = 6, 4
#: cuts by rare words end when one takes less than this share of what is left
CUT_SHARE = 0.02

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class SuffixAutomaton:
    """States in order of creation, 0 the empty word: ``link``, ``size`` (words
    of the longest member) and ``prefix`` (the state of each prefix)."""

    def __init__(self, word: list[int]):
        # the first transition of a state is kept in arrays, others in a dict
        self.link, self.size, self.prefix = array("i", [-1]), array("i", [0]), array("i")
        self._by, self._to, self._more = array("i", [-1]), array("i", [-1]), {}
        for c in word:
            self._append(c)

    def _next(self, p: int, c: int) -> int:
        if self._by[p] == c:
            return self._to[p]
        more = self._more.get(p)
        return more.get(c, -1) if more else -1

    def _put(self, p: int, c: int, to: int) -> None:
        if self._by[p] == c or self._by[p] < 0:
            self._by[p], self._to[p] = c, to
        else:
            self._more.setdefault(p, {})[c] = to

    def _state(self, size: int, link: int, by: int = -1, to: int = -1) -> int:
        self.size.append(size)
        self.link.append(link)
        self._by.append(by)
        self._to.append(to)
        return len(self.size) - 1

    def _append(self, c: int) -> None:
        size, link = self.size, self.link
        p = self.prefix[-1] if self.prefix else 0
        new = self._state(size[p] + 1, 0)
        self.prefix.append(new)
        while p >= 0 and (q := self._next(p, c)) < 0:
            self._put(p, c, new)
            p = link[p]
        if p < 0:
            return
        if size[q] == size[p] + 1:
            link[new] = q
            return
        clone = self._state(size[p] + 1, link[q], self._by[q], self._to[q])
        if q in self._more:
            self._more[clone] = dict(self._more[q])
        while p >= 0 and self._next(p, c) == q:
            self._put(p, c, clone)
            p = link[p]
        link[q] = link[new] = clone


def _heavy_chains(link: array, size: array) -> list[int]:
    """The top state of each state's heavy chain."""
    order = np.argsort(np.frombuffer(size, dtype=np.intc), kind="stable").tolist()
    weight, heavy = [1] * len(order), [-1] * len(order)
    for v in reversed(order[1:]):
        p = link[v]
        weight[p] += weight[v]
    best = [0] * len(order)
    for v in order[1:]:
        p = link[v]
        if weight[v] > best[p]:
            best[p], heavy[p] = weight[v], v
    top = [0] * len(order)
    for v in order[1:]:
        top[v] = top[link[v]] if heavy[link[v]] == v and link[v] else v
    return top


def stretch_runs(word: list[int], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers; the
    exponent is 2 at least."""
    automaton = SuffixAutomaton(word)
    link, size, prefix = automaton.link, automaton.size, automaton.prefix
    top = _heavy_chains(link, size)
    del automaton
    # segments (longest member, last end) of a chain, the uppermost on top
    stacks: dict[int, list[tuple[int, int]]] = {}
    found, latest = {}, {}
    for i, v in enumerate(prefix):
        while v > 0:
            head, own = top[v], size[v]
            stack = stacks.get(head)
            if stack is None:
                stacks[head] = [(own, i)]
            else:
                while stack:
                    longest, end = stack[-1]
                    s, d = min(longest, own), i - end
                    # a colour's path may cross chains: the lowest part counts
                    if s >= d * (exponent - 1) and s + d >= min_length and latest.get(d) != i:
                        latest[d] = i
                        found[i - d - s + 1, d] = i
                    if longest <= own:
                        stack.pop()
                    if longest >= own:  # those below are off the path
                        break
                stack.append((own, i))
            v = link[head]
    return sorted((start, end - start + 1, d) for (start, d), end in found.items())


def _stretches(ids: np.ndarray, min_length: int, exponent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, words) of the parts in which runs can be: cut at words that
    occur less than ``exponent`` times in their part, as long as that pays."""
    places, part = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    width = int(ids.max()) + 1 if len(ids) else 1
    while len(places) >= min_length:
        _, which, count = np.unique(part * width + ids[places], return_inverse=True, return_counts=True)
        keep = np.flatnonzero(count[which] >= exponent)
        if not len(keep):
            return
        new = np.flatnonzero(np.diff(places[keep], prepend=-2) > 1)
        length = np.diff(np.append(new, len(keep)))
        long = np.repeat(length >= min_length, length)
        before, places = len(places), places[keep][long]
        part = np.repeat(np.arange(len(new)), length)[long]
        if before - len(places) <= CUT_SHARE * before:
            break
    for one in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
        if len(one) >= min_length:
            yield int(one[0]), ids[one]


def word_runs(words: list[bytes], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """The runs of a list of words, by start, then period."""
    if len(words) < min_length:
        return []
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
    out = []
    for at, part in _stretches(ids, min_length, exponent):
        out += [(at + start, length, q) for start, length, q in stretch_runs(part.tolist(), min_length, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in no run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with n_words, runs (by start, then period) and collapsed: the
    text's words without the repetitions, joined by one space.  ``exponent`` is
    2 at least."""
    if exponent < 2:
        raise ValueError("runs of an exponent below 2 are not defined")
    docs = without_clashes(docs, ("n_words", "runs", "collapsed"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    kept = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in slices(batches):
            count, found, texts = [], [], []
            for x in b.column("__text").to_pylist():
                words = x.split()  # of bytes: at space and 0x09 to 0x0D
                runs = word_runs(words, min_length, exponent)
                count.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(kept_words(words, runs)))
            out = [*(b.column(n) for n in names), pa.array(count, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "__n", "__runs", "__collapsed"])

    rows = own.withColumn("__text", utf8(text)).mapInArrow(run, f"{kept}, __n bigint, __runs {RUNS}, __collapsed string")
    return rows.toDF(*docs.columns, "n_words", "runs", "collapsed")


def with_tail_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32 of the decimal doc_id and g = h div 10,
    each tenth text (h mod 10 = 0) takes, from word a = g mod n on, its words
    a .. a + p - 1 again and again, p = 1 + (n - a) div (3 + g mod 8); other
    texts, and those of a null id, stay as they are."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for k, (text, h) in enumerate(zip(texts, b.column("h").to_pylist())):
                if h is None or h % 10 or not text or not (words := text.split()):
                    continue
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                tail = words[a : a + p]
                texts[k] = b" ".join(words[:a] + (tail * -(-(n - a) // p))[: n - a])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), h.alias("h")).mapInArrow(run, f"doc_id {kind}, text string")


def run_digests(found: DataFrame) -> DataFrame:
    """A row for each document of ``find_runs``: its longest run, and digests
    of its runs and of its collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    first = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(first, F.lit(0))
    length = -best["less"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * length / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
