"""Token ids as binary shards under Re-Pair grammar compression.

Documents are encoded in ascending doc_id order, each followed by an end id,
and the ids are cut into shards.  In a shard, repeated id pairs are replaced by
nonterminals until no pair occurs ``LEAST`` times.  Each round takes the most
frequent pairs in which no symbol is a first part of one and a second part of
another; their places cannot overlap, so a round replaces all of them at once.
In a run of one symbol, pairs are taken from the left.  No pair holds the end
id, so documents begin on whole symbols.

A shard is a row of a Parquet table:

    part, shard       its range of documents, and place in it
    start, n_ids      ids of the range before the shard, and in it
    rules             pairs, all left parts before the right ones: rule k is
                      symbol ``base + k``
    lengths           expansion length of each rule
    symbols           the compressed ids, u2 or u4 (``width``)
    doc_ids           the documents with ids in the shard,
    doc_starts        where they begin, in ids of the range,
    doc_ends          and where their ids in this shard end

Numbers (u4, if not said) are kept as byte planes, lowest bytes first, under
zstd: high bytes that are mostly zero take next to no space.

Ids at any place are decoded alone: running sums of the symbols' lengths find
the symbols that cover them.

Cases: null text is empty and gives the end id alone; a null doc_id sorts
first; equal ids are ordered by text hash; a document longer than a shard goes
on in the next ones; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.session import scratch_path

from .common import utf8
from .text_hash import from_planes, planes
from .tokens import encoder

END_ID = 1
#: ids in a shard, and how often a pair must occur to be replaced
SHARD_IDS, LEAST = 1 << 19, 2
#: a round's rules: its pairs of at least half the greatest count, or so many;
#: counters that sort out rare pairs, as a power of two
ROUND_RULES, SLOT_BITS = 2048, 18
#: steps in which a round's pairs are chosen many at a time, before the rest
STEPS = 8


def _pair_keys(left: np.ndarray, right: np.ndarray, small: bool) -> np.ndarray:
    """A pair as one number; symbols below 2**16 make 32-bit numbers, which
    sort twice as fast."""
    if small:
        return (left << np.uint32(16)) | right
    return (left.astype(np.uint64) << np.uint64(32)) | right


def _slots(keys: np.ndarray, top: int, slot_bits: int) -> np.ndarray:
    """Counters of pairs; other ones in each round, as ``top`` has grown."""
    bits = 8 * keys.itemsize
    odd = keys.dtype.type((0x9E3779B97F4A7C15 * (2 * top + 1)) >> (64 - bits) & (2**bits - 1) | 1)
    return ((keys * odd) >> keys.dtype.type(bits - slot_bits)).astype(np.intp)


def _limit(counts: np.ndarray) -> int:
    """How many pairs a round replaces; four times as many are looked at."""
    return max(ROUND_RULES, np.count_nonzero(2 * counts >= counts.max(initial=0)))


def _frequent(keys: np.ndarray, tally: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of the most frequent pairs, sorted: all that occur as
    often as the last one that a round looks at, and more.
    ``tally`` has each place's counter, which is no less than its pair's count;
    0 for places that do not count."""
    # pairs of a count are in counters of it or more: as many counters as a
    # round needs and half as many again mostly hold enough pairs
    counters = np.bincount(tally)
    counters = np.cumsum((counters / np.maximum(np.arange(len(counters)), 1))[::-1])[::-1]
    least = max(LEAST, np.count_nonzero(counters[1:] >= 6 * ROUND_RULES))
    while True:
        pairs = np.sort(keys.take(np.flatnonzero(tally >= least)))
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        counts = np.diff(np.append(first, len(pairs)))
        often = np.flatnonzero(counts >= least)
        pairs, counts = pairs[first[often]], counts[often]
        if least == LEAST or len(counts) >= 4 * _limit(counts):
            return pairs, counts
        least = LEAST


def _chosen(pairs: np.ndarray, counts: np.ndarray, bits: int, top: int) -> np.ndarray:
    """Pairs of a round, the most frequent first, such that no symbol is both
    a left and a right part; a pair of equal symbols has its symbol alone."""
    limit = _limit(counts)
    below = counts.max() - counts
    if counts.max() < 1 << 16:  # numpy sorts 16-bit numbers in one pass
        below = below.astype(np.uint16)
    best = np.argsort(below, kind="stable")[: 4 * limit]
    lefts, rights = (pairs[best] >> bits).astype(np.intp), (pairs[best] & ((1 << bits) - 1)).astype(np.intp)
    is_left, is_right = np.zeros(top, dtype=bool), np.zeros(top, dtype=bool)
    taken, none = np.zeros(len(best), dtype=bool), len(best)
    left_at, right_at = np.full(top, none, dtype=np.int32), np.full(top, none, dtype=np.int32)
    rest = np.arange(len(best))
    # pairs whose symbols no earlier open pair has in the other place are
    # taken together; few steps decide nearly all
    for _ in range(STEPS):
        if not len(rest):
            break
        a, b = lefts.take(rest), rights.take(rest)
        left_at[a[::-1]], right_at[b[::-1]] = rest[::-1], rest[::-1]
        sure = (right_at.take(a) >= rest) & (left_at.take(b) >= rest)
        left_at[a], right_at[b] = none, none
        sure_at = np.flatnonzero(sure)
        taken[rest.take(sure_at)] = is_left[a.take(sure_at)] = is_right[b.take(sure_at)] = True
        rest = rest.take(np.flatnonzero(~(sure | is_right.take(a) | is_left.take(b))))
    for k, a, b in zip(rest.tolist(), lefts[rest].tolist(), rights[rest].tolist()):
        if not (is_right[a] or is_left[b]):
            taken[k] = is_left[a] = is_right[b] = True
    return np.sort(pairs[best[taken][:limit]])


def _places(names: np.ndarray, keys: np.ndarray, slots: np.ndarray, top: int, slot_bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in ``keys``, index in ``names``) of the keys that are names.
    ``table``, all 0 before and after, names a pair by its counter."""
    own, number = _slots(names, top, slot_bits), np.arange(1, len(names) + 1, dtype=table.dtype)
    table[own] = number
    place = table.take(slots, mode="clip")
    at = np.flatnonzero(place > 0)
    place = place.take(at).astype(np.intp) - 1
    lost = np.flatnonzero(table[own] != number)  # their counter is another name's
    table[own] = 0
    keys = keys.take(at)
    same = names.take(place) == keys
    hit = np.flatnonzero(same)
    if not len(lost):
        return at.take(hit), place.take(hit)
    rest = np.flatnonzero(~same)
    near = np.minimum(np.searchsorted(names[lost], keys.take(rest)), len(lost) - 1)
    late = names[lost][near] == keys.take(rest)
    return np.concatenate([at.take(hit), at[rest[late]]]), np.concatenate([place.take(hit), lost[near[late]]])


def compress(ids: np.ndarray, base: int, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) of ids below ``base``; rule k is (left, right).

    The sequence is a linked list between two end ids.  A round looks at the
    live places alone: a pair below ``LEAST`` cannot become frequent, as pairs
    that come up hold a symbol of the last round, so its places are left.
    """
    n, end = len(ids), np.uint32(end_id)
    # symbols are numbered from those that occur, in their order: pairs are
    # small numbers then, and sort as they would
    used = np.flatnonzero(np.bincount(np.append(ids, end), minlength=base))
    number = np.zeros(base, dtype=np.uint32)
    number[used] = np.arange(len(used), dtype=np.uint32)
    end = number[end]
    seq = np.concatenate(([end], number.take(ids), [end]))
    after, before = np.arange(1, n + 3), np.arange(-1, n + 1)
    live = (seq != end) & np.append(seq[1:] != end, False)
    stay = np.ones(n + 2, dtype=bool)
    stay[[0, n + 1]] = False
    rules, top = [np.empty((0, 2), dtype=np.uint32)], len(used)
    table = np.zeros((1 << SLOT_BITS) + 1, dtype=np.int32)
    while True:
        small = top <= 1 << 16
        bits = 16 if small else 32
        at = np.flatnonzero(live)
        left, right = seq.take(at, mode="clip"), seq.take(after.take(at, mode="clip"), mode="clip")
        keys = _pair_keys(left, right, small)
        # fewer places need fewer counters
        slot_bits = min(SLOT_BITS, len(keys).bit_length() + 1)
        slots = _slots(keys, top, slot_bits)
        tally = np.bincount(slots, minlength=1 << slot_bits)
        # in a run of one symbol, every other place counts, from the left
        again = equal = np.flatnonzero(left == right)
        if len(equal):
            index = np.arange(len(equal))
            begins = np.append(True, (after[at[equal[:-1]]] != at[equal[1:]]) | (keys[equal[:-1]] != keys[equal[1:]]))
            again = equal[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 1]
            np.subtract.at(tally, slots[again], 1)
        tally = tally.take(slots, mode="clip")
        live[at] = tally >= LEAST
        tally[again] = 0
        slots[again] = 1 << slot_bits  # which no pair has
        pairs, counts = _frequent(keys, tally)
        if not len(pairs):
            break
        names = _chosen(pairs, counts, bits, top)
        parts = np.stack([names >> bits, names & ((1 << bits) - 1)], axis=1).astype(np.uint32)
        rules.append(parts)
        hit, place = _places(names, keys, slots, top, slot_bits, table)
        at = at.take(hit)
        gone = after.take(at)
        seq[at] = (top + place).astype(np.uint32)
        stay[gone] = live[gone] = False
        gone = after[at] = after.take(gone)
        before[gone] = at
        live[at] = seq.take(gone) != end
        back = before.take(at)
        live[back] = seq.take(back) != end
        top += len(parts)
    symbol = np.concatenate([used, np.arange(base, base + top - len(used))]).astype("<u4")
    return symbol.take(seq.take(np.flatnonzero(stay))), symbol.take(np.concatenate(rules))


def _rounds(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Stretches of rules whose parts all come before the stretch."""
    latest, start = np.maximum.accumulate(rules.max(axis=1, initial=0).astype(np.int64)), 0
    while start < len(rules):
        stop = int(np.searchsorted(latest, base + start))
        yield start, stop
        start = stop


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each rule; parts come before the whole."""
    of = np.ones(base + len(rules), dtype="<u4")
    for start, stop in _rounds(rules, base):
        of[base + start : base + stop] = of[rules[start:stop]].sum(axis=1)
    return of[base:]


def symbol_lengths(symbols: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    of = np.ones(base + len(lengths), dtype=np.int64)
    of[base:] = lengths
    return of[symbols]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one behind the other."""
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    places += np.arange(len(places))
    return places


#: rules up to this length are written out once, where a shard is decoded as a whole
SHORT = 64


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids of symbols: long ones are split, a level of the grammar at a
    time, until each is an id or a rule that is written out."""
    lengths = rule_lengths(rules, base) if lengths is None else lengths
    of = symbol_lengths(np.arange(base + len(rules)), lengths, base)
    short = SHORT if len(symbols) > len(rules) else 1
    # the ids of each id and short rule, parts before wholes
    sizes = np.where(of <= short, of, 0)
    begin = np.cumsum(sizes) - sizes
    flat = np.arange(begin[-1] + sizes[-1] if len(sizes) else 0, dtype=np.uint32)
    for start, stop in _rounds(rules, base) if short > 1 else ():
        parts = rules[start:stop][of[base + start : base + stop] <= short].ravel()
        at = begin[base + start]
        ids = flat.take(_runs(begin.take(parts), of.take(parts)))
        flat[at : at + len(ids)] = ids
    seq = symbols.astype(np.intp)
    while len(split := np.flatnonzero(of.take(seq) > short)):
        parts = rules[seq[split] - base]
        at = split + np.arange(len(split))
        seq = np.insert(seq, split + 1, parts[:, 1])
        seq[at] = parts[:, 0]
    return flat.take(_runs(begin.take(seq), of.take(seq)))


def decode_range(symbols, rules, lengths, base: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard, without decoding the rest."""
    ends = np.cumsum(symbol_lengths(symbols, lengths, base))
    first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    skipped = ends[first - 1] if first else 0
    return expand(symbols[first:last], rules, base, lengths)[start - skipped : stop - skipped]


def _schema(doc_id: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("part", pa.int32()), ("shard", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("base", pa.int32()), ("width", pa.int32()),
        ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("doc_ids", pa.list_(doc_id)), ("doc_starts", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int32())),
    ])


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards.  The texts are
    shuffled once, into ranges of doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", utf8().alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        base = own.tokenizer.get_vocab_size()
        end = np.array([END_ID], dtype="<u4").tobytes()
        waiting, size, shard, start = [], 0, 0, 0  # waiting: (doc_id, its start, ids as bytes)

        def packed(rows_, like):
            ids = np.frombuffer(b"".join(x for _, _, x in rows_), dtype="<u4")
            symbols, rules = compress(ids, base)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            ends = np.cumsum([len(x) // 4 for _, _, x in rows_])
            values = [part, shard, start, len(ids), base, width, planes(rules.T.ravel()), planes(rule_lengths(rules, base)), planes(symbols.astype(f"<u{width}")), [d for d, _, _ in rows_], [at for _, at, _ in rows_], ends]
            schema = _schema(like)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        like = None
        for b in batches:
            like = b.column("doc_id").type
            texts = b.column("text").to_pylist()
            for k in range(0, len(texts), 2048):
                for doc_id, ids in zip(b.column("doc_id").slice(k, 2048).to_pylist(), own.encode(texts[k : k + 2048])):
                    ids += end
                    at = start + size
                    while size + len(ids) // 4 >= shard_ids:
                        cut = 4 * (shard_ids - size)
                        waiting.append((doc_id, at, ids[:cut]))
                        yield packed(waiting, like)
                        waiting, size, shard, start, ids = [], 0, shard + 1, start + shard_ids, ids[cut:]
                    if ids:
                        waiting.append((doc_id, at, ids))
                        size += len(ids) // 4
        if waiting:
            yield packed(waiting, like)

    schema = f"part int, shard bigint, start bigint, n_ids bigint, base int, width int, rules binary, lengths binary, symbols binary, doc_ids array<{kind}>, doc_starts array<bigint>, doc_ends array<int>"
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def _unpacked(rules: bytes, lengths: bytes, symbols: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths) of a stored shard."""
    return from_planes(symbols, f"<u{width}"), np.ascontiguousarray(from_planes(rules, "<u4").reshape(2, -1).T), from_planes(lengths, "<u4")


def _combined(crc1: int, crc2: int, length2: int) -> int:
    """The crc32 of two runs of bytes, from theirs."""
    # appending length2 zero bytes to the first is a linear map of its bits,
    # applied by squaring the one-bit map
    def times(m, v):
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    step = [0xEDB88320] + [1 << k for k in range(31)]
    n = 8 * length2
    while n:
        if n & 1:
            crc1 = times(step, crc1)
        step = [times(step, x) for x in step]
        n >>= 1
    return crc1 ^ crc2


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards
    alone; ``start`` counts the ids of all documents before it."""
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    # one row for each range of documents, as many as writing tasks
    offsets, total = [], 0
    for part, n in sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()):
        offsets.append((part, total))
        total += n
    before = spark.createDataFrame(offsets, "part int, offset long")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                base, *packed = (b.column(c)[i].as_py() for c in ("base", "rules", "lengths", "symbols", "width"))
                symbols, rules, lengths = _unpacked(*packed)
                ids = expand(symbols, rules, base, lengths)
                ids = ids.astype("<u4").tobytes()
                ends = b.column("doc_ends")[i].values.to_numpy().astype(np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                crcs = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(starts, ends)]
                at = starts + b.column("start")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("part")[i].as_py()] * len(ends), pa.int32()), b.column("doc_ids")[i].values, b.column("doc_starts")[i].values, pa.array(at), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                    names=["part", "doc_id", "doc_start", "at", "n", "crc"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs, ns = [], []
            for own in b.column("pieces").to_pylist():
                crc, n = own[0]["crc"], own[0]["n"]
                for x in own[1:]:
                    crc, n = _combined(crc, x["crc"], 4 * x["n"]), n + x["n"]
                crcs.append(crc)
                ns.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "start", "base", "width", "rules", "lengths", "symbols", "doc_ids", "doc_starts", "doc_ends").mapInArrow(
        pieces, f"part int, doc_id {kind}, doc_start bigint, at bigint, n bigint, crc bigint"
    )
    whole = rows.groupBy("part", "doc_start").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))
    whole = whole.join(F.broadcast(before), "part").select("doc_id", (F.col("doc_start") + F.col("offset")).alias("start"), "pieces")
    return whole.mapInArrow(joined, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(spark: SparkSession, path: str, part: int, start: int, stop: int) -> np.ndarray:
    """Random access: ids ``start`` to ``stop`` of a range of documents; only
    the shards that hold them are read, and only their symbols decoded."""
    shards = spark.read.parquet(path).where((F.col("part") == part) & (F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    out = []
    for r in shards.orderBy("start").collect():
        symbols, rules, lengths = _unpacked(r["rules"], r["lengths"], r["symbols"], r["width"])
        out.append(decode_range(symbols, rules, lengths, r["base"], max(0, start - r["start"]), min(r["n_ids"], stop - r["start"])))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def token_ids(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as shards (to ``path``, else to the shared folder) and
    read each document's digest back from them."""
    path = path or scratch_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer)
    return read_documents(docs.sparkSession, path)
