"""N-gram Jaccard self-join with a token-group matrix.

Documents are sets of five-word shingles; two of them link when the sets'
Jaccard similarity is at least ``percent``/100.  Similar documents are
partitioned into groups, each with the union of its members' shingles.  A
document can link with a member only if the group's union holds ``percent`` %
of its shingles, so only such groups are opened and compared member by member.

1. Equal sets become one class, held by one 64-bit hash of the set.
2. Classes that share one, two or three min-hashes meet ``HUBS`` members of
   their bucket.  Pairs with a few equal min-hashes partition the classes into
   groups of about ``GROUP`` similar members at most; pairs with most equal are
   compared, and their links form first clusters.
3. The matrix holds, for each shingle, the groups whose members have it among
   the first ``n - ceil(n * percent / 100) + l`` of their ``n`` shingles.  (In
   any common order, two linked sets share ``l`` of these.)  The order takes
   shingles that a counting sketch over all documents calls frequent last, so
   a passage that many documents share makes no candidates of them.
4. A class that shares enough of these with the members of larger clusters in
   a group meets the group.  The group's union bounds its overlap; qualifying
   groups are opened, and a link into each cluster found there is kept, all
   that components need.  ``jaccard_links`` lets a class meet every such group,
   its own cluster's included, and keeps every link.

Cases: null text is empty; a document without words has 0 shingles and is its
own component; with fewer than five words the whole sequence is one shingle;
equal ids stay separate rows; a null id never names a component unless all of
it are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import conf_partitions, slices, stored, utf8
from .components import components
from .text_hash import SPACES, U64, from_planes, hash_texts, planes, shingle_set

SHINGLE, PERCENT = 5, 75
#: members of a group, and queries that meet it in one call, about
GROUP, QUERIES = 512, 256
#: counters of the sketch, by the corpus' size within these bounds; its blocks
COUNTERS, BLOCKS = (1 << 20, 1 << 25), 64
#: min-hashes of a document, how many must agree for one group and before sets
#: are compared, buckets of each kind that a document is in, hubs of a bucket
SIGNATURE, ALIKE, AGREE, BUCKETS, HUBS = 16, 5, 9, 8, 2
#: linked sets must share an n-th of their size among their first shingles
PREFIX = 10
#: shingles that one task of the matrix step takes, about
TASK_TOKENS = 4_000_000
#: bits of the filter of documents whose sets are needed (4 MB)
NEEDED_BITS = 1 << 25

_ODD = np.random.Generator(np.random.PCG64(6)).integers(0, 2**63, SIGNATURE, dtype=U64) * U64(2) + U64(1)


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n, percent: int):
    """First shingles of a set that the matrix holds."""
    return n - -(-n * percent // 100) + -(-n // PREFIX)


def _documents(docs: DataFrame, shingle: int, counters: int) -> DataFrame:
    """A row for each document (doc_id, n, cls, sig), and in rows with a block
    each task's share of the counting sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size, like = np.zeros(counters, dtype=np.uint16), [], 0, None

        def flush():
            if waiting:
                slots = np.sort((np.concatenate(waiting) >> U64(65 - counters.bit_length())).astype(np.uint32))
                first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1]))) if len(slots) else slots
                at, more = slots[first], np.diff(np.append(first, len(slots)))
                counts[at] = np.minimum(counts[at] + more, 65535)  # the order of frequencies needs no more
                waiting.clear()

        for b in slices(batches):
            like = b.column("doc_id").type
            n, cls, sig = [], [], []
            for words in hash_texts(b.column("text").to_pylist(), SPACES):
                tokens = shingle_set(words, shingle)
                n.append(len(tokens))
                cls.append(class_of(tokens))
                sig.append([int((tokens * c).min().view(np.int64)) for c in _ODD] if len(tokens) else [])
                waiting.append(tokens)
                size += len(tokens)
                if size > 1 << 20:
                    flush()
                    size = 0
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.list_(pa.int64())),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=["doc_id", "n", "cls", "sig", "block", "task", "counts"],
            )
        flush()
        if like is not None:
            packed = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, BLOCKS)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(BLOCKS, like), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.list_(pa.int64())),
                 pa.array(range(BLOCKS), pa.int32()), pa.array([task] * BLOCKS, pa.int32()), pa.array(packed, pa.binary())],
                names=["doc_id", "n", "cls", "sig", "block", "task", "counts"],
            )

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n bigint, cls bigint, sig array<bigint>, block int, task int, counts binary"
    )


def _frequency_levels(rows: DataFrame, counters: int) -> np.ndarray:
    """For each counter its level: 0 up to twice the mean, then doublings."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(counters // BLOCKS, dtype=np.int64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), dtype=np.uint16)
        packed = zlib.compress(np.minimum(total, 65535).astype(np.uint16).tobytes(), 1)
        return pa.table({"block": t.column("block").slice(0, 1), "counts": pa.array([packed], pa.binary())})

    parts = rows.where("block is not null").select("block", (F.col("task") % 256).alias("salt"), "counts")
    parts = parts.groupBy("block", "salt").applyInArrow(add, "block int, counts binary")
    blocks = parts.groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    # block by block, so that the driver holds the levels alone
    counts = lambda r: np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.uint16)
    usual = max(1.0, 2 * sum(int(counts(r).sum(dtype=np.int64)) for r in blocks) / counters)
    level = np.ceil(np.log2(np.maximum(np.arange(65536) / usual, 1.0))).astype(np.uint8)
    out = np.zeros(counters, dtype=np.uint8)
    for r in blocks:
        one = level[counts(r)]
        out[r["block"] * len(one) :][: len(one)] = one
    return out


def _shared_prefixes(docs: DataFrame, levels: np.ndarray, buckets: int, shingle: int, percent: int) -> DataFrame:
    """(token, cls) of the prefix shingles that several classes have."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    shift, width = U64(65 - len(levels).bit_length()), 1 << 21

    packing = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary()), ("places", pa.binary())])

    def emit(tokens, owners):
        t, o = np.concatenate(tokens), np.concatenate(owners)
        # buckets by the low bits: the order has spent the high ones
        at = (t & U64(0xFFFFFFFF)).astype(np.int64) % buckets
        order = np.lexsort((t, at))
        ends = np.searchsorted(at[order], np.arange(buckets + 1))
        t, o = t[order], o[order]
        out = {"bucket": [], "tokens": [], "owners": [], "places": []}
        for i in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            part = slice(ends[i], ends[i + 1])
            owners, places = np.unique(o[part], return_inverse=True)
            out["bucket"].append(i)
            out["tokens"].append(planes(np.diff(t[part], prepend=U64(0))))
            out["owners"].append(owners.tobytes())
            out["places"].append(planes(places.astype(np.uint32)))
        return pa.RecordBatch.from_pydict(out, schema=packing)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, tokens, owners, size = shared.value, [], [], 0
        for b in slices(batches):
            for words in hash_texts(b.column(0).to_pylist(), SPACES):
                own = shingle_set(words, shingle)
                if not len(own):
                    continue
                cls = class_of(own)
                rank = level[(own >> shift).astype(np.int64)]
                first = own[np.argsort(rank, kind="stable")[: prefix_length(len(own), percent)]]
                tokens.append(first)
                owners.append(np.full(len(first), cls, dtype=np.int64))
                size += len(first)
                if size >= width:
                    yield emit(tokens, owners)
                    tokens, owners, size = [], [], 0
        if tokens:
            yield emit(tokens, owners)

    def several(t: pa.Table) -> pa.Table:
        token = np.concatenate([np.cumsum(from_planes(x, U64)) for x in t.column("tokens").to_pylist()])
        owners = zip(t.column("owners").to_pylist(), t.column("places").to_pylist())
        owner = np.concatenate([np.frombuffer(x, dtype=np.int64)[from_planes(y, np.uint32)] for x, y in owners])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        same = token[1:] == token[:-1]
        keep = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        token, owner = token[keep], owner[keep]
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))[: len(token)]
        token, owner = token[new], owner[new]
        same = token[1:] == token[:-1]
        keep = (np.append(same, False) | np.insert(same, 0, False))[: len(token)]
        return pa.table({"token": pa.array(token[keep].view(np.int64)), "cls": pa.array(owner[keep])})

    packed = docs.select(utf8().alias("text")).mapInArrow(prefixes, "bucket int, tokens binary, owners binary, places binary")
    return packed.groupBy("bucket").applyInArrow(several, "token bigint, cls bigint")


def _needed_filter(needed: DataFrame) -> np.ndarray:
    """A bit for each class whose set is needed (others may pass, too)."""
    slot = F.shiftrightunsigned("cls", 64 - (NEEDED_BITS.bit_length() - 1)) + 1
    rows = needed.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    ).collect()
    out = np.zeros(NEEDED_BITS // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bitmap"]), dtype=np.uint8)
        out[(r["bucket"] - 1) * len(part) :][: len(part)] = part
    return out


def _sets(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(cls, tokens) of the needed classes, once each."""
    needed = stored(needed, "needed-classes")
    shared = docs.sparkSession.sparkContext.broadcast(_needed_filter(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = shared.value, set()
        for b in slices(batches):
            cls, sets = [], []
            for words in hash_texts(b.column(0).to_pylist(), SPACES):
                own = shingle_set(words, shingle)
                c = class_of(own)
                slot = (c & (2**64 - 1)) >> (64 - (NEEDED_BITS.bit_length() - 1))
                if len(own) and c not in done and bits[slot >> 3] >> (slot & 7) & 1:
                    done.add(c)
                    if len(done) > 100_000:
                        done.clear()
                    cls.append(c)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "tokens"])

    rows = docs.select(utf8().alias("text")).mapInArrow(run, "cls bigint, tokens binary")
    return rows.join(needed, "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _bucket_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, compare): a class and a hub of one of its min-hash buckets, where
    some min-hashes agree; compare if most do and the sizes allow a link."""
    at = lambda k: F.element_at("sig", k % SIGNATURE + 1)
    keys = [F.struct(F.lit(width * BUCKETS + k).alias("k"), F.xxhash64(*[at(k + 5 * i) for i in range(width)]).alias("v")) for width in (1, 2, 3) for k in range(BUCKETS)]
    keys = classes.select("cls", F.inline(F.array(*keys)))
    # hubs differ from bucket to bucket, so a class meets many of its likes
    picks = [F.min(F.struct(F.xxhash64("cls", "k", F.lit(h)), "cls")).getField("cls") for h in range(HUBS)]
    hubs = keys.groupBy("k", "v").agg(F.array(*picks).alias("hubs"), F.count("*").alias("m")).where("m > 1")
    pairs = keys.join(hubs, ["k", "v"]).select("cls", F.explode(F.array_distinct("hubs")).alias("hub")).where("cls <> hub")
    pairs = pairs.select(F.greatest("cls", "hub").alias("a"), F.least("cls", "hub").alias("b")).distinct()
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.withColumn("agree", agree).where(F.col("agree") >= ALIKE).select("a", "b", ((F.col("agree") >= AGREE) & fit).alias("compare"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = [_links(np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64), percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("cls").alias(c), F.col("tokens").alias(t)) for c, t in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _grouped(classes: DataFrame, clusters: DataFrame, alike: DataFrame) -> DataFrame:
    """(cls, n, rank, grp): every class with its cluster, as (size, id), and
    its group, a part of the classes alike."""
    def rooted(rows, roots, name):
        rows = rows.join(roots.select(F.col("node").alias("cls"), F.col("root").alias(name)), "cls", "left")
        rows = rows.withColumn(name, F.coalesce(name, "cls"))
        return rows.join(rows.groupBy(name).agg(F.count("*").alias(f"{name}_size")), name)

    rows = rooted(rooted(classes.select("cls", "n"), clusters, "cluster"), alike, "kin")
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("kin_size") / GROUP))
    return rows.select("cls", "n", F.struct(F.col("cluster_size").alias("size"), F.col("cluster").alias("id")).alias("rank"), F.xxhash64("kin", part).alias("grp"))


def _met_groups(prefixes: DataFrame, grouped: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(cls, grp): classes and groups that share enough first shingles, with
    members whose clusters rank above the class's, or any members."""
    rows = prefixes.join(grouped, "cls")
    matrix = rows.groupBy("token", F.col("grp").alias("met")).agg(F.max("rank").alias("top"))
    queries = rows.select("token", "cls", "n", "rank")
    met = queries.join(matrix, "token").where(F.lit(whole) | F.expr("top > rank")).groupBy("cls", F.col("met").alias("grp")).agg(F.first("n").alias("n"), F.count("*").alias("shared"))
    enough = F.ceil(F.ceil(F.col("n") * percent / 100) / PREFIX)
    return met.where(F.col("shared") >= enough).select("cls", "grp")


def _opened(met: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(a, b): for each class and met group whose union holds enough of its
    shingles, a link with a member of each cluster of higher rank; or its
    links with all members of smaller name, so that each link comes once."""
    load = met.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    of = grouped.select("cls", "grp", F.col("rank.size").alias("size"), F.col("rank.id").alias("id"))
    queries = met.join(load, "grp").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    queries = queries.select("grp", "block", "cls").join(of.drop("grp"), "cls").join(sets, "cls").select("grp", "block", "cls", "size", "id", "tokens")
    members = of.join(load, "grp").join(sets, "cls")
    members = members.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cls", "size", "id", "tokens")
    members = members.select(*[F.col(c).alias(c) for c in members.columns])  # own columns beside the queries'

    def run(q: pa.Table, m: pa.Table) -> pa.Table:
        a, b = [], []
        own = [np.frombuffer(x, dtype=U64) for x in m.column("tokens").to_pylist()]
        if own and q.num_rows:
            n = np.array([len(x) for x in own])
            every, member = np.concatenate(own), np.repeat(np.arange(len(own)), n)
            order = np.argsort(every, kind="stable")
            every, member = every[order], member[order]
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            union, ends = every[first], np.append(first, len(every))
            names, ranks = m.column("cls").to_pylist(), list(zip(m.column("size").to_pylist(), m.column("id").to_pylist()))
            for c, size, cluster, x in zip(*(q.column(k).to_pylist() for k in ("cls", "size", "id", "tokens"))):
                x = np.frombuffer(x, dtype=U64)
                at = np.minimum(np.searchsorted(union, x), len(union) - 1)
                at = at[union[at] == x]
                if 100 * len(at) < percent * len(x):  # the union's bound
                    continue
                lengths = ends[at + 1] - ends[at]
                places = np.repeat(ends[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                both = np.bincount(member[places], minlength=len(own))
                linked = np.flatnonzero(100 * both >= percent * (len(x) + n - both)).tolist()
                if whole:
                    own_links = [names[i] for i in linked if names[i] < c]
                    a += [c] * len(own_links)
                    b += own_links
                    continue
                found = {}
                for i in linked:
                    if ranks[i] > (size, cluster):
                        found[ranks[i]] = names[i]
                a += [c] * len(found)
                b += found.values()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return queries.groupBy("grp", "block").cogroup(members.groupBy("grp", "block")).applyInArrow(run, "a bigint, b bigint")


def _prepared(docs: DataFrame, percent: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n, cls), classes, their groups, and the prefix
    shingles that several classes have."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = min(COUNTERS[1], max(COUNTERS[0], 1 << (size // 64).bit_length()))
    rows = stored(_documents(docs, shingle, counters), "shingle-sets")
    levels = _frequency_levels(rows, counters)
    rows = rows.where("block is null")
    classes = rows.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"))
    classes = stored(classes.withColumn("first", F.element_at("sig", 1)), "shingle-classes")
    total = rows.agg(F.sum(F.col("n") * (1 - percent / 100 + 1 / PREFIX) + 2)).first()[0] or 0
    buckets = max(conf_partitions(docs.sparkSession), int(total) // TASK_TOKENS + 1)
    pairs = stored(_bucket_pairs(classes, percent), "bucket-pairs")
    compared = pairs.where("compare").select("a", "b")
    ends = compared.select(F.col("a").alias("cls")).unionByName(compared.select(F.col("b").alias("cls"))).distinct()
    near = stored(_verified(compared, stored(_sets(docs, ends, shingle), "pair-sets"), percent), "bucket-links")
    both = near.select(F.lit("near").alias("graph"), "a", "b").unionByName(pairs.select(F.lit("alike").alias("graph"), "a", "b"))
    parts = components(both, "graph")
    grouped = stored(_grouped(classes, *(parts.where(F.col("graph") == g) for g in ("near", "alike"))), "groups")
    prefixes = stored(_shared_prefixes(docs, levels, buckets, shingle, percent), "shared-prefixes")
    return rows, classes, grouped, prefixes


def _group_links(docs: DataFrame, grouped: DataFrame, prefixes: DataFrame, percent: int, shingle: int, whole: bool) -> DataFrame:
    met = stored(_met_groups(prefixes, grouped, percent, whole), "met-groups")
    members = grouped.join(met.select("grp").distinct(), "grp", "left_semi").select("cls")
    sets = stored(_sets(docs, met.select("cls").unionByName(members).distinct(), shingle), "group-sets")
    return stored(_opened(met, grouped, sets, percent, whole), "group-links")


def jaccard_links(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between classes, a > b, each once; and (doc_id,
    n_shingles, cls, n_links), the class of each document and the number of
    other classes that it links with.  Documents of one class with words are
    equal sets and link with each other, too; those without words link with
    none.  The links of a group of near copies grow with its square."""
    rows, _, grouped, prefixes = _prepared(docs, percent, shingle)
    links = _group_links(docs, grouped, prefixes, percent, shingle, whole=True)
    ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls")))
    counts = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
    members = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(counts, "cls", "left")
    return links, members.select("doc_id", "n_shingles", "cls", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, cls, root): a row for each document;
    the smallest doc_id reachable by links, its own included, names a
    component; cls is the hash of its set, root a hash for its component."""
    rows, classes, grouped, prefixes = _prepared(docs, percent, shingle)
    more = _group_links(docs, grouped, prefixes, percent, shingle, whole=False)
    # a link found in step 4 joins whole clusters
    whole = grouped.select("cls", F.col("rank.id").alias("cluster"))
    ends = more.join(whole.withColumnRenamed("cls", "a").withColumnRenamed("cluster", "x"), "a")
    ends = ends.join(whole.withColumnRenamed("cls", "b").withColumnRenamed("cluster", "y"), "b")
    last = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    member = whole.join(last.withColumnRenamed("node", "cluster"), "cluster", "left").select("cls", F.coalesce("root", "cluster").alias("root"))
    member = member.join(classes.select("cls", "doc_id"), "cls")
    names = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = member.join(names, "root").select("cls", "component_id", "root")
    out = rows.select("doc_id", "n", "cls").join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "cls", "root")


def group_keepers(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their components: the
    one with the smallest doc_id (null last; equal ids by set), and every
    document without words.  Repeated rows stand once."""
    rows = jaccard_components(docs, percent, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "cls")
    first = rows.where("n_shingles > 0").groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.cls")
    first = stored(first.select(F.col("doc_id").alias("__id"), F.col("cls").alias("__cls")), "group-keepers")

    @F.pandas_udf("long")
    def set_class(texts: pd.Series) -> pd.Series:
        return pd.Series([class_of(shingle_set(w, shingle)) for w in hash_texts(list(texts), SPACES)], dtype="int64")

    # ids are looked up first, so sets are hashed again for keepers' ids alone
    same_id = docs.join(first, docs["doc_id"].eqNullSafe(first["__id"]))
    kept = same_id.where(set_class(utf8()) == F.col("__cls")).dropDuplicates(["__id", "__cls"]).select(*[docs[c] for c in docs.columns])
    blank = docs.where(~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return kept.unionByName(blank)
