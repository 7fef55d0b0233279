"""MinHash near-duplicate detection with odd sketches.

Documents are sets of four-word shingles; two of them link when the sets'
Jaccard similarity is at least ``percent``/100, and linked documents form groups.

1. Equal sets become one class, held by one 64-bit hash of the set.  Each class
   gets ``BANDS * ROWS`` min-hashes.  An odd sketch folds them into ``BITS``
   bits: every sample flips the bit it hashes to.  Samples that two sets share
   cancel in the exclusive or, so its population count tells how many differ,
   most precisely when few do: ``similarity`` is
   ``1 + BITS / (4 * samples) * ln(1 - 2 * count / BITS)``.
2. Bands of ``ROWS`` samples name buckets.  Two sets of similarity 0.8 share
   none of them with probability 1e-13.
3. Each member of a bucket meets the bucket's hub; buckets are cut into parts
   of ``PART`` members with hubs of their own, so no hub meets more.  Pairs whose
   sketches allow a link (``xor_limit``: seven standard deviations) go on, for
   each class the one of smallest count; they are compared on the full sets, and
   links form first groups.
4. Buckets that still hold several groups compare the sketches of members of
   different groups, in blocks of bounded size and without those of the bucket's
   largest group among each other.  Of the pairs that the sketches allow only a
   forest leaves the bucket; its trees join to kinships, one for each class.
5. Within a kinship, again in blocks, members of different groups whose sketches
   allow a link are compared on their full sets, many at a time by the shingles
   that they share.  A link joins two groups, which then need no other.

So every pair that shares a bucket and whose sketches allow a link is compared,
unless its classes are in one group already.

Cases: null text is empty; a document without words has 0 shingles and is its
own group; with fewer than four words the whole sequence is one shingle; equal
ids stay separate rows; a null id never names a group unless all of it are null;
a document is kept if it has the id that names its group, so all rows of that id
in the group are; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8
from .components import components
from .text_hash import SPACES, U64, hash_texts, mixed, shingle_set

SHINGLE, PERCENT = 4, 80
#: bands, min-hashes of a band, bits of a sketch
BANDS, ROWS, BITS = 42, 3, 512
SAMPLES = BANDS * ROWS
#: members that meet one hub, about; members of a block
PART, BLOCK = 1024, 2048
#: shingles of a kinship's block
BLOCK_TOKENS = 1 << 20
#: rows of small buckets, and shingles of small kinships, that one call takes
CALL_ROWS, CALL_TOKENS = 16_384, 1 << 19
#: sets with so few likely partners meet them one by one
FEW = 8
#: bits of the filter of texts whose sets are needed (4 MB)
NEEDED_BITS = 1 << 25

_ODD = np.random.Generator(np.random.PCG64(12)).integers(0, 2**63, SAMPLES, dtype=U64) * U64(2) + U64(1)
_SALT = np.random.Generator(np.random.PCG64(13)).integers(0, 2**63, SAMPLES, dtype=U64)


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8, person=b"odd").digest(), "little", signed=True)


def min_hashes(tokens: np.ndarray) -> np.ndarray:
    """The samples of a set that is not empty."""
    out = np.full(SAMPLES, U64(2**64 - 1))
    for at in range(0, len(tokens), 2048):
        np.minimum(out, np.multiply.outer(_ODD, tokens[at : at + 2048]).min(axis=1), out=out)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """The sketches (rows of BITS / 64 words) of rows of samples."""
    slot = (mixed(samples ^ _SALT) >> U64(64 - BITS.bit_length() + 1)).astype(np.int64)
    flat = slot + np.arange(len(samples))[:, None] * BITS
    odd = np.bincount(flat.ravel(), minlength=len(samples) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(samples), BITS), axis=1, bitorder="little").view(U64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """The bucket of each band, a number that differs between bands."""
    h = np.tile(_SALT[:BANDS], (len(samples), 1))
    for r in range(ROWS):
        h = mixed(h ^ samples[:, r::ROWS])
    return h


def expected_count(differing: float) -> float:
    """Population count expected if so many samples differ."""
    return BITS / 2 * (1 - math.exp(-4 * differing / BITS))


def xor_limit(percent: int) -> int:
    """The count that two sets of that similarity stay below but for a chance
    of about 1e-11."""
    differing = SAMPLES * (1 - percent / 100)
    spread = math.sqrt(differing * percent / 100)
    by_samples = (expected_count(differing + spread) - expected_count(differing)) ** 2
    by_slots = BITS / 4 * (1 - math.exp(-8 * differing / BITS)) - BITS / 4 * (8 * differing / BITS) * math.exp(-8 * differing / BITS)
    return math.ceil(expected_count(differing) + 7 * math.sqrt(by_samples + max(by_slots, 0)))


def xor_count(a: Column, b: Column) -> Column:
    """Population count of the exclusive or of two sketches."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))


def similarity(count: Column) -> Column:
    """The Jaccard similarity estimated from an ``xor_count``, 0 at least."""
    share = F.least(2 * count / BITS, F.lit(1 - 1e-9))
    return F.greatest(F.lit(0.0), 1 + BITS / (4 * SAMPLES) * F.log(1 - share))


def sketched_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n, cls, keys, sketch) of each document: its number of
    shingles, its set's hash, its buckets and its odd sketch (null without
    words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(w, shingle) for w in hash_texts(b.column("text").to_pylist(), SPACES)]
            n = np.array([len(x) for x in sets], dtype=np.int64)
            some = np.flatnonzero(n)
            samples = np.array([min_hashes(sets[i]) for i in some.tolist()], dtype=U64).reshape(len(some), SAMPLES)
            place = np.full(len(sets), -1)
            place[some] = np.arange(len(some))
            taken = pa.array(np.where(place < 0, 0, place), pa.int64(), mask=place < 0)
            lists = []
            for values, width in ((band_keys(samples), BANDS), (odd_sketches(samples), BITS // 64)):
                flat = pa.array(values.reshape(-1).view(np.int64))
                lists.append(pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * width, flat).take(taken))
            cls = pa.array([class_of(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n), cls, *lists], names=["doc_id", "text_hash", "n", "cls", "keys", "sketch"])

    rows = docs.select("doc_id", utf8().alias("text"), F.xxhash64(utf8()).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n bigint, cls bigint, keys array<bigint>, sketch array<bigint>")


def _sets(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(cls, tokens) of the needed classes (cls, text_hash), once each.  Only
    texts that a bit filter of bounded size lets pass are taken to words."""
    needed = stored(needed, "needed-classes")
    slot = F.shiftrightunsigned("text_hash", 64 - (NEEDED_BITS.bit_length() - 1)) + 1
    bits = needed.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    ).collect()
    filled = np.zeros(NEEDED_BITS // 8, dtype=np.uint8)
    for r in bits:
        part = np.frombuffer(bytes(r["bitmap"]), dtype=np.uint8)
        filled[(r["bucket"] - 1) * len(part) :][: len(part)] = part
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, done = shared.value, set()
        for b in slices(batches):
            h = b.column("text_hash").to_numpy().view(U64)
            at = h >> U64(64 - (NEEDED_BITS.bit_length() - 1))
            hit = filled[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1
            # copies of one text come once, but for a bounded memory of them
            some = [i for i in np.flatnonzero(hit).tolist() if h[i] not in done and not done.add(h[i])]
            if len(done) > 100_000:
                done.clear()
            sets = [shingle_set(w, shingle) for w in hash_texts(b.column("text").take(pa.array(some, pa.int64())).to_pylist(), SPACES)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cls", "tokens"])

    rows = docs.select(utf8().alias("text"), F.xxhash64(utf8()).alias("text_hash")).mapInArrow(run, "cls bigint, tokens binary")
    return rows.join(needed.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("cls").alias(c), F.col("tokens").alias(t)) for c, t in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    needed = classes.join(ends, "cls", "left_semi").select("cls", "text_hash")
    return stored(_confirmed(pairs, stored(_sets(docs, needed, shingle), "pair-sets"), percent), "near-links")


def _hub_pairs(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each class its likeliest hub."""
    rows = buckets.withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / PART)))
    hubs = rows.groupBy("key", "part").agg(F.min("cls").alias("hub"))
    tops = hubs.groupBy("key").agg(F.min("hub").alias("top"))
    pairs = rows.join(hubs, ["key", "part"]).select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    pairs = pairs.unionByName(hubs.join(tops, "key").select(F.col("hub").alias("a"), F.col("top").alias("b")))
    pairs = pairs.where("a <> b").distinct()
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("count", xor_count(F.col("s_a"), F.col("s_b")))
    fit = (F.col("count") <= xor_limit(percent)) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return pairs.where(fit).groupBy("a").agg(F.min_by("b", F.struct("count", "b")).alias("b"))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    rows = rows.join(groups.select(F.col("node").alias("cls"), "root"), "cls", "left")
    return rows.withColumn("root", F.coalesce("root", "cls"))


def _dealt(rows: DataFrame, block: int, call: int) -> DataFrame:
    """Rows (key, cls, root, weight) of the keys with several groups, dealt to
    calls (part, x, y): many small keys to one, and of a large one the members
    outside its largest group (``asks``) in blocks x, against all its members in
    blocks y, each of about the weight ``block``."""
    sizes = rows.groupBy("key", "root").agg(F.sum("weight").alias("k"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.max("k").alias("k"), F.sum("k").alias("m")).where("k < m")
    rows = rows.join(largest, "key").withColumn("asks", F.col("root") != F.col("major"))
    rows = rows.withColumns({"nx": F.ceil((F.col("m") - F.col("k")) / block).cast("int"), "ny": F.ceil(F.col("m") / block).cast("int")})
    calls = F.lit(int(largest.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]) // call + 1)
    small = F.col("ny") == 1
    own = F.xxhash64("cls")
    blocks = lambda n: F.sequence(F.lit(0), n - 1)
    asked = rows.select("*", F.pmod(own, "ny").cast("int").alias("y"), F.explode(blocks(F.col("nx"))).alias("x"), F.lit(False).alias("asking"))
    asking = rows.where("asks").select("*", F.pmod(own, "nx").cast("int").alias("x"), F.explode(blocks(F.col("ny"))).alias("y"), F.lit(True).alias("asking"))
    both = asked.unionByName(asking).withColumn("part", F.when(small, F.pmod(F.xxhash64("key"), calls)).otherwise(F.col("key")))
    both = both.withColumns({c: F.when(small, F.lit(-1)).otherwise(F.col(c)) for c in ("x", "y")})
    return both.select("part", "x", "y", "key", "cls", "root", "asks", "asking")


class _Call:
    """The rows of one call, and for each of its keys the likely pairs."""

    def __init__(self, t: pa.Table, percent: int):
        self.key, self.cls, self.root, self.n = (t.column(c).to_numpy() for c in ("key", "cls", "root", "n"))
        self.asks, self.asking = (t.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "asking"))
        self.sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(U64).reshape(len(self.key), BITS // 64)
        self.percent, self.limit = percent, xor_limit(percent)

    def keys(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows that ask and those asked, key by key."""
        order = np.argsort(self.key, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(self.key[order])) + 1):
            yield at[self.asking[at]], at[~self.asking[at]]

    def likely(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each row that asks, and the asked ones of other groups with which
        sketches and sizes allow a link; a pair of two that ask comes once."""
        for q in np.split(left, range(256, len(left), 256)):
            count = np.zeros((len(q), len(right)), dtype=np.uint16)
            for w in range(BITS // 64):
                count += np.bitwise_count(self.sketch[q, w][:, None] ^ self.sketch[right, w][None, :])
            fit = (count <= self.limit) & (self.root[q][:, None] != self.root[right][None, :])
            fit &= ~self.asks[right][None, :] | (self.cls[q][:, None] > self.cls[right][None, :])
            low, high = np.minimum(self.n[q][:, None], self.n[right][None, :]), np.maximum(self.n[q][:, None], self.n[right][None, :])
            fit &= 100 * low >= self.percent * high
            for i in np.flatnonzero(fit.any(axis=1)).tolist():
                yield int(q[i]), right[fit[i]]


class _Shared:
    """The shingles of many sets, to count what another set shares with each."""

    def __init__(self, sets: list[np.ndarray]):
        every, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(every, kind="stable")
        every, self.member = every[order], member[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        self.union, self.ends, self.sets = every[first], np.append(first, len(every)), len(sets)

    def counts(self, x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.union, x), len(self.union) - 1)
        at = at[self.union[at] == x]
        lengths = self.ends[at + 1] - self.ends[at]
        places = np.repeat(self.ends[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(self.member[places], minlength=self.sets)


def _kin_edges(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each call and bucket a forest over the classes that likely
    pairs join."""

    def run(t: pa.Table) -> pa.Table:
        call, a, b = _Call(t, percent), [], []
        for left, right in call.keys():
            names, place = np.unique(call.cls[np.append(left, right)], return_inverse=True)
            of = dict(zip(np.append(left, right).tolist(), place.tolist()))
            label = np.arange(len(names))
            for q, partners in call.likely(left, right):
                own = np.unique(label[[of[q], *(of[x] for x in partners.tolist())]])
                if len(own) > 1:
                    a += names[own[1:]].tolist()
                    b += [int(names[own[0]])] * (len(own) - 1)
                    label[np.isin(label, own)] = own[0]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("part", "x", "y").applyInArrow(run, "a bigint, b bigint")


def _kin_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between groups, found on the full sets (``tokens``); for
    each call and kinship enough of them to join all that link."""

    def run(t: pa.Table) -> pa.Table:
        call, a, b = _Call(t, percent), [], []
        tokens = t.column("tokens")
        for left, right in call.keys():
            groups = {int(r): int(r) for r in np.unique(call.root[np.append(left, right)])}

            def find(r):
                while groups[r] != r:
                    groups[r] = r = groups[groups[r]]
                return r

            sets = [np.frombuffer(tokens[i].as_py(), dtype=U64) for i in right.tolist()]
            at = {i: k for k, i in enumerate(right.tolist())}
            shared = None
            for q, partners in call.likely(left, right):
                partners = [i for i in partners.tolist() if find(int(call.root[i])) != find(int(call.root[q]))]
                if not partners:
                    continue
                x = np.frombuffer(tokens[q].as_py(), dtype=U64)
                if len(partners) > FEW:
                    shared = shared or _Shared(sets)
                    both = shared.counts(x)[[at[i] for i in partners]].tolist()
                else:
                    both = [len(np.intersect1d(x, sets[at[i]], assume_unique=True)) for i in partners]
                for i, k in zip(partners, both):
                    if 100 * k >= percent * (len(x) + int(call.n[i]) - k) and find(int(call.root[i])) != find(int(call.root[q])):
                        groups[find(int(call.root[i]))] = find(int(call.root[q]))
                        a.append(int(call.cls[q]))
                        b.append(int(call.cls[i]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("part", "x", "y").applyInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, cls, root): a row for each
    document; the smallest doc_id reachable by links, its own included, names
    its group; cls is the hash of its set, root a hash for its group."""
    rows = stored(sketched_documents(docs, shingle), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n", "keys", "sketch")]
    classes = rows.where("n > 0").groupBy("cls").agg(*firsts, F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("doc_id"))
    classes = stored(classes, "sketch-classes")
    keys = classes.select("cls", F.explode("keys").alias("key"))
    several = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = stored(keys.join(several, "key"), "buckets")
    links = _linked(docs, stored(_hub_pairs(buckets, classes, percent), "hub-pairs"), classes, percent, shingle)
    groups = components(links)
    shown = classes.select("cls", "n", "sketch")
    met = _dealt(_with_groups(buckets.select("key", "cls", F.lit(1).alias("weight")), groups), BLOCK, CALL_ROWS)
    kin = components(stored(_kin_edges(met.join(shown, "cls"), percent), "kin-edges"))
    members = classes.select("cls", "n", "text_hash").join(kin.select(F.col("node").alias("cls"), F.col("root").alias("key")), "cls")
    members = stored(_with_groups(members, groups), "kin-members")
    if not members.isEmpty():
        sets = stored(_sets(docs, members.select("cls", "text_hash"), shingle), "kin-sets")
        met = _dealt(members.select("key", "cls", "root", F.col("n").alias("weight")), BLOCK_TOKENS, CALL_TOKENS)
        more = stored(_kin_links(met.join(shown, "cls").join(sets, "cls"), percent), "kin-links")
        groups = components(links.unionByName(more))
    member = classes.select("cls", "doc_id").join(groups.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    names = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = member.join(names, "root").select("cls", "component_id", "root")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "cls", "root")
