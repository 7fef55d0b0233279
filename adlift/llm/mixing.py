"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words, up to ``max_repeats`` times its
own words; what it cannot take is shared anew by weight.  A document is taken
``e`` times on average (the source's target over its words, or in proportion
to an importance column): ``floor(e)`` copies are certain, and one more is
drawn with inclusion probability ``p = e - floor(e)``.  The draw ranks the
documents of a source by random odds over inclusion odds,
``u / (1 - u) / (p / (1 - p))``, and takes them in this order until the words
reach what the certain copies leave of the target: a sample of fixed size in
words, with unequal probabilities.  ``u`` is a hash of the id, the text and the
source; rows that are equal in these are numbered, and draw each for itself.

Cases: null text has size 0; a null source is a source of its own, sorted
last; a negative, null or zero importance takes no words; of equal rows, as
many are taken in every run, whichever these are; null ids draw by their text;
an empty table gives an empty mix; other columns are ignored by ``mix`` and
kept by ``mixed_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
#: ranges of the rank, of which only the one with the cut is sorted
BINS = 4096


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw_of(seed: str, importance: Column | None) -> Column:
    """The name under which a row draws, in hex digits; equal rows share it."""
    parts = [
        F.lit(seed),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")),
    ]
    if importance is not None:
        parts.append(F.coalesce(importance.cast("string"), F.lit("null")))
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def uniform(draw: Column) -> Column:
    """A number in (0, 1) fixed by the draw."""
    return (F.conv(F.substring(draw, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


@dataclass(frozen=True)
class SourceTarget:
    source: str | None
    words: int
    target: float


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> list[SourceTarget]:
    """Share all words by weight, no source above its cap: sources fill up in
    the order of cap over weight, until the common level reaches none."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    rows = [(s, n, weights[k % len(weights)]) for k, (s, n) in enumerate(order)]
    total, capped, weight = sum(n for _, n in sizes), 0, sum(w for _, _, w in rows)
    out = {}
    for s, n, w in sorted(rows, key=lambda r: (max_repeats * r[1] / r[2], r[0] is None, r[0] or "")):
        level = (total - capped) / weight
        if max_repeats * n / w <= level:
            out[s] = float(max_repeats * n)
            capped, weight = capped + max_repeats * n, weight - w
        else:
            out[s] = w * level
    return [SourceTarget(s, n, out[s]) for s, n, _ in rows]


#: one row per source is broadcast up to so many sources, else joined by shuffle
BROADCAST_SOURCES = 200_000


def _plan_for(base: DataFrame, weights, max_repeats: int, plain: bool) -> DataFrame:
    """(source, source_size, target, scale): a row for each source; ``scale``
    is the copies for an importance of 1 that give the target words."""
    spark = base.sparkSession
    sizes = [(r["source"], r["n"]) for r in base.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    rows = [(r.source, r.words, r.target, r.target / r.words if r.words else 0.0) for r in targets(sizes, weights, max_repeats)]
    for _ in range(0 if plain else 100):
        # copies stop at max_repeats; the scale grows until the others make up for it
        full = F.col("importance") * F.col("scale") >= max_repeats
        sums = _beside(base, _frame(spark, rows), len(rows)).groupBy("source").agg(
            F.sum(F.when(full, F.col("size") * max_repeats).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("importance"))).alias("rest"),
        )
        found = {r["source"]: (r["capped"], r["rest"]) for r in sums.collect()}
        new = []
        for s, n, t, x in rows:
            capped, rest = found[s]
            new.append((s, n, t, max(0.0, t - capped) / rest if rest > 0 else x))
        same = all(abs(a[3] - b[3]) <= 1e-9 * b[3] for a, b in zip(new, rows))
        rows = new
        if same:
            break
    return _frame(spark, rows)


def _frame(spark, rows) -> DataFrame:
    """The rows as an Arrow table, which Spark takes without Python workers."""
    kinds = {"source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "scale": pa.float64()}
    columns = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds)))


def _beside(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """rows with their source's plan."""
    p = plan.withColumnRenamed("source", "__source")
    p = F.broadcast(p) if n_sources <= BROADCAST_SOURCES else p
    return rows.join(p, rows["source"].eqNullSafe(p["__source"]), "left").drop("__source")


#: equal rows after the first are broadcast up to so many (16 bytes each), else joined by shuffle
BROADCAST_REPEATS = 500_000


def _entry(importance: Column | None, seed: str) -> list[Column]:
    """What the mix needs of a document; ``row`` names it."""
    weight = F.lit(1.0) if importance is None else F.greatest(F.coalesce(importance.cast("double"), F.lit(0.0)), F.lit(0.0))
    return [
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"),
        draw_of(seed, importance).alias("tie"),
        weight.alias("importance"),
        F.monotonically_increasing_id().alias("row"),
    ]


def _repeats(base: DataFrame) -> DataFrame:
    """(row, nth) of the rows that equal ``nth`` others before them.

    Rows are numbered within their part of the stored table, and the parts'
    counts summed, so that no task takes all rows of a large group.
    """
    rows = base.select("tie", F.shiftright("row", 33).alias("part"), "row")
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("tie", "part").orderBy("row")) - 1)
    counts = rows.groupBy("tie", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tie").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("tie", "part", F.sum("n").over(earlier).alias("shift")).where("shift > 0")
    found = numbered.join(shifts, ["tie", "part"], "left").withColumn("nth", F.col("k") + F.coalesce("shift", F.lit(0)))
    return found.where("nth > 0").select("row", "nth")


def _drawn(base: DataFrame) -> DataFrame:
    """base with ``u`` and a ``tie`` for each row."""
    repeats = stored(_repeats(base), "mix-repeats")
    n = repeats.count()
    if n:
        repeats = F.broadcast(repeats) if n <= BROADCAST_REPEATS else repeats
        again = F.md5(F.concat_ws(":", F.col("tie"), F.col("nth").cast("string")).cast("binary"))
        base = base.join(repeats, "row", "left").withColumn("tie", F.when(F.col("nth").isNull(), F.col("tie")).otherwise(again)).drop("nth")
    return base.withColumn("u", uniform(F.col("tie")))


def _ranked(rows: DataFrame, max_repeats: int) -> DataFrame:
    """rows with certain copies (``sure``) and ``rank``: random odds over
    inclusion odds, null without a chance of one more."""
    e = F.least(F.col("importance") * F.col("scale"), F.lit(float(max_repeats)))
    # a sum that misses a whole number by rounding alone counts as it
    e = F.when(F.abs(e - F.round(e)) < 1e-9, F.round(e)).otherwise(e)
    rows = rows.withColumn("mean", F.coalesce(e, F.lit(0.0))).withColumn("sure", F.floor("mean"))
    p = F.col("mean") - F.col("sure")
    return rows.withColumn("rank", F.when(p > 0, F.col("u") / (1 - F.col("u")) * ((1 - p) / p)))


def _cuts(ranked: DataFrame) -> DataFrame:
    """(source, cut): the last (rank, size, tie) drawn of each source.

    Word sums of ``BINS`` ranges of the rank find the range with the cut; only
    its rows are sorted.
    """
    bins = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BINS), F.lit(BINS - 1)).cast("int")
    rows = ranked.withColumn("bin", bins)
    own = Window.partitionBy("source")
    sums = rows.groupBy("source", "target", "bin").agg(
        F.sum(F.col("size") * F.col("sure")).alias("sure"), F.sum("size").alias("words")
    )
    sums = sums.withColumn("left", F.col("target") - F.sum("sure").over(own)).where("bin is not null")
    before = F.sum("words").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before < left")
    at = sums.groupBy("source").agg(F.max(F.struct("bin", "left", "before")).alias("at")).select(
        F.col("source").alias("__source"), "at.*"
    )
    last = rows.join(at.withColumnRenamed("bin", "__bin"), rows["source"].eqNullSafe(F.col("__source")) & (F.col("bin") == F.col("__bin")))
    order = Window.partitionBy("source").orderBy("rank", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(order))
    # the document that crosses the target is drawn if the sum is nearer with it
    drawn = F.col("upto") + (F.col("upto") - F.col("size")) < 2 * F.col("left")
    mark = F.struct("rank", "size", "tie")
    # before the first of this range: all of the ranges before it
    start = F.struct((F.col("bin") / (BINS - F.col("bin"))).alias("rank"), F.lit(-1).cast("long").alias("size"), F.lit("").alias("tie"))
    return last.groupBy("source").agg(F.max(F.when(drawn, mark).otherwise(start)).alias("cut"))


def _decided(docs: DataFrame, columns: list[Column], importance, weights, max_repeats: int, seed: str) -> DataFrame:
    """``columns`` and source, size, source_size, target, copies of each row.

    The rows are stored once; the decision of a row follows from its draw, its
    source's target and its source's cut, so ``columns`` are shuffled only if
    more than ``BROADCAST_REPEATS`` rows repeat others.
    """
    base = stored(docs.select(*columns, *_entry(importance, seed)), "mix-entries")
    plan = _plan_for(base, weights, max_repeats, importance is None)
    n = plan.count()
    base = _drawn(base)
    cuts = _cuts(_ranked(_beside(base.select("source", "size", "tie", "u", "importance"), plan, n), max_repeats))
    plan = stored(_beside(plan, cuts, n), "mix-plan")
    rows = _ranked(_beside(base, plan, n), max_repeats)
    extra = F.coalesce(F.struct("rank", "size", "tie") <= F.col("cut"), F.lit(False))
    return rows.withColumn("copies", F.col("sure").cast("int") + extra.cast("int"))


def mix(docs: DataFrame, importance: Column | None = None, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for
    each document; ``taken`` is copies times size."""
    rows = _decided(docs, [F.col("doc_id")], importance, weights, max_repeats, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, importance: Column | None = None, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("__doc")
    rows = _decided(docs, [F.col("doc_id"), whole], importance, weights, max_repeats, seed)
    return rows.where("copies > 0").select("__doc", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("__doc.*")
