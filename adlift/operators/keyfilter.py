"""A bit filter of cohort keys: fact rows that cannot be of the cohort are
dropped where they are read, before anything is shuffled.

The filter is a table of 64-bit words, a bit for each hashed key.  Its size is
set by the number of keys, which the caller measures on a stored cohort, and
never exceeds ``MAX_BITS`` (2^20 words of 16 bytes), so broadcasting it is safe
whatever the cohort; a cohort too large for that gets no filter.  A key of the
cohort always passes, another passes with a chance of at most keys over bits:
the query behind the filter must decide exactly, and its rows are the same
with and without it.  NULLs hash like any value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bits of the largest filter, and for each key of a smaller one
MAX_BITS = 1 << 26
BITS_PER_KEY = 64
#: with fewer bits for each key than this too many other rows would pass
LEAST_BITS_PER_KEY = 4


def filter_bits(n_keys: int) -> int | None:
    """Bits (a power of two) for so many keys; None if a filter of
    ``MAX_BITS`` would hold too many."""
    if n_keys * LEAST_BITS_PER_KEY > MAX_BITS:
        return None
    return min(MAX_BITS, 1 << max(6, (n_keys * BITS_PER_KEY - 1).bit_length()))


def _place(columns: list[str], bits: int) -> tuple[Column, Column]:
    """Word and bit of a row's key."""
    at = F.pmod(F.xxhash64(*columns), F.lit(bits).cast("bigint"))
    return F.shiftright(at, 6), (at % 64).cast("int")


@dataclass(frozen=True)
class KeyFilter:
    """``words`` is ``(word, bits)``, None where every row passes."""

    columns: tuple[str, ...]
    n_bits: int | None
    words: DataFrame | None

    def keep(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose key may be in the cohort (columns unchanged)."""
        if self.words is None:
            return df
        word, bit = _place([df[c] for c in self.columns], self.n_bits)
        side = F.broadcast(self.words.toDF("__word", "__bits"))
        return df.join(side, (word == F.col("__word")) & (F.getbit(F.col("__bits"), bit) == 1), "left_semi")


def key_filter(keys: DataFrame, path: str) -> KeyFilter:
    """The filter of a cohort's keys (all columns, in their order).  The distinct
    keys are written under ``path`` first, which measures them and keeps the
    cohort from being computed again."""
    columns = tuple(keys.columns)
    keys.distinct().write.parquet(path)
    back = keys.sparkSession.read.schema(keys.schema).parquet(path)
    bits = filter_bits(back.count())
    if bits is None:
        return KeyFilter(columns, None, None)
    word, bit = _place(list(columns), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    words = back.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(one).alias("bits"))
    return KeyFilter(columns, bits, words)
