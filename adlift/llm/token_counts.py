"""Exact length histogram of encoded documents.

Documents are aggregated by encoded length, which leaves one row per length,
however many documents there are.  Suffix sums over the lengths then answer,
for every context limit, how many documents exceed it, the total under
truncation, and quantiles.

Cases: null and empty texts have length 0; an empty table gives an empty
histogram; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, utf8
from .tokens import encoder

#: lengths summed together before the sums over all blocks
BLOCK = 1024


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(n_tokens): a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for b in batches:
            texts, out = b.column(0).to_pylist(), []
            for k in range(0, len(texts), 2048):
                out += [len(x) // 4 for x in own.encode(texts[k : k + 2048])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["n_tokens"])

    return docs.select(utf8().alias("text")).mapInArrow(run, "n_tokens bigint")


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each encoded length that occurs:

    n_tokens, n_docs              the length, and the documents that have it
    docs_over, tokens_over        documents longer than it, and their ids
    docs_upto, tokens_upto        documents up to it, and their ids
    truncated_total               ids left if all documents are cut to it
    quantile                      share of documents up to it
    """
    bins = stored(token_counts(docs, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-histogram")
    bins = bins.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("ids", F.col("n_tokens") * F.col("n_docs"))
    # one row per block of lengths: the longest document over BLOCK
    blocks = bins.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("ids").alias("t"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(over), zero).alias("d_over"), F.coalesce(F.sum("t").over(over), zero).alias("t_over"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_ids"),
    )
    later = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = bins.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_ids",
        (F.col("d_over") + F.coalesce(F.sum("n_docs").over(later), zero)).alias("docs_over"),
        (F.col("t_over") + F.coalesce(F.sum("ids").over(later), zero)).alias("tokens_over"),
    )
    upto = F.col("all_ids") - F.col("tokens_over")
    return rows.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_upto"), upto.alias("tokens_upto"),
        (upto + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the least length that ``share`` of the documents do not exceed."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """(total): ids left if all documents are cut to ``limit``, whether or not
    a document has that length."""
    upto = histogram.where(F.col("n_tokens") <= limit).agg(F.max("tokens_upto").alias("u"), F.min("docs_over").alias("o"))
    every = histogram.agg(F.sum("n_docs").alias("n"))
    return upto.select((F.coalesce("u", F.lit(0)) + limit * F.coalesce("o", every.scalar())).alias("total"))
