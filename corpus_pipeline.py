"""A training corpus from raw documents: five stages, each written as Parquet
and read again as the next one's documents.

toxicity         documents that the classifier rejects go
near_duplicates  one document of each group of near duplicates stays
decontaminate    documents with a benchmark passage go
mix              each document stays as often as its source's target asks
token_ids        the documents as token-id shards; a digest row per document

Every stage works on all rows that the one before kept; all but the last return
the columns of documents.  Repeated rows, null texts and an empty table pass
through each stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlift.llm.common import WORD_BPE, stored, table
from adlift.llm.decontaminate import clean_documents
from adlift.llm.mixing import mixed_documents
from adlift.llm.ngram_join import group_keepers
from adlift.llm.token_ids import token_ids
from adlift.llm.toxicity import THRESHOLD, score_column, train


#: rows that Spark sends to a Python worker at once: whole texts are long, and
#: the default of 10,000 of them fills buffers on both sides
BATCH_ROWS = 1_000


#: a Python worker gives freed memory back to the system at once; else it keeps
#: what its largest batch took for as long as Spark uses the worker
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(1 << 20),
}


def _settings(spark: SparkSession) -> None:
    spark.sparkContext.environment.update(WORKER_MEMORY)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold."""
    _settings(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_column(model, spark) < THRESHOLD)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id in each group."""
    _settings(spark)
    return group_keepers(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, each row by its own text."""
    _settings(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    return mixed_documents(docs)


def token_ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    return token_ids(docs, WORD_BPE)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("token_ids", token_ids_stage),
]

#: a trained classifier and a tokenizer are beyond SQL; tests hold the stages
#: against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
