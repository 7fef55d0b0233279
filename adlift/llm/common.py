"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.session import scratch_path

#: the tokenizer file of the queries; the operators take any path
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared folder and read it
    back: its rows (and any row id in them) are then fixed, whatever executor
    is lost later, and nothing upstream runs twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def conf_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most, so that the Python objects
    made of a part stay few where Spark sends ten thousand rows at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def without_clashes(docs: DataFrame, added: Iterable[str]) -> DataFrame:
    """``docs`` with columns that are named like one to be added (whatever the
    case) renamed: ``_input`` is put behind until the name is free."""
    added = {c.lower() for c in added}
    taken = {c.lower() for c in docs.columns} | added
    names = []
    for c in docs.columns:
        if c.lower() in added:
            while c.lower() in taken:
                c += "_input"
            taken.add(c.lower())
        names.append(c)
    return docs.toDF(*names)
