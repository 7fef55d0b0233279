"""The queries of this subpackage, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BPE, table
from .decontaminate import decontaminate
from .fingerprints import edited_fingerprints
from .line_spread import without_spread_lines
from .lm_scoring import backoff_scores
from .mixing import mix
from .ngram_join import jaccard_components
from .odd_sketch import near_groups
from .periodic_runs import find_runs, run_digests, with_tail_periods
from .ranked_search import ranked_search
from .token_counts import length_histogram
from .token_ids import token_ids
from .toxicity import toxicity
from .url_filters import judge_urls


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("cls", "root")


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), WORD_BPE)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_spread_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(with_tail_periods(table(spark, sf_dir, "documents"))))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("cls", "root")


QUERIES = {
    "op12_odd_sketches": op12_odd_sketches,
    "op13_ranked_search": op13_ranked_search,
    "op11_periodic_runs": op11_periodic_runs,
    "op3_line_spread": op3_line_spread,
    "op2_url_filters": op2_url_filters,
    "op4_toxicity": op4_toxicity,
    "op1_token_counts": op1_token_counts,
    "op5_token_ids": op5_token_ids,
    "op7_stupid_backoff": op7_stupid_backoff,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_pareto_mixing": op9_pareto_mixing,
}
