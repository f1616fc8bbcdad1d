"""Training corpus from raw documents: filter, deduplicate, remove secrets, mix, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return
the columns of documents. A document without a clear reason to go stays: only the quality rules and the deduplication remove documents, and
the mix leaves out or repeats whole documents to meet its targets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from watchfold.llm import mixing, neardup, packing, quality, secret_scan
from watchfold.session import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows of one Arrow batch. Whole texts pass through Python, and an executor holds several batches at a time on both sides.
ARROW_ROWS = 1000


def lean(stage: Stage) -> Stage:
    """`stage`, run with small Arrow batches."""
    @wraps(stage)
    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        return stage(spark, docs, sf_dir)
    return run_lean


@lean
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cut-offs of their language."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@lean
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of texts with a Jaccard similarity of 0.8 or more."""
    return neardup.deduplicated(docs)


@lean
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a marker."""
    return secret_scan.redacted(docs)


@lean
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in order of their training position."""
    return mixing.mixed(docs)


@lean
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences, which keep the order of the mix."""
    return packing.pack_documents(docs, ordered=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage), ("simhash_near_dedup", near_dedup_stage), ("secret_scan", secrets_stage), ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage),
]

#: SimHash needs XXH64, and the models and the tokenizer have no SQL form: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
