"""A training-data pipeline over ``documents``: five stages, each writing Parquet that the next one reads.

1. toxicity: documents scored toxic go (model trained on ``labels``' training rows).
2. line_dedup: repeated lines go; every document stays.
3. near_dup: one document, the smallest doc_id, of each group of near-duplicates (shingle similarity 0.80 or more) stays.
4. decontaminate: documents contaminated by ``benchmark`` go.
5. packing: the rest is packed into sequences of at most 1024 tokens (a row per piece).

The first four return the columns of ``documents``.  Empty tables pass through; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskroll.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from riskroll.llm.common import ship, table, written

#: Shingle similarity of near-duplicates in the pipeline, in percent (op8's contract says 85).
NEAR_DUP_PERCENT = 80


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup.drop_repeated(docs)


def _near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.keep_first(docs, NEAR_DUP_PERCENT)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("near_dup", _near_dup),
    ("decontaminate", _decontaminate),
    ("packing", _packing),
]

#: No stage but the decontamination can be expressed in SQL; tests/llm compares the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
