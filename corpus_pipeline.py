"""The corpus pipeline: quality rules, near-duplicate removal, substring dedup, decontamination and encoding, in this order.

Every stage works on all that its predecessor kept: it is a function of (spark, docs, sf_dir) whose result is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``, and keep any other columns, whatever their names. Empty
tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import bpe, decontaminate, ngram_join, passages, quality
from proofline.llm.shared import discard, documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail go; failing lines of the others are removed. A null or empty text fails; repeated rows share their fate."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest doc_id (null last), then of the smallest hash of the text.

    Rows that share a doc_id but not the text are documents of their own; of rows equal in both one stays. Wordless texts have no near copies.
    """
    return ngram_join.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out, but for their first occurrence; documents without a word left go. A null doc_id comes first in order."""
    return passages.remove(docs, passages.repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, those without a doc_id too; null or empty texts hold none."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every row that is left; a null text has no ids."""
    return bpe.encode(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: MinHash, latent retrieval and byte-pair encoding can't be stated in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder, and deleted once the next one's is."""
    return run_stages(spark, documents(spark, sf_dir), sf_dir)


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
