"""Plain texts as blocks: a line that isn't blank is a paragraph of the body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For DuckDB: the same blocks as a common table expression.
SQL = r"""numbered AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
blocks AS (SELECT doc_id, CAST(i - 1 AS INT) AS ord, text FROM numbered WHERE regexp_matches(text, '[^\s]'))"""


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, dealt out by ``keys`` if their input has fewer splits than there are cores; a larger input has enough of them and isn't moved."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if rows.rdd.getNumPartitions() < cores else rows


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, text of ``documents``; only these two columns are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spread(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).where(F.col("text").rlike(r"[^\s]")), "doc_id", "ord")
