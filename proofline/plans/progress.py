"""Progress, remaining time and skipped checks from tables of chunks. Orders stand in for chunks of analyses (their customers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The share of each stage in percent.
WEIGHTS = {"extract": 5, "local": 50, "context": 30, "global": 7}
MIN_DONE = 3
STAGE = "CASE WHEN o_orderkey % 3 = 0 THEN 'local' WHEN o_orderkey % 3 = 1 THEN 'context' ELSE 'global' END"
#: An analysis' own status, by its key.
STATUS = ["EXTRACTING", "ANALYZING_LOCAL", "ANALYZING_CONTEXT", "ANALYZING_GLOBAL", "FINALIZING", "COMPLETED", "QUEUED"]
SETTLED = "o_orderstatus <> 'O'"
FAILED = "o_orderstatus = 'P'"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return orders.select(F.col("o_custkey").alias("analysis_id"), F.expr(STAGE).alias("stage"), F.expr(SETTLED).alias("settled"), F.expr(FAILED).alias("failed"), F.expr("cast(o_totalprice as bigint) % 1000").alias("tokens"))


def _fraction(stage: str) -> str:
    return f"(CASE WHEN {stage}_total = 0 THEN 1.0 ELSE {stage}_settled / {stage}_total END)"


PROGRESS = f"""CASE WHEN status = 'COMPLETED' THEN 100 WHEN status = 'QUEUED' THEN 0 WHEN status = 'EXTRACTING' THEN 0 ELSE least(99, floor({WEIGHTS['extract']} + {WEIGHTS['local']} * {_fraction('local')}
  + CASE WHEN status IN ('ANALYZING_CONTEXT', 'ANALYZING_GLOBAL', 'FINALIZING') THEN {WEIGHTS['context']} * {_fraction('context')} ELSE 0.0 END
  + CASE WHEN status IN ('ANALYZING_GLOBAL', 'FINALIZING') THEN {WEIGHTS['global']} * {_fraction('global')} ELSE 0.0 END + 0.5)) END"""
REMAINING = f"CASE WHEN done >= {MIN_DONE} AND total > done AND status IN ('ANALYZING_LOCAL', 'ANALYZING_CONTEXT', 'ANALYZING_GLOBAL') THEN floor(600.0 / done * (total - done) + 0.5) END"


def progress(table: DataFrame) -> DataFrame:
    """Percent done and seconds left of every analysis, ten minutes after its start."""
    stages = ["local", "context", "global"]
    found = table.groupBy("analysis_id").agg(
        F.count("*").alias("total"), F.count_if("settled").alias("done"),
        *[F.count_if(F.col("stage") == s).alias(f"{s}_total") for s in stages], *[F.count_if((F.col("stage") == s) & F.col("settled")).alias(f"{s}_settled") for s in stages],
    )
    found = found.withColumn("status", F.element_at(F.array(*map(F.lit, STATUS)), F.expr(f"cast(analysis_id % {len(STATUS)} + 1 as int)")))
    return found.select("analysis_id", "status", "total", "done", F.expr(PROGRESS).cast("int").alias("progress"), F.expr(REMAINING).cast("int").alias("seconds_left"))


def skipped_checks(table: DataFrame) -> DataFrame:
    """Per stage of an analysis: chunks, failed ones and tokens, where some failed; and whether more than a tenth did."""
    found = table.groupBy("analysis_id", "stage").agg(F.count("*").alias("total"), F.count_if("failed").alias("skipped"), F.sum("tokens").alias("tokens"))
    return found.where("skipped > 0").withColumn("too_many", F.col("skipped") * 10 > F.col("total"))


def queries() -> dict:
    return {"analysis_progress": lambda spark, sf: progress(chunks(spark, sf)), "skipped_checks": lambda spark, sf: skipped_checks(chunks(spark, sf))}


def oracle_sql() -> dict[str, str]:
    table = f"c AS (SELECT o_custkey AS analysis_id, {STAGE} AS stage, {SETTLED} AS settled, {FAILED} AS failed, CAST(trunc(o_totalprice) AS BIGINT) % 1000 AS tokens FROM orders)"
    sums = ", ".join(f"count(*) FILTER (stage = '{s}') AS {s}_total, count(*) FILTER (stage = '{s}' AND settled) AS {s}_settled" for s in ("local", "context", "global"))
    names = ", ".join(f"'{s}'" for s in STATUS)
    return {
        "analysis_progress": f"""WITH {table}, s AS (SELECT analysis_id, count(*) AS total, count(*) FILTER (settled) AS done, {sums}, [{names}][1 + analysis_id % {len(STATUS)}] AS status FROM c GROUP BY analysis_id)
          SELECT analysis_id, status, total, done, CAST({PROGRESS} AS INT) AS progress, CAST({REMAINING} AS INT) AS seconds_left FROM s""",
        "skipped_checks": f"WITH {table} SELECT analysis_id, stage, count(*) AS total, count(*) FILTER (failed) AS skipped, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (failed) * 10 > count(*) AS too_many FROM c GROUP BY analysis_id, stage HAVING count(*) FILTER (failed) > 0",
    }
