"""Which findings count: places inside quotations, and what a service's answer may add to a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.operators.beautify import MARKED, marked
from proofline.operators.issues import ISSUES_SQL, issue_rows
from proofline.sources import text as source

# Issues that a chunk's answer may add, those of style among them, and issues of a section group's answer.
LOCAL, LOCAL_STYLE, CONTEXT = 25, 8, 8


def inside_quotation(text: Column, place: Column) -> Column:
    """Whether a place stands between quotation marks that are still open there."""
    before = F.substr(text, F.lit(1), place)
    n = lambda mark: F.length(before) - F.length(F.replace(before, F.lit(mark), F.lit("")))
    return (n("«") > n("»")) | (n('"') % 2 == 1) | (n("“") > n("”"))


def accepted(issues: DataFrame, allowed: DataFrame) -> DataFrame:
    """Issues of an answer that name a block of their chunk: the first of style up to their limit, and of those the first up to the answer's."""
    own = issues.join(allowed, ["doc_id", "block"], "left_semi").withColumn("chunk", F.expr("block div 8"))
    chunk = Window.partitionBy("doc_id", "chunk").orderBy("issue_id")
    style = F.sum((F.col("category") == "style").cast("int")).over(chunk.rowsBetween(Window.unboundedPreceding, 0))
    kept = own.withColumn("style", style).where((F.col("category") != "style") | (F.col("style") <= LOCAL_STYLE))
    return kept.withColumn("place", F.row_number().over(chunk)).where(F.col("place") <= LOCAL).select("issue_id", "doc_id", "chunk", "place")


def context_accepted(issues: DataFrame) -> DataFrame:
    """The first issues of each answer on a section group."""
    place = F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("issue_id"))
    return issues.withColumn("place", place).where(F.col("place") <= CONTEXT).select("issue_id", "doc_id", "block", "place")


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Issues by id, each once."""
    return issues.groupBy("issue_id", "doc_id").agg(F.min("block").alias("block"), F.min("category").alias("category"))


def queries() -> dict:
    def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
        half = F.expr("cast(length(text) div 2 as int)")
        return marked(spark, sf_dir).select("doc_id", "ord", half.alias("place"), inside_quotation(F.col("text"), half).alias("inside"))

    rows = lambda spark, sf: distinct_issues(issue_rows(spark, sf))
    return {
        "inside_quotation": quoted,
        "local_accepted": lambda spark, sf: accepted(rows(spark, sf), rows(spark, sf).select("doc_id", "block").distinct().where("(doc_id + block) % 5 <> 4")),
        "context_accepted": lambda spark, sf: context_accepted(rows(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    count = lambda mark: f"len(string_split(left(text, length(text) // 2), '{mark}')) - 1"
    once = f"{ISSUES_SQL}, u AS (SELECT issue_id, doc_id, min(block) AS block, min(category) AS category FROM issues GROUP BY issue_id, doc_id)"
    return {
        "inside_quotation": f"""WITH {source.SQL.replace("blocks AS", "plain AS")}, blocks AS (SELECT doc_id, ord, {MARKED} AS text FROM plain)
          SELECT doc_id, ord, CAST(length(text) // 2 AS INT) AS place, {count('«')} > {count('»')} OR ({count('"')}) % 2 = 1 OR {count('“')} > {count('”')} AS inside FROM blocks""",
        "local_accepted": f"""WITH {once}, o AS (SELECT *, block // 8 AS chunk, count(*) FILTER (category = 'style') OVER (PARTITION BY doc_id, block // 8 ORDER BY issue_id) AS style FROM u WHERE (doc_id + block) % 5 <> 4)
          SELECT issue_id, doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(row_number() OVER (PARTITION BY doc_id, chunk ORDER BY issue_id) AS INT) AS place FROM o WHERE category <> 'style' OR style <= {LOCAL_STYLE} QUALIFY place <= {LOCAL}""",
        "context_accepted": f"WITH {once} SELECT issue_id, doc_id, block, CAST(row_number() OVER (PARTITION BY doc_id, block ORDER BY issue_id) AS INT) AS place FROM u QUALIFY place <= {CONTEXT}",
    }
