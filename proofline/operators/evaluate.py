"""How many injected faults the rules find, and how many of their findings are true: recall and precision by document and over all.

Every fault is a known change of a text. A fault is found if an issue of its document has it in its excerpt, or the other way round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.text import SPACE
from proofline.operators.rules import repeated_word, repeated_word_sql
from proofline.sources import text as source

def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with faults, the second word of every third line doubled: doc_id, ord, text, and the excerpt that is wrong (null in the others)."""
    blocks = source.blocks(spark, sf_dir)
    word = F.regexp_extract("text", rf"^[^{SPACE}]+[ ]([a-z]{{4,12}})[ ]", 1)
    hit = (F.col("ord") % 3 == 0) & (word != "")
    text = F.regexp_replace("text", rf"^([^{SPACE}]+[ ])([a-z]{{4,12}})[ ]", "$1$2 $2 ")
    return blocks.select("doc_id", "ord", F.when(hit, text).otherwise(F.col("text")).alias("text"), F.when(hit, F.concat(word, F.lit(" "), word)).alias("wrong"))


def evaluated(blocks: DataFrame) -> DataFrame:
    """Per document: injected faults, found ones, findings and true ones."""
    faults = blocks.where("wrong IS NOT NULL").select("doc_id", "ord", "wrong")
    issues = repeated_word(blocks.select("doc_id", "ord", "text")).select("doc_id", "ord", "start", "original")
    alike = (F.contains("original", "wrong") | F.contains("wrong", "original"))
    one = lambda c: (faults["doc_id"] == issues["doc_id"]) & (faults["ord"] == issues["ord"]) & c
    found = faults.join(issues, one(alike), "left_semi").groupBy("doc_id").agg(F.count("*").alias("found"))
    true = issues.join(faults, one(alike), "left_semi").groupBy("doc_id").agg(F.count("*").alias("true_findings"))
    sums = blocks.groupBy("doc_id").agg(F.count("wrong").alias("injected")).join(found, "doc_id", "left").join(true, "doc_id", "left")
    sums = sums.join(issues.groupBy("doc_id").agg(F.count("*").alias("findings")), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sums.select("doc_id", "injected", zero("found"), zero("findings"), zero("true_findings"))


def totals(per_document: DataFrame) -> DataFrame:
    """Recall and precision in whole percent; null where there is nothing to divide by."""
    names = ("injected", "found", "findings", "true_findings")
    summed = per_document.agg(*[F.sum(c).alias(c) for c in names])
    percent = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 100 / F.col(b) + 0.5)).cast("int")
    return summed.select(*names, percent("found", "injected").alias("recall"), percent("true_findings", "findings").alias("precision"))


def queries() -> dict:
    return {"evaluated_documents": lambda spark, sf: evaluated(damaged(spark, sf)), "recall_precision": lambda spark, sf: totals(evaluated(damaged(spark, sf)))}


def oracle_sql() -> dict[str, str]:
    head = rf"^([^{SPACE}]+[ ])([a-z]{{4,12}})[ ]"
    blocks = source.SQL.replace("blocks AS", "plain AS") + rf""", faulty AS (SELECT *, regexp_extract(text, '{head}', 2) AS word FROM plain),
      blocks AS (SELECT doc_id, ord, CASE WHEN ord % 3 = 0 AND word <> '' THEN regexp_replace(text, '{head}', '\1\2 \2 ') ELSE text END AS text, CASE WHEN ord % 3 = 0 AND word <> '' THEN word || ' ' || word END AS wrong FROM faulty)"""
    each = f"""{blocks}, i AS ({repeated_word_sql(blocks)}), b AS (SELECT doc_id, ord, wrong FROM blocks WHERE wrong IS NOT NULL),
      d AS (SELECT doc_id, count(wrong) AS injected FROM blocks GROUP BY doc_id), f AS (SELECT b.doc_id, count(*) AS found FROM b WHERE EXISTS (SELECT 1 FROM i WHERE i.doc_id = b.doc_id AND i.ord = b.ord AND (contains(original, wrong) OR contains(wrong, original))) GROUP BY b.doc_id),
      n AS (SELECT doc_id, count(*) AS findings, count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE i.doc_id = b.doc_id AND i.ord = b.ord AND (contains(original, wrong) OR contains(wrong, original)))) AS true_findings FROM i GROUP BY doc_id),
      e AS (SELECT doc_id, injected, coalesce(found, 0) AS found, coalesce(findings, 0) AS findings, coalesce(true_findings, 0) AS true_findings FROM d LEFT JOIN f USING (doc_id) LEFT JOIN n USING (doc_id))"""
    return {
        "evaluated_documents": f"WITH {each} SELECT * FROM e",
        "recall_precision": f"""WITH {each}, s AS (SELECT CAST(sum(injected) AS BIGINT) AS injected, CAST(sum(found) AS BIGINT) AS found, CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(true_findings) AS BIGINT) AS true_findings FROM e)
          SELECT *, CAST(CASE WHEN injected > 0 THEN floor(found * 100 / injected + 0.5) END AS INT) AS recall, CAST(CASE WHEN findings > 0 THEN floor(true_findings * 100 / findings + 0.5) END AS INT) AS precision FROM s""",
    }
