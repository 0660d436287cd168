"""The registered queries of this package, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline import model
from proofline.functions import answers, scalar
from proofline.functions.text import word_count
from proofline.operators import ambiguity, anchor, beautify, decisions, edits, evaluate, filters, forms, grammar, history, issues, language, lexicon, names, parts, related, review, rules, segments, serve, structure, styles, wording, words
from proofline.plans import chunks, progress, work
from proofline.sources import html
from proofline.sources import text as source
from proofline.streaming import limits, quota, spacing

MODULES = [words, scalar, answers, rules, anchor, ambiguity, structure, styles, parts, names, language, lexicon, forms, grammar, issues, review, related, wording, serve, history, filters, edits, segments, beautify, evaluate, decisions, chunks, progress, work, quota, limits, spacing]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated words as final issues: classified, identified, and capped by the document's length."""
    blocks = source.blocks(spark, sf_dir)
    found = rules.repeated_word(blocks).select(
        "doc_id", F.col("ord").alias("block"), "start", "end", "original", "suggestion", F.lit("spelling").alias("category"), F.lit("typo").alias("subtype"), F.lit("major").alias("severity"), F.lit("high").alias("confidence"), F.lit("rules").alias("source")
    )
    least, per_thousand = model.RULE_CAPS["repeated_word"]
    length = blocks.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("n_words"))
    cap = F.greatest(F.lit(least), F.ceil(F.col("n_words") * F.lit(per_thousand) / 1000))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "start"))
    kept = found.join(length, "doc_id").withColumn("place", place).where(F.col("place") <= cap)
    marked = issues.classified(kept).withColumn("fingerprint", F.sha1(F.concat_ws("|", "category", "subtype", "doc_id", "block", "start", "end")))
    return marked.select("doc_id", "block", "start", "end", "original", "suggestion", "nature", "severity", "fingerprint", "place")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {"repeated_word_issues": flagship}
    for module in [*MODULES, html]:
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    least, per_thousand = model.RULE_CAPS["repeated_word"]
    hits = rules.oracle_sql()["repeated_word"]
    found = {
        "repeated_word_issues": f"""WITH hits AS ({hits}), len AS (SELECT doc_id, sum(n_words) AS n FROM ({words.oracle_sql()["block_word_count"]}) GROUP BY doc_id),
          p AS (SELECT h.*, n, row_number() OVER (PARTITION BY h.doc_id ORDER BY ord, start) AS place FROM hits h JOIN len USING (doc_id))
          SELECT doc_id, ord AS block, start, "end", original, suggestion, 'error' AS nature, 'major' AS severity, sha1(concat_ws('|', 'spelling', 'typo', doc_id, ord, start, "end")) AS fingerprint, CAST(place AS INT) AS place
          FROM p WHERE place <= greatest({least}, ceil(n * {per_thousand} / 1000))"""
    }
    for module in MODULES:
        found |= module.oracle_sql()
    return found
