"""Remarks on a whole document: those that name several blocks fan out to their places, and supposed contradictions become units of work whose verdict makes an issue or nothing.

All joins are by (doc_id, block) or (doc_id, unit); a document's units are ranked by one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.functions.text import SPACE, sentences_sql
from proofline.operators import review, rules
from proofline.operators.anchor import FIRST_LENGTH, anchor, first_sentence
from proofline.operators.structure import typed_blocks, typed_sql

# Sections that a document needs for remarks on the whole, and contradictions that are looked into.
LEAST_SECTIONS, MAX_UNITS = 2, 10


def known_items(items: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Remarks (doc_id, seq, block, related, subtype, severity, confidence) on blocks that exist, of documents with enough sections (doc_id, n_sections)."""
    enough = sections.where(F.col("n_sections") >= LEAST_SECTIONS).select("doc_id")
    own = blocks.select("doc_id", F.col("ord").alias("block"))
    return items.join(enough, "doc_id", "left_semi").join(own, ["doc_id", "block"], "left_semi")


def known_related(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, pos, other): the blocks that a remark names and that exist, in its order."""
    rows = items.select("doc_id", "seq", F.posexplode("related").alias("pos", "other"))
    return rows.join(blocks.select("doc_id", F.col("ord").alias("other")), ["doc_id", "other"], "left_semi")


def units(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first contradictions of a document as units: the remark's block against the first one that it names."""
    first = known_related(items, blocks).groupBy("doc_id", "seq").agg(F.min_by("other", "pos").alias("other"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    found = items.where("subtype = 'contradiction'").join(first, ["doc_id", "seq"]).withColumn("unit", place).where(F.col("unit") < MAX_UNITS)
    return found.select("doc_id", "unit", "seq", F.col("block").alias("block_a"), F.col("other").alias("block_b"), "severity", "confidence")


def passages(items: DataFrame, units: DataFrame, verdicts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every remark that becomes an issue, a row for each other block it is related to (one without any if there are none), with the place of the passage there.

    Contradictions count only through their unit's verdict (doc_id, unit, verdict, excerpt_a, excerpt_b): compatible makes nothing, contradictory keeps the confidence, anything
    else lowers it. An excerpt that doesn't stand in its block leaves the issue's own place open, and stands for the first sentence in the other block.
    """
    text = blocks.select("doc_id", F.col("ord").alias("block"), F.col("text").alias("own_text"))
    judged = units.join(verdicts.where("verdict <> 'compatible'"), ["doc_id", "unit"])
    confidence = F.when(F.col("verdict") == "contradictory", F.col("confidence")).otherwise(F.lit("low"))
    confirmed = judged.select("doc_id", "seq", F.lit("contradiction").alias("subtype"), F.col("block_a").alias("block"), confidence.alias("confidence"), "verdict", "excerpt_a", F.array("block_b").alias("related"), F.col("excerpt_b").alias("excerpt"))
    none = F.lit(None).cast("string")
    plain = items.where("subtype <> 'contradiction'").select("doc_id", "seq", "subtype", "block", "confidence", none.alias("verdict"), none.alias("excerpt_a"), "related", none.alias("excerpt"))
    issues = plain.union(confirmed).join(text, ["doc_id", "block"])
    issues = issues.withColumn("own", F.when(F.col("excerpt_a").isNotNull(), anchor(F.col("own_text"), F.col("excerpt_a")))).drop("own_text", "excerpt_a")
    fan = issues.select("doc_id", "seq", "block", "excerpt", F.explode("related").alias("other")).where("other <> block").dropDuplicates(["doc_id", "seq", "other"])
    there = fan.join(blocks.select("doc_id", F.col("ord").alias("other"), "text"), ["doc_id", "other"])
    place = F.coalesce(F.when(F.col("excerpt").isNotNull(), anchor(F.col("text"), F.col("excerpt"))), first_sentence(F.col("text")))
    placed = there.select("doc_id", "seq", "other", place.alias("p"))
    rows = issues.drop("related", "excerpt").join(placed, ["doc_id", "seq"], "left")
    return rows.select("doc_id", "seq", "subtype", "block", "confidence", "verdict", F.col("own.start").alias("own_start"), F.col("own.end").alias("own_end"), "other", "p.start", "p.end", "p.how")


#: For both engines: the issues of a review as remarks that name the next block, their own, a further one and one that isn't there; verdicts and excerpts by arithmetic.
SUBTYPE = "CASE place % 3 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'global_repetition' ELSE 'tense_shift' END"
RELATED = ["block + 1 + CAST(place % 2 AS INT)", "block", "block + 2 + CAST(place % 5 AS INT)", "-1"]
VERDICT = "CASE (doc_id + unit) % 3 WHEN 0 THEN 'contradictory' WHEN 1 THEN 'compatible' ELSE 'uncertain' END"
EXCERPT_A = "CASE WHEN unit % 2 = 0 THEN substring(text_a, 3, 20) ELSE 'zzq' END"
EXCERPT_B = "CASE WHEN unit % 4 < 3 THEN substring(text_b, 2, 25) ELSE 'zzq' END"


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks = rules.injected(spark, sf_dir).select("doc_id", "ord", "text")
    found = review.reviewed(rules.injected(spark, sf_dir))
    items = found.select("doc_id", F.col("issue_id").alias("seq"), "block", F.array(*map(F.expr, RELATED)).alias("related"), F.expr(SUBTYPE).alias("subtype"), "severity", "confidence")
    heads = typed_blocks(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("kind") == "heading").alias("n_sections"))
    return known_items(items, blocks, heads), blocks


def verdicts(units: DataFrame, blocks: DataFrame) -> DataFrame:
    side = lambda c: blocks.select("doc_id", F.col("ord").alias(f"block_{c}"), F.col("text").alias(f"text_{c}"))
    rows = units.join(side("a"), ["doc_id", "block_a"]).join(side("b"), ["doc_id", "block_b"])
    return rows.select("doc_id", "unit", F.expr(VERDICT).alias("verdict"), F.expr(EXCERPT_A).alias("excerpt_a"), F.expr(EXCERPT_B).alias("excerpt_b"))


def related_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, blocks = tables(spark, sf_dir)
    found = units(items, blocks)
    return passages(items, found, verdicts(found, blocks), blocks)


def queries() -> dict:
    return {"contradiction_units": lambda spark, sf: units(*tables(spark, sf)), "related_passages": related_passages}


def _ctes() -> str:
    trim = lambda x: f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    return f"""{review._ctes()}, heads AS (SELECT doc_id FROM (WITH {typed_sql()} SELECT * FROM blocks) WHERE kind = 'heading' GROUP BY doc_id HAVING count(*) >= {LEAST_SECTIONS}),
    item AS (SELECT doc_id, issue_id AS seq, block, place, {SUBTYPE} AS subtype, severity, confidence, [{", ".join(RELATED)}] AS related FROM classified WHERE doc_id IN (SELECT doc_id FROM heads)),
    rel AS (SELECT i.doc_id, seq, pos, other FROM (SELECT doc_id, seq, generate_subscripts(related, 1) AS pos, unnest(related) AS other FROM item) i WHERE EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = i.doc_id AND b.ord = other)),
    unit AS (SELECT i.doc_id, row_number() OVER (PARTITION BY i.doc_id ORDER BY i.seq) - 1 AS unit, i.seq, block AS block_a, o.other AS block_b, severity, confidence FROM item i JOIN (SELECT doc_id, seq, arg_min(other, pos) AS other FROM rel GROUP BY doc_id, seq) o USING (doc_id, seq)
      WHERE subtype = 'contradiction' QUALIFY unit < {MAX_UNITS}),
    told AS (SELECT u.*, {VERDICT} AS verdict, {trim(EXCERPT_A)} AS xa, {trim(EXCERPT_B)} AS xb, text_a, text_b FROM unit u JOIN (SELECT doc_id, ord AS block_a, text AS text_a FROM blocks) USING (doc_id, block_a) JOIN (SELECT doc_id, ord AS block_b, text AS text_b FROM blocks) USING (doc_id, block_b)),
    kept AS (SELECT doc_id, seq, 'contradiction' AS subtype, block_a AS block, CASE WHEN verdict = 'contradictory' THEN confidence ELSE 'low' END AS confidence, verdict, CASE WHEN xa <> '' AND strpos(text_a, xa) > 0 THEN strpos(text_a, xa) - 1 END AS own_start, length(xa) AS own_length, block_b AS other, xb FROM told WHERE verdict <> 'compatible'),
    open AS (SELECT i.doc_id, i.seq, subtype, block, confidence, NULL AS verdict, NULL AS own_start, NULL AS own_length, r.other, NULL AS xb FROM item i LEFT JOIN (SELECT DISTINCT r.doc_id, r.seq, r.other FROM rel r JOIN item i ON i.doc_id = r.doc_id AND i.seq = r.seq AND i.block <> r.other) r ON r.doc_id = i.doc_id AND r.seq = i.seq WHERE subtype <> 'contradiction'),
    both_kinds AS (SELECT * FROM open UNION ALL SELECT * REPLACE (CASE WHEN other <> block THEN other END AS other) FROM kept), {sentences_sql('blocks', 'doc_id, ord')}"""


def oracle_sql() -> dict[str, str]:
    return {
        "contradiction_units": f"WITH {_ctes()} SELECT doc_id, CAST(unit AS INT) AS unit, seq, block_a, block_b, severity, confidence FROM unit",
        "related_passages": f"""WITH {_ctes()} SELECT k.doc_id, seq, subtype, block, confidence, verdict, CAST(own_start AS INT) AS own_start, CAST(own_start + own_length AS INT) AS own_end, other,
          CAST(CASE WHEN xb <> '' AND strpos(b.text, xb) > 0 THEN strpos(b.text, xb) - 1 ELSE s.start END AS INT) AS start, CAST(CASE WHEN xb <> '' AND strpos(b.text, xb) > 0 THEN strpos(b.text, xb) - 1 + length(xb) ELSE least(s.start + length(s.text), s.start + {FIRST_LENGTH}) END AS INT) AS "end",
          CASE WHEN other IS NULL THEN NULL WHEN xb <> '' AND strpos(b.text, xb) > 0 THEN 'exact' ELSE 'first_sentence' END AS how
          FROM both_kinds k LEFT JOIN blocks b ON b.doc_id = k.doc_id AND b.ord = other LEFT JOIN sentences s ON s.doc_id = k.doc_id AND s.ord = other AND s.sentence = 0""",
    }
