"""Edits of block texts: checks with reasons, a choice without overlaps, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import rules
from proofline.sources import text as source

# Fixed value: characters of a replacement.
MAX_REPLACEMENT = 1000


def reason() -> Column:
    """Why an edit can't be applied, in the order of the checks; null if it can."""
    text, start, stop, new = F.col("text"), F.col("start"), F.col("stop"), F.col("replacement")
    bad_text = (F.length(new) > MAX_REPLACEMENT) | new.rlike(r"[\t\n\r\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]") | (new == F.col("expected"))
    return (
        F.when(text.isNull(), "block_not_found").when(text != F.col("expected_text"), "block_changed").when((start < 0) | (stop < start) | (stop > F.length(text)), "invalid_range")
        .when(F.substr(text, start + 1, stop - start) != F.col("expected"), "original_mismatch").when(F.col("kind") == "toc_entry", "unsupported_block").when(bad_text, "invalid_replacement")
    )


#: For both engines: edits of the documents' repeated words with every fault there is, by plain arithmetic.
FAULTS = {
    "expected_text": "CASE WHEN id % 11 = 0 THEN concat(text, 'x') ELSE text END",
    "new_start": "CASE WHEN id % 13 = 0 THEN -1 ELSE start END",
    "stop": "CASE WHEN id % 17 = 0 THEN 1000000 WHEN id % 19 = 0 THEN stop + 3 ELSE stop END",
    "new_ord": "CASE WHEN id % 23 = 0 THEN ord + 1000000 ELSE ord END",
    "replacement": "CASE id % 7 WHEN 0 THEN concat(suggestion, chr(9)) WHEN 1 THEN original WHEN 2 THEN repeat('x', 1001) ELSE suggestion END",
}
KIND = "CASE WHEN ord % 9 = 8 THEN 'toc_entry' ELSE 'paragraph' END"


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edits and blocks."""
    blocks = source.blocks(spark, sf_dir).withColumn("kind", F.expr(KIND))
    hits = rules.repeated_word(blocks).join(blocks.select("doc_id", "ord", "text"), ["doc_id", "ord"]).withColumnRenamed("end", "stop")
    hits = hits.withColumn("id", (F.col("doc_id") * 10000 + F.col("ord")) * 100000 + F.col("start"))
    made = hits.withColumns({c: F.expr(e.replace("chr(", "char(")) for c, e in FAULTS.items() if c != "stop"}).withColumn("stop", F.expr(FAULTS["stop"]))
    return made.select("id", "doc_id", F.col("new_ord").cast("int").alias("ord"), F.col("new_start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "expected_text", F.col("original").alias("expected"), "replacement"), blocks


def checked(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every edit with its block's text and the reason against it, null if there is none."""
    found = edits.join(blocks.select("doc_id", "ord", "kind", "text"), ["doc_id", "ord"], "left")
    return found.withColumn("reason", reason())


def apart(edits: DataFrame) -> DataFrame:
    """Edits in the order of the text; one that overlaps the last kept one gets the reason ``overlap``.

    What was kept last decides, so it is a fold over a block's edits in order.
    """
    e = F.struct("start", "stop", "id", "replacement")
    lists = edits.where("reason IS NULL").groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(e)).alias("edits"))
    empty = F.struct(F.lit(-1).alias("stop"), F.lit(False).alias("hollow"), F.array().cast("array<bigint>").alias("kept"))

    def step(a, x):
        hollow = x["start"] == x["stop"]
        clash = (x["start"] < a["stop"]) | ((x["start"] == a["stop"]) & (hollow | a["hollow"]))
        return F.when(clash, a).otherwise(F.struct(x["stop"].alias("stop"), hollow.alias("hollow"), F.concat(a["kept"], F.array(x["id"])).alias("kept")))

    return lists.withColumn("kept", F.aggregate("edits", empty, step, lambda a: a["kept"]))


def outcome(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """id and outcome of every edit: applied, or the reason why not."""
    found = checked(edits, blocks)
    kept = apart(found).select(F.explode("kept").alias("id"), F.lit(True).alias("kept"))
    return found.join(kept, "id", "left").select("id", F.coalesce("reason", F.when(F.col("kept"), F.lit("applied")), F.lit("overlap")).alias("outcome"))


def applied(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks with all kept edits made, from the end of the text to its start, so places stay right."""
    kept = apart(checked(edits, blocks))
    own = F.filter("edits", lambda x: F.array_contains("kept", x["id"]))
    text = F.aggregate(F.reverse(own), F.col("text"), lambda t, x: F.concat(F.substr(t, F.lit(1), x["start"]), x["replacement"], F.substr(t, x["stop"] + 1, F.length(t))))
    return blocks.join(kept, ["doc_id", "ord"]).select("doc_id", "ord", text.alias("text"))


def without_repeats(blocks: DataFrame) -> DataFrame:
    """Blocks with repeated words, each repetition replaced by one word."""
    hits = rules.repeated_word(blocks).join(blocks, ["doc_id", "ord"])
    edits = hits.select(F.xxhash64("doc_id", "ord", "start").alias("id"), "doc_id", "ord", "start", F.col("end").alias("stop"), F.col("text").alias("expected_text"), F.col("original").alias("expected"), F.col("suggestion").alias("replacement"))
    return applied(edits, blocks.withColumn("kind", F.lit("paragraph")))


def frozen(edits: DataFrame) -> DataFrame:
    """One hash per document over its edits in order, by which an equal export is found again."""
    e = F.concat_ws(":", "ord", "start", "stop", "replacement")
    return edits.groupBy("doc_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(e)), ";"), 256).alias("edits_hash"), F.count("*").alias("n"))


def queries() -> dict:
    return {
        "edit_reasons": lambda spark, sf: checked(*tables(spark, sf)).select("id", "reason"),
        "edit_outcomes_fold": lambda spark, sf: outcome(*tables(spark, sf)),
        "edits_frozen": lambda spark, sf: frozen(tables(spark, sf)[0]),
        "repeats_corrected_fold": lambda spark, sf: without_repeats(source.blocks(spark, sf)),
    }


#: For DuckDB: of the edits of ``r`` without a reason, those that don't overlap the one kept before.
KEPT_SQL = """l AS (SELECT doc_id, ord, list([{'s': start, 'e': stop, 'id': id}] ORDER BY start, stop, id) AS l FROM r WHERE reason IS NULL GROUP BY doc_id, ord),
  g AS (SELECT list_reduce(l, lambda a, x: CASE WHEN x[1].s < a[len(a)].e OR (x[1].s = a[len(a)].e AND (x[1].s = x[1].e OR a[len(a)].s = a[len(a)].e)) THEN a ELSE list_concat(a, x) END) AS l FROM l), kept AS (SELECT u.id FROM (SELECT unnest(l) AS u FROM g))"""


def oracle_sql() -> dict[str, str]:
    f = FAULTS
    e = f"""{source.SQL}, h AS (SELECT r.*, "end" AS stop, b.text, (r.doc_id * 10000 + r.ord) * 100000 + start AS id FROM ({rules.repeated_word_sql()}) r JOIN blocks b ON b.doc_id = r.doc_id AND b.ord = r.ord),
      e AS (SELECT id, doc_id, {f["new_ord"]} AS ord, {f["new_start"]} AS start, {f["stop"]} AS stop, {f["expected_text"]} AS expected_text, original AS expected, {f["replacement"]} AS replacement FROM h),
      k AS (SELECT doc_id, ord, text, {KIND} AS kind FROM blocks)"""
    why = f"""r AS (SELECT e.*, text, CASE WHEN text IS NULL THEN 'block_not_found' WHEN text <> expected_text THEN 'block_changed' WHEN start < 0 OR stop < start OR stop > length(text) THEN 'invalid_range'
      WHEN substring(text, start + 1, stop - start) <> expected THEN 'original_mismatch' WHEN kind = 'toc_entry' THEN 'unsupported_block'
      WHEN length(replacement) > {MAX_REPLACEMENT} OR contains(replacement, chr(9)) OR contains(replacement, chr(10)) OR replacement = expected THEN 'invalid_replacement' END AS reason FROM e LEFT JOIN k USING (doc_id, ord))"""
    one = "concat_ws(':', ord, start, stop, replacement)"
    return {
        "repeats_corrected_fold": f"""WITH {source.SQL}, r AS (SELECT doc_id, ord, start AS id, start, "end" AS stop, suggestion AS replacement, NULL AS reason FROM ({rules.repeated_word_sql()})),
          l AS (SELECT doc_id, ord, list([{{'s': start, 'e': stop, 'n': replacement}}] ORDER BY start, stop) AS l FROM r GROUP BY doc_id, ord), g AS (SELECT doc_id, ord, unnest(list_reduce(l, lambda a, x: CASE WHEN x[1].s < a[len(a)].e THEN a ELSE list_concat(a, x) END)) AS u FROM l),
          o AS (SELECT doc_id, ord, u, coalesce(lag(u.e) OVER w, 0) AS before, lead(u.s) OVER w IS NULL AS last FROM g WINDOW w AS (PARTITION BY doc_id, ord ORDER BY u.s))
          SELECT o.doc_id, o.ord, string_agg(substring(text, CAST(before + 1 AS BIGINT), CAST(u.s - before AS BIGINT)) || u.n || CASE WHEN last THEN substring(text, CAST(u.e + 1 AS BIGINT)) ELSE '' END, '' ORDER BY u.s) AS text FROM o JOIN blocks b ON b.doc_id = o.doc_id AND b.ord = o.ord GROUP BY o.doc_id, o.ord""",
        "edit_reasons": f"WITH {e}, {why} SELECT id, reason FROM r",
        "edit_outcomes_fold": f"WITH {e}, {why}, {KEPT_SQL} SELECT id, coalesce(reason, CASE WHEN id IN (SELECT id FROM kept) THEN 'applied' ELSE 'overlap' END) AS outcome FROM r",
        "edits_frozen": f"WITH {e} SELECT doc_id, sha256(string_agg({one}, ';' ORDER BY {one})) AS edits_hash, count(*) AS n FROM e GROUP BY doc_id",
    }
