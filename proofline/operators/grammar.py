"""Findings of an outside grammar checker, given as a table, as issues of the block table.

Findings of other kinds, in addresses or code, that only change typography, or on names are left out. Findings of one rule in one sentence are
alternatives: the one with the lowest action number stands, and the others make it uncertain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.functions.text import PROTECTED, SPACE, computed
from proofline.operators.rules import repeated_word, repeated_word_sql, values
from proofline.sources import text as source

# Kinds of findings and their subtypes, the kinds that can be sure, and homophones that make any finding doubtful.
KINDS = {"gn": "gender_number", "ppas": "agreement", "conj": "conjugation", "infi": "conjugation", "imp": "conjugation", "vmode": "conjugation", "inte": "syntax", "conf": "syntax", "loc": "syntax"}
SURE = ("gn", "ppas", "conj", "infi")
HOMOPHONES = (
    "a à as ont on son sont ses ces c’est s’est sait ce se et est es ou où leur leurs la là l’a ma m’a ta t’a mes mais peu peut peux quel quelle quels quelles qu’elle qu’elles quand quant sans s’en dans d’en ni n’y si s’y ci tout tous"
).split()
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
#: A word with a digit, of capitals only, or with a capital inside.
NAME = r"\p{N}|^\p{Lu}{2,}$|.\p{Lu}"

def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[’‘ʼ`´]", "'"), f"[{SPACE}]+", " "))


def mapped(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, ord, start, stop, subtype, suggestion, confidence, alternatives."""
    dim = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    found = findings.withColumn("subtype", dim[F.col("kind")]).where("subtype IS NOT NULL").join(blocks, ["doc_id", "ord"])
    found = found.where("start >= 0 AND start < stop AND stop <= length(text)")
    before = F.substr("text", F.lit(1), F.col("start"))
    # what ends at a place is looked for from there, in the reversed text, so no pattern is tried at every character before it
    behind = lambda text, pattern, group: F.reverse(F.regexp_extract(F.reverse(text), pattern, group))
    run = F.concat(behind(before, f"^[^{SPACE}]*", 0), F.regexp_extract(F.substr("text", F.col("start") + 1), f"^[^{SPACE}]*", 0))
    # the text itself stays here: a block of many findings would be shuffled once for each
    found = computed(
        found, ["doc_id", "ord", "start", "stop", "rule", "kind", "suggestions", "subtype"], original=F.substr("text", F.col("start") + 1, F.col("stop") - F.col("start")), run=run,
        sentence=F.regexp_count(before, F.lit(r"[.!?…]+\s+")), last=F.lower(behind(F.regexp_replace(before, r"^.*[.!?…]+\s+", ""), f"^[^\\p{{L}}\\p{{N}}]*({WORD})", 1)),
    )
    found = found.where((F.trim("original") != "") & ~F.col("run").rlike(PROTECTED))
    useful = F.array_distinct(F.filter("suggestions", lambda s: (F.trim(s) != "") & (plain(s) != plain(F.col("original")))))
    found = found.withColumn("useful", useful).where((F.size("suggestions") == 0) | (F.size("useful") > 0))
    words = F.regexp_extract_all("original", F.lit(WORD), F.lit(0))
    names = F.size(F.filter(words, lambda w: w.rlike(NAME)))
    found = found.where(~((F.size(words) == 1) & (names == 1)) & ~((F.size("useful") == 0) & (names > 0)))
    found = found.withColumns({"rule_group": F.regexp_replace("rule", r"_a\d+_\d+$", ""), "action": F.regexp_extract("rule", r"_a(\d+)_\d+$", 1).cast("int")})
    group = Window.partitionBy("doc_id", "ord", "rule_group", "sentence")
    found = found.withColumns({"n": F.count("*").over(group), "place": F.row_number().over(group.orderBy("action", "start"))}).where("place = 1")
    last = F.col("last")
    curly = lambda w: F.regexp_replace(F.lower(w), "['ʼ`´]", "’")
    doubtful = curly(last).isin(HOMOPHONES) | F.exists(words, lambda w: curly(w).isin(HOMOPHONES)) | last.rlike(r"\p{N}")
    confidence = F.when(F.size("useful") == 0, "low").when((F.size("useful") == 1) & (F.col("n") == 1) & F.col("kind").isin(*SURE) & ~doubtful, "high").otherwise("medium")
    return found.select("doc_id", "ord", "start", "stop", "subtype", F.get("useful", F.lit(0)).alias("suggestion"), confidence.alias("confidence"), (F.col("n") - 1).cast("int").alias("alternatives"))


#: For both engines: the checker's findings, on the documents' repeated words, by plain arithmetic on their place.
MADE = {"kind": "element_at(array('gn', 'ppas', 'conj', 'infi', 'typo', 'inte'), cast(start % 6 + 1 as int))", "rule": "concat('r', start % 50, '_a', start % 3 + 1, '_1')"}
KIND_SQL = "['gn', 'ppas', 'conj', 'infi', 'typo', 'inte'][1 + start % 6]"


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings (doc_id, ord, start, stop, rule, kind, suggestions) and blocks."""
    blocks = source.blocks(spark, sf_dir)
    hits = repeated_word(blocks).withColumnRenamed("end", "stop").withColumns({c: F.expr(e) for c, e in MADE.items()})
    other = F.when(F.col("start") % 4 == 0, F.array().cast("array<string>")).when(F.col("start") % 4 == 1, F.array("suggestion")).when(F.col("start") % 4 == 2, F.array("suggestion", F.upper("suggestion"))).otherwise(F.array("original"))
    return hits.select("doc_id", "ord", "start", "stop", "rule", "kind", other.alias("suggestions")), blocks


def by_kind(findings: DataFrame) -> DataFrame:
    """How many findings of each kept subtype the checker gave."""
    dim = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return findings.withColumn("subtype", dim[F.col("kind")]).where("subtype IS NOT NULL").groupBy("subtype").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {"grammar_issues": lambda spark, sf: mapped(*tables(spark, sf)), "grammar_kinds": lambda spark, sf: by_kind(tables(spark, sf)[0])}


def oracle_sql() -> dict[str, str]:
    q = lambda x: x.replace("'", "''")
    plain_sql = lambda x: f"trim(regexp_replace(regexp_replace({x}, '[’‘ʼ`´]', chr(39), 'g'), '[{SPACE}]+', ' ', 'g'))"
    curly = lambda x: f"regexp_replace(lower({x}), '[''ʼ`´]', '’', 'g')"
    same, sure = (", ".join(f"'{x}'" for x in xs) for xs in (HOMOPHONES, SURE))
    kinds = f"k(kind, subtype) AS (VALUES {values(list(KINDS.items()))})"
    return {
        "grammar_issues": rf"""WITH {source.SQL}, {kinds}, h AS (SELECT r.doc_id, r.ord, start, "end" AS stop, suggestion, original, text FROM ({repeated_word_sql()}) r JOIN blocks b ON b.doc_id = r.doc_id AND b.ord = r.ord),
        f AS (SELECT *, {KIND_SQL} AS kind, start % 50 AS rule_group, start % 3 + 1 AS action, CASE start % 4 WHEN 0 THEN [] WHEN 1 THEN [suggestion] WHEN 2 THEN [suggestion, upper(suggestion)] ELSE [original] END AS offered FROM h),
        g AS (SELECT *, left(text, start) AS before, list_filter(offered, lambda x: trim(x) <> '' AND {plain_sql('x')} <> {plain_sql('original')}) AS fit, regexp_extract_all(original, '{q(WORD)}') AS words FROM f JOIN k USING (kind)),
        u AS (SELECT *, list_filter(fit, lambda x, i: list_position(fit, x) = i) AS useful, len(list_filter(words, lambda w: regexp_matches(w, '{NAME}'))) AS names FROM g),
        w AS (SELECT *, len(regexp_extract_all(before, '[.!?…]+\s+')) AS sentence, lower(regexp_extract(regexp_replace(before, '^.*[.!?…]+\s+', ''), '({q(WORD)})[^\p{{L}}\p{{N}}]*$', 1)) AS last FROM u
          WHERE trim(original) <> '' AND (len(offered) = 0 OR len(useful) > 0) AND NOT (len(words) = 1 AND names = 1) AND NOT (len(useful) = 0 AND names > 0)
            AND NOT regexp_matches(regexp_extract(before, '[^{SPACE}]*$') || regexp_extract(substring(text, start + 1), '^[^{SPACE}]*'), '{PROTECTED}')),
        o AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY doc_id, ord, rule_group, sentence ORDER BY action, start) AS place FROM w WINDOW g AS (PARTITION BY doc_id, ord, rule_group, sentence)),
        d AS (SELECT *, list_contains([{same}], {curly('last')}) OR len(list_filter(words, lambda x: list_contains([{same}], {curly('x')}))) > 0 OR regexp_matches(last, '\p{{N}}') AS doubtful FROM o WHERE place = 1)
        SELECT doc_id, ord, start, stop, subtype, useful[1] AS suggestion, CASE WHEN len(useful) = 0 THEN 'low' WHEN len(useful) = 1 AND n = 1 AND kind IN ({sure}) AND NOT doubtful THEN 'high' ELSE 'medium' END AS confidence, CAST(n - 1 AS INT) AS alternatives FROM d""",
        "grammar_kinds": f"WITH f AS (SELECT {KIND_SQL} AS kind FROM ({repeated_word_sql()})), {kinds} SELECT subtype, count(*) AS n FROM f JOIN k USING (kind) GROUP BY subtype",
    }
