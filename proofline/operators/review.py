"""The whole review of a corpus: all rules on all blocks, one issue per place, caps by length, nature and priority, the best 500, and the score.

Rules find issues inside the row. Then a document's issues are its only data: two greedy choices (by family within a block), two window ranks and one
aggregation, all partitioned by document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline import model
from proofline.functions.text import PROTECTED, matches, runs_sql, word_count, word_sql
from proofline.operators import forms, issues, rules, structure

COLUMNS = ["issue_id", "doc_id", "block", "start", "end", "rule", "category", "subtype", "severity", "confidence", "source", "original", "suggestion"]
#: An issue's number within its document has room for so many places in a block and so many rules.
PLACES, KINDS = 1 << 31, 1 << 5
# What each rule's issues are: category, subtype, severity, confidence.
KIND = {
    "repeated_word": ("spelling", "typo", "major", "high"),
    "long_sentence": ("style", "too_long", "minor", "medium"),
    "double_space": ("punctuation", "spacing", "minor", "high"),
    "space_before_punctuation": ("punctuation", "spacing", "minor", "high"),
    "doubled_punctuation": ("punctuation", "punctuation", "minor", "high"),
    "missing_space_after_comma": ("punctuation", "spacing", "minor", "high"),
    "misspelling": ("spelling", "misspelling", "minor", "medium"),
    "heading_gap": ("structure", "heading_numbering", "major", "high"),
    "undefined_acronym": ("coherence", "acronym", "minor", "medium"),
    "terminology_variant": ("coherence", "terminology_variant", "minor", "high"),
    "toc_mismatch": ("structure", "toc_mismatch", "major", "high"),
}
# Kinds of blocks that rules of language look at, and those that are written in sentences, with the rules that only these have.
LANGUAGE_KINDS, PROSE_KINDS = ("paragraph", "list_item", "table_cell", "caption", "footnote", "endnote"), ("paragraph", "list_item", "footnote", "endnote")
PROSE_RULES = ("long_sentence", "double_space")

Rule = Callable[[DataFrame], DataFrame]
#: The rules in the order in which they are tried: blocks to rows with ``rule`` and the columns of ``rules.FOUND``. A new rule is one more entry.
RULES: list[Rule] = [rules.every_hit]


def findings(blocks: DataFrame, by: list[Rule] | None = None) -> DataFrame:
    """The issues of all rules, those with a place inside their block only. A suggestion of nothing but spaces is none."""
    found = None
    for rule in by or RULES:
        own = rule(blocks).select("rule", *rules.FOUND)
        found = own if found is None else found.unionByName(own)
    number = {rule: k for k, rule in enumerate(KIND)}
    kinds = F.create_map(*[x for rule, kind in KIND.items() for x in (F.lit(rule), F.array(*map(F.lit, kind)))])[F.col("rule")]
    known = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("rule")]
    out = found.where("start >= 0 AND start < end").withColumns({"kind": kinds, "issue_id": F.col("ord").cast("long") * PLACES * KINDS + F.col("start").cast("long") * KINDS + known})
    names = {name: F.get("kind", F.lit(k)) for k, name in enumerate(("category", "subtype", "severity", "confidence"))}
    suggestion = F.when(F.trim("suggestion") != "", F.col("suggestion"))
    return out.withColumns({**names, "block": F.col("ord"), "source": F.lit("rules"), "suggestion": suggestion}).select(COLUMNS)


def reviewed(blocks: DataFrame) -> DataFrame:
    """The issues of a review, with nature, priority, place in the document's ranking and fingerprint."""
    words = blocks.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("doc_words"))
    found = issues.block_dedupe(findings(blocks)).join(words, "doc_id")
    found = issues.final_dedupe(issues.rule_cap(found).drop("place"))
    return marked(issues.top_issues(found, model.MAX_ISSUES))


def marked(best: DataFrame) -> DataFrame:
    out = best.withColumn("fingerprint", F.sha1(F.concat_ws("|", "category", "subtype", "doc_id", "block", "start", "end")))
    return out.select("doc_id", "issue_id", "block", "start", "end", "rule", "nature", "severity", "category", "confidence", "subtype", "original", "suggestion", "priority", "place", "capped", "fingerprint", "doc_words", "verdict")


#: A word of small letters that stands alone.
ALONE = rf"(?<![\p{{L}}\p{{N}}'’-])[{forms.LETTERS}]{{3,{forms.LONGEST}}}(?![\p{{L}}\p{{N}}'’-])"


def misspelling(blocks: DataFrame) -> DataFrame:
    """Words that the corpus hardly knows, with exactly one known word within one edit or two light ones: wherever they stand outside addresses, paths and code."""
    words = forms.words_of(blocks)
    near = forms.close_words(words.select("word"), words.where(F.col("n") >= forms.KNOWN).select("word"))
    sure = near.groupBy("word").agg(F.count("*").alias("n"), F.min("candidate").alias("suggestion")).where("n = 1").select("word", "suggestion")
    places = rules.calmed(blocks).select(*rules.KEYS, F.explode(matches(F.col("calm"), ALONE)).alias("m")).select(*rules.KEYS, "m.start", "m.end", F.col("m.text").alias("original"))
    return places.join(sure, places["original"] == sure["word"]).select(F.lit("misspelling").alias("rule"), *rules.FOUND)


def language_rules(blocks: DataFrame) -> DataFrame:
    """The rules on single blocks, on the kinds of blocks that each is for."""
    kinds = blocks.where(F.col("kind").isin(*LANGUAGE_KINDS))
    prose = F.col("kind").isin(*PROSE_KINDS)
    found = rules.every_hit(kinds.where(prose)).unionByName(rules.every_hit(kinds.where(~prose)).where(~F.col("rule").isin(*PROSE_RULES)))
    return found.select("rule", *rules.FOUND).union(misspelling(kinds))


def document_rules(blocks: DataFrame) -> DataFrame:
    """The rules on whole documents, each capped by itself. A variant or an entry is placed where it first stands in its block."""
    text = blocks.select(*rules.KEYS, "text")

    def found_by(rule: str, found: DataFrame, original: str, suggestion: str | None = None) -> DataFrame:
        rows = found.withColumns({"original": F.col(original), "new": F.col(suggestion) if suggestion else F.lit(None).cast("string")}).select(*rules.KEYS, "original", "new").join(text, rules.KEYS)
        start = F.position(F.col("original"), F.col("text")) - 1
        return rows.select(F.lit(rule).alias("rule"), *rules.KEYS, start.alias("start"), (start + F.length("original")).alias("end"), "original", F.col("new").alias("suggestion"))

    gaps, entries = structure.heading_gap(blocks), structure.toc_mismatch(blocks)
    acronyms = structure.undefined_acronym(blocks).select(F.lit("undefined_acronym").alias("rule"), *rules.KEYS, "start", (F.col("start") + F.length("acronym")).alias("end"), F.col("acronym").alias("original"), F.lit(None).cast("string").alias("suggestion"))
    return found_by("heading_gap", gaps, "number").union(acronyms).union(found_by("terminology_variant", structure.terminology_variant(blocks), "original", "suggestion")).union(found_by("toc_mismatch", entries, "original"))


def reviewed_by_all(blocks: DataFrame) -> DataFrame:
    """The review of typed blocks (doc_id, ord, kind, level, text, equations) by every rule.

    Rules of language compete for places within their block and are capped by the document's length; rules on documents join them after that; then one issue of a family stays
    at a place, and the best of a document.
    """
    words = blocks.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("doc_words"))
    own = issues.rule_cap(issues.block_dedupe(findings(blocks, [language_rules])).join(words, "doc_id")).drop("place")
    every = own.unionByName(findings(blocks, [document_rules]).join(words, "doc_id"))
    return marked(issues.top_issues(issues.final_dedupe(every), model.MAX_ISSUES))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks with faults in them."""
    blocks = structure.typed_blocks(spark, sf_dir).withColumn("equations", F.col("doc_id") % 10 == 0)
    return blocks.withColumn("text", F.when(F.col("kind").isin("heading", "toc_entry"), F.col("text")).otherwise(F.expr(rules.INJECTED)))


def queries() -> dict:
    blocks = rules.injected
    return {
        "full_review_issues": lambda spark, sf: reviewed_by_all(typed(spark, sf)).drop("doc_words", "verdict"),
        "full_review_scores": lambda spark, sf: issues.score(reviewed_by_all(typed(spark, sf))),
        "review_issues": lambda spark, sf: reviewed(blocks(spark, sf)).drop("doc_words", "verdict"),
        "review_scores": lambda spark, sf: issues.score(reviewed(blocks(spark, sf))),
        "rule_findings": lambda spark, sf: findings(blocks(spark, sf)).groupBy("doc_id", "rule").agg(F.count("*").alias("n")),
    }


def _full_ctes() -> str:
    """Every rule over typed blocks, language rules by kinds; ends in ``classified`` as the shorter review does."""
    typed = structure.typed_sql().replace("blocks AS", "tb AS") + f", every_block AS (SELECT doc_id, ord, kind, level, CASE WHEN kind IN ('heading', 'toc_entry') THEN text ELSE {rules.INJECTED} END AS text, doc_id % 10 = 0 AS equations FROM tb)"
    only = lambda kinds: f"{typed}, blocks AS (SELECT * FROM every_block WHERE kind IN ({', '.join(map(repr, kinds))}))"
    columns = 'doc_id, ord, start, "end", original, suggestion'
    language, prose = only(LANGUAGE_KINDS), only(PROSE_KINDS)
    whole = f"{typed}, blocks AS (SELECT doc_id, ord, kind, level, text FROM every_block)"
    calm = f"""{language}, {runs_sql('blocks', 'doc_id, ord')}, t AS (SELECT doc_id, ord, start, generate_subscripts(p, 1) AS i, unnest(p) AS tok FROM (SELECT *, regexp_extract_all(run, '[\\p{{L}}\\p{{N}}''’-]+|[^\\p{{L}}\\p{{N}}''’-]+') AS p FROM runs WHERE NOT regexp_matches(run, '{PROTECTED}'))),
      pl AS (SELECT doc_id, ord, tok, CAST(start + coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, ord, start ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s FROM t)"""
    spelled = f"""WITH {calm}, {forms.VOCABULARY_CTES}, {forms.close_ctes("SELECT word FROM v")}, sure AS (SELECT word, min(candidate) AS suggestion FROM near_known GROUP BY word HAVING count(*) = 1)
      SELECT doc_id, ord, s AS start, s + length(tok) AS "end", tok AS original, suggestion FROM pl JOIN sure ON sure.word = tok"""
    placed = lambda sql, original, new: f"""SELECT r.doc_id, r.ord, strpos(b.text, {original}) - 1 AS start, strpos(b.text, {original}) - 1 + length({original}) AS "end", {original} AS original, {new} AS suggestion FROM ({sql}) r JOIN (WITH {whole} SELECT * FROM blocks) b ON b.doc_id = r.doc_id AND b.ord = r.ord"""
    within = f"""SELECT 'repeated_word' AS rule, {columns} FROM ({rules.repeated_word_sql(language)}) UNION ALL SELECT 'long_sentence', doc_id, ord, start, "end", original, NULL FROM ({rules.long_sentence_sql(prose)})
      UNION ALL SELECT rule, {columns} FROM (WITH {language}, {rules.EQUATIONS}, {rules.typography_ctes()} SELECT * FROM found) x WHERE rule <> 'double_space' OR EXISTS (SELECT 1 FROM (WITH {prose} SELECT doc_id, ord FROM blocks) y WHERE y.doc_id = x.doc_id AND y.ord = x.ord)
      UNION ALL SELECT 'misspelling', {columns} FROM ({spelled})"""
    beyond = f"""SELECT 'heading_gap' AS rule, {columns} FROM ({placed(structure._heading_sql(), "r.number", "NULL")}) UNION ALL SELECT 'undefined_acronym', doc_id, ord, start, start + length(acronym), acronym, NULL FROM ({structure._acronym_sql(whole)})
      UNION ALL SELECT 'terminology_variant', {columns} FROM ({placed(structure._variant_sql(whole), "r.original", "r.suggestion")}) UNION ALL SELECT 'toc_mismatch', {columns} FROM ({placed(structure._toc_sql(), "r.original", "NULL")})"""
    return _classified(f"{whole}, every AS ({within}), beyond AS ({beyond})", "UNION ALL SELECT f.*, doc_words FROM late f JOIN len USING (doc_id)")


def _ctes() -> str:
    columns = 'doc_id, ord, start, "end", original, suggestion'
    return _classified(f"""{rules.INJECTED_SQL}, {rules.EQUATIONS}, every AS (SELECT 'repeated_word' AS rule, {columns} FROM ({rules.repeated_word_sql(rules.INJECTED_SQL)})
      UNION ALL SELECT 'long_sentence', doc_id, ord, start, "end", original, NULL FROM ({rules.long_sentence_sql(rules.INJECTED_SQL)})
      UNION ALL SELECT rule, {columns} FROM (WITH {rules.INJECTED_SQL}, {rules.EQUATIONS}, {rules.typography_ctes()} SELECT * FROM found))""")


def _classified(every: str, more: str = "") -> str:
    """The steps from ``every`` hit to ``classified`` issues; ``more`` adds those of ``beyond``, which rules cap by themselves."""
    case = lambda k: "CASE rule " + " ".join(f"WHEN '{rule}' THEN '{kind[k]}'" for rule, kind in KIND.items()) + " END"
    number = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {k}" for k, rule in enumerate(KIND)) + " END"
    least, per = (issues._case("rule", {rule: cap[k] for rule, cap in model.RULE_CAPS.items()}) for k in (0, 1))
    second = issues.GREEDY_SQL
    for name in ("lists", "folded", "apart"):
        second = second.replace(f"{name} AS", f"{name}2 AS").replace(f"FROM {name}", f"FROM {name}2")
    hit = lambda name, rows: f"""{name} AS (SELECT (CAST(ord AS BIGINT) * {PLACES} + start) * {KINDS} + {number} AS issue_id, doc_id, ord AS block, start, "end", rule, {case(0)} AS category, {case(1)} AS subtype, {case(2)} AS severity0, {case(3)} AS confidence,
      'rules' AS source, original, CASE WHEN trim(suggestion) <> '' THEN suggestion END AS suggestion, CAST(NULL AS VARCHAR) AS verdict FROM {rows} WHERE start >= 0 AND start < "end")"""  # noqa: E731
    late = f"{hit('late', 'beyond')}," if more else ""
    return f"""{every}, {hit("found", "every")}, {late}
    p AS (SELECT *, {issues._case("confidence", model.CONFIDENCE_RANK)} AS priority, {issues.FAMILY} AS family FROM found), {issues.GREEDY_SQL},
    len AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '{word_sql()}'))) AS BIGINT) AS doc_words FROM blocks GROUP BY doc_id),
    capped0 AS (SELECT f.*, doc_words FROM found f JOIN apart USING (doc_id, issue_id) JOIN len USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id, rule ORDER BY block, start, issue_id) <= greatest({least}, ceil(({per}) * doc_words / 1000))),
    capped AS (SELECT * FROM capped0 {more}),
    natured AS (SELECT * EXCLUDE (severity0), severity0 AS severity, {issues.NATURE} AS nature FROM capped), classed AS (SELECT * EXCLUDE (severity), {issues.SEVERITY} AS severity FROM natured),
    q AS (SELECT *, {issues.PRIORITY} AS priority, {issues.FAMILY} AS family FROM classed), {second.replace("FROM p ", "FROM q ")},
    ranked AS (SELECT q.*, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, block, start, issue_id) AS place, count(*) OVER (PARTITION BY doc_id) > {model.MAX_ISSUES} AS capped FROM q JOIN apart2 USING (doc_id, issue_id)),
    classified AS (SELECT * FROM ranked WHERE place <= {model.MAX_ISSUES})"""


def oracle_sql() -> dict[str, str]:
    listed = lambda ctes: f"""WITH {ctes} SELECT doc_id, issue_id, block, start, "end", rule, nature, severity, category, confidence, subtype, original, suggestion, CAST(priority AS INT) AS priority, CAST(place AS INT) AS place, capped,
          sha1(concat_ws('|', category, subtype, doc_id, block, start, "end")) AS fingerprint FROM classified"""  # noqa: E731
    return {
        "review_issues": listed(_ctes()),
        "full_review_issues": listed(_full_ctes()),
        "full_review_scores": f"WITH {_full_ctes()}, {issues.score_ctes()} SELECT * FROM scored",
        "review_scores": f"WITH {_ctes()}, {issues.score_ctes()} SELECT * FROM scored",
        "rule_findings": f"WITH {_ctes()} SELECT doc_id, rule, count(*) AS n FROM found GROUP BY doc_id, rule",
    }
