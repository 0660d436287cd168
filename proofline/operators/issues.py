"""The issue table: classification, identity, priority, overlap removal, caps, counts and scores.

The driver has no issue table. ``issue_rows`` derives one from ``lineitem`` by plain arithmetic, written in both engines, so that every query on
issues has independent SQL.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline import model

#: Issues of so many consecutive orders make up a document, so the documents grow with the data and no document does.
ORDERS = 60
#: Two subtypes of each category, in the order of the categories.
_SUBTYPES = [s for names in model.SUBTYPES.values() for s in (names[0], names[1])]
_RULES = list(model.RULE_CAPS)


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


ISSUES_SQL = f"""issues AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS issue_id, l_orderkey // {ORDERS} AS doc_id, CAST(l_partkey % 40 AS INT) AS block,
  CAST(l_suppkey % 90 + l_partkey % 300 AS INT) AS start, CAST(l_suppkey % 90 + l_partkey % 300 + 1 + 3 * l_linenumber AS INT) AS "end",
  {_list(model.CATEGORIES)}[1 + l_partkey % 6] AS category, {_list(_SUBTYPES)}[1 + 2 * (l_partkey % 6) + l_orderkey % 2] AS subtype,
  {_list(_RULES)}[1 + (l_partkey + l_linenumber) % 9] AS rule, {_list(model.SEVERITIES)}[1 + l_orderkey % 3] AS severity, {_list(model.CONFIDENCES)}[1 + l_linenumber % 3] AS confidence,
  {_list(model.SOURCES)}[1 + (l_orderkey + l_linenumber) % 5] AS source, {_list(model.STATUSES)}[1 + (l_orderkey + l_partkey) % 5] AS status,
  'w' || (l_partkey % 50) AS original, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'w' || (l_orderkey % 50) END AS suggestion,
  CASE l_suppkey % 3 WHEN 0 THEN 'contradictory' WHEN 1 THEN 'compatible' END AS verdict, 200 + (l_orderkey // {ORDERS} * 37) % 5000 AS doc_words FROM lineitem)"""


def _pick(items: list[str], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), F.expr(f"cast({index} + 1 as int)"))


def issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return lines.select(
        F.expr("((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey").alias("issue_id"),
        F.expr(f"l_orderkey div {ORDERS}").alias("doc_id"),
        F.expr("cast(l_partkey % 40 as int)").alias("block"),
        F.expr("cast(l_suppkey % 90 + l_partkey % 300 as int)").alias("start"),
        F.expr("cast(l_suppkey % 90 + l_partkey % 300 + 1 + 3 * l_linenumber as int)").alias("end"),
        _pick(model.CATEGORIES, "l_partkey % 6").alias("category"),
        _pick(_SUBTYPES, "2 * (l_partkey % 6) + l_orderkey % 2").alias("subtype"),
        _pick(_RULES, "(l_partkey + l_linenumber) % 9").alias("rule"),
        _pick(model.SEVERITIES, "l_orderkey % 3").alias("severity"),
        _pick(model.CONFIDENCES, "l_linenumber % 3").alias("confidence"),
        _pick(model.SOURCES, "(l_orderkey + l_linenumber) % 5").alias("source"),
        _pick(model.STATUSES, "(l_orderkey + l_partkey) % 5").alias("status"),
        F.expr("concat('w', l_partkey % 50)").alias("original"),
        F.expr("case when l_partkey % 7 <> 0 then concat('w', l_orderkey % 50) end").alias("suggestion"),
        F.expr("case l_suppkey % 3 when 0 then 'contradictory' when 1 then 'compatible' end").alias("verdict"),
        F.expr(f"200 + (l_orderkey div {ORDERS} * 37) % 5000").alias("doc_words"),
    )


# For DuckDB only: what the columns below say for Spark.
NATURE = """CASE WHEN category IN ('spelling', 'grammar', 'punctuation') THEN CASE WHEN confidence = 'low' THEN 'verify' WHEN confidence = 'high' AND suggestion IS NOT NULL THEN 'error' ELSE 'suggestion' END
  WHEN category = 'style' THEN CASE WHEN confidence = 'low' THEN 'verify' ELSE 'suggestion' END
  WHEN category = 'coherence' AND subtype = 'contradiction' THEN CASE WHEN verdict = 'contradictory' THEN 'potential' ELSE 'verify' END
  WHEN category = 'coherence' THEN CASE WHEN confidence = 'low' THEN 'verify' ELSE 'potential' END
  WHEN subtype IN ('heading_numbering', 'toc_mismatch') THEN CASE WHEN confidence = 'high' THEN 'potential' ELSE 'verify' END
  WHEN subtype IN ('weak_transition', 'heading_wording') AND confidence = 'high' AND suggestion IS NOT NULL THEN 'suggestion' ELSE 'verify' END"""
SEVERITY = "CASE WHEN nature = 'verify' AND severity = 'critical' THEN 'major' ELSE severity END"
FAMILY = "CASE WHEN category IN ('spelling', 'grammar', 'punctuation') THEN 'language' ELSE category || ':' || subtype END"
LANGUAGE = ("spelling", "grammar", "punctuation")


def nature() -> Column:
    """What an issue claims to be: an error only if a correction is sure, never more than a hint where nothing is."""
    sure, unsure, corrected = F.col("confidence") == "high", F.col("confidence") == "low", F.col("suggestion").isNotNull()
    doubt = lambda otherwise: F.when(unsure, F.lit("verify")).otherwise(F.lit(otherwise))
    language = F.when(unsure, F.lit("verify")).when(sure & corrected, F.lit("error")).otherwise(F.lit("suggestion"))
    contradiction = F.when(F.col("verdict").eqNullSafe("contradictory"), F.lit("potential")).otherwise(F.lit("verify"))
    numbering = F.when(sure, F.lit("potential")).otherwise(F.lit("verify"))
    wording = F.when(sure & corrected, F.lit("suggestion")).otherwise(F.lit("verify"))
    structure = F.when(F.col("subtype").isin("heading_numbering", "toc_mismatch"), numbering).when(F.col("subtype").isin("weak_transition", "heading_wording"), wording).otherwise(F.lit("verify"))
    coherence = F.when(F.col("subtype") == "contradiction", contradiction).otherwise(doubt("potential"))
    return F.when(F.col("category").isin(*LANGUAGE), language).when(F.col("category") == "style", doubt("suggestion")).when(F.col("category") == "coherence", coherence).otherwise(structure)


def family() -> Column:
    """Issues of one family compete for a place in the text."""
    return F.when(F.col("category").isin(*LANGUAGE), F.lit("language")).otherwise(F.concat_ws(":", "category", "subtype"))


def ranked(column: str, ranks: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])[F.col(column)]


def priority() -> Column:
    parts = ((model.NATURE_RANK, "nature", 1000), (model.CONFIDENCE_RANK, "confidence", 100), (model.SEVERITY_RANK, "severity", 10), (model.SOURCE_RANK, "source", 1))
    return sum((ranked(column, ranks) * weight for ranks, column, weight in parts), F.lit(0))


def _case(column: str, ranks: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " END"


PRIORITY = f"{_case('nature', model.NATURE_RANK)} * 1000 + {_case('confidence', model.CONFIDENCE_RANK)} * 100 + {_case('severity', model.SEVERITY_RANK)} * 10 + {_case('source', model.SOURCE_RANK)}"
CLASSIFIED_SQL = ISSUES_SQL + f""", natured AS (SELECT *, {NATURE} AS nature FROM issues), classified AS (SELECT * EXCLUDE (severity), {SEVERITY} AS severity FROM natured)"""


def classified(issues: DataFrame) -> DataFrame:
    """Issues with their nature, and a severity that fits it."""
    out = issues if "verdict" in issues.columns else issues.withColumn("verdict", F.lit(None).cast("string"))
    softened = F.when((F.col("nature") == "verify") & (F.col("severity") == "critical"), F.lit("major")).otherwise(F.col("severity"))
    return out.withColumn("nature", nature()).withColumn("severity", softened)


def fingerprint(issues: DataFrame) -> DataFrame:
    """The identity of an issue: a hash of what it is and where. The first of equal ones stays."""
    marked = issues.withColumn("fingerprint", F.sha1(F.concat_ws("|", "category", "subtype", "doc_id", "block", "start", "end")))
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("issue_id"))
    return marked.withColumn("n", first).where("n = 1").select("issue_id", "doc_id", "fingerprint")


def rule_cap(issues: DataFrame) -> DataFrame:
    """The first issues of every rule in a document, in document order, up to the rule's cap for its length (``doc_words``)."""
    caps = F.create_map(*[F.lit(x) for rule, cap in model.RULE_CAPS.items() for x in (rule, F.struct(F.lit(float(cap[0])).alias("least"), F.lit(float(cap[1])).alias("per")))])[F.col("rule")]
    place = F.row_number().over(Window.partitionBy("doc_id", "rule").orderBy("block", "start", "issue_id"))
    cap = F.greatest(caps["least"], F.ceil(caps["per"] * F.col("doc_words") / 1000).cast("double"))
    return issues.withColumn("place", place).where(F.col("place") <= cap)


def top_issues(issues: DataFrame, most: int) -> DataFrame:
    """The most important issues of each document, with priority and place; ``capped`` tells whether there were more. All columns stay."""
    w = Window.partitionBy("doc_id")
    found = classified(issues).withColumn("priority", priority())
    found = found.withColumns({"place": F.row_number().over(w.orderBy(F.desc("priority"), "block", "start", "issue_id")), "capped": F.count("*").over(w) > most})
    return found.where(F.col("place") <= most)


GROUP = ["doc_id", "block", "family"]


def keep_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy choice in the order of the rows: an issue stays if no kept one of its group overlaps it.

    Rows come sorted by group, so only one group's kept places are in memory; they are held sorted, so each test is one search.
    """
    group, starts, ends = None, [], []
    for batch in batches:
        keep = []
        for start, end, *own in zip(*(batch[c].to_pylist() for c in ("start", "end", *GROUP)), strict=True):
            if own != group:
                group, starts, ends = own, [], []
            at = bisect.bisect_left(starts, end)
            free = not at or ends[at - 1] <= start
            if free:
                starts.insert(at, start)
                ends.insert(at, end)
            keep.append(free)
        yield batch.filter(pa.array(keep, pa.bool_()))


def greedy(issues: DataFrame) -> DataFrame:
    """One issue per place in each group, the one with the highest priority; ties go to the first in the text. All columns stay."""
    ordered = issues.repartition(*GROUP).sortWithinPartitions(*GROUP, F.desc("priority"), "start", "issue_id")
    return ordered.mapInArrow(keep_apart, ordered.schema).drop("priority", "family")


def final_dedupe(issues: DataFrame) -> DataFrame:
    """Between stages: the most important issue of a family stays at a place. Groups are the issues of one family in one block."""
    return greedy(classified(issues).withColumns({"priority": priority(), "family": family()}))


def block_dedupe(issues: DataFrame) -> DataFrame:
    """The same within the rules' own output: the most confident one stays, then the one found first."""
    return greedy(issues.withColumns({"priority": ranked("confidence", model.CONFIDENCE_RANK), "family": family()}))


def counts(issues: DataFrame) -> DataFrame:
    """Issues of each document by dimension and value, zeros included."""
    spark = issues.sparkSession
    dimensions = {"nature": model.NATURES, "category": model.CATEGORIES, "source": model.SOURCES}
    grid = spark.createDataFrame([(d, v) for d, vs in dimensions.items() for v in vs], "dimension string, value string")
    rows = classified(issues).select("doc_id", F.explode(F.create_map(*[x for d in dimensions for x in (F.lit(d), F.col(d))])).alias("dimension", "value"))
    found = rows.groupBy("doc_id", "dimension", "value").agg(F.count("*").alias("n"))
    every = issues.select("doc_id").distinct().join(F.broadcast(grid))
    return every.join(found, ["doc_id", "dimension", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


# The weights and limits of the score.
NATURE_WEIGHT = {"error": 1.0, "suggestion": 0.3, "potential": 0.5, "verify": 0.0}
PENALTY_CAP = {"spelling": 25, "grammar": 25, "punctuation": 10, "style": 15, "coherence": 15, "structure": 10}
PER_DENSITY, LEAST_WORDS = 2, 250


def score(issues: DataFrame) -> DataFrame:
    """Penalties by category from weighted density in ``doc_words``, each capped and rounded to tenths, and what they leave of 100."""
    thousands = F.greatest(F.col("doc_words"), F.lit(LEAST_WORDS)) / 1000
    weight = ranked("nature", NATURE_WEIGHT) * ranked("severity", model.SEVERITY_RANK)
    raw = lambda c: F.round(F.sum(F.when(F.col("category") == c, weight).otherwise(0.0)), 6)
    summed = classified(issues).groupBy("doc_id").agg(F.first("doc_words").alias("doc_words"), *[raw(c).alias(c) for c in model.CATEGORIES])
    penalty = lambda c: F.floor(F.least(F.lit(float(PENALTY_CAP[c])), F.col(c) / thousands * PER_DENSITY) * 10 + 0.5) / 10
    out = summed.select("doc_id", *[penalty(c).alias(c) for c in model.CATEGORIES])
    total = sum((F.col(c) for c in model.CATEGORIES[1:]), F.col(model.CATEGORIES[0]))
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 - F.round(total, 6) + 0.5))).cast("int"))


def score_ctes() -> str:
    """For DuckDB: the score as common table expressions over ``classified``, ending in ``scored``."""
    weight = f"{_case('nature', NATURE_WEIGHT)} * {_case('severity', model.SEVERITY_RANK)}"
    raw = ", ".join(f"round(CAST(sum(CASE WHEN category = '{c}' THEN CAST({weight} AS DOUBLE) ELSE 0.0 END) AS DOUBLE), 6) AS {c}" for c in model.CATEGORIES)
    thousands = f"(greatest(doc_words, {LEAST_WORDS}) / 1000)"
    pen = ", ".join(f"floor(least(CAST({PENALTY_CAP[c]} AS DOUBLE), {c} / {thousands} * {PER_DENSITY}) * 10 + 0.5) / 10 AS {c}" for c in model.CATEGORIES)
    total = " + ".join(model.CATEGORIES)
    return f"""s AS (SELECT doc_id, any_value(doc_words) AS doc_words, {raw} FROM classified GROUP BY doc_id), pen AS (SELECT doc_id, {pen} FROM s),
      scored AS (SELECT *, CAST(greatest(0, least(100, floor(100 - round({total}, 6) + 0.5))) AS INT) AS score FROM pen)"""


TOP = 20
#: For DuckDB: of the rows of ``p``, those that no kept row of their group overlaps, as a fold over lists.
GREEDY_SQL = """lists AS (SELECT doc_id, list([{'s': start, 'e': "end", 'id': issue_id}] ORDER BY priority DESC, start, issue_id) AS l FROM p GROUP BY doc_id, block, family),
  folded AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN a ELSE list_concat(a, x) END) AS l FROM lists),
  apart AS (SELECT u.id AS issue_id, doc_id FROM (SELECT doc_id, unnest(l) AS u FROM folded))"""


def queries() -> dict:
    rows = issue_rows
    return {
        "issue_classified": lambda spark, sf: classified(rows(spark, sf)).select("issue_id", "doc_id", "category", "subtype", "confidence", "nature", "severity"),
        "issue_fingerprint": lambda spark, sf: fingerprint(rows(spark, sf)),
        "rule_cap": lambda spark, sf: rule_cap(rows(spark, sf)).select("issue_id", "doc_id", "rule", "place"),
        "top_issues": lambda spark, sf: top_issues(rows(spark, sf), TOP).select("issue_id", "doc_id", "priority", "place", "capped"),
        "final_dedupe_greedy": lambda spark, sf: final_dedupe(rows(spark, sf)).select("issue_id", "doc_id"),
        "block_dedupe_greedy": lambda spark, sf: block_dedupe(rows(spark, sf)).select("issue_id", "doc_id"),
        "issue_counts": lambda spark, sf: counts(rows(spark, sf)),
        "quality_score": lambda spark, sf: score(rows(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    least, per = (_case("rule", {rule: cap[k] for rule, cap in model.RULE_CAPS.items()}) for k in (0, 1))
    dims = " UNION ALL ".join(f"SELECT '{d}' AS dimension, unnest({_list(v)}) AS value" for d, v in {"nature": model.NATURES, "category": model.CATEGORIES, "source": model.SOURCES}.items())
    found = " UNION ALL ".join(f"SELECT doc_id, '{d}' AS dimension, {d} AS value, count(*) AS n FROM classified GROUP BY doc_id, {d}" for d in ("nature", "category", "source"))
    return {
        "issue_classified": f"WITH {CLASSIFIED_SQL} SELECT issue_id, doc_id, category, subtype, confidence, nature, severity FROM classified",
        "issue_fingerprint": f"""WITH {ISSUES_SQL}, f AS (SELECT issue_id, doc_id, sha1(concat_ws('|', category, subtype, doc_id, block, start, "end")) AS fingerprint FROM issues)
          SELECT min(issue_id) AS issue_id, arg_min(doc_id, issue_id) AS doc_id, fingerprint FROM f GROUP BY fingerprint""",
        "rule_cap": f"WITH {ISSUES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule ORDER BY block, start, issue_id) AS place FROM issues) SELECT issue_id, doc_id, rule, CAST(place AS INT) AS place FROM p WHERE place <= greatest({least}, ceil(({per}) * doc_words / 1000))",
        "top_issues": f"""WITH {CLASSIFIED_SQL}, p AS (SELECT *, {PRIORITY} AS priority FROM classified),
          r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, block, start, issue_id) AS place, count(*) OVER (PARTITION BY doc_id) > {TOP} AS capped FROM p)
          SELECT issue_id, doc_id, CAST(priority AS INT) AS priority, CAST(place AS INT) AS place, capped FROM r WHERE place <= {TOP}""",
        "final_dedupe_greedy": f"""WITH {CLASSIFIED_SQL}, p AS (SELECT *, {PRIORITY} AS priority, {FAMILY} AS family FROM classified), {GREEDY_SQL} SELECT issue_id, doc_id FROM apart""",
        "block_dedupe_greedy": f"""WITH {ISSUES_SQL}, p AS (SELECT *, {_case('confidence', model.CONFIDENCE_RANK)} AS priority, {FAMILY} AS family FROM issues), {GREEDY_SQL} SELECT issue_id, doc_id FROM apart""",
        "issue_counts": f"""WITH {CLASSIFIED_SQL}, g AS ({dims}), d AS (SELECT DISTINCT doc_id FROM issues), f AS ({found})
          SELECT d.doc_id, g.dimension, g.value, coalesce(n, 0) AS n FROM d CROSS JOIN g LEFT JOIN f ON f.doc_id = d.doc_id AND f.dimension = g.dimension AND f.value = g.value""",
        "quality_score": f"WITH {CLASSIFIED_SQL}, {score_ctes()} SELECT * FROM scored",
    }
