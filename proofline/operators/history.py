"""Queries on stored analyses: ownership, history, single decisions, guarded changes of state, warnings, exports and their rows to go.

Orders stand in for documents (their customers own them), line items for issues and exports, as in the other modules on stored rows. Every query is
a join, a window or a filter over whole tables; nothing is updated in place, each returns the rows as they are afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline import model
from proofline.operators.issues import CLASSIFIED_SQL, TOP, classified, issue_rows, top_issues
from proofline.sources import text as source

# Documents in a history, characters of a block that a list shows, and how long exports and documents live (days).
HISTORY, SHOWN, EXPORT_DAYS, DOCUMENT_DAYS = 100, 4000, 7, 30
NOW = "TIMESTAMP '1998-06-01 00:00:00'"
#: Names and sizes that an upload is refused for, in the order of the tests; for the browser's check before sending.
MOST_BYTES = 20 * 1024 * 1024


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def history(documents: DataFrame) -> DataFrame:
    """The newest documents of every owner; the limit is the feature."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    found = documents.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("document_id"), place.alias("place"))
    return found.where(F.col("place") <= HISTORY)


def owned(issues: DataFrame, documents: DataFrame, owners: DataFrame) -> DataFrame:
    """The issues whose document belongs to one of ``owners`` (c_custkey)."""
    mine = documents.join(owners, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return issues.join(mine, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


def expired_exports(exports: DataFrame, documents: DataFrame) -> DataFrame:
    """Exports that are too old themselves, or whose document is."""
    now = F.expr(NOW)
    found = exports.join(documents.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    own, other = F.col("l_shipdate") + F.expr(f"INTERVAL {EXPORT_DAYS} DAYS") < now, F.col("o_orderdate") + F.expr(f"INTERVAL {DOCUMENT_DAYS} DAYS") < now
    return found.where(own | F.coalesce(other, F.lit(False))).select("l_orderkey", "l_linenumber", F.when(own, "export").otherwise("document").alias("reason"))


def with_context(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """Listed issues with what the list shows of their block; only blocks that hold one are looked at."""
    wanted = issues.select("doc_id", F.col("block").alias("ord")).distinct()
    shown = blocks.join(wanted, ["doc_id", "ord"], "left_semi").select("doc_id", F.col("ord").alias("block"), F.substring("text", 1, SHOWN).alias("context"))
    return issues.join(shown, ["doc_id", "block"]).select("issue_id", "doc_id", "block", "context")


def allowed(decision: Column, nature: Column, user_text: Column) -> Column:
    """An own text is needed to edit, a suggestion to accept; only doubtful issues are marked as verified."""
    return (
        F.when(decision == "edited", F.length(F.trim(user_text)) > 0)
        .when(decision == "accepted", F.col("suggestion").isNotNull())
        .when(decision == "verified", nature.isin("potential", "verify"))
        .otherwise(decision.isin("ignored", "open"))
    )


def decided(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every issue after its last valid decision; invalid ones change nothing."""
    found = issues.join(decisions, "issue_id", "left").where(F.col("decision").isNotNull() & allowed(F.col("decision"), F.col("nature"), F.col("user_text")))
    last = found.groupBy("issue_id").agg(F.max_by("decision", "seq").alias("decision"))
    return issues.join(last, "issue_id", "left").select("issue_id", "doc_id", F.coalesce("decision", "status").alias("status"))


def decisions_of(issues: DataFrame) -> DataFrame:
    """Decisions derived from issues, by plain arithmetic: two for each second issue."""
    d = "element_at(array('accepted', 'edited', 'verified', 'ignored', 'nonsense'), cast((issue_id + seq) % 5 + 1 as int))"
    rows = issues.where("issue_id % 2 = 0").select("issue_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    return rows.select("issue_id", "seq", F.expr(d).alias("decision"), F.expr("case when issue_id % 3 = 0 then ' ' else 'text' end").alias("user_text"))


DECISIONS_SQL = """decisions AS (SELECT issue_id, seq, ['accepted', 'edited', 'verified', 'ignored', 'nonsense'][1 + (issue_id + seq) % 5] AS decision, CASE WHEN issue_id % 3 = 0 THEN ' ' ELSE 'text' END AS user_text
  FROM (SELECT issue_id, unnest([0, 1]) AS seq FROM issues WHERE issue_id % 2 = 0))"""


def recount(issues: DataFrame) -> DataFrame:
    """Reviewed issues of each document, of how many."""
    return issues.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "open").alias("reviewed"))


def exportable(issues: DataFrame) -> DataFrame:
    """What an export writes: accepted suggestions, and own texts."""
    text = F.when((F.col("status") == "accepted") & F.col("suggestion").isNotNull(), F.col("suggestion")).when((F.col("status") == "edited") & F.col("user_text").isNotNull(), F.col("user_text"))
    return issues.withColumn("replacement", text).where("replacement IS NOT NULL").select("issue_id", "doc_id", "replacement")


def pinned(issues: DataFrame) -> DataFrame:
    """The open issues of a document and its pinned one (the last), whatever its status, in document order."""
    last = F.max("issue_id").over(Window.partitionBy("doc_id"))
    kept = issues.withColumn("pin", F.col("issue_id") == last).where("status = 'open' OR pin")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "start", "issue_id"))
    return kept.select("issue_id", "doc_id", "pin", place.alias("place"))


def moved(table: DataFrame) -> DataFrame:
    """Analyses after a change of state that is only made while they are active."""
    return table.select("analysis_id", F.when(F.col("status").isin(model.TERMINAL), F.col("status")).otherwise(F.lit("CANCELED")).alias("status"), (~F.col("status").isin(model.TERMINAL)).alias("changed"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, model.STAGES))
    return orders(spark, sf_dir).select(F.col("o_orderkey").alias("analysis_id"), F.element_at(states, F.expr(f"cast(o_orderkey % {len(model.STAGES)} + 1 as int)")).alias("status"))


def warnings(issues: DataFrame) -> DataFrame:
    """A document's warnings with those of its issues added, each once, in order."""
    new = issues.groupBy("doc_id").agg(F.collect_set("rule").alias("new"), F.min("source").alias("old"))
    return new.select("doc_id", F.array_join(F.array_sort(F.array_union(F.array("old", F.lit("capped")), "new")), ",").alias("warnings"))


def left_out(issues: DataFrame, most: int) -> DataFrame:
    """The issues that a document's cap leaves out."""
    return issues.join(top_issues(issues, most).select("issue_id", "doc_id"), ["issue_id", "doc_id"], "left_anti").select("issue_id", "doc_id")


def refused(files: DataFrame) -> DataFrame:
    """Why a file isn't taken, from its name and size alone; null if it may be sent."""
    name = F.lower(F.trim("name"))
    reason = F.when(F.col("size") == 0, "empty").when(name.endswith(".doc"), "legacy").when(name.endswith(".docm"), "macros").when(~name.endswith(".docx"), "not_word").when(F.col("size") > MOST_BYTES, "too_large")
    return files.select("file_id", reason.alias("reason"))


FILES = {
    "name": "concat('Rapport ', CAST(page_id AS STRING), CASE page_id % 6 WHEN 0 THEN '.doc' WHEN 1 THEN '.DOCM' WHEN 2 THEN '.pdf' ELSE '.docx ' END)",
    "size": "CASE WHEN page_id % 13 = 0 THEN 0 WHEN page_id % 11 = 0 THEN length(html) + 20971520 ELSE length(html) END",
}


def repeated_notes(blocks: DataFrame) -> DataFrame:
    """Texts that several headers, footers or notes of a document share."""
    notes = blocks.where("kind = 'footnote'").groupBy("doc_id", F.trim("text").alias("text")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return notes.where("n > 1")


def common_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For both engines: documents whose notes are cut to their first words, so some repeat."""
    return source.blocks(spark, sf_dir).withColumns({"kind": F.expr(NOTE_KIND), "text": F.expr(NOTE_TEXT)})


NOTE_KIND, NOTE_TEXT = "CASE WHEN ord % 2 = 1 THEN 'footnote' ELSE 'paragraph' END", "CASE WHEN ord % 2 = 1 THEN substring(text, 1, 2) ELSE text END"


def word_diff(changes: DataFrame) -> DataFrame:
    """What differs between two texts, in whole words: what they share at the front and at the end, and what went and came between."""
    parts = lambda c: F.split(F.regexp_replace(c, r"(\s+)", "\x01$1\x01"), "\x01")
    a, b = F.col("a"), F.col("b")
    same = lambda x, y: F.coalesce(F.array_position(F.transform(F.sequence(F.lit(0), F.least(F.size(x), F.size(y))), lambda i: (F.get(x, i).eqNullSafe(F.get(y, i)) & (i < F.least(F.size(x), F.size(y)))).cast("int")), 0), F.lit(1)) - 1
    out = changes.withColumns({"a": parts(F.col("before")), "b": parts(F.col("after"))}).withColumn("front", same(a, b).cast("int"))
    rest = lambda c: F.reverse(F.slice(c, F.col("front") + 1, F.greatest(F.size(c) - F.col("front"), F.lit(0))))
    out = out.withColumn("back", same(rest(a), rest(b)).cast("int"))
    joined = lambda c, start, n: F.array_join(F.slice(c, start, F.greatest(n, F.lit(0))), "")
    middle = lambda c: joined(c, F.col("front") + 1, F.size(c) - F.col("front") - F.col("back"))
    return out.select(
        "doc_id", "ord",
        F.length(joined(a, F.lit(1), F.col("front"))).alias("prefix"), middle(a).alias("removed"), middle(b).alias("added"), F.length(joined(F.reverse(a), F.lit(1), F.col("back"))).alias("suffix"),
    )


CHANGED = "CASE WHEN ord % 3 = 0 THEN replace(text, 'a', 'e') WHEN ord % 3 = 1 THEN concat(text, ' fin') ELSE text END"


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.blocks(spark, sf_dir).select("doc_id", "ord", F.col("text").alias("before"), F.expr(CHANGED).alias("after"))


def queries() -> dict:
    items = lambda spark, sf: spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = lambda spark, sf: classified(issue_rows(spark, sf))
    edited = lambda spark, sf: rows(spark, sf).withColumn("user_text", F.expr("case when issue_id % 4 = 0 then concat('t', block) end"))
    return {
        "history": lambda spark, sf: history(orders(spark, sf)),
        "owned_issues": lambda spark, sf: owned(items(spark, sf), orders(spark, sf), spark.read.parquet(f"{sf}/customer.parquet").where("c_nationkey = 3")),
        "expired_exports": lambda spark, sf: expired_exports(items(spark, sf), orders(spark, sf)),
        "listed_context": lambda spark, sf: with_context(rows(spark, sf).where("status = 'open' AND category = 'spelling'"), source.blocks(spark, sf)),
        "decided": lambda spark, sf: decided(rows(spark, sf), decisions_of(rows(spark, sf))),
        "decided_recount": lambda spark, sf: recount(decided(rows(spark, sf), decisions_of(rows(spark, sf)))),
        "exportable": lambda spark, sf: exportable(edited(spark, sf)),
        "pinned_list": lambda spark, sf: pinned(rows(spark, sf)),
        "guarded_state": lambda spark, sf: moved(analyses(spark, sf)),
        "warnings_union": lambda spark, sf: warnings(rows(spark, sf)),
        "beyond_cap": lambda spark, sf: left_out(issue_rows(spark, sf), TOP),
        "refused_files": lambda spark, sf: refused(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("file_id"), *[F.expr(e).alias(c) for c, e in FILES.items()])),
        "repeated_notes": lambda spark, sf: repeated_notes(common_blocks(spark, sf)),
        "word_diff": lambda spark, sf: word_diff(changed(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    states, ended = ", ".join(f"'{s}'" for s in model.STAGES), ", ".join(f"'{s}'" for s in model.TERMINAL)
    valid = """CASE decision WHEN 'edited' THEN trim(user_text) <> '' WHEN 'accepted' THEN suggestion IS NOT NULL WHEN 'verified' THEN nature IN ('potential', 'verify') ELSE decision IN ('ignored', 'open') END"""
    after = f"""{CLASSIFIED_SQL}, {DECISIONS_SQL}, v AS (SELECT issue_id, arg_max(decision, seq) AS decision FROM decisions JOIN classified USING (issue_id) WHERE {valid} GROUP BY issue_id),
      done AS (SELECT issue_id, doc_id, coalesce(decision, status) AS status FROM classified LEFT JOIN v USING (issue_id))"""
    tokens = lambda c: f"list_filter(list_concat([''], flatten(list_transform(regexp_extract_all({c}, '\\s+|\\S+'), lambda x: [x]))), lambda x: x <> '')"
    return {
        "history": f"SELECT o_custkey AS owner, o_orderkey AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS place FROM orders QUALIFY place <= {HISTORY}",
        "owned_issues": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)",
        "expired_exports": f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate + INTERVAL {EXPORT_DAYS} DAY < {NOW} THEN 'export' ELSE 'document' END AS reason FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
          WHERE (l_shipdate + INTERVAL {EXPORT_DAYS} DAY < {NOW} OR coalesce(o_orderdate + INTERVAL {DOCUMENT_DAYS} DAY < {NOW}, false))""",
        "listed_context": f"WITH {CLASSIFIED_SQL}, {source.SQL} SELECT issue_id, c.doc_id, c.block, substring(b.text, 1, {SHOWN}) AS context FROM classified c JOIN blocks b ON b.doc_id = c.doc_id AND b.ord = c.block WHERE status = 'open' AND category = 'spelling'",
        "decided": f"WITH {after} SELECT * FROM done",
        "decided_recount": f"WITH {after} SELECT doc_id, count(*) AS total, count(*) FILTER (status <> 'open') AS reviewed FROM done GROUP BY doc_id",
        "exportable": f"""WITH {CLASSIFIED_SQL}, u AS (SELECT *, CASE WHEN issue_id % 4 = 0 THEN 't' || block END AS user_text FROM classified)
          SELECT issue_id, doc_id, CASE status WHEN 'accepted' THEN suggestion ELSE user_text END AS replacement FROM u WHERE (status = 'accepted' AND suggestion IS NOT NULL) OR (status = 'edited' AND user_text IS NOT NULL)""",
        "pinned_list": f"""WITH {CLASSIFIED_SQL}, m AS (SELECT doc_id, max(issue_id) AS last FROM classified GROUP BY doc_id), k AS (SELECT c.*, issue_id = last AS pin FROM classified c JOIN m USING (doc_id) WHERE status = 'open' OR issue_id = last)
          SELECT issue_id, doc_id, pin, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, start, issue_id) AS INT) AS place FROM k""",
        "guarded_state": f"WITH a AS (SELECT o_orderkey AS analysis_id, [{states}][1 + o_orderkey % {len(model.STAGES)}] AS status FROM orders) SELECT analysis_id, CASE WHEN status IN ({ended}) THEN status ELSE 'CANCELED' END AS status, status NOT IN ({ended}) AS changed FROM a",
        "warnings_union": f"""WITH {CLASSIFIED_SQL}, w AS (SELECT doc_id, rule AS w FROM classified UNION SELECT doc_id, min(source) FROM classified GROUP BY doc_id UNION SELECT doc_id, 'capped' FROM classified)
          SELECT doc_id, string_agg(w, ',' ORDER BY w) AS warnings FROM w GROUP BY doc_id""",
        "beyond_cap": f"""WITH {CLASSIFIED_SQL}, r AS (SELECT issue_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {_priority_sql()} DESC, block, start, issue_id) AS place FROM classified) SELECT issue_id, doc_id FROM r WHERE place > {TOP}""",
        "refused_files": f"""WITH f AS (SELECT page_id AS file_id, lower(trim({FILES['name'].replace('AS STRING', 'AS VARCHAR')})) AS name, {FILES['size']} AS size FROM pages)
          SELECT file_id, CASE WHEN size = 0 THEN 'empty' WHEN suffix(name, '.doc') THEN 'legacy' WHEN suffix(name, '.docm') THEN 'macros' WHEN NOT suffix(name, '.docx') THEN 'not_word' WHEN size > {MOST_BYTES} THEN 'too_large' END AS reason FROM f""",
        "repeated_notes": source_notes_sql(),
        "word_diff": f"""WITH {source.SQL}, c AS (SELECT doc_id, ord, {tokens('text')} AS a, {tokens(CHANGED)} AS b FROM blocks),
          f AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false), least(len(a), len(b)) + 1) - 1 AS front FROM c),
          g AS (SELECT *, least(len(a), len(b)) - front AS most FROM f), h AS (SELECT *, coalesce(list_position(list_transform(range(0, most), lambda i: a[len(a) - i] = b[len(b) - i]), false), most + 1) - 1 AS back FROM g)
          SELECT doc_id, ord, CAST(length(array_to_string(a[1:front], '')) AS INT) AS prefix, array_to_string(a[front + 1:len(a) - back], '') AS removed, array_to_string(b[front + 1:len(b) - back], '') AS added,
            CAST(length(array_to_string(a[len(a) - back + 1:], '')) AS INT) AS suffix FROM h""",
    }


def _priority_sql() -> str:
    case = lambda column, ranks: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " END"
    return f"{case('nature', model.NATURE_RANK)} * 1000 + {case('confidence', model.CONFIDENCE_RANK)} * 100 + {case('severity', model.SEVERITY_RANK)} * 10 + {case('source', model.SOURCE_RANK)}"


def source_notes_sql() -> str:
    return f"WITH {source.SQL}, t AS (SELECT doc_id, ord, {NOTE_KIND} AS kind, {NOTE_TEXT} AS text FROM blocks) SELECT doc_id, trim(text) AS text, count(*) AS n, min(ord) AS first_ord FROM t WHERE kind = 'footnote' GROUP BY doc_id, trim(text) HAVING count(*) > 1"
