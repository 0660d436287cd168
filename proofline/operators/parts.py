"""Documents of several parts: headers and footers once each, notes at the page and section of the block that calls them, one reading order over all, and pages.

Everything is by document: a self-join of notes with their callers on (doc_id, id), and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.functions.text import SPACE, word_count, word_sql
from proofline.operators.structure import WORDS_PER_PAGE, _section_ctes, sections, typed_blocks

# The least words of a page with a declared number of pages, and the words of a page that make such a number plausible.
LEAST_PER_PAGE, PLAUSIBLE = 150, (80, 900)
#: Parts in reading order; headers and footers stand mixed, as their parts come.
ORDER = {"body": 0, "footnote": 1, "endnote": 2, "header": 3, "footer": 3}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def pages(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """The page of every block (doc_id, ord, text, breaks_before, breaks_inside) and its document's number of pages.

    Breaks that a word processor has left tell pages by themselves. Without any, words do: those of a page follow from ``declared`` (doc_id, declared) where that is plausible.
    """
    w = Window.partitionBy("doc_id")
    before = w.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    counted = blocks.withColumn("n_words", word_count(F.col("text"))).join(declared, "doc_id", "left")
    inner = F.col("breaks_before") + F.col("breaks_inside")
    sums = {"words": F.sum("n_words").over(w), "breaks": F.sum(inner).over(w), "words_before": F.coalesce(F.sum("n_words").over(before), F.lit(0)), "breaks_passed": F.coalesce(F.sum(inner).over(before), F.lit(0)) + F.col("breaks_before")}
    rows = counted.withColumns(sums)
    per = F.col("words") / F.col("declared")
    known = F.when((F.col("declared") > 0) & per.between(*PLAUSIBLE), F.col("declared"))
    rows = rows.withColumn("known", known).withColumn("per_page", F.when(F.col("known").isNotNull(), F.greatest(F.lit(float(LEAST_PER_PAGE)), F.col("words") / F.col("known"))).otherwise(F.lit(float(WORDS_PER_PAGE))))
    rendered = F.col("breaks") > 0
    page = F.when(rendered, 1 + F.col("breaks_passed")).otherwise(F.floor(F.col("words_before") / F.col("per_page")) + 1)
    total = F.when(rendered, F.greatest(1 + F.col("breaks"), F.coalesce("known", F.lit(0)))).otherwise(F.coalesce("known", F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("per_page")))))
    return rows.select("doc_id", "ord", page.cast("int").alias("page"), total.cast("int").alias("n_pages"), F.when(rendered, "rendered_break").otherwise("word_count").alias("method"))


def reading_order(body: DataFrame, extras: DataFrame, paged: DataFrame) -> DataFrame:
    """One order over a document: doc_id, position, part, text, page, section, note_of.

    ``body`` has doc_id, ord, kind, level, text and ``calls``, the ids of the notes that it calls, as (part, id); if several blocks call a note the last one counts. ``extras`` are
    the paragraphs of other parts: doc_id, part, seq, note_id, text. Blank ones go, as do headers and footers whose text was there before in the same kind of part.
    """
    placed = sections(body).select("doc_id", "ord", "section").join(paged.select("doc_id", "ord", "page"), ["doc_id", "ord"])
    calls = body.select("doc_id", "ord", F.explode("calls").alias("c")).groupBy("doc_id", F.col("c.part").alias("part"), F.col("c.id").alias("note_id")).agg(F.max("ord").alias("note_of"))
    own = extras.withColumn("own", trimmed(F.col("text"))).where("own <> ''")
    again = F.row_number().over(Window.partitionBy("doc_id", "part", "own").orderBy("seq"))
    repeated = F.col("part").isin("header", "footer") & (F.col("again") > 1)
    kept = own.withColumn("again", again).where(~repeated)
    notes = kept.join(calls, ["doc_id", "part", "note_id"], "left").join(placed.withColumnRenamed("ord", "note_of"), ["doc_id", "note_of"], "left")
    columns = ["doc_id", "part", "seq", "text", "page", "section", "note_of"]
    main = body.join(placed, ["doc_id", "ord"]).select("doc_id", F.lit("body").alias("part"), F.col("ord").alias("seq"), "text", "page", "section", F.lit(None).cast("int").alias("note_of"))
    rank = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])[F.col("part")]
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "seq")) - 1
    return main.unionByName(notes.select(*columns)).select("doc_id", position.alias("position"), "part", "text", "page", "section", "note_of")


#: For both engines: parts and breaks of the documents by arithmetic; every fifth block calls a note, some notes twice and some never.
CALLED = "CASE WHEN ord % 5 = 2 THEN ord {div} 10 END"
EXTRA = {
    "part": "CASE WHEN ord % 10 = 7 THEN 'footnote' WHEN ord % 10 = 8 THEN 'endnote' WHEN ord % 4 = 0 THEN 'header' ELSE 'footer' END",
    "text": "CASE WHEN ord % 10 IN (7, 8) THEN concat('Note ', substring(text, 1, 30)) WHEN ord % 12 = 6 THEN '  ' ELSE concat(' En-tête ', (ord + doc_id) % 3, ' ') END",
}
EXTRA_ROWS = "ord % 10 IN (7, 8) OR ord % 2 = 0"
BREAKS = {"breaks_before": "CASE WHEN doc_id % 3 = 0 AND ord % 7 = 3 THEN 1 ELSE 0 END", "breaks_inside": "CASE WHEN doc_id % 3 = 0 AND ord % 11 = 5 THEN 2 ELSE 0 END"}
DECLARED = "CASE WHEN doc_id % 4 <> 1 THEN 1 + doc_id % 6 END"


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    typed = typed_blocks(spark, sf_dir)
    called = F.expr(CALLED.format(div="div")).cast("long")
    calls = F.when(called.isNotNull(), F.array(*[F.struct(F.lit(p).alias("part"), called.alias("id")) for p in ("footnote", "endnote")])).otherwise(F.array().cast("array<struct<part:string,id:bigint>>"))
    body = typed.withColumns({"calls": calls, **{c: F.expr(e) for c, e in BREAKS.items()}})
    extras = typed.where(EXTRA_ROWS).select("doc_id", F.expr(EXTRA["part"]).alias("part"), F.col("ord").alias("seq"), F.expr("ord div 10").cast("long").alias("note_id"), F.expr(EXTRA["text"]).alias("text"))
    declared = typed.select("doc_id").distinct().select("doc_id", F.expr(DECLARED).alias("declared"))
    return body, extras, pages(body, declared)


def queries() -> dict:
    return {"reading_order": lambda spark, sf: reading_order(*tables(spark, sf)), "page_methods": lambda spark, sf: tables(spark, sf)[2]}


def _page_ctes() -> str:
    """Pages from sums over all blocks up to each one, by joins instead of windows for the breaks."""
    return f"""{_section_ctes()}, pb AS (SELECT doc_id, ord, len(regexp_extract_all(text, '{word_sql()}')) AS n, {BREAKS["breaks_before"]} AS bb, {BREAKS["breaks_inside"]} AS bi FROM blocks),
    pd AS (SELECT doc_id, sum(n) AS words, sum(bb + bi) AS breaks, {DECLARED} AS declared FROM pb GROUP BY doc_id),
    pk AS (SELECT *, CASE WHEN declared > 0 AND words / declared BETWEEN {PLAUSIBLE[0]} AND {PLAUSIBLE[1]} THEN declared END AS known FROM pd),
    pp AS (SELECT *, CASE WHEN known IS NULL THEN {WORDS_PER_PAGE} ELSE greatest({LEAST_PER_PAGE}, words / known) END AS per FROM pk),
    pr AS (SELECT *, sum(n) OVER w - n AS wb, sum(bb + bi) OVER w - bi AS passed FROM pb WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    paged AS (SELECT doc_id, ord, CAST(CASE WHEN breaks > 0 THEN 1 + passed ELSE floor(wb / per) + 1 END AS INT) AS page, CAST(CASE WHEN breaks > 0 THEN greatest(1 + breaks, coalesce(known, 0)) ELSE coalesce(known, greatest(1, ceil(words / per))) END AS INT) AS n_pages,
      CASE WHEN breaks > 0 THEN 'rendered_break' ELSE 'word_count' END AS method FROM pr JOIN pp USING (doc_id))"""


def oracle_sql() -> dict[str, str]:
    return {
        "page_methods": f"WITH {_page_ctes()} SELECT * FROM paged",
        "reading_order": rf"""WITH {_page_ctes()}, x AS (SELECT doc_id, {EXTRA["part"]} AS part, ord AS seq, ord // 10 AS note_id, {EXTRA["text"]} AS text FROM blocks WHERE {EXTRA_ROWS}),
        y AS (SELECT * FROM x WHERE trim(text) <> '' AND NOT (part IN ('header', 'footer') AND EXISTS (SELECT 1 FROM x o WHERE o.doc_id = x.doc_id AND o.part = x.part AND trim(o.text) = trim(x.text) AND o.seq < x.seq))),
        called AS (SELECT doc_id, {CALLED.format(div="//")} AS id, max(ord) AS owner FROM blocks WHERE ord % 5 = 2 GROUP BY ALL),
        m AS (SELECT b.doc_id, 'body' AS part, b.ord AS seq, text, page, section, NULL AS note_of FROM blocks b JOIN sec USING (doc_id, ord) JOIN paged USING (doc_id, ord)
          UNION ALL SELECT y.doc_id, part, seq, y.text, page, section, owner FROM y LEFT JOIN called c ON c.doc_id = y.doc_id AND c.id = y.note_id AND part IN ('footnote', 'endnote') LEFT JOIN sec s ON s.doc_id = c.doc_id AND s.ord = c.owner LEFT JOIN paged p ON p.doc_id = c.doc_id AND p.ord = c.owner)
        SELECT doc_id, CAST(count(*) OVER (PARTITION BY doc_id ORDER BY CASE part WHEN 'body' THEN 0 WHEN 'footnote' THEN 1 WHEN 'endnote' THEN 2 ELSE 3 END, seq) - 1 AS INT) AS position, part, text, page, CAST(section AS INT) AS section, CAST(note_of AS INT) AS note_of FROM m""",
    }
