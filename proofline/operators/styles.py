"""Roles of paragraph styles: each style says what it is by its name or outline level, or is what the style is that it is based on.

Chains of styles are followed by pointer jumping: in every round each open style looks at the one it points to, takes its role or else its pointer, so a
round doubles how far a style has looked. A chain that comes back to itself never ends; after as many rounds as the longest possible chain needs, what is open is normal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.plans.rounds import settled

# Names by which styles are known, and the first outline level that means body text.
HEADING, TITLE = r"(?i)^(?:heading|titre)\s*(\d)$", r"(?i)^(?:title|titre)$"
TOC, TOC_ID, CAPTION = r"(?i)^(?:toc\s*\d|tm\s*\d|toc heading|en-tête de table des matières)$", r"(?i)^TOC\d|^TM\d", r"(?i)^(?:caption|légende)$"
BODY_LEVEL = 9


def own_role(style: Column, name: Column, outline: Column) -> Column:
    """What a style says of itself: (role, level, source), null if nothing."""
    called = F.coalesce(name, style)
    number = F.coalesce(*[F.when(x.rlike(HEADING), F.regexp_extract(x, HEADING, 1).cast("int")) for x in (called, style)])
    role = lambda r, level=None, source=None: F.struct(F.lit(r).alias("role"), (level if level is not None else F.lit(None)).cast("int").alias("level"), F.lit(source).cast("string").alias("source"))
    return (
        F.when(number.isNotNull(), role("heading", number, "style")).when(called.rlike(TITLE), role("title", F.lit(1), "style")).when(called.rlike(TOC) | style.rlike(TOC_ID), role("toc"))
        .when(called.rlike(CAPTION), role("caption")).when(outline < BODY_LEVEL, role("heading", outline + 1, "outline"))
    )


def roles(styles: DataFrame) -> DataFrame:
    """doc_id, style, role, level, source of every style (doc_id, style, name, based_on, outline). Styles that others name but nobody defines are judged by their id."""
    named = styles.select("doc_id", F.col("based_on").alias("style")).where("style IS NOT NULL").join(styles.select("doc_id", "style"), ["doc_id", "style"], "left_anti").distinct()
    missing = named.select("doc_id", "style", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("based_on"), F.lit(None).cast("int").alias("outline"), F.lit(False).alias("defined"))
    every = styles.select("doc_id", "style", "name", "based_on", "outline", F.lit(True).alias("defined")).union(missing)
    found = own_role(F.col("style"), F.col("name"), F.col("outline"))
    nodes = settled(every.select("doc_id", "style", "defined", found.alias("found"), F.when(found.isNull(), F.col("based_on")).alias("next")))
    longest = nodes.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(longest)) + 1):
        ahead = nodes.select("doc_id", F.col("style").alias("next"), F.col("found").alias("theirs"), F.col("next").alias("beyond"))
        open_ones = nodes.where("next IS NOT NULL").drop("found").join(ahead, ["doc_id", "next"])
        moved = open_ones.select("doc_id", "style", "defined", F.col("theirs").alias("found"), F.when(F.col("theirs").isNull(), F.col("beyond")).alias("next"))
        nodes = settled(nodes.where("next IS NULL").union(moved))
        if nodes.where("next IS NOT NULL").isEmpty():
            break
    return nodes.where("defined").select("doc_id", "style", F.coalesce("found.role", F.lit("normal")).alias("role"), "found.level", "found.source")


#: For both engines: sixteen styles of every document, mostly based on the next one, with names, outline levels, ends, unknown bases and circles by arithmetic.
PER_DOC = 16
STYLE = {
    "name": "CASE (doc_id * 7 + k * 3) % 41 WHEN 0 THEN concat('heading ', 1 + k % 4) WHEN 1 THEN 'Titre' WHEN 2 THEN 'TOC Heading' WHEN 3 THEN 'Légende' WHEN 4 THEN 'Titre 3' WHEN 5 THEN NULL ELSE concat('Corps ', k) END",
    "based_on": f"CASE WHEN (doc_id + k) % 29 = 0 THEN NULL WHEN (doc_id + k * 3) % 31 = 0 THEN 'Heading2' WHEN (doc_id + k) % 37 = 0 THEN 'unknown' WHEN k = {PER_DOC - 1} THEN 's0' ELSE concat('s', k + 1) END",
    "outline": "CASE WHEN (doc_id + k * 5) % 43 = 0 THEN k % 11 END",
}


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(PER_DOC - 1))).alias("k"))
    return docs.select("doc_id", F.concat(F.lit("s"), F.col("k")).alias("style"), *[F.expr(e).alias(c) for c, e in STYLE.items()])


def queries() -> dict:
    return {"style_roles": lambda spark, sf: roles(styles(spark, sf))}


def oracle_sql() -> dict[str, str]:
    """Every style walked up its chain, with the styles on the way as guard."""
    heading = HEADING.replace("(?i)", "")
    plain = lambda p: p.replace("(?i)", "")
    return {
        "style_roles": f"""WITH RECURSIVE st AS (SELECT doc_id, 's' || k AS style, {STYLE["name"]} AS name, {STYLE["based_on"]} AS based_on, {STYLE["outline"]} AS outline FROM documents, range({PER_DOC}) AS r(k)),
        walk AS (SELECT doc_id, style AS origin, style AS cur, [style] AS seen FROM st
          UNION ALL SELECT w.doc_id, origin, s.based_on, list_append(seen, s.based_on) FROM walk w JOIN st s ON s.doc_id = w.doc_id AND s.style = w.cur WHERE s.based_on IS NOT NULL AND NOT list_contains(seen, s.based_on)),
        told AS (SELECT w.doc_id, origin, len(seen) AS far, cur, lower(coalesce(name, cur)) AS name, outline FROM walk w LEFT JOIN st s ON s.doc_id = w.doc_id AND s.style = w.cur),
        judged AS (SELECT *, CASE WHEN regexp_matches(name, '{heading}') THEN 'heading/' || right(name, 1) || '/style' WHEN regexp_matches(lower(cur), '{heading}') THEN 'heading/' || right(cur, 1) || '/style' WHEN regexp_matches(name, '{plain(TITLE)}') THEN 'title/1/style'
          WHEN regexp_matches(name, '{plain(TOC)}') OR regexp_matches(lower(cur), '^toc\\d|^tm\\d') THEN 'toc//' WHEN regexp_matches(name, '{plain(CAPTION)}') THEN 'caption//' WHEN outline < {BODY_LEVEL} THEN 'heading/' || (outline + 1) || '/outline' END AS verdict FROM told),
        best AS (SELECT doc_id, origin, arg_min(verdict, far) FILTER (verdict IS NOT NULL) AS v FROM judged GROUP BY doc_id, origin)
        SELECT doc_id, origin AS style, coalesce(split_part(v, '/', 1), 'normal') AS role, TRY_CAST(split_part(v, '/', 2) AS INT) AS level, nullif(split_part(v, '/', 3), '') AS source FROM best""",
    }
