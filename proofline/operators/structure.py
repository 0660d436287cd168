"""Rules and measures on whole documents: acronyms, spellings, numbering, tables of contents, pages, sections, language."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.functions.text import every, matches, word_count, word_sql
from proofline.sources import text as source

# Acronyms so common that nobody defines them.
COMMON_ACRONYMS = (
    "PDF URL HTML CSS SQL API USB PC TV OK CV PME SA SAS SARL UE ONU IT IA AI FAQ PIB TVA HT TTC RH DG CEO GPS WIFI ID NB PS ETC OS CPU RAM IP HTTP HTTPS XML JSON"
).split()
# French words by whose share a text is taken for French.
FRENCH_STOPWORDS = "le la les de des du et en un une est pour que qui dans au aux sur par avec ce cette ces il elle nous sont pas plus ont été ou mais son sa ses leur leurs".split()
MIN_FRENCH_WORDS, FRENCH_SHARE, LANGUAGE_BLOCKS = 30, 0.12, 400
ACRONYM_CAP, VARIANT_CAP, NUMBERING_CAP, TOC_CAP = 5, 8, 10, 5
WORDS_PER_PAGE = 400
ROMAN = "^[IVXLCDM]+$"
HEADING_NUMBER = r"^\s*(\d+(?:\.\d+)*)\.?\s+\S"
PAGE_NUMBER = r"[\t.…\s]+\d+\s*$"
VARIANT_WORD = r"\p{L}+(?:-\p{L}+)+|\p{L}{4,}"
TOC_TITLES = ("table des matières", "sommaire")


def strings(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


#: A heading of this kind means that the document explains its acronyms.
GLOSSARY = r"(?i)sigles|acronymes|abr[ée]viations|glossaire"
ACRONYM = r"(?<![\p{L}\p{N}])\p{Lu}{2,6}(?=s?(?![\p{L}\p{N}]))"


def undefined_acronym(blocks: DataFrame) -> DataFrame:
    """Capitals used twice or more in a document and defined nowhere in it, in the order in which they first occur.

    Headings don't count as uses, entries of a table of contents count for nothing, and documents with a glossary give none. A definition is an acronym in
    brackets, or in front of a bracket or colon; definitions are gathered by document, so no text is joined.
    """
    body = blocks.where("kind <> 'toc_entry'")
    explained = body.where((F.col("kind") == "heading") & F.col("text").rlike(GLOSSARY)).select("doc_id").distinct()
    uses = body.where((F.col("kind") != "heading") & F.col("text").rlike(ACRONYM)).select("doc_id", "ord", F.explode(matches(F.col("text"), ACRONYM)).alias("m"))
    uses = uses.select("doc_id", "ord", "m.start", F.col("m.text").alias("acronym")).where(~F.col("acronym").isin(COMMON_ACRONYMS) & ~F.col("acronym").rlike(ROMAN))
    counted = uses.groupBy("doc_id", "acronym").agg(F.count("*").alias("n"), F.min(F.struct("ord", "start")).alias("first")).where("n >= 2")
    counted = counted.join(explained, "doc_id", "left_anti")
    named = F.array_union(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]*\p{Lu}{2})\s*[(:]"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"\(\s*(\p{Lu}{2,6})\s*\)"), F.lit(1)))
    defined = body.where(F.col("text").rlike(r"\p{Lu}{2}\s*[(:)]")).select("doc_id", F.explode(named).alias("definition")).distinct()
    open_ones = counted.join(defined, (counted["doc_id"] == defined["doc_id"]) & F.endswith("definition", "acronym"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("first.ord", "first.start", "acronym"))
    return open_ones.withColumn("rank", rank).where(F.col("rank") <= ACRONYM_CAP).select("doc_id", "acronym", "n", F.col("first.ord").alias("ord"), F.col("first.start").alias("start"), "rank")


def _acronym_sql(blocks: str) -> str:
    return rf"""WITH {blocks}, b AS (SELECT * FROM blocks WHERE kind <> 'toc_entry'),
    c AS (SELECT doc_id, ord, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (SELECT doc_id, ord, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS p FROM b WHERE kind <> 'heading')),
    s AS (SELECT doc_id, ord, part, CAST(coalesce(sum(length(part)) OVER (PARTITION BY doc_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM c),
    a AS (SELECT doc_id, ord, start, regexp_extract(part, '^(\p{{Lu}}{{2,6}})s?$', 1) AS acronym FROM s),
    k AS (SELECT doc_id, acronym, count(*) AS n, min(ord * 1000000 + start) AS f FROM a WHERE acronym <> '' AND acronym NOT IN ({strings(COMMON_ACRONYMS)}) AND NOT regexp_matches(acronym, '{ROMAN}') GROUP BY ALL HAVING count(*) >= 2),
    o AS (SELECT * FROM k WHERE doc_id NOT IN (SELECT doc_id FROM b WHERE kind = 'heading' AND regexp_matches(lower(text), 'sigles|acronymes|abréviations|abreviations|glossaire'))
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = k.doc_id AND regexp_matches(b.text, '\(\s*' || acronym || '\s*\)|' || acronym || '\s*[(:]'))),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, acronym) AS rank FROM o)
    SELECT doc_id, acronym, n, CAST(f // 1000000 AS INT) AS ord, CAST(f % 1000000 AS INT) AS start, CAST(rank AS INT) AS rank FROM r WHERE rank <= {ACRONYM_CAP}"""


def terminology_variant(blocks: DataFrame) -> DataFrame:
    """Words that a document writes both with and without hyphens: the rarer form, and the usual one."""
    words = blocks.select("doc_id", "ord", F.posexplode(every(F.col("text"), VARIANT_WORD)).alias("i", "word"))
    forms = words.groupBy("doc_id", F.lower("word").alias("form")).agg(F.count("*").alias("n"), F.min(F.struct("ord", "i", "word")).alias("first"))
    forms = forms.withColumn("key", F.replace("form", F.lit("-"), F.lit("")))
    w = Window.partitionBy("doc_id", "key")
    order = w.orderBy(F.desc("n"), "first.ord", "first.i")
    ranked = forms.withColumns({"forms": F.count("*").over(w), "place": F.row_number().over(order), "usual": F.first("form").over(order)})
    second = ranked.where("forms >= 2 AND place = 2")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("first.ord", "first.i"))
    return second.withColumn("rank", rank).where(F.col("rank") <= VARIANT_CAP).select("doc_id", "key", F.col("first.word").alias("original"), F.col("usual").alias("suggestion"), "n", F.col("first.ord").alias("ord"))


def _variant_sql(blocks: str) -> str:
    return rf"""WITH {blocks},
    w AS (SELECT doc_id, ord, generate_subscripts(p, 1) AS i, unnest(p) AS word FROM (SELECT doc_id, ord, regexp_extract_all(text, '{VARIANT_WORD}') AS p FROM blocks)),
    f AS (SELECT doc_id, lower(word) AS form, replace(lower(word), '-', '') AS key, count(*) AS n, min(ord * 1000000 + i) AS f, arg_min(word, ord * 1000000 + i) AS word FROM w GROUP BY doc_id, lower(word)),
    r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS forms, row_number() OVER o AS place, first_value(form) OVER o AS usual FROM f WINDOW o AS (PARTITION BY doc_id, key ORDER BY n DESC, f)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS rank FROM r WHERE forms >= 2 AND place = 2)
    SELECT doc_id, key, word AS original, usual AS suggestion, n, CAST(f // 1000000 AS INT) AS ord FROM k WHERE rank <= {VARIANT_CAP}"""


#: For both engines: documents as typed blocks, by plain arithmetic on the place of a line, as the driver's texts have no headings, lists or tables of
#: contents. Headings are numbered with gaps; entries of a table of contents repeat a heading of the document or name one it lacks.
TYPED = {
    "kind": "CASE WHEN ord % 6 = 0 THEN 'heading' WHEN ord % 6 = 1 AND ord < 30 THEN 'toc_entry' WHEN ord % 6 = 4 THEN 'list_item' WHEN ord % 12 = 5 THEN 'table_cell' WHEN ord % 12 = 11 THEN 'footnote' ELSE 'paragraph' END",
    "level": "CASE WHEN ord % 6 = 0 THEN CAST(1 + (ord / 6 + doc_id) % 3 + CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0 END AS INT) END",
    "title": "concat('Partie ', CAST(CASE WHEN ord % 6 = 0 THEN ord ELSE ord - 1 + 12 * ((doc_id + ord) % 3) END AS INT))",
}
NUMBERS = ["1 + ord / 54", "1 + (ord / 18) % 3", "1 + (ord / 6) % 4", "1", "1", "2 + (ord / 6) % 5", "1", "3 + ord / 30"]


def typed_columns(whole: str) -> tuple[str, str, str]:
    """kind, level and text; ``whole`` writes a whole-number division ``{a} / {b}`` in the engine's way."""
    exact = lambda text: re.sub(r"\(?ord / (\d+)", lambda m: m[0].replace(f"ord / {m[1]}", whole.format(m[1])), text)
    level = exact(TYPED["level"])
    number = "concat_ws('.', " + ", ".join(f"CASE WHEN level > {k} THEN CAST(CAST({exact(n)} AS INT) AS STRING) END" for k, n in enumerate(NUMBERS)) + ")"
    text = f"CASE kind WHEN 'heading' THEN concat({number}, ' ', title, CASE WHEN doc_id % 11 = 3 AND ord = 6 THEN ' Glossaire' ELSE '' END) WHEN 'toc_entry' THEN concat(title, ' .... ', CAST(ord AS STRING)) ELSE text END"
    return TYPED["kind"], level, text


def typed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, kind, level (of headings) and text."""
    kind, level, text = typed_columns("ord div {}")
    out = source.blocks(spark, sf_dir).withColumns({"kind": F.expr(kind), "level": F.expr(level), "title": F.expr(TYPED["title"])})
    return out.withColumn("text", F.when(F.col("kind").isin("heading", "toc_entry"), F.concat(F.lit(""), F.expr(text))).otherwise(F.col("text"))).select("doc_id", "ord", "kind", "level", "text")


def typed_sql() -> str:
    kind, level, text = typed_columns("ord // {}")
    return source.SQL.replace("blocks AS", "plain AS") + f""", kinds AS (SELECT *, {kind} AS kind, {level} AS level, {TYPED["title"]} AS title FROM plain),
    blocks AS (SELECT doc_id, ord, kind, level, {text} AS text FROM kinds)"""


GAP = "array<struct<ord:int,number:string,previous:string,expected:int>>"


def numbering(blocks: DataFrame) -> DataFrame:
    """Numbered headings with what their number is compared with: doc_id, ord, number, previous and expected (null where nothing is).

    The last number of every depth is kept in an array while a document's headings are gone through in order; a shallower heading
    cuts off the deeper ones. Only headings take part, of any depth.
    """
    heads = blocks.where("kind = 'heading'").withColumn("number", F.regexp_extract("text", HEADING_NUMBER, 1)).where("number <> ''")
    heads = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "number"))).alias("heads"))
    none = F.lit(None).cast("string")
    zero = F.struct(F.array().cast("array<string>").alias("last"), F.array().cast(GAP).alias("out"))
    parent = lambda x: F.regexp_extract(x, r"^(.*)\.\d+$", 1)
    final = lambda x: F.regexp_extract(x, r"(\d+)$", 1).cast("int")

    def step(a: Column, x: Column) -> Column:
        depth = F.size(F.split(x["number"], r"\."))
        before = F.get(a["last"], depth - 1)
        follows = before.isNotNull() & (parent(before) == parent(x["number"]))
        row = F.struct(x["ord"].alias("ord"), x["number"].alias("number"), F.when(follows, before).alias("previous"), F.when(follows, final(before) + 1).alias("expected"))
        kept = F.slice(F.concat(a["last"], F.array_repeat(none, depth)), F.lit(1), depth - 1)
        return F.struct(F.concat(kept, F.array(x["number"])).alias("last"), F.concat(a["out"], F.array(row)).alias("out"))

    rows = F.aggregate("heads", zero, step, lambda a: a["out"])
    return heads.select("doc_id", F.explode(rows).alias("h")).select("doc_id", "h.*")


def heading_gap(blocks: DataFrame) -> DataFrame:
    """Numbered headings that don't follow the last one of their depth under the same parent, the first ten of a document."""
    gaps = numbering(blocks).where(F.regexp_extract("number", r"(\d+)$", 1).cast("int") != F.col("expected"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return gaps.withColumn("rank", rank).where(F.col("rank") <= NUMBERING_CAP).select("doc_id", "ord", "number", "previous", "expected")


def _numbering_ctes() -> str:
    return rf"""{typed_sql()},
    h AS (SELECT doc_id, ord, regexp_extract(text, '{HEADING_NUMBER}', 1) AS number FROM blocks WHERE kind = 'heading'),
    n AS (SELECT *, len(string_split(number, '.')) AS depth, regexp_extract(number, '^(.*)\.\d+$', 1) AS parent, CAST(regexp_extract(number, '(\d+)$', 1) AS INT) AS last FROM h WHERE number <> ''),
    j AS (SELECT a.doc_id, a.ord, max(b.ord) AS before FROM n a LEFT JOIN n b ON a.doc_id = b.doc_id AND b.ord < a.ord AND b.depth = a.depth GROUP BY a.doc_id, a.ord),
    cmp AS (SELECT a.doc_id, a.ord, a.number, a.last, CASE WHEN b.parent = a.parent AND NOT EXISTS (SELECT 1 FROM n c WHERE c.doc_id = a.doc_id AND c.ord > b.ord AND c.ord < a.ord AND c.depth < a.depth) THEN b.number END AS previous, b.last AS pl
      FROM n a JOIN j USING (doc_id, ord) LEFT JOIN n b ON b.doc_id = a.doc_id AND b.ord = j.before)"""


def _heading_sql() -> str:
    return f"""WITH {_numbering_ctes()}, g AS (SELECT doc_id, ord, number, previous, CAST(pl + 1 AS INT) AS expected FROM cmp WHERE previous IS NOT NULL AND last <> pl + 1)
    SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= {NUMBERING_CAP}"""


def structure_summary(blocks: DataFrame) -> DataFrame:
    """Per document: headings, numbered ones, those compared with another, entries of the table of contents, and comparable ones."""
    title = normal_title(F.col("text"))
    count = lambda c: F.count(F.when(c, 1))
    heading, entry = F.col("kind") == "heading", F.col("kind") == "toc_entry"
    summed = blocks.groupBy("doc_id").agg(
        count(heading).alias("headings"),
        count(heading & F.col("text").rlike(HEADING_NUMBER)).alias("numbered"),
        count(entry).alias("toc_entries"),
        count(entry & (F.length(title) >= 3) & ~title.isin(*TOC_TITLES)).alias("comparable_entries"),
    )
    compared = numbering(blocks).where("expected IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("compared"))
    return summed.join(compared, "doc_id", "left").withColumn("compared", F.coalesce("compared", F.lit(0)))


def normal_title(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, PAGE_NUMBER, ""), r"\s+", " ")))


def toc_mismatch(blocks: DataFrame) -> DataFrame:
    """Entries of a table of contents that are no heading, nor the beginning of one or the other way round.

    The comparison is an anti join on doc_id with the prefix test on top, so each document is compared by itself.
    """
    titles = blocks.withColumn("title", normal_title(F.col("text")))
    heads = titles.where("kind = 'heading'").select("doc_id", F.col("title").alias("head"))
    entries = titles.where("kind = 'toc_entry'").where((F.length("title") >= 3) & ~F.col("title").isin(*TOC_TITLES))
    entries = entries.join(heads.select("doc_id").distinct(), "doc_id", "left_semi")
    alike = (entries["doc_id"] == heads["doc_id"]) & (F.col("head").startswith(F.col("title")) | F.col("title").startswith(F.col("head")))
    missing = entries.join(heads, alike, "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return missing.withColumn("rank", rank).where(F.col("rank") <= TOC_CAP).select("doc_id", "ord", F.trim(F.regexp_replace("text", PAGE_NUMBER, "")).alias("original"))


def _toc_sql() -> str:
    title = f"lower(trim(regexp_replace(regexp_replace(text, '{PAGE_NUMBER}', ''), '\\s+', ' ', 'g')))"
    return rf"""WITH {typed_sql()}, t AS (SELECT *, {title} AS title FROM blocks), h AS (SELECT doc_id, title AS head FROM t WHERE kind = 'heading')
    SELECT doc_id, ord, trim(regexp_replace(text, '{PAGE_NUMBER}', '')) AS original FROM t WHERE kind = 'toc_entry' AND length(title) >= 3 AND title NOT IN ('table des matières', 'sommaire')
      AND doc_id IN (SELECT doc_id FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = t.doc_id AND (starts_with(head, title) OR starts_with(title, head)))
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= {TOC_CAP}"""


BEFORE_ALL = "Début du document"


def section_heads(blocks: DataFrame) -> DataFrame:
    """Headings with their section's path, outermost title first, and the headings it stands under, itself last: doc_id, section (its ord), level, path, parents.

    The headings still open are a stack: a new one closes those of its level and deeper. Only a document's headings are gone through, at any depth.
    """
    heads = blocks.where("kind = 'heading'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "level", F.trim("text").alias("title")))).alias("heads"))
    zero = F.struct(F.array().cast("array<struct<level:int,title:string,ord:int>>").alias("open"), F.array().cast("array<struct<ord:int,level:int,path:string,parents:array<int>>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        stack = F.concat(F.filter(a["open"], lambda o: o["level"] < x["level"]), F.array(F.struct(x["level"].alias("level"), x["title"].alias("title"), x["ord"].alias("ord"))))
        row = F.struct(x["ord"].alias("ord"), x["level"].alias("level"), F.array_join(F.transform(stack, lambda o: o["title"]), " > ").alias("path"), F.transform(stack, lambda o: o["ord"]).alias("parents"))
        return F.struct(stack.alias("open"), F.concat(a["out"], F.array(row)).alias("out"))

    rows = heads.select("doc_id", F.explode(F.aggregate("heads", zero, step, lambda a: a["out"])).alias("h"))
    return rows.select("doc_id", F.col("h.ord").alias("section"), "h.level", "h.path", "h.parents")


def sections(blocks: DataFrame) -> DataFrame:
    """Every block's section (the ord of its heading, -1 before the first), path, and paragraph number in it (headings have none)."""
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("ord")), True).over(order), F.lit(-1))
    placed = blocks.withColumn("section", own).join(section_heads(blocks).select("doc_id", "section", "path"), ["doc_id", "section"], "left")
    other = F.col("kind") != "heading"
    place = F.sum(other.cast("int")).over(Window.partitionBy("doc_id", "section").orderBy("ord"))
    return placed.select("doc_id", "ord", "section", F.coalesce("path", F.lit(BEFORE_ALL)).alias("path"), F.when(other, place).cast("int").alias("paragraph"))


def section_tree(blocks: DataFrame) -> DataFrame:
    """The sections in preorder with their words: own ones, and those of all sections below rolled up."""
    words = sections(blocks).select("doc_id", "ord", "section").join(blocks.select("doc_id", "ord", word_count(F.col("text")).alias("n")), ["doc_id", "ord"])
    own = words.groupBy("doc_id", "section").agg(F.sum("n").alias("own_words"))
    heads = section_heads(blocks)
    up = heads.select("doc_id", "section", F.explode("parents").alias("parent")).join(own, ["doc_id", "section"]).groupBy("doc_id", F.col("parent").alias("section")).agg(F.sum("own_words").alias("n_words"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section"))
    parent = F.when(F.size("parents") > 1, F.element_at("parents", -2))
    return heads.join(own, ["doc_id", "section"]).join(up, ["doc_id", "section"]).select("doc_id", "section", place.alias("place"), "level", parent.alias("parent"), "path", "own_words", "n_words")


def _section_ctes() -> str:
    """Every pair of a block and the headings open there: none at or above the heading's level stands between."""
    return f"""{typed_sql()}, h AS (SELECT doc_id, ord, level, trim(text) AS title FROM blocks WHERE kind = 'heading'),
    opened AS (SELECT h.doc_id, h.ord, h.level, h.title, coalesce(min(n.ord), 2000000000) AS closed FROM h LEFT JOIN h n ON n.doc_id = h.doc_id AND n.ord > h.ord AND n.level <= h.level GROUP BY h.doc_id, h.ord, h.level, h.title),
    sec AS (SELECT b.doc_id, b.ord, coalesce(max(o.ord), -1) AS section, coalesce(string_agg(o.title, ' > ' ORDER BY o.ord), '{BEFORE_ALL}') AS path FROM blocks b LEFT JOIN opened o ON o.doc_id = b.doc_id AND o.ord <= b.ord AND b.ord < o.closed GROUP BY b.doc_id, b.ord)"""


def _tree_sql() -> str:
    return f"""WITH {_section_ctes()}, w AS (SELECT b.doc_id, b.ord, section, len(regexp_extract_all(text, '{word_sql()}')) AS n FROM blocks b JOIN sec USING (doc_id, ord)),
    own AS (SELECT doc_id, section, sum(n) AS own_words FROM w GROUP BY ALL), rolled AS (SELECT o.doc_id, o.ord, sum(w.n) AS n_words FROM opened o JOIN w ON w.doc_id = o.doc_id AND w.ord >= o.ord AND w.ord < o.closed GROUP BY ALL),
    up AS (SELECT a.doc_id, a.ord, max(b.ord) AS parent FROM opened a LEFT JOIN opened b ON b.doc_id = a.doc_id AND b.ord < a.ord AND a.ord < b.closed GROUP BY ALL)
    SELECT o.doc_id, CAST(o.ord AS INT) AS section, CAST(row_number() OVER (PARTITION BY o.doc_id ORDER BY o.ord) AS INT) AS place, o.level, CAST(parent AS INT) AS parent, path, CAST(own_words AS BIGINT) AS own_words, CAST(n_words AS BIGINT) AS n_words
    FROM opened o JOIN sec s ON s.doc_id = o.doc_id AND s.ord = o.ord JOIN own ON own.doc_id = o.doc_id AND own.section = o.ord JOIN rolled r ON r.doc_id = o.doc_id AND r.ord = o.ord JOIN up ON up.doc_id = o.doc_id AND up.ord = o.ord"""


def _summary_sql() -> str:
    title = f"lower(trim(regexp_replace(regexp_replace(text, '{PAGE_NUMBER}', ''), '\\s+', ' ', 'g')))"
    return rf"""WITH {_numbering_ctes()}, k AS (SELECT doc_id, count(*) AS compared FROM cmp WHERE previous IS NOT NULL GROUP BY doc_id)
    SELECT b.doc_id, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'heading' AND regexp_matches(text, '{HEADING_NUMBER}')) AS numbered, count(*) FILTER (kind = 'toc_entry') AS toc_entries,
      count(*) FILTER (kind = 'toc_entry' AND length({title}) >= 3 AND {title} NOT IN ('table des matières', 'sommaire')) AS comparable_entries, coalesce(any_value(k.compared), 0) AS compared
    FROM blocks b LEFT JOIN k USING (doc_id) GROUP BY b.doc_id"""


def page_estimate(blocks: DataFrame) -> DataFrame:
    """Pages by words: a block is on the page that the words before it fill."""
    counted = blocks.select("doc_id", "ord", word_count(F.col("text")).alias("n_words"))
    before = F.coalesce(F.sum("n_words").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select("doc_id", "ord", "n_words", (F.floor(before / WORDS_PER_PAGE) + 1).cast("int").alias("page"))


def looks_french(blocks: DataFrame) -> DataFrame:
    """The share of French words among the first blocks, and the verdict; short texts pass."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    first = blocks.withColumn("place", place).where(F.col("place") <= LANGUAGE_BLOCKS)
    words = every(F.lower("text"), r"\p{L}+")
    hits = F.size(F.filter(words, lambda w: w.isin(FRENCH_STOPWORDS)))
    summed = first.groupBy("doc_id").agg(F.sum(F.size(words)).alias("n_words"), F.sum(hits).alias("n_hits"))
    return summed.select("doc_id", "n_words", "n_hits", ((F.col("n_words") < MIN_FRENCH_WORDS) | (F.col("n_hits") / F.col("n_words") >= FRENCH_SHARE)).alias("french"))


def queries() -> dict:
    blocks = source.blocks
    return {
        "undefined_acronym": lambda spark, sf: undefined_acronym(blocks(spark, sf).withColumn("kind", F.lit("paragraph"))),
        "undefined_acronym_typed": lambda spark, sf: undefined_acronym(typed_blocks(spark, sf)),
        "terminology_variant": lambda spark, sf: terminology_variant(blocks(spark, sf)),
        "terminology_variant_cases": lambda spark, sf: terminology_variant(hyphenated(spark, sf)),
        "heading_gap": lambda spark, sf: heading_gap(typed_blocks(spark, sf)),
        "toc_mismatch": lambda spark, sf: toc_mismatch(typed_blocks(spark, sf)),
        "structure_summary": lambda spark, sf: structure_summary(typed_blocks(spark, sf)),
        "sections": lambda spark, sf: sections(typed_blocks(spark, sf)),
        "section_tree": lambda spark, sf: section_tree(typed_blocks(spark, sf)),
        "page_estimate": lambda spark, sf: page_estimate(blocks(spark, sf)),
        "looks_french": lambda spark, sf: looks_french(blocks(spark, sf)),
    }


#: For both engines: documents in which every fourth line hyphenates its longer words, so one document has both spellings.
HYPHENATED = "CASE WHEN ord % 4 = 1 THEN replace(replace(text, 'er', 'e-r'), 'en', 'e-n') ELSE text END"
HYPHENATED_SQL = source.SQL.replace("blocks AS", "plain AS") + f", blocks AS (SELECT doc_id, ord, {HYPHENATED} AS text FROM plain)"


def hyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.blocks(spark, sf_dir).withColumn("text", F.expr(HYPHENATED))


def oracle_sql() -> dict[str, str]:
    n_words = f"len(regexp_extract_all(text, '{word_sql()}'))"
    return {
        "undefined_acronym": _acronym_sql(source.SQL.replace("blocks AS", "lines AS") + ", blocks AS (SELECT *, 'paragraph' AS kind FROM lines)"),
        "undefined_acronym_typed": _acronym_sql(typed_sql()),
        "terminology_variant": _variant_sql(source.SQL),
        "terminology_variant_cases": _variant_sql(HYPHENATED_SQL),
        "heading_gap": _heading_sql(),
        "structure_summary": _summary_sql(),
        "section_tree": _tree_sql(),
        "sections": f"""WITH {_section_ctes()} SELECT doc_id, ord, CAST(section AS INT) AS section, path,
          CASE WHEN kind <> 'heading' THEN CAST(count(*) FILTER (kind <> 'heading') OVER (PARTITION BY doc_id, section ORDER BY ord) AS INT) END AS paragraph FROM sec JOIN blocks USING (doc_id, ord)""",
        "toc_mismatch": _toc_sql(),
        "page_estimate": f"""WITH {source.SQL}, c AS (SELECT doc_id, ord, CAST({n_words} AS INT) AS n_words FROM blocks)
          SELECT doc_id, ord, n_words, CAST(coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {WORDS_PER_PAGE} + 1 AS INT) AS page FROM c""",
        "looks_french": f"""WITH {source.SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM blocks),
          w AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM p WHERE k <= {LANGUAGE_BLOCKS}),
          s AS (SELECT doc_id, CAST(sum(len(w)) AS BIGINT) AS n_words, CAST(sum(len(list_filter(w, lambda x: x IN ({strings(FRENCH_STOPWORDS)})))) AS BIGINT) AS n_hits FROM w GROUP BY doc_id)
          SELECT *, n_words < {MIN_FRENCH_WORDS} OR n_hits / n_words >= {FRENCH_SHARE} AS french FROM s""",
    }
