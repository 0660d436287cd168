"""Excerpts anchored in the text they quote: word for word first, else with quotes, apostrophes, dashes and spaces made alike.

Folding changes lengths (an ellipsis becomes three dots, runs of spaces one, spaces beside quotes none), so a match in the folded text says nothing of the original's places.
The text is therefore cut into units that fold as a whole; running sums of their lengths before and after folding are the map back. All of it stays inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.text import SPACE, bound, every, running, sentence_ranges, sentences_sql
from proofline.sources import text as source

# Characters taken for a space, a double quote, an apostrophe and a hyphen, and the longest passage that stands for a whole block.
BLANK, QUOTE, ALIKE, PLAIN = r" \t\n\x{00A0}\x{202F}\x{2009}", r'“”«»"', "’‘ʼ–—", "'''--"
FIRST_LENGTH = 300
UNIT = rf"[{BLANK}]*[{QUOTE}][{BLANK}]*|[{BLANK}]+|…|[^{BLANK}{QUOTE}…]+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def fold(unit: Column) -> Column:
    return F.when(unit.rlike(f"[{QUOTE}]"), F.lit('"')).when(unit.rlike(f"^[{BLANK}]"), F.lit(" ")).when(unit == "…", F.lit("...")).otherwise(F.translate(unit, ALIKE, PLAIN))


def place(start: Column, end: Column, how: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(how).alias("how"))


def anchor(text: Column, excerpt: Column) -> Column:
    """Where an excerpt stands in a text: (start, end, how), how being exact or folded; null if it doesn't. Case counts in exact matches only."""

    def folded(needle: Column) -> Column:
        return bound(every(text, UNIT), lambda units: bound(F.transform(units, fold), lambda new: mapped(units, new, needle)))

    def mapped(units: Column, new: Column, needle: Column) -> Column:
        rows = F.arrays_zip(units.alias("old"), new.alias("new"), running(F.transform(units, F.length)).alias("start"), running(F.transform(new, F.length)).alias("at"))
        return bound(rows, lambda r: bound(F.position(F.lower(needle), F.lower(F.array_join(new, ""))), lambda k: F.when(k > 0, place(back(r, k - 1), back(r, k + F.length(needle) - 2) + 1, "folded"))))

    def back(rows: Column, k: Column) -> Column:
        unit = F.get(F.filter(rows, lambda u: (u["at"] <= k) & (k < u["at"] + F.length(u["new"]))), F.lit(0))
        inner = F.when(unit["new"] == '"', F.length(F.regexp_extract(unit["old"], f"^[{BLANK}]*", 0))).when((unit["old"] == "…") | (unit["new"] == " "), F.lit(0)).otherwise(k - unit["at"])
        return unit["start"] + inner

    def found(own: Column) -> Column:
        exact = F.position(own, text)
        needle = F.array_join(F.transform(every(own, UNIT), fold), "")
        return F.when(F.length(own) == 0, None).when(exact > 0, place(exact - 1, exact - 1 + F.length(own), "exact")).otherwise(bound(needle, folded))

    return bound(trimmed(excerpt), found)


def first_sentence(text: Column) -> Column:
    """The place that stands for a whole block: its first sentence, or what of it fits."""
    return bound(F.get(sentence_ranges(text), F.lit(0)), lambda s: place(s["start"], F.least(s["end"], s["start"] + FIRST_LENGTH), "first_sentence"))


def anchored(blocks: DataFrame) -> DataFrame:
    """Blocks with an ``excerpt`` each to its place; one that isn't found stands at the first sentence."""
    found = blocks.select("doc_id", "ord", "text", "excerpt", F.coalesce(anchor(F.col("text"), F.col("excerpt")), first_sentence(F.col("text"))).alias("a"))
    return found.select("doc_id", "ord", "a.start", "a.end", "a.how", F.substr("text", F.col("a.start") + 1, F.col("a.end") - F.col("a.start")).alias("found"))


#: For both engines: texts with quotes, dashes and odd spaces put in, and excerpts of them altered as a model would, some beyond recognition.
QUOTED = """CASE doc_id % 4 WHEN 0 THEN replace(replace(text, ', ', ' « a » '), '. ', '… ') WHEN 1 THEN replace(replace(text, ', ', ' – '), 'e ', 'e’ ') WHEN 2 THEN replace(text, '. ', ' . ') ELSE text END"""
CUT = "substring(text, CAST((doc_id * 31 + ord * 17) % greatest(1, length(text) - 30) + 1 AS INT), CAST(12 + doc_id % 40 AS INT))"
EXCERPT = """CASE (doc_id + ord) % 6 WHEN 0 THEN raw WHEN 1 THEN replace(replace(raw, '’', chr(39)), '…', '...') WHEN 2 THEN replace(replace(replace(raw, '« ', '"'), ' »', '"'), ' ', '  ') WHEN 3 THEN translate(raw, 'aeiou', 'AEIOU')
  WHEN 4 THEN replace(replace(raw, ' ', ' '), '–', '-') ELSE concat(raw, 'zzq') END"""


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = source.blocks(spark, sf_dir).withColumn("text", F.expr(QUOTED)).withColumn("raw", F.expr(CUT))
    return blocks.select("doc_id", "ord", "text", F.expr(EXCERPT).alias("excerpt"))


def queries() -> dict:
    return {"anchored_excerpts": lambda spark, sf: anchored(quoted(spark, sf))}


def oracle_sql() -> dict[str, str]:
    """Written over single characters: a space is kept if it begins its run and no quote stands on either side of the run."""
    folded = rf"""replace(regexp_replace(regexp_replace(translate(own, '{ALIKE}', '''''''--'), '[{BLANK}]*[{QUOTE}][{BLANK}]*', '"', 'g'), '[{BLANK}]+', ' ', 'g'), '…', '...')"""
    blocks = f"""{source.SQL.replace("blocks AS", "plain AS")}, blocks AS (SELECT doc_id, ord, {QUOTED} AS text FROM plain)"""
    return {
        "anchored_excerpts": rf"""WITH {blocks}, cut AS (SELECT *, {CUT} AS raw FROM blocks), e AS (SELECT doc_id, ord, text, regexp_replace({EXCERPT}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS own FROM cut),
        x AS (SELECT *, CASE WHEN own = '' THEN 0 ELSE strpos(text, own) END AS exact, {folded} AS needle FROM e),
        c AS (SELECT doc_id, ord, i, ch, CASE WHEN regexp_matches(ch, '[{BLANK}]') THEN 1 WHEN regexp_matches(ch, '[{QUOTE}]') THEN 2 ELSE 0 END AS k FROM (SELECT doc_id, ord, generate_subscripts(l, 1) AS i, unnest(l) AS ch FROM (SELECT doc_id, ord, string_split(text, '') AS l FROM x WHERE exact = 0 AND own <> ''))),
        n AS (SELECT *, sum(CASE WHEN k = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, ord ORDER BY i) AS solid, lag(k) OVER (PARTITION BY doc_id, ord ORDER BY i) AS before FROM c),
        s AS (SELECT doc_id, ord, solid, k AS kind FROM n WHERE k <> 1),
        g AS (SELECT n.doc_id, n.ord, n.i, CASE n.k WHEN 1 THEN ' ' WHEN 2 THEN '"' ELSE replace(translate(ch, '{ALIKE}', '''''''--'), '…', '...') END AS r FROM n LEFT JOIN s a ON a.doc_id = n.doc_id AND a.ord = n.ord AND a.solid = n.solid LEFT JOIN s b ON b.doc_id = n.doc_id AND b.ord = n.ord AND b.solid = n.solid + 1
          WHERE n.k <> 1 OR (before IS DISTINCT FROM 1 AND a.kind IS DISTINCT FROM 2 AND b.kind IS DISTINCT FROM 2)),
        h AS (SELECT doc_id, ord, string_agg(r, '' ORDER BY i) AS hay, flatten(list(list_transform(range(length(r)), lambda z: i) ORDER BY i)) AS pos FROM g GROUP BY doc_id, ord),
        f AS (SELECT x.*, hay, pos, strpos(lower(hay), lower(needle)) AS p FROM x LEFT JOIN h USING (doc_id, ord)),
        {sentences_sql('blocks', 'doc_id, ord')},
        o AS (SELECT f.doc_id, f.ord, f.text, CASE WHEN exact > 0 THEN exact - 1 WHEN own <> '' AND p > 0 THEN pos[p] - 1 ELSE s.start END AS a, CASE WHEN exact > 0 THEN exact - 1 + length(own) WHEN own <> '' AND p > 0 THEN pos[p + length(needle) - 1] ELSE least(s.start + length(s.text), s.start + {FIRST_LENGTH}) END AS z,
          CASE WHEN exact > 0 THEN 'exact' WHEN own <> '' AND p > 0 THEN 'folded' ELSE 'first_sentence' END AS how FROM f JOIN sentences s ON s.doc_id = f.doc_id AND s.ord = f.ord AND s.sentence = 0)
        SELECT doc_id, ord, CAST(a AS INT) AS start, CAST(z AS INT) AS "end", how, substring(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) AS found FROM o""",
    }
