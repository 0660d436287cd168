"""Names: capital words after titles or initials, directly or behind other parts of a name, and words that begin a sentence.

A name is walked backwards over at most HOPS words within REACH characters, inside the row. What stands before a word comes from the pieces that the text is cut into
anyway, so no text is copied from its beginning for each word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.text import FILL, MARK, SENTENCE_END, SPACE, SPACES, bound, computed, plain, rows_of, running, sentences_sql
from proofline.sources import text as source

# Titles, initials and parts of names, how far back a name is walked, and in how many words.
TITLE = r"""(?:^|[\s(«"'’])(?:M|MM|Mme|Mmes|Mlle|Mlles|Me|Mgr|Dr|Drs|Pr|Prs|St|Ste|Sr)\.?\s+$"""
INITIALS = r"""(?:^|[\s(«"'’])\p{Lu}\.(?:-?\p{Lu}\.)*\s+$"""
PART = r"(?:\p{Lu}[\p{L}'’-]*|de|du|des|d['’]|van|von|der|da|di|del|della|dos|le|la|ben|ibn|el|al)\s*$"
REACH, HOPS = 80, 5
CAPITAL = r"(?<![\p{L}\p{N}'’-])\p{Lu}[\p{L}'’-]*"


def after_title(before: Column) -> Column:
    """Whether what stands before a word ends in a title or initials, or in parts of a name behind them."""

    def state(text: Column, done: Column, found: Column) -> Column:
        return F.named_struct(F.lit("text"), text, F.lit("done"), done, F.lit("found"), found)

    def hop(a: Column, _: Column) -> Column:
        text = a["text"]
        on = lambda bare, found: state(F.regexp_replace(bare, PART, ""), found | ~bare.rlike(PART), found)
        walked = bound(text.rlike(TITLE) | text.rlike(INITIALS), lambda found: bound(F.rtrim(text, F.lit(SPACES)), lambda bare: on(bare, found)))
        return F.when(a["done"], a).otherwise(walked)

    begin = state(F.right(before, F.lit(REACH)), F.lit(False), F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HOPS)), begin, hop, lambda a: a["found"])


def words_before(text: Column, pattern: str) -> Column:
    """Matches with their places and what stands before them, in a text with FILL at the beginning of each sentence: array of (start, text, before).

    ``before`` goes back far enough for a sentence's opening marks and REACH characters before these. Most of the time a few pieces hold so much.
    """

    def rows(cut: Column, start: Column) -> Column:
        row = lambda k: F.named_struct(F.lit("start"), F.get(start, k), F.lit("text"), F.get(cut, k), F.lit("before"), back(cut, k))
        return F.when(F.size(cut) > 1, F.transform(F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)), row))

    def back(cut: Column, k: Column) -> Column:
        def last(n: int) -> Column:
            return F.array_join(F.transform(F.slice(cut, F.greatest(F.lit(1), k + 1 - n), F.least(k, F.lit(n))), lambda p: F.right(p, F.lit(2 * REACH))), "")

        return bound(last(12), lambda few: F.right(F.when((F.length(few) >= 2 * REACH) | (k <= 12), few).otherwise(last(2 * REACH)), F.lit(2 * REACH)))

    cut = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(text.rlike(pattern), bound(cut, lambda c: bound(running(F.transform(c, lambda p: F.length(F.translate(p, FILL, "")))), lambda at: rows(c, at))))


def capital_words(blocks: DataFrame) -> DataFrame:
    """Every word with a capital: doc_id, ord, start, word, after_title, sentence_start (no letter before it in its sentence, and that one doesn't follow a title itself).

    A sentence that begins behind an abbreviated title is none: the full stop was the title's.
    """
    text = F.concat(F.lit(FILL), F.regexp_replace(plain(F.col("text")), SENTENCE_END, f"$1$2{FILL}$3"))
    marked = computed(blocks.where(F.col("text").rlike(CAPITAL)), ["doc_id", "ord"], text=text)
    rows = rows_of(marked, ["doc_id", "ord"], words_before(F.col("text"), CAPITAL), "w").select("doc_id", "ord", "w.start", "w.text", "w.before")
    opening = rf"{FILL}[^\p{{L}}\p{{N}}{FILL}]*$"
    bare = lambda c: F.translate(c, FILL, "")
    # few words begin a sentence: only for these the walk is made once more, from before their opening marks
    begins = F.when(F.col("before").rlike(opening), ~after_title(bare(F.regexp_replace("before", opening, "")))).otherwise(F.lit(False))
    return rows.select("doc_id", "ord", "start", F.col("text").alias("word"), after_title(bare(F.col("before"))).alias("after_title"), begins.alias("sentence_start"))


#: For both engines: documents with titles, initials and particles put before some of their words.
TITLED = """CASE doc_id % 4 WHEN 0 THEN replace(replace(text, '. ', '. M. '), ', ', ', Dr ') WHEN 1 THEN replace(replace(text, '. ', '. Mme Aya de '), ', ', ' J.-P. La ') WHEN 2 THEN replace(text, ', ', ' Pr. A B C D E F ') ELSE text END"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.blocks(spark, sf_dir).withColumn("text", F.expr(TITLED))


def queries() -> dict:
    return {"capital_words": lambda spark, sf: capital_words(titled(spark, sf))}


def oracle_sql() -> dict[str, str]:
    """The walk as a chain of steps, one for each hop."""
    q = lambda s: s.replace("'", "''")

    def walked(source_name: str, result: str) -> str:
        steps, before = "", source_name
        for k in range(HOPS):
            steps += rf""", {result}{k} AS (SELECT * EXCLUDE (b, hit, over), CASE WHEN over OR hit THEN b ELSE regexp_replace(regexp_replace(b, '[{SPACE}]+$', ''), '{q(PART)}', '') END AS b,
              hit OR (NOT over AND (regexp_matches(b, '{q(TITLE)}') OR regexp_matches(b, '{q(INITIALS)}'))) AS hit, over OR NOT regexp_matches(regexp_replace(b, '[{SPACE}]+$', ''), '{q(PART)}') AS over FROM {before})"""
            before = f"{result}{k}"
        return steps.lstrip(", ")

    word = r"[\p{L}\p{N}''’-]+|[^\p{L}\p{N}''’-]+"
    return {
        "capital_words": rf"""WITH {source.SQL.replace("blocks AS", "lines AS")}, blocks AS (SELECT doc_id, ord, {TITLED} AS text FROM lines), {sentences_sql('blocks', 'doc_id, ord')},
        t AS (SELECT doc_id, ord, text, generate_subscripts(p, 1) AS i, unnest(p) AS tok FROM (SELECT doc_id, ord, text, regexp_extract_all(text, '{word}') AS p FROM blocks)),
        pl AS (SELECT *, coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM t),
        c AS (SELECT doc_id, ord, text, CAST(place AS INT) AS start, regexp_extract(tok, '^\p{{Lu}}[\p{{L}}''’-]*', 0) AS word FROM pl WHERE regexp_matches(tok, '^\p{{Lu}}')),
        w AS (SELECT * EXCLUDE text, right(left(text, start), {REACH}) AS b, false AS hit, false AS over FROM c), {walked('w', 'h')},
        sp AS (SELECT s.doc_id, s.ord, sentence, s.start + length(regexp_extract(s.text, '^[^\p{{L}}\p{{N}}]*', 0)) AS first, left(b.text, s.start) AS b0 FROM sentences s JOIN blocks b ON b.doc_id = s.doc_id AND b.ord = s.ord),
        sw AS (SELECT doc_id, ord, first, right(b0, {REACH}) AS b, false AS hit, false AS over FROM sp), {walked('sw', 'g')}
        SELECT h.doc_id, h.ord, start, word, h.hit AS after_title, g.first IS NOT NULL AND NOT g.hit AS sentence_start FROM h{HOPS - 1} h LEFT JOIN g{HOPS - 1} g ON g.doc_id = h.doc_id AND g.ord = h.ord AND g.first = h.start""",
    }
