"""Words, runs and sentences of a text, and the places where they stand.

Spark's regular expressions return text and no places. Matches are therefore put between marks, the text is cut at the marks, and a part's place is
the length of all parts before it, summed up inside the row: no shuffle, and rows that share a key never mix. Only matches cost anything.

All of it is linear in the text: no part is copied or searched once per match, protected runs are blanked out once before any pattern is tried, and sums
are formed chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a word, a number, protected text and an elision.
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
NUMBER = r"^\p{N}+$"
#: White space, no-break spaces included, as a class that Java and RE2 read alike.
SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters one by one.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A run without spaces that holds one of these is an address, a path, a file name or code.
PROTECTED = r"[\\/_=<>{}`#@|~^]|[\p{L}\p{N}]\.[\p{L}\p{N}]"
#: A whole run that holds one; tried at the beginning of runs only.
PROTECTED_RUN = rf"(?<![^{SPACE}])[^{SPACE}]*?(?:{PROTECTED})[^{SPACE}]*"
ELISION = r"^(?:l|d|j|m|n|s|t|c|qu|jusqu|lorsqu|puisqu|quoiqu)['’](.+)$"
#: A sentence ends with its marks and closing quotes, if space and a capital, a digit or an opening quote follow.
SENTENCE_END = r'([.!?…]+["»”’)]*)([' + SPACE + r']+)([\p{Lu}\p{N}«“"(])'
#: Noncharacters, which texts don't hold: a mark around matches, and what protected runs are filled with. A text that holds one is read as if it held OTHER.
MARK, FILL, OTHER = "\ufdd0", "\ufdd1", "\ufffd"
#: Steps of a running sum that are folded at once; a fold copies what it has so far in every step.
STEPS = 64


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(every(text, WORD)).cast("int")


def number_count(text: Column) -> Column:
    return F.size(F.filter(every(text, WORD), lambda w: w.rlike(NUMBER))).cast("int")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, each computed once a row.

    Spark moves conditions on a computed column to where its inputs come from, even below a shuffle, and computes it there once more for each. It moves none below a generator, so
    the values go through one that makes a single row.
    """
    rows = df.select(*keep, F.explode_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("computed"))
    return rows.select(*keep, *[F.col(f"computed.{name}").alias(name) for name in columns])


def rows_of(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """A row for each element of an array, which is computed once: an inner ``explode`` brings a condition on its size that computes it before."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def running(sizes: Column) -> Column:
    """The sum of all sizes before each one. Chunks of STEPS are summed on their own, then moved by what stands before them."""

    def sums(a: Column) -> Column:  # one more than ``a``: the last is the total
        return F.aggregate(a, F.array(F.lit(0)), lambda out, x: F.array_append(out, F.element_at(out, -1) + x))

    def moved(chunks: Column) -> Column:
        before = sums(F.transform(chunks, lambda c: F.element_at(c, -1)))
        return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, d: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: x + d)))

    cut = lambda a: F.transform(F.sequence(F.lit(1), F.size(a), F.lit(STEPS)), lambda k: sums(F.slice(a, k, F.lit(STEPS))))
    return bound(sizes, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(bound(cut(a), moved)))


def pieces_at(pieces: Column) -> Column:
    """The pieces of a text, in order, with their places: array of (start, end, text)."""
    row = lambda x, start: F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("text"))
    return bound(pieces, lambda p: F.zip_with(p, running(F.transform(p, F.length)), row))


def plain(text: Column) -> Column:
    return F.translate(text, MARK + FILL, OTHER + OTHER)


def calm_text(text: Column) -> Column:
    """The text with every run that is an address, a path or code filled up: no pattern of letters, spaces or marks matches inside, and places stay."""
    parts = F.split(F.regexp_replace(plain(text), PROTECTED_RUN, f"{MARK}$0{MARK}"), MARK, -1)
    filled = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit(FILL), F.length(x))).otherwise(x)), "")
    return F.when(text.rlike(PROTECTED), filled).otherwise(plain(text))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a Java pattern with their places, the character before each (if any) and what follows up to the end of the next match: array of (start, end, text, before, rest)."""

    def hit(cut: Column) -> Column:
        at = lambda k: F.get(cut, k)["text"]

        def row(k: Column) -> Column:
            own = F.get(cut, k)
            before = F.when(F.length(at(k - 1)) > 0, F.right(at(k - 1), F.lit(1))).otherwise(F.when(k > 1, F.right(at(k - 2), F.lit(1))).otherwise(F.lit("")))
            return F.struct(own["start"].alias("start"), own["end"].alias("end"), own["text"].alias("text"), before.alias("before"), F.concat(at(k + 1), F.coalesce(at(k + 2), F.lit(""))).alias("rest"))

        return F.when(F.size(cut) > 1, F.transform(F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)), row))

    cut = pieces_at(F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}"), MARK, -1))
    return F.when(text.rlike(pattern), bound(cut, hit))


def runs_sql(source: str, keys: str) -> str:
    """The same for DuckDB, as common table expressions ending in ``runs``."""
    return rf"""cut AS (SELECT {keys}, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (SELECT {keys}, regexp_extract_all(text, '[^{SPACE}]+|[{SPACE}]+') AS p FROM {source})),
placed AS (SELECT {keys}, i, part, CAST(coalesce(sum(length(part)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM cut),
ahead AS (SELECT {keys}, part AS run, start, lead(part, 1) OVER w AS sep, lead(part, 2) OVER w AS next, lead(start, 2) OVER w AS next_start FROM placed WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
runs AS (SELECT * FROM ahead WHERE regexp_matches(run, '^[^{SPACE}]'))"""


def sentence_ranges(text: Column) -> Column:
    """Sentences in order, without outer spaces: array of (start, end, text)."""
    cut = pieces_at(F.split(F.regexp_replace(F.translate(text, MARK, OTHER), SENTENCE_END, f"$1{MARK}$2$3"), MARK, -1))

    def trimmed(x: Column) -> Column:
        start = (x["start"] + F.length(x["text"]) - F.length(F.ltrim(x["text"], F.lit(SPACES)))).cast("int")
        own = F.btrim(x["text"], F.lit(SPACES))
        return F.struct(start.alias("start"), (start + F.length(own)).cast("int").alias("end"), own.alias("text"))

    return F.transform(cut, trimmed)


def sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sentences with their places: keys, sentence (from 0), start, end and text without outer spaces."""
    rows = df.select(*keys, F.posexplode(sentence_ranges(F.col(text))).alias("sentence", "s"))
    return rows.select(*keys, "sentence", "s.start", "s.end", "s.text")


def sentences_sql(source: str, keys: str) -> str:
    end = SENTENCE_END.replace("'", "''")
    return rf"""spieces AS (SELECT {keys}, string_split(regexp_replace(text, '{end}', '\1' || chr(1) || '\2\3', 'g'), chr(1)) AS p FROM {source}),
scut AS (SELECT {keys}, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM spieces),
splaced AS (SELECT {keys}, i, part, CAST(coalesce(sum(length(part)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM scut),
sentences AS (SELECT {keys}, CAST(i - 1 AS INT) AS sentence, CAST(start + length(part) - length(regexp_replace(part, '^[{SPACE}]+', '')) AS INT) AS start, regexp_replace(part, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text FROM splaced)"""


def word_sql() -> str:
    return WORD.replace("'", "''")
