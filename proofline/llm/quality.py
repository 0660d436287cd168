"""Operator 6, quality rules: line-first cleaning with built-in functions only.

Every line of a text is judged by itself; failing lines are removed and a document that loses
too much of its text, or that fails the document-level base rules, is rejected. There is no shuffle: one pass over
the table, every row on its own.

Defined results: a null text counts as empty, an empty text has no words and fails the base
rules. Repeated rows each get their own, equal result, rows with a null doc_id too. Extra columns of the input are kept; ``score`` replaces
columns named like a result, ``clean`` keeps them all. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import documents, nested, text_or_empty

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected if the lines that stay hold less than this share of its words.
MIN_KEPT_SHARE = 0.5

# Rules for a line, as regular expressions that both Java and RE2 read alike.
#: Marks that set cells of a menu apart; a line with three of them is navigation.
NAVIGATION = r"[|»›·]"
MIN_NAVIGATION = 3
BOILERPLATE = (
    r"(?i)(?:\bcookies?\b.*\b(?:accept|consent|policy|settings)\b|\b(?:accept|use) (?:all )?cookies\b|\bprivacy policy\b|\bterms of (?:use|service)\b"
    r"|\ball rights reserved\b|\b(?:enable|requires?) javascript\b|\blorem ipsum\b|\b(?:click|tap) here\b|\bsubscribe (?:now|to our)\b|\bsign (?:in|up) to\b|\bshare (?:on|this)\b"
    r"|\balle rechte vorbehalten\b|\bcookies? (?:akzeptieren|aceptar|accepter)\b|\b(?:akzeptieren|aceptar|acepte|accepter|acceptez) (?:sie )?(?:alle |todas las |tous les |las |les )?cookies\b|\bhier klicken\b|\bnewsletter abonnieren\b|\bjavascript aktivieren\b"
    r"|\btodos los derechos reservados\b|\bderechos reservados\b|\bhaga clic\b|\bde privacidad\b|\baviso legal\b|\btous droits r.serv|\bde confidentialit|\bmentions l.gales\b|\bcliquez ici\b|\babonnez-vous\b)"
)
#: In small letters; every match of ``BOILERPLATE`` holds one, so texts without any are not searched.
SEEDS = ["cookie", "privacy policy", "terms of ", "rights reserved", "javascript", "lorem ipsum", "click here", "tap here", "subscribe ", "sign in to", "sign up to", "share on", "share this"]
SEEDS += ["rechte vorbehalten", "hier klicken", "newsletter abonnieren", "derechos reservados", "haga clic", "de privacidad", "aviso legal", "tous droits r", "de confidentialit", "mentions l", "cliquez ici", "abonnez-vous"]
#: A word that ends in a run of marks (three symbols, or two exclamation or question marks).
NOISE_MARKS = r"[#*$%&<>]{3,}|[!?]{2,}"
#: Sentence ends, with closing quotes or brackets after them.
TERMINAL = r"""[.!?…:;][)\]"'”’»]*\s*$"""
MAX_NOISE_PER_WORD = 0.3
MIN_DISTINCT_SHARE = 0.2
MIN_LONG_LINE = 10
#: An unpunctuated line is only a failure if it is short (a menu entry, a button, a caption).
MAX_UNPUNCTUATED = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use at many places of ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """How many words stand in three-word windows that the text holds twice or more.

    Hashes of the windows, sorted with their places, show which windows may be repeated; those are then sorted and compared
    by their words. The cost is n log n in the words of one text.
    """
    number = lambda n: F.lit(n).cast("long")

    def covered(places: Column) -> Column:
        start = F.struct(number(-3).alias("prev"), number(0).alias("total"))
        return F.aggregate(F.array_sort(places), start, lambda a, p: F.struct(p.alias("prev"), (a["total"] + F.least(number(3), p - a["prev"])).alias("total")), lambda a: a["total"])

    def exact(w: Column, places: Column) -> Column:
        spelled = F.transform(places, lambda i: F.struct(F.array_join(F.slice(w, (i + 1).cast("int"), F.lit(3)), " ").alias("window"), i.alias("i")))
        near = lambda s: F.filter(s, lambda x, i: (x["window"] == F.get(s, i - 1)["window"]) | (x["window"] == F.get(s, i + 1)["window"]))
        return let(F.array_sort(spelled), lambda s: covered(F.transform(near(s), lambda x: x["i"])))

    def likely(keys: Column) -> Column:
        """Places of windows whose hash occurs again, and perhaps some more."""
        bits = F.ceil(F.log2(F.size(keys).cast("double"))).cast("int")  # a place fits beside the other bits of the hash in one long, which sorts fast

        def masked(mask: Column) -> Column:
            joined = F.transform(keys, lambda h, i: h.bitwiseAND(mask).bitwiseOR(i.cast("long")))
            same = lambda x, y: x.bitwiseAND(mask) == y.bitwiseAND(mask)
            near = lambda s: F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return let(F.array_sort(joined), lambda s: F.transform(near(s), lambda x: x.bitwiseAND(F.bitwise_not(mask))))

        return let(F.call_function("shiftleft", number(-1), bits), masked)

    def repeated(w: Column, keys: Column) -> Column:
        none = F.size(F.array_distinct(keys)) == F.size(keys)
        return F.when(none, number(0)).otherwise(let(likely(keys), lambda p: exact(w, p)))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: F.when(F.size(w) < 4, number(0)).otherwise(let(windows(w), lambda k: repeated(w, k))))


def line_fails(line: Column, words: Column, seeded: Column) -> Column:
    """Whether a line is navigation, boilerplate, marks, one word over and over, or a bare fragment; ``seeded`` tells if its text holds a seed."""
    n = F.size(words)
    return (
        (F.regexp_count(line, F.lit(NAVIGATION)) >= MIN_NAVIGATION)
        | (seeded & line.rlike(BOILERPLATE))
        | (F.regexp_count(line, F.lit(NOISE_MARKS)) > n * F.lit(MAX_NOISE_PER_WORD))
        | ((n >= MIN_LONG_LINE) & (F.size(F.array_distinct(words)) < n * F.lit(MIN_DISTINCT_SHARE)))
        | (~line.rlike(TERMINAL) & (n <= MAX_UNPUNCTUATED))
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "kept_words", "base_failed", "kept"]


def judged(docs: DataFrame, text: str) -> DataFrame:
    """``row`` (the input row), ``n_lines``, ``n_kept`` lines and the columns of ``COUNTS``."""
    size = lambda c: F.size(c).cast("long")
    out = nested(docs, text_or_empty(text).alias("t"))

    def line(x: Column, seeded: Column) -> Column:
        return let(words_of(x), lambda w: F.struct(x.alias("line"), w.alias("words"), ((F.size(w) > 0) & line_fails(x, w, seeded)).alias("fails")))

    # bound here, as the optimizer would otherwise work it out again for every line
    seeded = let(F.lower("t"), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(seed)) for seed in SEEDS]))
    every = let(seeded, lambda some: F.transform(F.split("t", "\n"), lambda x: line(x, some)))
    lines = F.filter(every, lambda x: F.size(x["words"]) > 0)
    out = out.withColumn("lines", lines).withColumn("good", F.filter("lines", lambda x: ~x["fails"]))
    words, names = F.flatten(F.transform("lines", lambda x: x["words"])), F.transform("lines", lambda x: x["line"])
    out = out.withColumn("words", words)
    out = out.select(
        "row",
        F.size("lines").alias("n_lines"),
        F.size("good").alias("n_kept"),
        size("words").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (size("lines") - size(F.array_distinct(names))).alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.array_join(F.transform("good", lambda x: x["line"]), "\n").alias("clean_text"),
        F.aggregate("good", F.lit(0).cast("long"), lambda a, x: a + F.size(x["words"])).alias("kept_words"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_words") >= F.lit(MIN_KEPT_SHARE) * F.col("n_words")))


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, ``clean_text``, ``kept_words``, ``base_failed`` and ``kept``."""
    return judged(docs, text).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in COUNTS or c == text], *[c for c in COUNTS if c != text])


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stay, with failing lines removed; same columns as ``docs``.

    A text that loses no line stays as it is, byte for byte. ``n_chars``, if it is a column, is counted again where lines were removed.
    """
    stay, lost = judged(docs, text).where("kept"), F.col("n_kept") < F.col("n_lines")
    new = {text: F.when(lost, F.col("clean_text")).otherwise(F.col(f"row.`{text}`"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return stay.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir).select("doc_id", "text")).select(RESULT)


def _sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql() -> dict[str, str]:
    spaces = "[\\x20\\x09-\\x0D]"
    words = lambda c: f"regexp_extract_all({c}, '[^\\x20\\x09-\\x0D]+')"
    bad = (
        f"len(regexp_extract_all(l, {_sql_string(NAVIGATION)})) >= {MIN_NAVIGATION} OR regexp_matches(l, {_sql_string(BOILERPLATE)})"
        f" OR len(regexp_extract_all(l, {_sql_string(NOISE_MARKS)})) > len({words('l')}) * CAST({MAX_NOISE_PER_WORD} AS DOUBLE)"
        f" OR (len({words('l')}) >= {MIN_LONG_LINE} AND len(list_distinct({words('l')})) < len({words('l')}) * CAST({MIN_DISTINCT_SHARE} AS DOUBLE))"
        f" OR (NOT regexp_matches(l, {_sql_string(TERMINAL)}) AND len({words('l')}) <= {MAX_UNPUNCTUATED})"
    )
    query = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, {words('t')} AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
    p AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM h, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
    k AS (SELECT r, sum(len({words('l')})) AS kept_words FROM (SELECT r, unnest(lines) AS l FROM w) WHERE NOT ({bad}) GROUP BY r),
    x AS (
      SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{spaces}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words
      FROM w LEFT JOIN p USING (r) LEFT JOIN k USING (r)),
    y AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM x)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND kept_words >= CAST({MIN_KEPT_SHARE} AS DOUBLE) * n_words AS kept, kept_words FROM y"""
    return {"op6_quality_rules": query}
