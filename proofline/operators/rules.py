"""Rules on the text of single blocks. Each gives located candidates: doc_id, ord, start, end, original, suggestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.text import FILL, NUMBER, PROTECTED, SPACE, WORD, bound, calm_text, computed, every, matches, rows_of, runs_sql, sentence_ranges, sentences_sql, word_count, word_sql
from proofline.sources import text as source

KEYS = ["doc_id", "ord"]
FOUND = ["doc_id", "ord", "start", "end", "original", "suggestion"]
# Words that are often right when doubled, and the longest word looked at.
ALLOWED_REPEATS = ("nous", "vous")
MAX_WORD = 30
# A sentence is long beyond so many words, unless it is an enumeration or mostly numbers.
LONG_SENTENCE, ENUMERATION_MARKS, MAX_NUMERIC = 45, 2, 0.3

LAST_WORD = r"(?:^|[^\p{L}\p{N}'’-])(\p{L}+)$"
FIRST_WORD = r"^(\p{L}+)(?:[^\p{L}\p{N}'’-].*)?$"
LETTERS_END = r"(\p{L}+)$"
BLANKS = r"^[ \x{00A0}\x{202F}]+$"


#: A word with the same word behind it; only the first is matched, so a third one makes a second pair.
REPEATED = r"(?iu)(?<![\p{L}\p{N}'’-])(\p{L}+)(?=[ \x{00A0}\x{202F}]+\1(?![\p{L}\p{N}'’-]))"
#: What a rule finds in a text.
HITS = "array<struct<rule:string,start:int,end:int,original:string,suggestion:string>>"


def hit(rule: str, start: Column, end: Column, original: Column, suggestion: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), start.alias("start"), end.alias("end"), original.alias("original"), suggestion.alias("suggestion"))


def repeats_of(calm: Column) -> Column:
    """The same word twice with nothing but spaces between, in a text without addresses, paths and code (``calm_text``)."""
    sep = lambda x: F.regexp_extract(x["rest"], rf"^[{SPACE}]+", 0)
    second = lambda x: F.substr(x["rest"], F.length(sep(x)) + 1, F.length(x["text"]))
    good = lambda x: (F.lower(x["text"]) == F.lower(second(x))) & sep(x).rlike(BLANKS) & (F.length(x["text"]) <= MAX_WORD) & ~F.lower(x["text"]).isin(*ALLOWED_REPEATS) & (F.left(F.substr(x["rest"], F.length(sep(x)) + F.length(x["text"]) + 1), F.lit(1)) != FILL)
    row = lambda x: hit("repeated_word", x["start"], x["end"] + F.length(sep(x)) + F.length(x["text"]), F.concat(x["text"], sep(x), second(x)), x["text"])
    return F.transform(F.filter(matches(calm, REPEATED), good), row)


def long_sentences_of(text: Column) -> Column:
    """Sentences of too many words, with their number of words."""

    def good(words: Column, x: Column) -> Column:
        numbers = F.size(F.filter(words, lambda w: w.rlike(NUMBER)))
        return (F.size(words) > LONG_SENTENCE) & (F.regexp_count(x["text"], F.lit(";")) < ENUMERATION_MARKS) & (numbers <= MAX_NUMERIC * F.size(words))

    found = F.filter(sentence_ranges(text), lambda x: bound(every(x["text"], WORD), lambda words: good(words, x)))
    row = lambda x: F.struct(F.lit("long_sentence").alias("rule"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("original"), F.lit(None).cast("string").alias("suggestion"), word_count(x["text"]).alias("n_words"))
    return F.when(word_count(text) > LONG_SENTENCE, F.transform(found, row))


def exploded(blocks: DataFrame, found: Column, *more: str) -> DataFrame:
    """A row for each thing found in a block."""
    return rows_of(blocks, KEYS, found, "hit").select(*KEYS, *[f"hit.{c}" for c in ("rule", "start", "end", "original", "suggestion", *more)])


def spans_of(runs: Column) -> Column:
    """Runs of a word processor (run_index, start, end), in order, as the stretches in which each run follows the one before without a gap in index or place."""
    zero = F.array().cast("array<struct<start:int,end:int,index:int>>")

    def step(out: Column, r: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        follows = (r["run_index"] == last["index"] + 1) & (r["start"] == last["end"])
        longer = F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.struct(last["start"].alias("start"), r["end"].alias("end"), r["run_index"].alias("index")))
        return F.when((F.size(out) > 0) & follows, longer).otherwise(F.array_append(out, F.struct(r["start"].alias("start"), r["end"].alias("end"), r["run_index"].alias("index"))))

    return F.aggregate(runs, zero, step)


def continuous(found: Column, spans: Column) -> Column:
    """What was found within one stretch: an image, a note's mark or a field between two runs leaves a gap that the text doesn't show."""
    return F.filter(found, lambda x: F.exists(spans, lambda s: (s["start"] <= x["start"]) & (x["end"] <= s["end"])))


def calmed(blocks: DataFrame) -> DataFrame:
    """The blocks with ``calm``, their text without addresses, paths and code, and ``spans`` if they have runs."""
    out = computed(blocks, blocks.columns, calm=calm_text(F.col("text")))
    return out.withColumn("spans", spans_of(F.col("runs"))) if "runs" in blocks.columns else out


def unbroken(blocks: DataFrame, found: Column) -> Column:
    """What was found, but for what crosses a gap between runs, if the blocks have any."""
    return continuous(found, F.col("spans")) if "spans" in blocks.columns else found


def repeated_word(blocks: DataFrame) -> DataFrame:
    """The same word twice with nothing but spaces between; both ends outside addresses, paths and code."""
    own = calmed(blocks.where(F.col("text").rlike(REPEATED)))
    return exploded(own, unbroken(own, repeats_of(F.col("calm")))).drop("rule")


def repeated_word_sql(blocks: str = source.SQL) -> str:
    names = ", ".join(f"'{w}'" for w in ALLOWED_REPEATS)
    last, first = LAST_WORD.replace("'", "''"), FIRST_WORD.replace("'", "''")
    return rf"""WITH {blocks}, {runs_sql('blocks', 'doc_id, ord')},
    w AS (SELECT *, regexp_extract(run, '{last}', 1) AS f, regexp_extract(next, '{first}', 1) AS s FROM runs)
    SELECT doc_id, ord, CAST(start + length(run) - length(f) AS INT) AS start, CAST(next_start + length(s) AS INT) AS "end", f || sep || s AS original, f AS suggestion
    FROM w WHERE f <> '' AND lower(f) = lower(s) AND regexp_matches(sep, '{BLANKS}') AND length(f) <= {MAX_WORD} AND lower(f) NOT IN ({names})
      AND NOT regexp_matches(run, '{PROTECTED}') AND NOT regexp_matches(next, '{PROTECTED}')"""


def long_sentence(blocks: DataFrame) -> DataFrame:
    """Sentences of too many words, with their number of words."""
    return exploded(blocks, long_sentences_of(F.col("text")), "n_words").select(*KEYS, "start", "end", "n_words", "original")


def long_sentence_sql(blocks: str = source.SQL) -> str:
    return rf"""WITH {blocks}, {sentences_sql('blocks', 'doc_id, ord')},
    w AS (SELECT doc_id, ord, start, text, regexp_extract_all(text, '{word_sql()}') AS words FROM sentences)
    SELECT doc_id, ord, start, CAST(start + length(text) AS INT) AS "end", CAST(len(words) AS INT) AS n_words, text AS original FROM w
    WHERE len(words) > {LONG_SENTENCE} AND length(text) - length(replace(text, ';', '')) < {ENUMERATION_MARKS}
      AND len(list_filter(words, lambda x: regexp_matches(x, '{NUMBER}'))) <= CAST({MAX_NUMERIC} AS DOUBLE) * len(words)"""


#: What is no space and not part of an address, a path or code.
SOLID = rf"[^{SPACE}{FILL}]"
#: Rule, pattern, and whether a document with equations is left alone, as its text lacks them.
TYPOGRAPHY = {
    "double_space": (rf"(?<={SOLID}) {{2,}}(?={SOLID})", False),
    "space_before_punctuation": (rf"(?<!\p{{L}})\p{{L}}+[ \x{{00A0}}]+[,.](?=[{SPACE}]|$)", True),
    "doubled_punctuation": (r"(?<![,;])([,;])\1(?![,;])", False),
    "missing_space_after_comma": (r"(?<![\p{L}\p{N}(\[{])\p{L}{2,},\p{L}{2,}(?![\p{L}\p{N}(\])}])", False),
}


def typography_of(calm: Column, equations: Column) -> Column:
    """Every match of the four patterns in a text without addresses, paths and code (``calm_text``)."""
    suggestions = {
        "double_space": lambda x: F.lit(" "),
        "space_before_punctuation": lambda x: F.regexp_replace(x, r"[ \x{00A0}]+", ""),
        "doubled_punctuation": lambda x: F.left(x, F.lit(1)),
        "missing_space_after_comma": lambda x: F.replace(x, F.lit(","), F.lit(", ")),
    }

    def found_by(rule: str, pattern: str, alone: bool) -> Column:
        rows = F.transform(matches(calm, pattern), lambda x: hit(rule, x["start"], x["end"], x["text"], suggestions[rule](x["text"])))
        return F.when(~equations, rows) if alone else rows

    return F.flatten(F.array_compact(F.array(*[found_by(rule, *how) for rule, how in TYPOGRAPHY.items()])))


def has_equations(blocks: DataFrame) -> Column:
    return F.coalesce(F.col("equations"), F.lit(False)) if "equations" in blocks.columns else F.lit(False)


def typography(blocks: DataFrame) -> DataFrame:
    """Double spaces, spaces before marks, doubled marks and commas glued to the next word: every match, with the rule's name.

    Blocks may have a column ``equations``: whether their document has any, and a column ``runs``: the runs of their text.
    """
    own = calmed(blocks)
    return exploded(own, unbroken(own, typography_of(F.col("calm"), has_equations(blocks))))


#: For both engines: documents with faults put in by plain arithmetic, as the driver's have none of them; some count as having equations.
INJECTED = """CASE doc_id % 5 WHEN 0 THEN replace(text, ', ', ' , ') WHEN 1 THEN replace(text, ', ', ',, ') WHEN 2 THEN replace(text, ', ', ',') WHEN 3 THEN replace(text, '. ', '.  ') ELSE replace(replace(text, '. ', ',,x;;'), ' ', ',') END"""
INJECTED_SQL = source.SQL.replace("blocks AS", "plain AS") + f", blocks AS (SELECT doc_id, ord, {INJECTED} AS text, doc_id % 10 = 0 AS equations FROM plain)"


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = source.blocks(spark, sf_dir)
    return blocks.withColumns({"text": F.expr(INJECTED), "equations": F.col("doc_id") % 10 == 0})


#: For both engines: runs of RUN characters as a word processor would have them; some documents miss an index after every third run, as an image leaves it.
RUN = 37


def with_runs(blocks: DataFrame) -> DataFrame:
    holes = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.lit(1))
    run = lambda k: F.struct((k + (k / 3).cast("int") * holes).alias("run_index"), (k * RUN).alias("start"), F.least((k + 1) * RUN, F.length("text")).alias("end"))
    return blocks.withColumn("runs", F.transform(F.sequence(F.lit(0), ((F.length("text") - 1) / RUN).cast("int")), run))


def every_hit(blocks: DataFrame) -> DataFrame:
    """The hits of all rules on blocks in one pass: ``rule`` and the columns of FOUND."""
    own = calmed(blocks)
    broken = [repeats_of(F.col("calm")), typography_of(F.col("calm"), has_equations(blocks))]
    plain = F.transform(long_sentences_of(F.col("text")), lambda x: F.struct(*[x[c].alias(c) for c in ("rule", "start", "end", "original", "suggestion")]))
    return exploded(own, F.flatten(F.array_compact(F.array(*[unbroken(own, x) for x in broken], plain))))


def typography_counts(blocks: DataFrame) -> DataFrame:
    found = typography(blocks)
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))


def typography_ctes() -> str:
    """Written over runs and their tokens: a doubled mark is a token of two equal marks, a glued comma stands between two tokens of letters."""
    p = PROTECTED
    return rf"""{runs_sql('blocks', 'doc_id, ord')},
    c AS (SELECT *, NOT regexp_matches(run, '{p}') AS calm, coalesce(NOT regexp_matches(next, '{p}'), true) AS calm_next, regexp_extract(run, '{LETTERS_END}', 1) AS word FROM runs),
    m AS (SELECT doc_id, ord, start, generate_subscripts(t, 1) AS i, unnest(t) AS tok FROM (SELECT *, regexp_extract_all(run, '[,;]+|[^,;]+') AS t FROM c WHERE calm AND regexp_matches(run, '[,;]'))),
    m2 AS (SELECT *, start + coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, ord, start ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM m),
    g AS (SELECT doc_id, ord, start, generate_subscripts(t, 1) AS i, unnest(t) AS tok FROM (SELECT *, regexp_extract_all(run, '\p{{L}}+|\P{{L}}') AS t FROM c WHERE calm AND contains(run, ','))),
    g2 AS (SELECT *, start + coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, ord, start ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, lag(tok) OVER w AS before, lead(tok) OVER w AS comma, lead(tok, 2) OVER w AS other, lead(tok, 3) OVER w AS after
      FROM g WINDOW w AS (PARTITION BY doc_id, ord, start ORDER BY i)),
    g3 AS (SELECT *, i - 2 * row_number() OVER (PARTITION BY doc_id, ord, start ORDER BY i) AS island FROM g2 WHERE regexp_matches(tok, '^\p{{L}}{{2,}}$') AND comma = ',' AND regexp_matches(other, '^\p{{L}}{{2,}}$')
      AND NOT coalesce(regexp_matches(before, '[\p{{N}}(\[{{]'), false) AND NOT coalesce(regexp_matches(after, '[\p{{N}}(\])}}]'), false)),
    g4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord, start, island ORDER BY i) AS k FROM g3),
    found AS (
    SELECT doc_id, ord, 'double_space' AS rule, CAST(start + length(run) AS INT) AS start, CAST(next_start AS INT) AS "end", sep AS original, ' ' AS suggestion
      FROM c WHERE regexp_matches(sep, '^ {{2,}}$') AND next IS NOT NULL AND calm AND calm_next
    UNION ALL SELECT doc_id, ord, 'space_before_punctuation', CAST(start + length(run) - length(word) AS INT), CAST(next_start + 1 AS INT), word || sep || next, word || next
      FROM c WHERE word <> '' AND regexp_matches(sep, '^[ \x{{00A0}}]+$') AND next IN (',', '.') AND calm AND doc_id NOT IN (SELECT doc_id FROM eq WHERE equations)
    UNION ALL SELECT doc_id, ord, 'doubled_punctuation', CAST(s AS INT), CAST(s + 2 AS INT), tok, tok[1] FROM m2 WHERE tok IN (',,', ';;')
    UNION ALL SELECT doc_id, ord, 'missing_space_after_comma', CAST(s AS INT), CAST(s + length(tok) + 1 + length(other) AS INT), tok || ',' || other, tok || ', ' || other FROM g4 WHERE k % 2 = 1)"""


NO_EQUATIONS = "eq AS (SELECT CAST(-1 AS BIGINT) AS doc_id, false AS equations)"
EQUATIONS = "eq AS (SELECT DISTINCT doc_id, equations FROM blocks)"


def values(rows: list[tuple]) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def queries() -> dict:
    return {
        "repeated_word": lambda spark, sf: repeated_word(source.blocks(spark, sf)),
        "long_sentence": lambda spark, sf: long_sentence(source.blocks(spark, sf)),
        "typography_cases": lambda spark, sf: typography(injected(spark, sf)),
        "typography_documents": lambda spark, sf: typography_counts(source.blocks(spark, sf)),
        "continuous_hits": lambda spark, sf: every_hit(with_runs(injected(spark, sf))),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "repeated_word": repeated_word_sql(),
        "long_sentence": long_sentence_sql(),
        "typography_cases": f"WITH {INJECTED_SQL}, {EQUATIONS}, {typography_ctes()} SELECT * FROM found",
        "continuous_hits": f"""WITH {INJECTED_SQL}, {EQUATIONS}, {typography_ctes()},
          every AS (SELECT doc_id, ord, rule, start, "end", original, suggestion FROM found UNION ALL SELECT doc_id, ord, 'repeated_word', start, "end", original, suggestion FROM ({repeated_word_sql(INJECTED_SQL)}))
          SELECT * FROM every e WHERE doc_id % 3 = 0 OR (start // {3 * RUN} + 1) * {3 * RUN} >= "end"
          UNION ALL SELECT doc_id, ord, 'long_sentence', start, "end", original, NULL FROM ({long_sentence_sql(INJECTED_SQL)})""",
        "typography_documents": f"WITH {source.SQL}, {NO_EQUATIONS}, {typography_ctes()} SELECT doc_id, rule, count(*) AS n, min(start) AS first_start FROM found GROUP BY doc_id, rule",
    }
