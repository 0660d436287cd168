"""French or English, per block or sentence with the document's language behind it, from function words, elisions, accents and lexicons.

Words are judged in place with array functions: no row per word, no shuffle but the one that sums a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.functions.text import MARK, OTHER, SENTENCE_END, SPACES, bound, computed, every, pieces_at
from proofline.sources import text as source

# Function words of either language that the other one hardly has.
FRENCH = (
    "le la les de des du et est un une pour que qui dans au aux sur par avec ce cette ces cet il elle ils elles nous vous sont pas ont été ou mais sa ses leur leurs se ne comme être avoir entre très aussi donc dont où sous sans chez après avant "
    "tout tous toute toutes cela ainsi lors selon depuis également notre nos votre vos je tu lui était étaient sera peut faire fait dès vers afin puis quand alors car même déjà encore plusieurs chaque"
).split()
ENGLISH = (
    "the of and to in is that for with are this by be from it which was were have has had not their its can will these those been also more at we our they them such between into than there would should could may who what when where how why he she his her "
    "you your about after before through during while because however both each other only over under any all some most many being does did do if so then just very my us upon within without across among against since until whether whose"
).split()
MIN_EVIDENCE, DOMINANCE, ACCENT_WEIGHT = 2, 2, 0.5
#: Letters of a word that a lexicon is asked about.
MIN_CONTENT = 3
LETTERS = r"\p{L}+(?:['’]\p{L}+)*"
PARTS = r"\p{L}+(?:['’]\p{L}+)*|[^\p{L}]+"
LETTER = r"^\p{L}"
ELIDED = r"^(?:l|d|j|m|n|s|t|c|qu|jusqu|lorsqu|puisqu|quoiqu)['’]\p{L}"
CONTRACTED = r"\p{L}['’](?:s|t|re|ve|ll|d|m)$"
ACCENTED = "[àâäéèêëîïôöùûüÿçœæ]"
#: What stands before a word that begins a sentence.
OPENING = r"""^[\s«“"'(]*$"""
AFTER_END = r"""[.!?…:]\s*[\s«“"'(]*$"""


def judged(text: Column) -> Column:
    """Half points (fr, en) of every word, and the word itself where it is no function word (content), as an array."""

    def one(p: Column, before: Column) -> Column:
        low = F.lower(p)
        opens = F.when(before.isNull(), True).otherwise(before.rlike(AFTER_END))
        name = p.rlike(r"^\p{Lu}") & (((F.length(p) >= 2) & p.rlike(r"^\p{Lu}+$")) | ~opens)
        # what a word says is found once: nothing, French or English, an accent, or that it is no function word
        said = F.when(~p.rlike(LETTER) | name, "-").when(low.rlike(ELIDED), "f").when(low.rlike(CONTRACTED), "e").when(low.isin(FRENCH), "f").when(low.isin(ENGLISH), "e").when(low.rlike(ACCENTED), "a").otherwise("o")
        return bound(said, lambda c: F.struct(F.when(c == "f", 2).when(c == "a", int(2 * ACCENT_WEIGHT)).otherwise(0).alias("fr"), F.when(c == "e", 2).otherwise(0).alias("en"), F.when(c.isin("a", "o") & (F.length(p) >= MIN_CONTENT), low).alias("content")))

    parts = every(text, PARTS)
    opener = lambda ps, i: F.when((i == 0) | ((i == 1) & F.get(ps, F.lit(0)).rlike(OPENING)), F.lit(None)).otherwise(F.get(ps, i - 1))
    return F.transform(F.array(parts), lambda ps: F.transform(ps, lambda p, i: one(p, opener(ps, i))))[0]


def total(words: Column, side: str) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + w[side])


def decide(fr: Column, en: Column) -> Column:
    """Sums are in half points."""
    enough = 2 * MIN_EVIDENCE
    return F.when(fr + en < enough, None).when((en >= enough) & (en >= fr * DOMINANCE), "en").when((fr >= enough) & (fr >= en * DOMINANCE), "fr").otherwise("uncertain")


def block_language(blocks: DataFrame) -> DataFrame:
    words = blocks.select("doc_id", "ord", judged(F.col("text")).alias("w"))
    found = words.select("doc_id", "ord", total(F.col("w"), "fr").alias("fr"), total(F.col("w"), "en").alias("en"))
    docs = found.groupBy("doc_id").agg(F.sum("fr").alias("doc_fr"), F.sum("en").alias("doc_en"))
    whole = F.when((F.col("doc_en") >= 2 * MIN_EVIDENCE) & (F.col("doc_en") >= F.col("doc_fr") * DOMINANCE), "en").otherwise("fr")
    return found.join(docs, "doc_id").select("doc_id", "ord", "fr", "en", F.coalesce(decide(F.col("fr"), F.col("en")), whole).alias("language"))


UNIT = ["doc_id", "ord", "sentence"]
#: A word with what stands before it, behind the word before.
TOKEN, ITS_WORD = r"[^\p{L}]*\p{L}+(?:['’]\p{L}+)*", r"\p{L}+(?:['’]\p{L}+)*$"
#: The end of the sentence before, which a block's words see and a sentence's don't.
LAST_END = r"""[.!?…]["»”’)]*$"""
#: No word of a lexicon: rows that ask none are dealt out by it.
NO_WORD = "-"


def told(sentence: Column, first: Column) -> Column:
    """What each word of a sentence says: a letter for the sentence, one for its block, and the word in small letters.

    f French, e English, a an accent, o no function word (b and p: too short to ask a lexicon), - nothing. ``first`` is whether the sentence is its block's first. Only before
    a sentence's first word may the block hold something else than the sentence.
    """

    def said(low: Column, size: Column) -> Column:
        apostrophe = low.rlike("['’]")
        short = size < MIN_CONTENT
        return F.when(apostrophe & low.rlike(ELIDED), "f").when(apostrophe & low.rlike(CONTRACTED), "e").when(low.isin(FRENCH), "f").when(low.isin(ENGLISH), "e").when(low.rlike(ACCENTED), F.when(short, "b").otherwise("a")).otherwise(F.when(short, "p").otherwise("o"))

    def named(opens: Column, whole: Column, letter: Column) -> Column:
        return F.when(whole | ~opens, "-").otherwise(letter)

    def capital(t: Column, i: Column, word: Column, low: Column, letter: Column) -> Column:
        before = F.left(t, F.length(t) - F.length(word))
        whole = (F.length(word) >= 2) & word.rlike(r"^\p{Lu}+$")
        within = F.concat(sentence["lead"], before)
        begins = lambda b: (b == "") | b.rlike(OPENING) | b.rlike(AFTER_END)
        two = F.concat(named(begins(before), whole, letter), named(F.when(first, begins(within)).otherwise(within.rlike(AFTER_END)), whole, letter), low)
        return F.when(i == 0, two).otherwise(bound(named(before.rlike(AFTER_END), whole, letter), lambda c: F.concat(c, c, low)))

    def one(t: Column, i: Column) -> Column:
        letters = lambda word, low: bound(said(low, F.length(word)), lambda c: F.when(word.rlike(r"^\p{Lu}"), capital(t, i, word, low, c)).otherwise(F.concat(c, c, low)))
        return bound(F.regexp_extract(t, ITS_WORD, 0), lambda word: bound(F.lower(word), lambda low: letters(word, low)))

    return F.transform(every(sentence["text"], TOKEN), one)


def units_of(text: Column) -> Column:
    """The sentences of a block: array of (start, end, fr, en, block_fr, block_en, content); sums are half points of the sentence and of what it adds to its block, content is what ``told`` says of words that a lexicon may be asked about."""
    def row(cut: Column) -> Column:
        def placed(x: Column, i: Column) -> Column:
            space = F.left(x["text"], F.length(x["text"]) - F.length(F.ltrim(x["text"], F.lit(SPACES))))
            own = F.btrim(x["text"], F.lit(SPACES))
            tail = F.when(i == 0, F.lit("")).otherwise(F.regexp_extract(F.get(cut, i - 1)["text"], LAST_END, 0))
            start = (x["start"] + F.length(space)).cast("int")
            return bound(F.struct(start.alias("start"), own.alias("text"), F.concat(tail, space).alias("lead")), lambda s: bound(told(s, i == 0), lambda words: summed(s, words)))

        return F.transform(cut, placed)

    def summed(s: Column, words: Column) -> Column:
        heads = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
        within = lambda h: F.concat(F.coalesce(F.substring(F.get(words, F.lit(0)), 2, 1), F.lit("")), F.substr(h, F.lit(2)))
        count = lambda h, others: F.length(F.translate(h, others, ""))
        fr, en = (lambda h: 2 * count(h, "eabop-") + count(h, "efop-")), (lambda h: 2 * count(h, "fabop-"))
        both = lambda h, b: F.struct(
            s["start"].alias("start"), (s["start"] + F.length(s["text"])).cast("int").alias("end"), fr(h).alias("fr"), en(h).alias("en"), fr(b).alias("block_fr"), en(b).alias("block_en"),
            F.filter(words, lambda w: F.left(w, F.lit(1)).isin("a", "o") | F.substring(w, 2, 1).isin("a", "o")).alias("content"),
        )
        return bound(heads, lambda h: bound(within(h), lambda b: both(h, b)))

    cut = pieces_at(F.split(F.regexp_replace(F.translate(text, MARK, OTHER), SENTENCE_END, f"$1{MARK}$2$3"), MARK, -1))
    return bound(cut, row)


def sentence_language(blocks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The language of every sentence: doc_id, ord, sentence, start, end, language, by (whose evidence decided: sentence, block or document).

    A sentence without enough function words is judged by words that only one language's lexicon has (word, lang), then takes its block's language, which is found in the same
    way, then its document's. Every word is judged once, for its sentence and its block. Only words of undecided sentences and blocks ask the lexicon: they go to it in one stream with the
    sentences themselves, so no text is read twice.
    """
    judged_blocks = computed(blocks.where("doc_id IS NOT NULL"), ["doc_id", "ord"], s=units_of(F.col("text")))
    few = lambda fr, en: fr + en < 2 * MIN_EVIDENCE
    points = F.aggregate("s", F.lit(0), lambda a, u: a + u["block_fr"] + u["block_en"])
    judged_blocks = judged_blocks.select("doc_id", "ord", "s", (points < 2 * MIN_EVIDENCE).alias("open"))
    whole = F.col("open")
    sums = ["start", "end", "fr", "en", "block_fr", "block_en"]

    units = judged_blocks.select("doc_id", "ord", whole, (F.size("s") > 1).alias("many"), F.posexplode("s").alias("sentence", "u"))
    own = F.col("many") & few(F.col("u.fr"), F.col("u.en"))
    # the first row stands for the sentence itself
    words = F.concat(F.array(F.concat(F.lit(NO_WORD), F.col("doc_id").cast("string"))), F.when(own | whole, F.filter("u.content", lambda w: (own & F.left(w, F.lit(1)).isin("a", "o")) | (whole & F.substring(w, 2, 1).isin("a", "o")))).otherwise(F.array().cast("array<string>")))
    rows = units.select(*UNIT, own.alias("own"), whole.alias("whole"), *[F.col(f"u.{c}") for c in sums], F.posexplode(words).alias("k", "w"))
    head = lambda k: F.substring("w", k, 1).isin("a", "o")
    itself = F.col("k") == 0
    rows = rows.select(*UNIT, *[F.when(itself, F.col(c)).alias(c) for c in sums], (~itself & F.col("own") & head(1)).alias("own"), (~itself & F.col("whole") & head(2)).alias("whole"), F.when(itself, F.col("w")).otherwise(F.substr("w", F.lit(3))).alias("word"))
    asked = rows.join(lexicon.select("word", "lang"), "word", "left").where("start IS NOT NULL OR lang IS NOT NULL")
    more = [F.sum(F.when(F.col(side) & (F.col("lang") == lang), 2).otherwise(0)).alias(f"{side}_{lang}") for side in ("own", "whole") for lang in ("fr", "en")]
    found = asked.groupBy(*UNIT).agg(*[F.max(c).alias(c) for c in sums], *more)

    block, doc = Window.partitionBy("doc_id", "ord"), Window.partitionBy("doc_id")
    found = found.repartition("doc_id").withColumns({"n": F.count("*").over(block), **{f"b_{lang}": F.sum(F.col(f"block_{lang}") + F.col(f"whole_{lang}")).over(block) for lang in ("fr", "en")}})
    found = found.withColumns({f"d_{lang}": F.sum(f"block_{lang}").over(doc) for lang in ("fr", "en")})
    main = F.when((F.col("d_en") >= 2 * MIN_EVIDENCE) & (F.col("d_en") >= F.col("d_fr") * DOMINANCE), "en").otherwise("fr")
    found = found.select(*UNIT, "start", "end", F.when(F.col("n") > 1, decide(F.col("fr") + F.col("own_fr"), F.col("en") + F.col("own_en"))).alias("own"), decide(F.col("b_fr"), F.col("b_en")).alias("of_block"), main.alias("of_doc"))
    by = F.when(F.col("own").isNotNull(), "sentence").when(F.col("of_block").isNotNull(), "block").otherwise("document")
    return found.select(*UNIT, "start", "end", F.coalesce("own", "of_block", "of_doc").alias("language"), by.alias("by"))


def language_at(places: DataFrame, sentences: DataFrame) -> DataFrame:
    """Places (doc_id, ord, start, ...) with the language of the sentence that holds them, null between sentences.

    Both are put in one order by block, and a place takes the last sentence before it: one window, whatever their numbers.
    """
    marks = sentences.select("doc_id", "ord", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("end", "language").alias("s"), F.lit(None).cast(places.select(F.struct("*")).schema[0].dataType).alias("row"))
    asked = places.select("doc_id", "ord", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["s"].dataType).alias("s"), F.struct("*").alias("row"))
    last = F.last("s", True).over(Window.partitionBy("doc_id", "ord").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    rows = marks.union(asked).withColumn("s", last).where("kind = 1")
    return rows.select("row.*", F.when(F.col("at") < F.col("s.end"), F.col("s.language")).alias("language"))


def lexicon_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the documents of one language use at least twice and those of the other never do."""
    docs = source.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IN ('fr', 'en')").select("doc_id", "lang", "text"), "doc_id").select("lang", F.explode(every(F.lower("text"), LETTERS)).alias("word"))
    counts = docs.groupBy("word").agg(F.count_if(F.col("lang") == "fr").alias("fr"), F.count_if(F.col("lang") == "en").alias("en"))
    return counts.where("(fr >= 2 AND en = 0) OR (en >= 2 AND fr = 0)").select("word", F.when(F.col("fr") > 0, "fr").otherwise("en").alias("lang"))


def short_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' blocks without their commas, so that many sentences have too few function words, and some blocks cut to a few words."""
    return source.blocks(spark, sf_dir).withColumn("text", F.expr(SHORTENED))


#: For both engines.
SHORTENED = "CASE WHEN doc_id % 3 = 0 THEN replace(text, ', ', '. A') WHEN doc_id % 3 = 1 AND ord % 2 = 0 THEN substring(text, 1, 60) ELSE text END"


def located_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.operators import rules

    blocks = short_blocks(spark, sf_dir)
    return language_at(rules.repeated_word(blocks), sentence_language(blocks, lexicon_of(spark, sf_dir)))


def queries() -> dict:
    return {
        "block_language": lambda spark, sf: block_language(source.blocks(spark, sf)),
        "sentence_language": lambda spark, sf: sentence_language(short_blocks(spark, sf), lexicon_of(spark, sf)),
        "language_at_hits": located_hits,
    }


def _sentence_ctes() -> str:
    """Words of blocks and sentences as rows, with what each says."""
    from proofline.functions.text import sentences_sql

    q = lambda s: s.replace("'", "''")
    fr, en = (", ".join(f"'{w}'" for w in ws) for ws in (FRENCH, ENGLISH))
    return rf"""{source.SQL.replace("blocks AS", "lines AS")}, blocks AS (SELECT doc_id, ord, {SHORTENED} AS text FROM lines), {sentences_sql('blocks', 'doc_id, ord')},
    lx AS (SELECT word, CASE WHEN count(*) FILTER (lang = 'fr') > 0 THEN 'fr' ELSE 'en' END AS lang FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+(?:[''’]\p{{L}}+)*')) AS word FROM documents WHERE lang IN ('fr', 'en')) GROUP BY word HAVING count(*) >= 2 AND count(DISTINCT lang) = 1),
    u AS (SELECT doc_id, ord, -1 AS sentence, 0 AS start, text FROM blocks UNION ALL SELECT doc_id, ord, sentence, start, text FROM sentences),
    c AS (SELECT doc_id, ord, sentence, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (SELECT doc_id, ord, sentence, regexp_extract_all(text, '{q(PARTS)}') AS p FROM u)),
    b AS (SELECT *, lag(part) OVER (PARTITION BY doc_id, ord, sentence ORDER BY i) AS before FROM c),
    w AS (SELECT *, lower(part) AS low, i = 1 OR (i = 2 AND regexp_matches(before, '{q(OPENING)}')) OR regexp_matches(before, '{q(AFTER_END)}') AS opens FROM b WHERE regexp_matches(part, '{LETTER}')),
    k AS (SELECT * FROM w WHERE NOT (length(part) >= 2 AND regexp_matches(part, '^\p{{Lu}}+$')) AND NOT (regexp_matches(part, '^\p{{Lu}}') AND NOT opens)),
    e AS (SELECT doc_id, ord, sentence, low, CASE WHEN regexp_matches(low, '{q(ELIDED)}') THEN 'f' WHEN regexp_matches(low, '{q(CONTRACTED)}') THEN 'e' WHEN low IN ({fr}) THEN 'f' WHEN low IN ({en}) THEN 'e' WHEN regexp_matches(low, '{ACCENTED}') THEN 'a' ELSE 'o' END AS t FROM k),
    s AS (SELECT doc_id, ord, sentence, count(*) FILTER (t = 'f') * 2 + count(*) FILTER (t = 'a') AS fr, count(*) FILTER (t = 'e') * 2 AS en, count(*) FILTER (lx.lang = 'fr') * 2 AS mfr, count(*) FILTER (lx.lang = 'en') * 2 AS men
      FROM e LEFT JOIN lx ON lx.word = e.low AND t IN ('a', 'o') AND length(low) >= {MIN_CONTENT} GROUP BY doc_id, ord, sentence),
    a AS (SELECT u.*, coalesce(fr, 0) AS fr, coalesce(en, 0) AS en, CASE WHEN coalesce(fr + en, 0) < 4 THEN coalesce(fr + mfr, 0) ELSE fr END AS f2, CASE WHEN coalesce(fr + en, 0) < 4 THEN coalesce(en + men, 0) ELSE en END AS e2 FROM u LEFT JOIN s USING (doc_id, ord, sentence)),
    v AS (SELECT *, CASE WHEN f2 + e2 < 4 THEN NULL WHEN e2 >= 4 AND e2 >= 2 * f2 THEN 'en' WHEN f2 >= 4 AND f2 >= 2 * e2 THEN 'fr' ELSE 'uncertain' END AS own FROM a),
    d AS (SELECT doc_id, CASE WHEN sum(en) >= 4 AND sum(en) >= 2 * sum(fr) THEN 'en' ELSE 'fr' END AS of_doc FROM v WHERE sentence = -1 GROUP BY doc_id),
    n AS (SELECT doc_id, ord, count(*) AS n FROM sentences GROUP BY doc_id, ord),
    j AS (SELECT x.doc_id, x.ord, x.sentence, CAST(x.start AS INT) AS start, CAST(x.start + length(x.text) AS INT) AS fin, CASE WHEN n > 1 THEN x.own END AS own, z.own AS of_block, of_doc FROM v x JOIN v z ON z.doc_id = x.doc_id AND z.ord = x.ord AND z.sentence = -1 JOIN n ON n.doc_id = x.doc_id AND n.ord = x.ord JOIN d ON d.doc_id = x.doc_id WHERE x.sentence >= 0),
    told AS (SELECT doc_id, ord, CAST(sentence AS INT) AS sentence, start, fin, coalesce(own, of_block, of_doc) AS language, CASE WHEN own IS NOT NULL THEN 'sentence' WHEN of_block IS NOT NULL THEN 'block' ELSE 'document' END AS "by" FROM j)"""


def oracle_sql() -> dict[str, str]:
    q = lambda s: s.replace("'", "''")
    fr, en = (", ".join(f"'{w}'" for w in ws) for ws in (FRENCH, ENGLISH))
    from proofline.operators import rules

    hits = rules.repeated_word_sql(source.SQL.replace("blocks AS", "lines AS") + f", blocks AS (SELECT doc_id, ord, {SHORTENED} AS text FROM lines)")
    return {
        "sentence_language": f"""WITH {_sentence_ctes()} SELECT doc_id, ord, sentence, start, fin AS "end", language, "by" FROM told""",
        "language_at_hits": f"""WITH {_sentence_ctes()}, h AS ({hits}) SELECT h.*, language FROM h LEFT JOIN told t ON t.doc_id = h.doc_id AND t.ord = h.ord AND t.start <= h.start AND h.start < t.fin""",
        "block_language": rf"""WITH {source.SQL},
        c AS (SELECT doc_id, ord, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (SELECT doc_id, ord, regexp_extract_all(text, '{q(PARTS)}') AS p FROM blocks)),
        b AS (SELECT *, lag(part) OVER (PARTITION BY doc_id, ord ORDER BY i) AS before FROM c),
        w AS (SELECT doc_id, ord, part, lower(part) AS low, i = 1 OR (i = 2 AND regexp_matches(before, '{q(OPENING)}')) OR regexp_matches(before, '{q(AFTER_END)}') AS opens FROM b WHERE regexp_matches(part, '{LETTER}')),
        k AS (SELECT * FROM w WHERE NOT (length(part) >= 2 AND regexp_matches(part, '^\p{{Lu}}+$')) AND NOT (regexp_matches(part, '^\p{{Lu}}') AND NOT opens)),
        e AS (SELECT doc_id, ord, CASE WHEN regexp_matches(low, '{q(ELIDED)}') THEN 'f' WHEN regexp_matches(low, '{q(CONTRACTED)}') THEN 'e' WHEN low IN ({fr}) THEN 'f' WHEN low IN ({en}) THEN 'e' WHEN regexp_matches(low, '{ACCENTED}') THEN 'a' END AS t FROM k),
        s AS (SELECT doc_id, ord, count(*) FILTER (t = 'f') * 2 + count(*) FILTER (t = 'a') AS fr, count(*) FILTER (t = 'e') * 2 AS en FROM e GROUP BY doc_id, ord),
        a AS (SELECT doc_id, ord, CAST(coalesce(fr, 0) AS INT) AS fr, CAST(coalesce(en, 0) AS INT) AS en FROM blocks LEFT JOIN s USING (doc_id, ord)),
        d AS (SELECT doc_id, CASE WHEN sum(en) >= 4 AND sum(en) >= 2 * sum(fr) THEN 'en' ELSE 'fr' END AS whole FROM a GROUP BY doc_id)
        SELECT doc_id, ord, fr, en, CASE WHEN fr + en < 4 THEN whole WHEN en >= 4 AND en >= 2 * fr THEN 'en' WHEN fr >= 4 AND fr >= 2 * en THEN 'fr' ELSE 'uncertain' END AS language FROM a JOIN d USING (doc_id)""",
    }
