"""Counts of words, numbers and paragraphs of the block table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.text import ELISION, NUMBER, PROTECTED, SPACE, WORD, every, word_count, word_sql
from proofline.sources import text as source


def word_frequency(blocks: DataFrame) -> DataFrame:
    """How often each word stands in each document; behind an elision the word is counted by itself too."""
    words = blocks.select("doc_id", F.explode(F.transform(every(F.col("text"), WORD), F.lower)).alias("word"))
    inner = F.regexp_extract("word", ELISION, 1)
    both = words.select("doc_id", F.explode(F.when(inner != "", F.array("word", inner)).otherwise(F.array("word"))).alias("word"))
    return both.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def block_words(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "ord", word_count(F.col("text")).alias("n_words"))


def number_share(blocks: DataFrame) -> DataFrame:
    words = every(F.col("text"), WORD)
    summed = blocks.groupBy("doc_id").agg(F.sum(F.size(words)).alias("n_words"), F.sum(F.size(F.filter(words, lambda w: w.rlike(NUMBER)))).alias("n_numbers"))
    return summed.withColumn("share", F.when(F.col("n_words") == 0, 0.0).otherwise(F.col("n_numbers") / F.col("n_words")))


def protected_runs(blocks: DataFrame) -> DataFrame:
    """Addresses, paths, file names and code per block: how many, and how long together."""
    runs = F.filter(every(F.col("text"), rf"[^{SPACE}]+"), lambda r: r.rlike(PROTECTED))
    found = blocks.select("doc_id", "ord", runs.alias("runs")).where(F.size("runs") > 0)
    return found.select("doc_id", "ord", F.size("runs").cast("int").alias("n"), F.length(F.array_join("runs", "")).cast("int").alias("n_chars"))


def first_of_repeats(blocks: DataFrame) -> DataFrame:
    """Blocks of a document that aren't a repetition of an earlier one, numbered in order."""
    own = Window.partitionBy("doc_id", F.trim("text")).orderBy("ord")
    kept = blocks.withColumn("k", F.row_number().over(own)).where("k = 1")
    return kept.select("doc_id", "ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("paragraph"))


def queries() -> dict:
    b = source.blocks
    return {
        "block_word_count": lambda spark, sf: block_words(b(spark, sf)),
        "doc_word_freq": lambda spark, sf: word_frequency(b(spark, sf)),
        "numeric_share": lambda spark, sf: number_share(b(spark, sf)),
        "protected_runs": lambda spark, sf: protected_runs(b(spark, sf)),
        "paragraph_number": lambda spark, sf: first_of_repeats(b(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    words = f"regexp_extract_all(text, '{word_sql()}')"
    elision = ELISION.replace("'", "''")
    return {
        "block_word_count": f"WITH {source.SQL} SELECT doc_id, ord, CAST(len({words}) AS INT) AS n_words FROM blocks",
        "doc_word_freq": f"""WITH {source.SQL}, w AS (SELECT doc_id, lower(unnest({words})) AS word FROM blocks),
          e AS (SELECT doc_id, word FROM w UNION ALL SELECT doc_id, regexp_extract(word, '{elision}', 1) FROM w WHERE regexp_matches(word, '{elision}'))
          SELECT doc_id, word, count(*) AS n FROM e GROUP BY doc_id, word""",
        "numeric_share": f"""WITH {source.SQL}, w AS (SELECT doc_id, {words} AS w FROM blocks),
          s AS (SELECT doc_id, CAST(sum(len(w)) AS BIGINT) AS n_words, CAST(sum(len(list_filter(w, lambda x: regexp_matches(x, '{NUMBER}')))) AS BIGINT) AS n_numbers FROM w GROUP BY doc_id)
          SELECT *, CASE WHEN n_words = 0 THEN 0.0 ELSE n_numbers / n_words END AS share FROM s""",
        "protected_runs": f"""WITH {source.SQL}, r AS (SELECT doc_id, ord, list_filter(regexp_extract_all(text, '[^{SPACE}]+'), lambda x: regexp_matches(x, '{PROTECTED}')) AS r FROM blocks)
          SELECT doc_id, ord, CAST(len(r) AS INT) AS n, CAST(length(array_to_string(r, '')) AS INT) AS n_chars FROM r WHERE len(r) > 0""",
        "paragraph_number": f"""WITH {source.SQL}, k AS (SELECT doc_id, min(ord) AS ord FROM blocks GROUP BY doc_id, trim(text))
          SELECT doc_id, ord, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS INT) AS paragraph FROM k""",
    }
