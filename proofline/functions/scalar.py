"""Small functions on names, titles, sizes and times, each as one expression that Spark and DuckDB read alike where they can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_filename(name: Column) -> Column:
    """The last part of a path without control characters and signs that file systems refuse; a name stays for an empty one."""
    last = F.regexp_replace(F.regexp_replace(name, r"^.*[\\/]", ""), r'[\x00-\x1f<>:"|?*]', "")
    short = F.trim(F.substring(F.trim(last), 1, 120))
    return F.when(short == "", "document.docx").otherwise(short)


def corrected_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(clean_filename(name), r"(?i)\.docx$", ""), F.lit("-corrigé.docx"))


def match_case(word: Column, like: Column) -> Column:
    """The word with a capital if the other one begins with a capital; the rest stays as it is."""
    return F.when(like.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1000))).otherwise(word)


def size_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" o"))).when(n < 1 << 20, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" Ko"))).otherwise(F.concat(F.floor(n / (1 << 20) + 0.5).cast("string"), F.lit(" Mo")))


def duration_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s"))).when(seconds % 60 == 0, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min "), (seconds % 60).cast("string"), F.lit(" s")))


def first_words(text: Column, n: int) -> Column:
    """A bounded beginning that ends between words, with an ellipsis if something is left out."""
    cut = F.regexp_replace(F.substring(text, 1, n), r"\s+\S*$", "")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("…")))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: their names and sizes as they would be shown."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size")
    path = F.concat(F.lit("a/b\\"), "p_name", F.lit("?.DOCX"))
    return parts.select(
        "p_partkey", clean_filename(path).alias("name"), corrected_name(path).alias("corrected"), match_case(F.col("p_name"), F.col("p_type")).alias("cased"),
        size_text(F.col("p_size").cast("long") * 40_000).alias("size"), duration_text(F.col("p_size") * 7).alias("duration"), first_words(F.concat_ws(" ", "p_type", "p_name"), 20).alias("short"),
    )


def queries() -> dict:
    return {"file_names": names}


def oracle_sql() -> dict[str, str]:
    clean = r"""trim(regexp_replace(regexp_replace('a/b\' || p_name || '?.DOCX', '^.*[\\/]', ''), '[\x00-\x1f<>:"|?*]', '', 'g'))"""
    n = "CAST(p_size AS BIGINT) * 40000"
    s = "p_size * 7"
    t = "concat_ws(' ', p_type, p_name)"
    return {
        "file_names": rf"""SELECT p_partkey, {clean} AS name, regexp_replace({clean}, '(?i)\.docx$', '') || '-corrigé.docx' AS corrected,
          CASE WHEN regexp_matches(p_type, '^\p{{Lu}}') THEN upper(p_name[1]) || substring(p_name, 2) ELSE p_name END AS cased,
          CASE WHEN {n} < 1024 THEN {n} || ' o' WHEN {n} < 1048576 THEN CAST(floor({n} / 1024 + 0.5) AS BIGINT) || ' Ko' ELSE CAST(floor({n} / 1048576 + 0.5) AS BIGINT) || ' Mo' END AS size,
          CASE WHEN {s} < 60 THEN {s} || ' s' WHEN {s} % 60 = 0 THEN {s} // 60 || ' min' ELSE {s} // 60 || ' min ' || {s} % 60 || ' s' END AS duration,
          CASE WHEN length({t}) <= 20 THEN {t} ELSE regexp_replace(substring({t}, 1, 20), '\s+[^\s]*$', '') || '…' END AS short FROM part"""
    }
