r"""Operator 10, license scans: an exact set-similarity join of text blocks with license templates.

A block is a line, or a stretch of words over consecutive lines (lines without a word left out), so that a wrapped notice is found:
of n words in a template, at most n - 2 are on the lines between, and at most n - 1 of the first and of the last line count. The join finds every block whose distinct words hold at least ``CONTAINMENT`` of a template's
distinct words. Template words are ordered by how many documents hold them, rarest first; a match must hold one of
the first ``m - need + 1`` words of a template (prefix filter), enough words of any template (length filter) and leave
room for the rest behind that word (positional filter). Only then are the sets compared.
Besides, the words of three phrases are located in the whole text (the base labels).

The template index is a constant of this module, some dozens of rows whatever the corpus, so it is
broadcast. The corpus is read and normalised once: base counts and each document's template words are written, with the text of those
documents only that hold enough words of some template (what a block can't do without). Frequencies and the join come from that table.

Defined results: a null text is empty, without words, labels or score. Documents with equal doc_id and text get equal
results, each row once. Words beyond ASCII stay as they are.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.quality import _sql_string
from proofline.llm.shared import documents, materialize, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices by which public licenses ask to be named, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def template_tokens() -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(re.findall(WORD, text.lower())))) for label, text in TEMPLATES]


def template_sizes() -> list[int]:
    """The words of each template, repeated ones too."""
    return [len(re.findall(WORD, text.lower())) for _, text in TEMPLATES]


def need_of(m: int, containment: float = CONTAINMENT) -> int:
    """The least overlap with a template of m words, in whole words."""
    return next(k for k in range(1, m + 1) if k >= containment * m)


def normal(text: Column) -> Column:
    """The words of a text, each between two spaces of its own, so neighbours never share a delimiter."""
    spaced = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NO_WORD, " "))
    return F.when(spaced == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(spaced, F.lit(" "), F.lit("  ")), F.lit(" ")))


def n_words_in(norm: Column) -> Column:
    return ((F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))) / 2).cast("long")


def distinct_words(norm: Column) -> Column:
    return F.array_distinct(F.split(F.trim(norm), " +"))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def all_tokens() -> list[str]:
    return sorted({t for _, tokens in template_tokens() for t in tokens})


def ranked_vocabulary(known: DataFrame) -> list[str]:
    """All template words by the number of documents that hold them (column ``known``), rarest first, then by the word.

    The result is as long as the templates' vocabulary, whatever the corpus.
    """
    found = known.select(F.explode("known").alias("token"))
    counts = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(all_tokens(), key=lambda t: (counts.get(t, 0), t))


def can_match(known: Column) -> Column:
    """Whether a document with these template words can hold a block that meets the threshold (length filter of the whole text)."""
    return reduce(Column.__or__, [F.size(F.array_intersect(strings(tokens), known)) >= need_of(len(tokens)) for _, tokens in template_tokens()])


def template_index(vocabulary: list[str]) -> list[tuple[str, int, int, list[str], str, int]]:
    """(prefix word, its place, need, template words in order, label, template) for each prefix word."""
    rank = {t: i for i, t in enumerate(vocabulary)}
    rows = []
    for number, (label, tokens) in enumerate(template_tokens()):
        ordered, need = sorted(tokens, key=rank.__getitem__), need_of(len(tokens))
        rows += [(t, p, need, ordered, label, number) for p, t in enumerate(ordered[: len(ordered) - need + 1])]
    return rows


def blocks_of(docs: DataFrame, prefix: Column, keys: list[str]) -> DataFrame:
    """The lines near a prefix word, and the stretches over lines that begin there: keys, head, inner, tail and whether it is a stretch."""
    longest = max(template_sizes())
    lines = F.transform(F.split("text", "\n"), lambda x: F.split(F.trim(normal(x)), " +"))
    docs = docs.select(*keys, F.filter(lines, lambda w: F.get(w, F.lit(0)) != "").alias("lines"))
    near = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.arrays_overlap(F.flatten(F.slice("lines", i, F.lit(longest))), prefix))
    ahead = docs.select(*keys, F.explode(F.transform(near, lambda i: F.slice("lines", i, F.lit(longest)))).alias("ahead"))
    ahead = ahead.select(*keys, "ahead", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("n_lines"))
    over = F.col("n_lines") > 1
    return ahead.select(
        *keys,
        F.get("ahead", F.lit(0)).alias("head"),
        F.flatten(F.slice("ahead", F.lit(2), F.greatest(F.col("n_lines") - 2, F.lit(0)))).alias("inner"),
        F.when(over, F.get("ahead", F.col("n_lines") - 1)).otherwise(F.array().cast("array<string>")).alias("tail"),
        over.alias("over"),
    ).where(F.size("inner") <= longest - 2)


def containment_join(blocks: DataFrame, vocabulary: list[str], keys: list[str]) -> DataFrame:
    """Every (block, template) at or over the threshold: keys, label, containment.

    ``blocks`` has the keys and the columns of ``blocks_of``.
    """
    spark = blocks.sparkSession
    rows = [(*r, template_sizes()[r[-1]]) for r in template_index(vocabulary)]
    index = spark.createDataFrame(rows, "token string, p int, need int, tokens array<string>, label string, template int, n int")
    prefix = strings(sorted({r[0] for r in rows}))
    known = blocks.select("*", F.array_intersect(strings(vocabulary), F.concat("head", "inner", "tail")).alias("known")).where(F.arrays_overlap("known", prefix))
    candidates = known.select("*", F.posexplode("known").alias("q", "token")).join(F.broadcast(index), "token")
    m, size, n = F.size("tokens"), F.size("known"), F.col("n")
    fits = (size >= F.col("need")) & (1 + F.least(m - F.col("p") - 1, size - F.col("q") - 1) >= F.col("need")) & (F.size("inner") <= n - 2)
    head = F.slice("head", F.greatest(F.size("head") - n + 2, F.lit(1)), n - 1)
    words = F.when(F.col("over"), F.concat(head, F.col("inner"), F.slice("tail", F.lit(1), n - 1))).otherwise(F.col("head"))
    overlap = F.size(F.array_intersect("tokens", words))
    return candidates.where(fits).where(overlap >= F.col("need")).select(*keys, "label", (overlap / m).alias("containment"))


def base_counts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, k1, k2 (hashes of the text), the base columns, ``known`` (template words), and ``text`` where a block can match."""
    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("norm", normal(F.col("text"))).withColumn("n_words", n_words_in(F.col("norm")))
    places, firsts, lasts, names = [], [], [], []
    for phrase, label in PHRASES.items():
        spaced, length = " " + phrase.replace(" ", "  ") + " ", len(phrase.split())
        n = ((F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(spaced), F.lit("")))) / F.lit(len(spaced))).cast("long")
        has = F.contains(F.col("norm"), F.lit(spaced))
        places.append(F.when(has, n).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(has, n_words_in(F.substring_index("norm", spaced, 1))))
        lasts.append(F.when(has, F.col("n_words") - n_words_in(F.substring_index("norm", spaced, -1)) - F.lit(length)))
        names.append(F.when(has, F.lit(label)))
    counted = base.select(
        "doc_id",
        F.xxhash64("text").alias("k1"),
        F.crc32(F.encode("text", "utf-8")).alias("k2"),
        "text",
        "n_words",
        sum(places[1:], places[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*names))).alias("base"),
        F.array_intersect(strings(all_tokens()), distinct_words(F.col("norm"))).alias("known"),
    )
    return counted.withColumn("text", F.when(can_match(F.col("known")), F.col("text")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    counted = materialize(base_counts(docs), "license-base")
    vocabulary = ranked_vocabulary(counted)
    prefix = strings(sorted({r[0] for r in template_index(vocabulary)}))
    keys = ["doc_id", "k1", "k2"]
    near = counted.where("text IS NOT NULL").select(*keys, "text")
    hits = containment_join(blocks_of(near, prefix, keys), vocabulary, keys)
    found = hits.groupBy(*keys).agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    found = found.withColumnsRenamed({"doc_id": "hit_id", "k1": "h1", "k2": "h2"})
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    joined = counted.drop("text", "known").join(found, same, "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))


def sql() -> dict[str, str]:
    rows = ", ".join(f"({i}, '{label}', [{', '.join(map(_sql_string, tokens))}], {need_of(len(tokens))})" for i, (label, tokens) in enumerate(template_tokens()))
    words = lambda c: f"regexp_extract_all(translate({c}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    at = lambda ws: " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws))
    per = [f"SELECT r, i, '{label}' AS label FROM p WHERE {at(phrase.split())}" for phrase, label in PHRASES.items()]
    query = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, {words('t')} AS w FROM d),
    p AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM w),
    b AS ({' UNION ALL '.join(per)}),
    b2 AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM b GROUP BY r),
    l AS (SELECT r, list_distinct({words('line')}) AS x FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
    m AS (SELECT r, label, len(list_intersect(x, tokens)) AS o, len(tokens) AS m, need FROM l, (VALUES {rows}) AS tpl(n, label, tokens, need)),
    m2 AS (SELECT r, list(DISTINCT label) AS found, max(o / m) AS best FROM m WHERE o >= need GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
      CAST(greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0)) AS DOUBLE) AS score
    FROM w LEFT JOIN b2 USING (r) LEFT JOIN m2 USING (r)"""
    return {"op10_license_scan": query}
