"""Rules on very long blocks, gaps between runs, and texts that hold the library's own marks."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import rules


def blocks(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, ord int, text string")


def test_long_block_with_many_hits(spark):
    """1.1 million characters, 100,000 repeats and a run of 200,000 characters: linear, so it ends within seconds."""
    text = "le le chat " * 100_000 + "x" * 200_000 + ",,"
    began = time.time()
    rows = rules.every_hit(blocks(spark, text))
    got = {r["rule"]: (r["n"], r["last"]) for r in rows.groupBy("rule").agg(F.count("*").alias("n"), F.max("start").alias("last")).collect()}
    assert got["repeated_word"] == (100_000, 99_999 * 11) and got["doubled_punctuation"] == (1, 1_300_000)
    assert time.time() - began < 90


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        row = spark.range(1).select(T.running(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("int"))) if n else T.running(F.array().cast("array<int>"))).first()[0]
        assert row == [k * (k + 1) // 2 for k in range(n)]


def test_protected_runs_and_marks(spark):
    found = rules.every_hit(blocks(spark, "a/b,,c le  a.b  le", f"le{T.MARK} le le{T.FILL} le", f"mot {T.MARK},, la la", "un a@b,,c un un.fr un")).collect()
    # double spaces next to a protected run don't count, nor anything inside one
    assert sorted((r["ord"], r["rule"], r["start"], r["original"]) for r in found) == [(1, "repeated_word", 4, "le le"), (2, "doubled_punctuation", 5, ",,"), (2, "repeated_word", 8, "la la")]


def test_gaps_between_runs(spark):
    text = "le le , mot  mot,,fin"
    schema = "doc_id long, ord int, text string, runs array<struct<run_index:int,start:int,end:int>>"
    runs = [[(0, 0, 10), (1, 10, 21)], [(0, 0, 4), (2, 4, 21)], [(0, 0, 13), (1, 14, 21)], [], [(3, 0, 21)]]
    found = rules.every_hit(spark.createDataFrame([(1, k, text, r) for k, r in enumerate(runs)], schema)).collect()
    by = {k: sorted((r["start"], r["rule"]) for r in found if r["ord"] == k) for k in range(5)}
    every = [(0, "repeated_word"), (3, "space_before_punctuation"), (8, "repeated_word"), (11, "double_space"), (16, "doubled_punctuation")]
    assert by[0] == by[4] == every and by[3] == []
    assert by[1] == [x for x in every if x[0] not in (0, 3)] and by[2] == [x for x in every if x != (8, "repeated_word")]
