"""Costly columns are computed once a row, where they are asked for, and not again below a shuffle for a condition on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import beautify, grammar, lexicon, names, rules
from proofline.sources import text as source

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def below_shuffle(plan: str) -> str:
    return plan[plan.index("RepartitionByExpression") :]


def test_edits_compute_texts_once(spark):
    blocks = source.blocks(spark, SF).repartition(3, "doc_id", "ord")
    plan = plan_of(beautify.edits(blocks).selectExpr("doc_id", "explode(edits) AS e"))
    assert plan.count(T.PROTECTED_RUN) == 1 and T.PROTECTED_RUN not in below_shuffle(plan)


def test_rules_compute_texts_once(spark):
    blocks = source.blocks(spark, SF).repartition(3, "doc_id", "ord")
    for found in (rules.every_hit(blocks), rules.typography(blocks)):
        plan = plan_of(found.where("start >= 0"))
        assert plan.count(T.PROTECTED_RUN) == 1 and T.PROTECTED_RUN not in below_shuffle(plan)


def test_beautified_long_block(spark):
    """20,000 changes in a block of 240,000 characters."""
    import time

    text = "Un mot deux ! " * 20_000
    began = time.time()
    row = beautify.beautified(spark.createDataFrame([(1, 0, text)], "doc_id long, ord int, text string")).first()
    assert row["after"] == text.replace(" !", "\u00a0!") and row["n_edits"] == 20_000
    assert time.time() - began < 120


def test_pairs_beyond_the_cost_are_left_out_early(spark):
    """No pair that ``ranked`` would take is lost, most of the others go, and words are read for both joins only."""
    words = ["maisno", "mason", "maison", "chato", "chateau", "château", "eleve", "élève", "regel", "regle", "règle", "aa", "a", "tems", "temps", "xxxxx", "bonjuor", "bonjour", "ecole", "école", "sso", "os", "qsdf", "wxcv", "abcdef", "bacdfe", "fedcba"]
    every = spark.createDataFrame([(a, b) for a in words for b in words if a != b], "word string, candidate string").withColumn("cost", lexicon.weighted_distance("word", "candidate"))
    rows = every.select("word", "candidate", "cost", lexicon.may_fit(F.col("word"), F.col("candidate")).alias("may"), (F.col("cost") <= lexicon.most_cost(F.col("word"))).alias("fits")).collect()
    assert any(r["fits"] for r in rows) and all(r["may"] for r in rows if r["fits"]) and sum(r["may"] for r in rows) < len(rows) / 4
    texts = spark.createDataFrame([("La maisno est belle",)], "text string")
    found = lexicon.misspelling(texts, spark.createDataFrame([("maison", 5.0)], "word string, zipf double"))
    assert [(r["word"], r["n"], r["suggestion"]) for r in found.collect()] == [("maisno", 1, "maison")]
    assert plan_of(found).count("regexp_extract_all") == 2


def test_capital_words_cut_texts_once(spark):
    plan = plan_of(names.capital_words(source.blocks(spark, SF).repartition(3, "doc_id", "ord")))
    assert plan.count(T.SENTENCE_END) == 1


def test_findings_leave_their_text_behind(spark):
    """Windows over findings hold no texts of blocks: a block of many findings would be copied for each."""
    blocks = spark.createDataFrame([(1, 0, "Voici un. Les-autres mot mot")], "doc_id long, ord int, text string")
    found = grammar.mapped(spark.createDataFrame([(1, 0, 21, 28, "r_a1_1", "gn", ["mot"])], "doc_id long, ord int, start int, stop int, rule string, kind string, suggestions array<string>"), blocks)
    assert [(r["start"], r["confidence"], r["suggestion"]) for r in found.collect()] == [(21, "high", "mot")]
    plan = plan_of(found)
    assert "text#" not in plan[: plan.rindex("Window")].split("Generate")[0]
