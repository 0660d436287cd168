"""What is learned from the corpus is learned from all of it."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proofline.llm import decontaminate as d

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "mnrst"]


def texts(n, seed=4):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    return [" ".join(rng.choices(WORDS, weights, k=rng.choice([5, 23, 24, 25, 130, 400]))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_decontamination_learns_from_every_document(spark, monkeypatch):
    """The cosines don't depend on a number of documents to learn from."""
    docs, items = texts(60), [t for t in texts(40, 8) if 20 < t.count(" ") < 130][:6]
    docs[7] += " " + items[0]
    docs[50] += " " + items[1]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(d, "EXTRA_RANK", 4)
    found = []
    for most in (10_000, 5):
        monkeypatch.setattr(d, "FIT_DOCS", most, raising=False)
        found.append({(r["doc_id"], r["item_id"]): r["cosine"] for r in d.find(table(spark, docs), benchmark).collect()})
    assert {(7, 0), (50, 1)} <= found[0].keys() and found[0] == pytest.approx(found[1], rel=1e-6)


@pytest.mark.parametrize("cells", [1 << 24, 4000])
def test_sums_of_terms_equal_whole_matrix(spark, cells):
    """A'A basis by stored terms, for frequent and rarer terms, in tables and as keys, against a dense matrix over every passage."""
    docs = [*texts(60), "", "none of these"]
    vocabulary = d.Vocabulary.of(d.word_hashes(texts(3, 8)))
    size = len(vocabulary.hashes)
    idf, weights = np.random.default_rng(1).uniform(1, 5, size), [2.0 if k % 2 else 1.0 for k in range(len(docs))]
    want = np.zeros((size, size))
    for text, weight in zip(docs, weights, strict=True):
        words = d.word_hashes([text])[0]
        for a in range(0, max(1, len(words)), d.STRIDE):
            row = np.bincount(vocabulary.find(words[a : a + 2 * d.STRIDE])[1], minlength=size)
            want += weight**2 / max(row @ idf**2, 1e-9) * np.outer(row * idf, row * idf)
    top, basis = np.argsort(idf)[: size // 3], np.random.default_rng(2).standard_normal((size, 7))
    stored = table(spark, docs).withColumn("w", F.when(F.col("doc_id") % 2 == 1, 2.0).otherwise(1.0))
    parts = [stored.where(f"w = {w}").select("text").mapInArrow(d.store_terms(vocabulary), d.STORED).withColumn("weight", F.lit(w)) for w in (1.0, 2.0)]
    shares = parts[0].unionByName(parts[1]).mapInArrow(d.together(idf, top, cells), d.TOGETHER)
    sums = shares.repartition("row").sortWithinPartitions("row").mapInArrow(d.merged(size), d.TOGETHER)
    got = d.summed(sums.mapInArrow(d.product(basis, top), "row int, vector binary"), basis.shape)
    assert np.allclose(got, want @ basis, rtol=1e-5, atol=1e-4 * abs(want).max())


def test_pipeline_decontamination_learns_from_every_document(spark, tmp_path, monkeypatch):
    """The pipeline's stage over more documents than a sample would take: its cosines are those of a dense model of every passage."""
    docs, items = texts(24_000, 5), [t for t in texts(80, 8) if 20 < t.count(" ") < 130][:12]
    docs = [t if len(t.split()) < 100 else " ".join(t.split()[:60]) for t in docs]
    planted = {(2_000 * k + 17, k) for k in range(len(items))}
    for doc, item in planted:
        docs[doc] = items[item] + " " + docs[doc]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hits, located = [], d.located
    monkeypatch.setattr(d, "EXTRA_RANK", 4)
    monkeypatch.setattr(d, "located", lambda *a, **o: hits.append(located(*a, **o)) or hits[-1])
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, table(spark, docs), str(tmp_path)).select("doc_id").collect()}
    found = {(r["doc_id"], r["item_id"]): r["cosine"] for r in hits[0].collect()}

    vocabulary = d.Vocabulary.of(d.word_hashes(items))
    size = len(vocabulary.hashes)

    def rows(text):
        words = d.word_hashes([text])[0]
        return [np.bincount(vocabulary.find(words[a : a + 2 * d.STRIDE])[1], minlength=size) for a in range(0, max(1, len(words)), d.STRIDE)]

    held, own = np.array([r for t in docs for r in rows(t)]), np.array([r for t in items for r in rows(t)])
    idf = np.log((2.0 + len(held)) / (1.0 + (held > 0).sum(axis=0)))

    def scaled(a):
        return a * idf / np.sqrt(np.maximum(a @ idf**2, 1e-9))[:, None]

    weight = np.sqrt(len(held) / len(items)) + 1
    both = np.concatenate([scaled(held), scaled(own) * weight])
    basis = np.random.default_rng(d._SEED).standard_normal((size, len(items) + 4))
    for _ in range(1 + d.POWER):
        basis = np.linalg.qr(both.T @ (both @ basis))[0]

    def unit(a):
        a = a @ (basis * idf[:, None])
        return a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-6)

    want = {}
    for doc, item in found:
        words = d.word_hashes([items[item]])[0]
        queries = [np.bincount(vocabulary.find(words[a : a + 2 * d.STRIDE])[1], minlength=size) for a in range(0, max(1, len(words) - d.STRIDE), d.STRIDE)]
        want[doc, item] = float((unit(np.array(rows(docs[doc]))) @ unit(np.array(queries)).T).max())
    assert len(items) == 12 and size > 2 * basis.shape[1] and planted <= found.keys()
    assert kept == set(range(len(docs))) - {doc for doc, _ in found}
    assert {k: found[k] for k in planted} == pytest.approx({k: want[k] for k in planted}, abs=1e-5)
