"""What a task holds stays bounded where its rows are many."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from proofline.llm import alignment, bpe, simhash


def test_groups_of_many_segments_are_read_in_portions():
    rng = random.Random(3)
    texts = [";".join(f"{rng.randrange(3000)},{rng.randrange(50)}|{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 3]))) if rng.random() > 0.01 else "" for _ in range(120_000)]
    tracemalloc.start()
    groups = alignment.Groups(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = sum(x.nbytes for x in (groups.pair, groups.times, groups.pairs, groups.bounds, groups.known, *groups.numbers.values()))
    assert peak < 4 * own
    few = alignment.Groups(texts[:3000])
    for k in (0, 17, 2999):
        i, j = groups.bounds[k : k + 2]
        a, b = few.bounds[k : k + 2]
        assert groups.pairs[groups.pair[i:j]].tolist() == few.pairs[few.pair[a:b]].tolist() and groups.times[i:j].tolist() == few.times[a:b].tolist()


def test_gathered_ids_stay_arrays():
    """Ids of a long text are put together without an object for each of them."""
    path, pattern = bpe.default_ranks()
    enc = bpe.encoder(path, pattern)
    ids = bpe.ids_of(enc, "some words to repeat " * 50)
    lists = bpe.ids_column([np.tile(ids, 2000), ids])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([5, 5], pa.int64()), "same": ["x", "x"], "k": pa.array([0, 1], pa.int32()), "ids": lists})
    tracemalloc.start()
    found = list(bpe.grouped([batch], ["k", "ids"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * lists.nbytes
    assert [(k, len(x)) for _, rows in found for k, x in rows] == [(0, 2000 * len(ids)), (1, len(ids))]


def test_ids_decoded_where_they_are_made(spark):
    """One chunk or many, repeated and missing texts: the same rows as by a second worker."""
    texts = [None, "", "short text", "many words é 中文 \n\t " * 40, "many words é 中文 \n\t " * 40, " " * 300 + "x"]
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = [sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in df.collect()) for df in (bpe.encode(docs, chunk=64, overlap=32, decoded=True), bpe.decode(bpe.encode(docs, chunk=64, overlap=32)))]
    assert rows[0] == rows[1] and sorted(r[2].decode() for r in rows[0]) == sorted(t or "" for t in texts)


def test_keys_of_fingerprints_are_never_broadcast(spark):
    """A small table of fingerprints gives very many keys, which Spark sizes by that table."""
    different = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    close = different.select(F.col("fp").bitwiseXOR(F.lit(3)).alias("fp"))
    found = simhash.members(different.union(close))
    assert found.count() > 0
    counted = found.groupBy().count()
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
