"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.shared import discard, materialize

MAX_ROUNDS = 60


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root): every id of the edges (a, b) with the smallest id of its component.

    Each round hands every node the smallest label among its neighbours, then follows labels one step further, so
    chains shrink by halves. Every round is written to the shared folder, which cuts its lineage. Nodes with very many edges are
    joined in parts (adaptive skew join) and their minima are formed before the shuffle. Edges with a null end are ignored.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = materialize(pairs.union(pairs.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), name)
    for _ in range(MAX_ROUNDS):
        near = both.join(labels, both["a"] == labels["id"]).groupBy(F.col("b").alias("n")).agg(F.min("root").alias("m"))
        better = labels.join(near, labels["id"] == near["n"]).select("id", F.col("root").alias("old"), F.least("root", "m").alias("mid"))
        ahead = labels.select(F.col("id").alias("x"), F.col("root").alias("far"))
        moved = better.join(ahead, F.col("mid") == F.col("x")).select("id", "old", F.least("mid", "far").alias("root"))
        moved = materialize(moved, name)
        changed = not moved.where("root <> old").isEmpty()
        discard(labels)
        labels = moved.select("id", "root")
        if not changed:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
