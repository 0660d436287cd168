"""Chunks of about so many words that never split a block, and groups of neighbouring sections.

Packing depends on what was packed before, so it is a fold over a document's blocks in order; only their order and word
counts take part, and documents are independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.text import word_count, word_sql
from proofline.sources import text as source

# Words of a local chunk and of a context group, and the least words of a group.
LOCAL_WORDS, CONTEXT_WORDS, SMALL_WORDS = 1800, 2500, 300


def packed(blocks: DataFrame, most: int = LOCAL_WORDS) -> DataFrame:
    """doc_id, ord, n_words and chunk (from 0)."""
    counted = blocks.select("doc_id", F.struct("ord", word_count(F.col("text")).alias("n")).alias("b"))
    per_doc = counted.groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    state = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("words"), F.array().cast("array<int>").alias("chunks"))

    def step(a, b):
        full = (a["words"] > 0) & (a["words"] + b["n"] > most)
        chunk = a["chunk"] + full.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(full, b["n"]).otherwise(a["words"] + b["n"]).alias("words"), F.concat(a["chunks"], F.array(chunk)).alias("chunks"))

    chunks = F.aggregate("b", state, step, lambda a: a["chunks"])
    rows = per_doc.withColumn("chunks", chunks).select("doc_id", F.explode(F.arrays_zip("b", "chunks")).alias("z"))
    first = rows.select("doc_id", F.col("z.b.ord").alias("ord"), F.col("z.b.n").alias("n_words"), F.col("z.chunks").alias("chunk"))
    return first


def chunk_sizes(blocks: DataFrame) -> DataFrame:
    """Chunks with their size, their first block, and the block before it, which is their context."""
    sizes = packed(blocks).groupBy("doc_id", "chunk").agg(F.count("*").alias("n_blocks"), F.sum("n_words").alias("n_words"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    before = F.lag("last_ord").over(Window.partitionBy("doc_id").orderBy("chunk"))
    return sizes.withColumn("context_ord", before).drop("last_ord")


def queries() -> dict:
    return {"local_chunks": lambda spark, sf: chunk_sizes(source.blocks(spark, sf))}


def oracle_sql() -> dict[str, str]:
    return {
        "local_chunks": f"""WITH RECURSIVE {source.SQL},
        c AS (SELECT doc_id, ord, len(regexp_extract_all(text, '{word_sql()}')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM blocks),
        f AS (SELECT doc_id, ord, n, k, 0 AS chunk, n AS words FROM c WHERE k = 1
          UNION ALL SELECT c.doc_id, c.ord, c.n, c.k, CASE WHEN f.words > 0 AND f.words + c.n > {LOCAL_WORDS} THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.words > 0 AND f.words + c.n > {LOCAL_WORDS} THEN c.n ELSE f.words + c.n END
          FROM f JOIN c ON c.doc_id = f.doc_id AND c.k = f.k + 1)
        SELECT doc_id, CAST(chunk AS INT) AS chunk, count(*) AS n_blocks, CAST(sum(n) AS BIGINT) AS n_words, min(ord) AS first_ord, lag(max(ord)) OVER (PARTITION BY doc_id ORDER BY chunk) AS context_ord FROM f GROUP BY doc_id, chunk""",
    }
