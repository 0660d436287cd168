"""Work that can be resumed: context groups of sections, what is still to do, the steps shown to a user, and when a failing service is given up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.functions.text import word_count, word_sql
from proofline.operators.structure import _section_ctes, sections, typed_blocks
from proofline.plans.chunks import CONTEXT_WORDS, SMALL_WORDS

# Attempts of a chunk over all runs, failures in a row after which a service is given up, and the steps in order.
MOST_ATTEMPTS, BREAKER = 4, 3
STEPS = ["extract", "local", "context", "global", "finalize"]
RUNNING = {"EXTRACTING": 1, "ANALYZING_LOCAL": 2, "ANALYZING_CONTEXT": 3, "ANALYZING_GLOBAL": 4, "FINALIZING": 5}


def context_groups(blocks: DataFrame, most: int = CONTEXT_WORDS, least: int = SMALL_WORDS) -> DataFrame:
    """Groups of neighbouring sections: doc_id, ord, section, group (from 1).

    Sections are joined until there are ``least`` words; one that doesn't fit any more begins a group, and one of over ``most`` words is cut between
    blocks. Both are folds, over a document's sections and over a long section's blocks; neither holds any text.
    """
    own = sections(blocks).where("section >= 0").join(blocks.where("kind <> 'toc_entry'").select("doc_id", "ord", word_count(F.col("text")).alias("n")), ["doc_id", "ord"])
    per = own.groupBy("doc_id", "section").agg(F.sum("n").cast("int").alias("words"), F.array_sort(F.collect_list(F.struct("ord", "n"))).alias("blocks"))

    def cut(a: Column, b: Column) -> Column:
        full = (a["words"] > 0) & (a["words"] + b["n"] > most)
        part = a["part"] + full.cast("int")
        return F.struct(part.alias("part"), F.when(full, b["n"]).otherwise(a["words"] + b["n"]).alias("words"), F.concat(a["out"], F.array(F.struct(b["ord"].alias("ord"), part.alias("part")))).alias("out"))

    begin = F.struct(F.lit(0).alias("part"), F.lit(0).alias("words"), F.array().cast("array<struct<ord:int,part:int>>").alias("out"))
    whole = F.transform("blocks", lambda b: F.struct(b["ord"].alias("ord"), F.lit(0).alias("part")))
    per = per.withColumn("parts", F.when(F.col("words") > most, F.aggregate("blocks", begin, cut, lambda a: a["out"])).otherwise(whole))
    lists = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "words"))).alias("s"))

    def step(a: Column, s: Column) -> Column:
        long = s["words"] > most
        fresh = (a["words"] > 0) & ((a["words"] + s["words"] > most) | long)
        group = a["group"] + (fresh | (a["closed"])).cast("int")
        words = F.when(fresh, F.lit(0)).otherwise(a["words"]) + s["words"]
        closed = long | (words >= least)
        row = F.struct(s["section"].alias("section"), group.alias("group"))
        return F.struct(group.alias("group"), F.when(closed, 0).otherwise(words).alias("words"), closed.alias("closed"), F.concat(a["out"], F.array(row)).alias("out"))

    zero = F.struct(F.lit(1).alias("group"), F.lit(0).alias("words"), F.lit(False).alias("closed"), F.array().cast("array<struct<section:int,group:int>>").alias("out"))
    groups = lists.select("doc_id", F.explode(F.aggregate("s", zero, step, lambda a: a["out"])).alias("g")).select("doc_id", "g.*")
    rows = per.select("doc_id", "section", F.explode("parts").alias("p")).join(groups, ["doc_id", "section"])
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("group", "p.part"))
    return rows.select("doc_id", F.col("p.ord").alias("ord"), "section", number.alias("group"))


def _groups_sql() -> str:
    return f"""WITH RECURSIVE {_section_ctes()}, w AS (SELECT doc_id, ord, section, len(regexp_extract_all(text, '{word_sql()}')) AS n FROM sec JOIN blocks USING (doc_id, ord) WHERE kind <> 'toc_entry' AND section >= 0),
    s AS (SELECT doc_id, section, sum(n) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS k FROM w GROUP BY doc_id, section),
    f AS (SELECT doc_id, section, words, k, 1 AS g, CASE WHEN words > {CONTEXT_WORDS} OR words >= {SMALL_WORDS} THEN 0 ELSE words END AS pending, words > {CONTEXT_WORDS} OR words >= {SMALL_WORDS} AS flushed FROM s WHERE k = 1
      UNION ALL SELECT s.doc_id, s.section, s.words, s.k, f.g + CASE WHEN f.flushed OR (f.pending > 0 AND (f.pending + s.words > {CONTEXT_WORDS} OR s.words > {CONTEXT_WORDS})) THEN 1 ELSE 0 END,
        CASE WHEN s.words > {CONTEXT_WORDS} OR (CASE WHEN f.pending + s.words > {CONTEXT_WORDS} THEN 0 ELSE f.pending END) + s.words >= {SMALL_WORDS} THEN 0 ELSE (CASE WHEN f.pending + s.words > {CONTEXT_WORDS} THEN 0 ELSE f.pending END) + s.words END,
        s.words > {CONTEXT_WORDS} OR (CASE WHEN f.pending + s.words > {CONTEXT_WORDS} THEN 0 ELSE f.pending END) + s.words >= {SMALL_WORDS} FROM f JOIN s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
    b AS (SELECT w.*, words, row_number() OVER (PARTITION BY w.doc_id, w.section ORDER BY ord) AS k FROM w JOIN s USING (doc_id, section)),
    p AS (SELECT doc_id, section, ord, n, words, k, 0 AS part, n AS filled FROM b WHERE k = 1
      UNION ALL SELECT b.doc_id, b.section, b.ord, b.n, b.words, b.k, p.part + CASE WHEN b.words > {CONTEXT_WORDS} AND p.filled > 0 AND p.filled + b.n > {CONTEXT_WORDS} THEN 1 ELSE 0 END,
        CASE WHEN p.filled > 0 AND p.filled + b.n > {CONTEXT_WORDS} THEN b.n ELSE p.filled + b.n END FROM p JOIN b ON b.doc_id = p.doc_id AND b.section = p.section AND b.k = p.k + 1)
    SELECT p.doc_id, p.ord, CAST(p.section AS INT) AS section, CAST(dense_rank() OVER (PARTITION BY p.doc_id ORDER BY g, part) AS INT) AS "group" FROM p JOIN f USING (doc_id, section)"""


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of analyses (their customers): index, stage, status, attempts."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_custkey").alias("analysis_id"), F.col("o_orderkey").alias("index"), F.expr("element_at(array('local', 'context', 'global'), cast(o_orderkey % 3 + 1 as int))").alias("stage"),
        F.expr("case o_orderstatus when 'O' then 'PENDING' when 'P' then 'FAILED' else 'DONE' end").alias("status"), F.expr("cast(o_orderkey % 6 as int)").alias("attempts"),
        F.expr("case when o_orderkey % 97 = 0 then 'quota' when o_orderkey % 11 = 0 then 'bad_request' when o_orderkey % 5 in (1, 2, 4) then 'unavailable' end").alias("failure"),
    )


CHUNKS_SQL = """c AS (SELECT o_custkey AS analysis_id, o_orderkey AS index, ['local', 'context', 'global'][1 + o_orderkey % 3] AS stage, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'FAILED' ELSE 'DONE' END AS status,
  CAST(o_orderkey % 6 AS INT) AS attempts, CASE WHEN o_orderkey % 97 = 0 THEN 'quota' WHEN o_orderkey % 11 = 0 THEN 'bad_request' WHEN o_orderkey % 5 IN (1, 2, 4) THEN 'unavailable' END AS failure FROM orders)"""


def to_resume(chunks: DataFrame) -> DataFrame:
    """What a resumed run works on, in order: chunks not begun, and failed ones with attempts left."""
    place = F.row_number().over(Window.partitionBy("analysis_id", "stage").orderBy("index"))
    return chunks.where((F.col("status") == "PENDING") | ((F.col("status") == "FAILED") & (F.col("attempts") < MOST_ATTEMPTS))).select("analysis_id", "stage", "index", "attempts", place.alias("place"))


def given_up(calls: DataFrame) -> DataFrame:
    """Every call of an analysis in order, and whether it was still made.

    A service is given up after a failure that time won't mend (quota, config), or after ``BREAKER`` temporary ones with no success between; a refused
    request counts for neither.
    """
    before = Window.partitionBy("analysis_id").orderBy("index")
    calls = calls.withColumn("good", F.sum(F.col("failure").isNull().cast("int")).over(before))
    streak = F.sum((F.col("failure") == "unavailable").cast("int")).over(Window.partitionBy("analysis_id", "good").orderBy("index"))
    stops = F.coalesce(F.col("failure").isin("quota", "config") | ((F.col("failure") == "unavailable") & (streak >= BREAKER)), F.lit(False))
    calls = calls.withColumn("stops", stops.cast("int"))
    halted = F.coalesce(F.max("stops").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return calls.select("analysis_id", "index", F.when(halted, "not made").when(F.col("failure").isNull(), "done").otherwise(F.col("failure")).alias("outcome"))


def steps(chunks: DataFrame, analyses: DataFrame) -> DataFrame:
    """The state of each of an analysis' steps: by its status while it runs, by its settled chunks once it failed or was cancelled."""
    settled = chunks.groupBy("analysis_id").agg(*[(F.count_if(F.col("stage") == s) > 0).alias(f"has_{s}") for s in STEPS[1:4]], *[F.count_if((F.col("stage") == s) & (F.col("status") == "PENDING")).alias(f"open_{s}") for s in STEPS[1:4]])
    found = analyses.join(settled, "analysis_id")
    done = F.array(F.lit(True), *[F.col(f"has_{s}") & (F.col(f"open_{s}") == 0) for s in STEPS[1:4]], F.lit(False))
    running = F.create_map(*[F.lit(x) for pair in RUNNING.items() for x in pair])[F.col("status")]
    first_open = F.array_position(done, F.lit(False)).cast("int")
    rows = found.select("analysis_id", "status", running.alias("running"), first_open.alias("open"), F.posexplode(F.array(*map(F.lit, STEPS))).alias("i", "step")).withColumn("i", F.col("i") + 1)
    live = F.when(F.col("i") < F.col("running"), "done").when(F.col("i") == F.col("running"), "running").otherwise("pending")
    over = F.when(F.col("i") < F.col("open"), "done").when((F.col("i") == F.col("open")) & (F.col("status") == "FAILED"), "failed").otherwise("skipped")
    state = F.when(F.col("status") == "COMPLETED", "done").when(F.col("running").isNotNull(), live).when(F.col("status") == "QUEUED", "pending").otherwise(over)
    return rows.select("analysis_id", "step", state.alias("state"))


STATES = ["QUEUED", "EXTRACTING", "ANALYZING_LOCAL", "ANALYZING_CONTEXT", "ANALYZING_GLOBAL", "FINALIZING", "COMPLETED", "FAILED", "CANCELED"]


def analyses(chunks: DataFrame) -> DataFrame:
    return chunks.select("analysis_id").distinct().withColumn("status", F.element_at(F.array(*map(F.lit, STATES)), F.expr(f"cast(analysis_id % {len(STATES)} + 1 as int)")))


def queries() -> dict:
    return {
        "context_groups": lambda spark, sf: context_groups(typed_blocks(spark, sf)),
        "chunks_to_resume": lambda spark, sf: to_resume(chunk_rows(spark, sf)),
        "calls_given_up": lambda spark, sf: given_up(chunk_rows(spark, sf)),
        "analysis_steps": lambda spark, sf: steps(chunk_rows(spark, sf), analyses(chunk_rows(spark, sf))),
    }


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"'{s}'" for s in STATES)
    settled = lambda s: f"(SELECT count(*) > 0 AND bool_and(status <> 'PENDING') FROM c WHERE c.analysis_id = a.analysis_id AND stage = '{s}')"
    return {
        "context_groups": _groups_sql(),
        "chunks_to_resume": f"""WITH {CHUNKS_SQL} SELECT analysis_id, stage, index, attempts, CAST(row_number() OVER (PARTITION BY analysis_id, stage ORDER BY index) AS INT) AS place FROM c
          WHERE status = 'PENDING' OR (status = 'FAILED' AND attempts < {MOST_ATTEMPTS})""",
        "calls_given_up": f"""WITH {CHUNKS_SQL}, u AS (SELECT a.analysis_id, a.index, count(*) AS streak FROM c a JOIN c b ON b.analysis_id = a.analysis_id AND b.index <= a.index AND b.failure = 'unavailable'
            WHERE a.failure = 'unavailable' AND NOT EXISTS (SELECT 1 FROM c g WHERE g.analysis_id = a.analysis_id AND g.failure IS NULL AND g.index > b.index AND g.index < a.index) GROUP BY ALL),
          h AS (SELECT analysis_id, min(index) AS stop FROM (SELECT analysis_id, index FROM u WHERE streak >= {BREAKER} UNION ALL SELECT analysis_id, index FROM c WHERE failure IN ('quota', 'config')) GROUP BY analysis_id)
          SELECT analysis_id, index, CASE WHEN index > stop THEN 'not made' WHEN failure IS NULL THEN 'done' ELSE failure END AS outcome FROM c LEFT JOIN h USING (analysis_id)""",
        "analysis_steps": f"""WITH {CHUNKS_SQL}, a AS (SELECT DISTINCT analysis_id, [{names}][1 + analysis_id % {len(STATES)}] AS status FROM c),
          d AS (SELECT *, CASE WHEN NOT {settled('local')} THEN 2 WHEN NOT {settled('context')} THEN 3 WHEN NOT {settled('global')} THEN 4 ELSE 5 END AS opened, list_position(['EXTRACTING', 'ANALYZING_LOCAL', 'ANALYZING_CONTEXT', 'ANALYZING_GLOBAL', 'FINALIZING'], status) AS run FROM a),
          s AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM d)
          SELECT analysis_id, ['extract', 'local', 'context', 'global', 'finalize'][i] AS step, CASE WHEN status = 'COMPLETED' THEN 'done' WHEN run > 0 THEN CASE WHEN i < run THEN 'done' WHEN i = run THEN 'running' ELSE 'pending' END
            WHEN status = 'QUEUED' THEN 'pending' WHEN i < opened THEN 'done' WHEN i = opened AND status = 'FAILED' THEN 'failed' ELSE 'skipped' END AS state FROM s""",
    }
