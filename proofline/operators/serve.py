"""Queries by which issues are listed, counted and decided on, and by which stored rows age out.

Parquet has no updates, so decisions and retention are pure transforms that return the rows as they are afterwards, or the rows to go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.operators.issues import CLASSIFIED_SQL, classified, issue_rows

# What the filter for grammar also shows, and how many rows a list may have.
FILTER_GROUPS = {"spelling": ["spelling"], "grammar": ["grammar", "punctuation"], "style": ["style"], "coherence": ["coherence"], "structure": ["structure"]}
PAGE_SIZE, MOST_IDS = 500, 1000
RELIABLE = """status = 'open' AND category IN ('spelling', 'grammar', 'punctuation') AND nature = 'error' AND confidence = 'high' AND suggestion IS NOT NULL AND suggestion <> original"""
ORDER_KEY = "block * 10000 + least(start, 9999)"
NOW = "TIMESTAMP '2000-06-01 00:00:00'"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(issue_rows(spark, sf_dir))


def listed(issues: DataFrame, categories: list[str], natures: list[str], offset: int, limit: int) -> DataFrame:
    """A page of the open issues, in document order. The page is the feature, so the limit is part of it."""
    found = issues.where(F.col("category").isin(categories) & F.col("nature").isin(natures) & (F.col("status") == "open"))
    found = found.withColumn("order_key", F.expr(ORDER_KEY).cast("int"))
    return found.orderBy("doc_id", "order_key", "issue_id").offset(offset).limit(limit).select("issue_id", "doc_id", "order_key", "category", "nature")


def category_counts(issues: DataFrame) -> DataFrame:
    """Open issues of each document by filter group, all groups in one pass."""
    open_ones = issues.where("status = 'open'")
    return open_ones.groupBy("doc_id").agg(F.count("*").alias("all_open"), *[F.count_if(F.col("category").isin(cs)).alias(name) for name, cs in FILTER_GROUPS.items()])


def review_progress(issues: DataFrame) -> DataFrame:
    n = F.count("*")
    return issues.groupBy("doc_id").agg(n.alias("total"), F.count_if(F.col("status") != "open").alias("reviewed"), F.count_if(F.expr(RELIABLE)).alias("reliable"), F.count_if(F.expr("status = 'open' AND nature IN ('potential', 'verify')")).alias("manual"))


def accept_reliable(issues: DataFrame) -> DataFrame:
    """The status of every issue after all reliable corrections were accepted, and whether it changed."""
    hit = F.expr(RELIABLE)
    return issues.select("issue_id", "doc_id", F.when(hit, "accepted").otherwise(F.col("status")).alias("status"), F.coalesce(hit, F.lit(False)).alias("changed"))


def undo_accept(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows that go back to open: those of the ids that are still accepted."""
    return issues.where("status = 'accepted'").join(ids, "issue_id", "left_semi").select("issue_id", "doc_id", F.lit("open").alias("status"))


def bulk_outcomes(issues: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests of many ids (request, issue_id): how many they name, and how many change; one of too many ids, or that names an unknown one, changes nothing."""
    asked = requests.distinct().join(issues.select("issue_id", "status"), "issue_id", "left")
    counted = asked.groupBy("request").agg(F.count("*").alias("n_ids"), F.count_if(F.col("status").isNull()).alias("unknown"), F.count_if(F.col("status") == "accepted").alias("accepted"))
    outcome = F.when(F.col("n_ids") > MOST_IDS, "too_many").when(F.col("unknown") > 0, "unknown_id").otherwise("done")
    return counted.select("request", "n_ids", outcome.alias("outcome"), F.when(outcome == "done", F.col("accepted")).otherwise(0).alias("changed"))


#: For both engines: requests of neighbouring documents' issues, of very different sizes, some with an id that isn't there.
REQUEST, ASKED_ID = "doc_id {div} 20 * 2 + CASE WHEN issue_id % 5 = 0 THEN 1 ELSE 0 END", "CASE WHEN issue_id % 997 = 0 THEN -1 ELSE issue_id END"


def section_groups(issues: DataFrame) -> DataFrame:
    """Consecutive issues of one block form a group (gaps and islands)."""
    order = Window.partitionBy("doc_id").orderBy("start", "issue_id")
    fresh = F.when(F.lag("block").over(order).eqNullSafe(F.col("block")), 0).otherwise(1)
    grouped = issues.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(order))
    return grouped.groupBy("doc_id", "part").agg(F.first("block").alias("block"), F.count("*").alias("n"))


def latest_per_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's newest entry; orders stand in for analyses."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    newest = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x"))
    return newest.select(F.col("o_custkey").alias("owner_id"), F.col("x.o_orderkey").alias("analysis_id"), F.col("x.o_orderstatus").alias("status"))


#: Orders as catalog rows with ages, for retention: (report column, condition).
RETENTION = {
    "exports_deleted": "created <= now - INTERVAL '1' DAY AND id % 3 = 0",
    "documents_deleted": "created <= now - INTERVAL '7' DAY",
    "files_deleted": "created <= now - INTERVAL '1' DAY AND created > now - INTERVAL '7' DAY",
    "stale_analyses": "created <= now - INTERVAL '2' HOUR AND status = 'O'",
    "stale_exports": "created <= now - INTERVAL '15' MINUTE AND status = 'P'",
}


def retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up at a given time would remove, per owner segment. The time is an argument, never the clock."""
    catalog = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"))
    catalog = catalog.withColumn("now", F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")))
    return catalog.groupBy(F.expr("owner % 10").alias("owners")).agg(*[F.count_if(F.expr(c)).alias(name) for name, c in RETENTION.items()])


def guests_without_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners that have nothing in progress: an anti join."""
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("owner_id"))
    owned = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("owner_id"))
    return users.join(owned, "owner_id", "left_anti")


def case_batches(issues: DataFrame, size: int = 20, most: int = 3) -> DataFrame:
    """Doubtful cases of each document, by priority, in batches of one size; those beyond the budget overflow."""
    kinds = {"error": 0, "suggestion": 1, "potential": 2, "verify": 3}
    rank = F.expr("CASE nature " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in kinds.items()) + " END")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "block", "start", "issue_id"))
    return issues.where("confidence <> 'high'").withColumn("place", place).select("issue_id", "doc_id", F.when(F.col("place") <= size * most, F.floor((F.col("place") - 1) / size)).cast("int").alias("batch"), (F.col("place") > size * most).alias("overflow"))


def queries() -> dict:
    return {
        "list_issues": lambda spark, sf: listed(rows(spark, sf), ["spelling", "grammar"], ["error", "suggestion"], 20, PAGE_SIZE),
        "category_counts": lambda spark, sf: category_counts(rows(spark, sf)),
        "review_progress": lambda spark, sf: review_progress(rows(spark, sf)),
        "accept_reliable": lambda spark, sf: accept_reliable(rows(spark, sf)),
        "undo_accept": lambda spark, sf: undo_accept(rows(spark, sf), rows(spark, sf).where("issue_id % 3 = 0").select("issue_id")),
        "bulk_outcomes": lambda spark, sf: bulk_outcomes(rows(spark, sf).groupBy("issue_id").agg(F.max("status").alias("status")), rows(spark, sf).select(F.expr(REQUEST.format(div="div")).alias("request"), F.expr(ASKED_ID).alias("issue_id"))),
        "section_groups": lambda spark, sf: section_groups(rows(spark, sf)),
        "latest_per_owner": latest_per_owner,
        "retention_report": retention_report,
        "guests_without_documents": guests_without_documents,
        "case_batches": lambda spark, sf: case_batches(rows(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    groups = ", ".join(f"count(*) FILTER (category IN ({', '.join(repr(c) for c in cs)})) AS {name}" for name, cs in FILTER_GROUPS.items())
    report = ", ".join(f"count(*) FILTER ({c}) AS {name}" for name, c in RETENTION.items())
    return {
        "list_issues": f"""WITH {CLASSIFIED_SQL} SELECT issue_id, doc_id, CAST({ORDER_KEY} AS INT) AS order_key, category, nature FROM classified
          WHERE category IN ('spelling', 'grammar') AND nature IN ('error', 'suggestion') AND status = 'open' ORDER BY doc_id, {ORDER_KEY}, issue_id LIMIT {PAGE_SIZE} OFFSET 20""",
        "category_counts": f"WITH {CLASSIFIED_SQL} SELECT doc_id, count(*) AS all_open, {groups} FROM classified WHERE status = 'open' GROUP BY doc_id",
        "review_progress": f"""WITH {CLASSIFIED_SQL} SELECT doc_id, count(*) AS total, count(*) FILTER (status <> 'open') AS reviewed, count(*) FILTER ({RELIABLE}) AS reliable,
          count(*) FILTER (status = 'open' AND nature IN ('potential', 'verify')) AS manual FROM classified GROUP BY doc_id""",
        "accept_reliable": f"WITH {CLASSIFIED_SQL} SELECT issue_id, doc_id, CASE WHEN {RELIABLE} THEN 'accepted' ELSE status END AS status, coalesce({RELIABLE}, false) AS changed FROM classified",
        "undo_accept": f"WITH {CLASSIFIED_SQL} SELECT issue_id, doc_id, 'open' AS status FROM classified WHERE status = 'accepted' AND issue_id % 3 = 0",
        "bulk_outcomes": f"""WITH {CLASSIFIED_SQL}, a AS (SELECT DISTINCT {REQUEST.format(div="//")} AS request, {ASKED_ID} AS id FROM classified), s AS (SELECT issue_id, max(status) AS status FROM classified GROUP BY issue_id),
          c AS (SELECT request, count(*) AS n_ids, count(*) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.issue_id = a.id)) AS gone, count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.issue_id = a.id AND s.status = 'accepted')) AS n FROM a GROUP BY request)
          SELECT request, n_ids, CASE WHEN n_ids > {MOST_IDS} THEN 'too_many' WHEN gone > 0 THEN 'unknown_id' ELSE 'done' END AS outcome, CASE WHEN n_ids <= {MOST_IDS} AND gone = 0 THEN n ELSE 0 END AS changed FROM c""",
        "section_groups": f"""WITH {CLASSIFIED_SQL}, f AS (SELECT *, CASE WHEN lag(block) OVER w IS NOT DISTINCT FROM block THEN 0 ELSE 1 END AS fresh FROM classified WINDOW w AS (PARTITION BY doc_id ORDER BY start, issue_id)),
          g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, issue_id) AS part FROM f) SELECT doc_id, CAST(part AS BIGINT) AS part, any_value(block) AS block, count(*) AS n FROM g GROUP BY doc_id, part""",
        "latest_per_owner": "SELECT o_custkey AS owner_id, o_orderkey AS analysis_id, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
        "retention_report": f"WITH c AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderdate AS created, o_orderstatus AS status, {NOW} AS now FROM orders) SELECT owner % 10 AS owners, {report} FROM c GROUP BY owner % 10",
        "guests_without_documents": "SELECT c_custkey AS owner_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')",
        "case_batches": f"""WITH {CLASSIFIED_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE nature WHEN 'error' THEN 0 WHEN 'suggestion' THEN 1 WHEN 'potential' THEN 2 ELSE 3 END, block, start, issue_id) AS place FROM classified WHERE confidence <> 'high')
          SELECT issue_id, doc_id, CASE WHEN place <= 60 THEN CAST((place - 1) // 20 AS INT) END AS batch, place > 60 AS overflow FROM p""",
    }
