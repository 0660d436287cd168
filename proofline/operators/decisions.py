"""Decisions on doubtful cases, given as a table: what becomes of each issue, and what requests would say.

Cases are the issue table, decisions and attempts are derived from it and from the orders by plain arithmetic, in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.operators.issues import ISSUES_SQL, issue_rows

KINDS, FALLBACKS = ["misspelling", "grammar", "confusion"], ["keep", "verify", "drop"]
# The longest wait in milliseconds, and the first one, which doubles with every attempt.
LONGEST_WAIT, FIRST_WAIT = 60_000, 2_000

CASES_SQL = f"""{ISSUES_SQL}, c AS (SELECT issue_id AS case_id, {KINDS}[1 + issue_id % 3] AS kind, {FALLBACKS}[1 + issue_id // 3 % 3] AS fallback, min(suggestion) AS suggestion FROM issues GROUP BY issue_id),
  d AS (SELECT case_id, seq, ['correct', 'keep', 'verify', 'nonsense'][1 + (case_id + seq * 3) % 4] AS decision, CASE WHEN case_id % 5 <> 0 THEN 'c' || case_id % 100 END AS correction
    FROM (SELECT case_id, unnest([1, 2]) AS seq FROM c WHERE case_id % 4 <> 3)),
  o AS (SELECT c.*, decision, correction, CASE WHEN decision IS NULL OR NOT (decision IN ('keep', 'verify') OR (decision = 'correct' AND correction IS NOT NULL))
      THEN CASE fallback WHEN 'drop' THEN 'dropped' WHEN 'verify' THEN 'verify' ELSE 'kept' END
      WHEN decision = 'correct' THEN 'corrected' WHEN decision = 'keep' THEN CASE WHEN kind = 'grammar' THEN 'verify' ELSE 'dropped' END ELSE CASE WHEN kind = 'confusion' THEN 'dropped' ELSE 'verify' END END AS outcome
    FROM c LEFT JOIN (SELECT * FROM d WHERE seq = 1) USING (case_id)),
  r AS (SELECT case_id, kind, outcome, CASE WHEN outcome = 'corrected' THEN correction WHEN outcome <> 'dropped' THEN suggestion END AS suggestion FROM o)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda items, index: F.element_at(F.array(*map(F.lit, items)), F.expr(f"cast({index} + 1 as int)"))
    rows = issue_rows(spark, sf_dir).groupBy("issue_id").agg(F.min("suggestion").alias("suggestion"))
    return rows.select(F.col("issue_id").alias("case_id"), pick(KINDS, "issue_id % 3").alias("kind"), pick(FALLBACKS, "issue_id div 3 % 3").alias("fallback"), "suggestion")


def decisions(cases: DataFrame) -> DataFrame:
    rows = cases.where("case_id % 4 <> 3").select("case_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("seq"))
    made = F.element_at(F.array(*map(F.lit, ["correct", "keep", "verify", "nonsense"])), F.expr("cast((case_id + seq * 3) % 4 + 1 as int)"))
    return rows.select("case_id", "seq", made.alias("decision"), F.expr("case when case_id % 5 <> 0 then concat('c', case_id % 100) end").alias("correction"))


def outcome() -> Column:
    """The first decision of a case counts; without a valid one the case's own fallback does."""
    kind, decision = F.col("kind"), F.col("decision")
    fallen = F.when(F.col("fallback") == "drop", F.lit("dropped")).when(F.col("fallback") == "verify", F.lit("verify")).otherwise(F.lit("kept"))
    usable = decision.isin("keep", "verify") | ((decision == "correct") & F.col("correction").isNotNull())
    keep = F.when(kind == "grammar", F.lit("verify")).otherwise(F.lit("dropped"))
    verify = F.when(kind == "confusion", F.lit("dropped")).otherwise(F.lit("verify"))
    return F.when(~F.coalesce(usable, F.lit(False)), fallen).when(decision == "correct", F.lit("corrected")).when(decision == "keep", keep).otherwise(verify)


def resolved(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every case with its outcome and the suggestion that stands afterwards."""
    first = F.row_number().over(Window.partitionBy("case_id").orderBy("seq"))
    chosen = decisions.withColumn("k", first).where("k = 1").select("case_id", "decision", "correction")
    found = cases.join(chosen, "case_id", "left").withColumn("outcome", outcome())
    return found.select("case_id", "kind", "outcome", F.when(F.col("outcome") == "corrected", F.col("correction")).when(F.col("outcome") != "dropped", F.col("suggestion")).alias("suggestion"))


def latest(decisions: DataFrame) -> DataFrame:
    """Late answers are ignored: the one with the highest number counts."""
    return decisions.groupBy("case_id").agg(F.max_by("decision", "seq").alias("decision"))


ATTEMPTS_SQL = """a AS (SELECT o_orderkey AS call_id, CAST(o_orderkey % 9 AS INT) AS attempt, [429, 401, 400, 503, 200, 403, 429][1 + o_orderkey % 7] AS status,
  CASE o_orderkey % 5 WHEN 0 THEN 'daily_quota' WHEN 1 THEN 'rate' END AS reason, CASE WHEN o_orderkey % 4 = 0 THEN 12 END AS retry_after FROM orders)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, [429, 401, 400, 503, 200, 403, 429])), (key % 7 + 1).cast("int"))
    reason = F.when(key % 5 == 0, "daily_quota").when(key % 5 == 1, "rate")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("call_id"), (key % 9).cast("int").alias("attempt"), status.alias("status"), reason.alias("reason"), F.when(key % 4 == 0, 12).alias("retry_after"))


def failures(attempts: DataFrame) -> DataFrame:
    """What kind of failure each attempt is, and how long to wait before the next; a spent daily quota is not waited for."""
    status, spent = F.col("status"), F.coalesce(F.col("reason") == "daily_quota", F.lit(False))
    kind = F.when(status.isin(401, 403), "config").when(spent & (status != 200), "quota").when(status == 400, "bad_request").when(status != 200, "unavailable")
    doubled = F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.col("attempt")), F.lit(LONGEST_WAIT)).cast("long")
    wait = F.when((status == 429) & ~spent, F.coalesce(F.col("retry_after").cast("long") * 1000, doubled))
    return attempts.select("call_id", "status", kind.alias("failure"), wait.alias("wait_ms"))


def queries() -> dict:
    both = lambda spark, sf: (cases(spark, sf), decisions(cases(spark, sf)))
    return {
        "case_decisions": lambda spark, sf: resolved(*both(spark, sf)),
        "case_outcomes": lambda spark, sf: resolved(*both(spark, sf)).groupBy("kind", "outcome").agg(F.count("*").alias("n")),
        "latest_decision": lambda spark, sf: latest(both(spark, sf)[1]),
        "call_failures": lambda spark, sf: failures(attempts(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "case_decisions": f"WITH {CASES_SQL} SELECT * FROM r",
        "case_outcomes": f"WITH {CASES_SQL} SELECT kind, outcome, count(*) AS n FROM r GROUP BY kind, outcome",
        "latest_decision": f"WITH {CASES_SQL} SELECT case_id, arg_max(decision, seq) AS decision FROM d GROUP BY case_id",
        "call_failures": f"""WITH {ATTEMPTS_SQL} SELECT call_id, status, CASE WHEN status = 200 THEN NULL WHEN status IN (401, 403) THEN 'config' WHEN reason = 'daily_quota' THEN 'quota' WHEN status = 400 THEN 'bad_request' ELSE 'unavailable' END AS failure,
          CASE WHEN status = 429 AND reason IS DISTINCT FROM 'daily_quota' THEN CAST(coalesce(retry_after * 1000, least({FIRST_WAIT} * power(2, attempt), {LONGEST_WAIT})) AS BIGINT) END AS wait_ms FROM a""",
    }
