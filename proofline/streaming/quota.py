"""Fixed-window quotas: how often each user did something per window, and where that is over the limit.

The same function serves batch and stream. On a stream the watermark bounds the state: windows older than it are emitted and dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (events, seconds) that are free per user, by kind of event.
LIMITS = {"signup": (3, 3600), "purchase": (20, 3600), "view": (10, 86400), "click": (10, 3600), "error": (10, 86400)}
LATENESS = "1 hour"
#: A day's budget by kind of event; 0 means none.
DAILY = {"click": 500, "view": 400, "purchase": 0, "error": 600}


def windowed(events: DataFrame) -> DataFrame:
    """user_id, event_type, window_start (seconds), n, over."""
    seconds = F.create_map(*[x for k, (_, s) in LIMITS.items() for x in (F.lit(k), F.lit(s))])[F.col("event_type")]
    limit = F.create_map(*[x for k, (m, _) in LIMITS.items() for x in (F.lit(k), F.lit(m))])[F.col("event_type")]
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    placed = events.select("user_id", "event_type", (at - at % seconds).alias("window_start"), limit.alias("most")).where("most IS NOT NULL")
    found = placed.groupBy("user_id", "event_type", "window_start", "most").agg(F.count("*").alias("n"))
    return found.select("user_id", "event_type", "window_start", "n", (F.col("n") > F.col("most")).alias("over"))


def quota_stream(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The counts of one kind of event as a stream over a folder of Parquet files, by event time."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    most, seconds = LIMITS[kind]
    events = spark.readStream.schema(schema).parquet(path).where(F.col("event_type") == kind)
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATENESS)
    counted = timed.groupBy("user_id", F.window("at", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.unix_timestamp("w.start").alias("window_start"), "n", (F.col("n") > most).alias("over"))


def unique_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Each job once, however often it was handed in: events by id, repeats within the lateness dropped."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))
    return events.withWatermark("at", LATENESS).dropDuplicatesWithinWatermark(["event_id"])


def daily_tokens(events: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """A day's sum per kind, and whether it has used up the day's budget; kinds without a budget, or with one of 0, never have."""
    budget = F.create_map(*[F.lit(x) for pair in (budgets or DAILY).items() for x in pair])[F.col("event_type")]
    summed = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sum(F.floor("value")).cast("long").alias("tokens"))
    return summed.withColumn("spent", F.coalesce((budget > 0) & (F.col("tokens") >= budget), F.lit(False)))


def read(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns)


def queries() -> dict:
    return {
        "quota_windows": lambda spark, sf: windowed(read(spark, sf, "user_id", "event_type", "ts")),
        "daily_tokens": lambda spark, sf: daily_tokens(read(spark, sf, "event_type", "ts", "value")),
    }


def oracle_sql() -> dict[str, str]:
    seconds = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {s}" for k, (_, s) in LIMITS.items()) + " END"
    most = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {m}" for k, (m, _) in LIMITS.items()) + " END"
    return {
        "quota_windows": f"""WITH e AS (SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec, {seconds} AS s, {most} AS m FROM events)
          SELECT user_id, event_type, sec - sec % s AS window_start, count(*) AS n, count(*) > any_value(m) AS over FROM e WHERE m IS NOT NULL GROUP BY user_id, event_type, sec - sec % s""",
        "daily_tokens": f"""WITH t AS (SELECT CAST(ts AS DATE) AS day, event_type, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY ALL), b AS (SELECT unnest({list(DAILY)}) AS kind, unnest({list(DAILY.values())}) AS budget)
          SELECT day, event_type, tokens, coalesce(budget > 0 AND tokens >= budget, false) AS spent FROM t LEFT JOIN b ON kind = event_type""",
    }
