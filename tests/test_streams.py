"""Keyed state on streams against the same in batch."""

from __future__ import annotations

from conftest import SF
from pyspark.sql import functions as F

from proofline.streaming import limits, quota, spacing

COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def in_order(spark, folder, parts=3):
    """The events as files, one after another in time, and one late event in a file of its own that moves the watermark on."""
    events = quota.read(spark, SF, *COLUMNS).orderBy("ts")
    rows = events.collect()
    size = len(rows) // parts + 1
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], events.schema).coalesce(1).write.mode("append").parquet(folder)
    for day in ("2030-01-01", "2031-01-01"):
        spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(day).cast("timestamp_ntz").alias("ts"), F.lit(999_999).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.mode("append").parquet(folder)


def drained(stream, name, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return {tuple(r) for r in stream.sparkSession.table(name).collect()}


def test_spaced_stream_equals_batch(spark, tmp_path):
    in_order(spark, str(tmp_path / "events"))
    got = drained(spacing.spacing_stream(spark, str(tmp_path / "events")), "spaced", str(tmp_path / "state"))
    want = {tuple(r) for r in spacing.spaced(spacing.requests(spark, SF)).collect()}
    assert {r for r in got if r[1] != -1} == want
    assert any(r[4] > 1 for r in want) and any(r[3] > r[2] for r in want)


def test_throttle_stream_equals_batch(spark, tmp_path):
    in_order(spark, str(tmp_path / "events"))
    got = drained(spacing.throttle_stream(spark, str(tmp_path / "events")), "throttled", str(tmp_path / "state"))
    want = {tuple(r) for r in limits.throttled(quota.read(spark, SF, "user_id", "ts", "event_id")).collect()}
    assert {r for r in got if r[1] != -1} == want


def test_a_pause_reopens_reserved_slots(spark):
    minute = 60_000
    # three requests at once, then a pause that covers the slots of the last two
    asked = [(1, 0, None, 1), (1, 0, None, 2), (1, 0, None, 3), (1, 5, 3 * minute, 4), (2, 0, None, 5)]
    rows = spacing.spaced(spark.createDataFrame(asked, spacing.ASKED), minute).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, 0, 0, 1), (1, 2, 0, 3 * minute + 5, 2), (1, 3, 0, 4 * minute + 5, 2), (2, 5, 0, 0, 1)]
