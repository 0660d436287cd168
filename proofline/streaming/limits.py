"""Throttling whose window begins at the first hit, as a fold over each user's hits in order.

A tumbling window would not do, as windows begin when a user comes. Hits are sorted within partitions by user, so a task holds one window's state and
streams through its rows, however many a user has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.streaming import quota

# Hits that are free in a window, and its length in seconds.
LIMIT, SECONDS = 3, 86_400


def opened(limit: int, seconds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, begun, hits = None, 0, 0
        for batch in batches:
            rows = []
            for own, at, event in zip(*(batch[c].to_pylist() for c in ("user_id", "at", "event_id")), strict=True):
                if own != user or at >= begun + seconds:
                    user, begun, hits = own, at, 0
                hits += 1
                rows.append((own, event, hits, begun + seconds - at, hits > limit))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["user_id", "event_id", "hits", "seconds_left", "blocked"])

    return run


def throttled(events: DataFrame, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """Every hit with its number in its window, the seconds until that ends, and whether it was blocked."""
    rows = events.where("user_id IS NOT NULL").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return ordered.mapInArrow(opened(limit, seconds), "user_id long, event_id long, hits int, seconds_left long, blocked boolean")


def queries() -> dict:
    return {"throttled_hits": lambda spark, sf: throttled(quota.read(spark, sf, "user_id", "ts", "event_id"))}


def oracle_sql() -> dict[str, str]:
    return {
        "throttled_hits": f"""WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS k FROM events WHERE user_id IS NOT NULL),
          f AS (SELECT user_id, sec, event_id, k, sec AS begun, 1 AS hits FROM e WHERE k = 1
            UNION ALL SELECT e.user_id, e.sec, e.event_id, e.k, CASE WHEN e.sec >= f.begun + {SECONDS} THEN e.sec ELSE f.begun END, CASE WHEN e.sec >= f.begun + {SECONDS} THEN 1 ELSE f.hits + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
          SELECT user_id, event_id, CAST(hits AS INT) AS hits, begun + {SECONDS} - sec AS seconds_left, hits > {LIMIT} AS blocked FROM f"""
    }
