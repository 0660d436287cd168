"""Requests that share a limiter: each gets the next free slot, slots stand an interval apart, and a pause reopens the slots that were reserved behind it.

What happens is a fold over a limiter's requests and pauses in the order of time: slots that have come are granted first, or reserved anew if a pause now covers them. The
same fold serves the batch, over partitions sorted by limiter, and the stream, where its state is kept per limiter and timers grant what is waiting.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from proofline.streaming import limits, quota

#: Milliseconds between two requests of a limiter, and how late events of a stream may be.
INTERVAL, LATENESS = 40 * 60_000, "1 hour"
GRANT = "limiter long, event_id long, asked long, granted long, reservations int"
#: One request or pause: when, whether it is a pause, its length in milliseconds.
ASKED = "limiter long, at long, pause long, event_id long"


class Slots:
    """A limiter's state: the next free slot, the end of its pause, and the reserved slots as a heap of (slot, event, asked, reservations)."""

    def __init__(self, interval: int = INTERVAL, free: int = 0, paused: int = 0, waiting: list[tuple] = ()):
        self.interval, self.free, self.paused, self.waiting = interval, free, paused, list(map(tuple, waiting))

    def reserve(self, now: int, event: int, asked: int, times: int) -> None:
        slot = max(now, self.free, self.paused)
        self.free = slot + self.interval
        heapq.heappush(self.waiting, (slot, event, asked, times))

    def until(self, now: float) -> Iterator[tuple[int, int, int, int]]:
        """What is granted up to ``now``: (event, asked, granted, reservations)."""
        while self.waiting and self.waiting[0][0] <= now:
            slot, event, asked, times = heapq.heappop(self.waiting)
            if self.paused > slot:
                self.reserve(slot, event, asked, times + 1)
            else:
                yield event, asked, slot, times

    def take(self, at: int, pause: int | None, event: int) -> Iterator[tuple[int, int, int, int]]:
        yield from self.until(at)
        if pause is None:
            self.reserve(at, event, at, 1)
        elif at + pause > self.paused:
            self.paused = at + pause
            self.free = max(self.free, self.paused)


def spaced(asked: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """Every request of ``asked`` (ASKED; pause is null for requests) with the time at which it may go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter, slots = None, Slots(interval)
        for batch in batches:
            rows = []
            for own, at, pause, event in zip(*(batch[c].to_pylist() for c in ("limiter", "at", "pause", "event_id")), strict=True):
                if own != limiter:
                    rows += [(limiter, *r) for r in slots.until(float("inf"))]
                    limiter, slots = own, Slots(interval)
                rows += [(own, *r) for r in slots.take(at, pause, event)]
            yield table(rows)
        yield table([(limiter, *r) for r in slots.until(float("inf"))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["limiter", "event_id", "asked", "granted", "reservations"])

    ordered = asked.where("limiter IS NOT NULL").repartition("limiter").sortWithinPartitions("limiter", "at", "event_id")
    return ordered.mapInArrow(run, GRANT)


class Spacing(StatefulProcessor):
    """The fold of a limiter on a stream. Rows of a batch are taken in order of time; a timer at the first reserved slot grants what no later event would."""

    def __init__(self, interval: int = INTERVAL):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("slots", "free long, paused long, waiting array<struct<slot:bigint,event:bigint,asked:bigint,times:int>>")

    def load(self) -> Slots:
        kept = self.state.get()
        return Slots(self.interval, *kept) if kept is not None else Slots(self.interval)

    def keep(self, slots: Slots) -> None:
        self.state.update((slots.free, slots.paused, slots.waiting))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if slots.waiting:
            self.handle.registerTimer(slots.waiting[0][0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        slots, out = self.load(), []
        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            out += slots.take(r["at"], r["pause"], r["event_id"])
        self.keep(slots)
        return iter([Row(limiter=key[0], event_id=e, asked=a, granted=g, reservations=n) for e, a, g, n in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        slots = self.load()
        out = list(slots.until(expiredTimerInfo.getExpiryTimeInMs()))
        self.keep(slots)
        return iter([Row(limiter=key[0], event_id=e, asked=a, granted=g, reservations=n) for e, a, g, n in out])


class Throttle(StatefulProcessor):
    """A user's window on a stream: it begins at the first hit, and is dropped by a timer when it ends."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "begun long, hits int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        begun, hits = self.state.get() or (None, 0)
        out = []
        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            at = r["at"] // 1000
            if begun is None or at >= begun + self.seconds:
                begun, hits = at, 0
                self.handle.registerTimer((begun + self.seconds) * 1000)
            hits += 1
            out.append(Row(user_id=key[0], event_id=r["event_id"], hits=hits, seconds_left=begun + self.seconds - at, blocked=hits > self.limit))
        self.state.update((begun, hits))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.state.get()
        if kept is not None and (kept[0] + self.seconds) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter([])


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # keyed state with timers is kept there only
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", LATENESS)


def spacing_stream(spark: SparkSession, path: str, interval: int = INTERVAL) -> DataFrame:
    """The grants of a folder of events as a stream."""
    rows = timed(spark, path).select("time", *asked_columns()).where("limiter IS NOT NULL")
    return rows.groupBy("limiter").transformWithState(Spacing(interval), GRANT, "Append", "EventTime")


def throttle_stream(spark: SparkSession, path: str, limit: int = limits.LIMIT, seconds: int = limits.SECONDS) -> DataFrame:
    """Every hit of a folder of events with its number in its user's window, as a stream."""
    rows = timed(spark, path).where("user_id IS NOT NULL").select("time", "user_id", F.unix_millis("time").alias("at"), "event_id")
    return rows.groupBy("user_id").transformWithState(Throttle(limit, seconds), "user_id long, event_id long, hits int, seconds_left long, blocked boolean", "Append", "EventTime")


#: For both engines: ten limiters; errors are pauses of some minutes.
LIMITERS = 10


def asked_columns() -> list[Column]:
    pause = F.when(F.col("event_type") == "error", F.floor(F.col("value") * 5) * 60_000)
    return [(F.col("user_id") % LIMITERS).alias("limiter"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), pause.alias("pause"), "event_id"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.read(spark, sf_dir, "user_id", "ts", "event_type", "value", "event_id").select(*asked_columns())


def queries() -> dict:
    return {"spaced_requests": lambda spark, sf: spaced(requests(spark, sf))}


def oracle_sql() -> dict[str, str]:
    """One step for every event and every slot that comes, whichever is first, with what waits as a sorted list."""
    return {
        "spaced_requests": f"""WITH RECURSIVE e AS (SELECT user_id % {LIMITERS} AS limiter, epoch_us(ts) // 1000 AS at_ms, CASE WHEN event_type = 'error' THEN CAST(floor(value * 5) AS BIGINT) * 60000 END AS pause, event_id FROM events WHERE user_id IS NOT NULL),
        q AS (SELECT *, row_number() OVER (PARTITION BY limiter ORDER BY at_ms, event_id) AS k, count(*) OVER (PARTITION BY limiter) AS n FROM e),
        z AS (SELECT limiter, list({{'t': at_ms, 'p': pause, 'e': event_id}} ORDER BY k) AS l FROM q GROUP BY limiter),
        f AS (SELECT limiter, l, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS free, CAST(0 AS BIGINT) AS paused, CAST([] AS STRUCT(s BIGINT, e BIGINT, a BIGINT, c INT)[]) AS w, CAST(NULL AS STRUCT(s BIGINT, e BIGINT, a BIGINT, c INT)) AS grant_ FROM z
          UNION ALL SELECT limiter, l,
            CASE WHEN ripe THEN k ELSE k + 1 END,
            CASE WHEN ripe AND paused > w[1].s THEN greatest(w[1].s, free, paused) + {INTERVAL} WHEN ripe THEN free WHEN x.p IS NULL THEN greatest(x.t, free, paused) + {INTERVAL} WHEN x.t + x.p > paused THEN greatest(free, x.t + x.p) ELSE free END,
            CASE WHEN NOT ripe AND x.p IS NOT NULL THEN greatest(paused, x.t + x.p) ELSE paused END,
            CASE WHEN ripe AND paused > w[1].s THEN list_sort(list_append(w[2:], {{'s': greatest(w[1].s, free, paused), 'e': w[1].e, 'a': w[1].a, 'c': CAST(w[1].c + 1 AS INT)}})) WHEN ripe THEN w[2:]
              WHEN x.p IS NULL THEN list_sort(list_append(w, {{'s': greatest(x.t, free, paused), 'e': x.e, 'a': x.t, 'c': CAST(1 AS INT)}})) ELSE w END,
            CASE WHEN ripe AND paused <= w[1].s THEN w[1] END
          FROM (SELECT *, l[k] AS x, len(w) > 0 AND (k > len(l) OR w[1].s <= l[k].t) AS ripe FROM f WHERE k <= len(l) OR len(w) > 0))
        SELECT limiter, grant_.e AS event_id, grant_.a AS asked, grant_.s AS granted, grant_.c AS reservations FROM f WHERE grant_ IS NOT NULL"""
    }
