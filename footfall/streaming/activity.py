"""Exact activity of the last half hour, every five minutes, as events arrive.

Counting distinct sessions of overlapping windows needs to know, for each session, in which windows it was seen already. So
state is kept per tenant and session: the five-minute slots with an event. A slot lies in six windows; a window gets one session more
when it has none of the session's other slots. What a micro-batch changes goes out as additions to (tenant, window), which are
summed per micro-batch, written to a folder of its own, and summed again by the reader.

Events are counted per slot and Arrow batch before the shuffle, so that a session with a third of all events is a few rows a task.
With a ``delay``, windows are final once the watermark has passed their end, and a timer clears a session's state when its last
window has; without one nothing is ever late and nothing is forgotten.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from footfall.sources import store

SLOT_MS = 5 * 60 * 1000
#: Slots of a window.
SLOTS = 6
_OUTPUT = "tenant_id string, until_ms long, events long, sessions long"


class _Sessions(StatefulProcessor):
    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "slots array<long>, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        slots, timer = self.seen.get() if self.seen.exists() else ([], None)
        seen = set(slots)
        events, sessions, counts = Counter(), Counter(), Counter()
        passed = timerValues.getCurrentWatermarkInMs() // SLOT_MS if self.timed else None
        for row in rows:
            counts[row["slot"]] += row["n"]
        for slot, n in counts.items():
            # Windows that the watermark has passed are final; their slots may be forgotten already.
            for window in range(max(slot, slot if passed is None else passed) + 1, slot + SLOTS + 1):
                events[window] += n
                # A window that ends with slot w - 1 has the slots from w - SLOTS on.
                if key[1] is not None and seen.isdisjoint(range(window - SLOTS, window)):
                    sessions[window] += 1
            seen.add(slot)
        due = timer
        if self.timed:
            seen = {slot for slot in seen if slot > passed - SLOTS}
            due = (max(counts.keys() | seen) + SLOTS + 1) * SLOT_MS
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
        self.seen.update((sorted(seen), due))
        for window, n in events.items():
            yield Row(tenant_id=key[0], until_ms=window * SLOT_MS, events=n, sessions=sessions[window])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events per tenant, session and slot of each batch of rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        counts = table.group_by(["tenant_id", "session_id", "slot"]).aggregate([([], "count_all")])
        columns = [counts[name] for name in ("tenant_id", "session_id", "slot")] + [counts["count_all"]]
        yield from pa.table(columns, names=["tenant_id", "session_id", "slot", "n"]).to_batches()


def activity_changes(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Additions to (tenant_id, until): ``events`` and ``sessions``. Events without a session count as events alone.

    The state store must be RocksDB (``limiter.state_store``).
    """
    slot = F.floor(F.unix_millis(F.col("time").cast("timestamp")) / SLOT_MS).cast("long")
    rows = events.select("tenant_id", F.col("session_id").cast("string").alias("session_id"), slot.alias("slot"))
    rows = rows.mapInArrow(_counted, "tenant_id string, session_id string, slot long, n long")
    if delay:
        rows = rows.withColumn("at", F.timestamp_millis(F.col("slot") * SLOT_MS)).withWatermark("at", delay)
    return rows.groupBy("tenant_id", "session_id").transformWithState(
        statefulProcessor=_Sessions(bool(delay)), outputStructType=_OUTPUT, outputMode="Append",
        timeMode="EventTime" if delay else "None",
    )


def _summed(changes: DataFrame, *keys: str) -> DataFrame:
    return changes.groupBy(*keys).agg(F.sum("events").alias("events"), F.sum("sessions").alias("sessions"))


def start_activity(changes: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch's additions to a folder of its own, written anew if the batch runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _summed(batch, "tenant_id", "until_ms").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = changes.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """``tenant_id, until, events, sessions`` of all windows so far."""
    done = store.committed(spark, path, "batch_id")
    schema = _OUTPUT
    changes = spark.read.schema(schema).parquet(*(f"{path}/batch_id={n}" for n in done)) if done else spark.createDataFrame([], schema)
    return _summed(changes, "tenant_id", "until_ms").select(
        "tenant_id", F.timestamp_millis("until_ms").cast("timestamp_ntz").alias("until"), "events", "sessions"
    )
