"""Arrivals cut into batches as they come: full, or once the first one has waited long enough.

State per queue: the arrivals that wait, fewer than a batch takes. A timer set by the first of them ends the batch if no later
arrival does. With the clock ``"arrival"`` time is that of the arrivals: the timer fires when the watermark passes it, and batches are
those of ``operators.batching`` if arrivals reach the stream in order. With the clock ``"wall"`` the first arrival waits ``wait_ms``
of real time, whatever its own time says.

A row without an id closes its queue, as a worker does that ends: what waits goes out.

A queue is one key, so its rows pass through one task per micro-batch, as they pass through one worker in the original; let
``queue`` name the worker or partition.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from footfall.functions import timing
from footfall.operators.batching import Batching

_OUTPUT = "queue string, number long, first_event long, first_ms long, size long, event_ids array<long>"


class _Batcher(StatefulProcessor):
    def __init__(self, batching: Batching, wall: bool):
        self.batching, self.wall = batching, wall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, ms long")
        self.meta = handle.getValueState("meta", "number long, due long")

    def _read(self) -> tuple[list, int, int | None]:
        number, due = self.meta.get() if self.meta.exists() else (0, None)
        return [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else [], number, due

    def _write(self, waiting: list, number: int, due: int | None, was: int | None) -> None:
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        self.meta.update((number, due))
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)

    def _batch(self, queue: str, number: int, waiting: list) -> Row:
        (first, ms), ids = waiting[0], [i for i, _ in waiting]
        return Row(queue=queue, number=number, first_event=first, first_ms=ms, size=len(ids), event_ids=ids)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting, number, was = self._read()
        due = was
        now = timerValues.getCurrentProcessingTimeInMs() if self.wall else None
        for row in sorted(rows, key=lambda r: (r["ms"], r["event_id"] is None, r["event_id"] or 0)):
            moment = now if self.wall else row["ms"]
            # The timer ends a batch after the waiting time; an arrival at that very millisecond still belongs to it.
            if waiting and (row["event_id"] is None or moment > due - 1):
                yield self._batch(key[0], number, waiting)
                waiting, number = [], number + 1
            if row["event_id"] is None:
                due = None
                continue
            if not waiting:
                due = moment + self.batching.wait_ms + 1
            waiting.append((row["event_id"], row["ms"]))
            if len(waiting) == self.batching.size:
                yield self._batch(key[0], number, waiting)
                waiting, number, due = [], number + 1, None
        self._write(waiting, number, due if waiting else None, was)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting, number, due = self._read()
        if waiting and due == expiredTimerInfo.getExpiryTimeInMs():
            yield self._batch(key[0], number, waiting)
            self.waiting.clear()
            self.meta.update((number + 1, None))

    def close(self) -> None:
        pass


def batched(
    arrivals: DataFrame, batching: Batching = Batching(), queue: str | None = None, clock: str = "arrival", delay: str = "0 seconds"
) -> DataFrame:
    """A stream of batches (``_OUTPUT``, ``first_time``) from a stream of event_id and arrived_at."""
    if clock not in ("arrival", "wall"):
        raise ValueError("clock must be arrival or wall")
    wall = clock == "wall"
    name = F.coalesce(F.col(queue).cast("string"), F.lit("")) if queue else F.lit("")
    rows = arrivals.select(
        name.alias("queue"), "event_id", F.col("arrived_at").cast("timestamp").alias("at"), timing.millis(F.col("arrived_at")).alias("ms")
    )
    if not wall:
        rows = rows.withWatermark("at", delay)
    out = rows.groupBy("queue").transformWithState(
        statefulProcessor=_Batcher(batching, wall), outputStructType=_OUTPUT, outputMode="Append",
        timeMode="ProcessingTime" if wall else "EventTime",
    )
    return out.withColumn("first_time", timing.from_millis(F.col("first_ms"))).drop("first_ms")
