"""Funnel conversion: how many sessions reach each step of an ordered list of events.

A session reaches a step at the first event of that name that comes after the one that reached
the step before, in order of time, then event id.

A session may hold any share of the events. Step events are therefore range-partitioned on
(tenant, session, time, event id), which cuts a long session into several partitions. A partition
reduces its stretch of a session to a few numbers - for each count of steps reached before it, the
count reached after it - and these are chained per session. There are at most as many stretches
of a session as partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

MAX_STEPS = 12


_KEY = ["tenant_id", "session_id"]
_ORDER = [*_KEY, "time", "event_id"]


def _reached(places: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per stretch of rows, steps reached after it for each number of steps reached before it.

    ``places`` holds, per step, the sorted row numbers of its events.
    """
    steps = len(places)
    after = np.empty((len(starts), steps + 1), dtype=np.int32)
    for before in range(steps + 1):
        count = np.full(len(starts), before, dtype=np.int32)
        last = starts - 1
        going = np.ones(len(starts), dtype=bool)
        for step in range(before, steps):
            found = places[step]
            place = np.searchsorted(found, last, side="right")
            here = np.append(found, np.iinfo(np.int64).max)[place]
            going &= here < ends
            count[going] += 1
            last = np.where(going, here, last)
        after[:, before] = count
    return after


def _stretches(codes: list[int]):
    """Reduce sorted step events to one row per session and partition."""

    def with_after(rows: pa.RecordBatch, after: np.ndarray) -> pa.RecordBatch:
        offsets = np.arange(len(after) + 1, dtype=np.int32) * (len(codes) + 1)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(after.ravel()))
        return pa.RecordBatch.from_arrays([*rows.columns, lists], [*_ORDER, "after"])

    def key(row: pa.RecordBatch) -> list:
        return [row.column(name)[0].as_py() for name in _KEY]

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last session of a batch may go on in the next one.
        held_row, held_after = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            changes = np.zeros(batch.num_rows - 1, dtype=bool)
            for name in _KEY:
                column = batch.column(name)
                changes |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, changes))
            ends = np.append(starts[1:], batch.num_rows)
            code = batch.column("code").to_numpy()
            after = _reached([np.flatnonzero(code == c) for c in codes], starts, ends)
            rows = batch.select(_ORDER).take(pa.array(starts))
            if held_row is not None and key(held_row) == key(rows):
                held_after = after[:1, held_after[0]]
                rows, after = rows.slice(1), after[1:]
                if not rows.num_rows:
                    continue
            if held_row is not None:
                yield with_after(held_row, held_after)
            yield with_after(rows.slice(0, rows.num_rows - 1), after[:-1])
            held_row, held_after = rows.slice(rows.num_rows - 1), after[-1:]
        if held_row is not None:
            yield with_after(held_row, held_after)

    return reduce


def session_reach(events: DataFrame, steps: list[str]) -> DataFrame:
    """``reached``: steps each session got through; sessions that reach none may be absent."""
    if not 1 <= len(steps) <= MAX_STEPS:
        raise ValueError("a funnel has 1 to 12 steps")
    names = sorted(set(steps))
    code = F.array_position(F.lit(names), F.col("event_name")).cast("int")
    step_events = events.where(F.col("event_name").isin(names)).select(*_ORDER, code.alias("code"))
    schema = "tenant_id string, session_id string, time timestamp_ntz, event_id long, after array<int>"
    stretches = (
        step_events.repartitionByRange(*_ORDER)
        .sortWithinPartitions(*_ORDER)
        .mapInArrow(_stretches([names.index(s) + 1 for s in steps]), schema)
    )
    in_order = F.array_sort(F.collect_list(F.struct("time", "event_id", "after")))
    chained = F.aggregate(
        in_order, F.lit(0), lambda so_far, stretch: F.get(stretch["after"], so_far)
    )
    return stretches.groupBy("tenant_id", "session_id").agg(chained.alias("reached"))


def conversion(events: DataFrame, steps: list[str]) -> DataFrame:
    """Sessions that reach each step, and shares of the first and of the previous step."""
    reach = session_reach(events, steps)
    spark = events.sparkSession
    counted = (
        reach.groupBy("reached")
        .agg(F.count("*").alias("sessions"))
        .select("sessions", F.explode(F.sequence(F.lit(0), "reached")).alias("step_no"))
        .groupBy("step_no")
        .agg(F.sum("sessions").alias("reached"))
    )
    listed = spark.createDataFrame(
        [(n, name) for n, name in enumerate(steps, 1)], "step_no int, event string"
    )
    ordered = Window.orderBy("step_no")
    first = F.first("reached").over(ordered)
    previous = F.lag("reached").over(ordered)
    share = lambda base: F.col("reached") / F.nullif(base, F.lit(0))
    return (
        listed.join(counted, "step_no", "left")
        .withColumn("reached", F.coalesce("reached", F.lit(0)))
        .select(
            "step_no",
            "event",
            "reached",
            share(first).alias("conversion_from_start"),
            F.when(F.col("step_no") == 1, share(first)).otherwise(share(previous)).alias("conversion_from_prev"),
        )
        .orderBy("step_no")
    )
