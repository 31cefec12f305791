"""Arrivals cut into the batches in which a worker stores them.

A batch begins with the first arrival that waits; it ends when it is full, or when an arrival comes more than the waiting time
after its first one. So where a batch ends follows from its first arrival alone, but where it begins from all batches before it:
``operators.chains`` finds the beginnings without walking the queue in one task.

Arrivals are numbered in the order of millisecond, then id, by running sums of counts per second within days, so that no task
sorts a whole queue.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from footfall.functions import timing
from footfall.operators import chains
from footfall.session import stage

#: Arrivals in a block, of which one task takes the places at once.
BLOCK = 1 << 16
SECOND_MS = 1000
DAY_SECONDS = 86_400


@dataclass(frozen=True)
class Batching:
    """Defaults are those of the reference worker."""

    size: int = 50
    wait_ms: int = 1000


def placed(arrivals: DataFrame) -> DataFrame:
    """``queue, event_id, ms`` with ``place``, the number of earlier arrivals in the queue."""
    timed = arrivals.withColumn("second", F.floor(F.col("ms") / SECOND_MS)).withColumn("day", F.floor(F.col("second") / DAY_SECONDS))
    by_second = timed.groupBy("queue", "day", "second").agg(F.count("*").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    days = by_second.groupBy("queue", "day").agg(F.sum("n").alias("n"))
    days = days.select("queue", "day", F.coalesce(F.sum("n").over(before("queue", "day")), none).alias("days_before"))
    seconds = by_second.select(
        "queue", "day", "second", F.coalesce(F.sum("n").over(before("queue", "day", "second")), none).alias("seconds_before")
    )
    offsets = seconds.join(days, ["queue", "day"]).select("queue", "second", (F.col("days_before") + F.col("seconds_before")).alias("before"))
    in_second = Window.partitionBy("queue", "second").orderBy("ms", "event_id")
    return (
        timed.withColumn("nth", F.row_number().over(in_second) - 1)
        .join(offsets, ["queue", "second"])
        .select("queue", "event_id", "ms", (F.col("before") + F.col("nth")).alias("place"))
    )


def _bounded(rows: DataFrame, batching: Batching, block: int) -> DataFrame:
    """Adds ``bound``: the place at which the batch after one that begins here begins."""
    # A block also sees as many arrivals of the next one as a batch may take.
    own = F.floor(F.col("place") / block)
    looks = F.when((F.col("place") % block < batching.size) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))

    # A search for each arrival: a window over the waiting time would add up all that come within it, for each arrival anew.
    def bounds(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        place, ms = (group[name].to_numpy() for name in ("place", "ms"))
        last = place[np.searchsorted(ms, ms + batching.wait_ms, "right") - 1]
        found = group.append_column("bound", pa.array(np.minimum(place + batching.size, last + 1)))
        return found.filter(pa.array(place // block == group["seen_by"][0].as_py())).drop_columns("seen_by")

    out = T.StructType([*rows.schema.fields, T.StructField("bound", T.LongType())])
    return rows.withColumn("seen_by", F.explode(looks)).groupBy("queue", "seen_by").applyInArrow(bounds, out)


def batches(arrivals: DataFrame, batching: Batching = Batching(), queue: str | None = None, block: int = BLOCK) -> DataFrame:
    """``queue, number, first_event, first_time, size`` of every batch of arrivals (event_id, arrived_at).

    All arrivals are one queue unless a column of ``arrivals`` names it; an empty name stands for none.
    """
    if block < batching.size:
        raise ValueError("a block must hold a whole batch")
    name = F.coalesce(F.col(queue).cast("string"), F.lit("")) if queue else F.lit("")
    timed = arrivals.select(name.alias("queue"), "event_id", timing.millis(F.col("arrived_at")).alias("ms"))
    # Blocks of the look ahead need not be those of the chains; larger ones are fewer calls.
    rows = stage(_bounded(placed(timed), batching, max(block, BLOCK)), "batch-places")
    found = chains.spans(rows, ["queue"], batching.size, block)
    firsts = found.where(F.col("place") == F.col("begin")).select("queue", "place", "number")
    return firsts.join(rows, ["queue", "place"]).select(
        "queue", "number", F.col("event_id").alias("first_event"), timing.from_millis(F.col("ms")).alias("first_time"),
        (F.col("bound") - F.col("place")).alias("size"),
    )
