"""The rate limit as a stateful stream operator, for low latency.

State per token: the admissions of its last window, at most ``limit`` of them, in RocksDB. Within a
micro-batch a token's posts are sorted in one task, so cap the micro-batch (files or offsets per
trigger) if one token may fill it; ``IngestPipeline`` has no such bound to watch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from footfall.functions import timing
from footfall.operators.ratelimit import Limit

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUTPUT = "token string, event_id long, ms long, allowed boolean, remaining long"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Start the stream within this; the setting of the session comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Limiter(StatefulProcessor):
    def __init__(self, limit: Limit):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getValueState("admitted", "times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        window, most = self.limit.window_ms, self.limit.max_events
        times = deque(self.admitted.get()[0] if self.admitted.exists() else ())
        posts = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "event_id"])
        allowed, remaining = [], []
        for ms in posts["ms"].tolist():
            while times and times[0] <= ms - window:
                times.popleft()
            fits = len(times) < most
            if fits:
                times.append(ms)
            allowed.append(fits)
            remaining.append(most - len(times) if fits else 0)
        self.admitted.update((list(times),))
        yield posts.assign(allowed=allowed, remaining=remaining)[
            ["token", "event_id", "ms", "allowed", "remaining"]
        ]

    def close(self) -> None:
        pass


def limited(posts: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """Verdicts for a stream of (event_id, token, arrived_at)."""
    keyed = posts.select("token", "event_id", timing.millis(F.col("arrived_at")).alias("ms"))
    return (
        keyed.groupBy("token")
        .transformWithStateInPandas(
            statefulProcessor=_Limiter(limit),
            outputStructType=_OUTPUT,
            outputMode="Append",
            timeMode="None",
        )
        .withColumn("reset_at", timing.from_millis(F.col("ms") + limit.window_ms))
    )
