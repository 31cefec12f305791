"""Posts to stored events as a stream.

One micro-batch is admitted, rate limited, enriched, stored and relayed. Each output goes to a
folder of its own for the batch and is overwritten on replay, so a batch that ran half way can run
again. The carried limits are written last and so commit the batch: readers leave out anything newer
than the newest commit. Tenants are read anew for each batch. The rate limit carries each token's last window of
admissions from batch to batch; posts must reach the stream in order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.operators import admission, enrichment, live
from footfall.operators.ratelimit import Limit, admitted_counts, carry_over
from footfall.sources import store


@dataclass(frozen=True)
class IngestPipeline:
    spark: SparkSession
    root: str
    tenants: Callable[[], DataFrame]
    limit: Limit = Limit()

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/batch_id={batch_id}"

    def _kept(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = self._folder(name, batch_id)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _commits(self) -> list[int]:
        return store.committed(self.spark, f"{self.root}/limits", "batch_id")

    def newest(self) -> int:
        """The last batch that was written whole; -1 before the first."""
        return max(self._commits(), default=-1)

    def limits(self, before: int | None = None) -> DataFrame | None:
        """What the newest batch, or the newest one before another, carries over; None if there is no such batch."""
        earlier = [n for n in self._commits() if before is None or n < before]
        return self.spark.read.parquet(self._folder("limits", earlier[-1])) if earlier else None

    def commit(self, limits: DataFrame, batch_id: int) -> None:
        self._kept(limits, "limits", batch_id)

    def process(self, posts: DataFrame, batch_id: int) -> None:
        checked = admission.validate(posts)
        resolved = self._kept(admission.resolve(checked, self.tenants()), "landing", batch_id)

        waiting = resolved.where(F.col("status").isNull())
        carry = self.limits(before=batch_id)
        keep = lambda df, name: self._kept(df, name, batch_id)
        counts = keep(admitted_counts(waiting, self.limit, carry, keep), "counts")
        last_windows = counts.select("token", "ms", "admitted", "carried")
        if carry is not None:
            # Tokens without posts in this batch keep what later posts may still have to count.
            earliest = counts.where("fresh > 0").agg(F.min("ms")).first()[0]
            idle = carry.join(counts.select("token").distinct(), "token", "left_anti")
            if earliest is not None:
                idle = idle.where(F.col("ms") > earliest - self.limit.window_ms)
            idle = idle.select("token", "ms", F.lit(0).cast("long").alias("admitted"), F.col("admitted").alias("carried"))
            last_windows = last_windows.unionByName(idle)
        outcomes = admission.apply_limit(resolved, self.limit, carry, counts)
        outcomes = self._kept(admission.with_reason(outcomes), "outcomes", batch_id)

        self._kept(admission.rejects(outcomes), "quarantine", batch_id)
        # Accepted posts keep every rule for jobs; enrichment.split_jobs is for jobs from elsewhere.
        events = enrichment.enrich(admission.jobs(outcomes))
        store.write_batch(events, f"{self.root}/events", batch_id)
        stored = store.read_batch(self.spark, f"{self.root}/events", batch_id)
        self._kept(live.relay(stored), "feed", batch_id)
        self.commit(carry_over(last_windows, self.limit), batch_id)

    def start(self, posts: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Run until stopped, every ``every``; without it, take what is there and end."""
        writer = posts.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.start()

    def events(self) -> DataFrame:
        return store.read_events(self.spark, f"{self.root}/events", self.newest())

    def compact(self) -> int | None:
        return store.compact(self.spark, f"{self.root}/events", self.newest())

    def _batches(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("batch_id") <= self.newest())

    def outcomes(self) -> DataFrame:
        return self._batches("outcomes")

    def quarantine(self) -> DataFrame:
        return self._batches("quarantine")

    def feed(self) -> DataFrame:
        return self._batches("feed")
