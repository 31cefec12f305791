"""Jobs that fail are tried again after a pause that doubles, and set aside after the last attempt.

A micro-batch tries its new jobs and those waiting jobs whose time has come by its clock, which is the latest arrival it
has seen. A job that fails waits ``delay_ms``, then twice as long, and so on; the table of waiting jobs (attempt, due time) is the
queue's state and is written as a new version by each micro-batch, last of all, which commits the batch. A batch that runs again
reads the version before it and writes the same folders. Waiting jobs are never gathered or grouped; each attempt is a plain
pass over the jobs that are due, and a clock that has moved far ahead lets a job use up several attempts in one batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.functions import timing
from footfall.session import stage
from footfall.sources import store

DONE, DEAD = "done", "dead"


@dataclass(frozen=True)
class Retry:
    """Defaults are those of the reference queue."""

    attempts: int = 3
    delay_ms: int = 1000

    def pause(self, attempt: Column) -> Column:
        """Milliseconds after a failed attempt."""
        return F.lit(self.delay_ms) * F.call_function("shiftleft", F.lit(1).cast("long"), attempt - 1)


@dataclass(frozen=True)
class RetryQueue:
    """``work`` does the jobs it is given (their columns and ``attempt``) and returns them with a boolean ``failed``."""

    spark: SparkSession
    root: str
    work: Callable[[DataFrame], DataFrame]
    retry: Retry = Retry()

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/batch_id={batch_id}"

    def _versions(self) -> list[int]:
        return store.committed(self.spark, f"{self.root}/waiting", "batch_id")

    def waiting(self, before: int | None = None) -> DataFrame | None:
        """Jobs with ``attempt`` (the next one) and ``due_ms`` after the newest batch, or the newest before another."""
        earlier = [n for n in self._versions() if before is None or n < before]
        return self.spark.read.parquet(self._folder("waiting", earlier[-1])) if earlier else None

    def process(self, jobs: DataFrame, batch_id: int) -> None:
        """Jobs have arrived_at and any other columns."""
        new = jobs.withColumns({"attempt": F.lit(1), "due_ms": timing.millis(F.col("arrived_at"))})
        new = stage(new, "retry-new")
        self._run(new, new.agg(F.max("due_ms")).first()[0], batch_id)

    def finish(self) -> None:
        """Let all pauses pass: every job ends done or dead."""
        if (newest := max(self._versions(), default=None)) is not None:
            self._run(self.waiting().limit(0), None, newest + 1, whole=True)

    def _run(self, new: DataFrame, clock: int | None, batch_id: int, whole: bool = False) -> None:
        before = self.waiting(before=batch_id)
        pool = new if before is None else new.unionByName(before.select(new.columns))
        ended, later = [], []
        # A job has at most so many attempts, hence so many rounds.
        for _ in range(self.retry.attempts):
            due = F.lit(whole) | (F.col("due_ms") <= (clock if clock is not None else -1))
            later.append(pool.where(~due))
            tried = stage(self.work(pool.where(due)), "retry-tried")
            failed = F.coalesce("failed", F.lit(True))
            last = F.col("attempt") >= self.retry.attempts
            ended.append(tried.where(~failed | last).withColumn("status", F.when(failed, DEAD).otherwise(DONE)).drop("failed"))
            again = tried.where(failed & ~last).drop("failed")
            pool = again.withColumns({
                "due_ms": F.col("due_ms") + self.retry.pause(F.col("attempt")), "attempt": F.col("attempt") + 1,
            }).select(new.columns)
            if again.isEmpty():
                break
        outcomes = reduce(DataFrame.unionByName, ended)
        outcomes = outcomes.withColumnRenamed("attempt", "attempts").withColumn("finished_at", timing.from_millis(F.col("due_ms"))).drop("due_ms")
        outcomes.write.mode("overwrite").parquet(self._folder("outcomes", batch_id))
        # After the last round no job is due and has attempts left.
        left = reduce(DataFrame.unionByName, later)
        left.write.mode("overwrite").parquet(self._folder("waiting", batch_id))

    def start(self, jobs: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        writer = jobs.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.start()

    def outcomes(self) -> DataFrame:
        """Jobs that ended: their columns, ``attempts``, ``status`` (done or dead) and ``finished_at``."""
        folders = [self._folder("outcomes", n) for n in self._versions()]
        return self.spark.read.parquet(*folders)

    def dead_letters(self) -> DataFrame:
        return self.outcomes().where(F.col("status") == DEAD)
