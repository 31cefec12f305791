"""Sliding-window rate limit per token.

An event is admitted if fewer than ``limit`` events of its token were admitted in the window
``(t - window, t]``; a refused event uses up nothing. Events of one token are taken in the order of
arrival millisecond, then event id.

A token may hold any share of the rows, so no step takes a token's events into one task:

1. Events are counted per token and millisecond (combined before the shuffle).
2. Arrivals in the window are running sums within time blocks of a token.
3. Only where arrivals exceed the limit does admission depend on what was refused before. Blocks
   are chained up to the next block boundary that has a whole window without such an excess
   before it; what was admitted there is known, so a chain starts afresh. Chains without an
   excess are admitted as they are.
4. Only chains with an excess are walked in order, as a stream of (millisecond, count) rows that
   remembers at most ``limit`` admissions. A chain's length is bounded by its time span in
   milliseconds, not by its events.
5. Verdicts go back to the events by token and millisecond.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.functions import timing
from footfall.session import stage

BLOCK_WINDOWS = 8


@dataclass(frozen=True)
class Limit:
    """Defaults are those of the reference collector."""

    max_events: int = 1000
    window_seconds: int = 60

    @property
    def window_ms(self) -> int:
        return self.window_seconds * 1000

    @property
    def block_ms(self) -> int:
        return self.window_ms * BLOCK_WINDOWS


def _block(ms: Column, limit: Limit) -> Column:
    return F.floor(ms / F.lit(limit.block_ms)).cast("long")


def _ms_in_block(limit: Limit) -> Column:
    return F.pmod(F.col("ms"), F.lit(limit.block_ms))


def arrivals(events: DataFrame) -> DataFrame:
    """Events per token and millisecond of arrival."""
    return (
        events.select("token", timing.millis(F.col("arrived_at")).alias("ms"))
        .groupBy("token", "ms")
        .agg(F.count("*").alias("fresh"))
    )


def window_sums(counts: DataFrame, amount: str, total: str, limit: Limit) -> DataFrame:
    """Adds ``total``: the sum of ``amount`` over ``(ms - window, ms]`` of the same token.

    Each row adds its amount at ``ms`` and takes it away at ``ms + window``, in every block that
    this span touches; the running sum within a block is then the window's sum.
    """
    last_block = _block(F.col("ms") + F.lit(limit.window_ms - 1), limit)
    changes = counts.withColumn(
        "block", F.explode(F.sequence(_block(F.col("ms"), limit), last_block))
    ).withColumn(
        "change",
        F.explode(
            F.array(
                F.struct(F.col("ms").alias("at"), F.col(amount).alias("by"), F.lit(True).alias("own")),
                F.struct(
                    (F.col("ms") + limit.window_ms).alias("at"),
                    (-F.col(amount)).alias("by"),
                    F.lit(False).alias("own"),
                ),
            )
        ),
    )
    so_far = (
        Window.partitionBy("token", "block")
        .orderBy("change.at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        changes.withColumn(total, F.sum("change.by").over(so_far))
        .where(F.col("change.own") & (F.col("block") == _block(F.col("ms"), limit)))
        .select("token", "block", *[c for c in counts.columns if c not in ("token", "block")], total)
    )


def arrival_rate(events: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """Arrivals in the window at each millisecond that has any."""
    counted = window_sums(arrivals(events), "fresh", "in_window", limit)
    return counted.select("token", "ms", F.col("fresh").alias("arrivals"), "in_window")


def _chains(rated: DataFrame, limit: Limit) -> DataFrame:
    """Blocks of a token with the chain they belong to and whether that chain has an excess."""
    excess = F.col("in_window") > limit.max_events
    in_tail = _ms_in_block(limit) > limit.block_ms - limit.window_ms
    blocks = rated.groupBy("token", "block").agg(
        F.max(excess).alias("hot"), F.max(excess & in_tail).alias("hot_tail")
    )
    in_order = Window.partitionBy("token").orderBy("block")
    goes_on = (F.lag("block").over(in_order) == F.col("block") - 1) & F.lag("hot_tail").over(in_order)
    started = blocks.withColumn(
        "start", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("block"))
    )
    chained = started.withColumn("chain", F.max("start").over(in_order))
    return chained.select(
        "token",
        "block",
        "chain",
        F.max("hot").over(Window.partitionBy("token", "chain")).alias("chain_hot"),
    )


def _walk(limit: Limit):
    """Quota per (token, chain, millisecond), reading rows sorted by exactly these."""
    window, most = limit.window_ms, limit.max_events

    def walk(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted, used = None, deque(), 0
        for frame in frames:
            tokens, chains = frame["token"].tolist(), frame["chain"].tolist()
            times, fresh = frame["ms"].tolist(), frame["fresh"].tolist()
            carried, lead = frame["carried"].tolist(), frame["lead"].tolist()
            may_skip = not any(carried)
            quotas, in_use = [0] * len(times), [most] * len(times)
            row, end = 0, 0
            while row < len(times):
                if row == end:
                    key = tokens[row], chains[row]
                    if key != current:
                        current, admitted, used = key, deque(), 0
                    end = row + 1
                    while end < len(times) and tokens[end] == key[0] and chains[end] == key[1]:
                        end += 1
                ms = times[row]
                while admitted and admitted[0][0] <= ms - window:
                    used -= admitted.popleft()[1]
                if lead[row]:
                    # Before the chain, hence admitted already.
                    quotas[row] = fresh[row]
                elif used < most:
                    quotas[row] = min(fresh[row], max(most - used - carried[row], 0))
                elif may_skip:
                    # Nothing is admitted until the oldest admission leaves the window.
                    row = bisect_left(times, admitted[0][0] + window, row + 1, end)
                    continue
                taken = quotas[row] + carried[row]
                if taken:
                    admitted.append((ms, taken))
                    used += taken
                in_use[row] = used
                row += 1
            out = frame[["token", "ms", "fresh", "carried"]].assign(admitted=quotas, used=in_use)
            yield out[~frame["lead"].to_numpy()]

    return walk


def admitted_counts(
    events: DataFrame, limit: Limit, carry: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """Per token and millisecond: ``fresh`` arrivals, how many are ``admitted``, ``carried`` ones, and
    the quota ``used`` in the window after them (all of it where any was refused).

    ``carry`` (token, ms, admitted) holds the admissions of an earlier run that still count. ``keep``
    writes the counted arrivals, which three steps read.
    """
    counts = arrivals(events)
    if carry is None:
        counts = counts.withColumn("carried", F.lit(0).cast("long"))
    else:
        earlier = carry.select(
            "token", "ms", F.lit(0).cast("long").alias("fresh"), F.col("admitted").alias("carried")
        )
        counts = (
            counts.withColumn("carried", F.lit(0).cast("long"))
            .unionByName(earlier)
            .groupBy("token", "ms")
            .agg(F.sum("fresh").alias("fresh"), F.sum("carried").alias("carried"))
        )
    counts = counts.withColumn("arrived", F.col("fresh") + F.col("carried"))
    rated = keep(window_sums(counts, "arrived", "in_window", limit), "arrivals")

    # A row belongs to its own block. One in the last window of its block also leads into the next
    # block: if a chain starts there, the row was admitted whole and still counts.
    own = F.struct(F.col("block"), F.lit(False).alias("lead"))
    ahead = F.struct((F.col("block") + 1).alias("block"), F.lit(True).alias("lead"))
    in_tail = _ms_in_block(limit) > limit.block_ms - limit.window_ms
    places = F.when(in_tail, F.array(own, ahead)).otherwise(F.array(own))
    hot = _chains(rated, limit).where("chain_hot")
    walked = (
        rated.select("token", "ms", "fresh", "carried", F.inline(places))
        .join(hot, ["token", "block"])
        .where(~F.col("lead") | (F.col("chain") == F.col("block")))
        .select("token", "chain", "ms", "fresh", "carried", "lead")
        .repartition("token", "chain")
        .sortWithinPartitions("token", "chain", "ms")
        .mapInPandas(
            _walk(limit), "token string, ms long, fresh long, carried long, admitted long, used long"
        )
    )
    # Nothing was refused in the windows of a chain without an excess: arrivals are admissions.
    calm = rated.join(hot, ["token", "block"], "left_anti").select(
        "token", "ms", "fresh", "carried", F.col("fresh").alias("admitted"), F.col("in_window").alias("used")
    )
    return calm.unionByName(walked)


def rate_limit(
    events: DataFrame, limit: Limit = Limit(), carry: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Events with ``allowed``, ``remaining`` and ``reset_at``.

    ``events`` needs ``event_id``, ``token`` and ``arrived_at``.
    """
    if counts is None:
        counts = admitted_counts(events, limit, carry)
    quota = counts.select(
        "token", F.col("ms").alias("_ms"), F.col("admitted").alias("_admitted"), F.col("used").alias("_used")
    )
    rank = F.row_number().over(Window.partitionBy("token", "_ms").orderBy("event_id"))
    ranked = (
        events.withColumn("_ms", timing.millis(F.col("arrived_at")))
        .join(quota, ["token", "_ms"])
        .withColumn("_rank", rank)
    )
    allowed = F.col("_rank") <= F.col("_admitted")
    left = F.lit(limit.max_events) - (F.col("_used") - F.col("_admitted") + F.col("_rank"))
    return ranked.select(
        *events.columns,
        allowed.alias("allowed"),
        F.when(allowed, F.greatest(left, F.lit(0))).otherwise(0).cast("long").alias("remaining"),
        timing.from_millis(F.col("_ms") + limit.window_ms).alias("reset_at"),
    )


def carry_over(counts: DataFrame, limit: Limit) -> DataFrame:
    """The admissions that later arrivals still have to count: each token's last window."""
    last = counts.groupBy("token").agg(F.max("ms").alias("last"))
    return (
        counts.join(last, "token")
        .where(F.col("ms") > F.col("last") - limit.window_ms)
        .select("token", "ms", (F.col("admitted") + F.col("carried")).alias("admitted"))
        .where("admitted > 0")
    )
