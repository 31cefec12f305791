"""Spans of ordered rows, where the first row of a span decides where the span ends.

A row has a ``place`` in its queue and a ``bound``; a span that begins with it ends before the first row whose place is not
below the bound, and the next one begins there. Which rows begin a span depends on all rows before them, yet a queue may
hold all rows there are, so no task walks a queue:

1. Places are cut into blocks at least as long as the farthest bound (``reach``). A span that comes from the block before can end
   only within ``reach`` of the block's first place, so for each row there the block notes where the chain that begins with it leaves the block, how
   many spans it has begun, and the last of them. Neighbouring rows with the same answer are one entry; chains soon meet, so a
   block is one small row.
2. Along a queue these small rows are followed in order, which gives the bound at which each block is entered.
3. Each block walks its own rows once more from there.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from footfall.session import stage

_TABLE = ("upto", "exits", "begun", "lasts")


def _next(places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row the one at which the next span begins; the number of rows if that is in a later block."""
    return np.searchsorted(places, bounds)


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    places, bounds = (rows[name].to_numpy() for name in ("place", "bound"))
    order = np.argsort(places, kind="stable")
    return places[order], bounds[order]


def _summary(places: np.ndarray, bounds: np.ndarray, begin: int, reach: int) -> tuple[np.ndarray, ...]:
    """``upto, exits, begun, lasts``: for an entry bound not above ``upto``, what ``chains`` says of the block."""
    n, following = len(places), _next(places, bounds)
    entries = min(int(np.searchsorted(places, begin + reach)) + 1, n)
    at = np.arange(entries)
    last, begun = at.copy(), np.zeros(entries, np.int64)
    going = at.copy()
    while len(going):
        last[going] = at[going]
        begun[going] += 1
        at[going] = following[at[going]]
        going = going[at[going] < n]
    exits, lasts = bounds[last], places[last]
    differs = np.ones(entries, bool)
    differs[:-1] = (lasts[1:] != lasts[:-1]) | (begun[1:] != begun[:-1])
    return tuple(values[differs] for values in (places[:entries], exits, begun, lasts))


def spans(rows: DataFrame, keys: list[str], reach: int, block: int) -> DataFrame:
    """Adds ``begin`` (place at which the row's span begins) and ``number`` (of the span in its queue, from 0).

    ``rows`` has ``keys``, ``place`` and ``bound``, with ``place < bound <= place + reach`` and no place twice in a queue. Null keys are a queue.
    """
    if block < reach:
        raise ValueError("a block must reach as far as a span")
    rows = stage(
        rows.select(*keys, "place", "bound").withColumn("block", F.floor(F.col("place") / block).cast("long")), "chain-rows"
    )
    key_fields = [rows.schema[key] for key in keys]
    longs = lambda *names: [T.StructField(name, T.LongType()) for name in names]
    arrays = [T.StructField(name, T.ArrayType(T.LongType())) for name in _TABLE]
    heads = [*keys, "block"]

    def summed(group: pa.Table) -> pa.Table:
        found = _summary(*_sorted(group), group["block"][0].as_py() * block, reach)
        head = group.select(heads).slice(0, 1)
        for name, values in zip(_TABLE, found):
            head = head.append_column(name, pa.array([values.tolist()], pa.list_(pa.int64())))
        return head

    def followed(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        entry, number, last = None, 0, None
        entries, numbers, lasts = [], [], []
        for row in group.select(["block", *_TABLE]).to_pylist():
            entries.append(entry)
            numbers.append(number)
            lasts.append(last)
            at = 0 if entry is None else bisect_left(row["upto"], entry)
            if at < len(row["upto"]):
                entry, last = row["exits"][at], row["lasts"][at]
                number += row["begun"][at]
        out = group.select(heads)
        for name, values in (("entry", entries), ("numbers", numbers), ("before", lasts)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    def walked(group: pa.Table, entered: pa.Table) -> pa.Table:
        places, bounds = _sorted(group)
        following = _next(places, bounds).tolist()
        entry, number, before = (entered[name][0].as_py() for name in ("entry", "numbers", "before"))
        begins = np.zeros(len(places), bool)
        at = 0 if entry is None else int(np.searchsorted(places, entry))
        while at < len(places):
            begins[at] = True
            at = following[at]
        so_far = np.cumsum(begins)
        first = places[begins]
        begin = np.where(so_far > 0, first[np.maximum(so_far - 1, 0)] if len(first) else 0, -1 if before is None else before)
        columns = [pa.repeat(group[key][0], len(places)) for key in keys]
        columns += [pa.array(x, pa.int64()) for x in (places, bounds, begin, number + so_far - 1)]
        return pa.table(columns, names=[*keys, "place", "bound", "begin", "number"])

    by_block = rows.groupBy(*heads)
    tables = by_block.applyInArrow(summed, T.StructType(key_fields + longs("block") + arrays))
    entries = tables.groupBy(*keys).applyInArrow(followed, T.StructType(key_fields + longs("block", "entry", "numbers", "before")))
    out = T.StructType(key_fields + longs("place", "bound", "begin", "number"))
    return by_block.cogroup(entries.groupBy(*heads)).applyInArrow(walked, out)
