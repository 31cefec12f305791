"""Joining facts to a dimension whose size is not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000
#: Of text; the driver holds the rows, their hash table and its serialised blocks, several times that.
BROADCAST_BYTES = 16 * 1024 * 1024


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` fits a broadcast; reads at most ``rows + 1`` rows to find out."""
    found = (
        df.limit(rows + 1)
        .agg(
            F.count("*").alias("rows"),
            F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size"),
        )
        .first()
    )
    return found["rows"] <= rows and found["size"] <= size


def sized(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it was counted to be small, else as it is."""
    return F.broadcast(df) if is_small(df) else df


def lookup(facts: DataFrame, dimension: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on ``key``, which has few rows in ``dimension`` and any share of the facts.

    A small dimension is broadcast, so the facts are not shuffled. A large one is dealt out by key and sent once; the
    partition that a hot key fills is cut up by adaptive execution, and only its few dimension rows are read again for each cut.
    Spark must not broadcast either side then: it goes by the size of compressed files, and the driver would hold all rows.
    """
    return facts.join(F.broadcast(dimension) if is_small(dimension) else dimension.hint("merge"), key, how)
