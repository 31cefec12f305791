"""A stable number for each row of a table, so that repeated ids and texts can be told apart."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from footfall.operators.lookup import is_small
from footfall.session import stage


def addressed(docs: DataFrame) -> DataFrame:
    """``docs`` as a plain scan of files, whose rows have a place; anything else is written first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return stage(docs, "addressed")
    return docs


def row_number() -> Column:
    """The same for a row whichever way and however often the files are read.

    Two rows of a table share a number with a chance of 2**-64 per pair.
    """
    return F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that is no column of ``df``."""
    while name in df.columns:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` (a plain scan) without the rows numbered in ``dropped``; texts move only if there are many of these."""
    name = free_name(docs, "row")
    dropped = dropped.select(F.col("row").alias(name))
    dropped = F.broadcast(dropped) if is_small(dropped) else dropped
    return docs.select("*", row_number().alias(name)).join(dropped, name, "left_anti").drop(name)
