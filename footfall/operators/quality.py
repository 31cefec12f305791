"""Integrity rules that files do not enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def required(schema: T.StructType) -> list[str]:
    """Columns that must have no NULL."""
    return [f.name for f in schema.fields if not f.nullable]


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs in each of ``columns``, in one pass."""
    counts = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return counts.unpivot([], columns, "column_name", "null_count")


def unique_audit(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once; NULL keys do not clash."""
    present = F.lit(True)
    for name in key:
        present = present & F.col(name).isNotNull()
    return (
        df.where(present).groupBy(*key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    )


def orphan_audit(df: DataFrame, tenants: DataFrame) -> DataFrame:
    """Rows per tenant id that no tenant has; counted per id before the join."""
    counted = df.groupBy("tenant_id").agg(F.count("*").alias("rows"))
    return counted.join(tenants.select(F.col("id").alias("tenant_id")), "tenant_id", "left_anti")
