"""Tenant scope: reports never see a bare table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import timing


def same_tenant(column: str, tenant_id: str | None) -> Column:
    """True for rows of the tenant; without a tenant no row is visible."""
    if not tenant_id:
        return F.lit(False)
    return F.col(column) == tenant_id.lower()


@dataclass(frozen=True)
class TenantScope:
    """The rows of one tenant in a table that carries ``tenant_id``."""

    table: DataFrame
    tenant_id: str | None

    def rows(self) -> DataFrame:
        return self.table.where(same_tenant("tenant_id", self.tenant_id))

    def since(self, start: datetime, until: datetime | None = None) -> DataFrame:
        """Rows from ``start`` on. There is no upper bound unless ``until`` asks for one.

        A table partitioned by day is pruned by the added day predicate, the files by the one on
        ``time``.
        """
        rows = self.rows()
        if "event_date" in self.table.columns:
            rows = rows.where(F.col("event_date") >= F.lit(start.date()))
        rows = rows.where(F.col("time") >= timing.literal(start))
        if until is not None:
            if "event_date" in self.table.columns:
                rows = rows.where(F.col("event_date") <= F.lit(until.date()))
            rows = rows.where(F.col("time") <= timing.literal(until))
        return rows

    def foreign_rows(self, rows: DataFrame) -> DataFrame:
        """The rows that a write under this scope must refuse."""
        return rows.where(~F.coalesce(same_tenant("tenant_id", self.tenant_id), F.lit(False)))


def visible_tenants(tenants: DataFrame, tenant_id: str | None, user_id: str | None) -> DataFrame:
    """A tenant row is visible to its own scope or to its owner."""
    return tenants.where(same_tenant("id", tenant_id) | same_tenant("owner_user_id", user_id))
