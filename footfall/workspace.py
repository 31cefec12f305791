"""The whole application over one folder: what the collector and the dashboard offer.

Tenants and funnels are append-only tables beside the event store. Reports take the id of the
signed-in user and see that user's tenant only.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from footfall import schemas
from footfall.functions import timing
from footfall.operators import funnels, live, stats, tenancy
from footfall.operators.ratelimit import Limit
from footfall.operators.scope import TenantScope
from footfall.sources import store
from footfall.sources.table import REMOVED, Table
from footfall.streaming.ingest import IngestPipeline


class TenantNotSetUp(LookupError):
    """The user owns no tenant yet."""


@dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    root: str
    limit: Limit = Limit()

    # Tenants and definitions

    def _table(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # an unreadable table is not an empty one
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.root}/{name}")

    def _present(self, rows: DataFrame, tenant_column: str = "tenant_id") -> DataFrame:
        """Rows without those of removed tenants."""
        removed = self._removed()
        return tenancy.purge(rows, removed.read(), tenant_column) if removed.state().files else rows

    def _removed(self) -> Table:
        return Table(self.spark, f"{self.root}/removed", REMOVED)

    def tenant_log(self) -> DataFrame:
        return self._present(self._table("tenants", schemas.TENANT_LOG), "id")

    def tenants(self) -> DataFrame:
        return tenancy.latest(self.tenant_log()).select(schemas.TENANTS.names)

    def funnel_rows(self) -> DataFrame:
        return self._present(self._table("funnels", schemas.FUNNELS))

    def setup_tenants(self, requests: DataFrame) -> None:
        """Requests have owner_user_id, name, requested_at and request_id."""
        new = tenancy.setup(self.tenants(), requests, F.expr("uuid()"), F.expr("uuid()"))
        self._append(new.withColumn("version", F.lit(0).cast("long")), "tenants")

    def update_domains(self, changes: DataFrame) -> None:
        """Changes have id, domains and version; versions grow."""
        self._append(tenancy.with_domains(self.tenant_log(), changes), "tenants")

    def create_funnels(self, requests: DataFrame) -> None:
        """Requests have tenant_id, name, steps and created_at."""
        self._append(tenancy.new_funnels(requests, F.expr("uuid()")), "funnels")

    def remove_tenants(self, gone: DataFrame) -> None:
        """Leave tenants (tenant_id) with their events and funnels out of everything from now on, without rewriting anything.

        Their tokens are unknown from the next batch on. ``purge_tenants`` lets their bytes go.
        """
        self._removed().append(gone.select("tenant_id").where("tenant_id IS NOT NULL").distinct())

    def purge_tenants(self, gone: DataFrame) -> None:
        """Remove tenants (tenant_id) with their events and funnels.

        What stays is written to the folder's next generation; ``self`` still names the old one.
        """
        target = Workspace(self.spark, f"{self.root}-purged", self.limit)
        limits = self.pipeline().limits()
        if limits is not None:
            events = tenancy.purge(self.events(), gone).select(schemas.EVENTS.names)
            store.write_batch(events, f"{target.root}/events", 0)
            tokens = self.tenant_log().join(gone.select(F.col("tenant_id").alias("id")), "id").select("token").distinct()
            target.pipeline().commit(limits.join(tokens, "token", "left_anti"), 0)
        tenants = tenancy.purge(self.tenant_log(), gone, "id")
        tenants.write.mode("overwrite").parquet(f"{target.root}/tenants")
        definitions = tenancy.purge(self.funnel_rows(), gone)
        definitions.write.mode("overwrite").parquet(f"{target.root}/funnels")

    # Events in

    def pipeline(self) -> IngestPipeline:
        return IngestPipeline(self.spark, self.root, self.tenants, self.limit)

    def ingest(self, posts: DataFrame) -> DataFrame:
        """Take a batch of posts (``schemas.RAW``); returns each post's outcome.

        A call that failed left nothing that reports read, and the next one takes its number.
        """
        if store.exists(self.spark, self._checkpoint()):
            raise RuntimeError("this folder is fed by a stream, which numbers its own batches")
        pipeline = self.pipeline()
        batch_id = pipeline.newest() + 1
        pipeline.process(posts, batch_id)
        outcomes = self.spark.read.parquet(f"{self.root}/outcomes/batch_id={batch_id}")
        return outcomes.select("event_id", "status", "reason", "remaining", "reset_at")

    def _checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def ingest_stream(self, posts: DataFrame, every: str | None = None) -> StreamingQuery:
        """Take a stream of posts. A folder is fed by batches or by a stream, not by both."""
        fed = store.exists(self.spark, f"{self.root}/landing")
        if fed and not store.exists(self.spark, self._checkpoint()):
            raise RuntimeError("this folder is fed by batches; a stream would overwrite them")
        return self.pipeline().start(posts, self._checkpoint(), every)

    def events(self) -> DataFrame:
        return self._present(self.pipeline().events())

    # Reports

    def tenant(self, user_id: str) -> Row:
        found = tenancy.of_owner(self.tenants(), user_id).first()
        if found is None:
            raise TenantNotSetUp("tenant not set up")
        return found

    def _scope(self, user_id: str, table: DataFrame) -> TenantScope:
        return TenantScope(table, self.tenant(user_id)["id"])

    def overview(self, user_id: str, range_key: str = "24h", as_of: datetime | None = None) -> DataFrame:
        return stats.overview(self._scope(user_id, self.events()), range_key, as_of)

    def timeseries(
        self, user_id: str, range_key: str = "7d", event: str | None = None, as_of: datetime | None = None
    ) -> DataFrame:
        series = stats.timeseries(self._scope(user_id, self.events()), range_key, event, as_of)
        return series.select(timing.to_iso(F.col("bucket")).alias("bucket"), "count")

    def realtime(self, user_id: str, as_of: datetime | None = None) -> DataFrame:
        return stats.realtime(self._scope(user_id, self.events()), as_of)

    def event_log(self, user_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
        return stats.event_log(self._scope(user_id, self.events()), limit, offset)

    def list_tenants(self) -> DataFrame:
        return tenancy.listing(self.tenants())

    def compact(self) -> int | None:
        """Rewrite the batches so far in large files; returns the last batch covered."""
        return self.pipeline().compact()

    def list_funnels(self, user_id: str) -> DataFrame:
        return tenancy.funnels_of(self._scope(user_id, self.funnel_rows()))

    def funnel_conversion(
        self, user_id: str, funnel_id: str, range_key: str | None = None, as_of: datetime | None = None
    ) -> DataFrame:
        """Conversion over all events, or over a range, whose days alone are read."""
        definition = self.list_funnels(user_id).where(F.col("id") == funnel_id).first()
        if definition is None:
            raise LookupError("no such funnel")
        scope = self._scope(user_id, self.events())
        events = scope.since(timing.range_start(range_key, as_of)) if range_key else scope.rows()
        return funnels.conversion(events, definition["steps"])

    def live_feed(self, user_id: str) -> DataFrame:
        return live.newest(self._scope(user_id, self.events()).rows())
