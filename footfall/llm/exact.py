"""Exact deduplication: stateful streaming over digests, full bytes compared on hits.

Rows land as ``(digest, id, locator)``. A streaming aggregation keeps, per digest and without
expiry, the smallest identifier, the locator of its content (file and row) and the group size in
RocksDB state. Further landings go on from the same state. Every row whose digest was seen before
is a hit; its whole text is compared with the text at the locator, so a digest collision makes
groups of its own instead of losing a text.

Defined cases: a null text counts as empty; of rows with equal text the smallest id stays, null ids
last, then the smallest locator, so exactly one of repeated rows stays; an empty table gives no
rows; other columns of the input are neither read nor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.llm.rows import addressed, without
from footfall.operators.lookup import is_small
from footfall.session import new_path, stage

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Files of stores with few keys stay small, so many state partitions cost little disk.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LANDED = "digest string, missing boolean, id long, file string, row long"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(""))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier, normalised text and locator of every row."""
    docs = addressed(docs)
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        normalised(F.col(text_col)).alias("content"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def land(rows: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Append one row per document to the landing folder; texts stay where they are."""
    rows.select(
        digest(F.col("content")).alias("digest"), F.col("id").isNull().alias("missing"), "id", "file", "row"
    ).write.mode("append").parquet(f"{folder}/landed")


def observe(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> None:
    """Feed what has landed since the last call to the keyed state."""

    def keep(changes: DataFrame, batch: int) -> None:
        changes.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/changes/at={batch}")

    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(LANDED)
        if files_per_batch:
            stream = stream.option("maxFilesPerTrigger", files_per_batch)
        state = (
            stream.parquet(f"{folder}/landed")
            .groupBy("digest")
            .agg(F.min(F.struct("missing", "id", "file", "row")).alias("keep"), F.count("*").alias("size"))
        )
        (
            state.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def seen(spark: SparkSession, folder: str) -> DataFrame:
    """The state as it stands: one row per digest."""
    schema = "digest string, keep struct<missing: boolean, id: long, file: string, row: long>, size long, batch long"
    changes = spark.read.schema(schema).parquet(f"{folder}/changes")
    newest = F.max_by(F.struct("keep", "size"), "batch").alias("s")
    return changes.groupBy("digest").agg(newest).select("digest", "s.keep", "s.size")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """``id, file, row, digest, keep_id, group_size, kept`` for every row of ``docs``."""
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "exact")
    rows = located(docs, id_col, text_col)
    land(rows, folder, digest)
    observe(spark, folder, files_per_batch)
    landed = spark.read.schema(LANDED).parquet(f"{folder}/landed")
    state = stage(seen(spark, folder), "exact-seen")

    # The whole texts of hits and of what they hit; the other texts do not move.
    repeated = state.filter("size > 1").select("digest", "keep")
    repeated = F.broadcast(repeated) if is_small(repeated) else repeated
    here = F.struct(F.col("id").isNull().alias("missing"), "id", "file", "row")
    hits = stage(
        rows.withColumn("digest", digest(F.col("content")))
        .join(repeated, "digest")
        .select("digest", here.alias("at"), "keep", "content"),
        "exact-hits",
    )
    first = hits.filter("at = keep").select("digest", F.col("content").alias("kept_content"))
    compared = hits.join(first, "digest").select(
        "digest", "at", F.when(F.col("content") != F.col("kept_content"), F.col("content")).alias("other")
    )
    compared = stage(compared, "exact-compared")
    groups = compared.groupBy("digest", "other").agg(F.min("at").alias("keep"), F.count("*").alias("size"))
    same = (F.col("c.digest") == F.col("g.digest")) & F.col("c.other").eqNullSafe(F.col("g.other"))
    verified = compared.alias("c").join(groups.alias("g"), same).select("c.digest", "at", "keep", "size")

    alone = landed.join(state.filter("size = 1"), "digest").select("digest", here.alias("at"), "keep", "size")
    return alone.unionByName(verified).select(
        "at.id", "at.file", "at.row", "digest", F.col("keep.id").alias("keep_id"),
        F.col("size").alias("group_size"), (F.col("at") == F.col("keep")).alias("kept"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = addressed(docs)
    dropped = exact_duplicates(docs, id_col, text_col).filter("NOT kept").select(F.xxhash64("file", "row").alias("row"))
    return without(docs, stage(dropped, "exact-dropped"))
