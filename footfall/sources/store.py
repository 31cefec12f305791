"""The event table as files.

A micro-batch writes its own folder, ``batches/batch_id=N/event_date=D``, and overwrites it when it
is replayed, so storing is idempotent. Compaction rewrites many small batches into
``compacted/upto=N/event_date=D``; readers take finished compactions and the batches after them.
Within a day, files are sorted by tenant and time and cut by range, so a large tenant gets several
files and min/max statistics skip the files of other tenants and times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from footfall import schemas

#: What a task of a compaction reads, about.
FILE_BYTES = 512 * 1024 * 1024
EVENT_DATE = T.StructField("event_date", T.DateType())
_STORED = T.StructType(schemas.EVENTS.fields + [EVENT_DATE])


def committed(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers N of the finished folders ``root/name=N``."""
    # Hadoop's file API, since the folder may be on any file system Spark reads.
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{root}/{name}=*/_SUCCESS")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in files or [])


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _bytes(spark: SparkSession, paths: list[str]) -> int:
    hadoop = [spark._jvm.org.apache.hadoop.fs.Path(path) for path in paths]
    files = hadoop[0].getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(files.getContentSummary(path).getLength() for path in hadoop)


def in_store_order(events: DataFrame, stored_bytes: int = 0) -> DataFrame:
    """Cut and sorted by day, tenant and time; ``stored_bytes`` asks for more cuts than the session's."""
    dated = events.withColumn("event_date", F.to_date("time"))
    order = ["event_date", "tenant_id", "time", "event_id"]
    cuts = -(-stored_bytes // FILE_BYTES)
    # Without a number the session's count holds, which adaptive execution can lower but not raise.
    more = [cuts] if cuts > int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return dated.repartitionByRange(*more, *order).sortWithinPartitions(*order)


def write_batch(events: DataFrame, root: str, batch_id: int) -> None:
    """Store one batch whole or not at all; storing it again replaces it."""
    path = f"{root}/batches/batch_id={batch_id}"
    in_store_order(events).write.mode("overwrite").partitionBy("event_date").parquet(path)


def read_batch(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    return spark.read.schema(_STORED).parquet(f"{root}/batches/batch_id={batch_id}")


def append(events: DataFrame, root: str) -> int:
    """Store ``events`` as the next batch; for a single writer. Returns the batch number."""
    spark = events.sparkSession
    done = committed(spark, f"{root}/batches", "batch_id") + committed(spark, f"{root}/compacted", "upto")
    batch_id = max(done, default=-1) + 1
    write_batch(events, root, batch_id)
    return batch_id


def _read(spark: SparkSession, root: str, name: str, numbers: list[int]) -> DataFrame:
    """The folders ``root/name=N`` as one scan."""
    if not numbers:
        return spark.createDataFrame([], _STORED)
    paths = [f"{root}/{name}={n}" for n in numbers]
    return spark.read.schema(_STORED).option("basePath", root).parquet(*paths).drop(name)


def _open_batches(spark: SparkSession, root: str, newest: int | None) -> tuple[list[int], list[int]]:
    """Compactions, and the batches that no compaction covers."""
    upto = committed(spark, f"{root}/compacted", "upto")
    last = upto[-1] if upto else -1
    batches = committed(spark, f"{root}/batches", "batch_id")
    return upto, [n for n in batches if n > last and (newest is None or n <= newest)]


def read_events(spark: SparkSession, root: str, newest: int | None = None) -> DataFrame:
    """All stored events with ``event_date``, the column to prune days by; with ``newest``, up to that batch."""
    upto, batches = _open_batches(spark, root, newest)
    recent = _read(spark, f"{root}/batches", "batch_id", batches)
    return _read(spark, f"{root}/compacted", "upto", upto).unionByName(recent) if upto else recent


def compact(spark: SparkSession, root: str, newest: int | None = None) -> int | None:
    """Rewrite the batches since the last compaction in large sorted files; with ``newest``, up to that batch.

    Old batch folders stay for retention to remove; readers no longer look at them.
    """
    _, batches = _open_batches(spark, root, newest)
    if not batches:
        return None
    small = _read(spark, f"{root}/batches", "batch_id", batches).drop("event_date")
    target = f"{root}/compacted/upto={batches[-1]}"
    size = _bytes(spark, [f"{root}/batches/batch_id={n}" for n in batches])
    in_store_order(small, size).write.mode("overwrite").partitionBy("event_date").parquet(target)
    return batches[-1]
