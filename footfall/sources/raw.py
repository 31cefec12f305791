"""Raw posts, as files or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from footfall import schemas
from footfall.functions import timing


def read_raw(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Envelopes (``schemas.RAW``) that the collector wrote, as JSON lines or Parquet."""
    return spark.read.schema(schemas.RAW).format(fmt).load(path)


def stream_raw(
    spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schemas.RAW).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records whose value is the post body; partition and offset make the id."""
    # The first of several headers of a name counts.
    header = lambda name: F.get(
        F.filter("headers", lambda h: h["key"] == name), 0
    )["value"].cast("string")
    return records.select(
        (F.col("partition").cast("long") * F.lit(1 << 44) + F.col("offset")).alias("event_id"),
        F.col("timestamp").cast("timestamp_ntz").alias("arrived_at"),
        F.col("value").cast("string").alias("body"),
        header("user-agent").alias("header_user_agent"),
        header("x-forwarded-for").alias("forwarded_for"),
        header("remote-ip").alias("remote_ip"),
    )


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Plain post bodies, one per line, without request data.

    The id is a hash of file and body, so a body repeated within a file gets the same id twice.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.xxhash64(F.col("_metadata.file_path"), "value").alias("event_id"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("arrived_at"),
        F.col("value").alias("body"),
        *[F.lit(None).cast("string").alias(c) for c in ("header_user_agent", "forwarded_for", "remote_ip")],
    )


TRAFFIC = [
    ("pageview", {"section": "catalogue"}),
    ("click", {"tag": "a", "text": "Order now"}),
    ("signup", {"channel": "newsletter"}),
]


def synthetic_traffic(tokens: DataFrame, url: str, referrer: str, at: Column) -> DataFrame:
    """Three posts per token (page view, click, signup) that share a session; ``at`` may be made of columns of ``tokens``."""
    as_map = T.MapType(T.StringType(), T.StringType())
    posts = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.create_map(*[F.lit(x) for pair in properties.items() for x in pair])
                .cast(as_map)
                .alias("properties"),
                F.lit(place).alias("place"),
            )
            for place, (name, properties) in enumerate(TRAFFIC)
        ]
    )
    session = F.regexp_replace(
        F.md5(F.concat(F.lit("session"), "token")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )
    exploded = tokens.select("token", session.alias("session"), at.alias("arrived_at"), F.inline(posts))
    at = F.col("arrived_at")
    return exploded.select(
        F.xxhash64("token", "place").alias("event_id"),
        at,
        F.to_json(
            F.struct(
                "token",
                F.col("name").alias("eventName"),
                "properties",
                F.col("session").alias("sessionId"),
                F.lit(url).alias("url"),
                F.lit(referrer).alias("referrer"),
                timing.to_iso(at).alias("occurredAt"),
            )
        ).alias("body"),
        *[F.lit(None).cast("string").alias(c) for c in ("header_user_agent", "forwarded_for", "remote_ip")],
    )
