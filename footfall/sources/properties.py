"""Event properties as shredded variants.

A property that occurs in most objects becomes a column of its own in the files, with its type, so a report on one
property reads that column and neither the other properties nor any text. Spark infers what to shred for each file when it is written;
what does not fit the inferred shape stays readable as a variant.

A value is shown as text: numbers in their shortest form, objects and arrays as JSON. Properties that are not JSON are kept as a null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from footfall import schemas
from footfall.sources import store

PROPERTIES = T.StructType(
    [schemas.EVENTS[name] for name in ("event_id", "time", "tenant_id", "event_name")]
    + [T.StructField("properties", T.VariantType()), store.EVENT_DATE]
)


def write_properties(events: DataFrame, root: str, batch_id: int) -> None:
    """The properties of one batch of events, whole or not at all; storing them again replaces them."""
    facts = events.select("event_id", "time", "tenant_id", "event_name", F.try_parse_json("properties").alias("properties"))
    path = f"{root}/properties/batch_id={batch_id}"
    store.in_store_order(facts).write.mode("overwrite").partitionBy("event_date").parquet(path)


def read_properties(spark: SparkSession, root: str) -> DataFrame:
    """All stored properties with ``event_date``, the column to prune days by."""
    done = store.committed(spark, f"{root}/properties", "batch_id")
    if not done:
        return spark.createDataFrame([], PROPERTIES)
    paths = [f"{root}/properties/batch_id={n}" for n in done]
    return spark.read.schema(PROPERTIES).option("basePath", f"{root}/properties").parquet(*paths).drop("batch_id")
