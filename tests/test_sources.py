"""Properties as variants, and made-up traffic as a data source."""

import json

from footfall.operators import stats, validation
from footfall.operators.scope import TenantScope
from footfall.session import new_path
from footfall.sources import properties
from footfall.sources.fixtures import HOT_TENANT
from footfall.sources.traffic import TrafficSource
from pyspark.sql import functions as F


def test_a_report_on_a_property_reads_its_column_alone(spark, fixtures):
    root = new_path(spark, "site")
    properties.write_properties(fixtures.plain_events(), root, 0)
    stored = properties.read_properties(spark, root)
    report = stats.property_breakdown(TenantScope(stored, HOT_TENANT), "k")
    plan = report._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "properties:struct<0:string>" in read and "event_id" not in read
    assert sorted(map(tuple, report.collect())) == sorted(
        map(tuple, stats.property_breakdown(TenantScope(fixtures.plain_events(), HOT_TENANT), "k").collect())
    )


def test_properties_of_all_shapes(spark):
    texts = ['{"a":1}', '{"a":"x","b":{"c":[1,2]}}', '{"a":true}', '{"b":null}', "[1]", "no json", None, '{"a b":"y"}', '{"a":{"z":1}}']
    events = spark.createDataFrame([(k, "t", text) for k, text in enumerate(texts)], "event_id long, tenant_id string, properties string")
    events = events.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS time", "concat('e', event_id) AS event_name")
    root = new_path(spark, "shapes")
    for _ in range(2):  # a batch that is stored again
        properties.write_properties(events, root, 3)
    scope = TenantScope(properties.read_properties(spark, root), "t")
    found = {r.event_name: r.value for r in stats.property_breakdown(scope, "a").collect()}
    assert found == {"e0": "1", "e1": "x", "e2": "true", "e8": '{"z":1}'} | dict.fromkeys(("e3", "e4", "e5", "e6", "e7"))
    assert {r.event_name: r.value for r in stats.property_breakdown(scope, "a b").collect()}["e7"] == "y"
    assert properties.read_properties(spark, new_path(spark, "nothing")).count() == 0


def test_traffic_in_batches_and_as_a_stream(spark, tmp_path):
    spark.dataSource.register(TrafficSource)
    tokens = ["10000000-0000-4000-8000-000000000001", "10000000-0000-4000-8000-000000000002"]
    options = {"tokens": json.dumps(tokens), "url": "https://example.com/try"}
    batch = spark.read.format("traffic").options(**options, sessions="1500").load()
    assert batch.count() == 2 * 1500 * 3 and batch.rdd.getNumPartitions() == 3
    parsed = validation.parse_bodies(batch)
    kinds = parsed.groupBy("token", "session_id").agg(F.count_distinct("event_name").alias("n"))
    assert kinds.where("n = 3").count() == 3000 and {r.token for r in parsed.select("token").distinct().collect()} == set(tokens)
    assert parsed.where("readable AND url = 'https://example.com/try'").count() == 9000
    stream = spark.readStream.format("traffic").options(**options, per_batch="7", most="20").load()
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
    for _ in range(60):
        query.processAllAvailable()
        if spark.read.parquet(f"{tmp_path}/out").count() >= 60:
            break
    query.stop()
    streamed = spark.read.parquet(f"{tmp_path}/out")
    same = batch.where(F.col("event_id") < 60).select(streamed.columns)
    assert streamed.count() == 60 and streamed.exceptAll(same).count() == 0
