"""Streaming re-aims (ST1-ST4): each stream reads the events table staged as
several files in time order, and is compared with the batch answer."""

from pyspark.sql import functions as F

from vellum.sources.sinks import scratch_path
from vellum.streaming import jobs
from vellum.suite import query


def _staged(spark):
    events = spark.table("events")
    src = scratch_path(spark, "events-stream")
    jobs.stage_in_time_order(events, "ts", src, files=4)
    return src, events.schema


STREAM_RULES = [
    {"rule_name": "value_present", "rule_type": "not_null", "column_name": "value"},
    {"rule_name": "value_max", "rule_type": "max_value", "column_name": "value", "rule_parameters": {"max": 30}},
    {"rule_name": "type_enum", "rule_type": "enum_values", "column_name": "event_type",
     "rule_parameters": {"allowed": ["click", "view"]}},
]


@query("st1_quality_stream", sql="""
SELECT 'value_present' AS rule_name, CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS violations FROM events
UNION ALL SELECT 'value_max', CAST(count(*) FILTER (WHERE value > 30) AS BIGINT) FROM events
UNION ALL SELECT 'type_enum', CAST(count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS BIGINT) FROM events""")
def st1(spark, sf):
    src, schema = _staged(spark)
    out = scratch_path(spark, "st1-out")
    jobs.quality_stream(spark, src, schema, STREAM_RULES, out, "run-1")
    res = spark.read.parquet(out)
    batches = res.select("batch_id").distinct().count()
    if batches < 2:
        raise AssertionError(f"expected several micro-batches, got {batches}")
    return res.groupBy("rule_name").agg(F.sum("violation_count").cast("long").alias("violations"))


@query("st2_window_kpi_stream", rounds={"total": 2}, sql="""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP)
       AS window_end, event_type, sum(value) AS total, count(*) AS events
FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY ALL""")
def st2(spark, sf):
    src, schema = _staged(spark)
    out = scratch_path(spark, "st2-out")
    jobs.window_kpi_stream(spark, src, schema, out)
    return (spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
            .withColumn("window_end", F.col("window_end").cast("timestamp_ntz")))


@query("st3_dedupe_stream", sql="SELECT DISTINCT user_id, event_type FROM events")
def st3(spark, sf):
    src, schema = _staged(spark)
    out = scratch_path(spark, "st3-out")
    jobs.dedupe_stream(spark, src, schema, out, ["user_id", "event_type"])
    return spark.read.parquet(out).select("user_id", "event_type")


@query("st4_outlier_stream", rounds={"z": 9}, sql="""
SELECT event_id, value, (value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) AS z FROM events
WHERE abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events)) > 3""")
def st4(spark, sf):
    src, schema = _staged(spark)
    out = scratch_path(spark, "st4-out")
    jobs.outlier_stream(spark, src, schema, spark.table("events"), "value", out)
    return spark.read.parquet(out).select("event_id", "value", "z")
