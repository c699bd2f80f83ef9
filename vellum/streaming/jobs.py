"""Structured Streaming jobs over a folder of arriving parquet files.

* ``quality_stream`` (ST1): quality rules on every micro-batch via
  ``foreachBatch``; results are appended keyed by (run, batch), so a
  replayed batch overwrites itself instead of counting twice;
* ``window_kpi_stream`` (ST2): a KPI per tumbling event-time window with a
  watermark (append mode: a window is emitted once the watermark passes it,
  so the newest window stays open until later events arrive);
* ``dedupe_stream`` (ST3): ``dropDuplicatesWithinWatermark`` on a key;
* ``outlier_stream`` (ST4): rows beyond |z| > 3 of a baseline computed once
  from the static table (two numbers, passed as literals).

All run with ``trigger(availableNow=True)`` and a checkpoint folder, so a
restarted job resumes where it stopped.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import quality
from vellum.sources.sinks import scratch_path


#: Files that each staged time range is written to, in parallel; a
#: micro-batch reads as many.
RANGE_FILES = 2


def stage_in_time_order(df: DataFrame, ts_col: str, path: str, ranges: int = 4, files: int = RANGE_FILES) -> None:
    """Write ``df`` as ``ranges`` consecutive time ranges, one after the other,
    each as ``files`` parquet files written in parallel, so a file source sees
    them arrive in time order. Rows without a time come with the first range."""
    bounds = df.select(F.percentile_approx(ts_col, [i / ranges for i in range(1, ranges)], 10000)).first()[0] or []
    place = F.lit(0)
    for edge in bounds:
        place = place + F.when(F.col(ts_col) >= F.lit(edge), 1).otherwise(0)
    for i in range(ranges):
        df.filter(place == i).repartition(files).write.mode("append").parquet(path)
        time.sleep(1.1)  # distinct modification times order the files


def _source(spark: SparkSession, path: str, schema, max_files: int = RANGE_FILES) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _run(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def quality_stream(spark: SparkSession, src: str, schema, rules, out: str, run_id: str) -> None:
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        res = quality.run_quality_checks(batch, rules, source=src)
        (res.withColumn("run_id", F.lit(run_id)).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id", "batch_id").parquet(out))

    _run(_source(spark, src, schema).writeStream.foreachBatch(per_batch), scratch_path(spark, "ckpt-st1"))


def event_time(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session time zone is UTC."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def window_kpi_stream(spark: SparkSession, src: str, schema, out: str, keys=("event_type",),
                      window: str = "1 day", lateness: str = "1 hour") -> None:
    s = event_time(_source(spark, src, schema)).withWatermark("ts", lateness)
    agg = (s.groupBy(F.window("ts", window).alias("w"), *keys)
           .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("events"))
           .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                   "total", "events"))
    _run(agg.writeStream.outputMode("append").format("parquet").option("path", out),
         scratch_path(spark, "ckpt-st2"))


def dedupe_stream(spark: SparkSession, src: str, schema, out: str, keys, lateness: str = "60 days") -> None:
    s = event_time(_source(spark, src, schema)).withWatermark("ts", lateness)
    d = s.dropDuplicatesWithinWatermark(list(keys))
    _run(d.writeStream.outputMode("append").format("parquet").option("path", out), scratch_path(spark, "ckpt-st3"))


def outlier_stream(spark: SparkSession, src: str, schema, baseline: DataFrame, column: str, out: str,
                   threshold: float = 3.0) -> None:
    mean, std = baseline.select(F.avg(column), F.stddev_samp(column)).first()
    s = _source(spark, src, schema)
    z = (F.col(column) - F.lit(mean)) / F.lit(std)
    flagged = s.withColumn("z", z).filter(F.abs(F.col("z")) > threshold)
    _run(flagged.writeStream.outputMode("append").format("parquet").option("path", out),
         scratch_path(spark, "ckpt-st4"))
