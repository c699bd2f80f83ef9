"""Append-only tables: violation log, KPI history, lineage, catalog.

Every append is keyed by a ``run_id`` partition and written with dynamic
partition overwrite, so re-running (or replaying) the same run replaces
its rows instead of adding them twice.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.common import present
from vellum.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    base = checkpoint_dir(spark)
    if not base:
        raise ValueError("Set spark.checkpoint.dir to a shared folder: scratch output is written there.")
    return f"{base.rstrip('/')}/vellum-{name}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str, run_id: str) -> None:
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def violation_rows(results: DataFrame, rule_ids: dict | None = None, ts=None) -> DataFrame:
    """Failed and errored results with rule id and check time."""
    ts = ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    ids = F.create_map(*[x for k, v in (rule_ids or {}).items() for x in (F.lit(k), F.lit(v))]) \
        if rule_ids else None
    rid = ids[F.col("rule_name")].cast("long") if ids is not None else F.lit(None).cast("long")
    return (results.filter(F.col("status").isin("failed", "error"))
            .withColumn("rule_id", rid).withColumn("check_timestamp", F.lit(ts).cast("timestamp")))


def append_violations(results: DataFrame, path: str, run_id: str, rule_ids: dict | None = None, ts=None) -> None:
    append(violation_rows(results, rule_ids, ts), path, run_id)


def append_kpi_values(values: DataFrame, path: str, run_id: str, run_ts=None) -> None:
    run_ts = run_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    append(values.select("name", F.lit(run_ts).cast("timestamp").alias("run_ts"), "value")
           .filter(F.col("value").isNotNull()), path, run_id)


def catalog_rows(tables: dict[str, DataFrame], exact: bool = True, profiled_at=None) -> DataFrame:
    """One row per column of every table: type, null share, distinct count,
    profiled time. One aggregation per table, all tables in one union."""
    profiled_at = profiled_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    parts = []
    for name, df in tables.items():
        distinct = F.count_distinct if exact else (lambda c: F.approx_count_distinct(c, 0.01))
        # distinct counts in their own aggregation (one struct-valued scalar subquery)
        dist = df.select(F.struct(*[distinct(present(df, f.name)).cast("long").alias(f"u{i}")
                                    for i, f in enumerate(df.schema.fields)]).alias("d")).scalar()
        items = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"),
                          (F.count_if(present(df, f.name).isNull()) / F.count(F.lit(1))).alias("null_share"),
                          dist[f"u{i}"].alias("distinct_count"))
                 for i, f in enumerate(df.schema.fields)]
        parts.append(df.agg(F.array(*items).alias("s")).select(F.lit(name).alias("name"), F.inline("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("profiled_at", F.lit(profiled_at).cast("timestamp"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def catalog_entries(tables: dict[str, DataFrame], source_type: str = "file", tags: dict | None = None,
                    descriptions: dict | None = None, profiled_at=None) -> DataFrame:
    """One catalog row per table: ``name, source_type, description, tags,
    schema_cache MAP<column, type>, last_profiled_at, rows``. Schemas come from
    metadata; the row count is one aggregation per table, unioned into one job."""
    profiled_at = profiled_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    parts = []
    for name, df in tables.items():
        schema = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
        tag_list = F.array(*[F.lit(t) for t in (tags or {}).get(name, [])]).cast("array<string>")
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), F.lit(source_type).alias("source_type"),
            F.lit((descriptions or {}).get(name)).cast("string").alias("description"), tag_list.alias("tags"),
            schema.alias("schema_cache"), F.lit(profiled_at).cast("timestamp").alias("last_profiled_at"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
