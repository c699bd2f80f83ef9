"""Schema inspection: one row per column of every table, read from
``df.schema`` on the driver (no job is run; the table is metadata)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.common import present

SCHEMA_INFO = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("source_no", T.IntegerType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("type", T.StringType()),
])


def schema_info(spark: SparkSession, tables: dict[str, DataFrame], max_columns: int | None = None,
                max_tables: int | None = None) -> DataFrame:
    """``source, source_no, ordinal, column_name, type`` (the reference caps
    listings at 10 tables and 25 columns; here the caps are optional)."""
    rows = []
    for s_no, (name, df) in enumerate(tables.items()):
        if max_tables is not None and s_no >= max_tables:
            break
        for i, f in enumerate(df.schema.fields):
            if max_columns is not None and i >= max_columns:
                break
            rows.append((name, s_no, i, f.name, f.dataType.simpleString()))
    return spark.createDataFrame(rows, SCHEMA_INFO)


def schema_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``source, column_name, rows, present`` from the data: rows of the table
    and values that are not missing, one aggregation per table."""
    out = None
    for name, df in tables.items():
        items = [F.struct(F.lit(f.name).alias("column_name"), F.count(F.lit(1)).alias("rows"),
                          F.count(present(df, f.name)).alias("present")) for f in df.schema.fields]
        part = df.agg(F.array(*items).alias("s")).select(F.lit(name).alias("source"), F.inline("s"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("Name at least one table.")
    return out


def json_schema(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Field names and types of a JSON document collection, inferred from
    every document (not one sample), plus the document count."""
    df = spark.read.json(path, multiLine=multi_line)
    fields = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    info = spark.createDataFrame(fields, "field STRING, type STRING")
    return info.withColumn("documents", df.select(F.count(F.lit(1))).scalar())
