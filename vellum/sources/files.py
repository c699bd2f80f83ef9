"""File and object-store readers.

The file extension (lower-cased) picks the reader; an unknown extension
raises ValueError and a missing path FileNotFoundError (checked through
the Hadoop file system, so it works for local, HDFS, s3a:// and gs://).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READERS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc"}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.globStatus(p) is not None and len(fs.globStatus(p)) > 0


def _format(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".xlsx", ".xls"):
        raise ValueError(f"Unsupported file type: {ext} (convert spreadsheets to CSV or parquet first)")
    if ext not in READERS:
        raise ValueError(f"Unsupported file type: {ext or '(none)'}")
    return READERS[ext]


def _starts_with_array(spark: SparkSession, path: str) -> bool:
    """A JSON file holding one array of records needs multiLine parsing."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0][0].lstrip().startswith("[")


# Texts that mean "missing" in a CSV cell (fixed values).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
               "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _has_line_breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes: a quoted value goes on
    in the next line, so lines are not records (one task reads such a file)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _without_null_tokens(df: DataFrame) -> DataFrame:
    """Null tokens become null; a text column of nothing else but numbers
    becomes numeric (one aggregation over the text columns)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    value = {c: F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")) for c in texts}
    checks = [e for i, c in enumerate(texts) for e in (
        F.count(value[c]).alias(f"n{i}"), F.count(value[c].try_cast("bigint")).alias(f"i{i}"),
        F.count(F.when(value[c].rlike(r"^[-+0-9.eE]+$"), value[c].try_cast("double"))).alias(f"d{i}"))]
    row = df.agg(*checks).first()
    for i, c in enumerate(texts):
        if row[f"n{i}"] and row[f"i{i}"] == row[f"n{i}"]:
            value[c] = value[c].cast("bigint")
        elif row[f"n{i}"] and row[f"d{i}"] == row[f"n{i}"]:
            value[c] = value[c].cast("double")
    return df.select(*[value[c].alias(c) if c in value else F.col(f"`{c}`") for c in df.columns])


def read_file(spark: SparkSession, path: str, fmt: str | None = None, schema=None,
              multi_line: bool | None = None, **options) -> DataFrame:
    """CSV (header, inferred types, the usual null texts -> null, doubled quotes,
    line breaks inside quotes), JSON (array of
    records or JSON lines), parquet, ORC."""
    kind = _format(path, fmt)
    if not _exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        if multi_line is None:
            multi_line = _has_line_breaks_in_quotes(spark, path)
        opts = {"header": "true", "inferSchema": "true" if schema is None else "false", "quote": '"', "escape": '"',
                "multiLine": str(bool(multi_line)).lower()}
        opts.update(options)
        df = reader.options(**opts).csv(path)
        return df if schema is not None else _without_null_tokens(df)
    if kind == "json":
        if multi_line is None:
            multi_line = _starts_with_array(spark, path)
        return reader.options(multiLine=str(bool(multi_line)).lower(), **options).json(path)
    return reader.options(**options).format(kind).load(path)


def object_path(scheme: str, bucket: str, key: str) -> str:
    """``s3`` -> ``s3a://bucket/key``, ``gcs`` -> ``gs://bucket/key``."""
    prefix = {"s3": "s3a", "s3a": "s3a", "gcs": "gs", "gs": "gs"}.get(scheme.lower())
    if prefix is None:
        raise ValueError(f"Unsupported object store: {scheme}")
    if not bucket or not key:
        raise ValueError("Bucket and key are required.")
    return f"{prefix}://{bucket}/{key.lstrip('/')}"


def read_object(spark: SparkSession, scheme: str, bucket: str, key: str, **kw) -> DataFrame:
    """Object-store scan (credentials come from the cluster's Hadoop config)."""
    return read_file(spark, object_path(scheme, bucket, key), **kw)


def with_source(df: DataFrame, name: str = "source_uri") -> DataFrame:
    """Provenance: the file each row came from (file-based sources only)."""
    return df.withColumn(name, F.col("_metadata.file_path"))
