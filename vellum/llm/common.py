"""Keys, staging and SQL fragments shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.ordered import with_global_index
from vellum.session import checkpoint_dir, ship_package

#: Rows of an Arrow batch handed to Python. Texts vary from one word to
#: megabytes, so the batch is kept small and also bounded in bytes.
BATCH_ROWS = 2048

WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Settings that the Python stages of this subpackage rely on."""
    ship_package(spark)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_uid long, _text string, _row struct)``: one row per input row.

    ``_uid`` is unique and orders rows as ``id_col`` does. Integer ids that
    are unique and not null serve as they are (one grouped count checks it);
    otherwise rows are numbered in the order of (id, nulls first; hash of
    the text; hash of the row), so rows sharing an id are separate documents
    in a stable order. ``_row`` holds every input column, so extra columns
    can have any name.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    ident = F.col(f"`{id_col}`")
    integral = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    out = docs.select(ident.alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), row)
    if integral:
        repeated = docs.groupBy(ident.alias("_id")).count().filter("_id IS NULL OR count > 1")
        if repeated.isEmpty():
            return out.select(F.col("_id").cast("long").alias("_uid", metadata={"is_id": True}), "_text", "_row")
    tie = [F.sha2(F.coalesce(F.col("_text"), F.lit("")), 256), F.col("_text").isNull(),
           F.xxhash64(F.to_json("_row"))]
    ranked = with_global_index(out.select("*", *[t.alias(f"_t{i}") for i, t in enumerate(tie)]),
                               ["_id", "_t0", "_t1", "_t2"], idx="_uid")
    return ranked.select("_uid", "_text", "_row")


def is_id(rows: DataFrame) -> bool:
    """Whether ``_uid`` of keyed rows is the id itself."""
    return bool(rows.schema["_uid"].metadata.get("is_id"))


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for those staged with
    ``outlives=True``, which belong to the scope around. What leaves the
    scope must not read the others any more."""
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hadoop).delete(p, True)


def staged(df: DataFrame, codec: str = "zstd", outlives: bool = False) -> DataFrame:
    """``df`` written once to the session's shared checkpoint folder and read
    back: later uses neither recompute it nor depend on a live executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if outlives else _scopes
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_sql(column) -> F.Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
