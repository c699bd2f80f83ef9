"""Anomaly findings: z-score outliers per numeric column (AN1), a trend
change of the rolling mean (AN2), snapshot drift between two tables (AN3)
and the union of findings (AN4).

AN1 is two aggregations over all numeric columns (statistics, then the
outlier counts against them as scalar subqueries), instead of one pass
per column. AN2 uses the distributed row order of ``operators.ordered``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.numeric import is_datetime_type, nan_to_null
from vellum.operators import ordered
from vellum.operators.common import col, present
from vellum.operators.profile import numeric_columns
from vellum import texts

ANOMALY_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("column_name", T.StringType()),
    T.StructField("details", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("outlier_count", T.LongType()), T.StructField("mean", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
])

Z_THRESHOLD = 3.0


def _fmt2(c):
    """'%.2f' rounded half-to-even on the binary value (Python's format)."""
    return F.regexp_replace(F.format_number(c, 2), ",", "")


def _num(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    x = col(c).cast("double")
    return nan_to_null(x) if isinstance(dt, (T.FloatType, T.DoubleType)) else x


def zscore_stats(df: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    """Per numeric column: n, mean, std, max (as text of the original type) and outlier count."""
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name STRING, n LONG, mean DOUBLE, std DOUBLE, "
                                                   "max DOUBLE, max_text STRING, outlier_count LONG")
    structs = []
    for c in cols:
        x = _num(df, c)
        mean = df.select(F.avg(x)).scalar()
        std = df.select(F.stddev_samp(x)).scalar()
        z = F.abs((x - mean) / std)
        structs.append(F.struct(
            F.lit(c).alias("column_name"), F.count(x).alias("n"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.max(x).alias("max"),
            F.max(nan_to_null(col(c)) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
                  else col(c)).cast("string").alias("max_text"),
            F.count_if(F.coalesce(z > threshold, F.lit(False))).alias("outlier_count")))
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s"))


def zscore_anomalies(df: DataFrame, threshold: float = Z_THRESHOLD, min_count: int = 10) -> DataFrame:
    """One finding per numeric column with at least ``min_count`` values, a positive
    standard deviation and rows beyond |z| > ``threshold``."""
    s = zscore_stats(df, threshold)
    found = s.filter((F.col("n") >= min_count) & (F.col("std") > 0) & (F.col("outlier_count") > 0))
    details = F.format_string(texts.OUTLIER_DETAILS,
                              F.col("outlier_count"), F.col("column_name"), F.lit(str(threshold)),
                              F.col("max_text"), _fmt2(F.col("mean")))
    return found.select(F.lit(texts.OUTLIER_TYPE).alias("type"), "column_name", details.alias("details"),
                        F.lit(texts.SEVERITY_MEDIUM).alias("severity"), F.col("outlier_count").cast("long"),
                        "mean", "max")


def outliers(df: DataFrame, column: str, threshold: float = Z_THRESHOLD) -> DataFrame:
    """The rows whose |z| exceeds the threshold in ``column``, with their z."""
    x = _num(df, column)
    mean = df.select(F.avg(x)).scalar()
    std = df.select(F.stddev_samp(x)).scalar()
    z = (x - mean) / std
    return df.withColumn("z", z).filter(F.abs(F.col("z")) > threshold)


def trend_change(df: DataFrame, time_column: str, target: str | None = None, tie_breaker: list | None = None,
                 window: int = 5, factor: float = 2.5, bucket_rows: int = ordered.BUCKET_ROWS) -> DataFrame:
    """Rolling ``window``-row mean of the first numeric column in time order;
    a finding when the last change exceeds ``factor`` standard deviations of
    all changes (more than 10 rows needed). Rows without a time come last;
    rows of one time are ordered by ``tie_breaker``, then by the target."""
    if time_column not in df.columns or not is_datetime_type(df.schema[time_column].dataType):
        return df.sparkSession.createDataFrame([], ANOMALY_SCHEMA)
    nums = numeric_columns(df)
    target = target or (nums[0] if nums else None)
    if target is None:
        return df.sparkSession.createDataFrame([], ANOMALY_SCHEMA)
    names = list(dict.fromkeys([time_column, *(tie_breaker or []), target]))  # equal times: by the target itself
    base = df.select(*[col(c) for c in names])
    order = [col(c).asc_nulls_last() for c in names]
    r = ordered.rolling(base, target, order, window, out="rm", bucket_rows=bucket_rows)
    stats = r.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("rm_diff").alias("std"),
                  F.max_by("rm_diff", "idx").alias("last"))
    hit = stats.filter((F.col("n") > 10) & (F.col("std") > 0) & (F.abs(F.col("last")) > factor * F.col("std")))
    direction = F.when(F.col("last") > 0, "increase").otherwise("decrease")
    details = F.format_string(texts.TREND_DETAILS,
                              direction, F.lit(target), _fmt2(F.col("last")), _fmt2(F.col("std")))
    return hit.select(F.lit(texts.TREND_TYPE).alias("type"), F.lit(target).alias("column_name"),
                      details.alias("details"), F.lit(texts.SEVERITY_MEDIUM).alias("severity"),
                      F.lit(None).cast("long").alias("outlier_count"), F.lit(None).cast("double").alias("mean"),
                      F.lit(None).cast("double").alias("max"))


def find_anomalies(df: DataFrame, time_column: str | None = None, tie_breaker: list | None = None) -> DataFrame:
    """Z-score findings for every numeric column, plus the trend check when a time
    column is given (the reference's findings list, as rows)."""
    out = zscore_anomalies(df)
    if time_column:
        out = out.unionByName(trend_change(df, time_column, tie_breaker=tie_breaker))
    return out


def snapshot_drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Per column present in both: row count, mean (numeric) and null share, then and now."""
    common = [c for c in current.columns if c in previous.columns]
    nums = set(numeric_columns(current)) & set(numeric_columns(previous))

    def stats(df):
        items = []
        for c in common:
            mean = F.avg(_num(df, c)) if c in nums else F.lit(None).cast("double")
            items.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"), mean.alias("mean"),
                                  (F.count_if(present(df, c).isNull()) / F.count(F.lit(1))).alias("null_share")))
        return df.agg(F.array(*items).alias("s")).select(F.inline("s"))

    a, b = stats(current).alias("a"), stats(previous).alias("b")
    j = a.join(b, "column_name")
    return j.select("column_name", F.col("b.rows").alias("rows_before"), F.col("a.rows").alias("rows_now"),
                    F.col("b.mean").alias("mean_before"), F.col("a.mean").alias("mean_now"),
                    (F.col("a.mean") - F.col("b.mean")).alias("mean_change"),
                    F.col("b.null_share").alias("null_share_before"), F.col("a.null_share").alias("null_share_now"))
