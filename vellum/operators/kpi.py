"""KPIs: calculation, tracking against history, thresholds, targets and
value formatting.

All non-SQL KPIs of one table are computed in one aggregation; a KPI whose
logic does not resolve (unknown column, non-aggregate expression) gets a
null value instead of aborting the run. SQL KPIs are scalar subqueries.
"""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.common import col, present
from vellum.operators.quantiles import exact_quantiles
from vellum import texts

log = logging.getLogger(__name__)

_SIMPLE = re.compile(r"^\s*(count_unique|sum|mean|median)\s*'([^']+)'")


def median_column(logic: str) -> str | None:
    """The column of a ``median 'c'`` KPI, else None."""
    m = _SIMPLE.match((logic or "").strip())
    return m.group(2) if m and m.group(1).lower() == "median" else None


def _missing_nan(df: DataFrame | None, name: str) -> Column:
    return present(df, name) if df is not None and name in df.columns else col(name)


def kpi_expression(logic: str, df: DataFrame | None = None) -> Column:
    """Aggregate Column for a KPI's logic: ``count``, ``count_unique 'c'``,
    ``sum 'c'``, ``mean 'c'``, ``median 'c'`` (approximate here; the exact
    median is computed by ``calculate_kpis``), else a SQL aggregate expression."""
    text = (logic or "").strip()
    if not text:
        raise ValueError("The KPI has no calculation_logic.")
    if text.lower() == "count":
        return F.count(F.lit(1)).cast("double")
    m = _SIMPLE.match(text)
    if m:
        fn, c = m.group(1).lower(), m.group(2)
        x = _missing_nan(df, c)
        if fn == "count_unique":
            return F.count_distinct(x).cast("double")
        if fn == "sum":
            return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))
        if fn == "mean":
            return F.avg(x.cast("double"))
        return F.percentile_approx(x.cast("double"), 0.5, 100000).cast("double")
    return F.expr(text).cast("double")


def calculate_kpis(df: DataFrame, kpis: list[dict], exact: bool = True) -> DataFrame:
    """``name, value`` for every KPI definition (dicts with ``name``,
    ``calculation_logic`` and optional ``calculation_type`` = 'sql')."""
    spark = df.sparkSession
    exprs, names, medians = [], [], []
    for k in kpis:
        name = k.get("name", "Unknown KPI")
        logic = k.get("calculation_logic", "")
        ctype = k.get("calculation_type", "expression")
        try:
            if ctype == "sql":
                e = sql_kpi(spark, logic)
            elif median_column(logic) and exact:
                c = median_column(logic)
                df.select(col(c)).schema  # an unknown column is a null KPI, not an abort
                medians.append((len(exprs), c))
                e = F.lit(None).cast("double")
            else:
                e = kpi_expression(logic, df)
                df.agg(e).schema  # resolve now: bad logic becomes a null value
        except Exception as err:  # noqa: BLE001 - any failure is a null KPI, as in the reference
            log.warning("KPI '%s' stays empty: %s", name, str(err).splitlines()[0])
            e = F.lit(None).cast("double")
        names.append(name)
        exprs.append(e.alias(f"k{len(exprs)}"))
    if not exprs:
        return spark.createDataFrame([], "name STRING, value DOUBLE")
    if medians:  # the exact medians of all KPIs by one distributed selection
        solved = exact_quantiles(df, list(dict.fromkeys(c for _, c in medians)), [0.5])
        for i, c in medians:
            exprs[i] = F.lit(solved[c][0]).cast("double").alias(f"k{i}")
    wide = df.agg(*exprs)
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"k{i}").cast("double").alias("value"))
                      for i, n in enumerate(names)])
    return wide.select(F.inline(pairs))


def sql_kpi(spark: SparkSession, logic: str) -> Column:
    """First cell of the SQL result as a double (null when empty)."""
    if not logic or not logic.strip():
        raise ValueError("The KPI has no calculation_logic.")
    res = spark.sql(logic)
    first = res.columns[0]
    return res.select(F.col(f"`{first}`").cast("double")).limit(1).scalar()


def latest_values(history: DataFrame, key: str = "name", ts: str = "run_ts", value: str = "value") -> DataFrame:
    """Newest value per KPI (``max_by``: one row per key, combined map-side)."""
    return history.groupBy(key).agg(F.max_by(value, ts).alias("previous_value"), F.max(ts).alias("previous_ts"))


def track(current: DataFrame, history: DataFrame, key: str = "name", ts: str = "run_ts",
          value: str = "value") -> DataFrame:
    """Current value against the newest stored one: delta and trend (-1/0/1);
    both null for a KPI without history or without a current value."""
    prev = latest_values(history, key, ts, value)
    j = current.join(prev, key, "left")
    delta = F.col(value) - F.col("previous_value")
    return j.select(key, F.col(value).alias("value"), "previous_value",
                    delta.alias("delta"), F.signum(delta).cast("int").alias("trend"))


def history_trend(history: DataFrame, key: str = "name", ts: str = "run_ts", value: str = "value") -> DataFrame:
    """Delta and trend of every stored value against the one before it (per KPI)."""
    w = Window.partitionBy(key).orderBy(ts)
    delta = F.col(value) - F.lag(value).over(w)
    return history.select("*", delta.alias("delta"), F.signum(delta).cast("int").alias("trend"))


def threshold_status(value: Column, upper: Column | float | None, lower: Column | float | None) -> Column:
    """``above_upper`` / ``below_lower`` / ``ok`` against stored alert thresholds."""
    up = upper if isinstance(upper, Column) else F.lit(upper).cast("double")
    lo = lower if isinstance(lower, Column) else F.lit(lower).cast("double")
    return (F.when(value.isNull(), None).when(up.isNotNull() & (value > up), "above_upper")
            .when(lo.isNotNull() & (value < lo), "below_lower").otherwise("ok"))


def target_distance(value: Column, target: Column | float) -> Column:
    """(value - target) / target; null when the target is 0 or missing."""
    t = target if isinstance(target, Column) else F.lit(target).cast("double")
    return F.try_divide(value - t, F.nullif(t, F.lit(0.0)))


def target_achieved(value: Column, target: Column | float) -> Column:
    """True when the value equals the target (null when either is missing)."""
    t = target if isinstance(target, Column) else F.lit(target).cast("double")
    return value.cast("double") == t


def format_value(value: Column, value_type: str = "number", precision: int = 2,
                 is_integer: bool = False) -> Column:
    """Text of a value as the UI shows it: ``$1,234.50``, ``12.34%``,
    ``1,234.50`` (integers without decimals), plain text; null -> ``N/A``.
    Rounding is half-to-even on the binary value, as Python's format."""
    v = value.cast("double")
    if value_type == "currency":
        s = F.concat(F.lit("$"), F.format_number(v, precision))  # "$-5.00" for negatives, as Python
    elif value_type == "percentage":  # no thousands separator, as Python's '.2%'
        s = F.concat(F.regexp_replace(F.format_number(v * 100.0, precision), ",", ""), F.lit("%"))
    elif value_type == "number":
        s = F.format_number(value.cast("long"), 0) if is_integer else F.format_number(v, precision)
    else:
        s = value.cast("string")
    return F.coalesce(s, F.lit(texts.NOT_AVAILABLE))


KPI_SCHEMA = T.StructType([
    T.StructField("project_id", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("calculation_type", T.StringType()),
    T.StructField("calculation_logic", T.StringType()), T.StructField("target_value", T.DoubleType()),
    T.StructField("alert_threshold_upper", T.DoubleType()), T.StructField("alert_threshold_lower", T.DoubleType()),
    T.StructField("is_active", T.BooleanType()),
])


def upsert(definitions: DataFrame, updates: DataFrame) -> DataFrame:
    """Define or overwrite KPIs by (project_id, name): the new row wins whole.
    Two updates of one KPI are a conflict: the job fails and names the KPI."""
    clash = F.concat(F.lit("Several updates of one KPI: "), F.col("name"))
    updates = updates.groupBy("project_id", "name").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in updates.columns if c not in ("project_id", "name")]) \
        .filter(F.when(F.col("_n") > 1, F.raise_error(clash).cast("boolean")).otherwise(F.lit(True))).drop("_n")
    old = definitions.alias("o")
    new = updates.alias("n")
    cond = F.col("o.name") == F.col("n.name")
    cond = cond & F.col("o.project_id").eqNullSafe(F.col("n.project_id"))
    j = old.join(new, cond, "full")
    has_new = F.col("n.name").isNotNull()
    return j.select(*[F.when(has_new, F.col(f"n.{f.name}")).otherwise(F.col(f"o.{f.name}")).alias(f.name)
                      for f in KPI_SCHEMA.fields])


def active(kpis: DataFrame, project_id: int | None = None) -> DataFrame:
    """Active KPI definitions, optionally of one project."""
    cond = F.col("is_active")
    if project_id is not None:
        cond = cond & (F.col("project_id") == project_id)
    return kpis.filter(cond)


TRACKED = ("project_id INT, name STRING, value DOUBLE, previous_value DOUBLE, delta DOUBLE, trend INT, status STRING")


def track_all(df: DataFrame, definitions: DataFrame, history_path: str, run_id: str, project_id: int | None = None,
              run_ts=None) -> DataFrame:
    """Track every active KPI in one call: values of all definitions from one
    aggregation, the newest stored value of an earlier run, delta and trend,
    the threshold status, and the values appended to the history under
    ``run_id`` (repeating a run replaces its rows and compares with the runs
    before it). Definitions and results are one row per KPI."""
    from vellum.sources.sinks import append_kpi_values  # the sinks module builds on the operators
    spark = df.sparkSession
    kept = active(definitions, project_id)
    rows = [r.asDict() for r in kept.select("project_id", "name", "calculation_type", "calculation_logic").collect()]
    # a name may exist in several projects: values are computed per definition
    specs = [{"name": str(i), "calculation_logic": r["calculation_logic"],
              "calculation_type": r["calculation_type"] or "expression"} for i, r in enumerate(rows)]
    keys = spark.createDataFrame([(str(i), r["project_id"], r["name"]) for i, r in enumerate(rows)],
                                 "_i STRING, project_id INT, name STRING")
    full = keys.withColumn("_key", F.concat_ws("/", F.coalesce(F.col("project_id").cast("string"), F.lit("")), "name"))
    values = calculate_kpis(df, specs).withColumnRenamed("name", "_i")
    now = full.join(values, "_i", "left")
    history = _history(spark, history_path, run_id)
    if history is not None:
        previous = latest_values(history.withColumnRenamed("name", "_key"), "_key").select("_key", "previous_value")
        now = now.join(previous, "_key", "left")
    else:
        now = now.withColumn("previous_value", F.lit(None).cast("double"))
    delta = F.col("value") - F.col("previous_value")
    limits = kept.select(F.concat_ws("/", F.coalesce(F.col("project_id").cast("string"), F.lit("")), "name").alias("_key"),
                         "alert_threshold_upper", "alert_threshold_lower")
    result = now.join(limits, "_key").select(
        "_key", "project_id", "name", "value", "previous_value", delta.alias("delta"),
        F.signum(delta).cast("int").alias("trend"),
        threshold_status(F.col("value"), F.col("alert_threshold_upper"), F.col("alert_threshold_lower")).alias("status"))
    done = result.collect()  # one row per definition, before the append changes the history
    out = spark.createDataFrame([tuple(r)[1:] for r in done], TRACKED)
    stored = spark.createDataFrame([(r["_key"], r["value"]) for r in done], "name STRING, value DOUBLE")
    append_kpi_values(stored, history_path, run_id, run_ts)
    return out


def _history(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """Stored values of the other runs, None before the first append."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema("name STRING, run_ts TIMESTAMP, value DOUBLE, run_id STRING").parquet(path) \
        .filter(F.col("run_id") != run_id)
