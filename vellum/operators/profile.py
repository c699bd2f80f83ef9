"""Column profiling: overview, numeric and categorical describe, missing
values, distinct counts, skewness / kurtosis and semantic types.

Each profile is one aggregation over the whole table (all columns at
once, combined map-side), reshaped to one row per column with
``unpivot``. ``exact=False`` swaps exact percentiles / distinct counts
for ``percentile_approx`` / ``approx_count_distinct`` (bounded memory per
task on very large tables). Unlike the reference, no 10 000-row sample is
taken: Spark profiles every row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.numeric import is_datetime_type, is_numeric_type, is_string_type, nan_to_null
from vellum.operators.common import col, present, seeded_sample
from vellum.operators.quantiles import exact_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string_type(f.dataType)]


def _num(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    x = col(c).cast("double")
    return nan_to_null(x) if isinstance(dt, (T.FloatType, T.DoubleType)) else x


def _missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return col(c).isNull() | F.isnan(col(c))
    return col(c).isNull()


def _long(df: DataFrame, structs: dict[str, Column], key: str = "column_name") -> DataFrame:
    """One aggregated row of per-column structs -> one row per column."""
    wide = df.agg(*[s.alias(c) for c, s in structs.items()])
    names = list(structs)
    return wide.unpivot([], [col(c) for c in names], key, "s").select(key, "s.*")


def overview(df: DataFrame) -> DataFrame:
    """rows, columns, duplicate_rows (rows beyond the first of each value)."""
    g = df.groupBy(*[col(c) for c in df.columns]).count()
    return g.agg(F.sum("count").cast("long").alias("rows"),
                 (F.sum("count") - F.count(F.lit(1))).cast("long").alias("duplicate_rows")) \
        .select(F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                F.coalesce("duplicate_rows", F.lit(0)).alias("duplicate_rows"))


DESCRIBE_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()), T.StructField("count", T.LongType()),
    *[T.StructField(n, T.DoubleType()) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")],
])


def describe_numeric(df: DataFrame, exact: bool = True) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 %, max per numeric column.

    ``exact``: one aggregation gives count, mean, std, min and max of every
    column (a few values per column reach the driver), then
    ``exact_quantiles`` selects the quartiles with counting passes; the table
    is built from those bounded results. ``exact=False`` is a single lazy
    aggregation with ``percentile_approx``."""
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], DESCRIBE_SCHEMA)
    xs = [_num(df, c) for c in cols]
    if exact:
        row = df.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(xs)
                       for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("lo", F.min),
                                    ("hi", F.max))]).first()
        n = [row[f"n{i}"] for i in range(len(cols))]
        lo = [row[f"lo{i}"] for i in range(len(cols))]
        hi = [row[f"hi{i}"] for i in range(len(cols))]
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], median_mean=False)
        rows = [(c, int(n[i]), row[f"m{i}"], row[f"s{i}"], lo[i], *q[c], hi[i]) for i, c in enumerate(cols)]
        return df.sparkSession.createDataFrame(rows, DESCRIBE_SCHEMA)
    structs = {}
    for c, x in zip(cols, xs):
        a = F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 100000).cast("array<double>")
        structs[c] = F.struct(F.count(x).cast("long").alias("count"), F.avg(x).alias("mean"),
                              F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                              a[0].alias("p25"), a[1].alias("p50"), a[2].alias("p75"), F.max(x).alias("max"))
    return _long(df, structs)


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, unique, top, freq per text column; ties for top go to the smallest value."""
    cols = columns or string_columns(df)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("v"))
                                          for c in cols])).alias("p")).select("p.*")
    counts = pairs.filter(F.col("v").isNotNull()).groupBy("column_name", "v").count()
    return counts.groupBy("column_name").agg(
        F.sum("count").cast("long").alias("count"), F.count(F.lit(1)).cast("long").alias("unique"),
        F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("top"),
        F.max("count").cast("long").alias("freq"))


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with at least one missing value: count and percentage."""
    structs = {c: F.struct(F.count_if(_missing(df, c)).cast("long").alias("missing_count"),
                           F.count(F.lit(1)).alias("n")) for c in df.columns}
    out = _long(df, structs)
    return (out.filter(F.col("missing_count") > 0)
            .select("column_name", "missing_count",
                    (F.col("missing_count") / F.col("n") * 100.0).alias("missing_percentage")))


def unique_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    fn = F.count_distinct if exact else (lambda x: F.approx_count_distinct(x, 0.01))
    structs = {c: F.struct(fn(present(df, c)).cast("long").alias("unique_count")) for c in df.columns}
    return _long(df, structs)


def shape_moments(df: DataFrame) -> DataFrame:
    """Bias-corrected skewness G1 (n >= 3) and excess kurtosis G2 (n >= 4), as pandas."""
    structs = {}
    for c in numeric_columns(df):
        x = _num(df, c)
        n = F.count(x).cast("double")
        g1, g2 = F.skewness(x), F.kurtosis(x)
        skew = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        structs[c] = F.struct(skew.alias("skewness"), kurt.alias("kurtosis"))
    return _long(df, structs)


def semantic_types(df: DataFrame) -> DataFrame:
    """numeric_id_candidate / numeric / datetime / text_long /
    text_or_id_high_cardinality / categorical / boolean / unknown.

    Distinct counts come from their own aggregation (a struct-valued scalar
    subquery, run once): mixed with plain aggregates, Spark's distinct
    rewrite would expand every row once per column for all of them."""
    fields = df.schema.fields
    dist = df.select(F.struct(*[F.count_distinct(col(f.name)).alias(f"u{i}")
                                for i, f in enumerate(fields)]).alias("d")).scalar()
    structs = {}
    for i, f in enumerate(fields):
        c, dt = f.name, f.dataType
        x = col(c)
        nunique = dist[f"u{i}"]
        if isinstance(dt, T.BooleanType):
            kind = F.lit("boolean")
        elif is_numeric_type(dt):
            kind = F.when(nunique < 20, "numeric_id_candidate").otherwise("numeric")
        elif is_datetime_type(dt):
            kind = F.lit("datetime")
        elif is_string_type(dt):
            nn = F.count(x)
            ratio = F.try_divide(nunique.cast("double"), nn)
            kind = (F.when(nn == 0, "unknown")
                    .when(ratio > 0.9, F.when(F.avg(F.length(x)) > 50, "text_long")
                          .otherwise("text_or_id_high_cardinality"))
                    .otherwise("categorical"))
        else:
            kind = F.lit("unknown")
        structs[c] = F.struct(kind.alias("semantic_type"))
    return _long(df, structs)


def profile(df: DataFrame, exact: bool = True, sample_rows: int | None = None) -> dict[str, DataFrame]:
    """All profile tables from few passes: one aggregation over every column
    (missing counts, moments, min/max, text lengths), one for the distinct
    counts, one quantile selection for the quartiles, one grouped count for
    the top text values and one for duplicate rows. Per-column results are bounded (a few numbers per
    column) and the small tables are built from them. ``sample_rows`` profiles
    a seeded sample of that many rows, as the reference does (10 000, seed
    42); by default every row is profiled."""
    if sample_rows:
        df = seeded_sample(df, sample_rows)
    spark = df.sparkSession
    fields = df.schema.fields
    nums = numeric_columns(df)
    distinct = F.count_distinct if exact else (lambda x: F.approx_count_distinct(x, 0.01))
    # distinct counts get their own aggregation: mixed with plain aggregates, Spark's
    # rewrite would expand every row once per distinct column for all of them
    u = df.agg(*[distinct(col(f.name)).alias(f"u{i}") for i, f in enumerate(fields)]).first()
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        aggs += [F.count_if(_missing(df, f.name)).alias(f"miss{i}"), F.count(col(f.name)).alias(f"nn{i}")]
        if f.name in nums:
            x = _num(df, f.name)
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.skewness(x).alias(f"g1_{i}"),
                     F.kurtosis(x).alias(f"g2_{i}")]
        elif is_string_type(f.dataType):
            aggs.append(F.avg(F.length(col(f.name))).alias(f"len{i}"))
    r = df.agg(*aggs).first().asDict()
    r.update(u.asDict())
    rows = r["rows"]
    idx = {f.name: i for i, f in enumerate(fields)}
    num_i = [idx[c] for c in nums]
    quart = exact_quantiles(df, nums, [0.25, 0.5, 0.75], median_mean=False) if exact and nums else {}
    if nums and not exact:
        approx = df.agg(*[F.percentile_approx(_num(df, c), [0.25, 0.5, 0.75], 100000).alias(c) for c in nums]).first()
        quart = {c: list(approx[c]) if approx[c] is not None else [None] * 3 for c in nums}
    distinct_rows = df.distinct().count()

    def g1g2(i):
        n = float(r[f"n{i}"] or 0)
        g1, g2 = r[f"g1_{i}"], r[f"g2_{i}"]
        skew = g1 * math.sqrt(n * (n - 1)) / (n - 2) if n >= 3 and g1 is not None else None
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n >= 4 and g2 is not None else None
        return skew, kurt

    def semantic(f, i):
        u, nn = r[f"u{i}"], r[f"nn{i}"]
        if isinstance(f.dataType, T.BooleanType):
            return "boolean"
        if is_numeric_type(f.dataType):
            return "numeric_id_candidate" if u < 20 else "numeric"
        if is_datetime_type(f.dataType):
            return "datetime"
        if is_string_type(f.dataType):
            if nn == 0:
                return "unknown"
            if u / nn > 0.9:
                return "text_long" if (r[f"len{i}"] or 0) > 50 else "text_or_id_high_cardinality"
            return "categorical"
        return "unknown"

    numeric_rows = [(c, int(r[f"n{i}"]), r[f"m{i}"], r[f"s{i}"], r[f"lo{i}"], *(quart.get(c) or [None] * 3),
                     r[f"hi{i}"]) for c, i in zip(nums, num_i)]
    return {
        "overview": spark.createDataFrame([(rows, len(fields), rows - distinct_rows)],
                                          "rows long, columns int, duplicate_rows long"),
        "numeric": spark.createDataFrame(numeric_rows, DESCRIBE_SCHEMA),
        "categorical": describe_categorical(df),
        "missing": spark.createDataFrame(
            [(f.name, r[f"miss{i}"], r[f"miss{i}"] / rows * 100.0) for i, f in enumerate(fields) if r[f"miss{i}"]],
            "column_name string, missing_count long, missing_percentage double"),
        "unique": spark.createDataFrame([(f.name, r[f"u{i}"]) for i, f in enumerate(fields)],
                                        "column_name string, unique_count long"),
        "moments": spark.createDataFrame([(c, *g1g2(i)) for c, i in zip(nums, num_i)],
                                         "column_name string, skewness double, kurtosis double"),
        "semantic_types": spark.createDataFrame([(f.name, semantic(f, i)) for i, f in enumerate(fields)],
                                                "column_name string, semantic_type string"),
    }
