"""Cleaning and feature-step suggestions computed from one aggregation.

Suggestions are rows ``step_type, params MAP<STRING,STRING>, issue,
details, rationale``. The type probe checks the whole column (not a
100-value sample): a text column is numeric when every non-null value
parses as a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.numeric import NUMBER_PATTERN, is_datetime_type, is_numeric_type, is_string_type
from vellum.operators.common import col
from vellum.operators.profile import _missing
from vellum import texts

SUGGESTION_SCHEMA = T.StructType([
    T.StructField("step_type", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("issue", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("rationale", T.StringType()),
])


def _pct(num: Column, den: Column) -> Column:
    """Percentage with one decimal, rounded half-to-even on the binary value (as Python)."""
    return F.regexp_replace(F.format_number(num / den * 100.0, 1), ",", "")


def _union(parts: list[DataFrame], spark) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], SUGGESTION_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cast(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SUGGESTION_SCHEMA.fields])


def suggest_cleaning(df: DataFrame) -> DataFrame:
    """Cleaning suggestions: imputation per column with missing values, duplicate
    removal, and a type conversion or string cleaning per text column."""
    spark = df.sparkSession
    fields = df.schema.fields
    text_cols = [f.name for f in fields if is_string_type(f.dataType)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(_missing(df, f.name)).alias(f"m{i}"))
    for i, f in enumerate(fields):
        if f.name in text_cols:
            x = col(f.name)
            aggs += [F.count_if(x.isNotNull() & ~x.rlike(NUMBER_PATTERN)).alias(f"bad_num{i}"),
                     F.count_if(x.isNotNull() & F.try_to_timestamp(x).isNull()).alias(f"bad_ts{i}"),
                     F.count(x).alias(f"nn{i}")]
    stats = df.agg(*aggs)
    # distinct counts in their own aggregation (one struct-valued scalar subquery)
    dist = (df.select(F.struct(*[F.count_distinct(col(f.name)).alias(f"u{i}") for i, f in enumerate(fields)
                                 if f.name in text_cols]).alias("d")).scalar() if text_cols else None)
    dup = (df.groupBy(*[col(c) for c in df.columns]).count()
           .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("dups")))
    parts = []
    # 1. missing values, one row per column with nulls
    items = []
    for i, f in enumerate(fields):
        strategy = "median" if is_numeric_type(f.dataType) else "mode"
        m = F.col(f"m{i}")
        items.append(F.when(m > 0, F.struct(
            F.lit("impute_missing").alias("step_type"),
            F.create_map(F.lit("column"), F.lit(f.name), F.lit("strategy"), F.lit(strategy)).alias("params"),
            F.lit(texts.MISSING_ISSUE).alias("issue"),
            F.format_string(texts.MISSING_DETAILS, F.lit(f.name), m,
                            _pct(m, F.col("n"))).alias("details"),
            F.lit(texts.MISSING_RATIONALE.format(strategy=strategy, column=f.name)).alias("rationale"))))
    if items:
        parts.append(stats.select(F.explode(F.array(*items)).alias("s")).filter("s IS NOT NULL").select("s.*"))
    # 2. duplicate rows
    parts.append(dup.select(F.lit("drop_duplicates").alias("step_type"),
                            F.create_map().cast("map<string,string>").alias("params"),
                            F.lit(texts.DUPLICATES_ISSUE).alias("issue"),
                            F.format_string(texts.DUPLICATES_DETAILS, F.col("dups"),
                                            _pct(F.col("dups"), stats.select(F.col("n")).scalar())).alias("details"),
                            F.lit(texts.DUPLICATES_RATIONALE).alias("rationale"),
                            F.col("dups")).filter("dups > 0").drop("dups"))
    # 3. text columns: numeric, datetime, category or string cleaning
    items = []
    for i, f in enumerate(fields):
        if f.name not in text_cols:
            continue
        c = f.name

        def row(step, target, issue, details, rationale):
            params = (F.create_map(F.lit("column"), F.lit(c), F.lit("target_type"), F.lit(target)) if target
                      else F.create_map(F.lit("column"), F.lit(c)))
            return F.struct(F.lit(step).alias("step_type"), params.alias("params"), F.lit(issue).alias("issue"),
                            F.lit(details).alias("details"), F.lit(rationale).alias("rationale"))
        nn, u = F.col(f"nn{i}"), dist[f"u{i}"]
        items.append(
            F.when(F.col(f"bad_num{i}") == 0, row(
                "convert_type", "numeric", texts.NUMERIC_ISSUE, texts.NUMERIC_DETAILS.format(column=c),
                texts.NUMERIC_RATIONALE))
            .when(F.col(f"bad_ts{i}") == 0, row(
                "convert_type", "datetime", texts.DATETIME_ISSUE, texts.DATETIME_DETAILS.format(column=c),
                texts.DATETIME_RATIONALE))
            .when(F.try_divide(u.cast("double"), nn) < 0.5, row(
                "convert_type", "category", texts.CATEGORY_ISSUE, texts.CATEGORY_DETAILS.format(column=c),
                texts.CATEGORY_RATIONALE))
            .otherwise(row(
                "strip_whitespace", None, texts.STRING_ISSUE, texts.STRING_DETAILS.format(column=c),
                texts.STRING_RATIONALE)))
    if items:
        parts.append(stats.select(F.explode(F.array(*items)).alias("s")).select("s.*"))
    return _union([_cast(p) for p in parts], spark)


def suggest_features(df: DataFrame, wide: int = 200) -> DataFrame:
    """The six proposals (date parts, interaction, group mean, quantile bins,
    one-hot, polynomial) on the first *usable* column of each kind: numeric
    with std > 0, text and dates with more than one value. One statistics
    aggregation decides usability. For a text column of more than ``wide``
    values the encoding proposed is the vector form, which needs no column
    per value."""
    spark = df.sparkSession
    fields = df.schema.fields
    nums = [f.name for f in fields if is_numeric_type(f.dataType)]
    cats = [f.name for f in fields if is_string_type(f.dataType)]
    dates = [f.name for f in fields if is_datetime_type(f.dataType)]
    # distinct counts in their own aggregation (one struct-valued scalar subquery)
    dist = (df.select(F.struct(*[F.count_distinct(col(c)).alias(f"u_{c}") for c in cats + dates]).alias("d")).scalar()
            if cats or dates else None)
    aggs = [F.lit(1).alias("_")]
    for c in nums:
        aggs.append((F.coalesce(F.stddev_samp(col(c).cast("double")), F.lit(0.0)) > 0).alias(f"ok_{c}"))
    for c in cats:
        u = dist[f"u_{c}"]
        aggs.append((u >= 2).alias(f"ok_{c}"))
    for c in dates:
        aggs.append((dist[f"u_{c}"] > 1).alias(f"ok_{c}"))
    stats = df.agg(*aggs)

    def first_ok(names: list[str], k: int = 1) -> Column:
        """The first k usable names, as an array (usability is data-dependent)."""
        arr = F.array(*[F.when(F.col(f"ok_{c}"), F.lit(c)) for c in names]) if names else F.array().cast("array<string>")
        return F.slice(F.filter(arr, lambda x: x.isNotNull()), 1, k)

    m = F.create_map
    L = F.lit
    is_wide = F.create_map(*[x for c in cats for x in (L(c), dist[f"u_{c}"] > wide)]) if cats else F.create_map().cast("map<string,boolean>")
    s = stats.select(first_ok(dates).alias("d"), first_ok(nums, 3).alias("num"), first_ok(cats).alias("cat"), is_wide.alias("wide"))
    d0, n0, n1, c0 = F.col("d")[0], F.col("num")[0], F.col("num")[1], F.col("cat")[0]
    nn = F.size("num")
    has_date, two_nums, one_num, has_cat = F.size("d") > 0, nn >= 2, nn >= 1, F.size("cat") > 0
    conds = [has_date, two_nums, one_num & has_cat, one_num, has_cat, two_nums]
    rows_ = [
        F.struct(
            L("date_extraction").alias("step_type"),
            m(L("column"), d0, L("components"), L('["year", "month", "dayofweek", "hour"]')).alias("params"),
            L("Feature Suggestion").alias("issue"),
            F.format_string(texts.DATE_PARTS_DETAILS, d0).alias("details"),
            L(texts.DATE_PARTS_RATIONALE).alias("rationale")),
        F.struct(
            L("numeric_interaction"), m(L("column1"), n0, L("column2"), n1, L("operation"), L("multiply")),
            L("Feature Suggestion"), F.format_string(texts.INTERACTION_DETAILS, n0, n1),
            L(texts.INTERACTION_RATIONALE)),
        F.struct(
            L("grouped_aggregation"), m(L("group_by_column"), c0, L("agg_column"), n0, L("agg_func"), L("mean")),
            L("Feature Suggestion"), F.format_string(texts.GROUP_AGG_DETAILS, n0, c0),
            L(texts.GROUP_AGG_RATIONALE)),
        F.struct(
            L("binning"), m(L("column"), n0, L("bins"), L("5"), L("strategy"), L("quantile")),
            L("Feature Suggestion"), F.format_string(texts.BINNING_DETAILS, n0),
            L(texts.BINNING_RATIONALE)),
        F.struct(
            L("categorical_encoding"), m(L("columns"), F.to_json(F.col("cat")), L("method"),
                                            F.when(F.col("wide")[c0], "one-hot-vector").otherwise("one-hot")),
            L("Feature Suggestion"), F.format_string(texts.ENCODING_DETAILS, c0),
            L(texts.ENCODING_RATIONALE)),
        F.struct(
            L("polynomial_features"), m(L("columns"), F.to_json(F.col("num")), L("degree"), L("2")),
            L("Feature Suggestion"),
            F.format_string(texts.POLYNOMIAL_DETAILS, nn),
            L(texts.POLYNOMIAL_RATIONALE)),
    ]
    props = [F.when(c, r) for c, r in zip(conds, rows_)]
    nothing = ~(has_date | two_nums | one_num | has_cat)
    props.append(F.when(nothing, F.struct(
        L(texts.NO_SUGGESTIONS), F.create_map().cast("map<string,string>"), L("Feature Suggestion"),
        L(texts.NO_SUGGESTIONS_DETAILS), L(None).cast("string"))))
    names = [f.name for f in SUGGESTION_SCHEMA.fields]
    rows = s.select(F.explode(F.array(*[p.cast(
        T.StructType([T.StructField(n, SUGGESTION_SCHEMA[n].dataType) for n in names])) for p in props])).alias("x"))
    return rows.filter("x IS NOT NULL").select("x.*")
