"""Profiles (AG9-AG20) and suggestions (CL11-CL13, FE9)."""

from vellum.operators import profile, suggest
from vellum.suite import query

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]


def _union(sqls):
    return "\nUNION ALL\n".join(sqls)


@query("ag9_overview", views=["orders_dup"], sql="""
SELECT CAST(count(*) AS BIGINT) AS rows, 6 AS columns,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) AS BIGINT) AS duplicate_rows
FROM orders_dup""")
def ag9(spark, sf):
    return profile.overview(spark.table("orders_dup"))


@query("ag17_frame_summary", sql="""
SELECT CAST(count(*) AS BIGINT) AS rows, 11 AS columns,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows
FROM lineitem""")
def ag17(spark, sf):
    return profile.overview(spark.table("lineitem"))


@query("ag10_describe", rounds={"mean": 6, "std": 6, "p25": 6, "p50": 6, "p75": 6}, sql=_union([f"""
SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
       CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
       quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem""" for c in LI_NUM]))
def ag10(spark, sf):
    return profile.describe_numeric(spark.table("lineitem"))


def _cat_sql(table, cols):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS unique,
       arg_min(v, (-n, v)) AS top, CAST(max(n) AS BIGINT) AS freq
FROM (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})""")
    return _union(parts)


@query("ag11_categorical", sql=_cat_sql("documents", ["text", "lang", "source"]))
def ag11(spark, sf):
    return profile.describe_categorical(spark.table("documents"))


@query("ag11_categorical_nulls", views=["events_nulls"], sql=_cat_sql("events_nulls", ["event_type"]))
def ag11n(spark, sf):
    return profile.describe_categorical(spark.table("events_nulls"))


def _missing_sql(table, cols):
    parts = [f"""
SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing_count,
       count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100.0 AS missing_percentage FROM {table}""" for c in cols]
    return f"SELECT * FROM ({_union(parts)}) WHERE missing_count > 0"


@query("ag12_missing", views=["orders_nulls"], sql=_missing_sql("orders_nulls", [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def ag12(spark, sf):
    return profile.missing_values(spark.table("orders_nulls"))


@query("ag12_missing_events", views=["events_nulls"], sql=_missing_sql("events_nulls", [
    "event_id", "ts", "user_id", "event_type", "value"]))
def ag12e(spark, sf):
    return profile.missing_values(spark.table("events_nulls"))


@query("ag13_unique", sql=_union([f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count "
                                  f"FROM lineitem" for c in LI_NUM + ["l_returnflag", "l_linestatus", "l_shipdate"]]))
def ag13(spark, sf):
    return profile.unique_counts(spark.table("lineitem"))


@query("ag14_skew_kurtosis", rounds={"skewness": 6, "kurtosis": 6}, sql=_union([
    f"SELECT '{c}' AS column_name, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis FROM lineitem" for c in LI_NUM]))
def ag14(spark, sf):
    return profile.shape_moments(spark.table("lineitem"))


@query("ag20_semantic_types", sql=_union([
    """SELECT 'doc_id' AS column_name, CASE WHEN count(DISTINCT doc_id) < 20 THEN 'numeric_id_candidate'
       ELSE 'numeric' END AS semantic_type FROM documents""",
    """SELECT 'n_chars', CASE WHEN count(DISTINCT n_chars) < 20 THEN 'numeric_id_candidate' ELSE 'numeric' END
       FROM documents"""] + [f"""
SELECT '{c}', CASE WHEN count({c}) = 0 THEN 'unknown'
  WHEN count(DISTINCT {c}) / count({c}) > 0.9 THEN CASE WHEN avg(length({c})) > 50 THEN 'text_long'
       ELSE 'text_or_id_high_cardinality' END ELSE 'categorical' END FROM documents""" for c in ["text", "lang", "source"]]))
def ag20(spark, sf):
    return profile.semantic_types(spark.table("documents"))


@query("ag20_semantic_types_orders", sql=_union([
    f"""SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) < 20 THEN 'numeric_id_candidate'
       ELSE 'numeric' END AS semantic_type FROM orders""" for c in ["o_orderkey", "o_custkey", "o_totalprice"]] + [
    "SELECT 'o_orderdate', 'datetime'"] + [f"""
SELECT '{c}', CASE WHEN count({c}) = 0 THEN 'unknown'
  WHEN count(DISTINCT {c}) / count({c}) > 0.9 THEN CASE WHEN avg(length({c})) > 50 THEN 'text_long'
       ELSE 'text_or_id_high_cardinality' END ELSE 'categorical' END FROM orders"""
    for c in ["o_orderstatus", "o_orderpriority"]]))
def ag20o(spark, sf):
    return profile.semantic_types(spark.table("orders"))


# -- suggestions -------------------------------------------------------------

NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _impute_row(table, c, strategy):
    return f"""
SELECT 'impute_missing' AS step_type, MAP {{'column': '{c}', 'strategy': '{strategy}'}} AS params,
       'Missing Values' AS issue,
       'Column ''{c}'' has ' || m || ' missing values (' || printf('%.1f', m / n * 100.0) || '%).' AS details,
       'Suggesting ''{strategy}'' imputation for ''{c}''. Consider alternatives like mean, constant, or dropping.' AS rationale
FROM (SELECT count(*) FILTER (WHERE {c} IS NULL) AS m, count(*) AS n FROM {table}) WHERE m > 0"""


def _dup_row(table):
    return f"""
SELECT 'drop_duplicates' AS step_type, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS params, 'Duplicate Rows' AS issue,
       'Found ' || d || ' complete duplicate rows (' || printf('%.1f', d / n * 100.0) || '%).' AS details,
       'Dropping duplicates ensures each record is unique.' AS rationale
FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS d, count(*) AS n FROM {table})
WHERE d > 0"""


def _type_row(table, c):
    return f"""
SELECT CASE WHEN k = 'strip' THEN 'strip_whitespace' ELSE 'convert_type' END AS step_type,
       CASE WHEN k = 'strip' THEN MAP {{'column': '{c}'}} ELSE MAP {{'column': '{c}', 'target_type': k}} END AS params,
       CASE k WHEN 'numeric' THEN 'Potential Numeric Type' WHEN 'datetime' THEN 'Potential Datetime Type'
              WHEN 'category' THEN 'Potential Categorical Type' ELSE 'Potential String Cleaning Needed' END AS issue,
       CASE k WHEN 'numeric' THEN 'Column ''{c}'' (object type) might be convertible to numeric.'
              WHEN 'datetime' THEN 'Column ''{c}'' (object type) might be convertible to datetime.'
              WHEN 'category' THEN 'Column ''{c}'' (object) has relatively few unique values.'
              ELSE 'Column ''{c}'' is object type. Check for leading/trailing spaces or inconsistent casing.' END AS details,
       CASE k WHEN 'numeric' THEN 'Converting to numeric enables calculations and analysis.'
              WHEN 'datetime' THEN 'Converting to datetime enables time-based analysis.'
              WHEN 'category' THEN 'Converting to ''category'' can save memory and improve performance.'
              ELSE 'Standardizing strings ensures consistency.' END AS rationale
FROM (SELECT CASE
  WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND NOT regexp_matches({c}, '{NUM_RE}')) = 0 THEN 'numeric'
  WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS TIMESTAMP) IS NULL) = 0 THEN 'datetime'
  WHEN count(DISTINCT {c}) / count({c}) < 0.5 THEN 'category' ELSE 'strip' END AS k FROM {table})"""


@query("cl11_suggest_missing", views=["orders_nulls"], sql=_union([
    _impute_row("orders_nulls", "o_totalprice", "median"), _impute_row("orders_nulls", "o_orderpriority", "mode"),
    _dup_row("orders_nulls"), _type_row("orders_nulls", "o_orderstatus"),
    _type_row("orders_nulls", "o_orderpriority")]))
def cl11(spark, sf):
    return suggest.suggest_cleaning(spark.table("orders_nulls"))


@query("cl12_suggest_duplicates", views=["orders_dup"], sql=_union([
    _dup_row("orders_dup"), _type_row("orders_dup", "o_orderstatus"), _type_row("orders_dup", "o_orderpriority")]))
def cl12(spark, sf):
    return suggest.suggest_cleaning(spark.table("orders_dup"))


@query("cl13_suggest_types", views=["customer_dirty"], sql=_union([
    _type_row("customer_dirty", c) for c in ["c_name", "c_acctbal_text", "c_mktsegment"]]))
def cl13(spark, sf):
    return suggest.suggest_cleaning(spark.table("customer_dirty"))


@query("cl13_suggest_types_numeric_text", sql=_union([
    _type_row("t", "k"), _type_row("t", "s")]).replace("FROM t)", "FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k, "
                                                       "CAST(o_orderdate AS VARCHAR) AS s FROM orders))"))
def cl13n(spark, sf):
    df = spark.table("orders").selectExpr("CAST(o_orderkey AS STRING) AS k", "CAST(o_orderdate AS STRING) AS s")
    return suggest.suggest_cleaning(df).filter("issue <> 'Duplicate Rows'")


@query("fe9_suggest_features", sql="""
SELECT * FROM (VALUES
 ('date_extraction', MAP {'column': 'o_orderdate', 'components': '["year", "month", "dayofweek", "hour"]'},
  'Feature Suggestion', 'Extract time components from ''o_orderdate''.', 'Temporal patterns are often predictive or cyclical.'),
 ('numeric_interaction', MAP {'column1': 'o_orderkey', 'column2': 'o_custkey', 'operation': 'multiply'},
  'Feature Suggestion', 'Create interaction: ''o_orderkey'' * ''o_custkey''.', 'May capture synergistic effects.'),
 ('grouped_aggregation', MAP {'group_by_column': 'o_orderstatus', 'agg_column': 'o_orderkey', 'agg_func': 'mean'},
  'Feature Suggestion', 'Aggregate ''o_orderkey'' grouped by ''o_orderstatus''.', 'Captures group-level behavior.'),
 ('binning', MAP {'column': 'o_orderkey', 'bins': '5', 'strategy': 'quantile'},
  'Feature Suggestion', 'Discretize ''o_orderkey'' into bins.', 'Can capture non-linear relationships.'),
 ('categorical_encoding', MAP {'columns': '["o_orderstatus"]', 'method': 'one-hot'},
  'Feature Suggestion', 'Encode categorical: ''o_orderstatus''.', 'Needed for many ML models.'),
 ('polynomial_features', MAP {'columns': '["o_orderkey","o_custkey","o_totalprice"]', 'degree': '2'},
  'Feature Suggestion', 'Generate polynomial features (degree 2) for 3 column(s).',
  'Capture non-linear interactions between numeric features.')
) AS t(step_type, params, issue, details, rationale)
WHERE (SELECT count(DISTINCT o_orderdate) > 1 AND stddev_samp(o_orderkey) > 0 AND stddev_samp(o_custkey) > 0
          AND stddev_samp(o_totalprice) > 0 AND count(DISTINCT o_orderstatus) BETWEEN 2 AND 200 FROM orders)""")
def fe9(spark, sf):
    return suggest.suggest_features(spark.table("orders"))
