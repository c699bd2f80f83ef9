"""Cleaning steps (CL), projections (PRJ), filters (FLT) and the step list (PL1)."""

from vellum.operators import clean
from vellum.plans.steps import run_steps
from vellum.suite import query

ORDERS_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

FLAGSHIP_STEPS = [
    {"step_type": "impute_missing", "params": {"column": "o_totalprice", "strategy": "median"}},
    {"step_type": "date_extraction", "params": {"column": "o_orderdate"}},
    {"step_type": "grouped_aggregation", "params": {"group_by_column": "o_orderpriority",
                                                    "agg_column": "o_totalprice", "agg_func": "mean"}},
]


@query("pl1_steps", views=["orders_nulls"], rounds={"o_totalprice_mean_by_o_orderpriority": 6}, sql="""
WITH imp AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         coalesce(o_totalprice, (SELECT median(o_totalprice) FROM orders_nulls)) AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders_nulls)
SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
       CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek,
       CAST(hour(o_orderdate) AS INTEGER) AS o_orderdate_hour,
       CASE WHEN o_orderpriority IS NULL THEN NULL
            ELSE avg(o_totalprice) OVER (PARTITION BY o_orderpriority) END AS o_totalprice_mean_by_o_orderpriority
FROM imp""")
def pl1_steps(spark, sf):
    return run_steps(spark.table("orders_nulls"), FLAGSHIP_STEPS)


LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LI_ORDER_SQL = ", ".join(LI_ORDER)


@query("cl1_drop_duplicates", views=["orders_dup"], sql="SELECT DISTINCT * FROM orders_dup")
def cl1_drop_duplicates(spark, sf):
    return clean.drop_duplicates(spark.table("orders_dup"))


@query("cl1_drop_duplicates_keep_none", views=["orders_dup"], sql=f"""
SELECT {ORDERS_COLS} FROM orders_dup GROUP BY ALL HAVING count(*) = 1""")
def cl1_keep_none(spark, sf):
    return clean.drop_duplicates(spark.table("orders_dup"), keep=False)


@query("cl1_drop_duplicates_subset_first", sql=f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LI_ORDER_SQL}) AS rn
  FROM lineitem) WHERE rn = 1""")
def cl1_subset_first(spark, sf):
    return clean.drop_duplicates(spark.table("lineitem"), subset=["l_orderkey", "l_linenumber"],
                                 keep="first", order_by=LI_ORDER)


@query("cl1_drop_duplicates_subset_last", sql=f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY {', '.join(c + ' DESC' for c in LI_ORDER)}) AS rn
  FROM lineitem) WHERE rn = 1""")
def cl1_subset_last(spark, sf):
    return clean.drop_duplicates(spark.table("lineitem"), subset=["l_orderkey", "l_linenumber"],
                                 keep="last", order_by=LI_ORDER)


@query("cl1_drop_duplicates_subset_none", sql="""
SELECT l.* FROM lineitem l SEMI JOIN (
  SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1) u
  USING (l_orderkey, l_linenumber)""")
def cl1_subset_none(spark, sf):
    return clean.drop_duplicates(spark.table("lineitem"), subset=["l_orderkey", "l_linenumber"], keep=False)


def _impute_sql(expr: str, col: str = "o_totalprice") -> str:
    cols = ORDERS_COLS.replace(col, f"{expr} AS {col}")
    return f"SELECT {cols} FROM orders_nulls"


@query("cl2_impute_mean", views=["orders_nulls"], rounds={"o_totalprice": 6},
       sql=_impute_sql("coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_nulls))"))
def cl2(spark, sf):
    return clean.impute_missing(spark.table("orders_nulls"), "o_totalprice", "mean")


@query("cl3_impute_median", views=["orders_nulls"],
       sql=_impute_sql("coalesce(o_totalprice, (SELECT median(o_totalprice) FROM orders_nulls))"))
def cl3(spark, sf):
    return clean.impute_missing(spark.table("orders_nulls"), "o_totalprice", "median")


@query("cl4_impute_mode", views=["orders_nulls"], sql=_impute_sql(
    "coalesce(o_orderpriority, (SELECT o_orderpriority FROM orders_nulls WHERE o_orderpriority IS NOT NULL "
    "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))", "o_orderpriority"))
def cl4(spark, sf):
    return clean.impute_missing(spark.table("orders_nulls"), "o_orderpriority", "mode")


@query("cl5_impute_constant", views=["orders_nulls"],
       sql=_impute_sql("coalesce(o_orderpriority, 'UNKNOWN')", "o_orderpriority"))
def cl5(spark, sf):
    return clean.impute_missing(spark.table("orders_nulls"), "o_orderpriority", "constant", value="UNKNOWN")


@query("cl5_impute_constant_numeric", views=["orders_nulls"],
       sql=_impute_sql("coalesce(o_totalprice, 0.0)"))
def cl5n(spark, sf):
    return clean.impute_missing(spark.table("orders_nulls"), "o_totalprice", "constant", value=0.0)


@query("cl6_impute_drop_rows", views=["orders_nulls"],
       sql="SELECT * FROM orders_nulls WHERE o_totalprice IS NOT NULL")
def cl6(spark, sf):
    return clean.impute_missing(spark.table("orders_nulls"), "o_totalprice", "drop_rows")


@query("flt1_drop_null_rows", views=["events_nulls"],
       sql="SELECT * FROM events_nulls WHERE event_type IS NOT NULL")
def flt1(spark, sf):
    return run_steps(spark.table("events_nulls"),
                     [{"step_type": "impute_missing", "params": {"column": "event_type", "strategy": "drop_rows"}}])


CUST_COLS = "c_custkey, c_nationkey, c_name, c_acctbal_text, c_mktsegment"


def _cust_sql(expr: str, col: str) -> str:
    return f"SELECT {CUST_COLS.replace(col, expr + ' AS ' + col, 1)} FROM customer_dirty"


@query("cl7_strip_whitespace", views=["customer_dirty"],
       sql=_cust_sql(r"regexp_replace(c_name, '^\s+|\s+$', '', 'g')", "c_name"))
def cl7(spark, sf):
    return clean.strip_whitespace(spark.table("customer_dirty"), "c_name")


@query("cl8_change_case_lower", views=["customer_dirty"], sql=_cust_sql("lower(c_mktsegment)", "c_mktsegment"))
def cl8l(spark, sf):
    return clean.change_case(spark.table("customer_dirty"), "c_mktsegment", "lower")


@query("cl8_change_case_upper", views=["customer_dirty"], sql=_cust_sql("upper(c_mktsegment)", "c_mktsegment"))
def cl8u(spark, sf):
    return clean.change_case(spark.table("customer_dirty"), "c_mktsegment", "upper")


# Title case oracle: capitalise each run of cased letters, lower the rest;
# the title case of a leading sharp s is 'Ss' (as Python and Java have it).
TITLE_SQL = (r"array_to_string(list_transform(regexp_extract_all({c}, "
             r"'([\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+)', 1), "
             r"lambda x: CASE WHEN substring(x, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substring(x, 1, 1)) END "
             r"|| lower(substring(x, 2))), '')")


@query("cl9_change_case_title", sql=f"SELECT doc_id, {TITLE_SQL.format(c='text')} AS text FROM documents")
def cl9(spark, sf):
    return clean.change_case(spark.table("documents").select("doc_id", "text"), "text", "title")


@query("cl9_change_case_title_mixed", views=["customer_dirty"],
       sql=_cust_sql(TITLE_SQL.format(c="c_mktsegment"), "c_mktsegment"))
def cl9m(spark, sf):
    return clean.change_case(spark.table("customer_dirty"), "c_mktsegment", "title")


NUM_SQL = (r"CASE WHEN regexp_matches({c}, '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$') "
           r"THEN TRY_CAST(trim({c}) AS DOUBLE) END")


@query("prj3_convert_numeric", views=["customer_dirty"],
       sql=_cust_sql(NUM_SQL.format(c="c_acctbal_text"), "c_acctbal_text"))
def prj3(spark, sf):
    return clean.convert_type(spark.table("customer_dirty"), "c_acctbal_text", "numeric")


@query("prj4_convert_datetime", sql="""
SELECT o_orderkey, TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) AS o_orderdate FROM orders""")
def prj4(spark, sf):
    steps = [{"step_type": "convert_type", "params": {"column": "o_orderdate", "target_type": "string"}},
             {"step_type": "convert_type", "params": {"column": "o_orderdate", "target_type": "datetime"}}]
    return run_steps(spark.table("orders").select("o_orderkey", "o_orderdate"), steps)


@query("prj5_convert_string", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
       o_orderpriority FROM orders""")
def prj5(spark, sf):
    df = spark.table("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    df = clean.convert_type(df, "o_orderkey", "string")
    return clean.convert_type(df, "o_orderdate", "string")


@query("prj6_convert_category", sql="SELECT o_orderkey, o_orderstatus FROM orders")
def prj6(spark, sf):
    df = spark.table("orders").select("o_orderkey", "o_orderstatus")
    out = clean.convert_type(df, "o_orderstatus", "category")
    assert out.schema["o_orderstatus"].metadata.get("categorical") is True
    return out


@query("prj1_rename_column", sql="SELECT o_orderkey AS order_id, o_custkey, o_totalprice FROM orders")
def prj1(spark, sf):
    df = spark.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return clean.rename_column(df, "o_orderkey", "order_id")


@query("prj2_drop_column", sql="SELECT * EXCLUDE (o_orderpriority) FROM orders")
def prj2(spark, sf):
    return clean.drop_column(spark.table("orders"), "o_orderpriority")


@query("cl1_drop_duplicate_texts", sql="""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def cl1t(spark, sf):
    """Exact copies of whole texts: keep the document with the smallest id."""
    return clean.drop_duplicates(spark.table("documents"), subset=["text"], keep="first", order_by=["doc_id"])


FUSED_STEPS = [{"step_type": "grouped_aggregation",
                "params": {"group_by_column": "o_orderpriority", "agg_column": c, "agg_func": f}}
               for c, f in (("o_totalprice", "mean"), ("o_totalprice", "sum"), ("o_custkey", "nunique"),
                            ("o_totalprice", "max"), ("o_totalprice", "median"))]


@query("pl1_group_transforms_fused", views=["orders_nulls"],
       rounds={"o_totalprice_mean_by_o_orderpriority": 6, "o_totalprice_sum_by_o_orderpriority": 2}, sql="""
SELECT o.*, g.m AS o_totalprice_mean_by_o_orderpriority, g.s AS o_totalprice_sum_by_o_orderpriority,
       g.u AS o_custkey_nunique_by_o_orderpriority, g.x AS o_totalprice_max_by_o_orderpriority,
       g.md AS o_totalprice_median_by_o_orderpriority
FROM orders_nulls o LEFT JOIN (
  SELECT o_orderpriority, avg(o_totalprice) AS m, coalesce(sum(o_totalprice), 0) AS s, count(DISTINCT o_custkey) AS u,
         max(o_totalprice) AS x, median(o_totalprice) AS md
  FROM orders_nulls GROUP BY o_orderpriority) g ON o.o_orderpriority = g.o_orderpriority""")
def pl1f(spark, sf):
    """Five group transforms on one key: the step runner fuses them into one
    aggregation and one join (the exact median keeps its skew-safe path)."""
    return run_steps(spark.table("orders_nulls"), FUSED_STEPS)


@query("pl1_imputations_fused", views=["events_nulls"], rounds={"value": 6}, sql="""
SELECT event_id, ts, user_id,
       coalesce(event_type, (SELECT event_type FROM events_nulls WHERE event_type IS NOT NULL
                             GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type,
       coalesce(value, (SELECT median(value) FROM events_nulls)) AS value
FROM events_nulls""")
def pl1i(spark, sf):
    """Two imputations in a row: their statistics come from one pass (mode) and
    one quantile selection (median)."""
    return run_steps(spark.table("events_nulls"), [
        {"step_type": "impute_missing", "params": {"column": "event_type", "strategy": "mode"}},
        {"step_type": "impute_missing", "params": {"column": "value", "strategy": "median"}}])
