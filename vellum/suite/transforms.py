"""Transform steps (PRJ7-PRJ13) and feature steps (FE1-FE8)."""

from vellum.operators import features, transform
from vellum.operators.columns import column_options
from vellum.plans.steps import run_steps
from vellum.suite import query

SALES = ("l_orderkey, l_linenumber, first_name, last_name, revenue, cost, sales_amount, quantity")


@query("prj7_numeric_columns", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem""")
def prj7(spark, sf):
    df = spark.table("lineitem")
    return df.select(*column_options(df, "numeric"))


@query("prj7_categorical_columns", sql="SELECT l_returnflag, l_linestatus FROM lineitem")
def prj7c(spark, sf):
    df = spark.table("lineitem")
    return df.select(*column_options(df, "categorical"))


@query("prj8_full_name", views=["sales"],
       sql=f"SELECT {SALES}, concat_ws(' ', first_name, last_name) AS full_name FROM sales")
def prj8(spark, sf):
    return run_steps(spark.table("sales"), [{"step_type": "combine_columns", "params": {
        "columns": ["first_name", "last_name"], "new_column_name": "full_name", "separator": " "}}])


@query("prj8_combine_columns", views=["sales"],
       sql=f"SELECT {SALES}, concat_ws('-', first_name, last_name, l_linenumber) AS flag_status FROM sales")
def prj8c(spark, sf):
    return transform.combine_columns(spark.table("sales"), ["first_name", "last_name", "l_linenumber"],
                                     "flag_status", "-")


@query("prj9_profit", views=["sales"],
       sql=f"SELECT {SALES}, revenue - cost AS profit FROM sales")
def prj9(spark, sf):
    return transform.column_difference(spark.table("sales"), "revenue", "cost", "profit")


@query("prj10_sales_per_quantity", views=["sales"],
       sql=f"SELECT {SALES}, coalesce(sales_amount / nullif(quantity, 0), 0) AS sales_per_quantity FROM sales")
def prj10(spark, sf):
    return transform.column_ratio(spark.table("sales"), "sales_amount", "quantity", "sales_per_quantity")


@query("prj11_calculate_column", sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net FROM lineitem""")
def prj11(spark, sf):
    df = spark.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return transform.calculate_column(df, "net", "l_extendedprice * (1 - l_discount) * (1 + l_tax)") \
        .select("l_orderkey", "l_linenumber", "net")


# sqrt is correctly rounded in both engines (compared exactly); ln / log10 may differ in the last bit
@query("prj12_apply_function", rounds={"l_discount_ln": "f", "l_discount_log10": "f"}, sql="""
SELECT l_orderkey, l_linenumber, l_discount, l_extendedprice,
       CASE WHEN l_discount > 0 THEN ln(l_discount) END AS l_discount_ln,
       CASE WHEN l_extendedprice >= 0 THEN sqrt(l_extendedprice) END AS l_extendedprice_sqrt,
       CASE WHEN l_discount > 0 THEN log10(l_discount) END AS l_discount_log10
FROM lineitem""")
def prj12(spark, sf):
    df = spark.table("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_extendedprice")
    df = transform.apply_function(df, "l_discount", "ln")
    df = transform.apply_function(df, "l_extendedprice", "sqrt")
    return transform.apply_function(df, "l_discount", "log10")


INTERACTIONS = {"multiply": "l_quantity * l_discount", "divide": "l_quantity / nullif(l_discount, 0)",
                "add": "l_quantity + l_discount", "subtract": "l_quantity - l_discount"}

for _op, _expr in INTERACTIONS.items():
    _name = f"l_quantity_{_op[:3]}_l_discount"

    def _mk(op=_op):
        def run(spark, sf):
            df = spark.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
            return run_steps(df, [{"step_type": "numeric_interaction",
                                   "params": {"column1": "l_quantity", "column2": "l_discount", "operation": op}}])
        return run

    query(f"fe2_interaction_{_op}", sql=f"""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, {_expr} AS {_name} FROM lineitem""")(_mk())


@query("fe1_date_extraction", sql="""
SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
       CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek,
       CAST(hour(o_orderdate) AS INTEGER) AS o_orderdate_hour
FROM orders""")
def fe1(spark, sf):
    return features.date_extraction(spark.table("orders"), "o_orderdate",
                                    ["year", "month", "day", "dayofweek", "hour"])


@query("fe1_date_extraction_events", sql="""
SELECT event_id, ts, CAST(isodow(ts) - 1 AS INTEGER) AS ts_dayofweek, CAST(hour(ts) AS INTEGER) AS ts_hour FROM events""")
def fe1e(spark, sf):
    return features.date_extraction(spark.table("events").select("event_id", "ts"), "ts", ["dayofweek", "hour"])


GROUP_SQL = {
    "mean": "avg(o_totalprice)", "median": "median(o_totalprice)", "sum": "coalesce(sum(o_totalprice), 0)",
    "std": "stddev_samp(o_totalprice)", "count": "count(o_totalprice)", "nunique": "count(DISTINCT o_totalprice)",
    "min": "min(o_totalprice)", "max": "max(o_totalprice)",
}

for _f, _agg in GROUP_SQL.items():
    _new = f"o_totalprice_{_f}_by_o_orderpriority"

    def _mkg(f=_f):
        def run(spark, sf):
            return features.grouped_aggregation(spark.table("orders_nulls"), "o_orderpriority", "o_totalprice", f)
        return run

    _r = {_new: 4 if _f in ("sum",) else 6} if _f in ("mean", "sum", "std") else {}
    query(f"fe3_grouped_{_f}", views=["orders_nulls"], rounds=_r, sql=f"""
SELECT o.*, g.v AS {_new}
FROM orders_nulls o LEFT JOIN (SELECT o_orderpriority, {_agg} AS v FROM orders_nulls GROUP BY o_orderpriority) g
  ON o.o_orderpriority = g.o_orderpriority""")(_mkg())


@query("fe3_grouped_mean_window", views=["orders_nulls"], rounds={"o_totalprice_mean_by_o_orderpriority": 6}, sql="""
SELECT *, CASE WHEN o_orderpriority IS NOT NULL THEN avg(o_totalprice) OVER (PARTITION BY o_orderpriority) END
       AS o_totalprice_mean_by_o_orderpriority FROM orders_nulls""")
def fe3w(spark, sf):
    return features.grouped_aggregation(spark.table("orders_nulls"), "o_orderpriority", "o_totalprice", "mean")


@query("fe4_binning_uniform", sql="""
WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 5 AS step FROM orders)
SELECT o_orderkey, o_totalprice,
       CAST((o_totalprice >= 1 * step + lo)::INT + (o_totalprice >= 2 * step + lo)::INT
          + (o_totalprice >= 3 * step + lo)::INT + (o_totalprice >= 4 * step + lo)::INT AS DOUBLE)
       AS o_totalprice_binned_uniform
FROM orders, s""")
def fe4(spark, sf):
    df = spark.table("orders").select("o_orderkey", "o_totalprice")
    return features.binning(df, "o_totalprice", 5, "uniform")


@query("fe5_binning_quantile", sql="""
WITH s AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders)
SELECT o_orderkey, o_totalprice,
       CAST((o_totalprice >= q[1])::INT + (o_totalprice >= q[2])::INT + (o_totalprice >= q[3])::INT
          + (o_totalprice >= q[4])::INT AS DOUBLE) AS o_totalprice_binned_quantile
FROM orders, s""")
def fe5(spark, sf):
    df = spark.table("orders").select("o_orderkey", "o_totalprice")
    return features.binning(df, "o_totalprice", 5, "quantile")


@query("fe5_binning_quantile_collapsed", sql="""
WITH s AS (SELECT quantile_cont(p_size, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM part),
e AS (SELECT list_filter(q, lambda x, i: i = 1 OR x - q[i - 1] > 1e-8) AS k FROM s)
SELECT p_partkey, p_size,
       CAST(len(list_filter(k[2:len(k) - 1], lambda x: x <= p_size)) AS DOUBLE) AS p_size_binned_quantile
FROM part, e""")
def fe5c(spark, sf):
    return features.binning(spark.table("part").select("p_partkey", "p_size"), "p_size", 10, "quantile")


@query("fe6_binning_kmeans")
def fe6(spark, sf):
    df = spark.table("orders").select("o_orderkey", "o_totalprice")
    return features.binning(df, "o_totalprice", 4, "kmeans")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _onehot_sql(values):
    return ", ".join(f"CAST(CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"c_mktsegment_{v}\""
                     for v in values)


@query("fe7_one_hot", sql=f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, {_onehot_sql(SEGMENTS)} FROM customer")
def fe7(spark, sf):
    return features.categorical_encoding(spark.table("customer"), ["c_mktsegment"])


@query("fe7_one_hot_drop_first", sql=f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, {_onehot_sql(SEGMENTS[1:])} FROM customer""")
def fe7d(spark, sf):
    return features.categorical_encoding(spark.table("customer"), ["c_mktsegment"], drop="first")


@query("fe7_one_hot_nulls", views=["orders_nulls"], sql="""
SELECT o_orderkey, """ + ", ".join(
    f"CAST(CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"o_orderpriority_{v}\""
    for v in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) + """,
  CAST(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END AS DOUBLE) AS o_orderpriority_nan FROM orders_nulls""")
def fe7n(spark, sf):
    df = spark.table("orders_nulls").select("o_orderkey", "o_orderpriority")
    return features.categorical_encoding(df, ["o_orderpriority"])


@query("fe8_polynomial", views=["orders_nulls"], rounds={"o_custkey^2": "f", "o_custkey o_totalprice": "f",
                                                          "o_totalprice^2": "f"}, sql="""
WITH m AS (SELECT avg(o_custkey) AS mc, avg(o_totalprice) AS mt FROM orders_nulls),
f AS (SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS DOUBLE) AS c, coalesce(o_totalprice, mt) AS t
      FROM orders_nulls, m)
SELECT o_orderkey, o_orderstatus, c * c AS "o_custkey^2", c * t AS "o_custkey o_totalprice", t * t AS "o_totalprice^2"
FROM f""")
def fe8(spark, sf):
    df = spark.table("orders_nulls").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    return run_steps(df, [{"step_type": "polynomial_features",
                           "params": {"columns": ["o_custkey", "o_totalprice"], "degree": 2}}])


@query("fe8_polynomial_interaction_only", sql="""
SELECT p_partkey, CAST(p_size AS DOUBLE) * p_retailprice AS "p_size p_retailprice" FROM part""",
       rounds={"p_size p_retailprice": 6})
def fe8i(spark, sf):
    df = spark.table("part").select("p_partkey", "p_size", "p_retailprice")
    return features.polynomial_features(df, ["p_size", "p_retailprice"], 2, interaction_only=True)


@query("fe7_one_hot_vector", sql="""
SELECT c_custkey, list_transform(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', NULL],
       lambda v: CAST(CASE WHEN v IS NULL THEN c_mktsegment IS NULL ELSE c_mktsegment = v END AS DOUBLE)) AS c_mktsegment_vec
FROM customer""")
def fe7v(spark, sf):
    from pyspark.ml.functions import vector_to_array
    df = spark.table("customer").select("c_custkey", "c_mktsegment")
    out = features.categorical_encoding(df, ["c_mktsegment"], method="one-hot-vector")
    return out.select("c_custkey", vector_to_array("c_mktsegment_vec").alias("c_mktsegment_vec"))
